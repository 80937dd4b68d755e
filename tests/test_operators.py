"""Operators on fixtures made by hand."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import asof, bars, entries, features, ledger, learning, pairs, screening, universe, walkforward
from tickloom.plans import fixtures, scans
from tickloom.sources import runs, tables
from tickloom.streaming import kalman, regimes, ticks

T0 = dt.datetime(2025, 1, 1)


def hours(n):
    return [T0 + dt.timedelta(hours=i) for i in range(n)]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_strict_read_rejects_repeats(spark):
    df = frame(spark, [(T0, "A", 1.0), (T0, "A", 2.0)], "ts timestamp_ntz, symbol string, close double")
    with pytest.raises(tables.BadIndex):
        tables.sane(df)
    assert tables.latest(df.withColumn("k", F.col("close")), ["ts", "symbol"], ["k"]).first()["close"] == 2.0


def test_nan_is_null(spark):
    assert tables.nullable(frame(spark, [(float("nan"),), (1.0,)], "x double")).where("x is null").count() == 1


def test_history_skips_bad_lines(spark, tmp_path):
    p = tmp_path / "t.jsonl"
    p.write_text('{"pair": "A-B", "ts": "2025-01-02T00:00:00"}\nnot json\n{"pair": "A-C", "ts": "2024-01-02T00:00:00"}\n')
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("pair", T.StringType()), T.StructField("ts", T.TimestampNTZType())])
    got = runs.read_trades(spark, str(p), schema, F.lit("2025-01-01").cast("timestamp_ntz")).collect()
    assert [r["pair"] for r in got] == ["A-B"]


def test_sinks_round_trip(spark, tmp_path):
    df = frame(spark, [("r", 0, 1.0), ("r", 1, 2.0)], "run_id string, window_id int, x double")
    runs.write_run(df, str(tmp_path / "run"))
    assert spark.read.parquet(str(tmp_path / "run")).where("window_id = 1").first()["x"] == 2.0


def test_gap_report(spark):
    ts = [T0 + dt.timedelta(minutes=m) for m in [*range(5), *range(11, 16)]]  # a jump of seven minutes
    got = bars.gaps(frame(spark, [("A", t, 1.0) for t in ts], "symbol string, ts timestamp_ntz, close double"), 60, (5, 10)).first()
    assert (got["gaps"], got["middle"], got["longest"], got["status"]) == (1, 1, 7.0, "warn")


def test_interpolation_stops_at_long_gaps(spark):
    px = [1.0, None, 3.0, None, None, None, 7.0]
    got = bars.interpolated(frame(spark, [("A", t, p) for t, p in zip(hours(7), px)], "symbol string, ts timestamp_ntz, close double"), 2).orderBy("ts")
    assert [r["px"] for r in got.collect()] == [1.0, 2.0, 3.0, None, None, None, 7.0]


def test_asof_takes_the_last_known(spark):
    left = frame(spark, [("A", t) for t in hours(4)], "k string, ts timestamp_ntz")
    right = frame(spark, [("A", hours(4)[1], 5.0), ("A", hours(4)[3], 6.0)], "k string, ts timestamp_ntz, v double")
    at = lambda strict: [r["v"] for r in asof.asof(left, right, ["k"], ["v"], strict=strict).orderBy("ts").collect()]
    assert at(False) == [None, 5.0, 5.0, 6.0]
    assert at(True) == [None, None, 5.0, 5.0]


# The figures of this test must match.
def test_masks_by_hand(spark):
    z, vol = [0, 2.1, 1.5, 0.4, 4.6], [0.001, 0.004, 0.004, 0.003, 0.004]
    d = frame(spark, [("A-B", t, float(a), v, 1.0) for t, a, v in zip(hours(5), z, vol)], "pair string, ts timestamp_ntz, z double, vol double, expected_profit double")
    got = entries.masks(d, 2, 0.5, 4.5, 4.5, 0.0, 0.002).orderBy("ts").collect()
    assert [r["entry_mask"] for r in got] == [False, True, False, False, False]
    assert [r["exit_mask"] for r in got] == [True, False, False, True, True]


def test_cooldown_is_longer_after_a_stop(spark):
    rows = [("P", t, i in (1, 3, 5), i == 0, 3) for i, t in enumerate(hours(6))]
    d = frame(spark, rows, "pair string, ts timestamp_ntz, entry_mask boolean, exit_mask boolean, exit_reason int")
    assert [r["blocked"] for r in entries.cooled(d, {0: 1, 3: 3}).orderBy("ts").collect()] == [False, True, False, True, False, False]


def test_greedy_cap(spark):
    d = frame(spark, [(0, "A-B", "A", "B", 1), (0, "A-C", "A", "C", 2), (0, "A-D", "A", "D", 3), (0, "B-C", "B", "C", 4)], "w int, pair string, coin_y string, coin_x string, rank int")
    got = {r["pair"] for r in entries.greedy(d, ["w"], ["rank", "pair"], 2).collect()}
    assert got == {"A-B", "A-C", "B-C"}


def ledger_rows(spark, nets, reasons=None):
    rows = [(0, "A-B", i + 1, T0, T0, 5, r, n + 0.001, 5e-4, 5e-4, n) for i, (n, r) in enumerate(zip(nets, reasons or [1] * len(nets)))]
    return frame(spark, rows, "window_id long, pair string, trade_seq long, entry_ts timestamp_ntz, exit_ts timestamp_ntz, hold_bars long, exit_reason long, gross double, fees double, slippage double, net double")


def test_only_a_win_ends_a_streak_of_stops(spark):
    nets = [0.05, 0.05, 0.05, 0.05, -0.001, -0.001, 0.0, -0.001]
    got = ledger.kill_switch(ledger_rows(spark, nets, [1, 1, 1, 1, 3, 3, 1, 3])).first()
    assert (got["disabled_at"], got["reason"]) == (8, "stop_streak")


def test_breaker_stays_tripped(spark):
    got = ledger.circuit_breaker(ledger_rows(spark, [0.001, -0.02, 0.05, 0.01]), ["window_id"]).orderBy("trade_seq").collect()
    assert [r["tripped"] for r in got] == [False, True, True, True]


def test_profit_factor_without_losses(spark):
    assert ledger.trade_stats(ledger_rows(spark, [0.1, 0.2]), ["pair"]).first()["profit_factor"] == 99.0


# The figures of this test must match.
def test_round_trip_trade(spark):
    """One trade, up 10 and 10 percent, back again."""
    y, x = np.log([100, 110, 100]), np.log([50, 55, 50])
    rows = [("ETH-BTC", t, "ETH", "BTC", float(a), float(b), 2.0, -2.1, i == 0, i == 2) for i, (t, a, b) in enumerate(zip(hours(3), y, x))]
    d = frame(spark, rows, "pair string, ts timestamp_ntz, coin_y string, coin_x string, y double, x double, beta double, z double, entry_mask boolean, exit_mask boolean")
    got = ledger.fold_trades(d, [], 5e-4, 5e-4, 100, 1.0).first()
    assert got["dir"] == 1 and got["hold_bars"] == 2 and got["exit_reason"] == 4
    assert abs(got["gross"]) < 1e-12 and abs(got["fees"] - 1e-3) < 1e-12
    assert abs(got["mae"] + np.log(1.1) / 3) < 1e-12


def test_stop_comes_before_time(spark):
    rows = [("A-B", t, "A", "B", p, 0.0, 0.0, -2.0, i == 0, False) for i, (t, p) in enumerate(zip(hours(5), [1.0, 0.4, 0.4, 0.4, 0.4]))]
    d = frame(spark, rows, "pair string, ts timestamp_ntz, coin_y string, coin_x string, y double, x double, beta double, z double, entry_mask boolean, exit_mask boolean")
    assert ledger.fold_trades(d, [], 0.0, 0.0, 1, 0.5).first()["exit_reason"] == 3


def test_portfolio_cap(spark):
    rows = [(p, t, *p.split("-"), 1.0, 1.0, 1.0, 2.0, True, False) for t in hours(3) for p in ("A-B", "A-C", "D-E")]
    d = frame(spark, rows, "pair string, ts timestamp_ntz, coin_y string, coin_x string, y double, x double, beta double, z double, entry_mask boolean, exit_mask boolean").withColumn("run", F.lit(0))
    assert {r["pair"] for r in ledger.fold_trades(d, ["run"], 0.0, 0.0, 9, 1.0, {"leg": 1}).collect()} == {"A-B", "D-E"}
    assert {r["pair"] for r in ledger.fold_trades(d, ["run"], 0.0, 0.0, 9, 1.0, {"portfolio": 1}).collect()} == {"A-B"}


def test_dickey_fuller_tells_walks_from_noise():
    rng = np.random.default_rng(7)
    assert pairs.p_value(pairs.adf(rng.normal(size=400))) < 0.01
    assert pairs.p_value(pairs.adf(np.cumsum(rng.normal(size=400)))) > 0.05
    assert abs(pairs.p_value(-2.86) - 0.05) < 0.002  # the published 5 percent point
    assert np.isnan(pairs.adf(np.ones(50)))


def test_scan_finds_a_cointegrated_pair(spark):
    rng = np.random.default_rng(42)
    x = np.cumsum(rng.normal(0, 0.02, 300)) + 5
    y = 1.3 * x + rng.normal(0, 0.01, 300)
    d = spark.createDataFrame(pd.DataFrame({"pair": "A-B", "ts": hours(300), "y": y, "x": x}))
    got = pairs.scan(d).first()
    slope = got["beta"] if got["direction"] == "y~x" else 1 / got["beta"]
    assert got["p_value"] < 0.01 and abs(slope - 1.3) < 0.05 and got["half_life"] < 5


def test_split_leaks_nothing(spark):
    d = walkforward.split(frame(spark, [(t,) for t in hours(10)], "ts timestamp_ntz"), 0.7)
    r = d.groupBy("role").agg(F.max("ts").alias("hi"), F.min("ts").alias("lo")).collect()
    by = {x["role"]: x for x in r}
    assert by["train"]["hi"] < by["test"]["lo"]


def test_drift_of_equal_samples_is_nothing(spark):
    x = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    assert abs(learning.stability(x, x).first()["psi"]) < 1e-9


def test_malformed_pairs(spark):
    d = frame(spark, [("A-B",), (" A - B-C ",), ("A",), ("-B",)], "pair string")
    a, b, ok = universe.legs(F.col("pair"))
    assert [tuple(r) for r in d.select(a, b, ok).collect()] == [("A", "B", True), ("A", "B-C", True), ("A", None, False), ("", "B", False)]


def kalman_bars(n=300):
    rng = np.random.default_rng(42)
    x = np.cumsum(rng.normal(0, 0.002, n)) + 5
    return pd.DataFrame({"pair": "A-B", "ts": hours(n), "y": 1.3 * x + rng.normal(0, 0.002, n), "x": x})


def test_kalman_state_can_be_carried(spark):
    """Filtering in two parts with the state in between is filtering at once."""
    d, p = spark.createDataFrame(kalman_bars()), kalman.Params(window=30)
    cut = F.lit(hours(300)[200])
    whole = kalman.filtered(d, p).where(F.col("ts") >= cut).orderBy("ts").toPandas()
    parts = kalman.filtered(d.where(F.col("ts") >= cut), p, kalman.warm_states(d.where(F.col("ts") < cut), p)).orderBy("ts").toPandas()
    assert np.allclose(whole["beta"], parts["beta"]) and np.allclose(whole["z"].astype(float), parts["z"].astype(float))


def test_kalman_looks_only_back():
    """A jump changes nothing before it, and stands out when it comes."""
    d = kalman_bars(200)
    jumped = d.assign(y=d["y"] + np.where(np.arange(200) >= 121, 0.1, 0.0))
    f, p = kalman._walk, kalman.Params(window=40)
    a, b = f(kalman.Filter(p), "A-B", d), f(kalman.Filter(p), "A-B", jumped)
    assert a["z"][:121].equals(b["z"][:121]) and abs(b["z"][121]) > 3 * abs(a["z"][121])


def test_kalman_stream_equals_batch(spark, tmp_path):
    d = kalman_bars(120)
    for i, part in enumerate((d[:70], d[70:])):
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    p = kalman.Params(window=30)
    src = spark.readStream.schema("pair string, ts timestamp_ntz, y double, x double").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = kalman.stream(src, p).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("ts").toPandas()
    want = kalman.filtered(spark.createDataFrame(d), p).orderBy("ts").toPandas()
    assert len(got) == 120 and np.allclose(got["beta"], want["beta"], atol=1e-6)


def test_live_bars_islands_and_repeats(spark, tmp_path):
    ts = [T0 + dt.timedelta(minutes=m) for m in (0, 5, 20, 61, 200)]
    rows = [("A", t, float(i), i) for i, t in enumerate(ts)] + [("A", ts[0], 0.0, 0)]
    frame(spark, rows, "symbol string, ts timestamp, value double, id int").coalesce(1).write.parquet(str(tmp_path / "in"))

    def run(name, make, mode):
        src = spark.readStream.schema("symbol string, ts timestamp, value double, id int").parquet(str(tmp_path / "in"))
        q = make(src).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).toPandas()

    got = run("bars_", lambda s: ticks.live_bars(s, "1 hour", "1 hour"), "complete").sort_values("start")
    assert list(got["n"]) == [4, 1, 1] and got["close"].iloc[0] == 2.0
    assert sorted(run("isl_", lambda s: ticks.islands(s, "30 minutes", "1 hour"), "complete")["n"]) == [1, 1, 4]
    assert len(run("once_", lambda s: ticks.once(s, ["symbol", "id"], "1 hour"), "append")) == 5


def test_decisions(spark):
    s = frame(spark, [("A-B", T0, 0.2), ("A-C", T0, 2.5), ("A-D", T0, 5.0), ("A-E", T0, 2.5)], "pair string, ts timestamp_ntz, z double")
    open_ = frame(spark, [("A-B",), ("A-D",), ("A-E",)], "pair string")
    got = {r["pair"]: r["action"] for r in ticks.decisions(s, open_, 2, 0.5, 4).collect()}
    assert got == {"A-B": "exit", "A-C": "enter", "A-D": "stop", "A-E": "hold"}


def test_regimes_change_one_step_at_a_time():
    rng = np.random.default_rng(1)
    px = 100 * np.exp(np.cumsum(np.r_[rng.normal(0, 0.001, 400), rng.normal(0, 0.05, 60), rng.normal(0, 0.001, 400)]))
    got = regimes.walk(px, 24, 24, 24)
    assert "RED" in got[400:470]
    steps = {(a, b) for a, b in zip(got, got[1:]) if a != b}
    assert ("RED", "GREEN") not in steps


def test_turns_are_graded(spark):
    """A positive run that turns after three bars, and a negative one that turns at once."""
    z = [1.0, 2.1, 2.3, 2.4, 2.3, 2.1, 0.5, -2.2, -2.5, -2.0]
    d = spark.createDataFrame([("p", i, x) for i, x in enumerate(z)], "pair string, ts int, z double")
    got = {r["ts"]: r for r in entries.inflection(d, 2.0).collect()}
    assert [got[i]["bars_since"] for i in range(10)] == [-1, 0, 1, 2, 3, 4, -1, 0, 1, -1]
    assert got[4]["peak"] and got[5]["peak"] and not got[3]["peak"] and not any(got[i]["valley"] for i in range(10))
    assert got[5]["confidence"] == pytest.approx(0.4 * 1.0 + 0.4 * (0.2 / 2.3) / 0.1 + 0.2) and got[3]["confidence"] == 0


def test_trades_in_and_out(spark):
    z = [0.0, 2.0, 2.5, 0.1, 3.0, 0.2, 0.0, -2.0]
    s = [1.0, 4.0, 5.0, 1.0, -2.0, -1.0, 0.0, 9.0]
    d = spark.createDataFrame([("p", i, a, b) for i, (a, b) in enumerate(zip(z, s))] + [("q", 0, None, 1.0)], "pair string, ts int, z double, spread double")
    got = {r["pair"]: (r["n_trades"], r["expectancy"]) for r in entries.in_and_out(d, 1.5, 0.5).collect()}
    assert got == {"p": (2, pytest.approx(((4 - 1) / 4 + (-1 + 2) / 2) / 2))}


def test_numbers_over_several_ranges(spark):
    d = spark.createDataFrame([(x,) for x in [5, 3, 9, 1, 7, 2, 8, 4, 6, 0, 6]], "k int")
    got = sorted((r["k"], r["__i"]) for r in learning.numbered(d, "k", 11, part=3).collect())
    assert [i for _, i in got] == list(range(11))


def test_histories_skip_bad_lines_and_reports_come_back(spark, tmp_path):
    states = spark.createDataFrame([("a-b", 1.0, [0.5, 0.25])], "pair string, x0 double, errors array<double>")
    runs.save_states(states, str(tmp_path / "s"))
    assert runs.load_states(spark, str(tmp_path / "s")).collect() == states.collect()
    report = spark.createDataFrame([("a-b", 3, 0.5), ("c-d", 1, None)], "pair string, trades long, win_rate double")
    runs.write_report(report, str(tmp_path / "r"))
    for kind in ("csv", "json"):
        assert sorted(runs.read_report(spark, str(tmp_path / "r"), report.schema, kind).collect(), key=str) == sorted(report.collect(), key=str)


def test_cells_of_a_sweep_are_runs(spark, sf):
    prices, w = scans.prices(spark, sf).where("symbol in ('click', 'view', 'error')"), fixtures.windows(spark, sf)
    limits = screening.Limits(max_p=1.0, max_z=1e9, min_half_life=0.0)
    spreads = walkforward.picked_spreads(prices, w, limits, 24, 0.8)
    got = {(r["max_p"], r["entry_z"], r["exit_z"]): r for r in walkforward.sweep_runs(spreads, [1.5, 9.0], [0.5], [0.01, 1.0]).collect()}
    assert len(got) == 4 and sorted(r["rank_net"] for r in got.values()) == [1, 2, 3, 4]
    for p in (0.01, 1.0):
        alone = walkforward.run(walkforward.run_trades(spreads.where(F.col("p_value") < p))).agg(F.coalesce(F.sum("trades"), F.lit(0)).alias("trades"), F.coalesce(F.sum("net"), F.lit(0.0)).alias("net")).first()
        assert got[(p, 1.5, 0.5)]["trades"] == alone["trades"] and got[(p, 1.5, 0.5)]["net"] == pytest.approx(alone["net"])
        assert got[(p, 9.0, 0.5)]["trades"] == 0 and got[(p, 9.0, 0.5)]["cheap"] is False
    assert got[(1.0, 1.5, 0.5)]["trades"] > 0


def test_features_of_missing_figures(spark):
    rows = [("p", i, z, v, 1.0 + i, 0.2, h, None) for i, (z, v, h) in enumerate([(None, None, 0), (2.0, 0.1, 2), (-2.5, 0.2, 0), (1.0, None, 3)])]
    d = spark.createDataFrame(rows, "pair string, ts int, z double, vol double, beta double, expected_profit double, expected_hold long, half_life double")
    s = {r["ts"]: r for r in features.for_scores(d, 1.5, 4.0).collect()}
    assert s[0]["z_score_abs"] is None and s[0]["is_expanding"] == 0 and s[0]["half_life_bars"] == 500 and s[0]["rolling_zero_crosses"] == 0
    assert s[1]["profit_per_bar"] == 0.001 and s[2]["profit_per_bar"] is None and s[2]["expected_profit"] == 0.1 and s[3]["spread_volatility"] is None
    empty = spark.createDataFrame([], "ts int, vol_regime_pctl double, trend_autocorr double")
    r = {x["ts"]: x for x in features.for_risk(d, empty, 1.5).collect()}
    assert (r[1]["vol_regime_pctl"], r[1]["trend_autocorr"], r[1]["spread_autocorr_lag1"], r[1]["half_life_normalized"]) == (0.5, 0.0, 0.0, None)
    assert [r[i]["is_fresh_extreme"] for i in range(4)] == [0, 0, 0, 0] and r[3]["is_reverting"] == 1 and r[2]["spread_vol_ratio"] == pytest.approx(0.2 / 0.15)
    assert features.for_scores(d.limit(0), 1.5, 4.0).count() == 0
