"""Streams that keep state against batches of the same rows, and tables that grow by deliveries."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import adapting, bars, ledger
from tickloom.plans import fixtures
from tickloom.sources import runs as R
from tickloom.sources import tables
from tickloom.streaming import kalman, ticks

T0 = dt.datetime(2025, 1, 1)


def landed(stream, spark, path):
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@pytest.mark.parametrize("name", ["stream_bars", "stream_once", "stream_decisions"])
def test_streams_read_folders_as_files(spark, sf, tmp_path, name):
    from tickloom import registry

    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    a, b = (sorted(map(str, registry.QUERIES[name](spark, d).collect())) for d in (sf, str(tmp_path)))
    if name != "stream_decisions":  # a pair's ticks come in order of time there, which files of a folder don't promise
        assert a == b
    assert len(a) and len(b)


def test_a_stream_of_nothing_fails(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        R.stream_of(spark, f"{tmp_path}/events.parquet", fixtures.table(spark, "/root/testdata/sf0.001", "events").schema)


def ticks_of(seed, n=300):
    rng, out = random.Random(seed), []
    for pair in ("a-b", "c-d"):
        t = T0
        for _ in range(n):
            t += dt.timedelta(minutes=rng.choice([10, 30, 60, 600]))
            out.append((pair, t, rng.choice([None, rng.gauss(0, 1.5), rng.gauss(0, 1.5), rng.gauss(0, 1.5)])))
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_decisions_of_a_stream_are_those_of_a_batch(spark, tmp_path, batches):
    """Whatever the batches; what opens in one closes in another, by a tick or by its timer."""
    rows, rules = ticks_of(3), ticks.Rules(hours=5)
    stops = sorted(r[1] for r in rows)
    edges = [stops[len(stops) * i // batches] for i in range(batches)] + [stops[-1] + dt.timedelta(1)]
    schema = "pair string, ts timestamp, z double"
    for a, b in zip(edges, edges[1:]):
        spark.createDataFrame([r for r in rows if a <= r[1] < b], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = landed(ticks.live_decisions(src, rules, "1 hours"), spark, tmp_path)
    want = ticks.decided(spark.createDataFrame(rows, schema), rules, "1 hours")
    key = lambda df: sorted((r["pair"], r["ts"], r["action"], round(r["z"], 9) if r["z"] is not None and r["z"] == r["z"] else None) for r in df.collect())
    a, b = key(got), key(want)
    assert a == b and {r[2] for r in a} == {"enter", "exit", "stop", "time", "hold"}
    for pair in ("a-b", "c-d"):
        acts = [r[2] for r in sorted((x for x in a if x[0] == pair), key=lambda x: (x[1], x[2] != "time")) if r[2] != "hold"]
        assert all((x == "enter") != (y == "enter") for x, y in zip(acts, acts[1:]))  # never two open, never one closed twice


def by_rule(rules, rows, since=None):
    """Decisions tick by tick."""
    out, hold = [], dt.timedelta(hours=rules.hours)
    for ts, z in rows:
        if since is not None and since + hold <= ts:
            out.append((since + hold, "time"))
            since = None
        size, action = abs(z) if z is not None else None, "hold"
        if size is not None and since is not None and size > rules.stop:
            action, since = "stop", None
        elif size is not None and since is not None and size < rules.leave:
            action, since = "exit", None
        elif size is not None and since is None and rules.entry < size <= rules.stop:
            action, since = "enter", ts
        out.append((ts, action))
    return out, since


@pytest.mark.parametrize("rules", [ticks.Rules(hours=2), ticks.Rules(1.0, 1.3, 2.0, 1), ticks.Rules(1.5, 0.1, 9.0, 5), ticks.Rules(hours=0)])
def test_decisions_follow_the_rule_tick_by_tick(rules):
    ns = lambda t: int(np.datetime64(t, "ns").view(np.int64))
    for seed in range(60):
        rng, t, rows = random.Random(seed), T0, []
        for _ in range(seed):
            t += dt.timedelta(minutes=rng.choice([0, 10, 30, 60, 600]))
            rows.append((t, rng.choice([None, rng.gauss(0, 1.5), rng.gauss(0, 1.5), rng.gauss(0, 1.5)])))
        rows.sort(key=lambda r: (r[0], r[1] is None, r[1] or 0.0))
        for since in (None, T0 - dt.timedelta(minutes=50)):
            want, left = by_rule(rules, rows, since)
            does, timed, now = ticks._act(rules, np.array([ns(r[0]) for r in rows], np.int64), np.array([np.nan if r[1] is None else r[1] for r in rows], float), None if since is None else ns(since))
            assert list(ticks.DOES[does]) == [a for _, a in want if a != "time"] and list(timed) == [ns(x) for x, a in want if a == "time"]
            assert now == (None if left is None else ns(left))


def test_a_pairs_ticks_are_held_as_numbers():
    """A worker's memory is a few numbers for each tick, and rows go out in pieces."""
    import tracemalloc

    n, rng = 300_000, np.random.default_rng(8)
    frames = [ticks.pd.DataFrame({"pair": "p", "ts": ticks.pd.Timestamp(T0) + ticks.pd.to_timedelta(rng.integers(0, 10**9, 10_000), "s"), "z": rng.standard_normal(10_000)}) for _ in range(n // 10_000)]
    tracemalloc.start()
    sizes = [len(p) for p in ticks._decide(ticks.Rules(), "p", iter(frames), None, lambda at: False)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) >= n and max(sizes) <= ticks.CHUNK and peak < 90 * n


def test_parts_in_order(spark):
    d = spark.range(1000).select((F.col("id") % 300).cast("timestamp").alias("ts"), "id")
    parts = [sorted(map(tuple, p.collect())) for p in ticks.in_order(d, 200, 3)]
    assert len(parts) == 5 and sorted(x for p in parts for x in p) == sorted(map(tuple, d.collect()))
    assert all(a[-1][0] < b[0][0] for a, b in zip(parts, parts[1:])) and max(map(len, parts)) < 400
    assert [p.count() for p in ticks.in_order(d, 1000)] == [1000]


def test_decisions_over_batches_are_those_of_one(spark, sf, monkeypatch):
    from tickloom import registry
    from tickloom.plans import online

    one = sorted(map(str, registry.QUERIES["stream_decisions"](spark, sf).collect()))
    monkeypatch.setattr(online, "BATCH", 300)
    assert sorted(map(str, registry.QUERIES["stream_decisions"](spark, sf).collect())) == one


def test_no_rows_no_decisions(spark):
    d = spark.createDataFrame([], "pair string, ts timestamp, z double")
    assert ticks.decided(d, ticks.Rules(), "1 hours").count() == 0


def test_late_rows_have_a_table_of_their_own(spark, tmp_path):
    schema = "id int, ts timestamp, v double"
    day = lambda k: T0 + dt.timedelta(days=k)
    deliveries = [[(1, day(0), 1.0), (2, day(40), 2.0), (2, day(40), 2.0)], [(2, day(40), 2.0), (3, day(5), 3.0), (4, day(39), 4.0), (3, day(5), 3.0)], [(3, day(5), 3.0), (5, day(0), 5.0), (6, day(41), 6.0), (4, day(39), 4.0)], []]
    apply = ticks.late_aside(str(tmp_path), ["id"], 3)
    for k, rows in enumerate(deliveries):
        for _ in range(2):  # a batch that is done again changes nothing
            apply(spark.createDataFrame(rows, schema), k)
    ids = lambda p: sorted(r["id"] for r in spark.read.schema(schema).parquet(p).collect())
    assert ids(f"{tmp_path}/on_time/*") == [1, 2, 4, 6] and ids(f"{tmp_path}/late") == [3, 5]


def test_months_that_nothing_touches_keep_their_files(spark, tmp_path):
    rng, path = random.Random(1), str(tmp_path / "t")
    schema = "symbol string, ts timestamp_ntz, value double, seq int"
    rows = [(rng.choice("ab"), T0 + dt.timedelta(days=rng.randrange(100)), rng.random(), k) for k in range(200)]
    tables.upsert_by_month(spark.createDataFrame(rows, schema), path, ["symbol", "ts"], ["seq"])
    files = lambda: {str(f.relative_to(path)): f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    new = [("a", T0 + dt.timedelta(days=d), 9.0, 1000 + d) for d in (1, 40)]
    for _ in range(2):
        tables.upsert_by_month(spark.createDataFrame(new, schema), path, ["symbol", "ts"], ["seq"])
        got = sorted(map(tuple, spark.read.schema(schema).parquet(path).drop("month").collect()))
        assert got == sorted(map(tuple, tables.latest(spark.createDataFrame(rows + new, schema), ["symbol", "ts"], ["seq"]).select("symbol", "ts", "value", "seq").collect()))
    after = files()
    kept = [f for f in before if "2025-01" not in f and "2025-02" not in f]
    assert kept and all(after[f] == before[f] for f in kept) and any(f not in after for f in before)
    tables.upsert_by_month(spark.createDataFrame([], schema), path, ["symbol", "ts"], ["seq"])
    assert files() == after


def test_a_large_month_has_several_writers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "MONTH_FILE", 50)
    schema, path = "symbol string, ts timestamp_ntz, value double, seq int", str(tmp_path / "t")
    rows = [("a", T0 + dt.timedelta(minutes=k if k < 400 else 10**5 + k), float(k), k) for k in range(420)] + [("n", None, 1.0, 0)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which joins tasks as small as these
    try:
        tables.upsert_by_month(spark.createDataFrame(rows, schema), path, ["symbol", "ts"], ["seq"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [f.parent.name for f in (tmp_path / "t").rglob("*.parquet")]
    assert files.count("month=2025-01-01") > 1 and files.count("month=2025-03-01") == 1 and len(set(files)) == 3
    for _ in range(2):
        got = sorted(map(tuple, spark.read.schema(schema).parquet(path).drop("month").collect()), key=lambda r: (r[0], r[3]))
        assert got == sorted(rows, key=lambda r: (r[0], r[3]))
        tables.upsert_by_month(spark.createDataFrame(rows, schema), path, ["symbol", "ts"], ["seq"])


def test_parameters_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [("p", k, T0 + dt.timedelta(hours=7 * k + rng.random()), rng.gauss(0.0005 if k // 150 % 2 else -0.0005, 0.001)) for k in range(900)]
    schema = "pair string, trade_seq long, exit_ts timestamp_ntz, net double"
    d = spark.createDataFrame(rows, schema)
    last = d.agg(F.max("exit_ts")).first()[0]
    want = sorted(map(tuple, ticks.changed(adapting.trailing_parameters(d, 2.0, 0.8, 7, 21).where(F.col("period_end") <= F.lit(last))).collect()))
    apply = ticks.parameter_updates(str(tmp_path), 2.0, 0.8, 7, 21)
    for k, (a, b) in enumerate(((0, 100), (100, 103), (103, 700), (700, 900))):
        for _ in range(2):
            apply(spark.createDataFrame(rows[a:b], schema), k)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out/*").collect()))
    assert got == want and len({r[3] for r in got}) > 1


def test_folds_in_a_row_are_the_figures_of_all_trades(spark):
    rng = random.Random(6)
    rows = [(k % 3, k // 40, k, None if rng.random() < 0.1 else round(rng.gauss(0, 1), 2)) for k in range(1500)] + [(3, 0, 0, -1.0), (3, 1, 1, None), (4, 5, 9, None), (5, 0, 0, 2.0)]
    d = spark.createDataFrame(rows, "g int, hour int, trade_seq int, net double")
    got = ledger.folds_in_a_row(ledger.trade_folds(d, ["g", "hour"]), ["g"], "hour").orderBy("g").collect()
    want = ledger.trade_stats(d, ["g"]).orderBy("g").collect()
    assert len(got) == len(want) == 6
    for a, b in zip(got, want):
        assert {c: a[c] for c in ("g", "n", "win_rate")} == {c: b[c] for c in ("g", "n", "win_rate")} and all(a[c] == pytest.approx(b[c]) for c in ("max_dd", "profit_factor"))


def test_a_delivery_of_many_files_is_one_batch(spark, tmp_path):
    got = []
    start = lambda src: ticks.each_batch(src, lambda b, k: got.append((k, sorted(r[0] for r in b.collect()))), f"{tmp_path}/checkpoint")
    ticks.delivered([spark.range(a, b, 1, 3) for a, b in ((0, 30), (30, 32), (32, 90))], str(tmp_path), start)
    assert got == [(0, list(range(30))), (1, [30, 31]), (2, list(range(32, 90)))]
    assert len(list((tmp_path / "in").glob("*.parquet"))) > 3


@pytest.mark.parametrize("name", ["stream_parameters", "stream_late"])
def test_no_task_writes_a_whole_delivery(spark, sf, monkeypatch, name):
    """Deliveries of large tables have the files that their tasks write."""
    from tickloom import registry

    seen, plain = [], ticks.delivered
    monkeypatch.setattr(ticks, "delivered", lambda parts, *rest: plain((seen.append(p._jdf.queryExecution().optimizedPlan().toString()) or p for p in parts), *rest))
    assert registry.QUERIES[name](spark, sf).count()
    assert len(seen) > 1 and not any("Repartition 1" in plan for plan in seen)


def test_tasks_grow_with_the_rows(spark, sf, monkeypatch):
    from tickloom import registry

    assert R.tasks_for(spark, 10**6) is None and R.tasks_for(spark, 36 * 10**6 + 1) == 37
    whole = [sorted(map(str, registry.QUERIES[q](spark, sf).collect())) for q in ("stream_parameters", "trailing_parameters")]
    monkeypatch.setattr(R, "TASK_ROWS", 900)
    assert [sorted(map(str, registry.QUERIES[q](spark, sf).collect())) for q in ("stream_parameters", "trailing_parameters")] == whole


def test_volatilities(spark):
    rng = np.random.default_rng(2)
    e = rng.standard_normal(120)
    rows = [("p", i, None if i % 17 == 3 else float(v)) for i, v in enumerate(e)]
    d = spark.createDataFrame(rows, "pair string, ts int, e double")
    got = d.select("ts", bars.ewma_vol("e", 20, 0.2).alias("w"), bars.mad_vol("e", 20).alias("m")).orderBy("ts").collect()
    for i, r in enumerate(got):
        past = np.array([v for _, _, v in rows[max(0, i - 19) : i + 1] if v is not None])
        for how, x in (("ewma", r["w"]), ("mad", r["m"])):
            want = kalman.spread_of(past, kalman.Params(vol=how))
            assert x == pytest.approx(want) or want == 0.01 and abs(x) < 1e-8


def test_gates_of_the_filter():
    """z waits for errors, is nothing where the ratio's gain is large, and shrinks with the ratio's variance."""
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.standard_normal(80)) * 0.1 + 3
    y = 0.7 * x + rng.standard_normal(80) * 0.01
    run = lambda f: [f.update(a, b) for a, b in zip(y, x)]
    base = run(kalman.Filter(kalman.Params(window=20)))
    assert all(r[0] is None for r in base[:20]) and all(r[0] is not None for r in base[20:] if r[5] <= 0.3)
    assert [r[0] for r in run(kalman.Filter(kalman.Params(window=20, max_gain=0.0)))] == [None] * 80
    start = (0.7, 0.0, 2.0, 0.0, 1.0, [0.01] * 10 + [-0.01] * 10)
    full, half = (kalman.Filter(kalman.Params(window=20, max_gain=9.0, max_p=p), start).update(3.0, 3.0)[0] for p in (2.0, 0.5))
    assert half == pytest.approx(full / 4)
    for how in ("std", "ewma", "mad"):
        z = kalman.Filter(kalman.Params(window=20, vol=how, max_gain=9.0, max_p=9.0), start).update(3.0, 3.0)
        assert z[0] == pytest.approx(z[3] / kalman.spread_of(np.array(start[-1]), kalman.Params(vol=how)))


def test_scalar_updates_are_the_matrix_ones():
    rng = np.random.default_rng(4)
    f = kalman.Filter(kalman.Params(window=5))
    s, p, q = np.array([1.0, 0.0]), np.eye(2), np.diag([1e-6 / 100, 1e-6])
    for _ in range(60):
        x, y = rng.standard_normal(2)
        h = np.array([x, 1.0])
        a = np.clip(p + q, 1e-10, 1e6)
        k = np.clip(a @ h / (h @ a @ h + 0.01), -1, 1)
        e = y - h @ s
        left = np.eye(2) - np.outer(k, h)
        s, p = s + k * e, np.clip(left @ a @ left.T + 0.01 * np.outer(k, k), 1e-10, 1e6)
        f.update(y, x)
        assert (f.x0, f.x1) == pytest.approx(tuple(s)) and (f.p00, f.p01, f.p11) == pytest.approx((p[0, 0], p[0, 1], p[1, 1]))
    assert len(f.state()[-1]) == 5


def test_the_end_of_the_training_part(spark):
    rows = [(p, T0 + dt.timedelta(hours=i), 1.0, 1.0) for p in ("short", "long", "new", "none") for i in range(60 * 24 if p != "new" else 90)]
    lives = spark.createDataFrame([("short", 5.0), ("long", float("inf")), ("new", 5.0)], "pair string, half_life double")
    got = dict(kalman.last_days(spark.createDataFrame(rows, "pair string, ts timestamp_ntz, y double, x double"), lives).groupBy("pair").count().collect())
    assert got == {"short": 7 * 24 + 1, "long": 45 * 24 + 1, "new": 90, "none": 60 * 24}


def test_spread_check(spark):
    rng = np.random.default_rng(6)
    x = np.cumsum(rng.standard_normal(400)) * 0.05 + 3
    series = {"good": 0.8 * x + rng.standard_normal(400) * 0.02, "moved": np.where(np.arange(400) < 200, 0.8, 2.0) * x + rng.standard_normal(400) * 0.02}
    rows = [(p, i, float(v[i]), float(x[i])) for p, v in series.items() for i in range(400)] + [("short", i, 1.0, 1.0) for i in range(60)]
    ratios = spark.createDataFrame([("good", 0.8), ("moved", 0.8), ("short", 1.0)], "pair string, beta double")
    got = {r["pair"]: r for r in kalman.spread_check(spark.createDataFrame(rows, "pair string, ts int, y double, x double"), ratios).collect()}
    assert got["good"]["valid"] and got["good"]["reason"] is None and got["good"]["p_value"] < 0.05
    assert got["short"]["reason"] == "short" and not got["moved"]["valid"] and got["moved"]["reason"] in ("unstable", "divergence") and got["moved"]["divergence"] > 0.3
    # the same by matrices
    s, p = np.array([0.8, 0.0]), np.eye(2)
    for a, b in zip(series["good"], x):
        h = np.array([b, 1.0])
        p = p + 1e-6 * np.eye(2)
        k = p @ h / (h @ p @ h + 0.01)
        s, p = s + k * (a - h @ s), (np.eye(2) - np.outer(k, h)) @ p
    assert got["good"]["kalman_beta"] == pytest.approx(s[0])
