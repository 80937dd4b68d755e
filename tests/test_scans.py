"""Scans, trades as intervals, and runs that learn, against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import feedback, intervals, ledger, screening
from tickloom.operators.pairs import p_value

SIGNALS = "w int, pair string, ts int, coin_y string, coin_x string, y double, x double, beta double, z double, entry_mask boolean, exit_mask boolean"


def walks(seed, bars=120):
    rng, rows = random.Random(seed), []
    for w in range(2):
        for pair in ("a-b", "a-c", "b-c"):
            y = x = 0.0
            for t in range(bars):
                y, x = y + rng.gauss(0, 0.1), x + rng.gauss(0, 0.1)
                z = rng.choice([None, float("nan"), rng.gauss(0, 2), rng.gauss(0, 2), rng.gauss(0, 2)])
                beta = rng.choice([0.5, -0.7, 1.2, None]) if t % 9 == 0 else 0.8
                rows.append((w, pair, t, pair[0], pair[2], y, x, beta, z, rng.random() < 0.3 if t % 11 else None, rng.random() < 0.2))
    return rows


@pytest.mark.parametrize("hold, stop, most", [(10, 0.2, None), (1, 0.5, None), (200, 1e9, None), (25, 0.05, 3)])
def test_intervals_are_what_a_walk_over_bars_finds(spark, hold, stop, most):
    d = spark.createDataFrame(walks(hold), SIGNALS)
    names = ["w", "pair", "trade_seq", "entry_ts", "exit_ts", "dir", "hold_bars", "exit_reason", "gross", "fees", "slippage", "net", "mae", "mfe"]
    got = sorted(map(tuple, intervals.interval_trades(d, ["w"], 5e-4, 1e-4, hold, stop, most).select(*names).collect()))
    want = sorted(map(tuple, ledger.fold_trades(d, ["w"], 5e-4, 1e-4, hold, stop, {"trades": most} if most else None).select(*names).collect()))
    assert len(got) == len(want) > 20 or most
    assert [g[:8] for g in got] == [x[:8] for x in want] and all(a == pytest.approx(b) for g, x in zip(got, want) for a, b in zip(g[8:], x[8:]))


@pytest.mark.parametrize("block", [1, 3, 8])
def test_chains_over_many_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(intervals, "BLOCK", block)
    rng, rows, want = random.Random(block), [], set()
    for key, n in (("p", 60), ("q", 1), ("r", block), ("s", 2 * block + 1)):
        ends = [min(i + rng.choice([1, 1, 2, 5, 20]), n) for i in range(n)]
        rows += [(key, i, e if e < n else None) for i, e in enumerate(ends)]
        at = 0
        while at < n:
            want.add((key, at))
            at = ends[at]
    d = spark.createDataFrame(rows, "k string, i long, next long")
    got = [tuple(r) for r in intervals.chained(d, ["k"]).select("k", "i").collect()]
    assert len(got) == len(want) and set(got) == want


def test_no_signals_no_intervals(spark):
    d = spark.createDataFrame(walks(1), SIGNALS)
    assert intervals.interval_trades(d.where("false"), ["w"], 0.0, 0.0, 5, 1.0).count() == 0
    assert intervals.interval_trades(d.withColumn("entry_mask", F.lit(False)), [], 0.0, 0.0, 5, 1.0).count() == 0
    one = d.where("ts = 0 and pair = 'a-b'").withColumn("entry_mask", F.lit(True))
    assert intervals.interval_trades(one, ["w"], 0.0, 0.0, 5, 1.0).count() == 0  # a last bar opens nothing


def plain_lags(e, most):
    """Regressions one by one, on the rows that all share, then on all rows of the best."""
    d = np.diff(e)

    def fit(lags, rows):
        x = np.array([[e[len(e) - 1 - rows + i], *(d[len(d) - rows + i - k] for k in range(1, lags + 1))] for i in range(rows)])
        y = d[-rows:]
        coef = np.linalg.lstsq(x, y, rcond=None)[0]
        rest = ((y - x @ coef) ** 2).sum()
        cov = rest / (rows - lags - 1) * np.linalg.inv(x.T @ x)
        return rows * math.log(rest / rows) + 2 * (lags + 1), coef[0] / math.sqrt(cov[0, 0])

    best = min(range(most + 1), key=lambda k: (fit(k, len(d) - most)[0], k))
    return best, fit(best, len(d) - best)[1]


def test_chosen_lags():
    rng = np.random.default_rng(4)
    seen = set()
    for k in range(6):
        noise, e = rng.standard_normal(300), np.zeros(300)
        for t in range(6, 300):
            e[t] = 0.9 * e[t - 1] + (0.5 * (e[t - 1] - e[t - 2]) if k % 2 else 0) - (0.4 * (e[t - 3] - e[t - 4]) if k > 2 else 0) + noise[t]
        lags, t = screening.best_lags(e, 5)
        assert (lags, pytest.approx(t)) == plain_lags(e, 5)
        seen.add(lags)
    assert len(seen) > 1 and math.isnan(screening.best_lags(np.ones(50), 5)[1]) and math.isnan(screening.best_lags(np.ones(2), 5)[1])


def prices(spark, seed=2):
    """a and b move together and revert; c drifts away in the end; d is on its own; e is flat."""
    rng = np.random.default_rng(seed)
    n, rows = 400, []
    a = np.cumsum(rng.standard_normal(n)) * 0.01 + 3
    near = np.zeros(n)
    for t in range(1, n):
        near[t] = 0.8 * near[t - 1] + rng.standard_normal() * 0.02
    series = {"a": a, "b": 0.5 * a + near + 1, "c": a + near[::-1] + np.where(np.arange(n) > 370, 0.3, 0.0), "d": np.cumsum(rng.standard_normal(n)) * 0.01, "e": np.ones(n)}
    for s, v in series.items():
        rows += [(t, s, float(v[t])) for t in range(n)]
    return spark.createDataFrame(rows, "ts int, symbol string, lp double"), series


def test_scan_against_plain_figures(spark):
    d, series = prices(spark)
    got = {r["pair"]: r for r in screening.scan(d, (), screening.Limits(0.05, 0.002, 4.0, 0.5, 100.0), 0.9, 0.1).collect()}
    assert "a-e" not in got  # no correlation with what doesn't move
    for pair, r in got.items():
        y, x = (series[s] for s in pair.split("-"))
        y, x = (x, y) if r["direction"] == "x~y" else (y, x)
        beta = np.cov(y[:360], x[:360])[0, 1] / np.var(x[:360], ddof=1)
        s = y - beta * x
        e = s - s[:360].mean()
        slope = np.polyfit(e[:359], np.diff(e[:360]), 1)[0]
        lags, t = plain_lags(e[:360], 5)
        want = (beta, s[:360].std(ddof=1), -math.log(2) / slope if slope < -1e-10 else math.inf, np.abs(e[360:]).max() / s[:360].std(ddof=1), t, p_value(t, 2))
        assert (r["hedge_ratio"], r["spread_vol"], r["half_life"], r["max_z"], r["statistic"], r["p_value"]) == pytest.approx(want, rel=1e-6) and r["lags"] == lags
        plain = "volatility" if want[1] < 0.002 else "p_value" if want[5] >= 0.05 else "drift" if want[3] > 4 else "half_life" if not 0.5 <= want[2] <= 100 else None
        assert r["reason"] == plain
    assert got["a-b"]["reason"] is None and got["a-c"]["reason"] == "drift"


def test_scan_of_odd_prices(spark):
    d, _ = prices(spark)
    assert screening.scan(d.where("false")).count() == 0 and screening.scan(d.where("symbol = 'a'")).count() == 0
    few = {r["pair"]: r for r in screening.scan(d.where("ts < 4"), (), screening.Limits(), 0.9, 0.0).collect()}
    assert all(r["reason"] is not None for r in few.values())
    v = d.select("ts", "symbol", F.when(F.col("symbol") == "b", 1.0).otherwise(9.0).alias("volume"))
    assert {r[0] for r in screening.liquid(d, v, 5.0).select("symbol").distinct().collect()} == {"a", "c", "d", "e"}


def test_two_stages(spark):
    d, _ = prices(spark)
    d = d.withColumn("ts", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, ts)"))
    loose = screening.Limits(0.05, 0.002, 9.0, 0.5, 100.0)
    got = {r["pair"]: r for r in screening.two_stage(d, 16, 8, loose, screening.Limits(0.05, 0.002, 9.0, 0.5, 100.0, 1.0, 9.0), 0.05, (0.5, 100.0), (60, 8, 60, 15), 0.1, all_=True).collect()}
    pair = "a-b" if "a-b" in got else "b-a"
    assert got[pair]["passed_both"] and got[pair]["stage2_p_value"] < 0.05 and got[pair]["p_value"] == got[pair]["stage2_p_value"] and {got[pair]["coin_y"], got[pair]["coin_x"]} == {"a", "b"}
    none = {r["pair"]: r for r in screening.two_stage(d, 16, 8, loose, screening.Limits(0.05, 0.002, 9.0, 0.5, 100.0, 0.0, 9.0), 0.05, (0.5, 100.0), (60, 8, 60, 15), 0.1, all_=True).collect()}
    assert none[pair]["reason"] in ("rolling", None) and (none[pair]["reason"] is None or none[pair]["stage2_p_value"] is None)


def plain_feedback(rows, rules):
    book, names, out = {}, {}, {}
    for w in sorted({r["window_id"] for r in rows}):
        own = {}
        for r in (r for r in rows if r["window_id"] == w):
            g, c, n, s = book.get(r["pair"], (0, 0, 0, 0))
            share = c / abs(g) if abs(g) > 1e-10 else math.inf if c > 0 else 0.0
            legs = r["pair"].split("-")
            verdict = "listed" if any(names.get(x, {}).get("listed") for x in legs) else "costly" if share > rules.max_cost else "stopped" if n and s / n > rules.max_stops else "traded"
            out[(w, r["pair"])] = verdict
            if verdict == "traded":
                own[r["pair"]] = r
        legs = {}
        for pair, r in own.items():
            book[pair] = tuple(a + b for a, b in zip(book.get(pair, (0, 0, 0, 0)), (r["gross"], r["cost"], r["trades"], r["stops"])))
            for x in pair.split("-"):
                legs[x] = tuple(a + b / 2 for a, b in zip(legs.get(x, (0, 0, 0)), (r["net"], r["trades"], r["stops"])))
        for x, (pnl, n, s) in legs.items():
            if n >= rules.min_trades:
                t = names.setdefault(x, {"pnl": 0, "n": 0, "s": 0, "k": 0, "listed": False})
                t["pnl"], t["n"], t["s"], t["k"] = t["pnl"] + pnl, t["n"] + n, t["s"] + s, t["k"] + 1
                t["listed"] |= t["k"] >= rules.min_windows and (t["pnl"] / t["k"] < rules.worst_avg or t["s"] / t["n"] > rules.worst_stops)
    return out


RESULTS = "window_id long, pair string, gross double, cost double, net double, trades long, stops long"


def test_windows_learn_from_those_before(spark, tmp_path):
    rng = random.Random(8)
    pairs = [f"{a}-{b}" for i, a in enumerate("abcdef") for b in "abcdef"[i + 1 :]]
    rows = [(w, p, g := rng.gauss(0.001, 0.01), 0.0005 * n, g - 0.0005 * n, n, sum(rng.random() < 0.3 for _ in range(n))) for w in range(6) for p in pairs if rng.random() < 0.8 for n in [rng.randint(1, 9)]]
    d = spark.createDataFrame(rows, RESULTS)
    rules = feedback.Rules(min_trades=4.0)
    got = {(r["window_id"], r["pair"]): r["verdict"] for r in feedback.carried(d, str(tmp_path / "run"), rules).collect()}
    assert got == plain_feedback(d.collect(), rules) and set(got.values()) == {"listed", "costly", "stopped", "traded"}
    listed = {r["symbol"]: r["version"] for r in spark.read.parquet(str(tmp_path / "run/symbols")).where("listed").groupBy("symbol").agg(F.min("version").alias("version")).collect()}
    assert listed and all(v == "listed" for (w, p), v in got.items() for x in p.split("-") if x in listed and w > listed[x])


def test_a_run_goes_on_from_its_last_version(spark, tmp_path):
    """What is there already is read, not made again."""
    d = spark.createDataFrame([(w, "a-b", -0.01, 0.001, -0.011, 6, 0) for w in range(4)], RESULTS)
    path = str(tmp_path / "run")
    rules = feedback.Rules(min_windows=2, max_cost=9.0)
    feedback.carried(d.where("window_id < 3"), path, rules)
    listed = spark.createDataFrame([("b", 0.0, 0.0, 0.0, 5, True)], feedback.SYMBOLS)
    listed.write.mode("overwrite").parquet(f"{path}/symbols/version=2")
    assert [r["verdict"] for r in feedback.carried(d, path, rules).orderBy("window_id").collect()] == ["traded", "traded", "traded", "listed"]
    assert feedback.carried(d.where("false"), str(tmp_path / "none"), rules).count() == 0


def test_two_steps_have_a_statistic(spark):
    """Five bars leave three to train on: two steps, and one degree of freedom."""
    y, x = [1.0, 1.3, 1.1, 1.6, 1.2], [0.5, 0.9, 0.4, 0.8, 0.7]
    bars = spark.createDataFrame([("a-b", i, p, q) for i, (p, q) in enumerate(zip(y, x))], "pair string, ts long, y double, x double")
    got = {r["direction"]: r["df"] for r in screening.gates(screening.spreads(bars, (), 0.7), ()).collect()}
    for way, p, q in (("y~x", y, x), ("x~y", x, y)):
        p, q = np.array(p[:3]), np.array(q[:3])
        e = p - np.cov(p, q)[0, 1] / np.var(q, ddof=1) * q
        e -= e.mean()
        before, step = e[:-1], np.diff(e)
        rho = before @ step / (before @ before)
        left = step - rho * before
        assert got[way] == pytest.approx(rho / np.sqrt(left @ left / (before @ before)), rel=1e-6)
