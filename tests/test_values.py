"""Values of tests and calibrations that SQL can't express, against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import learning, pairs
from tickloom.plans import fixtures


def plain_adf(x, lags):
    """The t value of the level, by the normal equations, with a constant."""
    d = np.diff(x)
    rows = [[x[t], 1.0, *(d[t - k] for k in range(1, lags + 1))] for t in range(lags, len(d))]
    a, y = np.array(rows), d[lags:]
    inverse = np.linalg.inv(a.T @ a)
    coef = inverse @ a.T @ y
    rest = y - a @ coef
    return coef[0] / math.sqrt(rest @ rest / (len(y) - a.shape[1]) * inverse[0, 0])


def series(seed, n, back):
    rng = np.random.default_rng(seed)
    s = np.zeros(n)
    for t in range(1, n):
        s[t] = (1 - back) * s[t - 1] + rng.standard_normal() * 0.1
    return s


def test_rolling_stationarity(spark):
    data = {"fast": series(1, 300, 0.5), "slow": series(2, 300, 0.01), "short": series(3, 50, 0.5)}
    d = spark.createDataFrame([(p, t, float(v)) for p, s in data.items() for t, v in enumerate(s)], "pair string, ts int, spread double")
    got = {r["pair"]: r for r in pairs.rolling_stationarity(d, 100, 30, lags=2, level=0.05).collect()}
    assert set(got) == {"fast", "slow"}
    for p, r in got.items():
        ps = [pairs.p_value(plain_adf(data[p][a : a + 100], 2), 1) for a in range(0, 201, 30)]
        assert r["n_windows"] == len(ps) == 7
        assert (r["mean_p"], r["max_p"], r["failure_rate"]) == pytest.approx((np.mean(ps), max(ps), np.mean([x > 0.05 for x in ps])))
    assert got["fast"]["failure_rate"] < got["slow"]["failure_rate"]


def walk(seed, n, back=0.3):
    rng = np.random.default_rng(seed)
    x = np.cumsum(rng.standard_normal(n)) * 0.1 + 3
    return x, 0.7 * x + series(seed + 50, n, back) + 1


def test_weighted_stationarity(spark):
    x, y = walk(4, 200)
    d = spark.createDataFrame([("p", t, float(y[t]), float(x[t])) for t in range(200)], "pair string, ts int, y double, x double")
    got = pairs.weighted_stationarity(d, 40, lags=1).first()
    w = 0.5 ** (np.arange(199, -1, -1) / 40)
    xm, ym = (w * x).sum() / w.sum(), (w * y).sum() / w.sum()
    beta = (w * (x - xm) * (y - ym)).sum() / (w * (x - xm) ** 2).sum()
    s = y - beta * x
    t = plain_adf(s[-120:], 1)
    slope = np.polyfit(s[:-1], np.diff(s), 1)[0]
    assert (got["beta"], got["n"], got["adf"], got["p_value"], got["half_life"]) == pytest.approx((beta, 120, t, pairs.p_value(t, 1), -math.log(2) / slope))


def test_subwindow_passes(spark):
    x, y = walk(6, 303, 0.8)
    y[202:] = np.cumsum(np.random.default_rng(9).standard_normal(101)) * 0.3 + 5  # the last part goes its own way
    d = spark.createDataFrame([("p", t, float(y[t]), float(x[t])) for t in range(303)], "pair string, ts int, y double, x double")
    got = pairs.subwindow_passes(d, 3, 0.05).first()
    lives = []
    for a in (0, 101, 202):
        both = []
        for u, v in ((x[a : a + 101], y[a : a + 101]), (y[a : a + 101], x[a : a + 101])):
            b, c = np.polyfit(v, u, 1)
            e = u - b * v - c
            slope = np.polyfit(e[:-1], np.diff(e), 1)[0]
            both.append((pairs.p_value(plain_adf(e, 1), 2), -math.log(2) / slope if slope < -1e-10 else math.inf))
        lives += [life for p, life in [min(both)] if p < 0.05]
    assert got["parts"] == 3 and got["passed"] == len(lives) >= 2 and got["pass_rate"] == pytest.approx(len(lives) / 3)
    assert got["half_life_cv"] == pytest.approx(np.std(lives) / np.mean(lives))


def test_platt_and_isotonic(spark):
    rng = np.random.default_rng(7)
    s = rng.standard_normal(400)
    y = (rng.random(400) < 1 / (1 + np.exp(-2 * s + 0.5))).astype(float)
    d = spark.createDataFrame([(float(a), float(b)) for a, b in zip(s, y)], "s double, y double")
    a, b = learning.platt(d)
    # the gradient of the smoothed likelihood vanishes there, and nowhere else
    t = np.where(y > 0.5, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    p = 1 / (1 + np.exp(a * s + b))
    assert abs(((t - p) * s).sum()) < 1e-6 and abs((t - p).sum()) < 1e-6 and a < 0
    got = learning.isotonic(d).orderBy("s").toPandas()
    # pooled neighbours: blocks of means that rise
    blocks = []
    for v in y[np.argsort(s)]:
        blocks.append([v, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            (m, k), (q, n) = blocks.pop(), blocks.pop()
            blocks.append([(m * k + q * n) / (k + n), k + n])
    assert np.allclose(got["p"], np.concatenate([np.full(n, m) for m, n in blocks]))


def test_bars_and_windows_follow_the_events(spark, tmp_path):
    rows = [("2025-03-02 05:10:00", "a", 1.0), ("2025-03-02 05:40:00", "a", 2.0), ("2025-03-21 23:30:00", "b", 3.0)]
    e = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    e.write.parquet(str(tmp_path / "some" / "events.parquet"))
    sf = str(tmp_path / "some")
    b = {(r.symbol, str(r.ts)): r.px for r in fixtures.bars(spark, sf).collect()}
    assert len(b) == 2 * 20 * 24 and b["a", "2025-03-02 04:00:00"] is None and b["a", "2025-03-21 23:00:00"] == 2.0 and b["b", "2025-03-21 23:00:00"] == 3.0
    w = fixtures.windows(spark, sf).orderBy("window_id").collect()
    assert [r.window_id for r in w] == [0, 1] and str(w[1].train_start) == "2025-03-07 00:00:00" and str(w[1].test_end) == "2025-03-22 00:00:00"
    assert fixtures.windows(spark, sf, 20, 5, 5).count() == 0
    e.where("false").write.parquet(str(tmp_path / "none" / "events.parquet"))
    assert fixtures.bars(spark, str(tmp_path / "none")).count() == 0 == fixtures.windows(spark, str(tmp_path / "none")).count()
