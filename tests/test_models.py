"""Models that windows hand on, and reports on odd rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import models, reports

T0 = dt.datetime(2025, 1, 1)
COLS = ["a", "b", "c"]


def rows(spark, n=400, seed=1, shuffled=False):
    """won follows a, mae follows b; c says nothing, and is missing at times."""
    rng = np.random.default_rng(seed)
    a, b, c = rng.standard_normal((3, n))
    won, mae = (a + 0.3 * rng.standard_normal(n) > 0).astype(float), np.abs(b) + 0.05 * rng.standard_normal(n)
    if shuffled:
        won, mae = rng.permutation(won), rng.permutation(mae)
    data = [(i // (n // 4), T0 + dt.timedelta(days=10 * (i // (n // 4))), T0 + dt.timedelta(days=10 * (i // (n // 4)), hours=i % 7), i, float(a[i]), float(b[i]), None if i % 13 == 0 else float("nan") if i % 17 == 0 else float(c[i]), float(won[i]), float(mae[i])) for i in range(n)]
    return spark.createDataFrame(data, "window_id long, starts timestamp_ntz, known_at timestamp_ntz, i int, a double, b double, c double, won double, mae double")


TARGETS = (models.Target("won", "score", True, 0.5), models.Target("mae", "predicted_mae", False, None))


def test_saved_models_score_as_they_did(spark, tmp_path):
    d = rows(spark)
    train, test = d.where("window_id < 3"), d.where("window_id = 3")
    assert models.fit(train, COLS, TARGETS, str(tmp_path / "m"), rounds=5) == ["score", "predicted_mae"]
    one, two = (models.scored(test, COLS, TARGETS, str(tmp_path / "m")).orderBy("i").toPandas() for _ in range(2))
    assert one.equals(two) and list(one.columns) == [*d.columns, "score", "predicted_mae", "confidence"] and len(one) == 100
    assert ((one["score"] > 0.5) == (one["won"] > 0.5)).mean() > 0.75 and np.corrcoef(one["predicted_mae"], one["mae"])[0, 1] > 0.7
    # confidence by hand, missing values at their means
    t = train.toPandas()
    z = np.abs(((one[COLS].fillna(t[COLS].mean())) - t[COLS].mean()) / t[COLS].std())
    assert np.allclose(one["confidence"], np.clip(1 - z.mean(axis=1) / 3, 0, 1))


def test_labels_that_mean_nothing_teach_nothing(spark, tmp_path):
    d = rows(spark, shuffled=True)
    models.fit(d.where("window_id < 3"), COLS, TARGETS, str(tmp_path / "m"), rounds=5)
    got = models.scored(d.where("window_id = 3"), COLS, TARGETS, str(tmp_path / "m")).toPandas()
    assert abs(((got["score"] > 0.5) == (got["won"] > 0.5)).mean() - 0.5) < 0.2 and abs(np.corrcoef(got["predicted_mae"], got["mae"])[0, 1]) < 0.35


def test_without_models_there_are_defaults(spark, tmp_path):
    d = rows(spark, 40)
    for path in (None, str(tmp_path / "nowhere")):
        got = models.scored(d, COLS, TARGETS, path).toPandas()
        assert (got["score"] == 0.5).all() and got["predicted_mae"].isna().all() and (got["confidence"] == 0).all()
    # too few rows, one class only, a feature that never has a value
    few = d.withColumn("won", F.lit(1.0)).withColumn("c", F.lit(None).cast("double"))
    assert models.fit(few, COLS, TARGETS, str(tmp_path / "few"), rounds=2, least=30) == ["predicted_mae"]
    got = models.scored(few, COLS, TARGETS, str(tmp_path / "few")).toPandas()
    assert (got["score"] == 0.5).all() and got["predicted_mae"].notna().all()
    assert models.fit(d.where("false"), COLS, TARGETS, str(tmp_path / "none")) == []
    assert models.scored(d, COLS, TARGETS, str(tmp_path / "none")).count() == 40


def test_windows_hand_models_on(spark, tmp_path):
    """Two windows have none; later ones use what was fitted on rows known by then; a version that is there is used again."""
    d = rows(spark).withColumn("known_at", F.when(F.col("i") % 2 == 0, F.col("known_at")).otherwise(F.lit(dt.datetime(2030, 1, 1)).cast("timestamp_ntz")))
    path = str(tmp_path / "run")
    got = models.by_window(d, COLS, TARGETS, path, rounds=3).toPandas()
    assert len(got) == 400 and (got[got["window_id"] < 2]["score"] == 0.5).all() and (got[got["window_id"] >= 2]["score"] != 0.5).all()
    again = models.by_window(d.withColumn("won", 1 - F.col("won")), COLS, TARGETS, path, rounds=3).toPandas()
    assert np.allclose(again.sort_values("i")["score"], got.sort_values("i")["score"])
    known = d.where("window_id < 2 and i % 2 = 0")
    models.fit(known, COLS, TARGETS, str(tmp_path / "plain"), rounds=3)
    plain = models.scored(d.where("window_id = 2"), COLS, TARGETS, str(tmp_path / "plain")).toPandas()
    assert np.allclose(plain.sort_values("i")["score"], got[got["window_id"] == 2].sort_values("i")["score"])
    assert models.by_window(d.where("false"), COLS, TARGETS, str(tmp_path / "no")).count() == 0


def test_return_scores(spark):
    d = spark.createDataFrame([(-1.0,), (-0.05,), (0.0,), (0.02,), (9.0,)], "r double")
    assert [round(r[0], 9) for r in d.select(models.return_score(F.col("r"))).collect()] == [0.0, 0.0, 0.5, 0.7, 1.0]


def test_windows_that_all_win_compare_with_nothing(spark):
    d = spark.createDataFrame([(w, 0.1 * w + 0.01, 5.0, 0.2, 0.6, 0.0, 1.0, 0.1, 0.3) for w in range(3)], "window_id int, " + ", ".join(f"{c} double" for c in reports.FIGURES))
    got = {r["metric"]: r for r in reports.losing_windows(d).collect()}
    assert len(got) == 8 and all(r["losing_mean"] is None and r["delta"] is None and r["winning_count"] == 3 for r in got.values())
    assert reports.window_advice(reports.losing_windows(d)).count() == 0
    bad = reports.losing_windows(d.unionByName(d.withColumns({"pnl": F.lit(-0.1), "bench_vol": F.lit(1.5), "mean_corr": F.lit(0.1)})))
    assert {r["metric"]: r["advice"] for r in reports.window_advice(bad).collect()} == {"bench_vol": "tighten volatility limit", "mean_corr": "filter by correlation"}


def test_sizes_by_hand(spark):
    rng = np.random.default_rng(1)
    r = {"a-b": rng.standard_normal(60) * 0.01}
    r["a-c"] = r["a-b"] + rng.standard_normal(60) * 0.002
    d = spark.createDataFrame([(p, t, None if t == 0 else float(v[t]), 0.8 if t % 2 else None) for p, v in r.items() for t in range(60)], "pair string, ts int, r double, score double")
    s = reports.Sizes(base=0.2, target_vol=1.0, lookback=20)
    got = {(x["pair"], x["ts"]): x["size"] for x in reports.sized(d, s).collect()}
    assert all((v is None) == (t % 2 == 0) for (_, t), v in got.items()) and all(s.least <= v <= s.most for v in got.values() if v is not None)
    c = (abs(np.corrcoef(r["a-b"][1:], r["a-c"][1:])[0, 1]) + 1) / 2
    vol = np.std(r["a-b"][40:60], ddof=1) * 8760**0.5
    want = 0.2 * (0.3 + 0.9 * 0.8) * min(2, max(0.5, 1.0 / vol)) * max(0.5, 1 - max(c - 0.5, 0) / 0.5 * 0.5)
    assert got[("a-b", 59)] == pytest.approx(min(0.25, max(0.1, want)))
