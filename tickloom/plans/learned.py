"""Queries of models that windows hand on: scores of entries and their risks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import features as T
from tickloom.operators import learning as M
from tickloom.operators import models as D
from tickloom.operators.intervals import would_be
from tickloom.plans import fixtures as X
from tickloom.plans.catalog import query
from tickloom.plans.signals import coin_features as figures_of_coins
from tickloom.plans.signals import forward_labels, with_half_life
from tickloom.sources.runs import new_folder

COST = 4 * 5e-4


def entries_with(features, spark, sf):
    """Entries of each test window with their features, what became of them (won, mae, stopped, forward_vol), and when that was known."""
    t = would_be(X.masks(spark, sf), [], 48, 0.5).select("pair", F.col("entry_ts").alias("ts"), F.col("exit_ts").alias("known_at"), (F.col("gross") > COST).cast("double").alias("won"), (-F.col("mae")).alias("mae"), (F.col("exit_reason") == 3).cast("double").alias("stopped"))
    w = X.windows(spark, sf).select("window_id", F.col("train_end").alias("starts"), "test_end")
    t = t.join(F.broadcast(w), (F.col("ts") >= F.col("starts")) & (F.col("ts") < F.col("test_end"))).drop("test_end")  # a row for each window
    return features.join(t, ["pair", "ts"]).join(forward_labels(spark, sf).select("pair", "ts", "forward_vol"), ["pair", "ts"])


@query()
def win_classifier(spark, sf):
    """The chance that an entry wins, by models that learn from earlier windows; 0.5 until there is one."""
    f = T.for_scores(with_half_life(spark, sf), 1.5, 4.0)
    cols = [c for c in f.columns if c not in ("pair", "ts")]
    out = D.by_window(entries_with(f, spark, sf), cols, D.WIN, new_folder(spark), rounds=5)
    return out.select("window_id", "pair", "ts", "score", "confidence")


@query()
def risk_regressor(spark, sf):
    """An entry's worst loss, the volatility ahead, the chance of a stop, and how familiar its features are, by models of earlier windows."""
    f = T.for_risk(with_half_life(spark, sf), T.benchmark_state(X.returns(spark, sf), "click"), 1.5)
    cols = [c for c in f.columns if c not in ("pair", "ts")]
    out = D.by_window(entries_with(f, spark, sf), cols, D.RISK, new_folder(spark), rounds=5)
    return out.select("window_id", "pair", "ts", "predicted_mae", "predicted_vol", "stopout_prob", "confidence")


#: The seven figures of a coin.
COIN = ("beta", "alpha", "vol", "rsi", "volume_flow", "funding_sentiment", "reversion")


@query()
def feature_clusters(spark, sf):
    """Clusters of symbols by their seven figures, numbered by mean beta."""
    return M.clusters(figures_of_coins(spark, sf), COIN, 4, 3, "beta").select("symbol", "cluster")
