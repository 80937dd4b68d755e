"""Drift, calibration, splits and clusters of features, with MLlib where a model is fitted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, RobustScaler, VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stability(reference: DataFrame, current: DataFrame, bins: int = 10) -> DataFrame:
    """(psi, bins) of the column x: bins end at the reference's quantiles, the last one included; values outside don't count."""
    edges = reference.agg(F.percentile("x", F.array(*(F.lit(i / bins) for i in range(bins + 1)))).alias("q"))
    both = reference.select("x", F.lit(0).alias("half")).unionByName(current.select("x", F.lit(1).alias("half"))).join(F.broadcast(edges))
    bin_ = F.least(F.size(F.filter("q", lambda v: v <= F.col("x"))), F.lit(bins))
    n = both.where((F.col("x") >= F.col("q")[0]) & (F.col("x") <= F.col("q")[bins])).groupBy(bin_.alias("bin")).agg(F.sum((F.col("half") == 0).cast("long")).alias("r"), F.sum((F.col("half") == 1).cast("long")).alias("c"))
    total = n.agg(F.sum("r").alias("tr"), F.sum("c").alias("tc"))
    s = n.join(F.broadcast(total)).select(F.greatest(F.col("r") / F.col("tr"), F.lit(1e-6)).alias("r"), F.greatest(F.col("c") / F.col("tc"), F.lit(1e-6)).alias("c"))
    return s.agg(F.sum((F.col("c") - F.col("r")) * F.log(F.col("c") / F.col("r"))).alias("psi"), F.count("*").alias("bins"))


def prediction_quality(pred: DataFrame, keys: Sequence[str], bins: int = 10) -> DataFrame:
    """(keys, n, rmse, brier, ece, hit_rate, median_p) of probabilities p of outcomes y."""
    b = pred.withColumn("bin", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)))
    ece = b.groupBy(*keys, "bin").agg(F.count("*").alias("k"), F.abs(F.avg("p") - F.avg("y")).alias("gap")).groupBy(*keys).agg((F.sum(F.col("k") * F.col("gap")) / F.sum("k")).alias("ece"))
    e2 = F.avg(F.pow(F.col("p") - F.col("y"), 2))
    return b.groupBy(*keys).agg(F.count("*").alias("n"), F.sqrt(e2).alias("rmse"), e2.alias("brier"), F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("int")).alias("hit_rate"), F.median("p").alias("median_p")).join(ece, list(keys)).select(*keys, "n", "rmse", "brier", "ece", "hit_rate", "median_p")


def numbered(rows: DataFrame, order: str, n: int, part: int = 1 << 20, most: int = 4096) -> DataFrame:
    """rows with __i, their place in the order of a numeric column: ranges of about `part` rows (no more than `most` ranges) are numbered side by side, from the rows before each."""
    k = min(most, n // part + 1)
    edges = sorted(set(rows.approxQuantile(order, [i / k for i in range(1, k)], 0.2 / k))) if k > 1 else []
    of = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(order))) if edges else F.lit(0)
    d = rows.withColumn("__r", of)
    counts = d.groupBy("__r").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")  # a row for each range
    place = F.row_number().over(Window.partitionBy("__r").orderBy(order)) - 1
    return d.withColumn("__p", place).join(F.broadcast(before), "__r").withColumn("__i", F.col("__p") + F.col("__b")).drop("__r", "__p", "__b")


def purged_folds(rows: DataFrame, order: str, folds: int, gap: int, first: float = 0.5) -> DataFrame:
    """(fold, role, rows of `rows`): expanding training parts, and test parts that begin `gap` rows after."""
    n = rows.count()
    start = int(n * first)
    size = max(1, (n - start) // folds)
    d = numbered(rows, order, n).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    end = F.lit(start) + F.col("fold") * size
    role = F.when(F.col("__i") < end, "train").when((F.col("__i") >= end + gap) & (F.col("__i") < end + size + gap), "test")
    return d.withColumn("role", role).where("role is not null").drop("__i")


def platt(scores: DataFrame, steps: int = 30) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(a s + b)) fitted to scores (s, y) by Newton steps on smoothed targets; each step is one aggregate."""
    pos, neg = scores.agg(F.coalesce(F.sum("y"), F.lit(0.0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0.0))).first()
    import math

    t = F.when(F.col("y") > 0.5, (pos + 1) / (pos + 2)).otherwise(1 / (neg + 2))
    a, b = 0.0, math.log((neg + 1) / (pos + 1))
    for _ in range(steps):
        p = 1 / (1 + F.exp(F.lit(a) * F.col("s") + F.lit(b)))
        w, d, s = p * (1 - p), t - p, F.col("s")
        h11, h12, h22, g1, g2 = scores.agg(F.sum(s * s * w), F.sum(s * w), F.sum(w), F.sum(s * d), F.sum(d)).first()
        det = (h11 + 1e-12) * (h22 + 1e-12) - h12 * h12
        da, db = -((h22 + 1e-12) * g1 - h12 * g2) / det, -((h11 + 1e-12) * g2 - h12 * g1) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b


def isotonic(scores: DataFrame) -> DataFrame:
    """scores (s, y) with p, a monotone fit."""
    model = IsotonicRegression(featuresCol="s", labelCol="y", predictionCol="p").fit(scores)
    return model.transform(scores)


def clusters(features: DataFrame, cols: Sequence[str], dims: int, k: int, by: str, seed: int = 42) -> DataFrame:
    """features with cluster: k-means on scaled principal parts, numbered by the mean of `by`."""
    steps = [VectorAssembler(inputCols=list(cols), outputCol="__v"), RobustScaler(inputCol="__v", outputCol="__r", withCentering=True), PCA(k=dims, inputCol="__r", outputCol="__p"), RobustScaler(inputCol="__p", outputCol="__q", withCentering=True), KMeans(k=k, seed=seed, featuresCol="__q", predictionCol="__c")]
    out = Pipeline(stages=steps).fit(features).transform(features)
    means = out.groupBy("__c").agg(F.avg(by).alias("__m")).withColumn("cluster", (F.dense_rank().over(Window.orderBy("__m", "__c")) - 1).cast("long"))
    return out.join(F.broadcast(means), "__c").select(*features.columns, "cluster")
