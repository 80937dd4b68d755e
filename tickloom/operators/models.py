"""Models of entries that outlast a run: fitted on what earlier windows have shown, saved by window, loaded by the next.

Each target has a boosted MLlib model of its own; training means and deviations of the features are saved with them, fill what is missing, and say how far a row lies from what
the models have seen.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.entries import clip
from tickloom.sources.runs import done, has_files, saved


@dataclasses.dataclass(frozen=True)
class Target:
    """A label to predict: the probability of 1, or a value; and what rows get while there is no model."""

    label: str
    out: str
    classify: bool
    default: float | None


#: A winning trade; a trade's worst loss, the volatility ahead, and a stop.
WIN = (Target("won", "score", True, 0.5),)
RISK = (Target("mae", "predicted_mae", False, None), Target("forward_vol", "predicted_vol", False, None), Target("stopped", "stopout_prob", True, 0.5))


def known(c: str) -> Column:
    """c where it is a finite number."""
    x = F.col(c).cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


def filled(rows: DataFrame, cols: Sequence[str], means: dict[str, float]) -> DataFrame:
    """rows with the features as __x: what is missing counts as its mean in training."""
    d = rows.withColumns({f"__{c}": F.coalesce(known(c), F.lit(means[c])) for c in cols})
    return VectorAssembler(inputCols=[f"__{c}" for c in cols], outputCol="__x").transform(d)


def fit(train: DataFrame, cols: Sequence[str], targets: Sequence[Target], path: str, rounds: int = 10, least: int = 30, seed: int = 7) -> list[str]:
    """Fits and saves a model of each target that `least` rows or more know, both labels among them if it is a class; their names. The folder shows as ready when all is written."""
    spark, train = train.sparkSession, saved(train)
    figures = [f(known(c)).alias(f"{k}_{c}") for c in cols for k, f in (("mean", F.avg), ("std", F.stddev_samp))]
    kinds = [x for t in targets for x in (F.count(known(t.label)).alias(f"n_{t.label}"), F.count_distinct(known(t.label)).alias(f"kinds_{t.label}"))]
    row = train.agg(*figures, *kinds).first()
    means = {c: row[f"mean_{c}"] or 0.0 for c in cols}
    spark.createDataFrame([(c, float(means[c]), float(row[f"std_{c}"] or 0.0)) for c in cols], "feature string, mean double, std double").write.mode("overwrite").parquet(f"{path}/stats")
    made = []
    for t in targets:
        if row[f"n_{t.label}"] < least or t.classify and row[f"kinds_{t.label}"] < 2:
            continue
        kind = GBTClassifier(featuresCol="__x", labelCol="__y", maxIter=rounds, maxDepth=3, seed=seed) if t.classify else GBTRegressor(featuresCol="__x", labelCol="__y", maxIter=rounds, maxDepth=3, seed=seed)
        rows = filled(train.withColumn("__y", known(t.label)).where("__y is not null"), cols, means)
        PipelineModel([kind.fit(rows)]).write().overwrite().save(f"{path}/models/{t.out}")
        made.append(t.out)
    spark.createDataFrame([(m,) for m in made], "target string").write.mode("overwrite").parquet(f"{path}/ready")
    return made


def scored(rows: DataFrame, cols: Sequence[str], targets: Sequence[Target], path: str | None) -> DataFrame:
    """rows with a column for each target, and confidence: 1 at the training means, 0 from three deviations on, by the mean distance of the features.

    Without saved models the targets are at their defaults, and confidence is 0. Features that didn't vary in training don't count for it.
    """
    spark = rows.sparkSession
    if path is None or not done(spark, f"{path}/ready"):
        return rows.withColumns({t.out: F.lit(t.default).cast("double") for t in targets} | {"confidence": F.lit(0.0)})
    stats = {r["feature"]: r for r in spark.read.parquet(f"{path}/stats").collect()}
    d = filled(rows, cols, {c: stats[c]["mean"] for c in cols})
    out = []
    for t in targets:
        if not has_files(spark, f"{path}/models/{t.out}"):
            d = d.withColumn(t.out, F.lit(t.default).cast("double"))
        else:
            d = PipelineModel.load(f"{path}/models/{t.out}").transform(d)
            d = d.withColumn(t.out, vector_to_array("probability")[1] if t.classify else F.col("prediction")).drop("probability", "rawPrediction", "prediction")
        out.append(t.out)
    varied = [c for c in cols if stats[c]["std"] > 1e-12]
    far = sum((F.abs((F.col(f"__{c}") - stats[c]["mean"]) / stats[c]["std"]) for c in varied), F.lit(0.0)) / max(1, len(varied))
    return d.withColumn("confidence", clip(1 - far / 3, 0.0, 1.0)).select(*rows.columns, *out, "confidence")


def return_score(predicted: Column) -> Column:
    """A predicted return as a score: -5 % and less is 0, 5 % and more is 1."""
    return (clip(predicted, -0.05, 0.05) + 0.05) / 0.1


def by_window(rows: DataFrame, cols: Sequence[str], targets: Sequence[Target], path: str, least_windows: int = 2, refit: bool = False, rounds: int = 10) -> DataFrame:
    """rows (window_id, starts, known_at, features, labels), each window's scored by models of the windows before.

    starts is when a row's window begins, known_at when its labels are known: models for a window learn from rows of earlier windows that are known when it starts. They are
    fitted once least_windows are over, and again after every later window with refit; a version is saved for each window, and one that is there isn't made again. Windows are
    a calendar, so the driver walks them.
    """
    spark, rows = rows.sparkSession, saved(rows)
    windows = rows.groupBy("window_id").agg(F.min("starts").alias("starts")).orderBy("window_id").collect()
    model, out = None, None
    for k, (w, starts) in enumerate(windows):
        at = f"{path}/models/version={w}"
        if k >= least_windows and (model is None or refit):
            if not done(spark, f"{at}/ready"):
                fit(rows.where((F.col("window_id") < w) & (F.col("known_at") < F.lit(starts))), cols, targets, at, rounds)
            model = at
        own = scored(rows.where(F.col("window_id") == w), cols, targets, model)
        out = own if out is None else out.unionByName(own)
    return scored(rows, cols, targets, None) if out is None else out
