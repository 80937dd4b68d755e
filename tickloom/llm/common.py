"""Shared helpers of the training-data operators."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Most rows and bytes that one Arrow batch hands to a Python worker, so that long texts don't pile up.
BATCH_ROWS, BATCH_BYTES = 4096, 16 << 20


@functools.cache
def _own_dir(app_id: str) -> str:
    return tempfile.mkdtemp(prefix="tickloom-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; in a local session without one, a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + _own_dir(spark.sparkContext.applicationId)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tickloom-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches where the session still has Spark's defaults."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)) in ("-1", "0", "2147483647", "9223372036854775807"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def own_columns(df: DataFrame, *names: str) -> list[str]:
    """df's columns without the named ones (an operator's results replace columns of the same name)."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def quoted(name: str) -> str:
    """A column's name for col(), dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"
