"""What runs leave behind and later ones read: signals by window, trade histories, filter states and reports."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@functools.cache
def _own_dir(app_id: str) -> str:
    return tempfile.mkdtemp(prefix="tickloom-runs-")


def new_folder(spark: SparkSession) -> str:
    """A new folder in that which the cluster names in spark.checkpoint.dir; in a local session without one, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(named or 'file://' + _own_dir(spark.sparkContext.applicationId)).rstrip('/')}/run-{uuid.uuid4().hex}"


def write_run(df: DataFrame, path: str) -> None:
    """Signals, masks or returns of a run, a folder for each window. Spark's commit shows a write whole or not at all."""
    df.write.mode("overwrite").partitionBy("run_id", "window_id").parquet(path)


def read_run(spark: SparkSession, path: str, run: str, windows: Sequence[int] = (), columns: Sequence[str] = ()) -> DataFrame:
    """A run's rows, of some windows if named: only their folders and the named columns are read. Absent runs give no rows."""
    df = spark.read.parquet(path).where(F.col("run_id") == run)
    df = df.where(F.col("window_id").isin(*windows)) if windows else df
    return df.select(*columns) if columns else df


def append_trades(trades: DataFrame, path: str) -> None:
    """Adds trades to a history of JSON lines."""
    trades.write.mode("append").json(path)


def read_trades(spark: SparkSession, path: str, schema: T.StructType, since: Column) -> DataFrame:
    """Trades of a JSON-lines history from a time on; lines that don't parse, or have no time, are left out."""
    lines = spark.read.text(path).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("t"))
    return lines.select("t.*").where(F.col("ts") >= since)


def save_states(states: DataFrame, path: str) -> None:
    """Filter states, a row for each pair; the whole table is replaced."""
    states.write.mode("overwrite").parquet(path)


def load_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report as CSV with a header and as JSON lines."""
    df.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    df.write.mode("overwrite").json(f"{path}/json")


def read_report(spark: SparkSession, path: str, schema: T.StructType, kind: str = "csv") -> DataFrame:
    return spark.read.schema(schema).option("header", True).format(kind).load(f"{path}/{kind}")


def compared(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Metrics of many runs, JSON objects in each path, with the path's last folder as run_id; a metric that a run lacks is null."""
    rows = spark.read.json(paths).select("*", F.input_file_name().alias("__f"))
    return rows.withColumn("run_id", F.element_at(F.split("__f", "/"), -2)).drop("__f")


def saved(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: rounds of a loop don't grow one plan, and a lost executor costs one round."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that one task sorts at a time.
TASK_ROWS = 1_000_000


def tasks_for(spark: SparkSession, rows: int) -> int | None:
    """How many tasks so many rows need; None where the cores are enough, and Spark's own choice does."""
    n = -(-rows // TASK_ROWS)
    return n if n > spark.sparkContext.defaultParallelism else None


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def has_files(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path, in any store that Spark reads."""
    fs, p = _file(spark, path)
    return fs.exists(p)


def stream_of(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> DataFrame:
    """A stream of a Parquet table that is one file or a folder of part files; FileNotFoundError if it is neither."""
    fs, p = _file(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    reader = spark.readStream.schema(schema).options(**options)
    if fs.getFileStatus(p).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", p.getName()).parquet(path.rsplit("/", 1)[0])  # a stream reads folders


def done(spark: SparkSession, path: str) -> bool:
    """Whether a write to the folder was committed."""
    return has_files(spark, f"{path}/_SUCCESS")
