"""Reading, cleaning and writing of candle, funding and report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.sources.runs import has_files, saved

CANDLE = T.StructType([T.StructField("ts", T.TimestampNTZType()), T.StructField("symbol", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume", "turnover")), T.StructField("data_source", T.StringType())])
#: Price factor of the thousand-unit tokens by source; volume takes its inverse.
THOUSANDS = ("kPEPE", "kSHIB", "kBONK", "kFLOKI", "kLUNC")
PRICE_FACTOR = {"okx": 1000.0, "binance": 0.001}

#: Rows of a month that one task writes into one file.
MONTH_FILE = 500_000


class BadIndex(ValueError):
    """A price table repeats a (ts, symbol)."""


def nullable(df: DataFrame) -> DataFrame:
    """NaN becomes null in all floating columns, since aggregates treat NaN as a value."""
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def long_prices(wide: DataFrame, ts: str = "ts") -> DataFrame:
    """(ts, symbol, close) of a table with a column for each symbol; what is no number becomes null."""
    symbols = [c for c in wide.columns if c != ts]
    return nullable(wide.select(F.col(ts).alias("ts"), *(F.col(c).try_cast("double").alias(c) for c in symbols)).unpivot("ts", symbols, "symbol", "close"))


def repeated_index(prices: DataFrame) -> DataFrame:
    """(ts, symbol, n) that occur more than once."""
    return prices.groupBy("ts", "symbol").agg(F.count("*").alias("n")).where("n > 1")


def sane(prices: DataFrame) -> DataFrame:
    """prices, once no (ts, symbol) repeats; else BadIndex."""
    if (bad := repeated_index(prices).first()) is not None:
        raise BadIndex(f"{bad['symbol']} has {bad['n']} rows at {bad['ts']}")
    return prices


def scan(df: DataFrame, as_of: Column, days: int, source: str | None = None) -> DataFrame:
    """Rows of the last days before as_of, of one source if named. Both predicates reach the scan."""
    out = df.where(F.col("ts") >= as_of - F.expr(f"interval '{days}' day"))
    return out.where(F.col("data_source") == source) if source else out


def latest(df: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """For each key the row that arrived last (an upsert); ties by all other columns."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*arrival, *sorted(c for c in rest if c not in arrival))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def regular(prices: DataFrame, grid: DataFrame, least_coverage: float) -> DataFrame:
    """(symbol, ts, close) on the whole grid, filled forward, of symbols with enough of it.

    grid has the ts column, one row for each bar, at equal steps.
    """
    n, first, last = grid.agg(F.count("*"), F.min("ts"), F.max("ts")).first()
    if not n:
        return prices.select("symbol", "ts", "close").where("false")
    step = int((last - first).total_seconds()) // max(n - 1, 1) or 1
    good = prices.where("close is not null").join(grid, "ts", "left_semi").groupBy("symbol").agg(F.count_distinct("ts").alias("n")).where(F.col("n") >= least_coverage * n).select("symbol")
    cells = good.withColumn("ts", F.explode(F.expr(f"sequence(timestamp_ntz'{first}', timestamp_ntz'{last}', interval '{step}' second)")))
    fill = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return cells.join(prices.select("symbol", "ts", "close"), ["symbol", "ts"], "left").withColumn("close", F.last("close", True).over(fill))


def normalised(raw: DataFrame, source: Column, symbol: Column, ts_ms: Column, price: Column, volume: Column, quote: Column) -> DataFrame:
    """Canonical candles of raw exchange rows.

    Thousand-unit tokens are rescaled as their source quotes them. Turnover is the quoted one where the source gives it (okx, 0
    if missing; binance), else volume x close.
    """
    thousand = symbol.isin(*THOUSANDS)
    factor = F.lit(1.0)
    for name, k in PRICE_FACTOR.items():
        factor = F.when(thousand & (source == name), F.lit(k)).otherwise(factor)
    p, v, q = price.try_cast("double") * factor, volume.try_cast("double") / factor, quote.try_cast("double")
    turnover = F.when(source == "okx", F.coalesce(q, F.lit(0.0))).when(source == "binance", q).otherwise(v * p)
    return raw.select(F.timestamp_millis(ts_ms.cast("long")).cast("timestamp_ntz").alias("ts"), symbol.alias("symbol"), p.alias("close"), v.alias("volume"), turnover.alias("turnover"), source.alias("data_source"))


def unseen(df: DataFrame, loaded: DataFrame) -> DataFrame:
    """Rows later than what is loaded of their symbol: (symbol, max_ts)."""
    return df.join(loaded, "symbol", "left").where("max_ts is null or ts > max_ts").drop("max_ts")


def write_by_month(df: DataFrame, path: str) -> None:
    """df as a table with a folder for each month of ts; what was there goes."""
    with_month(df).write.mode("overwrite").partitionBy("month").parquet(path)


def with_month(df: DataFrame) -> DataFrame:
    return df.withColumn("month", F.date_trunc("month", "ts").cast("date"))


def upsert_by_month(new: DataFrame, path: str, keys: Sequence[str], arrival: Sequence[str]) -> None:
    """Puts rows into a table by month: of rows with the same key the last to arrive stays, also against what is there (see `latest`).

    Only months that new rows touch are read and written, each by as many tasks as its rows need; the others keep their files. Keys hold ts, so that a key stays in its month. The same rows
    twice change nothing.
    """
    new = saved(with_month(new))
    months = [r[0] for r in new.select("month").distinct().collect()]  # a calendar
    if not months:
        return
    merged = new
    if has_files(new.sparkSession, path):
        there = new.sparkSession.read.schema(new.schema).parquet(path).where(F.col("month").isin(months))
        merged = there.unionByName(new)
    merged = saved(latest(merged, [*keys, "month"], arrival))
    files = merged.groupBy(F.col("month").alias("__month")).agg(F.ceil(F.count("*") / MONTH_FILE).alias("__files"))
    dealt = merged.join(F.broadcast(files), F.col("month").eqNullSafe(F.col("__month")))  # a calendar
    dealt = dealt.repartition("month", F.pmod(F.xxhash64(*keys), "__files")).drop("__month", "__files")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def members(clusters: DataFrame) -> DataFrame:
    """(cluster, symbol) of rows with a JSON object {cluster: [symbols]} in the column `json`."""
    parsed = clusters.select(F.from_json("json", "map<string, array<string>>").alias("m"))
    return parsed.select(F.explode("m").alias("cluster", "symbols")).select("cluster", F.explode("symbols").alias("symbol"))


def inverted(members_: DataFrame) -> DataFrame:
    return members_.groupBy("cluster").agg(F.sort_array(F.collect_set("symbol")).alias("symbols"))
