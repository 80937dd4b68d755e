"""A walk-forward run whose windows learn from those before them.

What a pair would do in a window depends on prices alone, so one job scans and trades all windows. Only which pairs may trade depends on
earlier windows: a ledger of pairs and a list of symbols are tables with a version for each window, and a window reads the versions that the one before wrote. So the
ordered part works on one row for each pair and window, and a run that stops can go on from its last version.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.ledger import count_if
from tickloom.sources.runs import done, saved

LEDGER = "pair string, gross double, cost double, trades long, stops long"
SYMBOLS = "symbol string, pnl double, trades double, stops double, windows long, listed boolean"


@dataclasses.dataclass(frozen=True)
class Rules:
    """When a symbol is listed for good (trades a window, windows, mean result, share of stops), and when a pair's past keeps it out (cost by gross, share of stops)."""

    min_trades: float = 5.0
    min_windows: int = 2
    worst_avg: float = -0.003
    worst_stops: float = 0.45
    max_cost: float = 0.8
    max_stops: float = 0.4


def results(trades: DataFrame) -> DataFrame:
    """(window_id, pair, gross, cost, net, trades, stops) of trades."""
    return trades.groupBy("window_id", "pair").agg(F.sum("gross").alias("gross"), F.sum(F.abs("fees") + F.abs("slippage")).alias("cost"), F.sum("net").alias("net"), F.count("*").alias("trades"), count_if(F.col("exit_reason") == 3).alias("stops"))


def judged(rows: DataFrame, ledger: DataFrame, symbols: DataFrame, rules: Rules) -> DataFrame:
    """A window's rows with verdict: listed (a leg is on the list), costly or stopped (by the pair's own past), else traded."""
    listed = symbols.where("listed").select(F.col("symbol"))
    legs = rows.select("pair", F.explode(F.split("pair", "-", 2)).alias("symbol")).join(listed, "symbol", "left_semi").select("pair", F.lit(True).alias("on_list")).distinct()
    past = ledger.select("pair", F.col("gross").alias("g"), F.col("cost").alias("c"), F.col("trades").alias("n"), F.col("stops").alias("s"))
    d = rows.join(legs, "pair", "left").join(past, "pair", "left")
    share = F.when(F.abs("g") > 1e-10, F.col("c") / F.abs("g")).when(F.col("c") > 0, float("inf")).otherwise(0.0)
    verdict = F.when(F.col("on_list"), "listed").when(share > rules.max_cost, "costly").when((F.col("n") > 0) & (F.col("s") / F.col("n") > rules.max_stops), "stopped").otherwise("traded")
    return d.select(*rows.columns, verdict.alias("verdict"))


def next_ledger(ledger: DataFrame, traded: DataFrame) -> DataFrame:
    names = ("gross", "cost", "trades", "stops")
    return ledger.unionByName(traded.select("pair", *names)).groupBy("pair").agg(*(F.sum(c).alias(c) for c in names))


def next_symbols(symbols: DataFrame, traded: DataFrame, rules: Rules) -> DataFrame:
    """Half of a pair's figures go to each leg; a window in which a symbol has few trades doesn't count for it."""
    legs = traded.withColumn("symbol", F.explode(F.split("pair", "-", 2))).groupBy("symbol").agg(*((F.sum(c) / 2).alias(n) for c, n in (("net", "pnl"), ("trades", "trades"), ("stops", "stops"))))
    new = legs.where(F.col("trades") >= rules.min_trades).withColumns({"windows": F.lit(1).cast("long"), "listed": F.lit(False)})
    d = symbols.unionByName(new).groupBy("symbol").agg(*(F.sum(c).alias(c) for c in ("pnl", "trades", "stops", "windows")), F.max("listed").alias("was"))
    now = (F.col("windows") >= rules.min_windows) & ((F.col("pnl") / F.col("windows") < rules.worst_avg) | (F.col("stops") / F.col("trades") > rules.worst_stops))
    return d.select("symbol", "pnl", "trades", "stops", "windows", (F.col("was") | now).alias("listed"))


def carried(rows: DataFrame, path: str, rules: Rules = Rules()) -> DataFrame:
    """rows (see `results`) with verdict, window after window; path gets a version of each table for each window.

    A version that is there already isn't made again: a run with the same path goes on where one stopped. Windows are a calendar, so the driver walks them.
    """
    spark, rows = rows.sparkSession, saved(rows)
    at = lambda kind, w: f"{path}/{kind}/version={w}"
    windows = [r[0] for r in rows.select("window_id").distinct().orderBy("window_id").collect()]
    ledger, symbols = spark.createDataFrame([], LEDGER), spark.createDataFrame([], SYMBOLS)
    for w in windows:
        if not done(spark, at("symbols", w)):  # written last
            judged(rows.where(F.col("window_id") == w), ledger, symbols, rules).write.mode("overwrite").parquet(at("judged", w))
            traded = spark.read.parquet(at("judged", w)).where("verdict = 'traded'")
            next_ledger(ledger, traded).write.mode("overwrite").parquet(at("ledger", w))
            next_symbols(symbols, traded, rules).write.mode("overwrite").parquet(at("symbols", w))
        ledger, symbols = spark.read.schema(LEDGER).parquet(at("ledger", w)), spark.read.schema(SYMBOLS).parquet(at("symbols", w))
    if not windows:
        return rows.withColumn("verdict", F.lit("traded")).where("false")
    return spark.read.parquet(*(at("judged", w) for w in windows)).select(*rows.columns, "verdict")
