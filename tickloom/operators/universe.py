"""Which symbols and pairs to look at: names, coverage, volume, volatility, funding, features and past results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rank of a source, the best first.
PRIORITY = {"hyperliquid": 1, "okx": 2, "binance": 3, "coinbase": 4}


def thousand_units(symbol: Column) -> Column:
    """Whether a symbol counts thousands: a k before capitals."""
    return symbol.rlike("^k(?=.*[A-Z])[^a-z]+$")


def exchange_symbol(symbol: Column, suffix: str, exceptions: dict[str, str | None]) -> Column:
    """A symbol's name elsewhere: its exception (None: not listed), or else its name and the suffix."""
    out = F.concat(F.regexp_replace(symbol, "^k(?=[A-Z])", ""), F.lit(suffix))
    for name, other in exceptions.items():
        out = F.when(symbol == name, F.lit(other)).otherwise(out)
    return out


def priority(source: Column) -> Column:
    out = F.lit(99)
    for name, rank in PRIORITY.items():
        out = F.when(source == name, rank).otherwise(out)
    return out


def legs(pair: Column, sep: str = "-") -> tuple[Column, Column, Column]:
    """(first, second, well formed): split once, trimmed, neither empty."""
    parts = F.split(pair, sep, 2)
    a, b = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    return a, b, F.coalesce((a != "") & (b != ""), F.lit(False))


def safe_log(x: Column) -> Column:
    """ln, null where x is not a positive finite number."""
    return F.when((x > 0) & ~F.isnan(x) & (x < float("inf")), F.log(x))


def clipped_log(prices: DataFrame) -> DataFrame:
    """prices with lp, the logarithm of the forward-filled close, not below the symbol's least positive one."""
    fill = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    out = prices.withColumn("filled", F.last("close", True).over(fill))
    least = F.min(F.when(F.col("filled") > 0, F.col("filled"))).over(Window.partitionBy("symbol"))
    return out.withColumn("lp", F.log(F.greatest("filled", least))).drop("filled")


def availability(prices: DataFrame, bars_per_day: int, min_days: int, min_coverage: float) -> DataFrame:
    """(symbol, first_ts, last_ts, n, days, coverage, ok)."""
    out = prices.where("close is not null").groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    out = out.withColumn("days", F.expr("cast(floor(timestampdiff(second, first_ts, last_ts) / 86400) as bigint)"))
    out = out.withColumn("coverage", F.when(F.col("days") > 0, F.round(F.col("n") / (F.col("days") * bars_per_day), 3)).otherwise(0.0))
    return out.withColumn("ok", (F.col("days") >= min_days) & (F.col("coverage") >= min_coverage))


def most_liquid(volumes: DataFrame, floor: float, n: int) -> DataFrame:
    """The n symbols of most volume, none below the floor; ties by name."""
    return volumes.where(F.col("volume") >= floor).orderBy(F.desc("volume"), "symbol").limit(n)


def calm(vols: DataFrame, cap: float, quantile: float = 0.9) -> DataFrame:
    """vols (symbol, vol) with keep: within the cap and the quantile of those that are."""
    inside = vols.where(F.col("vol") <= cap).agg(F.percentile("vol", quantile).alias("limit"))
    return vols.join(F.broadcast(inside)).withColumn("keep", F.coalesce((F.col("vol") <= cap) & (F.col("vol") <= F.col("limit")), F.lit(False))).drop("limit")


def funding_stats(funding: DataFrame, expected: int, min_coverage: float, cap: float) -> DataFrame:
    """(symbol, mean_rate, coverage, keep)."""
    out = funding.groupBy("symbol").agg(F.avg("rate").alias("mean_rate"), (F.count("rate") / F.lit(expected)).alias("coverage"))
    return out.withColumn("keep", (F.col("coverage") >= min_coverage) & (F.abs("mean_rate") <= cap))


def funding_pairs(pairs: DataFrame, stats: DataFrame, cap: float) -> DataFrame:
    """Pairs (coin_y, coin_x) whose legs' mean rates lie within cap of one another, with net_rate."""
    y, x = stats.select(F.col("symbol").alias("coin_y"), F.col("mean_rate").alias("ry")), stats.select(F.col("symbol").alias("coin_x"), F.col("mean_rate").alias("rx"))
    return pairs.join(y, "coin_y").join(x, "coin_x").withColumn("net_rate", F.col("ry") - F.col("rx")).where(F.abs("net_rate") <= cap).drop("ry", "rx")


def outside(df: DataFrame, events: DataFrame, closed: bool = True) -> DataFrame:
    """Rows of df outside all intervals of events (start, end), whose ends belong to them if closed.

    events is a list that somebody wrote down, so it goes to all tasks.
    """
    inside = (F.col("ts") >= F.col("start")) & (F.col("ts") <= F.col("end")) if closed else (F.col("ts") > F.col("start")) & (F.col("ts") < F.col("end"))
    return df.join(F.broadcast(events), inside, "left_anti")


def by_features(pairs: DataFrame, features: DataFrame, alpha: float = -0.1, vol_z: float = 2.5, flow: float = 0.4) -> DataFrame:
    """pairs with rejected: both alphas low, either leg too volatile, or either flow thin. Missing features don't reject."""
    cols = ("alpha", "volatility_z", "volume_flow")
    out = pairs
    for leg in ("y", "x"):
        out = out.join(features.select(F.col("symbol").alias(f"coin_{leg}"), *(F.col(c).alias(f"{c}_{leg}") for c in cols)), f"coin_{leg}", "left")
    bad = ((F.col("alpha_y") < alpha) & (F.col("alpha_x") < alpha)) | (F.greatest("volatility_z_y", "volatility_z_x") > vol_z) | (F.least("volume_flow_y", "volume_flow_x") < flow)
    return out.withColumn("rejected", F.coalesce(bad, F.lit(False))).select(*pairs.columns, "rejected")


def by_history(ledger: DataFrame, max_cost: float = 0.8, max_stops: float = 0.4) -> DataFrame:
    """(pair, cost_ratio, stop_rate, rejected); the ratio is infinite for costs without a gross."""
    out = ledger.groupBy("pair").agg((F.abs(F.sum("fees")) + F.abs(F.sum("slippage"))).alias("cost"), F.abs(F.sum("gross")).alias("gross"), F.avg((F.col("exit_reason") == 3).cast("double")).alias("stop_rate"))
    ratio = F.when(F.col("gross") > 1e-12, F.col("cost") / F.col("gross")).when(F.col("cost") > 0, float("inf")).otherwise(0.0)
    return out.withColumn("cost_ratio", ratio).withColumn("rejected", (F.col("cost_ratio") > max_cost) | (F.col("stop_rate") > max_stops)).select("pair", "cost_ratio", "stop_rate", "rejected")


def window_coverage(bars: DataFrame, windows: DataFrame, least: float) -> DataFrame:
    """(window_id, symbol, coverage) of symbols that cover enough of a window's training part."""
    inside = (F.col("ts") >= F.col("train_start")) & (F.col("ts") < F.col("train_end"))
    return bars.join(F.broadcast(windows), inside).groupBy("window_id", "symbol").agg(F.avg(F.col("close").isNotNull().cast("double")).alias("coverage")).where(F.col("coverage") >= least)


def listed(pairs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Pairs of which both legs are among symbols."""
    return pairs.join(symbols.select(F.col("symbol").alias("coin_y")), "coin_y", "left_semi").join(symbols.select(F.col("symbol").alias("coin_x")), "coin_x", "left_semi")


def unlisted(pairs: DataFrame, bad: DataFrame) -> DataFrame:
    """Pairs of which no leg is among bad."""
    return pairs.join(bad.select(F.col("symbol").alias("coin_y")), "coin_y", "left_anti").join(bad.select(F.col("symbol").alias("coin_x")), "coin_x", "left_anti")


def changes(active: DataFrame, found: DataFrame) -> DataFrame:
    """(pair, action): add what is found, keep what is both, and of the rest retire what is open and drop what is not."""
    both = active.select("pair", F.col("is_open"), F.lit(True).alias("was")).join(found.select("pair", F.lit(True).alias("now")), "pair", "full")
    return both.select("pair", F.when(F.col("was").isNull(), "add").when(F.col("now"), "keep").when(F.col("is_open"), "retire").otherwise("drop").alias("action"))
