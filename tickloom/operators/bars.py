"""Bars of one series: gaps, resampling, interpolation, rolling statistics, trend and regime figures."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F


def gaps(bars: DataFrame, seconds: int, edges: tuple[int, int]) -> DataFrame:
    """(symbol, gaps, small, middle, large, longest, missing, status): gaps over 1.5 bars, in bars, split at edges; missing in percent."""
    w = Window.partitionBy("symbol").orderBy("ts")
    d = bars.withColumn("gap", F.timestamp_diff("SECOND", F.lag("ts").over(w), F.col("ts")) / seconds)
    a, b = edges
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    g = F.col("gap")
    span = F.floor(F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")) / seconds) + 1
    out = d.groupBy("symbol").agg(n(g > 1.5).alias("gaps"), n((g > 1.5) & (g <= a)).alias("small"), n((g > a) & (g <= b)).alias("middle"), n(g > b).alias("large"), F.max(g).alias("longest"), (100 * (1 - F.count("*") / span)).alias("missing"))
    return out.withColumn("status", F.when(F.col("longest") > b, "fatal").when(F.col("longest") > a, "warn").otherwise("ok"))


def resampled(ticks: DataFrame, width: str) -> DataFrame:
    """(symbol, ts, close, turnover, n): the last non-null close of each bin, closed and labelled on the left."""
    bin_ = F.window(F.col("ts").cast("timestamp"), width).start.cast("timestamp_ntz")
    return ticks.where("close is not null").groupBy("symbol", bin_.alias("bin")).agg(F.max_by("close", "ts").alias("close"), F.sum("turnover").alias("turnover"), F.count("*").alias("n")).withColumnRenamed("bin", "ts")


def interpolated(bars: DataFrame, longest: int) -> DataFrame:
    """bars on a full grid with px: the close, or a line between its neighbours over at most `longest` missing bars."""
    w = Window.partitionBy("symbol").orderBy("ts")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    k = F.row_number().over(w)
    d = bars.withColumn("k", k)
    known = F.when(F.col("close").isNotNull(), F.struct(F.col("k").alias("k"), F.col("close").alias("v")))
    d = d.withColumns({"a": F.last(known, True).over(back), "b": F.first(known, True).over(ahead)})
    line = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("k") - F.col("a.k")) / (F.col("b.k") - F.col("a.k"))
    return d.withColumn("px", F.when(F.col("close").isNotNull(), F.col("close")).when(F.col("b.k") - F.col("a.k") - 1 <= longest, line)).drop("k", "a", "b")


def last(w, n: int):
    return w.rowsBetween(1 - n, 0)


def full(c: Column, w, n: int, value: Column) -> Column:
    """value, where the last n rows all have c."""
    return F.when(F.count(c).over(last(w, n)) >= n, value)


def percent_rank(c: Column, w) -> Column:
    """Mean rank of c among the non-null values of a partition, over their number; null for null."""
    ties = w.orderBy(c)
    n = F.count(c).over(w)
    rank = F.rank().over(w.orderBy(c.asc_nulls_last()))
    same = F.count(c).over(ties.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(c.isNotNull(), (rank + (same - 1) / 2) / n)


def trend(spreads: DataFrame, n: int, slope: float, far: float, keys: Sequence[str] = ("pair",)) -> DataFrame:
    """spreads with ma_slope, vs_ma (both in deviations), trend_score and masks against entries with the trend."""
    w = Window.partitionBy(*keys).orderBy("ts")
    s = F.col("spread")
    d = spreads.withColumns({"ma": full(s, w, n, F.avg(s).over(last(w, n))), "sd": full(s, w, n, F.stddev_samp(s).over(last(w, n)))})
    fine = F.col("sd") > 1e-12
    d = d.withColumns({"ma_slope": F.when(fine, (F.col("ma") - F.lag("ma").over(w)) / F.col("sd")), "vs_ma": F.when(fine, (s - F.col("ma")) / F.col("sd"))})
    return d.drop("ma", "sd").withColumns({
        "trend_score": F.coalesce(1 - F.least(F.abs("ma_slope") / slope, F.lit(1.0)), F.lit(1.0)),
        "no_short": F.coalesce((F.col("ma_slope") > slope) & (F.col("vs_ma") > far), F.lit(False)),
        "no_long": F.coalesce((F.col("ma_slope") < -slope) & (F.col("vs_ma") < -far), F.lit(False)),
    })


def lag1(c: Column, before: Column, w, n: int) -> Column:
    """Rolling lag-1 autocorrelation: population covariance over sample deviations."""
    f = last(w, n)
    cov = F.avg(c * before).over(f) - F.avg(c).over(f) * F.avg(before).over(f)
    d = F.stddev_samp(c).over(f) * F.stddev_samp(before).over(f)
    return F.when((F.count(c * before).over(f) >= n) & (d > 1e-12), cov / d)


def regime(returns: DataFrame, benchmark: str, n: int, vol_limit: float, calm: float, wild: float) -> DataFrame:
    """(ts, vol_rank, dispersion_pos, allowed, state): by rank of the benchmark's rolling volatility and place of dispersion in its range.

    A missing rank blocks, missing dispersion doesn't. Volatilities that agree to nine digits are equal. The rank is over all of the table, as for a finished test window.
    """
    w = Window.orderBy("ts")
    b = returns.where(F.col("symbol") == benchmark).select("ts", F.when(F.count("ret").over(last(w, n)) >= n // 2, F.round(F.stddev_samp("ret").over(last(w, n)), 9)).alias("vol"))
    b = b.withColumn("vol_rank", percent_rank(F.col("vol"), Window.partitionBy()))
    x = returns.groupBy("ts").agg(F.stddev_samp("ret").alias("dispersion"))
    lo, hi = F.min("dispersion").over(last(w, n)), F.max("dispersion").over(last(w, n))
    x = x.withColumn("dispersion_pos", F.when((F.count("dispersion").over(last(w, n)) >= n // 2) & (hi > lo), (F.col("dispersion") - lo) / (hi - lo)))
    d = b.join(x, "ts", "full").select("ts", "vol_rank", "dispersion_pos")
    v, p = F.coalesce("vol_rank", F.lit(0.5)), F.coalesce("dispersion_pos", F.lit(0.5))
    state = F.when((v > wild) | (p > wild), "RED").when((v > calm) | (p > calm), "YELLOW").otherwise("GREEN")
    return d.withColumns({"allowed": F.coalesce(F.col("vol_rank") <= vol_limit, F.lit(False)) & F.coalesce(F.col("dispersion_pos") <= vol_limit, F.lit(True)), "state": state})


def coin_features(returns: DataFrame, n: int, rsi_n: int) -> DataFrame:
    """(symbol, beta, alpha, vol, rsi, reversion) of the last rows, against the mean of each bar's middle 80 percent.

    returns has (symbol, ts, px, ret).
    """
    cuts = returns.groupBy("ts").agg(F.percentile("ret", F.array(F.lit(0.1), F.lit(0.9))).alias("q"))
    market = returns.join(cuts, "ts").where((F.col("ret") >= F.col("q")[0]) & (F.col("ret") <= F.col("q")[1])).groupBy("ts").agg(F.avg("ret").alias("market"))
    d = returns.join(market, "ts").where("ret is not null").withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts"))))
    near, rs = F.col("k") <= n, F.col("k") <= rsi_n
    up, down = F.avg(F.when(rs, F.greatest("ret", F.lit(0.0)))), F.avg(F.when(rs, F.greatest(-F.col("ret"), F.lit(0.0))))
    g = d.groupBy("symbol").agg(
        (F.covar_samp(F.when(near, F.col("ret")), F.when(near, F.col("market"))) / F.var_samp(F.when(near, F.col("market")))).alias("beta"), F.avg(F.when(near, F.col("ret"))).alias("mean"), F.avg(F.when(near, F.col("market"))).alias("m"),
        F.stddev_samp(F.when(near, F.col("ret"))).alias("vol"), (100 * up / (up + down)).alias("rsi"), (F.max_by("px", "ts") / F.median(F.when(near, F.col("px"))) - 1).alias("reversion"),
    )
    return g.select("symbol", "beta", (F.col("mean") - F.col("beta") * F.col("m")).alias("alpha"), "vol", "rsi", "reversion")


def flows(turnover: DataFrame, near: int, far: int) -> DataFrame:
    """(symbol, volume_flow): mean turnover of the last `near` bars against that of the last `far`, less 1; missing turnover is none."""
    d = turnover.withColumns({"v": F.coalesce("turnover", F.lit(0.0)), "k": F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))})
    mean = lambda n: F.avg(F.when(F.col("k") <= n, F.col("v")))
    return d.groupBy("symbol").agg((mean(near) / F.when(mean(far) == 0, 1.0).otherwise(mean(far)) - 1).alias("volume_flow"))


def sentiment(funding: DataFrame, n: int) -> DataFrame:
    """(symbol, funding_sentiment): the mean of the last n rates, in percent."""
    d = funding.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where(F.col("k") <= n)
    return d.groupBy("symbol").agg((100 * F.avg("rate")).alias("funding_sentiment"))


def last_values(x: str, n: int, keys: Sequence[str] = ("pair",)) -> Column:
    """The known values of the last n rows, the oldest first."""
    return F.collect_list(x).over(Window.partitionBy(*keys).orderBy("ts").rowsBetween(1 - n, 0))


def ewma_vol(x: str, n: int, alpha: float, keys: Sequence[str] = ("pair",)) -> Column:
    """Square root of the squares of the last n rows, averaged from 0 on with weight alpha for each later one; null where none is known."""
    v = last_values(x, n, keys)
    return F.when(F.size(v) > 0, F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, e: alpha * e * e + (1 - alpha) * a)))


def mad_vol(x: str, n: int, scale: float = 1.4826, keys: Sequence[str] = ("pair",)) -> Column:
    """Median distance of the last n rows from their median, scaled to a deviation; null where none is known."""

    def middle(v: Column) -> Column:
        s, k = F.array_sort(v), F.size(v)
        return (F.get(s, F.floor((k - 1) / 2).cast("int")) + F.get(s, F.floor(k / 2).cast("int"))) / 2

    v = last_values(x, n, keys)
    # the median is bound once, as the only element of an array, not found again for each value
    off = F.transform(F.array(middle(v)), lambda m: F.transform(v, lambda e: F.abs(e - m)))[0]
    return F.when(F.size(v) > 0, scale * F.transform(F.array(off), middle)[0])


@F.udtf(returnType="symbol string, ts timestamp_ntz, close double, filled boolean")
class GapFill:
    """A table function over one series in order of time: its bars, and between them the missing ones with the last known close."""

    def __init__(self):
        self.ts, self.close = None, None

    def eval(self, row: Row, seconds: int):
        step = datetime.timedelta(seconds=seconds)
        while self.ts is not None and self.ts + step < row["ts"]:
            self.ts += step
            yield row["symbol"], self.ts, self.close, True
        self.ts, self.close = row["ts"], self.close if row["close"] is None else row["close"]
        yield row["symbol"], self.ts, self.close, row["close"] is None


def gap_filled(bars: DataFrame, seconds: int) -> DataFrame:
    """(symbol, ts, close, filled) of bars (symbol, ts, close) at whole steps: one for each step from a series' first bar to its last; missing closes take the last known one.

    A task fills one series as it passes and holds one bar of it. Bars are at whole steps from the first, and don't repeat.
    """
    return GapFill(bars.select("symbol", "ts", "close").asTable().partitionBy("symbol").orderBy("ts"), F.lit(seconds))
