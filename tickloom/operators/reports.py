"""Reports on windows, regimes, sizes, models and whole runs."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.entries import clip
from tickloom.operators.pairs import correlated
from tickloom.operators.walkforward import with_windows

FIGURES = ("pnl", "trades", "stop_rate", "win_rate", "bench_return", "bench_vol", "dispersion", "mean_corr")


def window_figures(trades: DataFrame, returns: DataFrame, benchmark: str, per_year: int) -> DataFrame:
    """(window_id, FIGURES) of windows that have trades; returns has (window_id, symbol, ts, px, ret), ret null at a window's first bar."""
    b = returns.where((F.col("symbol") == benchmark) & (F.col("px") > 0)).groupBy("window_id").agg((F.max_by("px", "ts") / F.min_by("px", "ts") - 1).alias("bench_return"), (F.stddev_samp("ret") * per_year**0.5).alias("bench_vol"))
    x = returns.groupBy("window_id", "ts").agg(F.stddev_samp("ret").alias("sd")).groupBy("window_id").agg(F.avg("sd").alias("dispersion"))
    c = correlated(returns.where("ret is not null").select("window_id", "symbol", "ts", F.col("ret").alias("lp")), 0.0, 2, ["window_id"]).groupBy("window_id").agg(F.avg("corr").alias("mean_corr"))
    t = trades.groupBy("window_id").agg(F.sum("net").alias("pnl"), F.count("*").cast("double").alias("trades"), F.avg((F.col("exit_reason") == 3).cast("int")).alias("stop_rate"), F.avg((F.col("net") > 0).cast("int")).alias("win_rate"))
    return t.join(b, "window_id").join(x, "window_id").join(c, "window_id").select("window_id", *FIGURES)


def losing_windows(windows: DataFrame, losing_below: float = -0.005) -> DataFrame:
    """(metric, losing_mean, winning_mean, delta, losing_count, winning_count), a row for each figure; means and delta are null where a side has no windows."""
    long = windows.withColumn("losing", F.col("pnl") < losing_below).unpivot("losing", list(FIGURES), "metric", "v")
    side = lambda lost: F.when(F.col("losing") == lost, F.col("v"))
    g = long.groupBy("metric").agg(F.avg(side(True)).alias("losing_mean"), F.avg(side(False)).alias("winning_mean"), F.count(side(True)).alias("losing_count"), F.count(side(False)).alias("winning_count"))
    return g.select("metric", "losing_mean", "winning_mean", (F.col("losing_mean") - F.col("winning_mean")).alias("delta"), "losing_count", "winning_count")


def window_advice(comparison: DataFrame) -> DataFrame:
    """(metric, delta, advice) for figures in which losing windows differ by enough."""
    d, m = F.col("delta"), F.col("metric")
    advice = (
        F.when((m == "bench_vol") & (d > 0.1), "tighten volatility limit").when((m == "dispersion") & (d > 0.0001), "tighten dispersion limit").when((m == "stop_rate") & (d > 0.1), "stricter entries or wider stops").when((m == "mean_corr") & (d < -0.1), "filter by correlation")
    )
    return comparison.select("metric", "delta", advice.alias("advice")).where("advice is not null")


#: Least and most half-life by trend, and by volatility where there is no trend.
RANGES = {"trending": (40, 480), "mean_reverting": (80, 1440), "high": (120, 1200), "low": (40, 720), "normal": (60, 960)}


def regime_ranges(prices: DataFrame, windows: DataFrame, benchmark: str, lookback: int = 336, vol_bars: int = 24, per_year: int = 35040) -> DataFrame:
    """(window_id, vol_percentile, vol, autocorr, volatility, trend, min_half_life, max_half_life) of each window's training part.

    vol_percentile is the share of the benchmark's rolling volatilities in the last `lookback` bars that are below the last one (0.5 with under two); autocorr the median of the
    symbols' lag-1 autocorrelations there, of those with twenty returns. Volatilities that agree to nine digits are equal. prices has (symbol, ts, px); a trend decides the range before volatility does.
    """
    d = with_windows(prices, windows).where("role = 'train'")
    own = Window.partitionBy("window_id", "symbol")
    d = d.withColumn("lr", F.log(F.col("px") / F.lag("px").over(own.orderBy("ts")))).where("lr is not null")
    frame = own.orderBy("ts").rowsBetween(1 - vol_bars, 0)
    d = d.withColumns({"r1": F.lag("lr").over(own.orderBy("ts")), "back": F.row_number().over(own.orderBy(F.desc("ts"))), "vol": F.when(F.count("lr").over(frame) >= vol_bars, F.round(F.stddev_samp("lr").over(frame), 9))}).where(F.col("back") <= lookback)
    v = d.where(F.col("symbol") == benchmark).withColumn("now", F.max(F.when(F.col("back") == 1, F.col("vol"))).over(Window.partitionBy("window_id")))
    p = v.groupBy("window_id").agg(F.when(F.count("vol") < 2, 0.5).otherwise(F.avg((F.col("vol") < F.col("now")).cast("int"))).alias("vol_percentile"), (F.coalesce(F.max("now"), F.lit(0.0)) * per_year**0.5).alias("vol"))
    varied = F.when((F.stddev_pop("lr") > 0) & (F.stddev_pop("r1") > 0), F.lit(True))
    pairs = d.where("r1 is not null").groupBy("window_id", "symbol").agg(F.try_divide(F.covar_pop("lr", "r1"), F.stddev_pop("lr") * F.stddev_pop("r1")).alias("c"), F.count("*").alias("n"), varied.alias("varied")).where("n >= 20 and varied")
    out = p.join(pairs.groupBy("window_id").agg(F.median("c").alias("autocorr")), "window_id", "left").withColumn("autocorr", F.coalesce("autocorr", F.lit(0.0)))
    out = out.withColumns({
        "volatility": F.when(F.col("vol_percentile") < 0.25, "low").when(F.col("vol_percentile") > 0.75, "high").otherwise("normal"),
        "trend": F.when(F.col("autocorr") > 0.15, "trending").when(F.col("autocorr") < -0.1, "mean_reverting").otherwise("neutral"),
    })
    kind = F.when(F.col("trend") != "neutral", F.col("trend")).otherwise(F.col("volatility"))
    at = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, v in RANGES.items() for x in (k, v[i]))), kind).cast("long")
    return out.withColumns({"min_half_life": at(0), "max_half_life": at(1)})


@dataclasses.dataclass(frozen=True)
class Sizes:
    """A base size, its factors by conviction, volatility target and correlation, and what a size stays within."""

    base: float = 1.0
    conviction: tuple[float, float] = (0.3, 1.2)
    target_vol: float = 0.15
    lookback: int = 48
    per_year: float = 8760.0
    vol_factor: tuple[float, float] = (0.5, 2.0)
    floor: float = 0.001
    threshold: float = 0.5
    penalty: float = 0.5
    least: float = 0.1
    most: float = 0.25


def sized(signals: DataFrame, sizes: Sizes) -> DataFrame:
    """signals (pair, ts, score, r (the spread's return), ...) with size.

    Volatility is that of the last returns once a quarter of the lookback (ten at least) is known, before that the pair's median, or a hundred floors. Correlation is the mean of |corr| of a pair's
    returns with all pairs', its own included, as one aggregate over the pairs of a bar; null scores have no size.
    """
    w = Window.partitionBy("pair").orderBy("ts").rowsBetween(1 - sizes.lookback, 0)
    known = F.count("r").over(w) >= max(10, sizes.lookback // 4)
    d = signals.withColumn("__v", F.when(known, F.stddev_samp("r").over(w)) * sizes.per_year**0.5)
    middle = F.median("__v").over(Window.partitionBy("pair"))
    d = d.withColumn("__v", F.greatest(F.lit(sizes.floor), F.coalesce("__v", F.when(middle > 0, middle).otherwise(sizes.floor * 100))))
    both = correlated(signals.where("r is not null").select("ts", F.col("pair").alias("symbol"), F.col("r").alias("lp")).withColumn("symbol", F.replace("symbol", F.lit("-"), F.lit("/"))), 0.0, 2)
    each = both.withColumn("pair", F.explode(F.split("pair", "-", 2))).groupBy("pair").agg(((F.sum(F.abs("corr")) + 1) / (F.count("*") + 1)).alias("__c")).withColumn("pair", F.replace("pair", F.lit("/"), F.lit("-")))
    d = d.join(each, "pair", "left")
    low, high = sizes.conviction
    by_vol = clip(sizes.target_vol / F.col("__v"), *sizes.vol_factor)
    over = F.greatest(F.coalesce("__c", F.lit(1.0)) - sizes.threshold, F.lit(0.0)) / max(1e-9, 1 - sizes.threshold) * sizes.penalty
    by_corr = F.greatest(F.lit(1 - sizes.penalty), 1 - over)
    size = sizes.base * (low + (high - low) * clip(F.col("score"), 0.0, 1.0)) * by_vol * by_corr
    return d.withColumn("size", F.when(F.col("score").isNotNull(), clip(size, sizes.least, sizes.most))).drop("__v", "__c")


def model_health(predictions: DataFrame, psi: float, days: int, baseline: float, fallback: float = 0.3, drift: float = 0.25, max_days: int = 30, bins: int = 10) -> DataFrame:
    """One row of predictions (p, y, confidence): percentiles of confidence, percent below `fallback`, errors, reasons to fit again (drift, accuracy, calibration, age), and retrain."""
    known = predictions.where(F.col("confidence").isNotNull() & ~F.isnan("confidence"))
    c = known.agg(F.count("*").alias("n"), *(F.percentile("confidence", F.lit(q / 100)).alias(f"confidence_p{q}") for q in (10, 50, 90)), (100 * F.avg((F.col("confidence") < fallback).cast("int"))).alias("fallback_pct"))
    e = predictions.agg(F.sqrt(F.avg(F.pow(F.col("p") - F.col("y"), 2))).alias("rmse"))
    gaps = predictions.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("k"), F.abs(F.avg("p") - F.avg("y")).alias("gap"))
    one = c.crossJoin(e).crossJoin(gaps.agg((F.sum(F.col("k") * F.col("gap")) / F.sum("k")).alias("ece")))  # single rows
    why = F.array(F.when(F.lit(psi > drift), "drift"), F.when(F.col("rmse") > 1.5 * baseline, "accuracy"), F.when(F.col("ece") > 0.15, "calibration"), F.when(F.lit(days > max_days), "age"))
    return one.withColumn("reasons", F.array_compact(why)).withColumn("retrain", F.size("reasons") > 0)


def run_totals(trades: DataFrame, capital: float) -> DataFrame:
    """One row: return compounded over windows (a window loses 99 % at most), shares of exits, and warnings."""
    w = trades.groupBy("window_id").agg(F.sum("net").alias("net"))
    total = w.agg(F.count("*").alias("windows"), (F.exp(F.sum(F.log1p(F.greatest(F.col("net") / capital, F.lit(-0.99))))) - 1).alias("compounded"))
    share = lambda k, n: F.avg((F.col("exit_reason") == k).cast("int")).alias(f"{n}_share")
    s = trades.agg(share(1, "signal"), share(2, "time"), share(3, "stop"), share(4, "forced"), (F.sum(F.col("fees") + F.col("slippage")) / F.abs(F.sum("gross"))).alias("cost"))
    return total.crossJoin(s).select("*", (F.col("stop_share") > 0.4).alias("many_stops"), (F.col("cost") > 0.5).alias("costly"), (F.col("forced_share") > 0.3).alias("many_forced")).drop("cost")


def wins_and_losses(trades: DataFrame, n: int) -> DataFrame:
    """(place, pair, wins, losses, win_rate) of the n pairs with most trades; of equals the first by name."""
    g = trades.groupBy("pair").agg(F.count("*").alias("trades"), F.sum((F.col("net") > 0).cast("long")).alias("wins")).orderBy(F.desc("trades"), "pair").limit(n)
    place = F.row_number().over(Window.orderBy(F.desc("trades"), "pair")).cast("long")  # n rows
    return g.select(place.alias("place"), "pair", "wins", (F.col("trades") - F.col("wins")).alias("losses"), (F.col("wins") / F.col("trades")).alias("win_rate"))


def quadrants(pairs: DataFrame) -> DataFrame:
    """(pair, expected, realised, dot, quadrant): dot is a size by trades; zeros count as a surprise."""
    e, r = F.col("expected"), F.col("realised")
    name = F.when((e > 0) & (r > 0), "as_hoped").when((e < 0) & (r < 0), "as_feared").when((e > 0) & (r < 0), "disappointed").otherwise("surprised")
    return pairs.select("pair", "expected", "realised", F.least(F.lit(500), F.greatest(F.lit(30), F.col("trades") * 20)).alias("dot"), name.alias("quadrant"))
