"""Position sizes: conviction, volatility, correlation, drawdown, regime, risk and final limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.bars import last
from tickloom.operators.entries import clip

#: Size factor by volatility class and by trend class.
REGIME = {"high": 0.7, "low": 1.2}
TRENDING = 0.8


def concentration(sizes: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """(keys, n, exposure, hhi, effective_n, max_share)."""
    share = F.col(size) / F.sum(size).over(Window.partitionBy(*keys))
    return sizes.withColumn("__s", share).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(size).alias("exposure"), F.sum(F.col("__s") * F.col("__s")).alias("hhi"), (1 / F.sum(F.col("__s") * F.col("__s"))).alias("effective_n"), F.max("__s").alias("max_share"))


def conviction(score: Column, mode: str, least: float = 0.25, most: float = 1.0, power: float = 2.0, steep: float = 10.0) -> Column:
    """A score between 0 and 1 as a share of the largest size."""
    s = clip(score, 0.0, 1.0)
    if mode == "linear":
        shape = s
    elif mode == "power":
        shape = F.pow(s, power)
    elif mode == "exponential":
        shape = (F.exp(power * s) - 1) / (F.exp(F.lit(power)) - 1)
    elif mode == "sigmoid":
        shape = 1 / (1 + F.exp(-steep * (s - 0.5)))
    elif mode == "stepped":
        shape = F.when(s >= 0.75, 1.0).when(s >= 0.5, 0.66).when(s >= 0.25, 0.33).otherwise(0.0)
    else:
        raise ValueError(mode)
    return least + (most - least) * shape


def kelly(win_rate: Column, avg_win: Column, avg_loss: Column, part: float = 0.5) -> Column:
    """A part of the Kelly share, between 0 and 1."""
    return clip(part * (win_rate - (1 - win_rate) / F.when(avg_loss > 1e-12, avg_win / avg_loss)), 0.0, 1.0)


def vol_target(vol: Column, target: float, lo: float = 0.5, hi: float = 2.0) -> Column:
    return F.coalesce(clip(target / F.when(vol > 1e-12, vol), lo, hi), F.lit(1.0))


def correlation_penalty(candidates: DataFrame, open_: DataFrame, corr: DataFrame, free: float = 0.5, least: float = 0.5) -> DataFrame:
    """candidates (pair) with max_corr to open pairs and penalty, falling from 1 above `free`. corr has (pair_a, pair_b, corr)."""
    both = corr.unionByName(corr.select(F.col("pair_b").alias("pair_a"), F.col("pair_a").alias("pair_b"), "corr"))
    most = both.join(open_.select(F.col("pair").alias("pair_b")), "pair_b", "left_semi").groupBy(F.col("pair_a").alias("pair")).agg(F.max(F.abs("corr")).alias("max_corr"))
    d = candidates.join(most, "pair", "left").withColumn("max_corr", F.coalesce("max_corr", F.lit(0.0)))
    return d.withColumn("penalty", F.greatest(F.lit(least), 1 - F.greatest(F.col("max_corr") - free, F.lit(0.0)) / (1 - free)))


def performance_factor(ret: Column, w, n: int) -> Column:
    """Between .5 and 1.5 by the rolling Sharpe ratio; 1 where half a window is missing."""
    f = last(w, n)
    ratio = F.avg(ret).over(f) / F.when(F.stddev_samp(ret).over(f) > 1e-12, F.stddev_samp(ret).over(f))
    return F.when(F.count(ret).over(f) >= n // 2, clip(1 + 0.25 * ratio, 0.5, 1.5)).otherwise(1.0)


def drawdown_factor(dd: Column, start: float = 0.03, whole: float = 0.10) -> Column:
    return 1 - 0.5 * clip((dd - start) / (whole - start), 0.0, 1.0)


def regime_factor(vol_class: Column, trend_class: Column) -> Column:
    out = F.lit(1.0)
    for k, v in REGIME.items():
        out = F.when(vol_class == k, v).otherwise(out)
    return out * F.when(trend_class == "trending", TRENDING).otherwise(1.0)


def risk_factor(mae: Column, vol: Column, stop: Column, confidence: Column, mae_mid: float, vol_mid: float) -> Column:
    """Between .5 and 1.5: more for little predicted risk, less for much; half as far from 1 without confidence."""
    risk = 0.4 * clip(mae / (2 * mae_mid), 0.0, 1.0) + 0.3 * clip(vol / (2 * vol_mid), 0.0, 1.0) + 0.3 * clip(stop, 0.0, 1.0)
    size = F.when(risk < 0.3, 1 + 0.5 * (0.3 - risk) / 0.3).when(risk > 0.6, 1 - 0.5 * (risk - 0.6) / 0.4).otherwise(1.0)
    return F.when(confidence < 0.5, 1 + 0.5 * (size - 1)).otherwise(size)


def clamped(sizes: DataFrame, size: str, single: float, total: float, dust: float, keys: Sequence[str] = ("ts",)) -> DataFrame:
    """sizes with `size` zero below dust, at most single, and scaled down where a group's sum exceeds total."""
    one = F.when(F.abs(size) < dust, 0.0).otherwise(F.least(F.abs(size), F.lit(single)) * F.signum(F.col(size)))
    d = sizes.withColumn(size, one)
    whole = F.sum(F.abs(size)).over(Window.partitionBy(*keys))
    return d.withColumn(size, F.when(whole > total, F.col(size) * total / whole).otherwise(F.col(size)))


def inverse_vol(sizes: DataFrame, vol: str, floor: float, keys: Sequence[str] = ("ts",)) -> DataFrame:
    """sizes with weight: inverse volatility within a group; a missing one counts as the group's median."""
    mid = sizes.groupBy(*keys).agg(F.median(vol).alias("__mid"))
    d = sizes.join(mid, list(keys)).withColumn("__i", 1 / F.greatest(F.coalesce(vol, "__mid"), F.lit(floor)))
    return d.withColumn("weight", F.col("__i") / F.sum("__i").over(Window.partitionBy(*keys))).drop("__i", "__mid")


def exposure_scale(bars: DataFrame, target: float, most: int) -> DataFrame:
    """bars (ts, exposure, n_active, n_pending) with scale: diversification times the gap to the target, between .25 and 2."""
    div = F.sqrt(F.least(F.col("n_active") + F.col("n_pending"), F.lit(most)) / most)
    gap = F.greatest(target - F.col("exposure"), F.lit(0.0)) / target
    return bars.withColumn("scale", clip(2 * div * gap, 0.25, 2.0))


def dynamic_stop(vols: DataFrame, base: float, lo: float = 0.7, hi: float = 1.5) -> DataFrame:
    """(pair, stop): wider for calm pairs; volatility against the median of the pairs' medians."""
    each = vols.groupBy("pair").agg(F.median("vol").alias("v"))
    mid = each.agg(F.median("v").alias("mid"))
    return each.join(F.broadcast(mid)).select("pair", (base * clip(1 / clip(F.col("v") / F.col("mid"), 0.5, 2.0), lo, hi)).alias("stop"))
