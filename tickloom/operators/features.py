"""Features of a pair's bars for models, as columns of one projection over a pair's rows in order of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.bars import last, percent_rank
from tickloom.operators.entries import no, of_pair


def within(c: Column, lo: float, hi: float) -> Column:
    """c kept between lo and hi; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def flag(c: Column) -> Column:
    """1 or 0, 0 for null."""
    return no(c).cast("double")


def rolling_autocorr(c: str, before: str, w: Window, n: int) -> Column:
    """Correlation of the last n values with those one bar earlier, all inside the frame; 0 unless all n are known and vary."""
    f = last(w, n - 1)
    d = F.stddev_samp(c).over(f) * F.stddev_samp(before).over(f)
    return F.when((F.count(c).over(last(w, n)) == n) & (d > 1e-12), F.covar_samp(c, before).over(f) / d).otherwise(0.0)


def for_scores(signals: DataFrame, entry: float, wide: float, k: int = 3, drift: int = 24, perf: int = 240, half_life: str = "half_life", gain: str | None = None) -> DataFrame:
    """(pair, ts, 21 features) for a score of signals: shape and speed of z, profit, volatility, half-life, stability.

    Comparisons with missing figures are 0, other missing figures stay null. A missing half-life is 500 bars, a missing
    gain column 0.5 throughout; crossings of zero are 0 until `perf` bars are known.
    """
    w = of_pair()
    z, a = F.col("z"), F.abs("z")
    d = signals.withColumns({
        "__z1": F.lag("z").over(w), "__zk": F.lag("z", k).over(w), "__zkk": F.lag("z", 2 * k).over(w), "__beta": F.lag("beta", drift).over(w),
        "__vol": F.when(F.count("vol").over(last(w, 24)) == 24, F.avg("vol").over(last(w, 24))), "__half": F.coalesce(half_life, F.lit(500.0)),
    })
    d = d.withColumns({"__v": (z - F.col("__zk")) / k, "__cross": no(z * F.col("__z1") < 0).cast("long")})
    v = F.col("__v")
    hold = F.when(F.col("expected_hold") != 0, F.col("expected_hold"))
    cols = {
        "z_score_abs": a,
        "z_normalized": (a - entry) / (wide - entry),
        "z_dist_from_optimal": F.abs(a - (entry + wide) / 2) / (wide - entry),
        "z_velocity": F.abs(v),
        "is_expanding": flag(z * v > 0),
        "is_reverting": flag(z * v < 0),
        "is_fresh_extreme": flag(a - F.abs("__zk") >= -0.1 * k),
        "is_stale_signal": flag((F.abs("__zkk") > a) & (z * v < 0)),
        "z_acceleration": F.abs(v - (F.col("__zk") - F.col("__zkk")) / k) / k,
        "expected_profit": within(F.col("expected_profit"), -0.1, 0.1),
        "expected_hold_bars": within(F.col("expected_hold").cast("double"), 0.0, 2000.0),
        "profit_per_bar": within(F.col("expected_profit") / hold, -0.001, 0.001),
        "spread_volatility": F.col("vol"),
        "vol_trend": within(F.col("vol") / F.when(F.col("__vol") != 0, F.col("__vol")), 0.5, 2.0),
        "half_life_bars": F.col("__half"),
        "half_life_normalized": within(F.col("__half") / 240, 0.1, 5.0),
        "mean_reversion_rate": F.log(F.lit(2.0)) / within(F.col("__half"), 60.0, 2000.0),
        "kalman_gain": within(F.col(gain), 0.0, 1.0) if gain else F.lit(0.5),
        "beta_abs": within(F.abs("beta"), 0.0, 5.0),
        "beta_drift_recent": within(F.abs(F.col("beta") - F.col("__beta")), 0.0, 1.0),
        "rolling_zero_crosses": F.when(F.count("*").over(last(w, perf)) == perf, F.sum("__cross").over(last(w, perf)).cast("double")).otherwise(0.0),
    }
    return d.select("pair", "ts", *(c.alias(n) for n, c in cols.items()))


def benchmark_state(returns: DataFrame, benchmark: str, n: int = 336) -> DataFrame:
    """(ts, vol_regime_pctl, trend_autocorr) of one symbol: rank of its rolling volatility, its rolling autocorrelation.

    0.5 and 0 until n returns are known. Volatilities that agree to nine digits are equal. One symbol's bars are ranked together.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    b = returns.where(F.col("symbol") == benchmark).withColumn("__r1", F.lag("ret").over(w))
    b = b.withColumn("__vol", F.when(F.count("ret").over(last(w, n)) == n, F.round(F.stddev_samp("ret").over(last(w, n)), 9)))
    b = b.withColumn("trend_autocorr", rolling_autocorr("ret", "__r1", w, n))
    return b.select("ts", F.coalesce(percent_rank(F.col("__vol"), Window.partitionBy("symbol")), F.lit(0.5)).alias("vol_regime_pctl"), "trend_autocorr")


def for_risk(signals: DataFrame, state: DataFrame, entry: float, half_life: str = "half_life", gain: str | None = None) -> DataFrame:
    """(pair, ts, 15 features) for the risk of an entry; state is benchmark_state, 0.5 and 0 at bars it lacks.

    Volatility is measured against the pair's median. No trade history is at hand: 24 hours since the last trade and a recent
    loss of 1 percent are fixed values.
    """
    w = of_pair()
    z, a = F.col("z"), F.abs("z")
    d = signals.withColumns({"__z1": F.lag("z").over(w), "__z3": F.lag("z", 3).over(w), "__beta": F.lag("beta", 24).over(w), "__mid": F.percentile("vol", F.lit(0.5)).over(Window.partitionBy("pair"))})
    d = d.withColumn("__d", z - F.col("__z1")).withColumn("__d1", F.lag("__d").over(w))
    before = F.abs("__z1")
    cols = {
        "z_score_abs": a,
        "z_normalized": a / entry,
        "z_velocity": z - F.col("__z3"),
        "is_fresh_extreme": flag((a > entry) & (before <= entry)),
        "is_reverting": flag((a < before) & (a > 0.5)),
        "spread_volatility": F.col("vol"),
        "spread_vol_ratio": within(F.col("vol") / F.greatest("__mid", F.lit(1e-6)), 0.1, 10.0),
        "spread_autocorr_lag1": rolling_autocorr("__d", "__d1", w, 24),
        "kalman_gain": F.col(gain) if gain else F.lit(0.5),
        "beta_drift_recent": F.abs(F.col("beta") - F.col("__beta")),
        "half_life_normalized": F.col(half_life) / 240,
        "hours_since_last_trade": F.lit(24.0),
        "recent_mae_same_pair": F.lit(0.01),
    }
    out = d.select("pair", "ts", *(c.alias(n) for n, c in cols.items())).join(state, "ts", "left")
    return out.withColumns({"vol_regime_pctl": F.coalesce("vol_regime_pctl", F.lit(0.5)), "trend_autocorr": F.coalesce("trend_autocorr", F.lit(0.0))})
