"""The scan for pairs: correlated candidates, gates on a training and a validation part, tests with chosen lags, and two stages.

Only candidates meet bar by bar: a pair that fails the correlation never has its bars joined.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.pairs import block_betas, correlated, p_value, rolling_stationarity
from tickloom.sources.runs import saved

#: Both directions of a pair; the first wins ties.
DIRECTIONS = ("y~x", "x~y")


@dataclasses.dataclass(frozen=True)
class Limits:
    """What a pair must meet: p below max_p, a spread deviation of min_vol, |z| in validation up to max_z, half-lives (bars), and in a second stage shares of failed tests and drift."""

    max_p: float = 0.03
    min_vol: float = 0.002
    max_z: float = 2.0
    min_half_life: float = 80.0
    max_half_life: float = 720.0
    max_failures: float = 0.3
    max_beta_drift: float = 0.5


def bars_of(pairs: DataFrame, prices: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, pair, ts, y, x) of the named pairs (keys, pair) alone; prices has (keys, ts, symbol, lp)."""
    legs = pairs.select(*keys, "pair", F.split("pair", "-", 2)[0].alias("coin_y"), F.split("pair", "-", 2)[1].alias("coin_x"))
    y = prices.select(*keys, F.col("symbol").alias("coin_y"), "ts", F.col("lp").alias("y"))
    x = prices.select(*keys, F.col("symbol").alias("coin_x"), "ts", F.col("lp").alias("x"))
    return legs.join(y, [*keys, "coin_y"]).join(x, [*keys, "coin_x", "ts"]).select(*keys, "pair", "ts", "y", "x")


def liquid(prices: DataFrame, volumes: DataFrame, least: float, keys: Sequence[str] = ()) -> DataFrame:
    """prices of symbols whose mean volume is at least `least`; volumes has (keys, ts, symbol, volume)."""
    good = volumes.groupBy(*keys, "symbol").agg(F.avg("volume").alias("v")).where(F.col("v") >= least).select(*keys, "symbol")
    return prices.join(good, [*keys, "symbol"], "left_semi")


def spreads(bars: DataFrame, keys: Sequence[str], ratio: float) -> DataFrame:
    """bars both ways: (keys, pair, direction, ts, y, x, train, beta, spread, mean), with the ratio and the mean of the training part, the first bars."""
    ways = F.array(F.struct(F.lit(DIRECTIONS[0]).alias("direction"), "y", "x"), F.struct(F.lit(DIRECTIONS[1]).alias("direction"), F.col("x").alias("y"), F.col("y").alias("x")))
    d = bars.select(*keys, "pair", "ts", F.explode(ways).alias("w")).select(*keys, "pair", "ts", "w.*")
    all_ = Window.partitionBy(*keys, "pair", "direction")
    n = F.count("*").over(all_)
    size = F.greatest(F.lit(2), F.least(F.floor(n * ratio), n - 2))
    d = d.withColumn("train", F.row_number().over(all_.orderBy("ts")) <= size)
    ty, tx = F.when(F.col("train"), F.col("y")), F.when(F.col("train"), F.col("x"))
    flat = F.var_samp(tx).over(all_) > 1e-18
    d = d.withColumn("beta", F.when(flat, F.covar_samp(ty, tx).over(all_) / F.var_samp(tx).over(all_)))
    d = d.withColumn("spread", F.col("y") - F.col("beta") * F.col("x"))
    return d.withColumn("mean", F.avg(F.when(F.col("train"), F.col("spread"))).over(all_))


def gates(sides: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, pair, direction, n, hedge_ratio, spread_vol, half_life, max_z, current_z, df): one aggregate of `spreads`.

    half_life is that of the training spread, infinite if it doesn't revert; max_z and current_z are distances of the validation part from the training mean, in
    training deviations; df is the Dickey-Fuller statistic of the training residuals without lags.
    """
    by = [*keys, "pair", "direction"]
    e = F.col("spread") - F.col("mean")
    d = sides.withColumn("e", e).withColumn("e1", F.lag("e").over(Window.partitionBy(*by).orderBy("ts")))
    step = F.when(F.col("train") & F.col("e1").isNotNull(), F.col("e") - F.col("e1"))
    level, off = F.when(step.isNotNull(), F.col("e1")), F.when(~F.col("train"), F.col("e"))
    g = d.groupBy(*by).agg(
        F.count("*").alias("n"), F.max("beta").alias("hedge_ratio"), F.stddev_samp(F.when(F.col("train"), F.col("spread"))).alias("spread_vol"), F.regr_slope(step, level).alias("slope"), F.max(F.abs(off)).alias("far"),
        F.max_by("e", "ts").alias("now"), F.count(step).alias("k"), F.sum(level * level).alias("ss"), F.sum(level * step).alias("sd"), F.sum(step * step).alias("dd"),
    )
    rho = F.col("sd") / F.col("ss")
    error = F.sqrt((F.col("dd") - rho * F.col("sd")) / (F.col("k") - 1) / F.col("ss"))
    fine = F.col("spread_vol") > 1e-8
    return g.select(
        *by, "n", "hedge_ratio", "spread_vol", F.when(F.col("slope") < -1e-10, -F.log(F.lit(2.0)) / F.col("slope")).otherwise(float("inf")).alias("half_life"),
        F.when(fine, F.col("far") / F.col("spread_vol")).alias("max_z"), F.when(fine, F.col("now") / F.col("spread_vol")).alias("current_z"), F.when(fine & (F.col("k") > 1) & (F.col("ss") > 0), F.try_divide(rho, error)).alias("df"),
    )


def best_lags(e: np.ndarray, most: int, constant: bool = False) -> tuple[int, float]:
    """(lags, statistic) of the augmented Dickey-Fuller regression, by Akaike's criterion, without a constant for residuals; (0, NaN) if it can't be had.

    All regressions share the rows that the most lags leave, so they are nested, and one QR decomposition gives the squares that each leaves over.
    """
    d = np.diff(e)
    most = min(most, max(0, len(d) // 2 - 2))
    if len(d) < 4 or np.ptp(e) < 1e-12:
        return 0, float("nan")

    def design(lags: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
        first = [np.ones(rows)] if constant else []
        return np.column_stack([*first, e[-rows - 1 : -1], *(d[len(d) - rows - k : len(d) - k] for k in range(1, lags + 1))]), d[-rows:]

    x, y = design(most, len(d) - most)
    q, _ = np.linalg.qr(x)
    left = (y @ y - np.cumsum((q.T @ y) ** 2))[int(constant) :]
    lags = int(np.argmin(len(y) * np.log(np.maximum(left, 1e-300) / len(y)) + 2 * np.arange(most + 1)))
    x, y = design(lags, len(d) - lags)
    square = x.T @ x
    coef = np.linalg.solve(square, x.T @ y)
    rest = y - x @ coef
    at = int(constant)
    return lags, float(coef[at] / np.sqrt(rest @ rest / (len(y) - x.shape[1]) * np.linalg.inv(square)[at, at]))


def tested(sides: DataFrame, keys: Sequence[str], max_lags: int = 5) -> DataFrame:
    """(keys, pair, direction, lags, statistic, p_value) of the training residuals. A task sees one direction of one pair; p is null where there is no test."""
    by, kinds = [*keys, "pair", "direction"], dict(sides.dtypes)

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        e = pdf.sort_values("ts")["e"].to_numpy(float)
        try:
            lags, t = best_lags(e[np.isfinite(e)], max_lags)
        except np.linalg.LinAlgError:
            lags, t = 0, float("nan")
        return pd.DataFrame([(*(pdf[k].iat[0] for k in by), lags, t, p_value(t, 2) if t == t else None)], columns=[*by, "lags", "statistic", "p_value"])

    train = sides.where("train").select(*by, "ts", (F.col("spread") - F.col("mean")).alias("e"))
    return train.groupBy(*by).applyInPandas(test, ", ".join(f"{k} {kinds[k]}" for k in by) + ", lags long, statistic double, p_value double")


def with_reason(rows: DataFrame, limits: Limits) -> DataFrame:
    """rows with reason, the first gate that a direction fails: volatility, test, p_value, drift, half_life, rolling, beta_drift; null if it passes.

    A figure of the second stage that rows don't have isn't asked for.
    """
    have = set(rows.columns)
    bad = F.when(~(F.coalesce(F.col("spread_vol"), F.lit(0.0)) >= limits.min_vol), "volatility")
    if "p_value" in have:
        bad = bad.when(F.col("p_value").isNull(), "test").when(F.col("p_value") >= limits.max_p, "p_value")
    bad = bad.when(F.col("max_z").isNull() | (F.col("max_z") > limits.max_z), "drift").when(~F.col("half_life").between(limits.min_half_life, limits.max_half_life), "half_life")
    if "failure_rate" in have:
        bad = bad.when(F.col("failure_rate") > limits.max_failures, "rolling")
    if "beta_drift" in have:
        bad = bad.when(F.col("beta_drift") > limits.max_beta_drift, "beta_drift")
    return rows.withColumn("reason", bad)


def better(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of both directions of a pair the one that passes, of two the lower p (then the first); of none the first, with its reason."""
    rank = F.struct(F.col("reason").isNotNull(), F.when(F.col("reason").isNull(), F.col("p_value") if "p_value" in rows.columns else F.lit(0.0)), (F.col("direction") != DIRECTIONS[0]))
    rest = [c for c in rows.columns if c not in (*keys, "pair")]
    return rows.groupBy(*keys, "pair").agg(F.min_by(F.struct(*rest), rank).alias("r")).select(*keys, "pair", "r.*")


def scan(prices: DataFrame, keys: Sequence[str] = (), limits: Limits = Limits(), ratio: float = 0.9, least_corr: float = 0.6, least_rows: int = 3, max_lags: int | None = 5) -> DataFrame:
    """One row for each candidate: (keys, pair, direction, n, hedge_ratio, spread_vol, half_life, max_z, current_z, df, lags, statistic, p_value, reason).

    prices has (keys, ts, symbol, lp). Candidates correlate by least_corr over least_rows bars or more; the first `ratio` of a pair's bars train. With max_lags None
    nothing is tested, and neither lags, statistic nor p_value come back. prices are read four times, so they are best a written table.
    """
    pairs = correlated(prices, least_corr, least_rows, keys)
    sides = spreads(bars_of(pairs, prices, keys), keys, ratio)
    if max_lags is not None:
        sides = saved(sides)  # gates and tests read it
    rows = gates(sides, keys)
    if max_lags is not None:
        rows = rows.join(tested(sides, keys, max_lags), [*keys, "pair", "direction"])
    return better(with_reason(rows, limits), keys)


def two_stage(prices: DataFrame, discovery_days: int, validation_days: int, loose: Limits, tight: Limits, final_p: float, lives: tuple[float, float], blocks: tuple[int, int, int, int], least_corr: float = 0.6, max_lags: int = 5, all_: bool = False) -> DataFrame:
    """(pair, coin_y, coin_x, stage1_*, stage2_*, passed_both, reason, current_z, p_value, half_life_bars) of pairs that a first stage finds and a second confirms.

    The first stage scans the last discovery_days, 85 % of them as training, by `loose`; the second tests the found direction on the last validation_days (75 %), by `tight`,
    with tests over rolling windows and block ratios (blocks: window and step of each, in bars), then asks for final_p and half-lives within `lives`.
    With all_, pairs that the second stage refuses come too.
    """
    end = F.max("ts")
    cut = prices.agg((end - F.make_dt_interval(F.lit(discovery_days))).alias("first"), (end - F.make_dt_interval(F.lit(validation_days))).alias("second"))
    d = prices.crossJoin(F.broadcast(cut))  # one row
    found = scan(d.where("ts >= first").select("ts", "symbol", "lp"), (), loose, 0.85, least_corr, 3, max_lags).where("reason is null")
    leg = F.split("pair", "-", 2)
    turned = F.col("direction") == DIRECTIONS[1]
    found = found.select(
        F.concat_ws("-", F.when(turned, leg[1]).otherwise(leg[0]), F.when(turned, leg[0]).otherwise(leg[1])).alias("pair"), F.col("p_value").alias("stage1_p_value"), F.col("half_life").alias("stage1_half_life"), F.col("hedge_ratio").alias("stage1_hedge_ratio"), "current_z",
    )
    recent = d.where("ts >= second").select("ts", "symbol", "lp")
    sides = spreads(bars_of(found, recent), (), 0.75).where(F.col("direction") == DIRECTIONS[0])
    train = sides.where("train")
    rows = gates(sides, ()).join(tested(sides, (), max_lags), ["pair", "direction"])
    rows = rows.join(rolling_stationarity(train.select("pair", "ts", "spread"), blocks[0], blocks[1]).select("pair", "failure_rate"), "pair", "left")
    start = F.col("beta_start")
    drift = F.when((F.col("n_blocks") >= 2) & (F.abs(start) > 1e-6), F.abs(F.col("beta_drift") / start)).otherwise(0.0)  # beside the first block's ratio
    rows = with_reason(rows.join(block_betas(train.select("pair", "ts", "y", "x"), blocks[2], blocks[3]).select("pair", drift.alias("beta_drift")), "pair", "left"), tight)
    late = F.when(F.col("reason").isNull() & ~(F.col("p_value") < final_p), "final_p_value").when(F.col("reason").isNull() & ~F.col("half_life").between(*lives), "final_half_life")
    got = rows.select("pair", *(F.when(F.col("reason").isNull(), F.col(c)).alias(n) for c, n in (("p_value", "stage2_p_value"), ("half_life", "stage2_half_life"), ("hedge_ratio", "stage2_hedge_ratio"))), F.coalesce("reason", late).alias("reason"))
    out = found.join(got, "pair", "left").withColumn("passed_both", F.col("reason").isNull() & F.col("stage2_p_value").isNotNull())
    out = out.select("pair", leg[0].alias("coin_y"), leg[1].alias("coin_x"), "stage1_p_value", "stage1_half_life", "stage1_hedge_ratio", "stage2_p_value", "stage2_half_life", "stage2_hedge_ratio", "passed_both", "reason", "current_z", F.coalesce("stage2_p_value", "stage1_p_value").alias("p_value"), F.coalesce("stage2_half_life", "stage1_half_life").alias("half_life_bars"))
    return out if all_ else out.where("passed_both")
