"""Pairs of series: correlation, hedge ratios, half-life, stationarity, and the statistics of a scan."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def correlated(prices: DataFrame, least: float, least_rows: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, pair, n, corr) of symbols a < b with at least |corr| and rows in common; prices has (keys, ts, symbol, lp). What doesn't move has no correlation.

    Symbols are paired within a bar: the prices of one bar come together once and pair up there, so what is shuffled is
    the prices, and sums for each pair.
    """
    at = prices.groupBy(*keys, "ts").agg(F.sort_array(F.collect_list(F.struct("symbol", "lp"))).alias("all"))
    a = at.select(*keys, "ts", F.posexplode("all").alias("i", "a"), "all")
    both = a.select(*keys, F.col("a"), F.explode(F.expr("slice(all, i + 2, size(all))")).alias("b"))
    out = both.groupBy(*keys, F.concat_ws("-", "a.symbol", "b.symbol").alias("pair")).agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("a.lp", "b.lp"), F.stddev_pop("a.lp") * F.stddev_pop("b.lp")).alias("corr"))
    return out.where((F.col("n") >= least_rows) & (F.abs("corr") >= least))


def hedge(pair_bars: DataFrame, keys: Sequence[str] = ("pair",)) -> DataFrame:
    """(keys, n, beta, alpha) of the regression of y on x."""
    return pair_bars.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("beta"), F.regr_intercept("y", "x").alias("alpha"))


def with_spread(pair_bars: DataFrame, ratios: DataFrame, keys: Sequence[str] = ("pair",)) -> DataFrame:
    return pair_bars.join(ratios, list(keys)).withColumn("spread", F.col("y") - F.col("beta") * F.col("x") - F.col("alpha"))


def half_life(spreads: DataFrame, keys: Sequence[str] = ("pair",)) -> DataFrame:
    """(keys, half_life): -ln 2 over the slope of the spread's change on its value before; infinite if it doesn't revert."""
    w = Window.partitionBy(*keys).orderBy("ts")
    lagged = spreads.withColumn("before", F.lag("spread").over(w)).where("before is not null")
    slope = lagged.groupBy(*keys).agg(F.regr_slope(F.col("spread") - F.col("before"), F.col("before")).alias("slope"))
    return slope.select(*keys, F.when(F.col("slope") < -1e-10, -F.log(F.lit(2.0)) / F.col("slope")).otherwise(float("inf")).alias("half_life"))


def weighted_hedge(pair_bars: DataFrame, half: float, keys: Sequence[str] = ("pair",)) -> DataFrame:
    """(keys, beta, alpha) with weights that halve every `half` bars back from the last."""
    w = Window.partitionBy(*keys).orderBy(F.desc("ts"))
    d = pair_bars.withColumn("w", F.pow(F.lit(0.5), (F.row_number().over(w) - 1) / half))
    s = d.groupBy(*keys).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("x")).alias("x"), F.sum(F.col("w") * F.col("y")).alias("y"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("w") * F.col("x") * F.col("y")).alias("xy"))
    beta = (F.col("w") * F.col("xy") - F.col("x") * F.col("y")) / (F.col("w") * F.col("xx") - F.col("x") * F.col("x"))
    return s.select(*keys, beta.alias("beta"), ((F.col("y") - beta * F.col("x")) / F.col("w")).alias("alpha"))


def block_betas(pair_bars: DataFrame, size: int, step: int) -> DataFrame:
    """(pair, n_blocks, beta_std, beta_range, beta_drift, beta_start) of regressions over blocks of `size` bars, begun every `step`."""
    n = F.count("*").over(Window.partitionBy("pair"))
    i = F.row_number().over(Window.partitionBy("pair").orderBy("ts")) - 1
    d = pair_bars.withColumns({"i": i, "n": n})
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / step)).cast("int")
    last = F.least(F.floor(F.col("i") / step), F.floor((F.col("n") - size) / step)).cast("int")
    blocks = d.where(F.col("n") >= size).withColumns({"f": first, "l": last}).where("l >= f").withColumn("block", F.explode(F.sequence("f", "l")))
    beta = blocks.groupBy("pair", "block").agg(F.regr_slope("y", "x").alias("beta")).where("beta is not null")
    return beta.groupBy("pair").agg(F.count("*").alias("n_blocks"), F.stddev_pop("beta").alias("beta_std"), (F.max("beta") - F.min("beta")).alias("beta_range"), (F.max_by("beta", "block") - F.min_by("beta", "block")).alias("beta_drift"), F.min_by("beta", "block").alias("beta_start"))


def parts(df: DataFrame, k: int) -> DataFrame:
    """df with part, 0 to k - 1, by place in the pair; the last one takes what is left over."""
    w = Window.partitionBy("pair")
    i = F.row_number().over(w.orderBy("ts")) - 1
    return df.withColumn("part", F.least(F.floor(i / F.greatest(F.floor(F.count("*").over(w) / k), F.lit(1))), F.lit(k - 1)).cast("long"))


#: MacKinnon's published response surface of the test statistic's distribution, constant and no trend, one series and two:
#: bounds, and polynomials of the tail and of the middle.
_SURFACE = {
    1: (2.74, -18.83, -1.61, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)),
    2: (0.92, -18.86, -2.62, (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377)),
}


def p_value(t: float, series: int = 1) -> float:
    """Approximate p-value of a Dickey-Fuller or Engle-Granger statistic."""
    import math

    top, bottom, star, tail, middle = _SURFACE[series]
    if not math.isfinite(t) or t > top:
        return 1.0
    if t < bottom:
        return 0.0
    x = sum(c * t**i for i, c in enumerate(tail if t <= star else middle))
    return 0.5 * math.erfc(-x / math.sqrt(2))


def adf(x: np.ndarray, lags: int = 1) -> float:
    """The t statistic of the level in the augmented Dickey-Fuller regression with a constant; NaN if it can't be had."""
    d = np.diff(x)
    n = len(d) - lags
    if n < lags + 8 or np.ptp(x) < 1e-12:
        return float("nan")
    a = np.column_stack([x[lags:-1], np.ones(n), *(d[lags - k : len(d) - k] for k in range(1, lags + 1))])
    y = d[lags:]
    coef, _, rank, _ = np.linalg.lstsq(a, y, rcond=None)
    if rank < a.shape[1]:
        return float("nan")
    rest = y - a @ coef
    s2 = rest @ rest / (n - a.shape[1])
    return float(coef[0] / np.sqrt(s2 * np.linalg.inv(a.T @ a)[0, 0]))


def stationarity(spreads: DataFrame, keys: Sequence[str] = ("pair",), lags: int = 1, series: int = 2) -> DataFrame:
    """(keys, n, adf, p_value) of the column spread in order of ts. A task sees one group: one pair in one window."""
    kinds = dict(spreads.dtypes)

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("ts")["spread"].to_numpy(float)
        t = adf(x[np.isfinite(x)], lags)
        return pd.DataFrame([(*(pdf[k].iat[0] for k in keys), len(x), t, p_value(t, series))], columns=[*keys, "n", "adf", "p_value"])

    return spreads.select(*keys, "ts", "spread").groupBy(*keys).applyInPandas(test, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n long, adf double, p_value double")


def engle_granger(y: np.ndarray, x: np.ndarray, lags: int = 1) -> tuple[float, float, float, float, float, float]:
    """(beta, alpha, spread_vol, half_life, adf, p_value) of the regression of y on x and of what it leaves over."""
    nan = float("nan")
    if len(y) < 3 or np.ptp(x) < 1e-12:
        return nan, nan, nan, float("inf"), nan, 1.0
    beta = float(np.cov(y, x)[0, 1] / np.var(x, ddof=1))
    alpha = float(y.mean() - beta * x.mean())
    s = y - beta * x - alpha
    before, change = s[:-1], np.diff(s)
    v = np.var(before)
    slope = float(np.mean((change - change.mean()) * (before - before.mean())) / v) if v > 1e-18 else 0.0
    t = adf(s, lags)
    return beta, alpha, float(s.std(ddof=1)), float(-np.log(2) / slope) if slope < -1e-10 else float("inf"), t, p_value(t, 2)


def scan(pair_bars: DataFrame, keys: Sequence[str] = ("pair",), lags: int = 1) -> DataFrame:
    """Engle-Granger both ways: (keys, direction, beta, alpha, spread_vol, half_life, adf, p_value), of the lower p.

    One shuffle of the bars; a task sees one group, a pair in a window.
    """
    kinds = dict(pair_bars.dtypes)

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        y, x = pdf["y"].to_numpy(float), pdf["x"].to_numpy(float)
        fine = np.isfinite(y) & np.isfinite(x)
        both = [("x~y", *engle_granger(x[fine], y[fine], lags)), ("y~x", *engle_granger(y[fine], x[fine], lags))]
        return pd.DataFrame([(*(pdf[k].iat[0] for k in keys), *min(both, key=lambda r: (r[-1], r[0])))], columns=[*keys, "direction", "beta", "alpha", "spread_vol", "half_life", "adf", "p_value"])

    return pair_bars.select(*keys, "ts", "y", "x").groupBy(*keys).applyInPandas(test, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", direction string, beta double, alpha double, spread_vol double, half_life double, adf double, p_value double")


def rolling_stationarity(spreads: DataFrame, size: int, step: int, lags: int = 5, level: float = 0.05) -> DataFrame:
    """(pair, n_windows, failure_rate, mean_p, max_p) of tests over windows of `size` bars, begun every `step`."""
    n, i = F.count("*").over(Window.partitionBy("pair")), F.row_number().over(Window.partitionBy("pair").orderBy("ts")) - 1
    d = spreads.withColumns({"i": i, "n": n}).where(F.col("n") >= size)
    first, last = F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / step)).cast("int"), F.least(F.floor(F.col("i") / step), F.floor((F.col("n") - size) / step)).cast("int")
    each = stationarity(d.withColumns({"f": first, "l": last}).where("l >= f").withColumn("part", F.explode(F.sequence("f", "l"))).drop("n"), ("pair", "part"), lags, 1)
    return each.groupBy("pair").agg(F.count("*").alias("n_windows"), F.avg((F.col("p_value") > level).cast("int")).alias("failure_rate"), F.avg("p_value").alias("mean_p"), F.max("p_value").alias("max_p"))


def false_discovery(tests: DataFrame, alpha: float, keys: Sequence[str] = (), method: str = "bh") -> DataFrame:
    """tests (keys, pair, p_value) with rank, threshold and significant, by Benjamini-Hochberg or Bonferroni (`bonferroni`)."""
    w = Window.partitionBy(*(keys or [F.lit(0)]))
    d = tests.withColumns({"rank": F.row_number().over(w.orderBy("p_value", "pair")).cast("long"), "m": F.count("*").over(w)})
    if method == "bonferroni":
        return d.withColumn("threshold", alpha / F.col("m")).withColumn("significant", F.col("p_value") <= F.col("threshold")).drop("m")
    d = d.withColumn("threshold", F.col("rank") / F.col("m") * alpha)
    last = F.max(F.when(F.col("p_value") <= F.col("threshold"), F.col("rank"))).over(w)
    return d.withColumn("significant", F.coalesce(F.col("rank") <= last, F.lit(False))).drop("m")


def subwindow_passes(pair_bars: DataFrame, n: int, level: float, min_half_life: float = 0.0, max_half_life: float = float("inf")) -> DataFrame:
    """(pair, parts, passed, pass_rate, half_life_cv): parts of equal length are tested one by one; the variation is that of the parts that passed, 0 with fewer than two."""
    each = scan(parts(pair_bars, n).select("pair", "part", "ts", "y", "x"), ("pair", "part"))
    ok = (F.col("p_value") < level) & F.col("half_life").between(min_half_life, max_half_life)
    life = F.when(ok & (F.col("half_life") < float("inf")), F.col("half_life"))
    g = each.groupBy("pair").agg(F.count("*").alias("parts"), F.sum(ok.cast("long")).alias("passed"), F.count(life).alias("k"), F.stddev_pop(life).alias("sd"), F.avg(life).alias("mean"))
    return g.select("pair", "parts", "passed", (F.col("passed") / n).alias("pass_rate"), F.when(F.col("k") >= 2, F.col("sd") / F.col("mean")).otherwise(0.0).alias("half_life_cv"))


def weighted_stationarity(pair_bars: DataFrame, half: int, lags: int = 1) -> DataFrame:
    """(pair, beta, n, adf, p_value, half_life): the spread of the forgetting hedge ratio, tested on its last 3 half bars; its half-life is that of all bars."""
    w = weighted_hedge(pair_bars, half).select("pair", "beta")
    s = pair_bars.join(w, "pair").withColumn("spread", F.col("y") - F.col("beta") * F.col("x"))
    recent = s.withColumn("k", F.row_number().over(Window.partitionBy("pair").orderBy(F.desc("ts")))).where(F.col("k") <= 3 * half)
    lives = half_life(s.select("pair", "ts", "spread"))
    return w.join(stationarity(recent, ("pair",), lags, 1), "pair").join(lives, "pair")


def rolling_beta(n: int, y: Column, x: Column) -> Column:
    """Covariance over variance of the last n rows of a pair."""
    w = Window.partitionBy("pair").orderBy("ts").rowsBetween(1 - n, 0)
    return F.when((F.count(x).over(w) >= n) & (F.var_samp(x).over(w) > 1e-12), F.covar_samp(y, x).over(w) / F.var_samp(x).over(w))
