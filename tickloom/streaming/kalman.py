"""Online regression of y on x for each pair by a two-state Kalman filter, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.operators.pairs import p_value
from tickloom.operators.screening import best_lags

STATE = "x0 double, x1 double, p00 double, p01 double, p11 double, errors array<double>"
OUT = "pair string, ts timestamp_ntz, z double, beta double, alpha double, innovation double, vol double, gain double"


@dataclass(frozen=True)
class Params:
    """delta: how fast the ratio may move; r: noise of a bar; window: errors that z is scaled by; vol: how (std, ewma, mad); burn: errors before the first z (window, if None).

    z is null where the ratio's gain is above max_gain, and shrinks to max_p / p where the ratio's variance p is above max_p.
    """

    delta: float = 1e-6
    r: float = 0.01
    window: int = 96
    max_gain: float = 0.3
    max_p: float = 0.5
    vol: str = "std"
    alpha: float = 0.2
    scale: float = 1.4826
    burn: int | None = None


def spread_of(errors: np.ndarray, params: Params) -> float:
    """How wide past errors are, in the order in which they came; 0.01 where that can't be said."""
    if not len(errors):
        return 0.01
    if params.vol == "ewma":
        keep = (1 - params.alpha) ** np.arange(len(errors) - 1, -1, -1)
        out = float(np.sqrt(params.alpha * (keep * errors * errors).sum()))
    elif params.vol == "mad":
        out = float(np.median(np.abs(errors - np.median(errors))) * params.scale)
    else:
        out = float(np.std(errors))
    return out if out > 1e-8 else 0.01


def _within(v: float, low: float = 1e-10, high: float = 1e6) -> float:
    return min(max(v, low), high)


class Filter:
    """State [beta, alpha]; all of P is kept between 1e-10 and 1e6, gains within 1, and P updated in Joseph form. Errors lie in a ring."""

    def __init__(self, params: Params, state: tuple | None = None):
        self.params = params
        self.x0, self.x1, self.p00, self.p01, self.p11, errors = state or (1.0, 0.0, 1.0, 0.0, 1.0, [])
        self.ring, self.n = np.zeros(params.window), 0
        for e in list(errors)[-params.window :]:
            self._push(e)

    def _push(self, e: float) -> None:
        self.ring[self.n % len(self.ring)] = e
        self.n += 1

    def errors(self) -> np.ndarray:
        """The last errors, the oldest first."""
        if self.n <= len(self.ring):
            return self.ring[: self.n]
        return np.roll(self.ring, -(self.n % len(self.ring)))

    def state(self) -> tuple:
        return (*map(float, (self.x0, self.x1, self.p00, self.p01, self.p11)), self.errors().tolist())

    def update(self, y: float, x: float) -> tuple[float | None, float, float, float, float, float]:
        """(z, beta, alpha, innovation, vol, gain): all but the innovation from what was known before the bar."""
        k = self.params
        error = y - (x * self.x0 + self.x1)
        s = x * (self.p00 * x + self.p01) + self.p01 * x + self.p11 + k.r
        gain = abs(self.p00 * x + self.p01) / s if s > 1e-10 else 0.0
        past = self.errors()
        vol = spread_of(past, k)
        z = None
        if len(past) >= (k.window if k.burn is None else k.burn) and gain <= k.max_gain:
            z = float(error / vol * min(1.0, k.max_p / self.p00))
        out = (z, float(self.x0), float(self.x1), float(error), vol, float(gain))
        a00, a01, a11 = _within(self.p00 + k.delta / 100), _within(self.p01), _within(self.p11 + k.delta)
        h0, h1 = a00 * x + a01, a01 * x + a11
        s = x * h0 + h1 + k.r
        k0, k1 = (_within(h / s, -1.0, 1.0) if s > 1e-10 else 0.0 for h in (h0, h1))
        self.x0, self.x1 = self.x0 + k0 * error, self.x1 + k1 * error
        m00, m01 = (1 - k0 * x) * a00 - k0 * a01, (1 - k0 * x) * a01 - k0 * a11
        m10, m11 = -k1 * x * a00 + (1 - k1) * a01, -k1 * x * a01 + (1 - k1) * a11
        self.p00 = _within(m00 * (1 - k0 * x) - m01 * k0 + k.r * k0 * k0)
        self.p01 = _within(-m00 * k1 * x + m01 * (1 - k1) + k.r * k0 * k1)
        self.p11 = _within(-m10 * k1 * x + m11 * (1 - k1) + k.r * k1 * k1)
        self._push(error)
        return out


def _walk(f: Filter, pair: str, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("ts")
    fine = np.isfinite(pdf["y"].to_numpy(float)) & np.isfinite(pdf["x"].to_numpy(float))
    rows = [(pair, ts, *f.update(y, x)) for ts, y, x in zip(pdf["ts"][fine], pdf["y"][fine], pdf["x"][fine])]
    return pd.DataFrame(rows, columns=["pair", "ts", "z", "beta", "alpha", "innovation", "vol", "gain"])


def filtered(pair_bars: DataFrame, params: Params, warm: DataFrame | None = None) -> DataFrame:
    """Signals of (pair, ts, y, x) in order of time; with warm states (pair, state columns) those of pairs that have one. A task sees a pair."""
    bars = pair_bars.select("pair", "ts", "y", "x")
    if warm is None:
        return bars.groupBy("pair").applyInPandas(lambda pdf: _walk(Filter(params), pdf["pair"].iat[0], pdf), OUT)

    def go(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or state.empty:
            return pd.DataFrame(columns=["pair", "ts", "z", "beta", "alpha", "innovation", "vol", "gain"])
        known = tuple(state.iloc[0][["x0", "x1", "p00", "p01", "p11", "errors"]])
        return _walk(Filter(params, known), pdf["pair"].iat[0], pdf)

    return bars.groupBy("pair").cogroup(warm.groupBy("pair")).applyInPandas(go, OUT)


def last_days(pair_bars: DataFrame, half_lives: DataFrame, times: float = 3.0, bars_per_day: int = 24, days: tuple[int, int] = (7, 45), least: int = 100) -> DataFrame:
    """The end of each pair's bars, `times` its half-life (in bars) long, whole days within `days`; all bars of pairs that have under `least` there, or no half-life.

    half_lives has (pair, half_life); infinite ones count as the longest.
    """
    own = Window.partitionBy("pair")
    length = F.least(F.greatest(F.floor(F.least(F.col("half_life"), F.lit(1e9)) / bars_per_day * times), F.lit(days[0])), F.lit(days[1])).cast("int")
    d = pair_bars.join(half_lives.select("pair", length.alias("__days")), "pair", "left")
    d = d.withColumn("__late", F.coalesce(F.col("ts") >= F.max("ts").over(own) - F.make_dt_interval("__days"), F.lit(True)))
    d = d.withColumn("__late", F.col("__late") | (F.sum(F.col("__late").cast("int")).over(own) < least))
    return d.where("__late").drop("__days", "__late")


def warm_states(pair_bars: DataFrame, params: Params, half_lives: DataFrame | None = None, min_beta: float = 0.01, max_beta: float = 50.0, max_p: float = 5.0) -> DataFrame:
    """(pair, state columns) after all bars, or after `last_days` by half-lives, of pairs whose ratio and uncertainty are sane."""

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Filter(params)
        _walk(f, pdf["pair"].iat[0], pdf)
        return pd.DataFrame([(pdf["pair"].iat[0], *f.state())], columns=["pair", "x0", "x1", "p00", "p01", "p11", "errors"])

    bars = pair_bars.select("pair", "ts", "y", "x")
    bars = bars if half_lives is None else last_days(bars, half_lives)
    out = bars.groupBy("pair").applyInPandas(go, "pair string, " + STATE)
    return out.where((F.abs("x0") <= max_beta) & (F.abs("x0") >= min_beta) & (F.col("p00") <= max_p))


def spread_check(pair_bars: DataFrame, ratios: DataFrame, delta: float = 1e-6, r: float = 0.01, max_p: float = 0.05, max_divergence: float = 0.3, lags: int = 5) -> DataFrame:
    """(pair, n, kalman_beta, divergence, half_life, p_value, valid, reason): whether the spread of a plain online regression is stationary and its ratio stays near the fixed one.

    ratios has (pair, beta), where the ratio starts, with alpha 0 and P = I; noise delta goes to both states, and nothing is clipped. The spread is what a bar leaves over after its own
    update. Reasons: short (under 100 bars), unstable (p of max_p and above), divergence.
    """

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        start = float(pdf["beta"].iat[0])
        (b, a), (p00, p01, p11), spread = (start, 0.0), (1.0, 0.0, 1.0), []
        for y, x in zip(pdf["y"], pdf["x"]):
            if not (np.isfinite(y) and np.isfinite(x)):
                continue
            p00, p11 = p00 + delta, p11 + delta
            h0, h1 = p00 * x + p01, p01 * x + p11
            s = x * h0 + h1 + r
            error = y - b * x - a
            b, a = b + h0 / s * error, a + h1 / s * error
            p00, p01, p11 = p00 - h0 * h0 / s, p01 - h0 * h1 / s, p11 - h1 * h1 / s
            spread.append(y - b * x - a)
        e = np.array(spread)
        if len(pdf) < 100 or len(e) < 50:
            rows = (len(e), float("nan"), float("inf"), float("inf"), 1.0, False, "short")
        else:
            far = abs(b - start) / (abs(start) if abs(start) > 1e-6 else 1.0)
            before, step = e[:-1], np.diff(e)
            v = np.var(before)
            slope = np.mean((step - step.mean()) * (before - before.mean())) / v if v > 1e-18 else 0.0
            t = best_lags(e, lags, constant=True)[1]
            p = p_value(t, 1) if t == t else 1.0
            reason = "unstable" if p >= max_p else "divergence" if far >= max_divergence else None
            rows = (len(e), b, far, float(-np.log(2) / slope) if slope < -1e-10 else float("inf"), p, reason is None, reason)
        return pd.DataFrame([(pdf["pair"].iat[0], *rows)], columns=["pair", "n", "kalman_beta", "divergence", "half_life", "p_value", "valid", "reason"])

    d = pair_bars.select("pair", "ts", "y", "x").join(ratios.select("pair", "beta"), "pair")
    return d.groupBy("pair").applyInPandas(go, "pair string, n long, kalman_beta double, divergence double, half_life double, p_value double, valid boolean, reason string")


def stream(bars: DataFrame, params: Params) -> DataFrame:
    """The same signals of a stream of (pair, ts, y, x): each pair's state is kept between batches; bars come in order of time."""

    def go(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        f = Filter(params, state.get if state.exists else None)
        out = _walk(f, key[0], pd.concat(list(batches)))
        state.update(f.state())
        yield out

    return bars.groupBy("pair").applyInPandasWithState(go, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
