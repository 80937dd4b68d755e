"""A market's state by a machine: a spike turns it red at once, other changes come at intervals, one step at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

ORDER = ("GREEN", "YELLOW", "RED")


def _target(rank: float, calm: float, wild: float) -> int:
    return 2 if rank > wild else 1 if rank > calm else 0


def walk(px: np.ndarray, n: int, every: int, rest: int, calm: float = 0.6, wild: float = 0.85, spike: float = 3.0) -> list[str]:
    """The state at each bar. Volatility is that of the last n returns, ranked among what was seen so far."""
    state, since, seen, out = 0, rest, [], []
    rets = np.r_[np.nan, np.diff(np.log(px))]
    for i in range(len(px)):
        since += 1
        part = rets[max(1, i - n + 1) : i + 1]
        if len(part) >= n:
            vol = float(np.std(part, ddof=1))
            if len(seen) >= n:
                z = (vol - np.mean(seen)) / (np.std(seen) or 1e-12)
                if z > spike and state != 2:
                    state, since = 2, 0
                elif i % every == 0 and since >= rest:
                    to = _target(float(np.mean(np.array(seen) < vol)), calm, wild)
                    if to != state:
                        state, since = state + (1 if to > state else -1), 0
            seen.append(vol)
        out.append(ORDER[state])
    return out


def states(bars: DataFrame, n: int, every: int, rest: int) -> DataFrame:
    """(symbol, ts, state) of (symbol, ts, px), a task for each symbol: for benchmarks."""

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        return pd.DataFrame({"symbol": pdf["symbol"], "ts": pdf["ts"], "state": walk(pdf["px"].to_numpy(float), n, every, rest)})

    return bars.select("symbol", "ts", "px").groupBy("symbol").applyInPandas(go, "symbol string, ts timestamp_ntz, state string")
