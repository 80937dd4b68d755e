"""Trades and returns: summaries, rules on running figures, and portfolio metrics.

A ledger has (window_id, pair, trade_seq, entry_ts, exit_ts, hold_bars, exit_reason, gross, fees, slippage, net); exit_reason
is 1 signal, 2 time, 3 stop, 4 forced.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def so_far() -> Window:
    """A pair's trades up to this one."""
    return Window.partitionBy("pair").orderBy("trade_seq").rowsBetween(Window.unboundedPreceding, 0)


def count_if(c: Column) -> Column:
    return F.sum(c.cast("long"))


def ledger_stats(t: DataFrame, keys: Sequence[str] = ("pair",), total: bool = True) -> DataFrame:
    """Trades, win rate, mean win and loss (positive), expectancy, sums, cost share and exit counts; with total, a row of all (null keys)."""
    grouped = t.rollup(*keys) if total else t.groupBy(*keys)
    win = F.col("net") > 0
    out = grouped.agg(
        F.count("*").alias("trades"), F.avg(win.cast("int")).alias("win_rate"), F.coalesce(F.avg(F.when(win, F.col("net"))), F.lit(0.0)).alias("avg_win"), F.coalesce(-F.avg(F.when(F.col("net") < 0, F.col("net"))), F.lit(0.0)).alias("avg_loss"),
        F.avg("net").alias("expectancy"), *(F.sum(c).alias(c) for c in ("gross", "fees", "slippage", "net")), *(count_if(F.col("exit_reason") == k).alias(f"exits_{n}") for k, n in ((1, "signal"), (2, "time"), (3, "stop"), (4, "forced"))),
    )
    return out.withColumn("cost_to_gross", F.when(F.abs("gross") > 1e-12, (F.col("fees") + F.col("slippage")) / F.abs("gross")))


def attribution_flags(t: DataFrame) -> DataFrame:
    """One row: totals, the residual of net against its parts, and flags; concentrated: two pairs make over half of all losses."""
    pairs = t.groupBy("pair").agg(F.sum("net").alias("net"))
    losers = pairs.where("net < 0").orderBy("net", "pair").limit(2).agg(F.coalesce(F.sum("net"), F.lit(0.0)).alias("top2"))
    lost = pairs.agg(F.coalesce(F.sum(F.when(F.col("net") < 0, F.col("net"))), F.lit(0.0)).alias("lost"))
    sums = t.agg(F.sum("gross").alias("gross"), F.sum("fees").alias("fees"), F.sum("slippage").alias("slippage"), F.sum("net").alias("net"))
    one = sums.join(F.broadcast(losers)).join(F.broadcast(lost))  # single rows
    return one.select("gross", "net", (F.abs(F.col("gross") - F.col("fees") - F.col("slippage") - F.col("net")) < 1e-6).alias("consistent"), (F.col("gross") < 0).alias("no_edge"), ((F.col("gross") > 0) & (F.col("net") < 0)).alias("eaten_by_cost"), (F.col("top2") < 0.5 * F.col("lost")).alias("concentrated"))


def trade_stats(t: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, median, deviation, ratio, additive drawdown, profit factor (99 without losses) and nearest-rank 90th percentile of net."""
    w = Window.partitionBy(*keys).orderBy("trade_seq").rowsBetween(Window.unboundedPreceding, 0)
    run = t.withColumn("cum", F.sum("net").over(w)).withColumn("dd", F.greatest(F.max("cum").over(w), F.lit(0.0)) - F.col("cum"))
    order = Window.partitionBy(*keys).orderBy("net", "trade_seq")
    run = run.withColumns({"__k": F.row_number().over(order), "__n": F.count("*").over(Window.partitionBy(*keys))})
    won, lost = F.sum(F.when(F.col("net") > 0, F.col("net"))), -F.sum(F.when(F.col("net") < 0, F.col("net")))
    out = run.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg((F.col("net") > 0).cast("int")).alias("win_rate"), F.sum("net").alias("total"), F.avg("net").alias("mean"), F.median("net").alias("median"), F.stddev_samp("net").alias("std"),
        F.max("dd").alias("max_dd"), F.when(F.coalesce(lost, F.lit(0.0)) > 0, F.coalesce(won, F.lit(0.0)) / lost).otherwise(99.0).alias("profit_factor"), F.max(F.when(F.col("__k") == F.bround(0.9 * (F.col("__n") - 1)) + 1, F.col("net"))).alias("p90"),
    )
    return out.withColumn("sharpe", F.when(F.col("std") > 1e-12, F.col("mean") / F.col("std")))


def trade_folds(t: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, known, wins, won, lost, total, top, low, fall) of trades in order of trade_seq: counts and sums of net, the highest and the lowest of its running sum, and the deepest fall
    of that from a top of the same group. Folds of groups that follow each other give the figures of all: see `folds_in_a_row`.
    """
    w = Window.partitionBy(*keys).orderBy("trade_seq").rowsBetween(Window.unboundedPreceding, 0)
    run = t.withColumn("cum", F.sum("net").over(w)).withColumn("top", F.max("cum").over(w))
    return run.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count("net").alias("known"), F.sum((F.col("net") > 0).cast("long")).alias("wins"), F.sum(F.when(F.col("net") > 0, F.col("net"))).alias("won"), F.sum(F.when(F.col("net") < 0, -F.col("net"))).alias("lost"),
        F.sum("net").alias("total"), F.max("cum").alias("top"), F.min("cum").alias("low"), F.max(F.col("top") - F.col("cum")).alias("fall"),
    )


def folds_in_a_row(folds: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """(keys, n, win_rate, max_dd, profit_factor) as in `trade_stats`, of folds of trades (see `trade_folds`) that follow each other by `order`."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    d = folds.withColumn("__sum", F.coalesce(F.sum("total").over(before), F.lit(0.0)))
    d = d.withColumn("__top", F.greatest(F.max(F.col("__sum") + F.col("top")).over(before), F.lit(0.0)))
    won, lost = F.coalesce(F.sum("won"), F.lit(0.0)), F.coalesce(F.sum("lost"), F.lit(0.0))
    return d.groupBy(*keys).agg(
        F.sum("n").alias("n"), (F.sum("wins") / F.sum("known")).alias("win_rate"), F.max(F.greatest("fall", F.col("__top") - F.col("__sum") - F.col("low"))).alias("max_dd"), F.when(lost > 0, won / lost).otherwise(99.0).alias("profit_factor"),
    )


def portfolio_metrics(returns: DataFrame, benchmark: DataFrame, per_year: int, keys: Sequence[str] = ("series",)) -> DataFrame:
    """Return (from the first bar's equity on), drawdown, longest time under water (bars), Calmar, Sharpe, correlation to the benchmark.

    returns has (keys, ts, ret); benchmark (ts, bench). The correlation is 0 with under three common bars.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("ts")
    all_ = w.rowsBetween(Window.unboundedPreceding, 0)
    d = returns.withColumn("equity", F.exp(F.sum(F.log1p(F.coalesce("ret", F.lit(0.0)))).over(all_)))
    d = d.withColumn("dd", 1 - F.col("equity") / F.max("equity").over(all_))
    d = d.withColumns({"under": F.col("dd") > 1e-12, "peaks": F.sum((F.col("dd") <= 1e-12).cast("long")).over(all_)})
    runs = d.where("under").groupBy(*keys, "peaks").agg(F.count("*").alias("len")).groupBy(*keys).agg(F.max("len").alias("longest_dd"))
    corr = d.join(benchmark, "ts").groupBy(*keys).agg(F.when(F.count("*") >= 3, F.corr("ret", "bench")).otherwise(0.0).alias("corr"))
    m = d.groupBy(*keys).agg(F.count("*").alias("n"), (F.max_by("equity", "ts") / F.min_by("equity", "ts") - 1).alias("total_return"), F.max("dd").alias("max_dd"), (F.avg("ret") / F.stddev_samp("ret") * per_year**0.5).alias("sharpe"))
    m = m.join(runs, keys, "left").join(corr, keys, "left")
    return m.withColumn("longest_dd", F.coalesce("longest_dd", F.lit(0).cast("long"))).withColumn("calmar", F.when(F.col("max_dd") > 1e-12, (F.pow(1 + F.col("total_return"), per_year / F.col("n")) - 1) / F.col("max_dd")))


def leg_blacklist(t: DataFrame, min_trades: int = 5, min_windows: int = 2, worst_avg: float = -0.003, worst_stops: float = 0.45) -> DataFrame:
    """(symbol, window_id, cum_pnl, cum_trades, cum_stops, windows, blacklisted): half of a pair's figures to each leg, window by window; once listed, for good."""
    legs = t.withColumn("symbol", F.explode(F.split("pair", "-", 2))).groupBy("symbol", "window_id").agg((F.sum("net") / 2).alias("pnl"), (F.count("*") / 2).alias("n"), (count_if(F.col("exit_reason") == 3) / 2).alias("stops"))
    w = Window.partitionBy("symbol").orderBy("window_id").rowsBetween(Window.unboundedPreceding, 0)
    cum = legs.where(F.col("n") >= min_trades).withColumns({"cum_pnl": F.sum("pnl").over(w), "cum_trades": F.sum("n").over(w), "cum_stops": F.sum("stops").over(w), "windows": F.count("*").over(w)})
    now = (F.col("windows") >= min_windows) & ((F.col("cum_pnl") / F.col("windows") < worst_avg) | (F.col("cum_stops") / F.col("cum_trades") > worst_stops))
    return cum.withColumn("blacklisted", F.max(now).over(w)).select("symbol", "window_id", "cum_pnl", "cum_trades", "cum_stops", "windows", "blacklisted")


def retired(t: DataFrame, min_trades: int = 6, max_stops: float = 0.5, min_mean: float = 0.0, min_wins: float = 0.25) -> DataFrame:
    """(pair, retired_at, reason): the first trade after which a rule fails, in the order stops, expectancy, wins."""
    n = F.row_number().over(Window.partitionBy("pair").orderBy("trade_seq"))
    d = t.withColumns({"k": n, "s": F.avg((F.col("exit_reason") == 3).cast("int")).over(so_far()), "m": F.avg("net").over(so_far()), "p": F.avg((F.col("net") > 0).cast("int")).over(so_far())})
    reason = F.when(F.col("s") > max_stops, "stops").when(F.col("m") < min_mean, "expectancy").when(F.col("p") < min_wins, "wins")
    return d.where(F.col("k") >= min_trades).withColumn("reason", reason).where("reason is not null").groupBy("pair").agg(F.min("trade_seq").alias("retired_at"), F.min_by("reason", "trade_seq").alias("reason"))


def kill_switch(t: DataFrame, min_trades: int = 6, streak: int = 3, min_wins: float = 0.35, min_mean: float = -0.005, min_sum: float = -0.02) -> DataFrame:
    """(pair, disabled_at, reason): the first trade after which a rule holds; only a win ends a streak of stops."""
    w = Window.partitionBy("pair").orderBy("trade_seq")
    d = t.withColumns({"k": F.row_number().over(w), "wins": F.sum((F.col("net") > 0).cast("int")).over(so_far()), "m": F.avg("net").over(so_far()), "c": F.sum("net").over(so_far())})
    since = Window.partitionBy("pair", "wins").orderBy("trade_seq").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("stops", F.sum(((F.col("exit_reason") == 3) & (F.col("net") <= 0)).cast("int")).over(since))
    reason = F.when(F.col("stops") >= streak, "stop_streak").when(F.col("wins") / F.col("k") < min_wins, "win_rate").when(F.col("m") < min_mean, "mean").when(F.col("c") < min_sum, "sum")
    return d.where(F.col("k") >= min_trades).withColumn("reason", reason).where("reason is not null").groupBy("pair").agg(F.min("trade_seq").alias("disabled_at"), F.min_by("reason", "trade_seq").alias("reason"))


def circuit_breaker(t: DataFrame, keys: Sequence[str], max_loss: float = -0.005, max_stops: float = 0.5, min_trades: int = 5, streak: int = 5) -> DataFrame:
    """t with tripped (for good, once a running figure of the group of keys is beyond a limit), size and z_add; in order of trade_seq."""
    w = Window.partitionBy(*keys).orderBy("trade_seq")
    all_ = w.rowsBetween(Window.unboundedPreceding, 0)
    d = t.withColumns({"k": F.row_number().over(w), "c": F.sum("net").over(all_), "s": F.avg((F.col("exit_reason") == 3).cast("int")).over(all_), "wins": F.sum((F.col("net") > 0).cast("int")).over(all_)})
    since = Window.partitionBy(*keys, "wins").orderBy("trade_seq").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("losses", F.sum((F.col("net") <= 0).cast("int")).over(since))
    now = (F.col("c") < max_loss) | ((F.col("k") >= min_trades) & (F.col("s") > max_stops)) | (F.col("losses") >= streak)
    d = d.withColumn("tripped", F.max(now).over(all_))
    return d.select(*t.columns, "tripped", F.when(F.col("tripped"), 0.5).otherwise(1.0).alias("size"), F.when(F.col("tripped"), 0.5).otherwise(0.0).alias("z_add"))


def running_ledger(t: DataFrame) -> DataFrame:
    """(pair, window_id, sums and counts of all windows before)."""
    w = Window.partitionBy("pair").orderBy("window_id").rowsBetween(Window.unboundedPreceding, -1)
    s = t.groupBy("pair", "window_id").agg(*(F.sum(c).alias(c) for c in ("gross", "fees", "slippage")), F.count("*").alias("trades"), count_if(F.col("exit_reason") == 3).alias("stops"))
    return s.select("pair", "window_id", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in ("gross", "fees", "slippage", "trades", "stops")))


def fold_trades(signals: DataFrame, keys: Sequence[str], fee: float, slip: float, max_hold: int, stop: float, caps: dict[str, int] | None = None) -> DataFrame:
    """Signals (keys, pair, ts, coin_y, coin_x, y, x (logarithms), beta, z, entry_mask, exit_mask) to trades that don't overlap.

    A trade opens at an entry with all figures present, against the sign of z, weighed 1 / (1 + |beta|); it closes at an exit, after
    max_hold bars, at a loss beyond stop, or at the last bar: reason 3 stop, 2 time, 4 forced or 1 signal, in this order. caps may
    limit `portfolio`, `leg` and `trades` (of a pair): then all pairs of a group of keys are walked together, by time and pair.
    A task sees one group. Costs are two fees and two slippages for each leg's weight.
    """
    cols = [*keys, "pair", "ts", "coin_y", "coin_x", "y", "x", "beta", "z", "entry_mask", "exit_mask"]
    kinds = dict(signals.dtypes)
    caps = caps or {}
    group = list(keys) if set(caps) & {"portfolio", "leg"} else [*keys, "pair"]

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "pair"])
        last = pdf.groupby("pair")["ts"].transform("max") == pdf["ts"]
        out, open_, legs, count = [], {}, {}, {}
        for row, is_last in zip(pdf.itertuples(index=False), last):
            t = open_.get(row.pair)
            if t:
                t["hold"] += 1
                gross = t["w"] * t["dir"] * ((row.y - t["y"]) - t["beta"] * (row.x - t["x"]))
                t["mae"], t["mfe"] = min(t["mae"], gross), max(t["mfe"], gross)
                reason = 3 if gross <= -stop else 2 if t["hold"] >= max_hold else 4 if is_last else 1 if row.exit_mask else 0
                if reason:
                    cost = 2 * t["w"] * (1 + abs(t["beta"]))
                    fees, slips = cost * fee, cost * slip
                    out.append((*(getattr(row, k) for k in keys), row.pair, count[row.pair], t["ts"], row.ts, t["dir"], t["hold"], reason, gross, fees, slips, gross - fees - slips, t["mae"], t["mfe"]))
                    del open_[row.pair]
                    for leg in (row.coin_y, row.coin_x):
                        legs[leg] -= 1
                continue
            fine = row.entry_mask and not is_last and all(v == v and v is not None for v in (row.y, row.x, row.beta, row.z))
            if fine and len(open_) < caps.get("portfolio", 1 << 60) and count.get(row.pair, 0) < caps.get("trades", 1 << 60) and max(legs.get(row.coin_y, 0), legs.get(row.coin_x, 0)) < caps.get("leg", 1 << 60):
                count[row.pair] = count.get(row.pair, 0) + 1
                for leg in (row.coin_y, row.coin_x):
                    legs[leg] = legs.get(leg, 0) + 1
                open_[row.pair] = {"ts": row.ts, "y": row.y, "x": row.x, "beta": row.beta, "dir": -1 if row.z > 0 else 1, "w": 1 / (1 + abs(row.beta)), "hold": 0, "mae": 0.0, "mfe": 0.0}
        names = [*keys, "pair", "trade_seq", "entry_ts", "exit_ts", "dir", "hold_bars", "exit_reason", "gross", "fees", "slippage", "net", "mae", "mfe"]
        return pd.DataFrame(out, columns=names)

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"pair string, trade_seq long, entry_ts {kinds['ts']}, exit_ts {kinds['ts']}, dir long, hold_bars long, exit_reason long, gross double, fees double, slippage double, net double, mae double, mfe double"])
    return signals.select(*cols).groupBy(*(group or [F.lit(0)])).applyInPandas(walk, schema)


def in_trade(bars: DataFrame, trades: DataFrame) -> DataFrame:
    """bars (pair, ts) with in_trade: after a trade's entry and not after its exit. Trades of a pair don't overlap."""
    from tickloom.operators.asof import asof

    last = asof(bars, trades.select("pair", F.col("entry_ts").alias("ts"), "exit_ts"), ["pair"], ["exit_ts"], strict=True)
    return last.withColumn("in_trade", F.coalesce(F.col("ts") <= F.col("exit_ts"), F.lit(False))).drop("exit_ts")
