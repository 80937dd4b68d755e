"""Trades as intervals: where each entry would end, and which entries are taken, without walking bars.

An entry's exit depends on the bars after it alone, so all entries get theirs side by side, from a frame of bounded length. Trades of a pair don't
overlap: the first entry is taken, then always the first entry after the last exit. That chain is found in two levels. A block of consecutive entries folds into where
each of them leads outside the block; these steps are followed by pointer doubling: they are joined with themselves, and every round doubles their
length. Then a block knows at which entry it is reached, and folds once more into the entries that are taken. Pairs of one block need no round at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.sources.runs import saved

#: Entries in a block, and doublings in one job.
BLOCK, AT_ONCE = 128, 3


def finite(*names: str) -> Column:
    """Whether all the columns hold numbers."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull() & ~F.isnan(n)
    return out


def would_be(signals: DataFrame, keys: Sequence[str], max_hold: int, stop: float) -> DataFrame:
    """(keys, pair, i, entry_ts, exit_ts, dir, hold_bars, exit_reason, weight, beta, gross, mae, mfe, next): each entry as if it were taken.

    signals has (keys, pair, ts, y, x (logarithms), beta, z, entry_mask, exit_mask), one row for each bar of a pair. A trade opens at an entry with all
    figures present that isn't the last bar, against the sign of z, weighed 1 / (1 + |beta|); it closes at a loss beyond stop (reason 3), after max_hold bars (2), at the
    last bar (4) or at an exit (1): the first bar of any, and reasons in this order. i numbers the entries of a pair from 0, next is the one that would follow. One shuffle.
    """
    by = Window.partitionBy(*keys, "pair").orderBy("ts")
    fine = F.coalesce(F.col("entry_mask"), F.lit(False)) & finite("y", "x", "beta", "z")
    d = signals.withColumn("last", F.lead("ts").over(by).isNull())
    d = d.withColumn("open", fine & ~F.col("last"))
    opens = F.count_if("open")
    so_far = opens.over(by.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumns({"i": so_far - 1, "after": F.when(so_far < opens.over(Window.partitionBy(*keys, "pair")), so_far)})
    bar = F.struct("ts", "y", "x", "last", F.coalesce("exit_mask", F.lit(False)).alias("leave"), "after")
    d = d.withColumn("path", F.collect_list(bar).over(by.rowsBetween(1, max_hold))).where("open")
    weight, side = 1 / (1 + F.abs("beta")), F.when(F.col("z") > 0, -1).otherwise(1)

    def step(b: Column, k: Column) -> Column:
        gross = weight * side * ((b["y"] - F.col("y")) - F.col("beta") * (b["x"] - F.col("x")))
        loss = gross.isNotNull() & ~F.isnan(gross) & (gross <= -stop)
        reason = F.when(loss, 3).when(k + 1 >= max_hold, 2).when(b["last"], 4).when(b["leave"], 1)
        return F.struct((k + 1).alias("hold"), b["ts"].alias("ts"), gross.alias("gross"), reason.alias("reason"), b["after"].alias("after"))

    d = d.withColumn("path", F.transform("path", step))
    d = d.withColumn("end", F.filter("path", lambda s: s["reason"].isNotNull())[0])
    held = F.transform(F.slice("path", F.lit(1), F.col("end.hold")), lambda s: s["gross"])
    return d.select(
        *keys, "pair", "i", F.col("ts").alias("entry_ts"), F.col("end.ts").alias("exit_ts"), side.cast("long").alias("dir"), F.col("end.hold").cast("long").alias("hold_bars"), F.col("end.reason").cast("long").alias("exit_reason"),
        weight.alias("weight"), "beta", F.col("end.gross").alias("gross"), F.least(F.lit(0.0), F.array_min(held)).alias("mae"), F.greatest(F.lit(0.0), F.array_max(held)).alias("mfe"), F.col("end.after").alias("next"),
    )


def chained(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, i) of the entries that are taken: the first of each key, and whatever its pointers (next) lead to. Entries of a key are numbered from 0 without gaps."""
    keys = list(keys)
    steps = F.array_sort(F.collect_list(F.struct("i", "next")))  # a block's, so of bounded length
    blocks = saved(entries.groupBy(*keys, F.floor(F.col("i") / BLOCK).alias("block")).agg(steps.alias("steps")))

    def outward(out: Column, s: Column) -> Column:
        """From the last entry on: out holds where the entries after s lead."""
        at = F.get(out, (s["next"] - s["i"] - 1).cast("int"))
        return F.concat(F.array(F.when(s["next"] - s["i"] <= F.size(out), at).otherwise(s["next"])), out)

    outs = F.aggregate(F.reverse("steps"), F.array().cast("array<bigint>"), outward)
    jump = blocks.select(*keys, F.posexplode(outs).alias("at", "next"), (F.col("block") * BLOCK).alias("base")).where("next is not null").select(*keys, (F.col("base") + F.col("at")).alias("i"), "next")
    reached = blocks.where("block = 0").select(*keys, F.lit(0).cast("long").alias("i"))
    if not jump.isEmpty():
        jump, reached = saved(jump), saved(reached)
    while not jump.isEmpty():
        for _ in range(AT_ONCE):
            reached = reached.unionByName(reached.join(jump, [*keys, "i"]).select(*keys, F.col("next").alias("i")))
            jump = jump.join(jump.select(*keys, F.col("i").alias("next"), F.col("next").alias("then")), [*keys, "next"]).select(*keys, "i", F.col("then").alias("next"))
        reached, jump = saved(reached), saved(jump)
    path = F.struct(F.col("i").alias("want"), F.array().cast("array<bigint>").alias("taken"))
    follow = lambda a, s: F.when(s["i"] == a["want"], F.struct(s["next"].alias("want"), F.concat(a["taken"], F.array(s["i"])).alias("taken"))).otherwise(a)
    d = blocks.join(reached.withColumn("block", F.floor(F.col("i") / BLOCK)), [*keys, "block"])
    return d.select(*keys, F.explode(F.aggregate("steps", path, follow, lambda a: a["taken"])).alias("i"))


def interval_trades(signals: DataFrame, keys: Sequence[str], fee: float, slip: float, max_hold: int, stop: float, most: int | None = None) -> DataFrame:
    """Trades (keys, pair, trade_seq, entry_ts, exit_ts, dir, hold_bars, exit_reason, gross, fees, slippage, net, mae, mfe) that don't overlap.

    At most `most` of a pair in a group of keys. Costs are two fees and two slippages for each leg's weight. Signals as in `would_be`; none give none.
    """
    by = [*keys, "pair"]
    entries = saved(would_be(signals, keys, max_hold, stop))
    t = entries.join(chained(entries, by), [*by, "i"]).withColumn("trade_seq", F.row_number().over(Window.partitionBy(*by).orderBy("i")).cast("long"))
    t = t if most is None else t.where(F.col("trade_seq") <= most)
    cost = 2 * F.col("weight") * (1 + F.abs("beta"))
    t = t.withColumns({"fees": cost * fee, "slippage": cost * slip}).withColumn("net", F.col("gross") - F.col("fees") - F.col("slippage"))
    return t.select(*by, "trade_seq", "entry_ts", "exit_ts", "dir", "hold_bars", "exit_reason", "gross", "fees", "slippage", "net", "mae", "mfe")
