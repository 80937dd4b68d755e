"""Parameters that follow results: by regime, by cluster, by trailing trades, and from window to window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators.entries import clip
from tickloom.operators.ledger import folds_in_a_row, trade_folds

#: Entry threshold added, size factor and open positions by regime.
REGIMES = (("GREEN", 0.0, 1.0, 8), ("YELLOW", 0.3, 0.6, 5), ("RED", 1.0, 0.0, 2))


def regime_parameters(states: DataFrame, base_z: float) -> DataFrame:
    """states (ts, state) with entry_z, size and max_positions of each bar."""
    rows = states.sparkSession.createDataFrame(REGIMES, "state string, add double, size double, max_positions int")
    return states.join(F.broadcast(rows), "state", "left").select("ts", "state", (base_z + F.coalesce("add", F.lit(0.0))).alias("entry_z"), F.coalesce("size", F.lit(1.0)).alias("size"), F.col("max_positions").cast("long").alias("max_positions"))


def filter_noise(vol_rank: Column, base_delta: float, base_r: float) -> tuple[Column, Column]:
    """(delta, r) of the online regression: in rough markets it follows less and trusts bars less."""
    wild = F.coalesce(vol_rank, F.lit(0.5))
    return base_delta * clip(2 - 2 * wild, 0.3, 3.0), base_r * clip(0.5 + 2 * wild, 0.5, 3.0)


def time_stops(half_lives: DataFrame, times: float, default: int) -> DataFrame:
    """(pair, time_stop): whole bars of some half-lives; the default where there is none."""
    hl = F.col("half_life")
    return half_lives.select("pair", F.when(hl.isNotNull() & (hl < float("inf")), (hl * times).cast("long")).otherwise(default).alias("time_stop"))


def cluster_penalty(candidates: DataFrame, exposure: DataFrame, step: float = 0.1, least: float = 0.3) -> DataFrame:
    """candidates (pair, cluster_y, cluster_x) with penalty: less for each open leg in the fuller of their clusters. exposure has (cluster, legs)."""
    d = candidates
    for leg in ("y", "x"):
        d = d.join(exposure.select(F.col("cluster").alias(f"cluster_{leg}"), F.col("legs").alias(f"n_{leg}")), f"cluster_{leg}", "left")
    most = F.greatest(F.coalesce("n_y", F.lit(0)), F.coalesce("n_x", F.lit(0)))
    return d.withColumn("penalty", F.greatest(F.lit(least), 1 - step * most)).drop("n_y", "n_x")


def labelled(profiles: DataFrame) -> DataFrame:
    """profiles (cluster, beta, vol, alpha) with a label, the first that fits."""
    label = F.when(F.col("vol") > 1.5 * F.avg("vol").over(Window.partitionBy()), "wild").when(F.col("beta") > 1.2, "aggressive").when(F.col("beta") < 0.8, "defensive").when(F.col("alpha") > 0, "leader").otherwise("core")
    return profiles.withColumn("label", label)


def recommended(stats: DataFrame, entry_z: float, size: float) -> DataFrame:
    """stats (keys, n, win_rate, profit_factor, max_dd) with mode, entry_z and size: one step towards or away from risk, within bounds; nothing under 20 trades."""
    off = (F.col("profit_factor") < 1) | (F.col("max_dd") > 0.1)
    on = (F.col("profit_factor") > 1.5) & (F.col("win_rate") > 0.5)
    mode = F.when(F.col("n") < 20, "keep").when(off, "off").when(on, "on").otherwise("keep")
    move = F.when(F.col("mode") == "off", 1).when(F.col("mode") == "on", -1).otherwise(0)
    return stats.withColumn("mode", mode).withColumns({"entry_z": clip(entry_z + 0.1 * move, 1.5, 3.0), "size": clip(size - 0.1 * move, 0.2, 1.0)})


def stepped(windows: DataFrame, start: float, step: float, least: float, most: float) -> DataFrame:
    """windows (window_id, pnl) with threshold: falls a step after a loss and rises half a step after a gain, within bounds, each from the last.

    An ordered fold over one number for each window.
    """
    rows = windows.agg(F.sort_array(F.collect_list(F.struct("window_id", "pnl"))).alias("rows"))
    nxt = f"greatest({least}D, least({most}D, acc[size(acc) - 1].t + case when w.pnl < 0 then -{step}D when w.pnl > 0 then {step / 2}D else 0D end))"
    first = f"array(named_struct('w', cast(null as bigint), 't', {start}D))"
    fold = F.expr(f"aggregate(rows, {first}, (acc, w) -> concat(acc, array(named_struct('w', w.window_id, 't', {nxt}))))")
    return rows.select(F.explode(fold).alias("r")).where("r.w is not null").select(F.col("r.w").alias("window_id"), F.col("r.t").alias("threshold"))


def trailing_parameters(trades: DataFrame, entry_z: float, size: float, period_days: int, trailing_days: int, least: int = 20, tasks: int | None = None) -> DataFrame:
    """(period_end, n, mode, entry_z, size) at each end of a period since 1970 that has `least` trades or more in its last trailing_days.

    trades has (pair, trade_seq, exit_ts, net); a trade counts for the ends that come within trailing_days after its exit, its own moment included. Trades fold into the hours
    that end with them or after them, once, dealt over so many tasks, if named, and an end sees its hours alone, however many trades those have.
    """
    at = F.datediff(F.col("exit_ts"), F.lit("1970-01-01")).cast("long") * 24 + F.hour("exit_ts") + F.when((F.minute("exit_ts") > 0) | (F.expr("extract(second from exit_ts)") > 0), 1).otherwise(0)
    d = trades.select(at.alias("__at"), F.struct("exit_ts", "pair", "trade_seq").alias("trade_seq"), "net")
    hours = trade_folds(d.repartition(tasks, "__at") if tasks else d, ["__at"])
    first, last = F.ceil(F.col("__at") / (24 * period_days)), F.floor((F.col("__at") + 24 * trailing_days - 1) / (24 * period_days))
    ends = hours.where(first <= last).withColumn("__k", F.explode(F.sequence(first, last)))
    s = folds_in_a_row(ends, ["__k"], "__at").where(F.col("n") >= least)
    end = F.date_add(F.lit("1970-01-01").cast("date"), (F.col("__k") * period_days).cast("int")).cast("timestamp_ntz")
    return recommended(s, entry_z, size).select(end.alias("period_end"), "n", "mode", "entry_z", "size")
