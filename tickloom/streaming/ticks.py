"""Streams of ticks and candles: bars, late rows, islands, and decisions. ts must be TIMESTAMP: watermarks don't take TIMESTAMP_NTZ."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Generator, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.operators.adapting import trailing_parameters
from tickloom.sources.runs import has_files, new_folder, saved, tasks_for
from tickloom.sources.tables import upsert_by_month


def live_bars(ticks: DataFrame, width: str, late: str, slide: str | None = None) -> DataFrame:
    """(symbol, start, open, high, low, close, n) of ticks (symbol, ts, value), tumbling or, with slide, overlapping."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = ticks.withWatermark("ts", late).groupBy("symbol", w.alias("w")).agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").alias("n"))
    return out.select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "n")


def islands(ticks: DataFrame, gap: str, late: str) -> DataFrame:
    """(symbol, first, last, n): runs of ticks without a gap."""
    out = ticks.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("symbol", F.col("w.start").alias("first"), F.col("w.end").alias("last"), "n")


def once(rows: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Rows whose key was not seen within the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def decisions(signals: DataFrame, positions: DataFrame, entry: float, leave: float, stop: float) -> DataFrame:
    """(pair, ts, z, action): stop, exit, enter or hold, by z and by what is open. positions (pair) is a table; no order is placed."""
    d = signals.join(positions.select("pair", F.lit(True).alias("open")), "pair", "left")
    a, is_open = F.abs("z"), F.coalesce("open", F.lit(False))
    action = F.when(is_open & (a > stop), "stop").when(is_open & (a < leave), "exit").when(~is_open & (a > entry) & (a <= stop), "enter").otherwise("hold")
    return d.select("pair", "ts", "z", action.alias("action"))


def each_batch(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a stream that hands each batch to apply; what was done survives a restart by the checkpoint."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def delivered(parts: Iterable[DataFrame], path: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Puts parts of equal columns into {path}/in one after the other, each in as many files as it has tasks. What start makes of the stream of these files takes each part as one batch, and
    goes on from its checkpoint when the next has come."""
    for part in parts:
        part.write.mode("append").parquet(f"{path}/in")
        start(part.sparkSession.readStream.schema(part.schema).parquet(f"{path}/in")).awaitTermination()


@dataclasses.dataclass(frozen=True)
class Rules:
    """|z| above which a position opens, below which it closes, above which it is stopped and none opens; hours after which it closes."""

    entry: float = 1.5
    leave: float = 0.5
    stop: float = 3.0
    hours: int = 48


ACTIONS = "pair string, ts timestamp, z double, action string"
#: A time that is null.
NEVER = np.iinfo(np.int64).min


#: What a tick may do, by number, and rows handed on at once.
DOES, CHUNK = np.array(["hold", "enter", "exit", "stop"], object), 20_000


def _act(rules: Rules, ts: np.ndarray, z: np.ndarray, since: int | None) -> tuple[np.ndarray, np.ndarray, int | None]:
    """(what each tick does, times at which positions ran out, when the position that is then open was opened) of a pair's ticks in order of time and z; times in nanoseconds.

    Where a position ends depends on the ticks after it alone, so all possible entries get their ends at once, and a loop follows those that are taken.
    """
    hold, size, n = rules.hours * 3_600_000_000_000, np.abs(z), len(ts)
    known = ts != NEVER
    closes = np.flatnonzero(known & ((size > rules.stop) | (size < rules.leave)))
    opens = np.flatnonzero(known & (size > rules.entry) & (size <= rules.stop))

    def first(at: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The first of the ticks `at` that isn't before i; n where there is none."""
        return np.append(at, n)[np.searchsorted(at, i)]

    closed, over = first(closes, opens + 1), np.maximum(np.searchsorted(ts, ts[opens] + hold), opens + 1)
    follows = np.searchsorted(opens, np.where(closed < over, closed + 1, over)).tolist()
    does, timed, taken, k = np.zeros(n, np.int8), [], [], 0
    if since is not None:
        close, end = int(first(closes, np.array(0))), int(np.searchsorted(ts, since + hold))
        if min(close, end) == n:
            return does, np.array([], np.int64), since
        if close < end:
            does[close] = 3 if size[close] > rules.stop else 2
        else:
            timed.append(since + hold)
        k = int(np.searchsorted(opens, close + 1 if close < end else end))
    while k < len(follows):
        taken.append(k)
        k = follows[k]
    at, closed, over = opens[taken], closed[taken], over[taken]
    does[at] = 1
    ends = closed[closed < over]
    does[ends] = np.where(size[ends] > rules.stop, 3, 2)
    timed = np.append(np.array(timed, np.int64), ts[at[(over <= closed) & (over < n)]] + hold)
    still = len(at) and min(closed[-1], over[-1]) == n
    return does, timed, int(ts[at[-1]]) if still else None


def _numbers(ticks: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return ticks["ts"].to_numpy("datetime64[ns]").view(np.int64), ticks["z"].to_numpy(float)


def _decide(rules: Rules, pair: str, batches: Iterable[pd.DataFrame], since: int | None, run_out: Callable[[int], bool]) -> Generator[pd.DataFrame, None, int | None]:
    """Rows of a pair's ticks, which are held as two numbers each, and when the position that is then open was opened; a position for which run_out holds doesn't stay open."""
    parts = [_numbers(b) for b in batches]
    ts, z = (np.concatenate(p) for p in zip(*parts))
    del parts
    later = ts[1:] > ts[:-1]
    if not later.all():
        order = np.lexsort((z, ts))
        ts, z = ts[order], z[order]
        del order
    does, timed, since = _act(rules, ts, z, since)
    if since is not None and run_out(since):
        timed, since = np.append(timed, since + rules.hours * 3_600_000_000_000), None
    for i in range(0, len(ts), CHUNK):
        yield _rows(pair, ts[i : i + CHUNK], z[i : i + CHUNK], DOES[does[i : i + CHUNK]])
    for i in range(0, len(timed), CHUNK):
        yield _rows(pair, timed[i : i + CHUNK], np.nan, "time")
    return since


def _rows(pair: str, ts: np.ndarray, z: np.ndarray | float, action: np.ndarray | str) -> pd.DataFrame:
    return pd.DataFrame({"pair": np.full(len(ts), pair, object), "ts": ts.view("datetime64[ns]"), "z": z, "action": action})


def live_decisions(signals: DataFrame, rules: Rules, late: str) -> DataFrame:
    """(pair, ts, z, action) of a stream of (pair, ts, z): enter, exit, stop, time or hold, each by the position that the pair's ticks before have left open.

    A pair's position is kept as state between batches; a timer closes it (time, without z) once the watermark passes its last hour, if no tick has. A null z holds.
    No order is placed. Ticks of a pair come in order of time, within a batch in any; a task holds those of one pair in one batch, some 50 bytes each, so batches bound it (see `in_order`).
    """
    hold = rules.hours * 3_600_000_000_000

    def go(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since = state.get[0] * 1000 if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield _rows(key[0], np.array([since + hold]), np.nan, "time")
            return
        since = yield from _decide(rules, key[0], batches, since, lambda at: (at + hold) / 1e6 <= state.getCurrentWatermarkMs())
        if since is None:
            if state.exists:
                state.remove()
        else:
            state.update((since // 1000,))
            state.setTimeoutTimestamp((since + hold) // 1_000_000)

    return signals.withWatermark("ts", late).groupBy("pair").applyInPandasWithState(go, ACTIONS, "since long", "append", GroupStateTimeout.EventTimeTimeout)


def decided(signals: DataFrame, rules: Rules, late: str) -> DataFrame:
    """What `live_decisions` makes of the same rows in the end, as one batch. A task sees a pair, whose ticks depend on those before."""
    mark = signals.agg((F.max("ts") - F.expr(f"interval {late}")).alias("mark"))
    d = signals.select("pair", "ts", "z").crossJoin(F.broadcast(mark))  # one row
    hold = pd.Timedelta(hours=rules.hours)

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(_decide(rules, pdf["pair"].iat[0], [pdf], None, lambda at: pd.Timestamp(at) + hold < pdf["mark"].iat[0]))

    return d.groupBy("pair").applyInPandas(go, ACTIONS)


def in_order(ticks: DataFrame, rows: int, pieces: int = 12) -> list[DataFrame]:
    """ticks (ts, ...) as parts of about `rows` rows, each later than the one before; equal times stay together. For batches of a size that doesn't grow with the table."""
    n = -(-ticks.count() // rows)
    if n <= 1:
        return [ticks]
    path = new_folder(ticks.sparkSession)
    part = F.floor(F.spark_partition_id() / pieces).cast("int")
    ticks.repartitionByRange(n * pieces, "ts").withColumn("part", part).write.partitionBy("part").parquet(path)
    return [ticks.sparkSession.read.schema(ticks.schema).parquet(f"{path}/part={k}") for k in range(n) if has_files(ticks.sparkSession, f"{path}/part={k}")]


def late_aside(path: str, keys: Sequence[str], days: int) -> Callable[[DataFrame, int], None]:
    """What a stream of rows (keys, ts, ...) does with each batch: on-time rows go to {path}/on_time, each key once; rows more than `days` behind the latest of the batches before
    go to {path}/late, merged by key and month.

    The latest time is a table with a version for each batch, so a batch that is done again meets the same mark, and does the same. On-time
    rows are compared with those of the last `days` alone, which earlier rows of the same key must be among.
    """
    mark_at, out = (lambda k: f"{path}/mark/version={k}"), f"{path}/on_time"

    def go(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        batch = saved(batch.repartition(*keys))  # even files: what removes copies sorts one at a time
        old = spark.read.parquet(mark_at(k - 1)).first()[0] if k and has_files(spark, mark_at(k - 1)) else None
        behind = F.lit(False) if old is None else F.col("ts") < F.lit(old) - F.expr(f"interval {days} days")
        late = batch.where(behind).dropDuplicates(list(keys))
        if not late.isEmpty():
            upsert_by_month(late, f"{path}/late", keys if "ts" in keys else [*keys, "ts"], list(keys))
        fine = batch.where(~F.coalesce(behind, F.lit(False))).dropDuplicates(list(keys))
        seen = [f"{out}/version={i}" for i in range(k) if has_files(spark, f"{out}/version={i}")]
        if seen and old is not None:
            before = spark.read.schema(batch.schema).parquet(*seen).where(F.col("ts") >= F.lit(old) - F.expr(f"interval {days} days"))
            fine = fine.join(before.select(*keys), list(keys), "left_anti")
        fine.write.mode("overwrite").parquet(f"{out}/version={k}")
        newest = batch.agg(F.max("ts").alias("ts")).select(F.greatest("ts", F.lit(old).cast(batch.schema["ts"].dataType)).alias("ts"))
        newest.write.mode("overwrite").parquet(mark_at(k))

    return go


def parameter_updates(path: str, entry_z: float, size: float, period_days: int, trailing_days: int) -> Callable[[DataFrame, int], None]:
    """What a stream of trades (pair, trade_seq, exit_ts, net), in order of time, does with each batch: at the end of each period that it completes, parameters by the
    trailing trades (see `trailing_parameters`) go to {path}/out, if they aren't those before.

    Trades of trailing_days are kept, as a version for each batch; a batch that is done again writes the same.
    """

    def go(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        kept = f"{path}/trades/version={k - 1}"
        known = saved(batch.unionByName(spark.read.schema(batch.schema).parquet(kept)) if k and has_files(spark, kept) else batch)
        before = [f"{path}/out/version={i}" for i in range(k) if has_files(spark, f"{path}/out/version={i}")]
        last = spark.read.parquet(*before).orderBy(F.desc("period_end")).first() if before else None
        marks = [f"{path}/mark/version={i}" for i in range(k) if has_files(spark, f"{path}/mark/version={i}")]
        done_to = spark.read.parquet(marks[-1]).first()[0] if marks else None
        mark = known.agg(F.max("exit_ts").alias("mark"))
        ends = trailing_parameters(known, entry_z, size, period_days, trailing_days, tasks=tasks_for(spark, known.count())).crossJoin(F.broadcast(mark)).where("period_end <= mark").drop("mark")
        ends = ends if done_to is None else ends.where(F.col("period_end") > F.lit(done_to))
        changed(ends, (last["entry_z"], last["size"]) if last else None).write.mode("overwrite").parquet(f"{path}/out/version={k}")
        known.crossJoin(F.broadcast(mark)).where(F.col("exit_ts") > F.col("mark") - F.make_dt_interval(F.lit(trailing_days + period_days))).drop("mark").write.mode("overwrite").parquet(f"{path}/trades/version={k}")
        mark.write.mode("overwrite").parquet(f"{path}/mark/version={k}")

    return go


def changed(ends: DataFrame, last: tuple[float, float] | None = None) -> DataFrame:
    """Rows (period_end, entry_z, size, ...) whose parameters aren't those of the row before, or, for the first, the last ones."""
    from pyspark.sql import Window

    w = Window.orderBy("period_end")  # a calendar's rows
    first = F.struct(F.lit(last[0]).alias("entry_z"), F.lit(last[1]).alias("size")) if last else F.lit(None).cast("struct<entry_z: double, size: double>")
    now = F.struct("entry_z", "size")
    before = F.coalesce(F.lag(now).over(w), first)
    return ends.withColumn("__b", before).where(~F.col("__b").eqNullSafe(now)).drop("__b")
