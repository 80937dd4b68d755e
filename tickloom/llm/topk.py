"""Exact top-k search by distributed histogram selection.

Rows are written once as chunks of whole numbers, and stay where they are. Queries come in blocks of bounded size, which go to all
tasks: each round, a task counts the scores of each query with its chunks in equal bins of the interval that must
hold the query's k-th highest score. Summed over all rows, the counts say in which bin that is, and the next round looks into that bin alone, until
an interval is a single score. A last pass emits what scores higher and, of ties at that score, the smallest ids. Only counts travel
between rounds, so what a query costs doesn't depend on how its scores are spread.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import bound_batches, quoted, shared_dir, written

#: Bins of a round, queries in a block (these bound what goes to a task and comes back), queries scored at once, rows in a chunk.
BINS, BLOCK, PART, CHUNK = 64, 4096, 256, 4096
CHUNK_TYPE = "ids binary, kind string, vectors binary"
#: Scores beyond this, either way, count as this.
MOST = (1 << 63) - 2


def usable(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, vector) of rows with an id and a vector of finite components."""
    v = F.col("vector")
    rows = df.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(vector)).cast("array<double>").alias("vector"))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def narrow(m: np.ndarray) -> np.ndarray:
    """m in the smallest type of whole numbers that holds it."""
    most = max(int(m.max(initial=0)), -int(m.min(initial=0)))
    return m.astype(next((t for t in (np.int8, np.int16, np.int32) if most <= np.iinfo(t).max), np.int64))


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, in floats where all sums stay exact; those beyond MOST are MOST."""
    size = lambda m: [max(abs(int(x)), abs(int(y))) for x, y in zip(m.max(axis=1, initial=0), m.min(axis=1, initial=0))]
    most_q, most_c = max(int(np.abs(q.astype(np.float64)).max(initial=0)) + 1, 1), max(int(np.abs(c.astype(np.float64)).max(initial=0)) + 1, 1)
    bound = most_q * most_c * max(1, q.shape[1])
    if bound < 1 << 53:
        kind = np.float32 if bound < 1 << 24 else np.float64
        return (q.astype(kind) @ c.astype(kind).T).astype(np.int64)
    if bound < MOST:
        return q.astype(np.int64) @ c.astype(np.int64).T
    # few rows are that large: these are summed without a limit, the others as before
    q, c = q.astype(np.int64), c.astype(np.int64)
    out = q @ c.T
    large = np.array([x * most_q * q.shape[1] >= MOST for x in size(c)], bool)
    if not large.any():
        return out
    if large.all():
        large = np.array([x * most_c * q.shape[1] >= MOST for x in size(q)], bool)
        out[large] = np.clip(q[large].astype(object) @ c.astype(object).T, -MOST, MOST).astype(np.int64)
        return out
    out[:, large] = np.clip(q.astype(object) @ c[large].astype(object).T, -MOST, MOST).astype(np.int64)
    out[:, ~large] = scores(q, c[~large])
    return out


def apart(score: np.ndarray, low: np.ndarray) -> np.ndarray:
    """How far scores are above low, without overflow; only where they are not below."""
    return score.view(np.uint64) - low[:, None].view(np.uint64)


def chunks_of(rows: DataFrame, dim: int) -> DataFrame:
    """Rows (id, vector) as a table of chunks: ids, and the matrix of their vectors in the type named by kind."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emit() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            for a in range(0, len(t), CHUNK):
                part = t.slice(a, CHUNK)
                v = part["vector"].combine_chunks()
                v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
                sizes = np.diff(v.offsets.to_numpy())
                m = np.zeros((len(sizes), dim), np.int64)
                m[np.arange(dim) < sizes[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
                m = narrow(m)
                yield pa.RecordBatch.from_pydict({"ids": [part["id"].to_numpy().astype("<i8").tobytes()], "kind": [m.dtype.str], "vectors": [m.tobytes()]}, schema=pa.schema([("ids", pa.binary()), ("kind", pa.string()), ("vectors", pa.binary())]))

        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= CHUNK:
                yield from emit()
                held.clear()
        if held:
            yield from emit()

    return written(rows.mapInArrow(go, CHUNK_TYPE), "chunks")


def opened(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        for ids, kind, raw in zip(*(c.to_pylist() for c in b.columns)):
            yield np.frombuffer(ids, "<i8"), np.frombuffer(raw, kind).reshape(-1, dim)


def top_k(df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """Each query's k rows of df with the highest integer scores: query_id, rank (from 1), <id_col>, score.

    Components become floor(scale * x), as longs; scores beyond MOST, either way, count as MOST. Ties go to the smaller id. A row is no
    candidate of a query with its own id. Rows with a
    null id, and vectors that are null or hold a null or non-finite component, take no part; shorter vectors are as if
    filled up with zeros. Rows of df that repeat an id are each a candidate; of queries that do, the least vector counts. Fewer
    than k candidates all come; empty tables give an empty result. Other columns play no part.

    Queries run block after block, each over all rows at once: of a block, BLOCK vectors and BLOCK x BINS counts pass through
    the driver, whatever the input.
    """
    spark = df.sparkSession
    bound_batches(spark)
    whole = F.transform("vector", lambda x: F.floor(x * scale))
    rows = usable(df, id_col, vector).select("id", whole.alias("vector"))
    asked = usable(queries, id_col, vector).select("id", whole.alias("vector")).groupBy("id").agg(F.min("vector").alias("vector"))
    largest = F.coalesce(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("decimal(38,0)")))), F.lit(0).cast("decimal(38,0)"))
    shape = [F.coalesce(F.max(F.size("vector")), F.lit(0)), F.coalesce(F.max(largest), F.lit(0).cast("decimal(38,0)")), F.count("*")]
    (dim_c, most_c, _), (dim_q, most_q, n_queries) = rows.agg(*shape).first(), asked.agg(*shape).first()
    result = f"query_id long, rank int, {quoted(id_col)} long, score long"
    if not n_queries:
        return spark.createDataFrame([], result)
    dim = max(dim_c, dim_q)
    reach = min(MOST, int(most_c) * int(most_q) * max(1, dim) + 1)  # no score lies farther from 0
    chunks = chunks_of(rows, dim)
    blocks = math.ceil(n_queries / BLOCK)
    waiting = asked
    if blocks > 1:
        path = f"{shared_dir(spark)}/tickloom-{uuid.uuid4().hex}/queries"
        asked.withColumn("block", F.expr(f"cast(pmod(xxhash64(id, 3), {blocks}) as int)")).write.partitionBy("block").parquet(path)
        waiting = spark.read.parquet(path)
    out = f"{shared_dir(spark)}/tickloom-{uuid.uuid4().hex}/found"
    for block in range(blocks):
        own = (waiting.where(F.col("block") == block) if blocks > 1 else waiting).select("id", "vector").orderBy("id").collect()
        for a in range(0, len(own), BLOCK):
            best(chunks, own[a : a + BLOCK], dim, reach, k).write.mode("append").parquet(out)
    found = spark.read.schema("query_id long, id long, score long").parquet(out)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def best(chunks: DataFrame, block: list, dim: int, reach: int, k: int) -> DataFrame:
    """(query_id, id, score): of each query of the block at least its k best rows, and no more than k of any task's."""
    ids = np.array([r["id"] for r in block], "<i8")
    vectors = np.zeros((len(block), dim), np.int64)
    for row, r in zip(vectors, block):
        row[: len(r["vector"])] = r["vector"]
    vectors, low, above = narrow(vectors), np.full(len(block), -reach, np.int64), np.zeros(len(block), np.int64)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(part of the block, candidates' ids, scores); a query's own row scores below all."""
        for other, c in opened(batches, dim):
            for a in range(0, len(ids), PART):
                part = slice(a, a + PART)
                score = scores(vectors[part], c)
                score[ids[part][:, None] == other[None]] = -reach - 1
                yield part, other, score

    def counter(low: np.ndarray, width: int, step: int):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(ids), BINS), np.int64)
            for part, _, score in scored(batches):
                far = apart(score, low[part])
                fine = (score >= low[part][:, None]) & (far < np.uint64(width))
                n = len(score)
                cell = ((far // np.uint64(step)).astype(np.int64) + np.arange(n)[:, None] * BINS)[fine]
                total[part] += np.bincount(cell, minlength=n * BINS).reshape(n, BINS)
            i, j = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["query", "bin", "n"])

        return count

    width = 2 * reach + 1
    while width > 1:
        step = -(-width // BINS)
        counted = chunks.mapInArrow(counter(low, width, step), "query int, bin int, n long").groupBy("query", "bin").agg(F.sum("n").alias("n")).toPandas()  # BLOCK x BINS rows at most
        total = np.zeros((len(ids), BINS), np.int64)
        total[counted["query"], counted["bin"]] = counted["n"]
        down = np.cumsum(total[:, ::-1], axis=1) + above[:, None]  # from the highest bin
        at = np.where(down[:, -1] >= k, (down >= k).argmax(axis=1), BINS - 1)  # with fewer than k in all, the lowest
        above = np.where(at > 0, down[np.arange(len(ids)), np.maximum(at - 1, 0)], above)
        low = (low.view(np.uint64) + (BINS - 1 - at).astype(np.uint64) * np.uint64(step)).view(np.int64)
        width = step

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ties: dict[int, np.ndarray] = {}
        for part, other, score in scored(batches):
            i, j = np.nonzero(score > low[part][:, None])
            yield pa.RecordBatch.from_arrays([pa.array(ids[part][i]), pa.array(other[j]), pa.array(score[i, j])], ["query_id", "id", "score"])
            i, j = np.nonzero(score == low[part][:, None])
            for q, a, b in zip(*(x.tolist() for x in (lambda u, at: (u, at, np.r_[at[1:], len(i)]))(*np.unique(i, return_index=True)))):
                if (need := k - int(above[part][q])) > 0:
                    ties[part.start + q] = np.sort(np.r_[ties.get(part.start + q, np.zeros(0, np.int64)), other[j[a:b]]])[:need]
        for q, tied in ties.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tied), ids[q])), pa.array(tied), pa.array(np.full(len(tied), low[q]))], ["query_id", "id", "score"])

    return chunks.mapInArrow(emit, "query_id long, id long, score long")
