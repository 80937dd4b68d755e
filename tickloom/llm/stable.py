"""Approximate nearest neighbours by cosine: low-dimensional stable projections, indexed by kd-tree.

Unit vectors are projected on MEASURES Gaussian directions. For a vector at distance d, the square of the projected distance over d squared follows
a chi-square law, so projected neighbours are verified in growing order until that law says that one nearer than the k-th found so far would,
with a chance of at least CHANCE, have come already. Every distinct vector is indexed: cells of an upper tree, split on a bounded
sample, are cut into chunks of bounded size, and each chunk has a tree of its own. A query first searches the cell it lies in; the
bound found there says which other cells the test still leaves open, and these are searched next, all in two joins of chunks with blocks of queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import bound_batches, quoted, written
from tickloom.llm.topk import usable

#: Directions (even); rows of a leaf, of a chunk, and queries of a block; rows that the upper tree is split on, and its cells, at most.
MEASURES, LEAF, CHUNK, BLOCK, SAMPLE, CELLS = 8, 64, 4096, 1024, 1 << 16, 1024
#: Chance that a vector as near as the k-th found would have come before the search stops.
CHANCE = 0.97


def chi_square(x: float, freedom: int) -> float:
    """The chi-square distribution for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(freedom // 2))


def reach(chance: float, freedom: int = MEASURES) -> float:
    """The square of the projected distance, in squares of the true one, within which a vector comes with the chance."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, freedom) < chance else (low, mid)
    return high


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(13).standard_normal((dim, MEASURES))


def units(v: np.ndarray) -> np.ndarray:
    """Vectors of length 1, also where squares would overflow or vanish."""
    v = v / np.maximum(np.abs(v).max(axis=1, keepdims=True, initial=0), np.finfo(float).tiny)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    parts = flat.chunks if isinstance(flat, pa.ChunkedArray) else [flat]
    return np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in parts] or [np.zeros(0)]).reshape(-1, dim)


class Splits:
    """An upper kd-tree of 2 ** depth cells, split at medians of a sample."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth, self.axis, self.value = depth, np.zeros(1 << depth, int), np.full(1 << depth, np.inf)
        held = {1: points}
        for node in range(1, 1 << depth):
            own = held.pop(node)
            if len(own):
                self.axis[node] = axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                self.value[node] = np.median(own[:, axis])
            upper = own[:, self.axis[node]] > self.value[node]
            held[2 * node], held[2 * node + 1] = own[~upper], own[upper]

    def cells(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), int)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] > self.value[node])
        return node - (1 << self.depth)


def in_leaves(points: np.ndarray) -> np.ndarray:
    """An order of the points in which each LEAF of them are a leaf of a kd-tree."""
    todo, out = [np.arange(len(points))], []
    while todo:
        own = todo.pop()
        if len(own) <= LEAF:
            out.append(own)
            continue
        at = points[own]
        half = -(-len(own) // LEAF) // 2 * LEAF
        own = own[np.argsort(at[:, np.argmax(at.max(axis=0) - at.min(axis=0))], kind="stable")]
        todo += [own[half:], own[:half]]
    return np.concatenate(out) if out else np.zeros(0, int)


def away(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squares of the distances of points from boxes."""
    out = np.zeros((len(points), len(low)))
    for p, a, b in zip(points.T, low.T, high.T):
        out += np.maximum(np.maximum(a[None] - p[:, None], p[:, None] - b[None]), 0) ** 2
    return out


def searched(vectors: np.ndarray, ids: list[list[int]], queries: np.ndarray, bounds: np.ndarray, k: int, far: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of a chunk's rows that are verified before the test holds, the k best of each query.

    bounds: squares of distances that k rows elsewhere are known to be within.
    """
    unit, asked = units(vectors), units(queries)
    net = directions(vectors.shape[1])
    points, at = unit @ net, asked @ net
    starts = np.arange(0, len(points), LEAF)
    mind = away(at, np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts))
    order = np.argsort(mind, axis=1, kind="stable")
    copies = np.array([len(x) for x in ids])
    own_ids = np.full((len(ids), copies.max()), -1, np.int64)
    own_ids[np.arange(copies.max()) < copies[:, None]] = [n for x in ids for n in x]
    best, who = np.full((len(asked), k), -np.inf), np.full((len(asked), k), -1, np.int64)
    nearest = bounds.copy()
    active = np.arange(len(asked))
    for r in range(len(starts)):
        active = active[mind[active, order[active, r]] <= far * nearest[active]]
        if not len(active):
            break
        leaf = order[active, r]
        for x in np.unique(leaf):
            own, part = active[leaf == x], slice(starts[x], starts[x] + LEAF)
            times = copies[part].max()  # copies of one vector each count
            score = np.repeat(asked[own] @ unit[part].T, times, axis=1)
            score[:, (np.arange(times) >= copies[part][:, None]).ravel()] = -np.inf
            both, names = np.c_[best[own], score], np.c_[who[own], np.broadcast_to(own_ids[part, :times].ravel(), score.shape)]
            top = np.lexsort((names, -both))[:, :k]
            best[own], who[own] = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)
        nearest[active] = np.minimum(nearest[active], 2 - 2 * best[active, -1])
    q, j = np.nonzero(best > -np.inf)
    return q, who[q, j], best[q, j]


def nearest(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", chance: float = CHANCE, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank (from 1), <id_col>, score: of each query the k rows of df with the largest cosine that the search finds.

    Scores are cosines of the original vectors in double precision; ties go to the smaller id. A row is no candidate of a query with its own id. Rows
    with a null id, and vectors that are null, zero, or hold a null or non-finite component, take no part; shorter vectors are as if filled up with
    zeros. Rows equal in id and vector count once; of queries that repeat an id, the least vector counts. Equal vectors are indexed once with
    their k + 1 smallest ids, which loses nothing. Fewer than k candidates all come; empty tables give an empty result. Other columns play no part.

    The driver holds SAMPLE projected rows and CELLS boxes, whatever the input.
    """
    spark = df.sparkSession
    bound_batches(spark)
    far, want, name = reach(chance), k + 1, quoted(id_col)
    result = f"query_id long, rank int, {name} long, score double"
    some = F.exists("vector", lambda x: x != 0)
    rows, asked = usable(df, id_col, vector).where(some), usable(queries, id_col, vector).where(some).groupBy("id").agg(F.min("vector").alias("vector"))
    dim = max(rows.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0], asked.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0])
    if not dim:
        return spark.createDataFrame([], result)
    filled = F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("vector"))).alias("vector")
    same = Window.partitionBy("vector").orderBy("id")
    classes = rows.select("id", filled).distinct().withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= want).groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    net = directions(dim)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = units(matrix(b["vector"], dim)) @ net
            yield b.append_column("at", pa.FixedSizeListArray.from_arrays(pa.array(at.ravel()), MEASURES).cast(pa.list_(pa.float64())))

    lying = written(classes.mapInArrow(project, "vector array<double>, ids array<long>, at array<double>"), "projected")
    count = lying.count()
    sample = np.array([r[0] for r in lying.select("at").orderBy(F.xxhash64("vector"), "at").limit(SAMPLE).collect()], float).reshape(-1, MEASURES)
    splits = Splits(sample, min(int(math.log2(CELLS)), max(0, math.ceil(math.log2(max(1, count / chunk))))))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("cell", pa.array(splits.cells(matrix(b["at"], MEASURES)).astype(np.int32)))

    celled = written(lying.mapInArrow(dealt, "vector array<double>, ids array<long>, at array<double>, cell int"), "celled")
    sides = [f(F.col("at")[i]).alias(f"{s}{i}") for s, f in (("low", F.min), ("high", F.max)) for i in range(MEASURES)]
    boxes = sorted(celled.groupBy("cell").agg(F.count("*").alias("n"), *sides).collect())  # CELLS at most
    cell_ids, low, high = np.array([r["cell"] for r in boxes]), np.array([r[2 : 2 + MEASURES] for r in boxes]), np.array([r[2 + MEASURES :] for r in boxes])
    chunks_in = spark.createDataFrame([(r["cell"], -(-r["n"] // chunk)) for r in boxes], "cell int, chunks int")
    index = written(celled.join(F.broadcast(chunks_in), "cell").select("cell", F.pmod(F.xxhash64("vector", F.lit(5)), "chunks").cast("int").alias("chunk"), "vector", "ids", "at").groupBy("cell", "chunk").applyInArrow(packed_chunk, "cell int, chunk int, ids array<array<long>>, vectors binary"), "index")

    # queries that ask for the same vector search once
    asked = asked.select("id", filled)
    once = written(asked.groupBy("vector").agg(F.min("id").alias("query")), "asked")

    def routed(home: bool):
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                mind = away(units(matrix(b["vector"], dim)) @ net, low, high)
                first = mind.argmin(axis=1)
                hit = np.zeros(mind.shape, bool)
                hit[np.arange(len(hit)), first] = True
                if not home:
                    bound = b["bound"].to_numpy(zero_copy_only=False)
                    hit = ~hit & (mind <= far * bound[:, None])
                q, c = np.nonzero(hit)
                yield b.take(pa.array(q)).append_column("cell", pa.array(cell_ids[c].astype(np.int32)))

        return go

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))]
        if len(right):
            bounds = right["bound"].to_numpy()
            for ids, raw in zip(left["ids"].to_pylist(), left["vectors"].to_pylist()):
                found.append(searched(np.frombuffer(raw).reshape(-1, dim), ids, matrix(right["vector"], dim), bounds, want, far))
        q, i, s = (np.concatenate(x) for x in zip(*found))
        return pa.table({"query": right["query"].take(pa.array(q)), "id": pa.array(i), "score": pa.array(s)})

    def searching(requests: DataFrame, home: bool, name: str) -> DataFrame:
        open_ = written(requests.select("query", "vector", "bound").mapInArrow(routed(home), "query long, vector array<double>, bound double, cell int"), f"{name}-requests")
        busy = open_.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).join(F.broadcast(chunks_in), "cell")  # CELLS rows at most
        one = open_.join(F.broadcast(busy), "cell").withColumn("part", F.pmod(F.xxhash64("query", F.lit(3)), "parts").cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        other = index.join(F.broadcast(busy.select("cell", "parts")), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        keys = ("cell", "chunk", "part")
        met = other.select(*keys, "ids", "vectors").groupBy(*keys).cogroup(one.select(*keys, "query", "vector", "bound").groupBy(*keys)).applyInArrow(answer, "query long, id long, score double")
        return written(best(met, want), name)

    found = searching(once.withColumn("bound", F.lit(float("inf"))), True, "home")
    bound = found.where(F.col("nth") == want).select("query", F.greatest(F.lit(0.0), 2 - 2 * F.col("score")).alias("limit"))
    wider = once.join(bound, "query", "left").select("query", "vector", F.coalesce("limit", F.lit(float("inf"))).alias("bound"))
    found = best(found.select("query", "id", "score").unionByName(searching(wider, False, "beyond").select("query", "id", "score")), want)
    own = asked.join(once, "vector").select(F.col("id").alias("query_id"), "query").join(found, "query").where(F.col("query_id") != F.col("id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return own.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def best(found: DataFrame, k: int) -> DataFrame:
    """Of each query the k best (query, id, score), with their place (nth)."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def packed_chunk(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """One row of the index: a chunk's vectors, in the order of its tree's leaves, and their ids."""
    dim = len(rows["vector"][0])
    order = in_leaves(matrix(rows["at"], MEASURES))
    vectors = matrix(rows["vector"], dim)[order]
    ids = rows["ids"].take(pa.array(order)).to_pylist()
    return pa.table({"cell": [key[0].as_py()], "chunk": [key[1].as_py()], "ids": [ids], "vectors": [vectors.tobytes()]}, schema=pa.schema([("cell", pa.int32()), ("chunk", pa.int32()), ("ids", pa.list_(pa.list_(pa.int64()))), ("vectors", pa.binary())]))
