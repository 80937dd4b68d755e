"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within 2r bits of one another share a variant within r bits of both, and two that share one are within
2r. So every distinct fingerprint emits its ball of radius r, and equal variants meet. Balls are large (2081 variants
for 64 bits and r = 2), so what is shuffled first is only a sorted, bit-packed array of short variant hashes for each
(chunk of fingerprints, bucket of hashes). A bucket answers each chunk with the hashes that another fingerprint may also
hold; the chunk then sends those few variants in full, and the links that they make are verified. Every group that
a task sees is bounded: a chunk by its number of fingerprints, a bucket by the hash, one variant by the ball around it.
Copies fold into their fingerprint before anything else, however many there are.

deduplicated() takes a similarity of shingle sets instead of a number of bits: several shorter fingerprints of a text go
through the same balls, each marked with its number in the bits above, and candidates are verified on whole texts.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import bound_batches, own_columns, quoted, written

#: Fingerprints in a chunk and variant hashes in a bucket, on average: these bound a task's memory, whatever the input.
CHUNK, BUCKET = 8192, 1 << 21
MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles, A-Z in lower case; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: only ASCII letters and ASCII white space
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    k = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:k].tolist()
    hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[-k:].tolist())], dtype=">u8")
    bits = np.zeros(64, np.int64)
    for i in range(0, k, 1 << 15):
        bits += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * bits > k).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprints(df: DataFrame, text: str = "text", shingle: int = 4, name: str = "fp") -> DataFrame:
    """df and the fingerprint of its text as a signed long. Null and empty texts have 0."""
    bound_batches(df.sparkSession)

    @F.pandas_udf("long")
    def go(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([signed(fingerprint(x, shingle)) for x in texts], dtype="int64")

    return df.select(*(F.col(quoted(c)) for c in own_columns(df, name)), go(F.col(quoted(text))).alias(name))


def ball(radius: int, bits: int = 64) -> np.ndarray:
    """All masks of at most radius bits."""
    return np.array([sum(1 << b for b in at) for r in range(radius + 1) for at in itertools.combinations(range(bits), r)], dtype=np.uint64)


def mixed(v: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose high bits depend on all bits; changes v."""
    v ^= v >> np.uint64(32)
    v *= MIX
    v ^= v >> np.uint64(29)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    return v


def variant_hashes(fps: np.ndarray, masks: np.ndarray, width: int) -> np.ndarray:
    """The top width bits of the mixed variants, mask by mask."""
    out = np.empty((len(masks), len(fps)), np.uint64)
    for row, mask in zip(out, masks):
        np.bitwise_xor(fps, mask, out=row)
        mixed(row)
        row >>= np.uint64(64 - width)
    return out


def packed(sorted_low: np.ndarray, cell_bits: int, low_bytes: int) -> tuple[bytes, bytes]:
    """Sorted numbers of cell_bits + 8 low_bytes bits as counts of the high part and the low parts in order."""
    low_bits = np.uint64(8 * low_bytes)
    counts = np.bincount((sorted_low >> low_bits).astype(np.int64), minlength=1 << cell_bits).astype("<u2")
    low = sorted_low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low_bytes]
    return counts.tobytes(), np.ascontiguousarray(low).tobytes()


def unpacked(counts: bytes, low: bytes, low_bytes: int) -> np.ndarray:
    n = np.frombuffer(counts, "<u2")
    out = np.zeros((len(low) // low_bytes, 8), np.uint8)
    out[:, :low_bytes] = np.frombuffer(low, np.uint8).reshape(-1, low_bytes)
    return out.view("<u8").ravel().astype(np.uint64) | np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(8 * low_bytes)


def near_pairs(fps: DataFrame, radius: int = 2, chunk: int = CHUNK, bucket: int = BUCKET, bits: int = 64) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints (column fp) that agree above their low bits and differ in at most 2 radius of these.

    Of the fingerprints that share a variant, each links to the smallest, so that components are those of all links.
    """
    masks = ball(radius, bits)
    total = fps.count() * len(masks)
    chunks = max(1, math.ceil(total / len(masks) / chunk))
    bucket_bits = max(0, math.ceil(math.log2(max(1, total / bucket))))
    # about nine bits more than it takes to count all variants: one in 500 meets another by chance, and is told apart later
    low_bytes = max(1, math.ceil((math.log2(max(2, chunk * len(masks))) - bucket_bits - 5) / 8) if total else 1)
    rest = max(8 * low_bytes + 1, math.ceil(math.log2(max(2, total))) + 9 - bucket_bits)
    while rest - 8 * low_bytes > 16:
        low_bytes += 1
    cell_bits, width = rest - 8 * low_bytes, bucket_bits + rest
    dealt = fps.select(F.expr(f"cast(pmod(xxhash64(fp, 7), {chunks}) as int)").alias("chunk"), "fp").repartition(2 * chunks, "chunk")  # rows are few and what they make is much: tasks must not be merged by their input

    def emit(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.unique(pdf["fp"].to_numpy().view(np.uint64))
        h = variant_hashes(own, masks, width).ravel()
        h.sort()
        edges = np.searchsorted(h, np.arange((1 << bucket_bits) + 1, dtype=np.uint64) << np.uint64(rest)).tolist()
        keep, rows = np.uint64((1 << rest) - 1), []
        for i, (a, b) in enumerate(itertools.pairwise(edges)):
            if b > a:
                rows.append((int(pdf["chunk"].iat[0]), i, *packed(h[a:b] & keep, cell_bits, low_bytes)))
        return pd.DataFrame(rows, columns=["chunk", "bucket", "counts", "low"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpacked(c, x, low_bytes) for c, x in zip(pdf["counts"], pdf["low"])]
        h = np.sort(np.concatenate(parts))
        twice = np.unique(h[1:][h[1:] == h[:-1]])
        top, rows = np.uint64(int(pdf["bucket"].iat[0]) << rest), []
        for c, part in zip(pdf["chunk"], parts):
            if len(found := np.unique(part[np.isin(part, twice)])):
                rows.append((int(c), (found | top).tobytes()))
        return pd.DataFrame(rows, columns=["chunk", "hits"])

    def answer(own: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"bucket": pd.Series(dtype="int32"), "v": pd.Series(dtype=object), "f": pd.Series(dtype=object)})
        if own.empty or hits.empty:
            return none
        wanted = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in hits["hits"]]))
        fp = np.unique(own["fp"].to_numpy().view(np.uint64))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        step = max(1, 64 * CHUNK // len(fp))
        for i in range(0, len(masks), step):
            h = variant_hashes(fp, masks[i : i + step], width)
            k, j = np.nonzero((wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h))
            found.append((fp[j] ^ masks[i : i + step][k], fp[j]))
        v, f = (np.concatenate(x) for x in zip(*found))
        to = (mixed(v.copy()) >> np.uint64(64 - width) >> np.uint64(rest)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        v, f, to = v[order], f[order], to[order]
        at = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]).tolist() if len(to) else []
        return pd.DataFrame([(int(to[a]), v[a:b].tobytes(), f[a:b].tobytes()) for a, b in zip(at, at[1:] + [len(to)])], columns=["bucket", "v", "f"]) if at else none

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        v, f = (np.concatenate([np.frombuffer(x, np.uint64) for x in pdf[c]]) for c in ("v", "f"))
        order = np.lexsort((f.view(np.int64), v))
        v, f = v[order], f[order]
        first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        least = np.repeat(f[first], np.diff(np.r_[first, len(v)]))
        pairs = np.unique(np.stack([least, f], axis=1)[least != f], axis=0)
        near = np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= 2 * radius
        return pd.DataFrame(np.ascontiguousarray(pairs[near]).view(np.int64), columns=["a", "b"])

    hits = dealt.groupBy("chunk").applyInPandas(emit, "chunk int, bucket long, counts binary, low binary").groupBy("bucket").applyInPandas(meet, "chunk int, hits binary")
    full = dealt.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInPandas(answer, "bucket long, v binary, f binary")
    return full.groupBy("bucket").applyInPandas(link, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): each node of edges (a, b) and the least node that it reaches, by rounds of large and small stars.

    Each round joins links with one row per node; nothing is gathered for a node, so a hot one is split like any
    skewed join. Every round is written to the shared folder.
    """
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    spark = e.sparkSession

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.expr("cast(xxhash64(a, b) as decimal(38,0))"))).first())

    now = state(e)
    for _ in range(rounds):
        if not now[0]:
            break
        both = e.union(e.select("b", "a")).toDF("a", "b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        e = written(small, "stars")
        before, now = now, state(e)
        if before == now:
            break
    else:
        raise RuntimeError(f"links did not settle in {rounds} rounds")
    roots = e.select("a", "b").union(e.select(F.col("b").alias("a"), "b")).distinct() if now[0] else spark.createDataFrame([], "a long, b long")
    return roots.toDF("node", "root")


def rooted(fps: DataFrame, value: Column, radius: int) -> DataFrame:
    """(fp, least, root): each distinct fingerprint, the least value of its rows, and the fingerprint that names its component."""
    classes = written(fps.groupBy("fp").agg(F.min(value).alias("least")), "classes")
    roots = components(near_pairs(classes.select("fp"), radius))
    return classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 2) -> DataFrame:
    """One row per row of df: its id, fp (signed long) and component_id, the least id that it reaches over links.

    Rows link if their fingerprints differ in at most 2 radius bits. Null and empty texts all have fingerprint 0 and link
    like any others. A null id takes part, but is never a component's id unless all of its ids are null. Repeated rows
    give repeated results. An empty table gives an empty result. Other columns of df play no part.
    """
    fps = written(with_fingerprints(df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text)).alias("text")), "text", shingle).select("id", "fp"), "fingerprints")
    roots = rooted(fps, F.col("id"), radius)
    named = roots.join(roots.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def word_shingles(text: str | None, shingle: int) -> tuple[int, np.ndarray]:
    """A hash of the words (signed) and those of their shingles, repeats included; A-Z in lower case, (0, none) without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0, np.empty(0, np.uint64)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    k = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:k].tolist()
    return signed(xxhash.xxh64_intdigest(joined, 7)), np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[-k:].tolist())], np.uint64)


def majority(hashes: np.ndarray, n: int) -> np.ndarray:
    """The n bits of a long SimHash; each 64 of them come from the hashes mixed anew."""
    words, rows = -(-n // 64), 255  # so many bits add up within a byte
    salts = np.arange(words, dtype=np.uint64) * MIX
    total = np.zeros(64 * words, np.int64)
    for a in range(0, len(hashes), rows << 3):
        h = mixed(hashes[a : a + (rows << 3), None] ^ salts).view(np.uint8)
        for i in range(0, len(h), rows):
            total += np.unpackbits(h[i : i + rows], axis=1).sum(axis=0, dtype=np.uint8)
    return (2 * total > len(hashes))[:n]


def tables(rows: int, similarity: float, recall: float, radius: int) -> tuple[int, int, int]:
    """(bits, n, limit): the length and number of short fingerprints by which rows texts are searched, and most bits that differ in all.

    Bits grow with the logarithm of rows, so that a variant meets an unrelated text once in 50 at any size. n follows: a pair whose
    shingle sets are as similar as asked for differs in a bit with the chance angle / pi, and is to be within 2 radius
    bits in one of the n with the chance recall. The limit is five deviations above the mean of such pairs.
    """
    bits = 8
    while rows * len(ball(radius, bits)) > 0.02 * 2**bits:
        bits += 1
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    one = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(2 * radius + 1))
    n = 1 if one >= recall else math.ceil(math.log(1 - recall) / math.log(1 - one))
    return bits, n, math.ceil(bits * n * p + 5 * math.sqrt(bits * n * p * (1 - p)))


def jaccard(a: Column, b: Column, shingle: int) -> Column:
    """Similarity of two texts' sets of shingles."""

    @F.pandas_udf("double")
    def go(x: pd.Series, y: pd.Series) -> pd.Series:
        last, out = (None, None), []
        for s, t in zip(x, y):
            if s != last[0]:
                last = (s, np.unique(word_shingles(s, shingle)[1]))
            other = np.unique(word_shingles(t, shingle)[1])
            both = len(np.intersect1d(last[1], other, assume_unique=True))
            out.append(both / max(1, len(last[1]) + len(other) - both))
        return pd.Series(out, dtype="float64")

    return go(a, b)


def deduplicated(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, recall: float = 0.98, radius: int = 1) -> DataFrame:
    """One row of each component of df: that with the least id, and of several with this id that with the least hash of its text.

    Rows link if their sets of word shingles have a Jaccard similarity of at least `similarity`. Candidates come from several short
    fingerprints of a text (see tables), each searched by balls of half the radius; candidates are verified on all
    fingerprints, then on whole texts. Equal word sequences are one class whatever their number; null and empty texts are one, too. A variant's
    members are held against its least one, so a link may also be missed where that is no near copy of either.

    So a row only goes if another one of its component stays, whatever texts share an id. Rows with a null id can't be
    referred to: they take no part, and stay.
    """
    bound_batches(df.sparkSession)
    key = [F.col(quoted(id_col)).alias("__id"), F.xxhash64(F.col(quoted(text))).alias("__hash")]
    named = df.where(F.col(quoted(id_col)).isNotNull())
    bits, n, limit = tables(named.count(), similarity, recall, radius)

    @F.pandas_udf("class long, at array<long>")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights, tags = np.int64(1) << np.arange(bits, dtype=np.int64), np.arange(n, dtype=np.int64) << np.int64(bits)
        for texts in batches:
            rows = []
            for x in texts:
                name, hashes = word_shingles(x, shingle)
                rows.append((name, majority(hashes, bits * n).reshape(n, bits) @ weights + tags if len(hashes) else np.empty(0, np.int64)))
            yield pd.DataFrame(rows, columns=["class", "at"])

    fps = written(named.select(*key, prints(F.col(quoted(text))).alias("p")).select("__id", "__hash", "p.*"), "prints")
    classes = written(fps.groupBy("class").agg(F.min(F.struct("__id", "__hash")).alias("least"), F.first("at").alias("at")), "classes")
    cells = classes.select("class", F.explode("at").alias("fp"))
    firsts = written(cells.groupBy("fp").agg(F.min("class").alias("first"), F.count("*").alias("n")), "cells")
    near = near_pairs(firsts.select("fp"), radius, chunk=CHUNK * len(ball(2)) // len(ball(radius, bits)) // 4, bits=bits)  # a quarter of the variants that a task of radius 2 holds
    inside = cells.join(firsts.where("n > 1"), "fp").select(F.col("class").alias("x"), F.col("first").alias("y"))
    across = near.join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select("x", "y")
    met = inside.union(across).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    sides = met.join(classes.select(F.col("class").alias("a"), F.col("at").alias("s")), "a").join(classes.select(F.col("class").alias("b"), F.col("at").alias("t")), "b")
    pairs = written(sides.where(F.expr(f"aggregate(zip_with(s, t, (x, y) -> bit_count(x ^ y)), 0, (m, x) -> m + x) <= {limit}")).select("a", "b"), "candidates")
    held = classes.join(pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct(), "class", "left_semi").select("class", "least.*")
    texts = written(named.select(*key, F.col(quoted(text)).alias("text")).dropDuplicates(["__id", "__hash"]).join(held, ["__id", "__hash"]).select("class", "text"), "texts")
    sides = pairs.join(texts.toDF("a", "s"), "a").join(texts.toDF("b", "t"), "b")
    roots = components(sides.where(jaccard(F.col("s"), F.col("t"), shingle) >= similarity).select("a", "b"))
    kept = classes.join(roots, classes["class"] == roots["node"], "left").groupBy(F.coalesce("root", "class").alias("root")).agg(F.min("least").alias("least")).select("least.*")
    stay = named.select(F.struct(*(F.col(quoted(c)) for c in df.columns)).alias("__row"), *key).join(kept, ["__id", "__hash"], "left_semi").dropDuplicates(["__id", "__hash"]).select("__row.*")
    return stay.unionByName(df.where(F.col(quoted(id_col)).isNull()))
