"""Substring dedup by recompression.

Texts become sequences of 64-bit word names. The first round names runs of one word, the next ones pairs: a name's hash bit
says whether it may open or close a pair, so whether two neighbours join depends on those two alone, and equal
substrings get equal names inside, everywhere. A name is a fingerprint of what it stands for, so that all tasks give the
same one without a shared dictionary. Three Spark rounds follow over chunks of documents:

1. names of the last round are counted over all texts; a chunk learns which of its own stand anywhere else;
2. a window can only repeat if each name that it alone determines does; the windows for which this holds are counted by
   95 bits of their word sequence, which tells real repeats from windows whose parts only occur apart;
3. words that repeated windows cover go.

What is shuffled between chunks and the buckets of hashes is packed arrays, one row for each chunk and bucket. A hot passage
folds within its chunk first, so no group grows with its number of copies. The text is shuffled once: all three rounds
read the same exchange.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import quoted

#: Bytes of text in a chunk and in a bucket's share, on average; pair rounds after that of runs.
CHUNK, BUCKET, ROUNDS = 6 << 20, 32 << 20, 6
FAR = 1 << 60
K1, K2, K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * K3
    return x ^ (x >> np.uint64(29))


class Words:
    """The words of a chunk's texts, one after another: names, the text that each is of, and where each text begins."""

    def __init__(self, texts: pa.ChunkedArray):
        split = pc.ascii_split_whitespace(pc.fill_null(texts, "").combine_chunks())
        if isinstance(split, pa.ChunkedArray):
            split = split.combine_chunks()
        flat, owner = split.flatten(), np.repeat(np.arange(len(split)), np.diff(split.offsets.to_numpy()))
        some = pc.greater(pc.binary_length(flat), 0)
        self.flat, self.owner = flat.filter(some), owner[some.to_numpy(zero_copy_only=False)]
        coded = self.flat.dictionary_encode()
        names = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        self.names = names[coded.indices.to_numpy()] if len(names) else names
        self.counts = np.bincount(self.owner, minlength=len(split)).astype(np.int64)
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where windows begin, and two hashes of each."""
        n = len(self.names)
        if n < width:
            none = np.zeros(0, np.uint64)
            return np.zeros(0, np.int64), none, none.astype(np.uint32)
        at = np.flatnonzero(self.owner[: n - width + 1] == self.owner[width - 1 :])
        out = []
        for k, names in ((int(K1), self.names), (int(K2), mix(self.names ^ K2))):
            up = np.full(n, k, np.uint64)
            up[0] = 1
            down = np.full(n, pow(k, -1, 1 << 64), np.uint64)
            down[0] = 1
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(names * np.cumprod(up))])
            out.append(mix((sums[width:] - sums[:-width])[at] * np.cumprod(down)[at]))
        return at, out[0], (out[1] >> np.uint64(32)).astype(np.uint32)


def parsed(words: Words, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names after all rounds, the text of each, and the range of words [from, to) that alone determines it."""
    name, owner = words.names, words.owner
    n = len(name)
    if not n:
        return name, owner, np.zeros(0, np.int64), np.zeros(0, np.int64)
    # runs; to be one, or none, a word must differ from its neighbours
    first = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])])
    size = np.diff(np.r_[first, n])
    lo = np.where(np.r_[True, owner[first[1:]] != owner[first[1:] - 1]], -FAR, first - 1)
    end = first + size
    hi = np.where(np.r_[owner[end[:-1]] != owner[end[:-1] - 1], True], FAR, end + 1)
    name, owner = name[first], owner[first]
    name = np.where(size > 1, mix(name * K1 + size.astype(np.uint64)), name)
    for r in range(rounds):
        opens = (mix(name + np.uint64((r + 1) * int(K2) % (1 << 64))) >> np.uint64(40)) & np.uint64(1) == 1
        same = owner[1:] == owner[:-1]
        joins = np.r_[opens[:-1] & ~opens[1:] & same, False]  # with the next one
        joined = np.r_[False, joins[:-1]]
        after_lo, after_hi = np.r_[np.where(same, lo[1:], 0), 0], np.r_[np.where(same, hi[1:], FAR), FAR]
        before_lo = np.r_[-FAR, np.where(same, lo[:-1], -FAR)]
        pair = mix(mix(name * K1 + np.uint64(r + 1)) + np.r_[name[1:], 0].astype(np.uint64) * K2)
        new_lo = np.where(joins, np.minimum(lo, after_lo), np.where(opens, lo, np.minimum(lo, before_lo)))
        new_hi = np.where(joins | opens, np.maximum(hi, after_hi), hi)
        keep = ~joined
        name, owner, lo, hi = np.where(joins, pair, name)[keep], owner[keep], new_lo[keep], new_hi[keep]
    return name, owner, lo, hi


def blobs(h: np.ndarray, bits: int, *more: np.ndarray) -> Iterator[tuple]:
    """(bucket, bytes of the hashes in it, bytes of more that belongs to them); h is sorted."""
    edges = np.searchsorted(h, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist() if bits else []
    for i, (a, b) in enumerate(zip([0, *edges], [*edges, len(h)])):
        if b > a:
            yield i, h[a:b].tobytes(), *(x[a:b].tobytes() for x in more)


def distinct(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs, sorted, and how often each occurs."""
    order = np.lexsort((h2, h1))
    h1, h2 = h1[order], h2[order]
    first = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]) if len(h1) else np.zeros(0, np.int64)
    return h1[first], h2[first], np.diff(np.r_[first, len(h1)])


def both_among(h1: np.ndarray, h2: np.ndarray, known: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Which pairs are among the known ones."""
    known, second, _ = distinct(known, second)
    begin, end = np.searchsorted(known, h1, "left"), np.searchsorted(known, h1, "right")
    out = np.zeros(len(h1), bool)
    for k in range(int((end - begin).max(initial=0))):  # one turn, but for first hashes that collide
        at = np.minimum(begin + k, max(len(known) - 1, 0))
        out |= (begin + k < end) & (second[at] == h2)
    return out


def repeated_words(df: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 35, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of df: its id, n_words, n_removed, kept (the words left, joined by a space) and spans.

    A word goes if a window of consecutive words that covers it also starts anywhere else, in the same text or another, as
    texts were given. spans has the removed ranges of words, [begin, end). Null and empty texts have no words and keep an
    empty string; a text shorter than a window stays whole; ids may be null or repeat (all but the ids' own rows are
    kept apart), and of any type that text can stand for; an empty table gives an empty result. Other columns play no part.
    """
    kind = df.select(F.col(quoted(id_col))).schema[0].dataType
    carried = "long" if kind.typeName() == "long" else "string"  # other ids travel as text
    docs = df.select(F.col(quoted(id_col)).cast(carried).alias("id"), F.col(quoted(text)).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, bits = math.ceil(max(size, 1) / CHUNK), max(0, math.ceil(math.log2(max(1, size / BUCKET))))
    # rows that repeat are spread by their place, which matters to none of them
    dealt = docs.select(F.expr(f"cast(pmod(xxhash64(id, text, monotonically_increasing_id() % 4099), {chunks}) as int)").alias("chunk"), "id", "text")
    parts = "chunk int, bucket int, once binary, more binary"
    part_type = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])
    answer_type = pa.schema([("chunk", pa.int32()), ("found", pa.binary())])
    pair_type = pa.schema([*answer_type, ("second", pa.binary())])
    out_type = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))])

    def rows(items: list[tuple], schema: pa.Schema) -> pa.Table:
        return pa.table([pa.array(x, t) for x, t in zip(zip(*items), schema.types)], schema=schema) if items else schema.empty_table()

    def heard(answers: pa.Table) -> np.ndarray:
        return np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in answers["found"].to_pylist())]))

    def among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
        return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)

    def name(chunk: pa.Table) -> pa.Table:
        names, count = np.unique(parsed(Words(chunk["text"]), rounds)[0], return_counts=True)
        k = chunk["chunk"][0].as_py()
        return rows([(k, *x) for x in blobs(names, bits, (count > 1).astype(np.uint8))], part_type)

    def named(bucket: pa.Table) -> pa.Table:
        own = [np.frombuffer(x, np.uint64) for x in bucket["once"].to_pylist()]
        more = np.concatenate([np.frombuffer(x, np.uint8) for x in bucket["more"].to_pylist()])
        every = np.concatenate(own)
        order = np.argsort(every, kind="stable")
        s = every[order]
        twin = np.r_[False, s[1:] == s[:-1]]
        twin[:-1] |= twin[1:]
        twin |= more[order] > 0
        flags = np.zeros(len(s), bool)
        flags[order] = twin
        cut = np.cumsum([0, *map(len, own)]).tolist()
        return rows([(k, h[f].tobytes()) for k, h, f in zip(bucket["chunk"].to_pylist(), own, (flags[a:b] for a, b in zip(cut, cut[1:]))) if f.any()], answer_type)

    def candidates(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(chunk):
            return part_type.empty_table()
        words = Words(chunk["text"])
        at, h1, h2 = words.windows(window)
        names, owner, lo, hi = parsed(words, rounds)
        alone = ~among(names, heard(answers)) & (lo > -FAR) & (hi < FAR) & (hi - lo <= window)
        a, b = np.maximum(hi[alone] - window, words.starts[owner[alone]]), lo[alone] + 1
        ruled = np.bincount(a, minlength=len(words.names) + 1) - np.bincount(b, minlength=len(words.names) + 1)
        open_ = np.cumsum(ruled)[at] == 0
        h1, h2, count = distinct(h1[open_], h2[open_] >> np.uint32(1))
        # whether the chunk has several takes the lowest bit of the second hash
        return rows([(chunk["chunk"][0].as_py(), *x) for x in blobs(h1, bits, h2 << np.uint32(1) | (count > 1).astype(np.uint32))], part_type)

    def verified(bucket: pa.Table) -> pa.Table:
        own = [np.frombuffer(x, np.uint64) for x in bucket["once"].to_pylist()]
        second = np.concatenate([np.frombuffer(x, np.uint32) for x in bucket["more"].to_pylist()])
        every = np.concatenate(own)
        order = np.lexsort((second, every))
        s, t = every[order], second[order] >> np.uint32(1)
        twin = np.r_[False, (s[1:] == s[:-1]) & (t[1:] == t[:-1])]
        twin[:-1] |= twin[1:]
        twin |= (second[order] & np.uint32(1)) > 0
        flags = np.zeros(len(s), bool)
        flags[order] = twin
        cut = np.cumsum([0, *map(len, own)]).tolist()
        return rows([(k, h[f].tobytes(), u[f].tobytes()) for k, h, u, f in zip(bucket["chunk"].to_pylist(), own, (second[a:b] >> np.uint32(1) for a, b in zip(cut, cut[1:])), (flags[a:b] for a, b in zip(cut, cut[1:]))) if f.any()], pair_type)

    def cut(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(chunk):
            return out_schema.empty_table()
        words = Words(chunk["text"])
        at, h1, h2 = words.windows(window)
        known, second = (np.concatenate([np.zeros(0, t), *(np.frombuffer(x, t) for x in answers[c].to_pylist())]) for c, t in (("found", np.uint64), ("second", np.uint32)))
        at = at[both_among(h1, h2 >> np.uint32(1), known, second)]
        edge = np.bincount(at, minlength=len(words.names) + 1) - np.bincount(at + window, minlength=len(words.names) + 1)
        gone = np.cumsum(edge)[:-1] > 0
        kept_n = np.bincount(words.owner[~gone], minlength=len(chunk))
        kept = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(kept_n)], pa.int32()), words.flat.filter(pa.array(~gone)))
        change = np.r_[True, (gone[1:] != gone[:-1]) | (words.owner[1:] != words.owner[:-1])] if len(gone) else np.zeros(0, bool)
        begin = np.flatnonzero(change)
        end = np.r_[begin[1:], len(gone)] if len(begin) else begin
        begin, end = (x[gone[begin]] for x in (begin, end))
        whose = words.owner[begin]
        spans = pa.StructArray.from_arrays([pa.array(x - words.starts[whose]) for x in (begin, end)], ["begin", "end"])
        spans = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(whose, minlength=len(chunk)))], pa.int32()), spans)
        return pa.table([chunk["id"].combine_chunks(), pa.array(words.counts), pa.array(words.counts - kept_n), pc.binary_join(kept, " "), spans], schema=out_schema)

    out_schema = out_type.set(0, pa.field("id", pa.string())) if carried == "string" else out_type
    learnt = dealt.groupBy("chunk").applyInArrow(name, parts).groupBy("bucket").applyInArrow(named, "chunk int, found binary")
    asked = dealt.groupBy("chunk").cogroup(learnt.groupBy("chunk")).applyInArrow(candidates, parts)
    told = asked.groupBy("bucket").applyInArrow(verified, "chunk int, found binary, second binary")
    done = dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(cut, f"id {carried}, n_words long, n_removed long, kept string, spans array<struct<begin:long,end:long>>")
    return done.select(F.col("id").cast(kind).alias(id_col), "n_words", "n_removed", "kept", "spans")
