"""Packing by vector bin packing.

Examples have three demands: tokens, segments and loss-bearing tokens. A sequence has a limit on each. The dot-product
heuristic fills one sequence after another: of the examples that still fit, the one goes in whose demand vector, in
shares of the limits, has the largest dot product with what is left of them. Examples are dealt by hash into pools of
bounded size and each pool is packed in one task, so pools run side by side and padding is lost only at a pool's end.
"""

from __future__ import annotations

import functools
import itertools
import json
import math
import os
import string
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import bound_batches, own_columns, quoted, written

#: Examples in a pool, on average: what one task packs.
POOL = 8192
#: Words whose ids a worker remembers, twice: those met lately, and those before. Rows that it takes at a time.
REMEMBERED, AT_ONCE = 250_000, 2048
#: Words that the tokenizer takes at a time.
SLICE = 4096
#: What may stand behind letters as a piece of its own: nothing that the tokenizer takes for a letter, a number or white space.
PUNCTUATION = string.punctuation


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 512
    loss: int = 2048


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_chars() -> dict[int, str]:
    """The character that byte-level tokenizers write for each byte: itself if it shows, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(shown)))}


BYTE_CHARS = byte_chars()


def one_piece(word: str) -> bool:
    """Whether the tokenizer's normalizer and patterns leave word as it is, whole."""
    return word.isalpha() and word == word.lower() and unicodedata.is_normalized("NFC", word) and "σ" not in word and "ς" not in word


def places(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n places from each begin on, one after another."""
    out = np.repeat((begin - (np.cumsum(n) - n)).astype(np.int32), n)
    out += np.arange(len(out), dtype=np.int32)
    return out


class WordIds:
    """A tokenizer's ids of whole texts, by way of their words.

    Only for tokenizers that drop white space: there the ids of a text are those of its words, one after another, and
    those of letters with punctuation behind them are those of both parts. Ids always come from the tokenizer's own
    model; letters alone skip its normalizer and patterns, which leave them one piece, in lower case.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        spec = json.loads(self.full.to_str())
        if spec["normalizer"]["normalizers"] != [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]:
            raise ValueError("words are only taken apart for a tokenizer that drops white space and ignores case")
        if spec["pre_tokenizer"]["pretokenizers"][1:] != [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]:
            raise ValueError("letters only go to the model of a tokenizer that takes them as bytes")
        self.model = self.full.model
        self._keep(pa.array([], pa.string()), np.empty(0, np.int64), np.empty(0, "<u4"))

    def _keep(self, names: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        """What is known: words, and their ids one after another."""
        self.names, self.sizes, self.ids = names, sizes, ids
        self.met = np.zeros(len(names), bool)

    def _forget(self) -> None:
        """What was met again in time stays."""
        if np.count_nonzero(self.met) > REMEMBERED:
            sizes = self.sizes[self.met]
            self._keep(self.names.filter(pa.array(self.met)), sizes, self.ids[places((np.cumsum(self.sizes) - self.sizes)[self.met], sizes)])

    def _learn(self, words: pa.Array) -> np.ndarray:
        """The numbers of words that aren't known yet.

        Words that aren't letters alone in slices: the tokenizer's own records of a word take many times what is kept of it.
        """
        tokenize, ids, sizes = self.model.tokenize, [], []
        ascii = pc.and_(pc.ascii_is_alpha(words), pc.ascii_is_lower(words))
        letters, rest = (words.filter(x).to_pylist() for x in (ascii, pc.invert(ascii)))
        whole, others = [], []
        for w in rest:
            (whole if one_piece(w) else others).append(w)
        for w in itertools.chain(letters, (w.encode().decode("latin-1").translate(BYTE_CHARS) for w in whole)):
            found = tokenize(w)
            sizes.append(len(found))
            ids += [t.id for t in found]
        for part in itertools.batched(others, SLICE):
            for e in self.full.encode_batch_fast(list(part), add_special_tokens=False):
                sizes.append(len(e.ids))
                ids += e.ids
        fresh = pa.array(letters + whole + others, pa.string())
        self.names, n = pa.concat_arrays([self.names, fresh]), len(self.names)
        self.sizes, self.ids = np.r_[self.sizes, np.array(sizes, np.int64)], np.r_[self.ids, np.array(ids, "<u4")]
        self.met = np.r_[self.met, np.ones(len(sizes), bool)]
        return n + pc.index_in(words, value_set=fresh).to_numpy()

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """The number of each of these different words among what is known."""
        found = pc.index_in(words, value_set=self.names)
        at = pc.fill_null(found, -1).to_numpy().copy()
        self.met[at[at >= 0]] = True
        if found.null_count:
            at[at < 0] = self._learn(words.filter(pc.is_null(found)))
        return at

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of different words, and how many each has.

        Letters go without their case and apart from punctuation behind them, so that few different words are left.
        """
        self._forget()
        core = pc.ascii_rtrim(words, characters=PUNCTUATION)
        # İ is two letters for the tokenizer
        plain = pc.and_not(pc.utf8_is_alpha(core), pc.match_substring(core, "İ"))
        head = pc.if_else(plain, pc.utf8_lower(core), words)
        tail = pc.if_else(plain, pc.replace_substring_regex(words, "^[^[:punct:]]+", ""), "")
        parts = pa.concat_arrays([head, tail]).dictionary_encode()
        at = self._numbers(parts.dictionary)[parts.indices.to_numpy()].reshape(2, -1).T.ravel()
        n = self.sizes[at]
        return self.ids[places((np.cumsum(self.sizes) - self.sizes)[at], n)], n.reshape(-1, 2).sum(axis=1)

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin and end."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        ids, sizes = self.of_words(coded.dictionary.cast(pa.string()))
        at = coded.indices.to_numpy()
        n = sizes[at]
        ids = ids[places((np.cumsum(sizes) - sizes)[at], n)]
        return ids, np.r_[0, np.cumsum(n)][split.offsets.to_numpy()]


@functools.lru_cache(1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_pieces(df: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int = 1, size: int = 2048) -> DataFrame:
    """Pieces of at most size ids of each text: id, start, length, ids_crc32, doc_tokens. The id `end` closes each text.

    Every piece of a text but the last is full. Null and empty texts are the closing id alone. The tokenizer's file must
    be at the same place on all machines.
    """
    bound_batches(df.sparkSession)
    path = tokenizer or default_tokenizer()
    last = np.array([end], "<u4").tobytes()
    kind = df.schema[id_col].dataType.simpleString()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for batch in batches:
            for a in range(0, len(batch), AT_ONCE):
                part = batch.slice(a, AT_ONCE)
                ids, at = words.of_texts(part.column(1))
                raw, out = memoryview(ids.tobytes()), []
                for i, (x, y) in enumerate(zip(at.tolist(), at[1:].tolist())):
                    total = y - x + 1
                    for s in range(0, total, size):
                        n = min(size, total - s)
                        crc = zlib.crc32(raw[4 * (x + s) : 4 * min(x + s + n, y)])
                        out.append((i, s, n, zlib.crc32(last, crc) if s + n == total else crc, total))
                rows, *cols = np.array(out, np.int64).reshape(-1, 5).T
                del ids, raw
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), *map(pa.array, cols)], ["id", "start", "length", "ids_crc32", "doc_tokens"])
                pa.default_memory_pool().release_unused()

    return df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text)).alias("text")).mapInArrow(go, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long").withColumnRenamed("id", id_col)


def packed(demands: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The sequence of each example (a row of demands), by the dot-product heuristic; one over a limit is alone."""
    kinds, of = np.unique(demands, axis=0, return_inverse=True)
    of = of.ravel()
    order = np.argsort(of, kind="stable")
    begin = np.searchsorted(of[order], np.arange(len(kinds)))
    left = np.bincount(of, minlength=len(kinds))
    share, out, sequence = kinds / limits, np.empty(len(of), np.int64), 0
    over = (kinds > limits).any(axis=1)

    def take(kind: int) -> None:
        left[kind] -= 1
        out[order[begin[kind] + left[kind]]] = sequence

    for kind in np.flatnonzero(over):
        while left[kind]:
            take(kind)
            sequence += 1
    live = np.flatnonzero(left)
    # kinds stand by their first demand, so that those with room for it are the first ones; a column for each kind
    need, weight = np.ascontiguousarray(kinds[live].T), np.ascontiguousarray(share[live].T)
    for kind in live[np.argsort(-weight.sum(axis=0), kind="stable")].tolist():
        while left[kind]:  # the best for an empty sequence
            room, chosen = limits.copy(), kind
            while True:
                take(chosen)
                room -= kinds[chosen]
                if not left[chosen]:
                    at = np.searchsorted(live, chosen)
                    live, need, weight = np.delete(live, at), np.delete(need, at, axis=1), np.delete(weight, at, axis=1)
                n = np.searchsorted(need[0], room[0], "right")
                fits = (need[1:, :n] <= room[1:, None]).all(axis=0)
                if not fits.any():
                    break
                chosen = live[np.argmax(np.where(fits, (room / limits) @ weight[:, :n], -np.inf))]
            sequence += 1
    return out


def pack(examples: DataFrame, tokens: str = "tokens", segments: str = "segments", loss: str = "loss", limits: Limits = Limits(), pool: int = POOL) -> DataFrame:
    """examples with sequence_id and offset (its first token's place there).

    No sequence exceeds a limit, but for an example that exceeds one by itself: that is a sequence of its own. Null demands
    count as 0. All rows stay, repeated ones too; an empty table gives an empty result; columns named sequence_id
    and offset are replaced.
    """
    cols = own_columns(examples, "sequence_id", "offset")
    count = examples.count()
    pools = max(1, math.ceil(count / pool))
    caps = np.array([limits.tokens, limits.segments, limits.loss], np.int64)
    kept = examples.select(*(F.col(quoted(c)) for c in cols))
    dealt = kept.withColumns({"__d0": F.coalesce(F.col(quoted(tokens)).cast("long"), F.lit(0)), "__d1": F.coalesce(F.col(quoted(segments)).cast("long"), F.lit(0)), "__d2": F.coalesce(F.col(quoted(loss)).cast("long"), F.lit(0))})
    # rows that are alike are spread by their place, which matters to none of them
    dealt = dealt.withColumn("__pool", F.expr(f"cast(pmod(xxhash64({', '.join(quoted(c) for c in cols)}, monotonically_increasing_id() % 4099), {pools}) as int)"))

    def go(key: tuple, batch: pa.Table) -> pa.Table:
        d = np.stack([batch[f"__d{i}"].to_numpy() for i in range(3)], axis=1)
        order = np.lexsort(d.T)
        batch, d = batch.take(pa.array(order)), d[order]
        to = packed(d, caps)
        by = np.argsort(to, kind="stable")
        ends = np.cumsum(d[by, 0])
        first = np.r_[True, to[by][1:] != to[by][:-1]]
        base = (ends - d[by, 0])[first][np.cumsum(first) - 1]
        offset = np.empty(len(d), np.int64)
        offset[by] = ends - d[by, 0] - base
        out = batch.drop_columns(["__d0", "__d1", "__d2", "__pool"])
        return out.append_column("sequence_id", pa.array(to + (key[0].as_py() << 32))).append_column("offset", pa.array(offset))

    schema = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in kept.schema.fields)
    return dealt.groupBy("__pool").applyInArrow(go, f"{schema}, sequence_id long, offset long")


def packed_documents(df: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """Texts in sequences, a row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A text's tokens all bear loss and each piece is a segment. Texts longer than a sequence fill as many as they can.
    """
    # written, or each use of the pieces would call the tokenizer again
    pieces = written(token_pieces(df, id_col, text, tokenizer, size=min(limits.tokens, limits.loss)), "pieces")
    made = pack(pieces.withColumns({"segments": F.lit(1), "loss": F.col("length")}), "length", "segments", "loss", limits)
    return made.drop("segments", "loss")


def conversation_examples(turns: DataFrame, conv: str = "conv_id", role: str = "role", text: str = "text", tokenizer: str | None = None, answers: str = "assistant") -> DataFrame:
    """An example for each conversation: tokens, segments (turns) and loss, the tokens of turns whose role is `answers`.

    Null and empty turns are their closing id; a null role bears no loss; turns of a null conversation are one example; repeated turns
    count as often. An empty table gives an empty result. Other columns play no part.
    """
    sized = token_pieces(turns.select(F.struct(F.col(quoted(conv)).alias("c"), F.col(quoted(role)).alias("r")).alias("id"), F.col(quoted(text)).alias("text")), "id", "text", tokenizer, size=1 << 40)
    return sized.groupBy(F.col("id.c").alias(conv)).agg(F.sum("length").alias("tokens"), F.count("*").alias("segments"), F.coalesce(F.sum(F.when(F.col("id.r") == answers, F.col("length"))), F.lit(0)).alias("loss"))


def packed_conversations(turns: DataFrame, limits: Limits, conv: str = "conv_id", role: str = "role", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Conversations as wholes in sequences under all three limits: conv, tokens, segments, loss, sequence_id, offset.

    Odd turns count as in `conversation_examples`. A conversation beyond a limit has a sequence of its own, whole; an empty table gives an empty result.
    """
    return pack(written(conversation_examples(turns, conv, role, text, tokenizer), "examples"), "tokens", "segments", "loss", limits)
