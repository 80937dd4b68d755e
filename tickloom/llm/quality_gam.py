"""Quality classifier: a generalised additive model with pairwise interactions.

Figures of each text are cut into bins. Boosting goes round and round the figures, each turn adding a shallow tree on that
figure alone, so that a figure's trees sum up to one lookup table over its bins; the pairs with the largest
remaining gain get two-way tables in the same manner. A score is the sum of the looked-up values. The model is fitted on
a bounded sample of labelled rows (FIT_ROWS) on the driver; figures and scores are computed for all texts by Spark.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import bound_batches, own_columns, quoted

#: At most about so many labelled rows are fitted, taken by a hash of their id; fewer if there are fewer.
FIT_ROWS = 30_000
BINS, PAIR_BINS, PAIRS = 32, 12, 8
FIGURES = (
    "words", "word_len", "symbols", "digits", "upper", "foreign", "dup_lines", "dup_trigrams", "distinct", "top_word", "doubled",
    "line_words", "lines", "closed_lines", "stops", "bare", "deflated", "long_words", "short_words", "bigrams", "bytes_entropy",
)
SYMBOLS, DIGITS, UPPERS, STOPS, LETTERS = b"#*$%&|<>{}[]\\^~=_+@", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:!?", b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def figures(text: str | None) -> tuple[float, ...]:
    """A text's figures; those of null and of texts without words are those of an empty text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return (0.0,) * len(FIGURES)
    size, count = len(raw), Counter(words)
    chars = sum(map(len, words))
    kinds = [size - len(raw.translate(None, x)) for x in (SYMBOLS, DIGITS, UPPERS, STOPS)]
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    seen = Counter(lines)
    repeated = sum(len(x) * (k - 1) for x, k in seen.items() if k > 1)
    trigrams, bigrams = Counter(zip(words, words[1:], words[2:])), set(zip(words, words[1:]))
    lengths = list(map(len, words))
    freq = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    p = freq[freq > 0] / size
    return (
        math.log1p(n), chars / n, kinds[0] / size, kinds[1] / size, kinds[2] / size, (raw.count(b"\xc3") + raw.count(b"\xc5")) / size, repeated / size,
        1 - len(trigrams) / (n - 2) if n > 2 else 0.0, len(count) / n**0.85, max(count.values()) / n, sum(map(bytes.__eq__, words, words[1:])) / n,
        math.log1p(n / len(lines)), math.log1p(len(lines)), sum(x.rstrip()[-1:] in b".!?\"" for x in lines) / len(lines), kinds[3] / n,
        sum(not w.translate(None, SYMBOLS + DIGITS + STOPS) for w in words) / n, len(zlib.compress(raw, 1)) / (size + 20),
        sum(x > 14 for x in lengths) / n, sum(x < 3 for x in lengths) / n, 1 - len(bigrams) / (n - 1) if n > 1 else 0.0, float(-(p * np.log2(p)).sum()),
    )


def with_figures(df: DataFrame, text: str = "text", name: str = "figures") -> DataFrame:
    """df and a struct of its text's figures."""
    bound_batches(df.sparkSession)

    @F.pandas_udf(T.StructType([T.StructField(x, T.DoubleType()) for x in FIGURES]))
    def go(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([figures(x) for x in texts], columns=FIGURES, dtype="float64")

    return df.select(*(F.col(quoted(c)) for c in own_columns(df, name)), go(F.col(quoted(text))).alias(name))


@dataclass
class Gam:
    """Bin edges, one table for each figure, and tables for pairs of figures."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), int)

    def coarse(self, j: int, b: np.ndarray) -> np.ndarray:
        """Bins of figure j as those of pair tables."""
        return b * PAIR_BINS // (len(self.edges[j]) + 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b, s = self.binned(x), np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            s += t[b[:, j]]
        for i, j, t in self.pairs:
            s += t[self.coarse(i, b[:, i]), self.coarse(j, b[:, j])]
        return 1 / (1 + np.exp(-s))


def leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 5.0)


def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 5.0)


def tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Values over bins of a tree that splits an ordered range greedily."""
    parts, (cg, ch) = [(0, len(g))], (np.r_[0, np.cumsum(x)] for x in (g, h))
    while len(parts) < leaves:
        best = (1e-9, None)
        for k, (a, b) in enumerate(parts):
            if b - a > 1:
                m = np.arange(a + 1, b)
                total = gain(cg[m] - cg[a], ch[m] - ch[a]) + gain(cg[b] - cg[m], ch[b] - ch[m]) - gain(cg[b] - cg[a], ch[b] - ch[a])
                i = int(np.argmax(total))
                if total[i] > best[0]:
                    best = (total[i], (k, int(m[i])))
        if best[1] is None:
            break
        k, m = best[1]
        parts[k : k + 1] = [(parts[k][0], m), (m, parts[k][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = leaf(cg[b] - cg[a], ch[b] - ch[a])
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of a tree that splits rows once and each side's columns once."""
    cg, ch = (np.cumsum(np.cumsum(x, 0), 1) for x in (g, h))
    best, out = 0.0, np.zeros_like(g)
    if len(g) < 2 or len(g[0]) < 2:
        return best, out
    sides = []
    for lo_g, lo_h in ((cg[:-1], ch[:-1]), (cg[-1] - cg[:-1], ch[-1] - ch[:-1])):  # rows up to i, rows after i
        total = gain(lo_g[:, :-1], lo_h[:, :-1]) + gain(lo_g[:, -1:] - lo_g[:, :-1], lo_h[:, -1:] - lo_h[:, :-1])
        at = total.argmax(axis=1)
        sides.append((total[np.arange(len(at)), at], at, lo_g, lo_h))
    i = int(np.argmax(sides[0][0] + sides[1][0]))
    for (_, at, sg, sh), rows in zip(sides, (slice(0, i + 1), slice(i + 1, None))):
        j = int(at[i])
        out[rows, : j + 1] = leaf(sg[i, j], sh[i, j])
        out[rows, j + 1 :] = leaf(sg[i, -1] - sg[i, j], sh[i, -1] - sh[i, j])
    return float(sides[0][0][i] + sides[1][0][i] - gain(cg[-1, -1], ch[-1, -1])), out


def fit(x: np.ndarray, y: np.ndarray, cycles: int = 150, rate: float = 0.1, pair_cycles: int = 60) -> Gam:
    """Without both labels, a model whose score is the smoothed share of label 1 (0.5 without rows)."""
    model = Gam(math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    if len(np.unique(y)) < 2:
        return model
    model.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    # a figure that is mostly one value still gets bins among the others
    model.edges = [np.unique(np.r_[e, np.quantile(c[c > e[-1]], [0.25, 0.5, 0.75])]) if len(e) < BINS // 2 and (c > e[-1]).any() else e for e, c in zip(model.edges, x.T)]
    b = model.binned(x)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    s = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-s))
        return y - p, p * (1 - p)

    for _ in range(cycles):
        for j, t in enumerate(model.tables):
            g, h = slopes()
            add = rate * tree(np.bincount(b[:, j], g, len(t)), np.bincount(b[:, j], h, len(t)))
            t += add
            s += add[b[:, j]]
    at = [model.coarse(j, b[:, j]) for j in range(len(model.edges))]

    def both(i: int, j: int, g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        cell = at[i] * PAIR_BINS + at[j]
        return pair_tree(*(np.bincount(cell, v, PAIR_BINS * PAIR_BINS).reshape(PAIR_BINS, PAIR_BINS) for v in (g, h)))

    g, h = slopes()
    order = sorted(((both(i, j, g, h)[0], i, j) for i in range(len(at)) for j in range(i)), reverse=True)
    model.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for _, i, j in order[:PAIRS]]
    for _ in range(pair_cycles):
        for i, j, t in model.pairs:
            add = rate * both(i, j, *slopes())[1]
            t += add
            s += add[at[i], at[j]]
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """True for rows that are never learnt from."""
    return F.coalesce(F.crc32(F.col(quoted(id_col)).cast("string")) % 4 == 2, F.lit(False))


def learnt(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> Gam:
    """The model of at most about rows labelled texts that are not held out; null labels and ids don't count.

    An id with several labels has their majority; label 1 wins a tie. Of an id's several texts the least counts.
    """
    marked = labels.select(F.col(quoted(id_col)).alias("__id"), F.col(quoted(label)).alias("__y")).where("__id is not null and __y is not null").where(~held_out("__id"))
    marked = marked.groupBy("__id").agg((F.avg("__y") >= 0.5).cast("int").alias("__y"))
    total = marked.count()
    part = marked.where(F.expr(f"pmod(xxhash64(__id, 11), 1000000) < {math.ceil(1e6 * rows / total)}")) if total > rows else marked
    texts = df.select(F.col(quoted(id_col)).alias("__id"), F.col(quoted(text)).alias("__text"))
    # at most `rows` ids, those of the least hashes, go to all tasks, and as many rows of numbers come back, whatever the input
    part = part.orderBy(F.xxhash64("__id", F.lit(11)), "__id").limit(rows) if total > rows else part
    own = texts.join(F.broadcast(part), "__id").groupBy("__id", "__y").agg(F.min("__text").alias("__text"))
    got = with_figures(own, "__text").select("__id", "__y", "figures.*").toPandas()
    got = got.sort_values(["__id", *FIGURES])
    return fit(got[list(FIGURES)].to_numpy(float), got["__y"].to_numpy(float))


def with_score(df: DataFrame, model: Gam, text: str = "text", name: str = "score") -> DataFrame:
    """df and a score between 0 and 1 of its text, null or not."""
    bound_batches(df.sparkSession)

    @F.pandas_udf("double")
    def go(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(np.array([figures(x) for x in texts], float).reshape(-1, len(FIGURES))))

    return df.select(*(F.col(quoted(c)) for c in own_columns(df, name)), go(F.col(quoted(text))).alias(name))


def quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.7, rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of df: its id, held_out, score (higher: label 1 likelier) and predicted (1 from threshold on).

    Texts alone make the score. Null and empty texts are scored alike. Rows with a null id are scored, never learnt from;
    ids that repeat are scored row by row. Without labels the score is 0.5; an empty table gives an empty result.
    """
    done = with_score(df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text)).alias("text")), learnt(df, labels, id_col, text, label, rows))
    return done.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.7, rows: int = FIT_ROWS) -> DataFrame:
    """The rows of df that the classifier of quality() doesn't reject, other columns and all."""
    return with_score(df, learnt(df, labels, id_col, text, label, rows), text, "__score").where(F.col("__score") >= threshold).select(*(F.col(quoted(c)) for c in df.columns))
