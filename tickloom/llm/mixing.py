"""Mixing sources to target weights: soft-membership mixing, with DataFrame operations alone.

A classifier learnt from a table of labels gives each text a probability for each domain. Every text then has a rate, how often it is
to be taken; the expected tokens of a domain are the sum over texts of rate x tokens x probability. Projected-gradient
least squares moves the rates, from 1 each and within their bounds, until those sums meet the targets. An iteration is one pass
over a table of tokens and probabilities that returns one number for each domain; a rate is an expression of the
steps so far.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Collection, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import own_columns, quoted, written

#: Labelled texts that the classifier learns from, at most; words of a domain's list; cells of a figure.
FIT_ROWS, WORDS, CELLS = 20_000, 24, 16
SPACES, MARKS = r"[\x20\x09-\x0D]+", '.,;:!?"()'


def among(words: Collection[str]) -> Callable[[Column], Column]:
    return lambda w: w.isin(*words)


def with_figures(df: DataFrame, text: str, listed: Collection[str] = ()) -> DataFrame:
    """df with __n, the number of words, the figures that cells are made of, and __hits: the words that are in some list.

    The text is cut into words once; all that follows looks at the array.
    """
    t = F.coalesce(F.col(quoted(text)), F.lit(""))
    df = df.withColumns({"__words": F.filter(F.split(F.lower(t), SPACES), lambda w: w != ""), "__lines": F.split(t, "\n"), "__signs": F.regexp_count(t, F.lit(r"[#*$%&|<>]")), "__size": F.length(t)})
    hits = F.filter(F.transform("__words", lambda w: F.rtrim(w, F.lit(MARKS))), among(listed)) if listed else F.array().cast("array<string>")
    return df.select(*(c for c in df.columns if c not in ("__words", "__lines")), F.size("__words").cast("long").alias("__n"), F.size("__lines").alias("__line"), F.size(F.array_distinct("__lines")).alias("__kinds"), hits.alias("__hits"))


def cell(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(CELLS - 1), F.floor(x))).cast("int")


def cells(lists: list[list[str]]) -> list[Column]:
    """Each figure's cell, 0 to CELLS - 1: length, word length, signs, repeated lines, line length, and words of each list."""
    n = F.greatest(F.col("__n"), F.lit(1))
    out = [cell(F.log2(n)), cell(2 * F.col("__size") / n - 4), cell(60 * F.col("__signs") / F.greatest(F.col("__size"), F.lit(1))), cell(16 * (1 - F.col("__kinds") / F.col("__line"))), cell(2 * F.log2(1 + n / F.col("__line")))]
    for words in lists:
        if words:
            out.append(cell(F.size(F.filter("__hits", among(words))) * 300 / F.greatest(n, F.lit(100))))
    return out


def word_lists(marked: DataFrame, sizes: Mapping[str, int]) -> dict[str, list[str]]:
    """For each domain, the words whose share of its texts exceeds most clearly their share of the others'."""
    words = F.transform(F.split(F.lower(F.coalesce("text", F.lit(""))), SPACES), lambda w: F.rtrim(w, F.lit(MARKS)))
    counts = marked.select("domain", F.explode(F.array_distinct(words)).alias("w")).where("length(w) > 1").groupBy("domain", "w").agg(F.count("*").alias("own"))
    known = F.from_json(F.lit(json.dumps(dict(sizes))), "map<string,bigint>")
    size, total = F.element_at(known, F.col("domain")), sum(sizes.values())
    every = counts.groupBy("w").agg(F.sum("own").alias("all")).where("all >= 8")
    score = F.log((F.col("own") + 0.5) / (size + 1) / ((F.col("all") - F.col("own") + 0.5) / (total - size + 1))) * F.sqrt("own")
    rank = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("score"), "w"))
    top = counts.join(every, "w").withColumn("score", score).where("score > 12").withColumn("k", rank).where(F.col("k") <= WORDS).orderBy("domain", "k").select("domain", "w")
    out: dict[str, list[str]] = {}
    for d, w in top.collect():  # WORDS for each domain at most
        out.setdefault(d, []).append(w)
    return out


def sampled_labels(marks: DataFrame, rows: int) -> DataFrame:
    """marks (__id, ...), one row for each id: those of the `rows` least hashes of their id."""
    total = marks.count()
    if total <= rows:
        return marks
    draw = F.pmod(F.xxhash64("__id", F.lit(13)), F.lit(1 << 40))
    # the filter leaves a little more than is wanted, so that few rows are sorted
    return marks.where(draw < math.ceil((1 << 40) * min(1.0, 1.05 * rows / total + 100 / total))).orderBy(draw, "__id").limit(rows)


def posteriors(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "domain", rows: int = FIT_ROWS) -> tuple[DataFrame, list[str]]:
    """df with __n (words of its text) and __p: the probability of each domain, in the order of the returned names.

    labels has an id and a domain; nulls don't count, of several labels of an id the least counts, and so does the least of several
    texts. At most `rows` labelled texts are learnt from, those of the least hashes of their ids. Without labels there is one domain, `all`.
    """
    marks = labels.select(F.col(quoted(id_col)).alias("__id"), F.col(quoted(label)).cast("string").alias("domain")).where("__id is not null and domain is not null").groupBy("__id").agg(F.min("domain").alias("domain"))
    texts = df.select(F.col(quoted(id_col)).alias("__id"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))
    # no more than `rows` ids and labels go to all tasks, whatever the input
    marked = written(texts.join(F.broadcast(sampled_labels(marks, rows)), "__id").groupBy("__id", "domain").agg(F.min("text").alias("text")), "marked")
    sizes = dict(marked.groupBy("domain").count().collect())
    domains, total = sorted(sizes) or ["all"], sum(sizes.values())
    by_domain = word_lists(marked, sizes)
    lists = [by_domain.get(d, []) for d in domains]
    listed = sorted({w for x in lists for w in x})
    figures = with_figures(marked, "text", listed).select("domain", F.posexplode(F.array(*cells(lists))).alias("figure", "cell"))
    counts = {(r["domain"], r["figure"], r["cell"]): r["count"] for r in figures.groupBy("domain", "figure", "cell").count().collect()}
    columns = cells(lists)
    # the tables of the classifier are one constant: figure, cell, domain
    tables = [[[math.log((counts.get((d, j, c), 0) + 0.5) / (sizes.get(d, 0) + 0.5 * CELLS)) for d in domains] for c in range(CELLS)] for j in range(len(columns))]
    prior = [math.log((sizes.get(d, 0) + 1) / (total + len(domains))) for d in domains]
    table, start = F.from_json(F.lit(json.dumps(tables)), "array<array<array<double>>>"), F.from_json(F.lit(json.dumps(prior)), "array<double>")
    out = with_figures(df, text, listed).withColumn("__cells", F.array(*columns))
    score = F.aggregate(F.sequence(F.lit(0), F.lit(len(columns) - 1)), start, lambda s, j: F.zip_with(s, table[j][F.col("__cells")[j]], lambda a, b: a + b))
    out = out.withColumn("__s", score).withColumn("__e", F.transform("__s", lambda x: F.exp(x - F.array_max("__s"))))
    p = F.transform("__e", lambda x: x / F.aggregate("__e", F.lit(0.0), lambda a, b: a + b))
    return out.select(*(F.col(quoted(c)) for c in df.columns), "__n", p.alias("__p")), domains


def dot(p: Column, x: Column) -> Column:
    return F.aggregate(F.zip_with(p, x, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def moved(steps: list[tuple[float, list[float]]], least: Column, most: float) -> Column:
    """The rate after steps (momentum, move) from 1: each takes p . move off, then goes on by momentum x what the step changed, within bounds."""
    if not steps:
        return F.lit(1.0)
    given = F.from_json(F.lit(json.dumps([{"m": m, "x": x} for m, x in steps])), "array<struct<m:double,x:array<double>>>")
    inside = lambda r: F.greatest(least, F.least(r, F.lit(most)))
    # s: the rate, and where the last step led before momentum
    start = F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("led"))
    stepped = F.aggregate(given, start, lambda s, g: carried(inside(s["rate"] - dot(F.col("__p"), g["x"])), s["led"], g["m"], inside))
    return stepped["rate"]


def carried(now: Column, before: Column, momentum: Column, inside: Callable[[Column], Column]) -> Column:
    return F.struct(inside(now + momentum * (now - before)).alias("rate"), now.alias("led"))


def rate(table: DataFrame, domains: list[str], weights: Mapping[str, float], tokens: float | None = None, size: str = "same", spare: bool = False, ceilings: Collection[str] = (), most: int = 80, close: float = 2e-4) -> tuple[Column, dict[str, float]]:
    """The rate of each row of table (__n, __p) as an expression of __p, and by how much each domain misses its target, as a share of all tokens.

    weights are the domains' shares of the tokens, scaled down if they sum up to over 1; domains without one share the
    rest as at present. size says how many tokens there are to be: `same` as at hand (or `tokens`), `up` as many as it takes for
    no domain to shrink, `down` as many as leave no domain larger, with no rate above 1. spare keeps the rate at 1 or more
    where domains that are to shrink are not likelier than the others. The weights of `ceilings` are
    upper bounds: such a domain keeps its present share if that is less, and spare then protects from these domains, whichever shrink.

    The objective is the squared distance of the domains' expected tokens from their targets, each in units of its present tokens. In
    that metric a gradient step of length 1 never overshoots, since no row's probabilities exceed 1 in sum. Steps carry
    momentum, which restarts when the distance grows. Where bounds keep the targets out of reach, or `most` steps are not enough,
    the second result says what is missing.
    """
    k_all, n = range(len(domains)), F.col("__n").cast("double")

    def sums(r: Column) -> list[float]:
        got = table.select(F.posexplode(F.transform("__p", lambda x: n * r * x)).alias("k", "t")).groupBy("k").agg(F.sum("t").alias("t"))
        found = dict(got.collect())  # one number for each domain
        return [found.get(k) or 0.0 for k in k_all]

    now = sums(F.lit(1.0))
    whole = sum(now)
    if not whole:
        return F.lit(1.0), dict.fromkeys(domains, 0.0)
    present = dict(zip(domains, now))
    weights = {d: min(w, present[d] / whole) if d in ceilings and d in present else w for d, w in weights.items()}
    given = {d: w for d, w in weights.items() if d in domains}
    total_w = max(1.0, sum(weights.values()))
    rest = sum(now[k] for k, d in enumerate(domains) if d not in given)
    share = [given[d] / total_w if d in given else max(0.0, 1 - sum(given.values()) / total_w) * now[k] / rest if rest else 0.0 for k, d in enumerate(domains)]
    share = [x / (sum(share) or 1.0) for x in share]
    fits = [now[k] / share[k] for k in k_all if share[k] > 0] or [whole]
    budget = {"up": max(fits), "down": min(fits), "same": whole if tokens is None else float(tokens)}[size]
    target = [budget * x for x in share]
    shrinks = [k for k, d in enumerate(domains) if (d in ceilings if ceilings else target[k] < now[k])]
    shrink = sum((F.col("__p")[k] for k in shrinks), F.lit(0.0))
    least, bound = F.when(shrink <= 0.5, 1.0).otherwise(0.0) if spare else F.lit(0.0), 1.0 if size == "down" else math.inf
    steps: list[tuple[float, list[float]]] = []
    speed, last, best, done = 1.0, math.inf, math.inf, 0
    for turn in range(most):
        miss = [a - b for a, b in zip(sums(moved(steps, least, bound)) if steps else now, target)]
        reached = max(map(abs, miss))
        if reached < 0.999 * best:
            best, done = reached, turn
        if reached <= close * budget or turn - done > 6:
            break  # met, or as near as the bounds let it come
        distance = sum(e * e / c for e, c in zip(miss, now) if c)
        before, speed = (1.0, 1.0) if distance > last else (speed, (1 + math.sqrt(1 + 4 * speed * speed)) / 2)
        last = distance
        steps.append(((before - 1) / speed, [e / c if c else 0.0 for e, c in zip(miss, now)]))
    return moved(steps, least, bound), {d: e / whole for d, e in zip(domains, miss)}


def quality_domains(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, domain): `toxic`, else `low` or `high` by quality."""
    return labels.select(id_col, F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "high").alias("domain"))


def mixed(df: DataFrame, labels: DataFrame, weights: Mapping[str, float], id_col: str = "doc_id", text: str = "text", tokens: float | None = None, size: str = "same") -> DataFrame:
    """One row per row of df: its id, n_tokens, rate, posterior (a struct with a probability for each domain), and missed.

    Tokens are words. Null and empty texts have none: they have the rate of the domains that they resemble and change no total. Rows
    that repeat, or tie in all figures, have equal rates and come back as often; an id may be null. With no labels, all texts are of
    one domain and the rate is that which meets the number of tokens. missed is the largest distance of a domain from its target, as a share
    of all tokens, the same in each row. An empty table gives an empty result. Other columns play no part.
    """
    table, domains = posteriors(df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text)).alias("text")), labels.withColumnRenamed(id_col, "id"), "id")
    table = written(table.drop("text"), "posteriors")
    found, miss = rate(table, domains, weights, tokens, size)
    return table.select(F.col("id").alias(id_col), F.col("__n").alias("n_tokens"), found.alias("rate"), F.struct(*(F.col("__p")[k].alias(d) for k, d in enumerate(domains))).alias("posterior"), F.lit(max(map(abs, miss.values()))).alias("missed"))


def resampled(df: DataFrame, labels: DataFrame, weights: Mapping[str, float], id_col: str = "doc_id", text: str = "text", tokens: float | None = None, size: str = "up", spare: bool = False, ceilings: Collection[str] = ()) -> DataFrame:
    """df's rows, each as often as its rate says: the whole part, and once more with the chance of the rest.

    The chance is a hash of id and text, so the same table gives the same rows, and rows that repeat fare alike. With size `up`, no domain
    shrinks and so hardly any row goes; with `down`, no row comes twice; with spare, none goes that is likely of a domain that doesn't shrink.
    ceilings are as for rate(). Null ids, null and empty texts are drawn like any others; without labels, or of an empty table, all rows
    stay. All columns are kept.
    """
    cols = own_columns(df)
    table, domains = posteriors(df, labels, id_col, text)
    table = written(table, "posteriors")  # once, texts and all, or each use of a probability would work it out anew
    out = table.withColumn("__rate", rate(table.select("__n", "__p"), domains, weights, tokens, size, spare, ceilings)[0])
    chance = F.expr(f"pmod(xxhash64({quoted(id_col)}, {quoted(text)}, 17), 1000000)") / 1e6
    times = (F.floor("__rate") + (chance < F.col("__rate") - F.floor("__rate")).cast("int")).cast("int")
    return out.withColumn("__times", times).where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*(F.col(quoted(c)) for c in cols))
