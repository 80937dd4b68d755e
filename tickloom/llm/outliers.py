"""Quality rules: robust multivariate outliers, with DataFrame operations alone.

For each language and source, the minimum covariance determinant is sought from several starts: centre and covariance are taken over
the share of rows that lie nearest by the last estimate, again and again, until determinants settle; the estimate of the least
determinant counts. A last estimate weighs all rows that are not far. A row is rejected if its Mahalanobis distance is beyond the cutoff.

Rows are counted once, into cells of nearly equal statistics that keep the rows' exact sums; all steps look at cells, of which
a group has a bounded number however many rows it holds. Estimates lean on those of the language, and these on those of all rows, as
if PRIOR rows more were drawn from there, so that small groups need no rule of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import quoted, written

P = 4
#: Share of a group's rows that an estimate rests on; random starts beside that from the medians, and rows that each is made of; most concentration steps.
ALPHA, STARTS, START_ROWS, STEPS = 0.75, 4, 8, 30
#: Rows of the wider group that each estimate counts in.
PRIOR = 10
#: A group that has more than 1/HOT of all rows is looked up by broadcast: there are fewer than HOT of them.
HOT = 1000
#: A statistic's least standard deviation: differences well below it mean nothing, even where all rows are alike. Where they are, each
#: statistic can reject by itself: words a tenth longer or shorter, half a sign in 100 letters, or 8 % of repeated lines or words.
FLOORS = (0.02, 0.1, 0.5, 0.5)
#: Statistics that most texts have none of and good ones may have: lines and words that repeat.
REPEATS = (2, 3)
#: Share of a normal group's rows that the cutoff leaves.
CUTOFF = 0.999
WORD, SPACES = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]+"
KEYS = ["__lang", "__source"]
#: Stands for all sources or languages; those of rows begin with "=".
ALL = "*"
X, LOWER = [f"x{i}" for i in range(P)], [(i, j) for i in range(P) for j in range(i + 1)]


def chi2_cdf(x: float, even: int) -> float:
    """Of an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(even // 2))


def chi2_quantile(q: float, even: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, even) < q else (lo, mid)
    return hi


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of its whole text, 0 for null."""
    t = F.coalesce(F.col(quoted(text)), F.lit(""))
    step = df.withColumns({"__words": F.filter(F.split(t, SPACES), lambda w: w != ""), "__lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)), "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long")})
    step = step.withColumns({"n_words": F.size("__words").cast("long"), "word_chars": F.length(F.array_join("__words", "")).cast("long"), "n_lines": F.size("__lines").cast("long"), "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")})
    step = step.withColumn("__runs", F.expr("if(n_words < 3, array(), transform(sequence(0, cast(n_words as int) - 3), i -> xxhash64(__words[i], __words[i + 1], __words[i + 2])))"))
    # most texts repeat no three words: only those that do are sorted
    step = step.withColumn("__sorted", F.expr("if(size(array_distinct(__runs)) = size(__runs), null, sort_array(transform(__runs, (h, i) -> struct(h, i))))"))
    step = step.withColumn("__twice", F.expr("transform(filter(__sorted, (x, j) -> (j > 0 and __sorted[j - 1].h = x.h) or (j + 1 < size(__sorted) and __sorted[j + 1].h = x.h)), x -> x.i)"))
    step = step.withColumn("n_repeat_words", F.expr("cast(if(__twice is null, 0, size(array_distinct(flatten(transform(__twice, i -> array(i, i + 1, i + 2)))))) as long)"))
    return step.drop("__words", "__lines", "__runs", "__sorted", "__twice")


def vector() -> list[Column]:
    """Transformed statistics: word length, and shares of symbols, repeated lines and repeated words, in logarithms."""
    share = lambda a, b: F.log1p(100 * F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]


def counted(used: DataFrame) -> DataFrame:
    """(keys, cell, n, x0.., q00..) of each group, language and all rows: means and sums of products over the rows of each cell, and total: the group's rows."""
    cell = F.array(*(F.round(F.col(x) / (f / 2)).cast("int") for x, f in zip(X, FLOORS)))
    first = used.withColumn("cell", cell).groupBy(*KEYS, "cell").agg(F.count("*").alias("n"), *(F.sum(x).alias(f"t{i}") for i, x in enumerate(X)), *(F.sum(F.col(X[i]) * F.col(X[j])).alias(f"q{i}{j}") for i, j in LOWER))
    sums = [F.sum(c).alias(c) for c in first.columns if c not in (*KEYS, "cell")]
    wider = first.groupBy(KEYS[0], "cell").agg(*sums).withColumn(KEYS[1], F.lit(ALL))
    widest = wider.groupBy("cell").agg(*sums).withColumns(dict.fromkeys(KEYS, F.lit(ALL)))
    every = written(first.unionByName(wider).unionByName(widest), "counted")
    totals = every.groupBy(*KEYS).agg(F.sum("n").alias("total"))
    means = [(F.col(f"t{i}") / F.col("n")).alias(x) for i, x in enumerate(X)]
    return written(every.join(totals, KEYS).select(*KEYS, "cell", "n", "total", *means, *(f"q{i}{j}" for i, j in LOWER)), "cells")


def units(cells: DataFrame) -> DataFrame:
    """(language, s2, s3): what a language's repeats are divided by, so that the ALPHA quantile of the rows that have any lies two least deviations from none.

    Most rows repeat nothing, so their spread says nothing about those that do. A language with under PRIOR rows that repeat takes the unit of all rows; without these it is 1.
    """
    d = cells.where(F.col(KEYS[1]) == ALL)
    some = lambda i: F.col(X[i]) > 0
    g = d.groupBy(KEYS[0]).agg(*(F.percentile(F.when(some(i), F.col(X[i])), F.lit(ALPHA), F.col("n")).alias(f"p{i}") for i in REPEATS), *(F.coalesce(F.sum(F.when(some(i), F.col("n"))), F.lit(0)).alias(f"k{i}") for i in REPEATS))
    g = g.select(KEYS[0], *(F.when(F.col(f"k{i}") >= PRIOR, F.greatest(F.lit(1.0), F.col(f"p{i}") / (2 * FLOORS[i]))).alias(f"s{i}") for i in REPEATS))
    of_all = F.broadcast(g.where(F.col(KEYS[0]) == ALL).select(*(F.col(f"s{i}").alias(f"a{i}") for i in REPEATS)))  # one row
    return g.join(of_all, how="left").select(KEYS[0], *(F.coalesce(f"s{i}", f"a{i}", F.lit(1.0)).alias(f"s{i}") for i in REPEATS))


def in_units(df: DataFrame, products: bool = False) -> DataFrame:
    """df, which has s2 and s3, with its repeats, and sums of products with them, in these units."""
    of = lambda i: F.col(f"s{i}") if i in REPEATS else F.lit(1.0)
    new = {X[i]: F.col(X[i]) / of(i) for i in REPEATS}
    new |= {f"q{i}{j}": F.col(f"q{i}{j}") / (of(i) * of(j)) for i, j in LOWER if products and (i in REPEATS or j in REPEATS)}
    return df.withColumns(new)


def with_factor(df: DataFrame, cov: dict[tuple[int, int], Column]) -> DataFrame:
    """df with l00..: the lower Cholesky factor of a covariance, of which the least standard deviations are FLOORS, and logdet."""
    for i, j in LOWER:
        rest = cov[i, j] - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2 / 100))) if i == j else rest / F.col(f"l{j}{j}"))
    return df.withColumn("logdet", sum((2 * F.log(f"l{i}{i}") for i in range(P)), F.lit(0.0)))


def estimate(cells: DataFrame, keys: list[str], weight: Column, scale: float) -> DataFrame:
    """(keys, n, m0.., l00.., logdet): mean and factor of the scaled covariance of each group's rows; weight is the part of a cell's rows that counts."""
    sums = cells.groupBy(*keys).agg(F.sum(weight * F.col("n")).alias("n"), *(F.sum(weight * F.col("n") * F.col(x)).alias(f"m{i}") for i, x in enumerate(X)), *(F.sum(weight * F.col(f"q{i}{j}")).alias(f"s{i}{j}") for i, j in LOWER))
    sums = sums.withColumns({f"m{i}": F.col(f"m{i}") / F.col("n") for i in range(P)})
    cov = {(i, j): (F.col(f"s{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * scale for i, j in LOWER}
    cov |= {(i, i): F.greatest(cov[i, i], F.lit(0.0)) + FLOORS[i] ** 2 for i in range(P)}
    return with_factor(sums, cov).select(*keys, "n", *(f"m{i}" for i in range(P)), *(f"l{i}{j}" for i, j in LOWER), "logdet")


def distance(df: DataFrame) -> DataFrame:
    """df, which has x0.., m0.. and l00.., with the square of the Mahalanobis distance, d2."""
    own = df.columns
    for i in range(P):
        df = df.withColumn(f"y{i}", (F.col(f"x{i}") - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return df.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(P)), F.lit(0.0))).select(*own, "d2")


def starts(cells: DataFrame) -> DataFrame:
    """(keys, start, m0.., l00..): the medians with median deviations, and STARTS random handfuls of each group's rows."""
    medians = cells.groupBy(*KEYS).agg(*(F.percentile(x, F.lit(0.5), F.col("n")).alias(f"m{i}") for i, x in enumerate(X)))
    spreads = cells.join(medians, KEYS).groupBy(*KEYS, *(f"m{i}" for i in range(P))).agg(*(F.percentile(F.abs(F.col(x) - F.col(f"m{i}")), F.lit(0.5), F.col("n")).alias(f"d{i}") for i, x in enumerate(X)))
    zero = F.lit(0.0)
    robust = spreads.select(*KEYS, F.lit(0).alias("start"), *(f"m{i}" for i in range(P)), *((F.greatest(1.4826 * F.col(f"d{i}"), F.lit(FLOORS[i])) if i == j else zero).alias(f"l{i}{j}") for i, j in LOWER))
    # a row is drawn by the least of exponential variates, which are as often least as a cell has rows
    draw = lambda s, k: -F.log((F.pmod(F.xxhash64("cell", F.lit(s), F.lit(k)), F.lit(1 << 30)) + 1) / (1 << 30)) / F.col("n")
    drawn = cells.groupBy(*KEYS).agg(*(F.array(*(F.min_by(F.array(*X), draw(s, k)) for k in range(START_ROWS))).alias(f"h{s}") for s in range(STARTS)))
    drawn = drawn.select(*KEYS, F.posexplode(F.array(*(f"h{s}" for s in range(STARTS)))).alias("start", "h"))
    mean = lambda get: F.aggregate("h", F.lit(0.0), lambda a, r: a + get(r)) / START_ROWS
    drawn = drawn.select(*KEYS, (F.col("start") + 1).alias("start"), *(mean(component(i)).alias(f"m{i}") for i in range(P)), *(mean(product(i, j)).alias(f"s{i}{j}") for i, j in LOWER))
    cov = {(i, j): F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}") + (FLOORS[i] ** 2 if i == j else 0.0) for i, j in LOWER}
    return robust.unionByName(with_factor(drawn, cov).select(*robust.columns))


def component(i: int):
    return lambda r: r[i]


def product(i: int, j: int):
    return lambda r: r[i] * r[j]


def concentrated(cells: DataFrame, now: DataFrame, scale: float) -> DataFrame:
    """The estimates over the ALPHA of each group's rows that are nearest by those of now; of the last cell, as many rows as are wanted."""
    keys = [*KEYS, "start"]
    placed = distance(cells.join(now.select(*keys, *(f"m{i}" for i in range(P)), *(f"l{i}{j}" for i, j in LOWER)), KEYS))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("d2", "cell")) - F.col("n")
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.ceil(F.col("total") * ALPHA) - before) / F.col("n")))
    return estimate(placed.withColumn("__w", weight).where("__w > 0"), keys, F.col("__w"), scale)


def least_determinants(cells: DataFrame, starts_kept: int = 2, steps: int = STEPS) -> DataFrame:
    """Of each group the estimate of the least determinant (keys, m0.., l00.., logdet), after concentration from all starts.

    All starts take three steps, the best two go on until no determinant changes.
    """
    scale = ALPHA / chi2_cdf(chi2_quantile(ALPHA, P), P + 2)
    now, last = written(starts(cells), "estimates"), None
    best = lambda df, k: df.withColumn("__k", F.row_number().over(Window.partitionBy(*KEYS).orderBy("logdet", "start"))).where(F.col("__k") <= k).drop("__k")
    for step in range(steps):
        new = concentrated(cells, now, scale)
        now, last = written(best(new, starts_kept) if step == 2 else new, "estimates"), now
        if step > 2:
            moved = now.join(last.select(*KEYS, "start", F.col("logdet").alias("__last")), [*KEYS, "start"]).agg(F.max(F.abs(F.col("logdet") - F.col("__last")))).first()[0]
            if moved is None or moved < 1e-6:
                break
    return best(now, 1).drop("start")


def leaning(own: DataFrame, wider: DataFrame, on: list[str]) -> DataFrame:
    """own's estimates with PRIOR rows of wider's counted in: mean and covariance of both together."""
    renamed = wider.select(*on, *(F.col(c).alias(f"w_{c}") for c in wider.columns if c not in (*KEYS, "n", "logdet")))
    both = own.join(renamed, on) if on else own.withColumn("__one", F.lit(1)).join(renamed.withColumn("__one", F.lit(1)), "__one").drop("__one")
    part = F.col("n") / (F.col("n") + PRIOR)
    product = lambda pre, i, j: sum((F.col(f"{pre}l{i}{k}") * F.col(f"{pre}l{j}{k}") for k in range(j + 1)), F.lit(0.0))
    cov = {(i, j): part * product("", i, j) + (1 - part) * product("w_", i, j) + part * (1 - part) * (F.col(f"m{i}") - F.col(f"w_m{i}")) * (F.col(f"m{j}") - F.col(f"w_m{j}")) for i, j in LOWER}
    both = both.withColumns({f"c{i}{j}": c for (i, j), c in cov.items()}).withColumns({f"m{i}": part * F.col(f"m{i}") + (1 - part) * F.col(f"w_m{i}") for i in range(P)})
    return with_factor(both.drop(*(f"l{i}{j}" for i, j in LOWER)), {k: F.col(f"c{k[0]}{k[1]}") for k in cov}).select(*own.columns)


def estimates(cells: DataFrame) -> DataFrame:
    """(keys, n, m0.., l00..) of each group: the least determinant's estimate, weighed anew over the rows that are not far, and leaning on the language's."""
    raw = least_determinants(cells)
    near = chi2_quantile(0.975, P)
    fine = written(estimate(distance(cells.join(raw.drop("n"), KEYS)).where(F.col("d2") <= near), KEYS, F.lit(1.0), 0.975 / chi2_cdf(near, P + 2)), "weighed")
    widest, wider = fine.where(F.col(KEYS[0]) == ALL), fine.where((F.col(KEYS[0]) != ALL) & (F.col(KEYS[1]) == ALL))
    wider = written(leaning(wider, widest, []), "languages")
    return leaning(fine.where(F.col(KEYS[1]) != ALL), wider, KEYS[:1])


def looked_up(rows: DataFrame, found: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows with their group's estimate. Groups of many rows are few, and go to all tasks; the others are joined, none of them large."""
    most = (sizes.agg(F.sum("rows")).first()[0] or 0) / HOT
    hot = sizes.where(F.col("rows") > most).select(*KEYS)
    hot_found = F.broadcast(found.join(hot, KEYS).withColumn("__hot", F.lit(True)))  # fewer than HOT rows
    first = rows.join(hot_found, KEYS, "left")
    rest = first.where("__hot is null").select(*rows.columns).join(found.join(hot, KEYS, "left_anti"), KEYS, "left")
    return first.where("__hot").drop("__hot").unionByName(rest)


def outliers(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """One row per row of df: its id, the statistics, base_failed, kept and distance.

    A row fails the base rules with under 50 words, or if over half of its words are in windows of three that repeat. Of the
    others, all are kept whose distance is within the cutoff. Estimates rest on rows that pass the base rules; distance is null where a
    language and source has no such row. Repeats are measured by those of the language's rows that have any (see `units`). A group of few rows has
    hardly an estimate of its own: it widens that of its language enough to hold its own centre. Null languages and sources are groups of
    their own. Null and empty texts have no words and fail. Repeated rows and ids each count and come back, ties fare alike; an empty table
    gives an empty result. Other columns play no part.
    """
    stats = with_statistics(df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text)).alias("text"), *(F.coalesce(F.concat(F.lit("="), F.col(quoted(c)).cast("string")), F.lit("null")).alias(k) for c, k in zip((lang, source), KEYS)))).drop("text")
    rows = stats.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).withColumns(dict(zip(X, vector())))
    rows = written(rows, "statistics")
    cells = counted(rows.where("not base_failed"))
    of_language = written(units(cells), "units")
    scaled = written(in_units(cells.join(of_language, KEYS[0]), True).select(*cells.columns), "scaled")
    found = written(estimates(scaled).join(of_language, KEYS[0]), "final")
    sizes = written(rows.groupBy(*KEYS).agg(F.count("*").alias("rows")), "sizes")
    final = distance(in_units(looked_up(rows, found.drop("n", "logdet"), sizes)))
    return final.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(F.col("d2") <= chi2_quantile(cutoff, P), F.lit(True))).alias("kept"), F.sqrt("d2").alias("distance"))
