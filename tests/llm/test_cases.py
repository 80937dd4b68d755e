"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

from tickloom.llm import licenses, mixing, outliers, packing, pii, quality_gam, recompression, sharding, simhash, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, id string, fp int, rate int, sequence_id string, kept int, shard int, license int, __id int, domain int"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def odd(spark):
    word = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()
    long = " ".join(f"{w}{i % 977}" for i in range(3000) for w in word)
    texts = [(1, "a b c d e. Mail x.y@example.com"), (1, "a b c d e. Mail x.y@example.com"), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, long), (None, "no id at all, none"), (None, None), (7, "é ü 漢字 \x1f\x85 ©"), (8, "x " * 5000)]
    return spark.createDataFrame([(i, t, None if k % 3 == 0 else "en", None if k % 2 else "s", None, "s", "i", 1, 2, "q", 3, 4, 5, 6, 7) for k, (i, t) in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, None), (3, 0, 0), (5, 1, 1), (None, 1, 0), (6, None, None), (8, 0, 0)], LABELS)


@pytest.fixture(scope="module")
def runs(labels):
    marks = mixing.quality_domains(labels)
    return {
        "pii": lambda d: pii.pseudonymize(d),
        "simhash": lambda d: simhash.near_duplicates(d),
        "quality": lambda d: quality_gam.quality(d, labels),
        "recompression": lambda d: recompression.repeated_words(d),
        "mixing": lambda d: mixing.mixed(d, marks, {"toxic": 0.2}),
        "outliers": lambda d: outliers.outliers(d),
        "shards": lambda d: sharding.shards(d, limit=100_000),
        "licenses": lambda d: licenses.licensed(d),
    }


NAMES = ["pii", "simhash", "quality", "recompression", "mixing", "outliers", "shards", "licenses"]


@pytest.mark.parametrize("name", NAMES)
def test_a_row_for_each_row(runs, odd, name):
    got = runs[name](odd)
    assert len(set(got.columns)) == len(got.columns)
    got = got.toPandas()
    assert len(got) == odd.count()
    assert sorted(got["doc_id"].fillna(-1)) == sorted(odd.toPandas()["doc_id"].fillna(-1))


@pytest.mark.parametrize("name", NAMES)
def test_an_empty_table(runs, odd, name):
    assert runs[name](odd.where("false")).count() == 0


def test_stages_keep_columns(odd, labels):
    for stage in (lambda d: quality_gam.accepted(d, labels, threshold=0.0), simhash.deduplicated, lambda d: pii.pseudonymize(d, counts=False), lambda d: mixing.resampled(d, mixing.quality_domains(labels), {"toxic": 0.2})):
        assert stage(odd).columns == odd.columns
        assert stage(odd).count() > 0
        assert stage(odd.where("false")).count() == 0


def test_one_stays_of_a_group(odd):
    got = sorted(r["doc_id"] or -1 for r in simhash.deduplicated(odd).collect())
    # 2, 3 and 4 have no words; 5 and 6 are equal; rows without an id stay
    assert got == [-1, -1, 1, 2, 5, 7, 8]


def test_packing_of_odd_rows(odd):
    got = packing.packed_documents(odd).toPandas()
    assert (got.groupby("sequence_id")["length"].sum() <= 2048).all()
    assert got[got["doc_id"] == 3]["doc_tokens"].tolist() == [1] and len(got[got["doc_id"] == 1]) == 2
    assert packing.packed_documents(odd.where("false")).count() == 0


def test_pack_counts_nulls_as_nothing(spark):
    d = spark.createDataFrame([(1, None, None, None, "x"), (2, 5, 1, 0, "y"), (2, 5, 1, 0, "y"), (3, 99, 1, 1, None)], "k int, tokens long, segments long, loss long, offset string")
    got = packing.pack(d, limits=packing.Limits(10, 4, 4)).toPandas()
    assert len(got) == 4 and list(got.columns) == ["k", "tokens", "segments", "loss", "sequence_id", "offset"]
    alone = got[got["k"] == 3]["sequence_id"].iat[0]
    assert (got["sequence_id"] == alone).sum() == 1


def test_topk_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5]), (4, None), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (None, [1.0, 1.0]), (8, []), (40, [0.0, -1.0]), (40, [0.0, -1.0])]
    d = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int")
    got = topk.top_k(d, d.where("vec_id % 20 = 0"), k=3).orderBy("query_id", "rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == 20] == [(1, 1, 4096), (2, 2, 4096), (3, 3, 2048)]
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == 40] == [(1, 1, 0), (2, 2, 0), (3, 3, 0)]
    assert topk.top_k(d, d.where("false")).count() == 0 and topk.top_k(d.where("false"), d.where("false")).columns == ["query_id", "rank", "vec_id", "score"]


def test_null_labels_teach_nothing(spark, odd):
    none = spark.createDataFrame([], LABELS)
    got = quality_gam.quality(odd, none).toPandas()
    assert (got["score"] == 0.5).all() and (got["predicted"] == 0).all()
    assert (mixing.mixed(odd, mixing.quality_domains(none), {}).toPandas()["rate"] - 1).abs().max() < 1e-3


def test_hot_key_still_shards(spark):
    """An id that holds all rows splits by the rows' place."""
    d = spark.range(400).select(F.lit(7).cast("long").alias("doc_id"), F.lit("z" * 1000).alias("text"))
    got = sharding.shards(d, limit=50_000).toPandas()
    assert got["shard_bytes"].max() <= 50_000 and len(got) == 400 and not got["oversized"].any()


def test_one_row_beyond_the_limit(spark):
    d = spark.createDataFrame([(1, "a" * 100), (2, "b" * 10)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in sharding.shards(d, limit=50).collect()}
    assert got[1]["oversized"] and not got[2]["oversized"] and got[1]["shard"] != got[2]["shard"]


@pytest.mark.parametrize("kind", ["int", "smallint", "bigint", "string", "date", "decimal(20,2)"])
def test_ids_of_any_type_are_cut_alike(spark, kind):
    long = " ".join(f"w{i}" for i in range(60))
    made = "date_add(date'2024-01-01', cast(k as int))" if kind == "date" else f"cast(k as {kind})"
    d = spark.createDataFrame([(1, long), (2, f"x {long}"), (3, "short"), (None, None)], "k int, text string").selectExpr(f"{made} as `doc.id`", "text")
    got = recompression.repeated_words(d, id_col="doc.id")
    assert got.dtypes[0] == d.dtypes[0] and sorted(map(str, (r[0] for r in got.collect()))) == sorted(map(str, (r[0] for r in d.collect())))
    assert sorted(r["n_removed"] for r in got.collect()) == [0, 0, 60, 60]


def test_packing_of_odd_conversations(spark):
    limits = packing.Limits(tokens=64, segments=4, loss=40)
    turns = [(1, "user", "hello there"), (1, "assistant", "hi"), (1, "assistant", "hi"), (2, None, None), (2, "assistant", ""), (None, "user", "lost"), (None, "assistant", "found"), (3, "assistant", "word " * 500), (4, "user", "a")]
    d = spark.createDataFrame([(*t, 1, 2) for t in turns], "conv_id long, role string, text string, offset int, sequence_id int")
    got = {r["conv_id"]: r for r in packing.packed_conversations(d, limits).collect()}
    assert set(got) == {1, 2, 3, 4, None} and got[1]["segments"] == 3 and got[2]["tokens"] == 2 and got[2]["loss"] == 1 and got[None]["segments"] == 2
    assert sum(r["sequence_id"] == got[3]["sequence_id"] for r in got.values()) == 1 and got[3]["tokens"] > limits.tokens
    fits = [r for r in got.values() if r["conv_id"] != 3]
    for s in {r["sequence_id"] for r in fits}:
        own = [r for r in fits if r["sequence_id"] == s]
        assert sum(r["tokens"] for r in own) <= 64 and sum(r["segments"] for r in own) <= 4 and sum(r["loss"] for r in own) <= 40
    assert packing.packed_conversations(d.where("false"), limits).count() == 0
