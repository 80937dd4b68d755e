"""Manifests, whitening and neighbour search against plain versions, and on odd rows."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import merkle, registry, stable, whitening

DOCS = "doc_id long, source string, lang string, n_chars long, text string, root string, at int, grp string, key int, proof int"


def plain_tree(nodes, run=3):
    """Levels of a tree, the leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([merkle.digest("".join(out[-1][i : i + run])) for i in range(0, len(out[-1]), run)])
    return out


def plain_leaf(row, text):
    part = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    return merkle.digest("".join(map(part, (row["doc_id"], row["source"], row["lang"], row["n_chars"], text))))


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof digest, folded root, verified), sorted."""
    sources = {}
    for r in rows:
        sources.setdefault(r["source"], []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    inner = {s: plain_tree([x for _, x in sorted(((-1 if r["doc_id"] is None else r["doc_id"]), plain_leaf(r, r["text"])) for r in own)]) for s, own in sources.items()}
    outer, out = plain_tree([inner[s][-1][0] for s in order]), []
    for s in order:
        own = sorted(sources[s], key=lambda r: ((-1 if r["doc_id"] is None else r["doc_id"]), plain_leaf(r, r["text"])))
        for i, r in enumerate(own):
            gone = r["text"] is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            now, siblings = plain_leaf(r, r["text"].replace("\n", "") if gone else r["text"]), ""
            for tree, at in ((inner[s], i), (outer, order.index(s))):
                for level in tree[:-1]:
                    run = level[at - at % 3 : at - at % 3 + 3]
                    siblings += "".join(run[: at % 3] + run[at % 3 + 1 :])
                    now, at = merkle.digest("".join(run[: at % 3]) + now + "".join(run[at % 3 + 1 :])), at // 3
            out.append((r["doc_id"], plain_leaf(r, r["text"]), inner[s][-1][0], outer[-1][0], hashlib.sha256(siblings.encode()).hexdigest(), now, now == outer[-1][0]))
    return sorted(out, key=str)


def digests(df):
    out = df.withColumn("proof_sha256", F.sha2(F.regexp_replace("proof", "[;|]", ""), 256))
    return sorted((tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_op11(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = sorted((tuple(r) for r in registry.op11_merkle_manifest(spark, sf).collect()), key=str)
    assert got == plain_manifest(rows) and 0 < sum(r[-1] for r in got) < len(got)


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_superblocks_of_any_height(spark, levels):
    """One source with most rows, some with one, two or three, and the null one; superblocks of 3 to 6,561 leaves."""
    sources = ["hot"] * 100 + ["a", "b", "b", "é", None, "c", "c", "c", *(f"s{i}" for i in range(12))]
    rows = [(i * 7 % 1000, s, "en" if i % 5 else None, None if i % 4 else i, f"line {i}\nnext\n" if i % 3 else None, "r", 1, "g", 2, 3) for i, s in enumerate(sources)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert digests(merkle.manifest(docs, merkle.without_line_feeds(), levels=levels)) == plain_manifest(docs.collect())


def test_manifest_of_odd_rows(spark):
    rows = [(1, "s", "en", 3, "a\nb", "r", 1, "g", 2, 3)] * 2 + [(None, "s", None, None, None, "r", 1, "g", 2, 3), (None, None, None, None, "", "r", 1, "g", 2, 3), (5, None, "de", 0, "long " * 200_000, "r", 1, "g", 2, 3)]
    docs = spark.createDataFrame(rows, DOCS)
    got = merkle.manifest(docs, merkle.without_line_feeds())
    assert got.columns == ["doc_id", "source", "position", "leaf", "subroot", "root", "proof", "folded_root", "verified"]
    assert digests(got) == plain_manifest(docs.collect())
    assert {r["position"] for r in got.where("source = 's'").collect()} == {0, 1, 2}
    one = merkle.manifest(docs.where("doc_id = 5")).collect()
    assert len(one) == 1 and one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] and one[0]["proof"] == "" and one[0]["verified"]
    assert merkle.manifest(docs.where("false")).count() == 0
    texts = spark.createDataFrame([("b", "x"), ("a", "y"), (None, "z")], "doc_id string, text string")
    assert [r["doc_id"] for r in merkle.manifest(texts.withColumn("source", F.lit(1)), fields=["text"]).orderBy("position").collect()] == [None, "a", "b"]


def plain_whitening(x, k):
    u = np.unique(x, axis=0)
    e, v = np.linalg.eigh(np.cov(u.T, bias=True))
    e, v = e[::-1], v[:, ::-1]
    return ((x - u.mean(0)) @ v[:, :k]) / np.sqrt(e[:k]), e[:k] / e.sum(), ((len(u) * x - u.sum(0)) ** 2).sum(1)


def test_op12(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    z, share, deviation = plain_whitening(np.floor(64 * np.array([r["embedding"] for r in rows], float)) + 1_000_000, 16)
    got = registry.op12_lanczos_whitening(spark, sf).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 16 * len(rows) and got["identity_error"].max() < 1e-10
    mine = got["whitened"].to_numpy().reshape(len(rows), 16)
    assert np.abs(mine * np.sign((mine * z).sum(0)) - z).max() < 1e-8
    assert np.allclose(got["explained"].to_numpy().reshape(-1, 16), share, rtol=1e-10) and (got["deviation"].to_numpy().reshape(-1, 16)[:, 0] == deviation).all()


def test_whitening_of_few_directions(spark):
    """Rows on a plane in five dimensions, one repeated a thousand times, and equal deviations in both directions."""
    rows = [(i, [float(a), float(b), float(a), 7.0, 0.0]) for i, (a, b) in enumerate([(2, 0), (-2, 0), (0, 3), (0, -3), (0, 0)])] + [(9, [2.0, 0.0, 2.0, 7.0, 0.0])] * 1000
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scale=1).toPandas()
    assert sorted(got["component"].unique()) == [1, 2] and len(got) == 2 * 1005 and set(got["n"]) == {5}
    assert got.groupby("component")["explained"].first().round(9).tolist() == [round(18 / 34, 9), round(16 / 34, 9)]
    assert got["identity_error"].max() < 1e-9 and got[got["vec_id"] == 9]["whitened"].abs().round(6).nunique() == 2
    square = [(i, [float(a), float(b), 0.0, 0.0]) for i, (a, b) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)])]
    even = whitening.whitened(spark.createDataFrame(square, "vec_id long, embedding array<double>"), scale=1).toPandas()
    assert sorted(even["component"].unique()) == [1, 2] and even["identity_error"].max() < 1e-9


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [1e300, 0.0]), (8, [-5.0, 1.0])]
    d = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, n int, component int")
    got = whitening.whitened(d).toPandas()
    assert sorted(got["vec_id"].fillna(-1).astype(int).unique()) == [-1, 1, 6, 7, 8] and set(got["n"]) == {5} and set(got["component"]) == {1}  # beside 2 ** 40 the second has no variance
    assert got[got["vec_id"] == 7]["deviation"].isna().all() and (got["vec_id"] == 1).sum() == 2
    assert set(whitening.whitened(d.where("vec_id <> 7")).toPandas()["component"]) == {1, 2}
    assert whitening.whitened(d.where("vec_id = 1")).count() == 0 and whitening.whitened(d.where("false")).count() == 0


def plain_nearest(rows, k, every):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = unit @ unit[q]
        out[ids[q]] = [(int(ids[i]), s[i]) for i in sorted(np.flatnonzero(ids != ids[q]), key=lambda i: (-round(s[i], 12), ids[i]))[:k]]
    return out


@pytest.mark.parametrize("chunk", [stable.CHUNK, 64])
def test_op13(spark, chunk):
    """Recall against all pairs, in one chunk and over eight cells or more; scores are exact, ranks gapless."""
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    d = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = stable.nearest(d, d.where("vec_id % 50 = 0"), k=5, chunk=chunk).toPandas()
    want, hits = plain_nearest(rows, 5, 50), 0
    assert sorted(want) == sorted(got["query_id"].unique())
    for q, own in got.sort_values("rank").groupby("query_id"):
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and q not in set(own["vec_id"]) and own["score"].is_monotonic_decreasing
        exact = dict(want[q])
        hits += len(set(own["vec_id"]) & set(exact))
        assert all(abs(s - exact[i]) < 1e-12 for i, s in zip(own["vec_id"], own["score"]) if i in exact)
    assert hits >= 0.95 * 5 * len(want)


def test_copies_and_ties(spark):
    """A third of all rows are one vector; several chunks hold ties."""
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(300)] + [(300 + i, rng.standard_normal(4).tolist()) for i in range(600)] + [(2000 + i, [2.0 * (i % 3 + 1), 0.0, 0.0, 0.0]) for i in range(60)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = stable.nearest(d, d.where("vec_id % 20 = 0"), k=5, chunk=64, chance=0.999).toPandas()
    for q in range(0, 300, 20):
        assert got[got["query_id"] == q].sort_values("rank")["vec_id"].tolist() == [i for i in range(6) if i != q][:5]
    want, mine = plain_nearest(rows, 5, 20), got.sort_values("rank").groupby("query_id")["vec_id"].apply(list)
    assert mine[2000] == [2001, 2002, 2003, 2004, 2005]
    same = sum(len(set(mine[q]) & {i for i, _ in want[q]}) for q in want)
    assert same >= 0.97 * 5 * len(want)


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [3e200, 1e200]), (3, [0.5]), (4, None), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (None, [1.0, 1.0]), (8, []), (9, [0.0, 0.0]), (100, [0.0, -1e-200]), (1, [1.0, 0.0]), (1, [0.0, 1.0])]
    d = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, score int")
    got = stable.nearest(d, d.where("vec_id % 50 = 0"), k=3).orderBy("query_id", "rank").collect()
    assert [(r["rank"], r["vec_id"], round(r["score"], 6)) for r in got if r["query_id"] == 50] == [(1, 1, 1.0), (2, 3, 1.0), (3, 2, 0.948683)]
    assert [r["vec_id"] for r in got if r["query_id"] == 100] == [1, 3, 50]
    all_ = stable.nearest(d, d.where("vec_id = 50"), k=30).collect()
    assert sorted((r["vec_id"]) for r in all_) == [1, 1, 2, 3, 100]
    assert stable.nearest(d, d.where("false")).count() == 0 and stable.nearest(d.where("false"), d.where("false")).columns == ["query_id", "rank", "vec_id", "score"]


def test_chi_square_reach():
    rng = np.random.default_rng(1)
    drawn = (rng.standard_normal((100_000, stable.MEASURES)) ** 2).sum(axis=1)
    assert all(abs((drawn <= stable.reach(p)).mean() - p) < 0.01 for p in (0.5, 0.9, 0.97))
