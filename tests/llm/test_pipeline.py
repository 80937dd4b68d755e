"""The pipeline against the same stages done by hand."""

import itertools
import re
from collections import Counter

import pytest

import corpus_pipeline
from tickloom.llm import packing, pii, quality_gam
from tickloom.llm.common import written


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), "stage")
        out.append(docs.toPandas())
    return out


def test_stages_one_by_one(spark, sf, stages):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    quality = quality_gam.quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).toPandas()
    kept = sorted(quality[quality["predicted"] == 1]["doc_id"])
    assert sorted(stages[0]["doc_id"]) == kept and list(stages[0].columns) == docs.columns
    # near-copies, by all pairs of texts with a common shingle
    sets = {r.doc_id: shingles(r.text) for r in stages[0].itertuples()}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    common = Counter(pair for ids in holders.values() for pair in itertools.combinations(sorted(ids), 2))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, j), n in common.items():
        if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    assert sorted(stages[1]["doc_id"]) == sorted({find(i) for i in sets})
    before = dict(zip(stages[1]["doc_id"], stages[1]["text"]))
    for r in stages[2].itertuples():
        assert r.text == pii.pseudonymize_text(before[r.doc_id], pii.Pseudonyms(pii.session_key(spark)), dict.fromkeys(pii.KINDS, 0)) and r.n_chars == len(r.text)
    assert set(stages[3]["doc_id"]) <= set(stages[2]["doc_id"]) and list(stages[3].columns) == docs.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    clean = set(labels[(labels["quality"] == 1) & (labels["toxic"] == 0)]["doc_id"]) & set(stages[2]["doc_id"])
    assert len(clean - set(stages[3]["doc_id"])) <= 0.02 * len(clean)


def test_sequences_hold_all_tokens(stages):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = sum(len(tok.encode(t, add_special_tokens=False).ids) + 1 for t in stages[3]["text"])
    assert stages[4]["length"].sum() == want and stages[4].groupby("sequence_id")["length"].sum().max() <= 2048


def test_run_gives_the_stages_rows(spark, sf, stages):
    got = corpus_pipeline.run(spark, sf).toPandas()
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got[key].to_numpy())) == sorted(map(tuple, stages[4][key].to_numpy()))
