"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import mixing, packing, pii, quality_gam, simhash
from tickloom.llm.common import written
from tickloom.llm.registry import table

#: Most that unwanted domains may have of the tokens; domains that aren't named share the rest as they do now.
TARGETS = {"toxic": 0.04}


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_gam.accepted(docs, table(spark, sf_dir, "labels"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, that with the least id stays."""
    return simhash.deduplicated(docs)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Values are replaced by pseudonyms of their format; n_chars follows the text."""
    return pii.pseudonymize(docs, counts=False).withColumn("n_chars", F.length("text").cast("long"))


def in_target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents shrink to their share of what is left; the others stay, once each: what dedup removed doesn't come back.

    Where toxic documents have no more than that share already, all documents stay.
    """
    return mixing.resampled(docs, mixing.quality_domains(table(spark, sf_dir, "labels")), TARGETS, size="down", spare=True, ceilings=TARGETS)


def in_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each in its place in a sequence."""
    return packing.packed_documents(docs)


STAGES = [("quality classifier", good_quality), ("simhash near-dedup", one_of_near_copies), ("pii pseudonyms", without_pii), ("target mix", in_target_mix), ("packing", in_sequences)]

#: SQL can't express boosting, links over fingerprints or a tokenizer: tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i}")
    return docs
