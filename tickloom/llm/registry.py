"""Queries of the training-data operators over the given tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import licenses, merkle, mixing, outliers, packing, pii, quality_gam, recompression, sharding, simhash, stable, topk, whitening


#: Target shares of tokens, and bytes of text that a shard may hold.
MIX, SHARD_BYTES = {"high": 0.9, "low": 0.05, "toxic": 0.05}, 16 << 20
#: What a sequence of conversations may hold.
CONVERSATIONS = packing.Limits(tokens=8192, segments=48, loss=6144)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=2)
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = recompression.repeated_words(table(spark, sf_dir, "documents"), window=35)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains = mixing.quality_domains(table(spark, sf_dir, "labels"))
    out = mixing.mixed(table(spark, sf_dir, "documents"), domains, MIX)
    return out.select("doc_id", "n_tokens", "rate", "posterior.*", "missed")


def op6_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.outliers(table(spark, sf_dir, "documents"))


def op7_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"))


def conversation_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector packing of instruction data: whole conversations, limited in tokens, turns and tokens of answers, each of which binds."""
    return packing.packed_conversations(table(spark, sf_dir, "conversations"), CONVERSATIONS)


def op8_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), limit=SHARD_BYTES)


def op9_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 20 = 0"), k=20)


def op10_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licensed(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merkle.manifest(table(spark, sf_dir, "documents"), merkle.without_line_feeds())
    siblings = F.regexp_replace("proof", "[;|]", "")
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", "verified")


def op12_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), k=16)


def op13_stable_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return stable.nearest(rows, rows.where("vec_id % 50 = 0"), k=5)


QUERIES = {f.__name__: f for f in (op1_feistel_pii, op2_simhash_ball, op3_quality_gam, op4_recompression, op5_soft_mixing, op6_mcd_outliers, op7_vector_packing, conversation_packing, op8_extendible_shards, op9_histogram_topk, op10_license_digests, op11_merkle_manifest, op12_lanczos_whitening, op13_stable_neighbours)}

def _bytes(x: str) -> str:
    """SQL of a field as '-' if null, else its UTF-8 byte count, a colon and its value."""
    return f"(CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}) || ':' || {x} END)"


#: Of the others, SQL has no permutations under a key, XXH64, boosting, iterations to a target, or tokenizers.
SQL: dict[str, str] = {
    "op4_recompression": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 h AS (SELECT doc_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM (SELECT doc_id, list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i + 34], ' '))) AS hs FROM w)),
 c AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1), g AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i FROM h SEMI JOIN c USING (h)), range(35) t(k)),
 k AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
 a AS (SELECT k.doc_id, count(g.i) AS n, string_agg(word, ' ' ORDER BY k.i) FILTER (g.i IS NULL) AS kept FROM k LEFT JOIN g ON k.doc_id = g.doc_id AND k.i = g.i GROUP BY k.doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN a ON w.doc_id = a.doc_id""",
    "op9_histogram_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""",
    "op11_merkle_manifest": f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, source, text, {_bytes('doc_id::VARCHAR')} || {_bytes('source')} || {_bytes('lang')} || {_bytes('n_chars::VARCHAR')} AS head,
    list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(doc_id::VARCHAR, '.'), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)) + y)) AS crc FROM documents),
 h AS (SELECT r, doc_id, source, sha256(head || {_bytes('text')}) AS leaf, sha256(head || CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN {_bytes("replace(text, chr(10), '')")} ELSE {_bytes('text')} END) AS seen FROM d),
 o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM h),
 t AS (SELECT source, 0 AS lvl, i, n, leaf AS h FROM o UNION ALL
   SELECT source, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY source, lvl, i // 3, n),
 s AS (SELECT source, h AS subroot, lvl AS top, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
 u AS (SELECT 0 AS lvl, i, n, subroot AS h FROM s UNION ALL
   SELECT lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lvl, i // 3, n),
 f AS (SELECT r, source, 0 AS lvl, i, n, seen AS h, '' AS p FROM o UNION ALL
   SELECT f.r, f.source, f.lvl + 1, f.i // 3, any_value((f.n + 2) // 3), sha256(string_agg(CASE WHEN t.i = f.i THEN f.h ELSE t.h END, '' ORDER BY t.i)),
     any_value(f.p) || coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i <> f.i), '')
   FROM f JOIN t ON t.source IS NOT DISTINCT FROM f.source AND t.lvl = f.lvl AND t.i // 3 = f.i // 3 WHERE f.n > 1 GROUP BY f.r, f.source, f.lvl, f.i),
 g AS (SELECT f.r, 0 AS lvl, s.i, s.n, f.h, f.p FROM f JOIN s ON s.source IS NOT DISTINCT FROM f.source WHERE f.n = 1 UNION ALL
   SELECT g.r, g.lvl + 1, g.i // 3, any_value((g.n + 2) // 3), sha256(string_agg(CASE WHEN u.i = g.i THEN g.h ELSE u.h END, '' ORDER BY u.i)),
     any_value(g.p) || coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i <> g.i), '')
   FROM g JOIN u ON u.lvl = g.lvl AND u.i // 3 = g.i // 3 WHERE g.n > 1 GROUP BY g.r, g.lvl, g.i)
SELECT doc_id, leaf, subroot, u.h AS root, sha256(g.p) AS proof_sha256, g.h AS folded_root, g.h = u.h AS verified
FROM o JOIN s ON s.source IS NOT DISTINCT FROM o.source JOIN g ON g.r = o.r AND g.n = 1 JOIN u ON u.n = 1""",
}
