"""Registered queries of this subpackage: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphlake.llm import decontam, hashsql, htmltext, langid, packing, secrets, sharding, simhash, substrings, surrogates, vectors
from glyphlake.llm.common import read_table


def op1_surrogate_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_personal_data(read_table(spark, sf_dir, "documents"), key="glyphlake-surrogates-1")


def op2_byte_prefix_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(read_table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_nearest_url_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = htmltext.main_text(read_table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_best_fit(read_table(spark, sf_dir, "documents"), window=1024, tokenizer="byte_bpe_50k", end_id=2)


def op5_randomness_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")


def op6_aho_corasick_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), width=8, least_items=2)
    return found.select("doc_id", "n_words", "n_hit", "n_items", decontam.items_digest("items").alias("items_sha256"), "contaminated")


def op7_hnsw_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.link_vectors(read_table(spark, sf_dir, "embeddings"), least=0.98)


def op8_recompression_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(read_table(spark, sf_dir, "documents"), width=50)


def op9_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = langid.is_held_out(F.col("doc_id"))
    predictor = langid.train(docs.where(~held_out))
    return langid.identify(docs, predictor, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_multi_index_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read_table(spark, sf_dir, "documents"), width=3, bits=2).select("doc_id", "fingerprint", "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_surrogate_personal_data,
        op2_byte_prefix_sharding,
        op3_nearest_url_differencing,
        op4_histogram_packing,
        op5_randomness_secret_scan,
        op6_aho_corasick_decontamination,
        op7_hnsw_near_dedup,
        op8_recompression_substring_dedup,
        op9_byte_cnn_language,
        op10_multi_index_simhash,
    )
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op2_byte_prefix_sharding": f"""
WITH codes AS ({hashsql.CRC_CODES}),
c AS (SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) + 1 AS BIGINT) AS size, {hashsql.crc32("coalesce(text, '')")} AS text_crc32 FROM documents, codes),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total,
             row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) AS place FROM c),
s AS (SELECT *, CAST(least(15, (upto * 2 - size) * 16 // (2 * total)) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, place - min(place) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s""",
    "op6_aho_corasick_decontamination": f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_ITEM_WORDS} AS ws FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, len(win) AS k, array_to_string(win, ' ') AS win FROM (
    SELECT item_id, unnest(CASE WHEN len(ws) >= 8 THEN list_transform(range(1, len(ws) - 6), lambda i: ws[i:i+7])
                                WHEN len(ws) > 0 THEN [ws] ELSE [] END) AS win FROM b)),
lens AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, i, array_to_string(ws[i:i+k-1], ' ') AS win
       FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, lens WHERE len(ws) >= k)),
hit AS (SELECT doc_id, i, dw.k AS k, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.k = iw.k),
w AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
n AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
             string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN w USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op8_recompression_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+49], ' ')) AS h
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
m AS (SELECT h, min(doc_id) AS lo FROM w GROUP BY h),
r AS (SELECT DISTINCT doc_id, p FROM (SELECT w.doc_id, unnest(range(i, i + 50)) AS p FROM w JOIN m USING (h) WHERE lo < w.doc_id)),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
k AS (SELECT x.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY x.p) AS kept
      FROM x LEFT JOIN r ON x.doc_id = r.doc_id AND x.p = r.p WHERE r.p IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
    "op7_hnsw_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (
  SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.x = v.vec_id LEFT JOIN n ON n.x = v.vec_id""",
    "op10_multi_index_simhash": rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT r, array_to_string(ws[i:i+2], ' ') AS shingle, count(*) AS times
      FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 1, least(len(ws), 1) + 1))) AS i FROM d) GROUP BY ALL),
u AS (SELECT DISTINCT shingle FROM s),{hashsql.xxh64_steps("u", "shingle", 42, "hashed")},
b AS (SELECT r, bit, sum(CAST((h >> bit) & 1 AS BIGINT) * times) AS ones, sum(times) AS shingles
      FROM (SELECT r, times, h, unnest(range(64)) AS bit FROM s JOIN hashed USING (shingle)) GROUP BY r, bit),
m AS (SELECT r, sum(CASE WHEN 2 * ones > shingles THEN CAST(1 AS HUGEINT) << CAST(bit AS INTEGER) ELSE 0 END) AS fp FROM b GROUP BY r),
p AS (SELECT doc_id, CAST(coalesce(fp, 0) AS HUGEINT) AS fp FROM d LEFT JOIN m USING (r)),
f AS (SELECT fp, min(doc_id) AS least_id FROM p GROUP BY fp),
l AS (SELECT a.fp AS x, c.fp AS y FROM f a JOIN f c ON a.fp <> c.fp AND bit_count(xor(a.fp, c.fp)) <= 2),
w AS (SELECT fp AS x, fp AS y FROM f UNION SELECT w.x, l.y FROM w JOIN l ON w.y = l.x),
c AS (SELECT x, min(least_id) AS component_id FROM w JOIN f ON w.y = f.fp GROUP BY x)
SELECT doc_id, lower(lpad(hex(CAST(fp AS UBIGINT)), 16, '0')) AS fingerprint, component_id FROM p JOIN c ON c.x = p.fp""",
}
