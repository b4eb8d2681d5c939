"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, chat, fingerprints, fixity, lm, mixing, near_dedup, packing, quality, token_counts, token_files, whitening
from .common import materialise, read_table, shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(read_table(spark, sf_dir, "documents"))


def op2_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.valid_vectors(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return ann.search(vectors, F.col("id") % 50 == 0, k=5)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(read_table(spark, sf_dir, "documents"))


def op4_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica of the pages' archives in which some records are damaged and some are missing."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    html = F.coalesce("html", F.lit(""))
    damaged = F.when(F.col("page_id") % 97 == 13, F.concat(F.lit("?"), F.substring(html, 2, 1 << 30))).otherwise(html)
    kept = pages.where(F.coalesce(F.col("page_id") % 389 != 7, F.lit(True)))
    records, replica = (materialise(fixity.manifest(p), "manifest") for p in (pages, kept.withColumn("html", damaged)))
    return fixity.audit(records, replica)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"))


def op6_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against a version with another last answer."""
    turns = read_table(spark, sf_dir, "conversations")
    pairs = chat.preference_pairs(turns, chat.swapped_answers(turns))
    sides = [f(F.col(c)).alias(f"{c}{end}") for c in ("chosen", "rejected") for f, end in ((chat.text_of, ""), (chat.mask_of, "_mask"))]
    return pairs.select("conv_id", "n_common", "prompt", *sides)


def op7_paragraph_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read_table(spark, sf_dir, "documents"))


def op8_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), size=2, percent=80)


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the files, then reads them."""
    folder = shared_folder(spark, "tokens")
    token_files.write_token_files(read_table(spark, sf_dir, "documents"), folder)
    return token_files.read_token_files(spark, folder)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return found.withColumnRenamed("id", "vec_id").withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_lm_scoring, op2_inverted_multi_index, op3_mix_sources, op4_merkle_fixity, op5_token_counts, op6_preference_format, op7_paragraph_fingerprints, op8_quality_gam, op9_best_fit_packing, op10_minhash_near_dedup, op11_token_files, op12_alignment, op13_whitening)}

ORACLES: dict[str, str] = {
    "op3_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source),
o AS (
  SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, source) AS k,
         coalesce(sum(3 * source_size) OVER before, 0)::BIGINT AS held,
         coalesce(sum(weight) OVER before, 0)::BIGINT AS passed
  FROM s WINDOW before AS (ORDER BY 3 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT min_by(((SELECT sum(source_size) FROM s) - held)::DOUBLE / ((SELECT sum(weight) FROM s) - passed)::DOUBLE, k) AS level
  FROM o WHERE ((SELECT sum(source_size) FROM s) - held)::DOUBLE / ((SELECT sum(weight) FROM s) - passed)::DOUBLE * weight <= 3 * source_size),
t AS (
  SELECT source, source_size, CASE WHEN weight * level > 3 * source_size THEN (3 * source_size)::DOUBLE ELSE weight * level END AS target
  FROM s, l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size = 0 THEN 0 ELSE floor(t.target)::BIGINT // t.source_size END AS epochs,
         floor(t.target)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - start)))::BIGINT AS taken
FROM p""",
    "op10_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN words
    ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS set
  FROM w),
x AS (SELECT doc_id, unnest(set) AS shingle FROM sets),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both
  FROM x JOIN x AS y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sets AS s ON s.doc_id = a JOIN sets AS t ON t.doc_id = b
  WHERE 100 * n_both >= 80 * (len(s.set) + len(t.set) - n_both)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT reach.doc_id, ways.b FROM reach JOIN ways ON ways.a = reach.other),
component AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, len(set)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN component USING (doc_id)""",
    "op4_merkle_fixity": r"""
WITH p AS (
  SELECT DISTINCT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
         CASE WHEN page_id % 97 = 13 THEN '?' || substr(coalesce(html, ''), 2) ELSE coalesce(html, '') END AS copy
  FROM pages),
r AS (
  SELECT page_id AS record_id, url,
         'WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || E'>\r\nWARC-Target-URI: ' || url
           || E'\r\nContent-Type: text/html\r\nContent-Length: ' AS head, html, copy
  FROM p),
w AS (
  SELECT record_id, replace(replace(head, '\r', chr(13)), '\n', chr(10)) || octet_length(encode(html)) || E'\r\n\r\n' || html || E'\r\n\r\n' AS record,
         replace(replace(head, '\r', chr(13)), '\n', chr(10)) || octet_length(encode(copy)) || E'\r\n\r\n' || copy || E'\r\n\r\n' AS copied
  FROM r),
o AS (
  SELECT record_id, (record_id // 256) * 1048576 AS archive, octet_length(encode(record))::BIGINT AS length, sha256(record) AS digest,
         CASE WHEN record_id % 389 <> 7 THEN sha256(copied) END AS replica_digest
  FROM w),
f AS (
  SELECT *, coalesce(sum(length) OVER (PARTITION BY archive ORDER BY record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
  FROM o)
SELECT record_id, archive, "offset", length, CASE WHEN replica_digest IS NULL THEN 'missing' ELSE 'changed' END AS status, digest, replica_digest
FROM f WHERE digest IS DISTINCT FROM replica_digest""",
    "op6_preference_format": r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM t),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, text DESC) AS k FROM t WHERE role = 'assistant'),
l AS (SELECT conv_id, turn, text FROM ranked WHERE k = 1),
s AS (
  SELECT t.conv_id, t.turn, t.role, l.turn IS NOT NULL AND t.role = 'assistant' AS last, CASE WHEN l.turn IS NOT NULL AND t.role = 'assistant' THEN o.text ELSE t.text END AS text
  FROM t LEFT JOIN l ON l.conv_id = t.conv_id AND l.turn = t.turn AND l.text = t.text AND t.role = 'assistant' LEFT JOIN l AS o ON o.conv_id = xor(t.conv_id, 1)),
b AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM s WHERE text IS NOT NULL),
c AS (
  SELECT coalesce(a.conv_id, b.conv_id) AS conv_id,
         min(coalesce(a.pos, b.pos)) FILTER (WHERE a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text) - 1 AS differs,
         count(a.pos) AS n, count(b.pos) AS m
  FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.pos = b.pos GROUP BY ALL),
n AS (SELECT conv_id, coalesce(differs, n)::INTEGER AS n_common FROM c WHERE n > 0 AND m > 0),
parts AS (
  SELECT 0 AS side, * FROM a UNION ALL BY NAME SELECT 1 AS side, * FROM b),
r AS (
  SELECT conv_id, n_common, side, pos, pos <= n_common AS common, '<|' || role || E'|>\n' AS head, text || E'<|end|>\n' AS body, role = 'assistant' AS learn
  FROM parts JOIN n USING (conv_id)),
m AS (
  SELECT *, CASE WHEN learn THEN len(head) || ':0,' || len(body) || ':1' ELSE (len(head) + len(body)) || ':0' END AS mask FROM r)
SELECT conv_id, n_common,
       coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (WHERE side = 0 AND common), '') AS prompt,
       coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (WHERE side = 0 AND NOT common), '') AS chosen,
       coalesce(string_agg(mask, ',' ORDER BY pos) FILTER (WHERE side = 0 AND NOT common), '') AS chosen_mask,
       coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (WHERE side = 1 AND NOT common), '') AS rejected,
       coalesce(string_agg(mask, ',' ORDER BY pos) FILTER (WHERE side = 1 AND NOT common), '') AS rejected_mask
FROM m GROUP BY conv_id, n_common""",
}
