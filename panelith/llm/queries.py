"""The driver's queries of this subpackage, with SQL where SQL can say the same.

Each runs its operator, with production parameters, over the whole of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_projection, bloom_lm, line_runs, pack_bins, quality_gam, records, simhash_vp, stream_bpe, token_counts, topk_blocks
from .tables import BYTE_FILE, WORD_FILE, table, tokenizer_path


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_gam.score(docs, quality_gam.fit(docs, table(spark, sf_dir, "labels")))


def op2_topk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_blocks.top_k(table(spark, sf_dir, "embeddings"))


def op3_ann_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_projection.nearest(table(spark, sf_dir, "embeddings"))


def op4_stream_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_FILE))


def op5_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score_documents(table(spark, sf_dir, "documents"))


def op6_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_runs.delete_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("lines_before").cast("long").alias("n_lines"), F.col("lines_deleted").cast("long").alias("n_deleted"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.record_digest(table(spark, sf_dir, "documents"), tokenizer_path(WORD_FILE), end_id=2)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(WORD_FILE), limit=2048)


def op9_pack_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_bins.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(WORD_FILE))


def op10_simhash_vp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vp.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_gam, op2_topk_blocks, op3_ann_projection, op4_stream_bpe, op5_bloom_lm, op6_line_runs, op7_records, op8_token_counts, op9_pack_bins, op10_simhash_vp)}

_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

#: Least windows of 10 words that start or end at a line, over lines that are found elsewhere.
LINE_RUNS_SQL = r"""
WITH t AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM {docs}
), l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM t
), often AS (
  SELECT line FROM l GROUP BY line HAVING count(*) > 1
), a AS (
  SELECT doc_id, i, line, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS w
  FROM l SEMI JOIN often USING (line)
), b AS (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM a
), c AS (
  SELECT *, sum(w) OVER (PARTITION BY doc_id, g ORDER BY i) AS through FROM b
), f AS (
  SELECT s.doc_id, s.i AS s, min(e.i) AS e FROM c s JOIN c e
  ON s.doc_id = e.doc_id AND s.g = e.g AND e.i >= s.i AND e.through >= s.through - s.w + 10 GROUP BY 1, 2
), k AS (
  SELECT e.doc_id, max(s.i) AS s, e.i AS e FROM c s JOIN c e
  ON s.doc_id = e.doc_id AND s.g = e.g AND e.i >= s.i AND e.through >= s.through - s.w + 10 GROUP BY e.doc_id, e.i
), win AS (
  SELECT doc_id, s, e FROM f UNION SELECT doc_id, s, e FROM k
), named AS (
  SELECT win.doc_id, s, e, array_to_string(ls[s:e], chr(10)) AS content, e - s AS m FROM win JOIN t USING (doc_id)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY content, m ORDER BY doc_id, s) AS rn FROM named
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(s, e)) AS i FROM ranked WHERE rn > 1
), per AS (
  SELECT doc_id, list(i) AS dead FROM gone GROUP BY doc_id
)
"""

_LINE_RUNS = LINE_RUNS_SQL.replace("{docs}", "documents") + """
SELECT doc_id, coalesce(len(ls), 0) AS n_lines, coalesce(len(dead), 0) AS n_deleted,
  sha256(CASE WHEN dead IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda x, i: NOT list_contains(dead, i)), chr(10)) END) AS text_sha256
FROM t LEFT JOIN per USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op2_topk_blocks": _TOP_K, "op6_line_runs": _LINE_RUNS}
