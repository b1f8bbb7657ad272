"""A training-data pipeline over documents: quality, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a
DataFrame that is written as Parquet and read again as the next one's docs.  All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelith.llm import line_runs, near_copies, pack_bins, quality_gam
from panelith.llm.tables import WORD_FILE, stored, table, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  Nulls and empty texts are scored like any text."""
    return quality_gam.keep_good(docs, quality_gam.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; so does a document that loses all its lines by it.

    ``n_chars`` is counted anew where a text has changed.  A text that was null or empty before
    stays as it is.
    """
    before, deleted, _ = line_runs.info_columns(docs)
    done = line_runs.delete_runs(docs).where((F.col(deleted) == 0) | (F.col(deleted) < F.col(before)))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col(deleted) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    Near duplicates share five-word shingles to a Jaccard similarity of 0.8 or more; candidates
    come from the fingerprints and the tree of op10, with a reach of their own.  Documents are
    judged as they are here and as they were before lines went, so that no leftovers of a near copy
    pass as a document.
    Of rows that share that id, the one with the smallest hash of the text (and of equal rows one)
    stays; of a group without any id, one row by the same rule.
    """
    return near_copies.keep_one(docs, others=table(spark, sf_dir, "documents").select("doc_id", "text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies: one row a piece."""
    return pack_bins.pack_documents(docs, tokenizer_path(WORD_FILE))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Scores, fingerprints and token counts are beyond SQL: see tests/llm/test_pipeline.py for a plain version.
ORACLE_SQL: str | None = None
