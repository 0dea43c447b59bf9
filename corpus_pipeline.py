"""Corpus pipeline over ``documents``: its stages, in order, each written and reread as the next one's input.

Every stage works on all rows it is given and keeps the columns doc_id, text, lang, source, n_chars;
the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import langid, minhash, packing, suffixes, winnowing
from gridloom.llm.common import materialize, table
from gridloom.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Whole texts that go to a Python worker, or come back, in one Arrow batch; Spark's 10,000 are tens of MB for each task on both sides.
BATCH_ROWS = 1000


def _batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session; every stage sets it, since stages are also run alone and their rows are read later."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; null texts, texts without letters and texts of fewer known words than labelled rows have go.

    Repeated rows and rows without an id are judged each by itself; columns beside those of documents are left out.
    """
    _batches(spark)
    model, least = langid.fit_with_floor(docs.where("lang is not null"))
    found = langid.identify(docs.select(*COLUMNS), model, known=True)
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("known") >= least)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of five-word-shingle near-duplicates (0.8 and more).

    Repeated rows (same id and text) are one document; rows without an id stand by their text.
    """
    _batches(spark)
    kept = minhash.near_duplicates(docs, width=5, percent=80).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    rows = docs.join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi").select(*COLUMNS)
    repeated = docs.groupBy("doc_id", F.md5(F.col("text").cast("binary")).alias("m")).count().where("count > 1")
    return rows if repeated.isEmpty() else rows.dropDuplicates(["doc_id", "text"])


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated 400-byte passages; a code point cut in two goes too, and so does a text of which nothing is left."""
    _batches(spark)
    rows = suffixes.remove_repeats(docs.select(*COLUMNS))
    whole = F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "\ufffd", "")
    rows = rows.withColumn("text", F.when(F.col("n_removed") == 0, F.col("kept").cast("string")).otherwise(whole))
    return rows.where("n_removed = 0 or length(text) > 0").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten words in a row of a benchmark item."""
    hit = winnowing.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    hit = hit.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_hash"))
    return docs.join(hit.hint("merge"), same, "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    _batches(spark)
    return packing.pack(docs, tokenizer_path(), added=True)


STAGES = [
    ("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("decontamination", decontamination), ("packing", packed),
]
#: Trained models, byte strings and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
