"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage but the last returns the columns of ``documents``, so that stages can be left
out or run alone. Stages work on all that their predecessor kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriweave.llm import byte_bpe, decontamination, language_id, ngram_join, suffix_dedup
from veriweave.llm.common import prepare, restored, table
from veriweave.session import checkpoint_dir


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; texts without a letter go."""
    prepare(spark)
    model = language_id.fit(docs, ~language_id.held_out())
    told = language_id.predict(docs, model, keep=docs.columns)
    return told.filter(F.col("lang_pred") != language_id.UNDECIDED).select(*restored(docs.columns))


def join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id; of equal rows one."""
    prepare(spark)
    linked = ngram_join.linked(docs)
    kept = linked.filter(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]), "left_semi")
    copies = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0))
    return rows.withColumn("_copy", F.row_number().over(copies)).filter("_copy = 1 OR text IS NULL").drop("_copy")


def cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the strings that stand earlier; characters cut in two by it go."""
    prepare(spark)
    cut = suffix_dedup.remove_repeats(docs, keep=docs.columns, decode=True)
    # Null texts stay null.
    text = F.when(F.size("spans") == 0, F.col(f"_kept{docs.columns.index('text')}")).otherwise(F.col("kept"))
    out = cut.select(*restored(docs.columns, text=text))
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items do not contaminate."""
    judged = decontamination.judged(docs, table(spark, sf_dir, "benchmark"), keep=docs.columns)
    return judged.filter(~F.col("contaminated")).select(*restored(docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of what is left, and the bytes they decode to, as counts and digests."""
    prepare(spark)
    return byte_bpe.digests(docs)


STAGES = [("language_id", identify), ("ngram_join", join), ("suffix_dedup", cut), ("decontamination", decontaminate), ("byte_bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


# A learned language model and a tokenizer are no SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None

QUERIES = {"pipeline": (run, ORACLE_SQL)}
