"""Registered queries of this package: name -> (function of session and folder, SQL or None)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from veriweave.llm import (
    byte_bpe, chat_format, conversation_repair, decontamination, embedding_dedup, fingerprints, hard_negatives, html_text, language_id,
    ngram_join, oracles, suffix_dedup, token_files, toxicity,
)
from veriweave.llm.common import table
from veriweave.session import checkpoint_dir


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents, by the shingles they share: components, and links of the whole join."""
    return ngram_join.linked_by_join(table(spark, sf_dir, "documents"))


# A conversation made of control strings, so that escaping is always met.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, packed as prefix trees and read back."""
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.digests(chat_format.packs(turns))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash of all documents and of their edited texts."""
    return fingerprints.compared(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written to files and read back."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), path)
    return token_files.read_summary(spark, path)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents inside benchmark windows."""
    return decontamination.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of all documents and the bytes they decode to."""
    return byte_bpe.digests(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from two folds of three."""
    return language_id.identify(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from four folds of five."""
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeats of 100-byte strings are cut out of all documents."""
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by rule and repaired by the cheapest edits."""
    return conversation_repair.repaired(table(spark, sf_dir, "conversations"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings of equal label, by cosine."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth embedding, among all."""
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_ngram_join": (op1_ngram_join, oracles.NGRAM_JOIN),
    "op2_chat_format": (op2_chat_format, oracles.CHAT_FORMAT),
    "op3_fingerprints": (op3_fingerprints, None),
    "op4_token_files": (op4_token_files, None),
    "op5_decontamination": (op5_decontamination, oracles.DECONTAMINATION),
    "op6_html_text": (op6_html_text, None),
    "op7_byte_bpe": (op7_byte_bpe, None),
    "op8_language_id": (op8_language_id, None),
    "op9_toxicity": (op9_toxicity, None),
    "op10_suffix_dedup": (op10_suffix_dedup, oracles.SUFFIX_DEDUP),
    "op11_conversation_repair": (op11_conversation_repair, oracles.CONVERSATION_REPAIR),
    "op12_embedding_dedup": (op12_embedding_dedup, oracles.EMBEDDING_DEDUP),
    "op13_hard_negatives": (op13_hard_negatives, oracles.HARD_NEGATIVES),
}
