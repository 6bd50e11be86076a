"""A corpus pipeline: five stages from raw documents to packed training sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import packing, quality, simhash, substring, toxicity
from packetloom.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line-first rules, with the lines that pass."""
    judged = quality.clean_lines(docs).where("kept")
    return judged.select(*[F.col("clean_text").alias(c) if c == "text" else F.length("clean_text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold of their language; all labels of the documents left train."""
    return toxicity.score_toxicity(docs, table(spark, sf_dir, "labels")).where("not toxic").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest doc_id.

    Rows go by their text, not by their doc_id: of rows equal in both one stays, different
    texts that share a doc_id are judged one by one, and rows without a doc_id all stay.
    """
    return simhash.first_copies(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one has; those left without words go."""
    left = substring.remove_spans(docs, substring.repeated_spans(docs)).where(~((F.col("cut_words") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")))
    return left.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences."""
    return packing.pack_best_fit(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_copies), ("substring_dedup", drop_repeated_passages), ("best_fit_packing", pack)]

#: No SQL can train the classifier; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
