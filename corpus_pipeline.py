"""A corpus pipeline out of the training-data operators: documents in, packed sequences out."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelith.llm import neardup, packing, secret_scan, substrings, toxicity
from tracelith.llm.run import Scratch, table


def sized(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, rejects go; the rest stays as it is."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the document with the smallest doc_id stays.

    Rows that share a doc_id or have none are documents of their own, unless their texts are equal or near-duplicates.
    """
    return neardup.one_of_each(docs, 80)


def drop_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated 20-word windows go, but for their first place. Every row stays.

    What is left of a text that loses words is joined by single spaces, so its lines go; other texts stay as they are.
    """
    out = substrings.drop_repeats(docs, keep_row=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    return sized(out.select(*((text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns)))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret becomes [SECRET]; every row stays."""
    return sized(secret_scan.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids: each document's pieces, their ids, and their places."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("substring_dedup", drop_substrings), ("secret_scan", redact_secrets), ("packing", pack)]

#: A trained classifier and a tokenizer are no SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages in turn; each reads the Parquet table that the one before it wrote."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
