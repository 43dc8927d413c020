"""Scratch tables and small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelith.llm.arrays import CHUNK_BYTES
from tracelith.sources.scratch import Scratch

__all__ = ["Scratch", "documents", "keyed", "mapped", "slices", "small_batches", "table", "text_of"]

BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame) -> DataFrame:
    """doc_id and text alone: null texts are empty, other columns stay outside the operators."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def text_of(df: DataFrame) -> Column:
    """The text as UTF-8 bytes; null texts are empty."""
    return F.encode(F.coalesce(df["text"].cast("string"), F.lit("")), "UTF-8")


def keyed(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), text as bytes, and doc_id and h, which tell documents apart and order them.

    h is 0, but for rows of one doc_id with different texts, which are documents of their own: it is a hash of
    the text there. Rows without a doc_id come after all others, ordered by h alone. Equal rows share doc_id and h.
    """
    rows = docs.select(F.struct(*(docs[f"`{c}`"].alias(c) for c in docs.columns)).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    several = rows.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b")).filter("a <> b").select("doc_id", F.lit(True).alias("several"))
    marked = rows.withColumn("several", F.lit(False)) if several.isEmpty() else rows.join(several.filter("doc_id is not null"), "doc_id", "left")
    apart = F.coalesce("several", F.lit(False)) | F.col("doc_id").isNull()
    return marked.select("row", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), F.when(apart, F.xxhash64("text")).otherwise(F.lit(0)).alias("h"), "text")


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, so that a batch of long texts fits a Python worker; a smaller bound stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).removesuffix("b")) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows with about `most` bytes in `column`, or in the field text of a struct."""
    for batch in batches:
        texts = batch.column(column)
        texts = pc.struct_field(texts, "text") if pa.types.is_struct(texts.type) else texts
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.flatnonzero(np.diff(size // most)) + 1 if len(size) else size
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows], strict=True):
            if b > a:
                yield batch.slice(int(a), int(b - a))


def mapped(docs: DataFrame, run) -> DataFrame:
    """docs.mapInArrow(run) with the columns of docs, whatever their names: Spark's own takes none with dots."""
    names, plain = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*plain)

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(b.rename_columns(names) for b in batches):
            yield out.rename_columns(plain)

    return rows.mapInArrow(inner, rows.schema).toDF(*names)
