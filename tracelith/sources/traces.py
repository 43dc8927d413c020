"""Labelled token sequences out of the driver's tables, and out of CSV files in the toolkit's formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelith.functions.labels import strict_bool
from tracelith.functions.tokens import delimited_tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequence_of(order: list[str], token: str) -> Column:
    """Tokens of a group in the given order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(token).alias("token")))), lambda x: x["token"])


def event_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trace for each user and day: event types in order, successful if a value reaches 75."""
    e = table(spark, sf_dir, "events")
    best = F.struct("value", -F.col("event_id"))
    t = e.groupBy(F.col("user_id").cast("string").alias("question_id"), F.date_format("ts", "yyyy-MM-dd").alias("sample_id")).agg(
        sequence_of(["ts", "event_id"], "event_type").alias("tokens"), (F.max("value") >= 75).alias("is_correct"), F.max_by("event_type", best).alias("predicted_answer")
    )
    return t.select(F.concat_ws(":", "question_id", "sample_id").alias("trace_id"), "question_id", "sample_id", "tokens", "is_correct", "predicted_answer", F.lit("purchase").alias("gold_answer"))


def order_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trace for each order: typed tokens `flag:status` of its lines, successful if the order is finished."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    li = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.concat_ws(":", "l_returnflag", "l_linestatus").alias("tok"))
    t = li.groupBy("l_orderkey").agg(sequence_of(["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "tok").alias("tokens"))
    t = t.join(o.select("o_orderkey", "o_custkey", "o_orderstatus"), t.l_orderkey == o.o_orderkey)
    q, s = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")
    return t.select(F.concat_ws(":", q, s).alias("trace_id"), q.alias("question_id"), s.alias("sample_id"), "tokens", (F.col("o_orderstatus") == "F").alias("is_correct"))


def strings(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table of strings: quoted line breaks stay, a byte-order mark before the first name goes."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def detect(df: DataFrame, *candidates: str) -> str:
    """The first candidate that is a column."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of the columns {', '.join(candidates)} among {', '.join(df.columns)}")


def trace_csv(spark: SparkSession, path: str, trace_col: str = "tokenized_trace", delimiter: str = " ", skip_bad: bool = False) -> DataFrame:
    """Typed traces of a CSV file. Labels that can't be read raise, or with `skip_bad` drop their rows."""
    raw = strings(spark, path)
    if raw.isEmpty():
        raise ValueError(f"no rows in {path}")
    for wrong, right in (("quesiton_id", "question_id"),):
        raw = raw.withColumnRenamed(wrong, right) if right not in raw.columns else raw
    missing = [c for c in ("question_id", "sample_id", "is_correct", trace_col) if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    label = strict_bool(F.col("is_correct"), raises=not skip_bad)
    rows = raw.withColumn("is_correct", label).withColumn("tokens", delimited_tokens(F.col(trace_col), delimiter))
    rows = rows.withColumn("trace_id", F.concat_ws(":", F.trim("question_id"), F.trim("sample_id"))).withColumn("trace_len", F.size("tokens"))
    return rows.filter("is_correct is not null") if skip_bad else rows


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON-lines file; blank, broken and other lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def benchmark_items(df: DataFrame, order: str) -> DataFrame:
    """question_id (given or the row's place in `order`), question, answer; blank ones are left out."""
    rows = df.filter((F.trim("question") != "") & (F.trim("answer") != ""))
    place = F.row_number().over(Window.orderBy(order)) - 1
    return rows.withColumn("question_id", F.coalesce(F.col("question_id").cast("int"), place) if "question_id" in df.columns else place)


def load_counts(spark: SparkSession, path: str, trace_col: str = "tokenized_trace") -> DataFrame:
    """One row: total rows of a trace file, those skipped for their label, those skipped for want of a trace or a question."""
    raw = strings(spark, path)
    bad = strict_bool(F.col("is_correct"), raises=False).isNull()
    blank = F.coalesce(F.trim(trace_col), F.lit("")).isin("", "MISSING") | (F.coalesce(F.trim("question_id"), F.lit("")) == "")
    return raw.agg(F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("bad_label"), F.count_if(~bad & blank).alias("no_trace"), F.count_if(~bad & ~blank).alias("kept"))


def table_file(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table by its suffix: csv, json (a list of objects), jsonl or parquet; any other is an error."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return strings(spark, path)
    if suffix == "jsonl":
        return jsonl(spark, path, schema) if schema else spark.read.json(path)
    if suffix == "json":
        return spark.read.json(path, multiLine=True)
    if suffix == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for {path}: csv, json, jsonl and parquet are known")
