"""Status of a tokenising run from its event log, as an aggregation that also runs as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Events of a question, with the stage they set.
STAGES = {"question_started": "started", "trace_chunked": "chunking", "metadata_ready": "metadata_ready", "trace_tokenized": "tokenizing", "question_done": "done", "question_error": "error"}


def progress(events: DataFrame) -> DataFrame:
    """One row for each question (event, ts, question_id, count, error): a fold that needs no order but the time stamps."""
    stage = F.create_map(*(F.lit(x) for kv in STAGES.items() for x in kv))
    rows = events.filter(F.coalesce(F.trim("question_id"), F.lit("")) != "").withColumn("_stage", F.try_element_at(stage, F.col("event")))
    is_ = lambda e: F.col("event") == e
    return rows.groupBy("question_id").agg(
        F.max_by("_stage", F.when(F.col("_stage").isNotNull(), F.struct("ts", "_stage"))).alias("stage"), F.coalesce(F.max(F.when(is_("trace_chunked"), F.col("count"))), F.lit(0)).alias("chunked"),
        F.coalesce(F.max(F.when(is_("trace_tokenized"), F.col("count"))), F.lit(0)).alias("tokenized"), F.coalesce(F.bool_or(is_("question_done")), F.lit(False)).alias("done"),
        F.coalesce(F.max_by("error", F.when(is_("question_error"), F.col("ts"))), F.lit("")).alias("error"), F.max("ts").alias("updated_ts"),
    )


def run_started(events: DataFrame) -> DataFrame:
    return events.agg(F.coalesce(F.bool_or(F.col("event") == "run_started"), F.lit(False)).alias("started"))


def status(expected: DataFrame, written: DataFrame, metadata: DataFrame, events: DataFrame) -> DataFrame:
    """Each expected question's counts and status: error before done, tokenizing, chunking, queued, pending."""
    want = expected.groupBy("question_id").agg(F.count(F.lit(1)).alias("expected_traces"))
    have = written.groupBy("question_id").agg(F.count(F.lit(1)).alias("written_traces"))
    known = metadata.select("question_id").distinct().withColumn("has_metadata", F.lit(True))
    out = want.join(have, "question_id", "left").join(known, "question_id", "left").join(progress(events), "question_id", "left").crossJoin(F.broadcast(run_started(events)))
    out = out.fillna(0, ["written_traces", "chunked", "tokenized"]).fillna("", ["error"]).fillna(False, ["has_metadata", "done"])
    done = F.col("done") | F.col("has_metadata") | (F.col("written_traces") >= F.col("expected_traces"))
    label = (
        F.when(F.trim("error") != "", "error").when(done, "done").when(F.col("tokenized") > 0, "tokenizing")
        .when((F.col("chunked") > 0) | F.coalesce(F.col("stage").isin("chunking", "metadata_ready", "started"), F.lit(False)), "chunking").when(F.col("started"), "queued").otherwise("pending")
    )
    return out.select("question_id", "expected_traces", F.least("chunked", "expected_traces").alias("chunked_traces"), F.least("tokenized", "expected_traces").alias("tokenized_traces"), "written_traces", label.alias("status"), "error", "updated_ts")


def roll_up(rows: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(f"{s}_questions") for s in ("done", "chunking", "tokenizing", "queued", "pending", "error")]
    return rows.agg(F.count(F.lit(1)).alias("questions"), F.sum("expected_traces").alias("expected_traces"), F.sum("written_traces").alias("written_traces"), *counts)
