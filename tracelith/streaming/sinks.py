"""Sinks that are appended to and resumed: rows as CSV, events as JSON lines, batch and streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

TRIGGER = "1 second"


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def start(spark: SparkSession, path: str, resume: bool) -> bool:
    """Makes a sink ready and says whether it holds rows: kept to be resumed, or removed."""
    at, files = _files(spark, path)
    held = files.exists(at) and files.getContentSummary(at).getLength() > 0
    if held and not resume:
        files.delete(at, True)
    return held and resume


def append_rows(rows: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Appends rows as CSV files with a header and these columns. A task that runs twice leaves one file: Spark commits files whole."""
    rows.select(*columns).write.mode("append").option("header", True).option("escape", '"').csv(path)


def remaining(rows: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """The rows whose keys the sink doesn't hold yet."""
    at, files = _files(rows.sparkSession, path)
    if not files.exists(at):
        return rows
    done = rows.sparkSession.read.csv(path, header=True, escape='"', multiLine=True).select(*(F.col(k).cast(rows.schema[k].dataType).alias(k) for k in keys)).distinct()
    return rows.join(done, list(keys), "left_anti")


def append_events(events: DataFrame, path: str) -> None:
    """Appends events as JSON lines; ts is the time of writing where there is none."""
    rows = events if "ts" in events.columns else events.withColumn("ts", F.lit(None).cast("double"))
    now = F.unix_micros(F.current_timestamp()) / 1e6
    rows.withColumn("ts", F.coalesce("ts", now)).write.mode("append").json(path)


def stream_rows(rows: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """A stream of rows into CSV files, each row once, in batches a second apart; a restart goes on from the checkpoint. once: what is there now, then it ends."""
    out = rows.writeStream.format("csv").option("header", True).option("escape", '"').option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=TRIGGER)).start(path)


def stream_events(events: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """A stream of events into JSON lines."""
    out = events.writeStream.format("json").option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=TRIGGER)).start(path)
