"""Readers of tables that earlier steps or other tools have written, and small settings."""

from __future__ import annotations

import os
from collections.abc import MutableMapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def optional_int(c: Column) -> Column:
    """Blank and missing are null."""
    return F.nullif(F.trim(c), F.lit("")).try_cast("long")


def optional_text(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def motif_table(spark: SparkSession, path: str, scope: str) -> DataFrame:
    """A written motif table: typed columns, the scope, the direction from the difference's sign; a blank or nan q is null."""
    rows = csv_rows(spark, path)
    whole, real = ("length", "success_count", "failure_count"), ("success_support", "failure_support", "support_difference", "lift", "log_odds_ratio")
    q = F.trim("q_value") if "q_value" in rows.columns else F.lit(None).cast("string")
    out = rows.select("motif", F.split("motif", r"\|").alias("tokens"), *(F.col(c).cast("long").alias(c) for c in whole), *(F.col(c).cast("double").alias(c) for c in real), F.when(~F.lower(q).isin("", "nan"), q.try_cast("double")).alias("q_value"))
    return out.withColumn("scope", F.lit(scope)).withColumn("direction", F.when(F.col("support_difference") >= 0, "success").otherwise("failure"))


def token_deltas(spark: SparkSession, root: str) -> DataFrame:
    """model, token, mean_delta of every root/results_<model>/token_deltas_all.csv; rows without a token or number are skipped."""
    rows = spark.read.csv(f"{root}/results_*/token_deltas_all.csv", header=True, escape='"')
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    out = rows.select(F.regexp_replace(folder, "^results_", "").alias("model"), F.trim("token").alias("token"), F.col("mean_delta").try_cast("double").alias("mean_delta"))
    return out.filter("token <> '' and mean_delta is not null")


def signal_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics of signals as signals.success_scores reads them, in the file's order; an empty file is an error."""
    names = ("pearson_with_correct", "mean_correct", "mean_incorrect", "best_threshold", "best_threshold_accuracy")
    rows = csv_rows(spark, path).withColumn("at", F.monotonically_increasing_id())
    out = rows.select("signal", F.row_number().over(Window.orderBy("at")).alias("place"), *(F.col(c).cast("double").alias(c) for c in names))
    if out.isEmpty():
        raise ValueError(f"no rows in {path}")
    return out


def normalized_benchmark(rows: DataFrame, source: str, subject: str | None = None, level: str | None = None, order: str | None = None) -> DataFrame:
    """question_id (from 0), question, answer, source_dataset, source_id, and subject, level and solution where there are any.

    rows: problem and answer, blank ones of which go; the source id is the url, else the id, else the place. `order`
    names the column that says where a row stands; without one, rows stand as they are read.
    """
    missing = sorted({"problem", "answer"} - set(rows.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    at = F.col(order) if order else F.monotonically_increasing_id()
    placed = rows.withColumn("_at", at).withColumn("_place", F.row_number().over(Window.orderBy("_at")) - 1)
    said = [F.trim(F.col(c).cast("string")).alias(n) for c, n in (("problem", "question"), ("answer", "answer"))]
    own = F.col("url") if "url" in rows.columns else F.col("id") if "id" in rows.columns else F.col("_place")
    extra = [F.lit(v).alias(n) for n, v in (("subject", subject), ("level", level)) if v is not None] + ["solution"] * ("solution" in rows.columns)
    kept = placed.select("_place", *said, own.cast("string").alias("source_id"), *extra).filter("question <> '' and answer <> ''")
    out = kept.withColumn("question_id", F.row_number().over(Window.orderBy("_place")) - 1).withColumn("source_dataset", F.lit(source))
    return out.select("question_id", "question", "answer", "source_dataset", "source_id", *(c for c in ("subject", "level", "solution") if c in out.columns))


def load_settings(path: str, into: MutableMapping[str, str] | None = None) -> dict[str, str]:
    """NAME=value lines of a settings file on the driver: what is set already stays. Comments and blank lines are skipped, quotes go."""
    target, found = os.environ if into is None else into, {}
    if not os.path.exists(path):
        return found
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            key, eq, value = line.strip().removeprefix("export ").partition("=")
            if not eq or key.startswith("#") or not key.strip():
                continue
            value = value.strip()
            value = value[1:-1] if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'" else value
            found[key.strip()] = value
            target.setdefault(key.strip(), value)
    return found


def file_suffix(model: str) -> str:
    """A model's name as a part of file names."""
    return "".join(c if c.isalnum() or c in "._-" else "_" for c in model.rsplit("/", 1)[-1]).strip("_")
