"""Cleaning, roll-ups and joins of trace tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelith.functions.tokens import let


def cleaned(rows: DataFrame, trace_col: str = "tokenized_trace") -> DataFrame:
    """Without rows whose trace is MISSING; `_` becomes `-` in every string column."""
    kept = rows.filter(F.coalesce(F.col(trace_col), F.lit("")) != "MISSING")
    return kept.select(*(F.translate(c, "_", "-").alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes))


def of_length(traces: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    n = F.size("tokens")
    return traces.filter((n >= least) & (n <= most if most is not None else F.lit(True)))


def distinct_traces(traces: DataFrame, order: str = "trace_id", per_question: bool = False) -> DataFrame:
    """The first row, in `order`, of equal token sequences, in all or in a question.

    The first is picked by an aggregation that starts in each task, so a sequence that many rows share moves once a task.
    """
    keys = ["question_id", "tokens"] if per_question else ["tokens"]
    rest = [c for c in traces.columns if c not in keys]
    first = traces.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("row"))
    return first.select(*(F.col(c) if c in keys else F.col("row").getField(c).alias(c) for c in traces.columns))


def first_questions(traces: DataFrame, n: int, order: str = "trace_id") -> DataFrame:
    """Traces of the n questions that come first in `order`."""
    keep = traces.groupBy("question_id").agg(F.min(order).alias("at")).orderBy("at").limit(n)
    return traces.join(F.broadcast(keep.select("question_id")), "question_id", "left_semi")


def corpus_summary(traces: DataFrame) -> DataFrame:
    n = F.size("tokens")
    return traces.agg(
        F.count(F.lit(1)).alias("traces"), F.count_distinct("question_id").alias("questions"), F.count_if("is_correct").alias("success"), F.count_if(~F.col("is_correct")).alias("failure"),
        F.avg(F.col("is_correct").cast("int")).alias("success_rate"), F.avg(n).alias("mean_len"), F.median(n).alias("median_len"), F.min(n).alias("min_len"), F.max(n).alias("max_len"),
    )


def question_stats(traces: DataFrame, least: int = 1, only_mixed: bool = False, least_right: int = 0, least_wrong: int = 0) -> DataFrame:
    out = traces.groupBy("question_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("is_correct").alias("right"), F.count_if(~F.col("is_correct")).alias("wrong"), F.avg(F.size("tokens")).alias("avg_len"))
    out = out.withColumn("accuracy", F.col("right") / F.col("total")).withColumn("is_mixed", (F.col("right") > 0) & (F.col("wrong") > 0))
    out = out.withColumn("acceptance_rate", F.lit(1.0)).withColumn("percent_correct", 100.0 * F.col("accuracy"))
    return out.filter((F.col("total") >= least) & (F.col("right") >= least_right) & (F.col("wrong") >= least_wrong) & (F.col("is_mixed") | F.lit(not only_mixed)))


def document_frequency(traces: DataFrame) -> DataFrame:
    return traces.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("documents"))


def bag_of_words(traces: DataFrame) -> DataFrame:
    """Raw counts and shares of all tokens."""
    counts = traces.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("count"))
    total = traces.agg(F.sum(F.size("tokens")).alias("total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("relative_frequency", F.col("count") / F.col("total")).drop("total")


def answer_distribution(traces: DataFrame) -> DataFrame:
    """Answers of each question by count, ties to the answer seen first; shares."""
    counts = traces.groupBy("question_id", "predicted_answer").agg(F.count(F.lit(1)).alias("count"), F.min("trace_id").alias("seen"))
    w = Window.partitionBy("question_id")
    return counts.withColumn("share", F.col("count") / F.sum("count").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("count"), "seen"))).drop("seen")


def natural_order(x: Column) -> list[Column]:
    """Whole numbers by value, before all other ids by text."""
    return [x.try_cast("bigint").asc_nulls_last(), x.asc()]


def distribution(df: DataFrame, value: str) -> DataFrame:
    """Mean, interpolated quartiles and a ten-bin histogram of values from 0 to 1."""
    bins = [F.count_if(F.least(F.floor(F.col(value) * 10), F.lit(9)) == i).alias(f"bin_{i}") for i in range(10)]
    return df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), *(F.percentile(value, p / 100).alias(f"p{p}") for p in (25, 50, 75)), F.min(value).alias("min"), F.max(value).alias("max"), *bins)


def joined_attempts(tokenized: DataFrame, raw: DataFrame, fields: list[str]) -> DataFrame:
    """Tokenized rows with their raw attempt: by attempt_index, else the only raw attempt of the sample, else attempt 0.

    Of raw rows with one key the last (`row_idx`) holds. Empty fields are filled from the raw row.
    """
    key = ["question_id", "sample_id"]
    last = raw.groupBy(*key, "attempt_index").agg(F.max_by(F.struct(*fields), "row_idx").alias("raw"))
    only = last.groupBy(*key).agg(F.when(F.count(F.lit(1)) == 1, F.min("attempt_index")).alias("only"))
    rows = tokenized.join(only, key, "left").withColumn("attempt_index", F.coalesce(F.nullif("attempt_index", F.lit("")), "only", F.lit("0"))).drop("only")
    out = rows.join(last, [*key, "attempt_index"])
    return out.select(*(c for c in rows.columns if c not in fields), *((F.coalesce(F.nullif(F.col(c), F.lit("")), F.col("raw").getField(c)) if c in rows.columns else F.col("raw").getField(c)).alias(c) for c in fields))


def not_done(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Rows whose (question_id, sample_id) has no output yet."""
    return rows.join(done.select("question_id", "sample_id").distinct(), ["question_id", "sample_id"], "left_anti")


def merged_benchmarks(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Items of all parts in order, the first of equal questions (white space and case aside), numbered anew."""
    rows = None
    for i, (source, df) in enumerate(parts):
        one = df.select("question", "answer", F.lit(source).alias("source_dataset"), F.lit(i).alias("part"), F.col("place"))
        rows = one if rows is None else rows.unionByName(one)
    key = F.lower(F.trim(F.regexp_replace("question", r"\s+", " ")))
    first = rows.withColumn("key", key).filter(F.col("key") != "").groupBy("key").agg(F.min(F.struct("part", "place", "question", "answer", "source_dataset")).alias("r")).select("r.*")
    # numbers by part, then within it: one window for each part, offsets from their counts
    size = first.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = size.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return first.join(F.broadcast(before), "part").withColumn("question_id", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("place")) - 1).select("question_id", "question", "answer", "source_dataset")


def sampled_report(attempts: DataFrame) -> DataFrame:
    """For each question: attempts, majority answer (ties to the one seen first), distinct answers, mean words and lines of the texts."""
    norm = F.lower(F.trim(F.regexp_replace("predicted_answer", r"\s+", " ")))
    rows = attempts.withColumn("norm", norm)
    counts = rows.filter("norm <> ''").groupBy("question_id", "norm").agg(F.count(F.lit(1)).alias("n"), F.min("trace_id").alias("seen"))
    top = counts.groupBy("question_id").agg(F.min_by("norm", F.struct((-F.col("n")).alias("n"), "seen")).alias("majority_answer"), F.count(F.lit(1)).alias("distinct_answers"))
    out = rows.groupBy("question_id").agg(F.count(F.lit(1)).alias("attempts"), F.count_if("is_correct").alias("right"), F.avg(F.size("tokens")).alias("avg_words"))
    bucket = F.when(F.col("right") == F.col("attempts"), "easy").when(F.col("right") == 0, "failed").otherwise("mixed")
    return out.withColumn("bucket", bucket).join(top, "question_id", "left").fillna(0, ["distinct_answers"])


def text_measures(text: Column) -> list[Column]:
    """words, lines (not blank) and chars of a text."""
    words = let(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda w: F.size(F.filter(w, lambda x: x != "")))
    lines = F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))
    return [words.alias("words"), lines.alias("lines"), F.length(text).alias("chars")]
