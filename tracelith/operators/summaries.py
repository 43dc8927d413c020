"""Summaries of a corpus and of motif tables: dataset facts, ranked lists, lookups by question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelith.functions.tokens import NOISE_TOKEN, ngrams
from tracelith.operators.mining import facts, name


def dataset_summary(traces: DataFrame) -> DataFrame:
    """One row: traces, questions, outcomes, lengths, rows with noise, distinct tokens."""
    noise = F.array_contains("tokens", NOISE_TOKEN)
    rows = traces.agg(
        F.count(F.lit(1)).alias("trace_count"), F.count_distinct("question_id").alias("question_count"), F.count_if("is_correct").alias("success_count"), F.count_if(~F.col("is_correct")).alias("failure_count"),
        F.avg(F.size("tokens")).alias("avg_token_count"), F.median(F.size("tokens")).alias("median_token_count"), F.max(F.size("tokens")).alias("max_token_count"), F.count_if(noise).alias("rows_with_noise"), F.avg(noise.cast("int")).alias("rows_with_noise_rate"),
    )
    unique = traces.select(F.explode(F.array_distinct("tokens")).alias("t")).agg(F.count_distinct("t").alias("unique_token_count"))
    return rows.crossJoin(unique)


def type_counts(traces: DataFrame) -> DataFrame:
    """token_type (what stands before the colon, or unknown), count of tokens."""
    t = F.col("t")
    return traces.select(F.explode("tokens").alias("t")).groupBy(F.when(t.contains(":"), F.substring_index(t, ":", 1)).otherwise(F.lit("unknown")).alias("token_type")).agg(F.count(F.lit(1)).alias("count"))


def key_means(scores: DataFrame, key: Column, score: str = "mean_delta", by: tuple[str, ...] = ()) -> DataFrame:
    """Mean score of each key, such as a token's base type; empty keys don't count."""
    return scores.withColumn("key", key).filter(F.col("key") != "").groupBy(*by, "key").agg(F.avg(score).alias("score"))


def class_lengths(traces: DataFrame) -> DataFrame:
    """question_id, success_avg_length, failure_avg_length: 0 where a class has no trace."""
    n = F.size("tokens")
    of = lambda yes: F.coalesce(F.sum(F.when(yes, n)), F.lit(0)) / F.greatest(F.count_if(yes), F.lit(1))
    return traces.groupBy("question_id").agg(of(F.col("is_correct")).alias("success_avg_length"), of(~F.col("is_correct")).alias("failure_avg_length"))


LISTS = {
    "best": ("p_correct", "support_total", "enrichment_correct"),
    "worst": ("p_incorrect", "support_total", "enrichment_incorrect"),
    "most_correct_enriched": ("enrichment_correct", "support_total"),
    "most_incorrect_enriched": ("enrichment_incorrect", "support_total"),
    "most_frequent": ("support_total",),
}


def ranked_lists(motifs: DataFrame, least: int = 10, k: int = 20) -> DataFrame:
    """list, rank, motif: the k first of each of LISTS among the motifs (mining.v1_motifs) with enough support; ties by name."""
    rows, out = motifs.filter(F.col("support_total") >= least), None
    for what, keys in LISTS.items():
        order = [*(F.col(c).cast("double").desc() for c in keys), name("motif")]
        part = rows.orderBy(*order).limit(k).withColumn("list", F.lit(what)).withColumn("rank", F.row_number().over(Window.partitionBy("list").orderBy(*order))).select("list", "rank", "motif")
        out = part if out is None else out.unionByName(part)
    return out


def dominance(motifs: DataFrame) -> DataFrame:
    """How many motifs each label dominates, and the spread of p_correct."""
    p = F.col("p_correct").cast("double")
    return motifs.agg(*(F.count_if(F.col("dominant_label") == x).alias(f"{x}_dominant") for x in ("correct", "incorrect", "tie")), F.min(p).alias("min"), F.percentile(p, 0.25).alias("p25"), F.median(p).alias("median"), F.avg(p).alias("mean"), F.percentile(p, 0.75).alias("p75"), F.max(p).alias("max"))


def place_of(question_id: Column) -> Column:
    """An order of question ids: whole numbers first, by value, then the rest by text."""
    number = F.when(question_id.rlike(r"^[0-9]{1,18}$"), question_id.cast("long"))
    return F.struct(number.isNull().alias("text"), F.coalesce(number, F.lit(0)).alias("number"), question_id.alias("id"))


def from_question(traces: DataFrame, start: str | None) -> DataFrame:
    """Traces of the questions from `start` on, in the order of their ids; none if no question has this id."""
    if start is None:
        return traces
    known = traces.filter(F.col("question_id") == start).limit(1).select(F.lit(True).alias("_known"))
    return traces.filter(place_of(F.col("question_id")) >= place_of(F.lit(start))).join(F.broadcast(known)).drop("_known")


def matched_motifs(traces: DataFrame, lists: DataFrame, longest: int = 4) -> DataFrame:
    """trace_id, matched_success_motifs, matched_failure_motifs: the listed motifs (direction, rank, motif) that the trace holds, in rank order.

    lists may have a question_id: a trace then meets its own question's motifs alone.
    """
    keys = ["question_id", "motif"] if "question_id" in lists.columns else ["motif"]
    held = facts(traces, ngrams(F.col("tokens"), 1, longest), "trace_id", "question_id").join(lists, keys)
    of = lambda d: F.transform(F.array_sort(F.collect_list(F.when(F.col("direction") == d, F.struct("rank", name("motif").alias("m"))))), lambda x: x["m"]).alias(f"matched_{d}_motifs")
    found = held.groupBy("trace_id").agg(of("success"), of("failure"))
    none = F.expr("cast(array() as array<string>)")
    out = traces.select("trace_id").join(found, "trace_id", "left")
    return out.select("trace_id", *(F.coalesce(c, none).alias(c) for c in ("matched_success_motifs", "matched_failure_motifs")))


def with_raw_lengths(traces: DataFrame, raw: DataFrame) -> DataFrame:
    """Adds raw_chars and raw_words of the raw texts (question_id, sample_id, text); a trace without its text is an error when it is read."""
    text = raw.select("question_id", "sample_id", F.length("text").alias("raw_chars"), F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")).alias("raw_words"))
    found = traces.join(text, ["question_id", "sample_id"], "left")
    missing = F.raise_error(F.concat(F.lit("no raw text of trace "), F.coalesce("question_id", F.lit("")), F.lit(":"), F.coalesce("sample_id", F.lit(""))))
    return found.withColumn("raw_chars", F.coalesce("raw_chars", missing.cast("int")))


def nonzero(coefficients: DataFrame, column: str = "coefficient", least: float = 1e-12) -> DataFrame:
    return coefficients.filter(F.abs(column) >= least)
