"""Question summaries and details for read-only exploration, and the sinks that write them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelith.functions import stats
from tracelith.functions.tokens import ngrams
from tracelith.operators import cards, mining
from tracelith.operators.corpus import answer_distribution

#: What insights say; %d and %s stand for numbers and motifs.
SENTENCES = {
    "mixed": "Outcomes differ: %d traces succeed and %d fail.",
    "right": "Every trace succeeds: read this as consistency, there is nothing to contrast.",
    "wrong": "Every trace fails: read this as one failure mode, there is nothing to contrast.",
    "shorter": "The median success is shorter than the median failure.",
    "longer": "The median success is longer than the median failure.",
    "even": "Successes and failures have the same median length.",
    "up": "Most typical of success: %s.",
    "down": "Most typical of failure: %s.",
    "spread": "Answers scatter: %d different ones.",
}
LABEL = "traces"
LOCAL_LOW, LOCAL_HIGH, LOCAL_LEAST, LOCAL_TOP = 1, 3, 2, 8


def local_rows(traces: DataFrame) -> DataFrame:
    """Contiguous motifs of each question with both outcomes: counts, supports and their difference."""
    counts = mining.class_counts(mining.facts(traces, ngrams(F.col("tokens"), LOCAL_LOW, LOCAL_HIGH), "question_id", "is_correct"), "question_id", "motif").filter(F.col("success_count") + F.col("failure_count") >= LOCAL_LEAST)
    totals = traces.groupBy("question_id").agg(F.count_if("is_correct").alias("success_total"), F.count_if(~F.col("is_correct")).alias("failure_total")).filter("success_total > 0 and failure_total > 0")
    rows = counts.join(totals, "question_id")
    rows = rows.withColumn("success_support", F.col("success_count") / F.col("success_total")).withColumn("failure_support", F.col("failure_count") / F.col("failure_total"))
    return rows.withColumn("support_difference", F.col("success_support") - F.col("failure_support"))


def split_by_direction(rows: DataFrame, k: int = LOCAL_TOP) -> DataFrame:
    """The k strongest motifs of both directions, ties to success; `rank` within question and direction."""
    d = F.col("support_difference")
    sided = rows.withColumn("direction", F.when(d >= 0, "success").otherwise("failure"))
    w = Window.partitionBy("question_id", "direction").orderBy(F.desc(F.abs(d)), F.desc(F.when(d >= 0, F.col("success_support")).otherwise(F.col("failure_support"))), mining.name("motif"))
    return sided.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def tags(success: Column, failure: Column, answers: Column, local: Column) -> Column:
    found = F.array(F.when((success > 0) & (failure > 0), "mixed_outcomes"), F.when((failure > 0) & (success / (success + failure) < 0.5), "hard_question"), F.when(answers >= 3, "high_diversity"), F.when(~local, "low_evidence"))
    return F.filter(found, lambda t: t.isNotNull())


def question_summaries(traces: DataFrame) -> DataFrame:
    """One row for each question; `separation` is what an explorer orders them by."""
    n = F.size("tokens")
    base = traces.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("total_traces"), F.count_if("is_correct").alias("success_count"), F.count_if(~F.col("is_correct")).alias("failure_count"), F.avg(n).alias("avg_token_count"), F.median(n).alias("median_token_count"),
        F.count_distinct("predicted_answer").alias("distinct_answers"), F.median(F.when(F.col("is_correct"), n)).alias("_ms"), F.median(F.when(~F.col("is_correct"), n)).alias("_mf"),
    )
    local = local_rows(traces)
    found = local.groupBy("question_id").agg(F.max(F.abs("support_difference")).alias("separation"))
    best = split_by_direction(local, 1)
    tops = best.groupBy("question_id").agg(*(F.max(F.when(F.col("direction") == d, mining.name("motif"))).alias(f"top_{d}_motif") for d in ("success", "failure")))
    out = base.join(found, "question_id", "left").join(tops, "question_id", "left").fillna(0.0, ["separation"])
    s, f = F.col("success_count"), F.col("failure_count")
    available = (s >= 2) & (f >= 2) & F.col("top_success_motif").isNotNull() | (s >= 2) & (f >= 2) & F.col("top_failure_motif").isNotNull()
    say = lambda k, *values: F.format_string(SENTENCES[k], *values) if values else F.lit(SENTENCES[k])
    mood = F.when((s > 0) & (f > 0), say("mixed", s, f)).when(s > 0, say("right")).otherwise(say("wrong"))
    length = F.when(F.col("_ms") < F.col("_mf"), say("shorter")).when(F.col("_ms") > F.col("_mf"), say("longer")).when(F.col("_ms") == F.col("_mf"), say("even"))
    up, down = (F.when(available, say(k, f"top_{d}_motif")) for k, d in (("up", "success"), ("down", "failure")))
    spread = F.when(F.col("distinct_answers") >= 3, say("spread", "distinct_answers"))
    bullets = F.array(mood, length, F.when(F.col("top_success_motif").isNotNull(), up), F.when(F.col("top_failure_motif").isNotNull(), down), spread)
    out = out.withColumn("success_rate", s / (s + f)).withColumn("tags", tags(s, f, F.col("distinct_answers"), available)).withColumn("insights", F.slice(F.filter(bullets, lambda b: b.isNotNull()), 1, 4))
    return out.drop("_ms", "_mf")


def representatives(traces: DataFrame, k: int = 3) -> DataFrame:
    """For each question and class the traces with most of its local motifs, then nearest to its median length, then first by id."""
    chosen = split_by_direction(local_rows(traces)).select("question_id", "motif", (F.col("direction") == "success").alias("is_correct"))
    hits = mining.facts(traces, ngrams(F.col("tokens"), LOCAL_LOW, LOCAL_HIGH), "question_id", "is_correct", "trace_id").join(chosen, ["question_id", "is_correct", "motif"]).groupBy("trace_id").agg(F.count(F.lit(1)).alias("matches"))
    group = traces.groupBy("question_id", "is_correct").agg(F.median(F.size("tokens")).alias("m"))
    rows = traces.select("question_id", "is_correct", "trace_id", F.size("tokens").alias("len")).join(group, ["question_id", "is_correct"]).join(hits, "trace_id", "left").fillna(0, ["matches"])
    w = Window.partitionBy("question_id", "is_correct").orderBy(F.desc("matches"), F.abs(F.col("len") - F.col("m")), "trace_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("question_id", "is_correct", "rank", "trace_id", "matches")


def overview(traces: DataFrame, label: str = LABEL) -> DataFrame:
    n = F.size("tokens")
    return traces.agg(F.lit(label).alias("corpus_label"), F.count(F.lit(1)).alias("total_traces"), F.count_distinct("question_id").alias("total_questions"), F.avg(F.col("is_correct").cast("int")).alias("success_rate"), F.avg(n).alias("avg_token_count"), F.median(n).alias("median_token_count"))


def write_questions(traces: DataFrame, path: str, label: str = LABEL) -> None:
    """Question details as JSON rows, ordered by question within the files, beside the overview and the list of questions."""
    details = question_summaries(traces)
    answers = answer_distribution(traces).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "predicted_answer", "count", "share"))).alias("answer_distribution"))
    shown = representatives(traces).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("is_correct", "rank", "trace_id"))).alias("representative_traces"))
    details.write.mode("overwrite").json(f"{path}/questions")
    details.join(answers, "question_id", "left").join(shown, "question_id", "left").repartitionByRange("question_id").sortWithinPartitions("question_id").write.mode("overwrite").json(f"{path}/question")
    overview(traces, label).write.mode("overwrite").json(f"{path}/overview")


class Service:
    """Read-only lookups over an export: the overview, the questions in order, one question."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path
        for part in ("overview", "questions", "question"):
            spark.read.json(f"{path}/{part}").limit(0).collect()  # a missing part fails here

    def overview(self) -> dict:
        return json.loads(self.spark.read.json(f"{self.path}/overview").toJSON().first())

    def questions(self, search: str = "", mixed: bool = False, diverse: bool = False, sort: str = "signal") -> DataFrame:
        rows = self.spark.read.json(f"{self.path}/questions")
        keep = F.lower("question_id").contains(search.lower())
        if mixed:
            keep &= F.array_contains("tags", "mixed_outcomes")
        if diverse:
            keep &= F.array_contains("tags", "high_diversity")
        first = {"signal": F.desc("separation"), "success_rate": F.desc("success_rate"), "trace_count": F.desc("total_traces")}[sort]
        return rows.filter(keep).orderBy(first, "question_id")

    def question(self, question_id: str) -> dict:
        found = self.spark.read.json(f"{self.path}/question").filter(F.col("question_id").cast("string") == question_id).toJSON().take(1)
        if not found:
            raise KeyError(question_id)
        return json.loads(found[0])


def write_csv(df: DataFrame, path: str, six: tuple[str, ...] = ()) -> None:
    """A CSV folder with a header, also where there are no rows; arrays joined by bars, `six` with six decimals."""
    flat = [F.array_join(c, "|").alias(c) if t.startswith("array") else F.format_string("%s", stats.fixed(c, 6)).alias(c) if c in six else F.col(c) for c, t in df.dtypes]
    out = df.select(*flat)
    if out.isEmpty():
        out = out.sparkSession.createDataFrame([], out.schema).coalesce(1)
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def markdown(df: DataFrame, title: str, k: int = 25) -> str:
    """A report table of the first k rows."""
    rows = df.take(k)
    head = f"# {title}\n\n| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns) + "\n"
    return head + "".join("| " + " | ".join(f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |\n" for r in rows)


def bundles(traces: DataFrame, low: int = 2, high: int = 3, least: int = 2) -> DataFrame:
    """Motif cards of every question in one pass."""
    return cards.motif_cards(traces, low, high, least, by=("question_id",))


def write_json(value: object, path: str) -> None:
    """A small artifact with sorted keys, on the driver's disk: a summary of one row, not a table."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False, default=str) + "\n")


def plot_data(rows: DataFrame, label: str, value: str, low: str | None = None, high: str | None = None, k: int = 25) -> DataFrame:
    """What a bar or forest plot draws: the k largest values by size, with limits where there are any, in the order of the bars."""
    return rows.orderBy(F.desc(F.abs(value)), label).limit(k).select(F.row_number().over(Window.orderBy(F.desc(F.abs(value)), label)).alias("place"), F.col(label).alias("label"), F.col(value).alias("value"), *(F.col(c).alias(n) for c, n in ((low, "low"), (high, "high")) if c))


def histogram(rows: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """bin, start, stop, count over equal bins from the least to the largest value, the last one closed."""
    ends = rows.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    width = F.greatest((F.col("hi") - F.col("lo")) / bins, F.lit(1e-12))
    at = rows.select(F.col(value).cast("double").alias("x")).filter("x is not null").crossJoin(F.broadcast(ends)).select(F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1)).alias("bin"), "lo", width.alias("w"))
    return at.groupBy("bin").agg((F.first("lo") + F.col("bin") * F.first("w")).alias("start"), (F.first("lo") + (F.col("bin") + 1) * F.first("w")).alias("stop"), F.count(F.lit(1)).alias("count"))
