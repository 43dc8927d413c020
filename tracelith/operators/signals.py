"""Signals of traces, their metrics against the outcome, and a score of success made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelith.functions import stats
from tracelith.operators import evaluate
from tracelith.sources.scratch import Scratch

SIGNALS = ("success_signal", "failure_signal", "net_signal", "trace_length", "success_to_failure_ratio", "log_success_to_failure_ratio")
SMALL = 1e-9


def signal_columns(traces: DataFrame) -> DataFrame:
    """Adds the ratio of success to failure signal and its logarithm; trace_length comes from the tokens where it isn't there."""
    ratio = (F.col("success_signal") + SMALL) / (F.col("failure_signal") + SMALL)
    out = traces if "trace_length" in traces.columns else traces.withColumn("trace_length", F.size("tokens"))
    return out.withColumn("trace_length", F.col("trace_length").cast("double")).withColumn("success_to_failure_ratio", ratio).withColumn("log_success_to_failure_ratio", F.log(ratio))


def metrics(traces: DataFrame, signals: tuple[str, ...] = SIGNALS, label: str = "is_correct") -> DataFrame:
    """signal, place (strongest first), pearson_with_correct, mean_correct, mean_incorrect, best_threshold, best_threshold_accuracy.

    Signals and label are written once: the thresholds read them many times, and must not make the traces anew.
    """
    traces = Scratch(traces.sparkSession).write(traces.select(*dict.fromkeys([*signals, label])), "signals")
    report = evaluate.signal_report(traces, list(signals), label)
    best = reduce(DataFrame.unionByName, (evaluate.best_threshold(traces, s, label).select(F.lit(s).alias("signal"), F.col("value").alias("best_threshold"), F.col("accuracy").alias("best_threshold_accuracy")) for s in signals))
    return report.join(best, "signal").select("signal", F.col("rank").alias("place"), F.col("pearson").alias("pearson_with_correct"), F.col("mean_success").alias("mean_correct"), F.col("mean_failure").alias("mean_incorrect"), "best_threshold", "best_threshold_accuracy")


def success_scores(traces: DataFrame, known: DataFrame) -> DataFrame:
    """Adds raw_score, p_success, predicted and signal_contributions.

    A signal adds its |correlation| times its distance from the threshold, in units of the distance of the class
    means, signed by the correlation's direction. Metrics of signals that the traces lack don't count. There is a
    row for each signal: a handful, so they go into the plan.
    """
    parts: list[Column] = []
    for m in sorted(known.collect(), key=lambda m: m["place"]):
        if m["signal"] in traces.columns:
            scale = abs(m["mean_correct"] - m["mean_incorrect"])
            weight = m["pearson_with_correct"] / (scale if scale >= SMALL else 1.0)
            parts.append(F.struct(F.lit(m["signal"]).alias("signal"), (weight * (F.col(m["signal"]).cast("double") - m["best_threshold"])).alias("part")))
    if not parts:
        return traces.withColumn("raw_score", F.lit(0.0)).withColumn("p_success", F.lit(0.5)).withColumn("predicted", F.lit(True)).withColumn("signal_contributions", F.lit(""))
    out = traces.withColumn("_parts", F.array(*parts)).withColumn("raw_score", F.aggregate("_parts", F.lit(0.0), lambda a, x: a + x["part"]))
    p = 1 / (1 + F.exp(-F.col("raw_score")))
    text = F.array_join(F.transform("_parts", lambda x: F.format_string("%s:%s", x["signal"], stats.fixed(x["part"], 3))), " || ")
    return out.withColumn("p_success", p).withColumn("predicted", p >= 0.5).withColumn("signal_contributions", text).drop("_parts")


def prediction_summary(scored: DataFrame, label: str = "is_correct") -> DataFrame:
    """rows, accuracy at one half, mean_p_success of the six-digit chances."""
    right = (F.col("predicted") == F.coalesce(F.col(label), F.lit(False))).cast("int")
    return scored.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.avg(right), F.lit(0.0)).alias("accuracy"), F.coalesce(F.avg(F.round("p_success", 6)), F.lit(0.0)).alias("mean_p_success"))


def trajectory(points: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Least-squares slope of y over x and whether y never falls; slope 0 and true under two points."""
    order = Window.partitionBy(*by, F.lit(1)).orderBy(x)
    steps = points.withColumn("_falls", F.coalesce(F.lag(y).over(order) > F.col(y) + 1e-12, F.lit(False)))
    return steps.groupBy(*by).agg(F.when(F.count(F.lit(1)) < 2, F.lit(0.0)).otherwise(F.coalesce(F.nanvl(F.regr_slope(y, x), F.lit(0.0)), F.lit(0.0))).alias("slope"), (~F.coalesce(F.bool_or("_falls"), F.lit(False))).alias("monotonic_non_decreasing"))


def shuffled_prefix(tokens: Column, key: Column, seed: int = 73) -> Column:
    """The tokens in an order drawn by a hash of key, place and seed: the control for the order of a prefix."""
    drawn = F.transform(tokens, lambda t, i: F.struct(F.xxhash64(key, i, F.lit(seed)).alias("h"), i.alias("i"), t.alias("t")))
    return F.transform(F.array_sort(drawn), lambda x: x["t"])
