"""Evaluation of scores, folds by question, robustness over sources, detection times, clusters."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelith.functions import stats


def confusion(df: DataFrame, score: str, label: str, threshold: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    yes, y = F.col(score) >= threshold, F.col(label)
    out = df.groupBy(*by).agg(F.count_if(yes & y).alias("tp"), F.count_if(~yes & ~y).alias("tn"), F.count_if(yes & ~y).alias("fp"), F.count_if(~yes & y).alias("fn"))
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return out.withColumn("accuracy", share(tp + tn, tp + tn + fp + fn)).withColumn("balanced_accuracy", (share(tp, tp + fn) + share(tn, tn + fp)) / 2)


def calibration_error(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins, the last one closed."""
    b = df.groupBy(F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("p"), F.avg(F.col(label).cast("int")).alias("y"))
    return b.agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


def question_auc_summary(df: DataFrame, score: str, label: str) -> DataFrame:
    """Over the questions with both classes: mean AUC, share of 0.5 and of 0.6 at least."""
    a = stats.auc(df, score, label, ["question_id"]).filter("positives > 0 and negatives > 0")
    return a.agg(F.count(F.lit(1)).alias("questions"), F.avg("auc").alias("mean_auc"), F.avg((F.col("auc") >= 0.5).cast("int")).alias("rate_half"), F.avg((F.col("auc") >= 0.6).cast("int")).alias("rate_six"))


def signal_report(df: DataFrame, signals: list[str], label: str) -> DataFrame:
    """Pearson, Spearman and AUC of each signal against the label, and the means by class; strongest first."""
    y = F.col(label).cast("double")
    rows = df.select(y.alias("y"), F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("x")) for s in signals))).alias("t")).select("y", "t.*")
    # ranks by counts of distinct values: the mean rank of a value follows from the counts below it
    at = rows.groupBy("signal", "x").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"))
    w = Window.partitionBy("signal").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("rank", F.col("below") + (F.col("n") + 1) / 2).withColumn("neg_below", F.coalesce(F.sum(F.col("n") - F.col("p")).over(w), F.lit(0)))
    total, pos = F.sum("n"), F.sum("p")
    moment = lambda v: (F.sum(F.col("p") * v) / total - F.sum(F.col("n") * v) / total * pos / total) / F.nullif(F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("n") * v * v) / total - F.pow(F.sum(F.col("n") * v) / total, 2)) * (pos / total) * (1 - pos / total)), F.lit(0.0))
    out = at.groupBy("signal").agg(
        F.coalesce(moment(F.col("x")), F.lit(0.0)).alias("pearson"), F.coalesce(moment(F.col("rank")), F.lit(0.0)).alias("spearman"),
        F.when((pos > 0) & (pos < total), F.sum(F.col("p") * (F.col("neg_below") + (F.col("n") - F.col("p")) / 2)) / (pos * (total - pos))).otherwise(F.lit(0.5)).alias("auc"),
        (F.sum(F.col("p") * F.col("x")) / pos).alias("mean_success"), (F.sum((F.col("n") - F.col("p")) * F.col("x")) / (total - pos)).alias("mean_failure"),
    )
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs(F.round("pearson", 9))), "signal")))


def best_threshold(df: DataFrame, value: str, label: str) -> DataFrame:
    """The threshold and direction that classify best: accuracy, threshold (between neighbouring values), direction; the first best."""
    at = df.groupBy(F.col(value).cast("double").alias("x")).agg(F.count_if(label).alias("p"), F.count_if(~F.col(label)).alias("n"))
    at = stats.running_sum(stats.running_sum(at, "x", "p", "pb"), "x", "n", "nb")
    tot = df.agg(F.count_if(label).alias("all_p"), F.count_if(~F.col(label)).alias("all_n"))
    ends = at.crossJoin(F.broadcast(tot)).withColumn("ge", F.col("all_p") - F.col("pb") + F.col("nb")).withColumn("le", F.col("pb") + F.col("p") + F.col("all_n") - F.col("nb") - F.col("n"))
    both = ends.select("x", F.explode(F.array(F.struct(F.lit("ge").alias("direction"), F.col("ge").alias("hits")), F.struct(F.lit("le").alias("direction"), F.col("le").alias("hits")))).alias("t"), (F.col("all_p") + F.col("all_n")).alias("rows"))
    return both.select("x", "t.*", "rows").orderBy(F.desc("hits"), "x", "direction").limit(1).select(F.col("x").alias("value"), "direction", (F.col("hits") / F.col("rows")).alias("accuracy"))


def question_folds(spark: SparkSession, traces: DataFrame, folds: int = 5, seed: int = 73) -> DataFrame:
    """question_id, fold: the questions' sorted ids, shuffled by the seed, dealt in turn.

    Question ids alone come to the driver; they are the units of a study, not its rows.
    """
    ids = sorted(r.question_id for r in traces.select("question_id").distinct().collect())
    random.Random(seed).shuffle(ids)
    return spark.createDataFrame([(q, i % folds) for i, q in enumerate(ids)], "question_id string, fold int")


def hashed_folds(traces: DataFrame, folds: int = 5) -> DataFrame:
    """question_id, fold by a hash of the id: for any number of questions, without the driver."""
    return traces.select("question_id").distinct().withColumn("fold", F.pmod(F.crc32(F.col("question_id").cast("binary")), F.lit(folds)).cast("int"))


def group_folds(spark: SparkSession, traces: DataFrame, folds: int = 5) -> DataFrame:
    """question_id, fold: questions by size, largest first, each to the lightest fold."""
    sizes = traces.groupBy("question_id").agg(F.count(F.lit(1)).alias("n")).collect()
    weight, out = [0] * folds, []
    for r in sorted(sizes, key=lambda r: (-r.n, r.question_id)):
        k = weight.index(min(weight))
        weight[k] += r.n
        out.append((r.question_id, k))
    return spark.createDataFrame(out, "question_id string, fold int")


def stable_tokens(deltas: DataFrame, k: int = 30) -> DataFrame:
    """Tokens among the k strongest of several models (model, token, mean_delta): votes, the share, whether half of the models agree, mean and population deviation."""
    top = deltas.withColumn("r", F.row_number().over(Window.partitionBy("model").orderBy(F.desc(F.abs("mean_delta")), "token"))).filter(F.col("r") <= k)
    models = deltas.agg(F.count_distinct("model").alias("n_models"))
    out = top.groupBy("token").agg(F.count(F.lit(1)).alias("votes"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"), F.avg("mean_delta").alias("mean_delta"), F.stddev_pop("mean_delta").alias("std_delta"))
    return out.crossJoin(F.broadcast(models)).withColumn("vote_fraction", F.col("votes") / F.col("n_models")).withColumn("stable", F.col("votes") >= F.ceil(F.col("n_models") / 2))


def model_agreement(deltas: DataFrame) -> DataFrame:
    """For each pair of models: common tokens, Pearson and Spearman of their deltas, share of equal signs."""
    a, b = (deltas.select("token", F.col("model").alias(f"model_{s}"), F.col("mean_delta").alias(s)) for s in "ab")
    both = a.join(b, "token").filter("model_a < model_b")
    pair = Window.partitionBy("model_a", "model_b")
    rank = lambda c: F.rank().over(pair.orderBy(F.desc(c))) + (F.count(F.lit(1)).over(Window.partitionBy("model_a", "model_b", c)) - 1) / 2.0
    ranked = both.withColumn("ra", rank("a")).withColumn("rb", rank("b"))
    return ranked.groupBy("model_a", "model_b").agg(F.count(F.lit(1)).alias("common"), stats.correlation("a", "b").alias("pearson"), stats.correlation("ra", "rb").alias("spearman"), F.avg((F.signum("a") == F.signum("b")).cast("int")).alias("sign_agreement"))


def detection(scores: DataFrame, threshold: float = 0.7) -> DataFrame:
    """First prefix at which a trace's confidence, either way, reaches the threshold, and what it says; for all traces and by outcome.

    scores: trace_id, is_correct, fraction, score.
    """
    sure = F.greatest(F.col("score"), 1 - F.col("score")) >= threshold
    first = scores.groupBy("trace_id", "is_correct").agg(F.min(F.when(sure, F.col("fraction"))).alias("at"), F.min_by(F.col("score") >= 0.5, F.when(sure, F.col("fraction"))).alias("says"))
    first = first.withColumn("says", F.when(F.col("at").isNotNull(), F.col("says")))
    out = first.cube("is_correct").agg(F.grouping("is_correct").alias("g"), F.count(F.lit(1)).alias("traces"), F.count("at").alias("detected"), F.median("at").alias("median_at"), F.avg((F.col("says") == F.col("is_correct")).cast("int")).alias("accuracy"))
    name = F.when(F.col("g") == 1, "all").when(F.col("is_correct"), "success").otherwise("failure")
    return out.select(name.alias("subset"), "traces", "detected", (F.col("detected") / F.col("traces")).alias("detection_rate"), "median_at", "accuracy")


def delta_matrix(per_question: DataFrame, tokens: list[str]) -> DataFrame:
    """question_id with a column for each token: the mean delta, 0 where there is none."""
    cells = [F.coalesce(F.avg(F.when(F.col("token") == t, F.col("delta_q"))), F.lit(0.0)).alias(t) for t in tokens]
    return per_question.groupBy("question_id").agg(*cells)


def cluster_signatures(assigned: DataFrame, tokens: list[str], k: int = 5) -> DataFrame:
    """For each cluster its k lowest and k highest tokens by mean. assigned: question_id, cluster and the token columns."""
    rows = assigned.select("cluster", F.explode(F.array(*(F.struct(F.lit(t).alias("token"), F.col(t).alias("x")) for t in tokens))).alias("t")).select("cluster", "t.*").groupBy("cluster", "token").agg(F.avg("x").alias("mean_delta"), F.count(F.lit(1)).alias("questions"))
    w = Window.partitionBy("cluster")
    out = rows.withColumn("low_rank", F.row_number().over(w.orderBy("mean_delta", "token"))).withColumn("high_rank", F.row_number().over(w.orderBy(F.desc("mean_delta"), "token")))
    return out.filter((F.col("low_rank") <= k) | (F.col("high_rank") <= k))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings of the same rows."""
    two = lambda x: x * (x - 1) / 2.0
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    part = lambda keys: cells.groupBy(*keys).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("s"))
    out = part([a, b]).withColumnRenamed("s", "both").crossJoin(part([a]).withColumnRenamed("s", "sa")).crossJoin(part([b]).withColumnRenamed("s", "sb")).crossJoin(df.agg(F.count(F.lit(1)).alias("n")))
    expected = F.col("sa") * F.col("sb") / F.nullif(two(F.col("n")), F.lit(0.0))
    top = (F.col("sa") + F.col("sb")) / 2
    return out.select(F.when(top == F.coalesce(expected, F.lit(0.0)), F.lit(1.0)).otherwise((F.col("both") - expected) / (top - expected)).alias("ari"))


def leave_out_rate(traces: DataFrame) -> DataFrame:
    """The oracle baseline: each trace scored by its question's success rate."""
    return traces.withColumn("score", F.avg(F.col("is_correct").cast("int")).over(Window.partitionBy("question_id")))


def mode_label(rate: Column) -> Column:
    return F.when(rate >= 0.5, 1).otherwise(0)
