"""Contrasts within questions: what a feature's presence does to success, averaged over questions.

All of them start from the same two aggregations: totals of each question, and for each question and
feature the traces that hold it. Traces without the feature are the difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelith.functions import stats
from tracelith.functions.tokens import first_action, position_bins, prefix


def mixed(traces: DataFrame) -> DataFrame:
    """Traces of the questions that have both outcomes."""
    both = traces.groupBy("question_id").agg(F.min("is_correct").alias("a"), F.max("is_correct").alias("b")).filter("a <> b").select("question_id")
    return traces.join(both, "question_id", "left_semi")


def question_totals(traces: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return traces.groupBy(*keys, "question_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("s"), F.avg(F.size("tokens")).alias("avg_len"))


def per_question(traces: DataFrame, features: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row for each feature and question where it occurs: n_with, s_with, and the question's totals."""
    held = traces.select(*keys, "question_id", "is_correct", F.explode(F.array_distinct(features)).alias("token"))
    held = held.groupBy(*keys, "question_id", "token").agg(F.count(F.lit(1)).alias("n_with"), F.count_if("is_correct").alias("s_with"))
    out = held.join(question_totals(traces, keys), [*keys, "question_id"]).withColumn("n_without", F.col("n") - F.col("n_with"))
    out = out.withColumn("succ_with_token", F.col("s_with") / F.col("n_with")).withColumn("succ_without_token", F.when(F.col("n_without") > 0, (F.col("s") - F.col("s_with")) / F.col("n_without")))
    return out.withColumn("baseline", F.col("s") / F.col("n")).withColumn("delta_q", F.col("succ_with_token") - F.col("succ_without_token"))


def token_deltas(traces: DataFrame, features: Column | None = None, least_questions: int = 10, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean and median of the within-question differences of each token, sign test, q, and what trace length doesn't explain.

    question_presence counts all mixed questions that hold the token, questions_used those with traces on both sides.
    """
    rows = per_question(mixed(traces), F.col("tokens") if features is None else features, keys)
    d = F.col("delta_q")
    out = rows.groupBy(*keys, "token").agg(
        F.count(F.lit(1)).alias("question_presence"), F.count(d).alias("questions_used"), F.avg(d).alias("mean_delta"), F.median(d).alias("median_delta"),
        F.avg(F.when(d.isNotNull(), F.col("baseline"))).alias("mean_question_baseline"), F.median(F.when(d.isNotNull(), F.col("baseline"))).alias("median_question_baseline"),
        F.count_if(d > 0).alias("sign_pos"), F.count_if(d < 0).alias("sign_neg"), F.avg(F.when(d.isNotNull(), F.col("avg_len"))).alias("avg_question_trace_len"),
    )
    out = out.filter((F.col("question_presence") >= least_questions) & (F.col("questions_used") > 0))
    out = out.withColumn("sign_n_nonzero", F.col("sign_pos") + F.col("sign_neg")).withColumn("sign_test_p", stats.sign_test(F.col("sign_pos"), F.col("sign_neg")))
    return with_residuals(stats.benjamini_hochberg(out, "sign_test_p", "bh_q", list(keys) or None), "avg_question_trace_len", "mean_delta", "length_control_residual", keys)


def with_residuals(df: DataFrame, x: str, y: str, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds y less its least-squares line on x; less its mean where x doesn't vary."""
    fit = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("_b"), F.avg(y).alias("_y"), F.avg(x).alias("_x"), F.max(x).alias("_hi"), F.min(x).alias("_lo"))
    out = df.join(fit, list(keys)) if keys else df.crossJoin(F.broadcast(fit))
    slope = F.when(F.col("_hi") - F.col("_lo") > stats.EPSILON, F.coalesce("_b", F.lit(0.0))).otherwise(0.0)
    return out.withColumn(name, F.col(y) - F.col("_y") - slope * (F.col(x) - F.col("_x"))).drop("_b", "_y", "_x", "_hi", "_lo")


def count_buckets(traces: DataFrame, least_questions: int = 10) -> DataFrame:
    """Success where a token stands once, or more often, against where it doesn't, by question; one q family over both tests."""
    rows = mixed(traces)
    times = rows.select("trace_id", "question_id", "is_correct", F.explode("tokens").alias("token")).groupBy("trace_id", "question_id", "token").agg(F.count(F.lit(1)).alias("k"), F.first("is_correct").alias("is_correct"))
    per = times.groupBy("question_id", "token").agg(*(f.alias(f"{a}{b}") for b, c in (("1", F.col("k") == 1), ("2", F.col("k") >= 2)) for a, f in (("n", F.count_if(c)), ("s", F.count_if(c & F.col("is_correct"))))))
    per = per.join(question_totals(rows), "question_id")
    without = F.col("n") - F.col("n1") - F.col("n2")
    zero = (F.col("s") - F.col("s1") - F.col("s2")) / F.nullif(without, F.lit(0))
    per = per.withColumns({f"d{b}": F.col(f"s{b}") / F.nullif(F.col(f"n{b}"), F.lit(0)) - zero for b in "12"})
    names = {"1": "1_vs_0", "2": "2plus_vs_0"}
    aggs = [F.count(F.lit(1)).alias("question_presence")]
    for b, n in names.items():
        d = F.col(f"d{b}")
        aggs += [F.count(d).alias(f"n_q_{n}"), F.coalesce(F.avg(d), F.lit(0.0)).alias(f"mean_delta_{n}"), F.coalesce(F.median(d), F.lit(0.0)).alias(f"median_delta_{n}"), F.count_if(d > 0).alias(f"_p{b}"), F.count_if(d < 0).alias(f"_n{b}")]
    out = per.groupBy("token").agg(*aggs).filter((F.col("question_presence") >= least_questions) & (F.col("n_q_1_vs_0") + F.col("n_q_2plus_vs_0") > 0))
    out = out.withColumns({f"p_{n}": stats.sign_test(F.col(f"_p{b}"), F.col(f"_n{b}")) for b, n in names.items()})
    both = out.select("token", F.explode(F.array(*(F.struct(F.lit(n).alias("side"), F.col(f"p_{n}").alias("p")) for n in names.values()))).alias("t")).select("token", "t.*")
    q = stats.benjamini_hochberg(both, "p", "q").groupBy("token").agg(*(F.max(F.when(F.col("side") == n, F.col("q"))).alias(f"q_{n}") for n in names.values()))
    return out.join(q, "token").drop("_p1", "_n1", "_p2", "_n2")


def position_deltas(traces: DataFrame, least_questions: int = 10) -> DataFrame:
    """Deltas of tokens in a third of the trace, beside the token's own delta and their ratio (0 where that is 0 or unknown)."""
    plain = token_deltas(traces, least_questions=least_questions).select(F.col("token").alias("base"), F.col("mean_delta").alias("collapsed_delta"))
    placed = token_deltas(traces, position_bins(F.col("tokens")), least_questions)
    placed = placed.withColumn("base", F.regexp_extract("token", r"^(.*)@@[^@]*$", 1)).withColumn("bin", F.regexp_extract("token", r"@@([^@]*)$", 1))
    out = placed.join(plain, "base", "left").fillna(0.0, ["collapsed_delta"])
    return out.withColumn("lift_ratio", F.when(F.col("collapsed_delta") == 0, F.lit(0.0)).otherwise(F.abs("mean_delta") / F.abs("collapsed_delta")))


def first_action_deltas(traces: DataFrame, least_questions: int = 2) -> DataFrame:
    """Deltas of each trace's first token (or first `action:` token, where there are such)."""
    one = F.array(F.coalesce(F.nullif(first_action(F.col("tokens")), F.lit("__NO_FIRST_ACTION__")), F.get("tokens", F.lit(0))))
    out = token_deltas(traces.filter(F.size("tokens") > 0), one, least_questions)
    n = traces.filter(F.size("tokens") > 0).select(one[0].alias("token"), "is_correct", "question_id")
    summary = n.groupBy("token").agg(F.count(F.lit(1)).alias("count"), F.countDistinct("question_id").alias("n_questions"), F.avg(F.col("is_correct").cast("int")).alias("success_rate"))
    return summary.join(out.select("token", "mean_delta", "questions_used", "sign_test_p", "bh_q"), "token", "left")


def prefix_leaderboard(traces: DataFrame, fractions: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0), least_questions: int = 10) -> DataFrame:
    """Token deltas over the first part of the traces, for each fraction, with the share of questions that gain."""
    cut = traces.withColumn("fraction", F.explode(F.array(*map(F.lit, fractions)))).withColumn("tokens", prefix(F.col("tokens"), F.col("fraction")))
    rows = per_question(mixed(cut), F.col("tokens"), ("fraction",))
    d = F.col("delta_q")
    out = rows.groupBy("fraction", "token").agg(F.count(d).alias("questions_used"), F.avg(d).alias("mean_delta"), F.avg((d > 0).cast("int")).alias("positive_fraction"), F.sum("n_with").alias("support"))
    return out.filter(F.col("questions_used") >= least_questions)


def lengths_by_question(traces: DataFrame, least: int = 2) -> DataFrame:
    """Trace lengths of both classes for each question; questions with too few of a class stay, with nulls."""
    length = F.size("tokens")
    rows = traces.select("question_id", "is_correct", length.alias("len"))
    x = lambda ok: F.when(F.col("is_correct") if ok else ~F.col("is_correct"), F.col("len"))
    out = rows.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n_total"), F.count(x(True)).alias("n_correct"), F.count(x(False)).alias("n_incorrect"), F.avg(x(True)).alias("mean_len_correct"), F.avg(x(False)).alias("mean_len_incorrect"),
        F.median(x(True)).alias("median_len_correct"), F.median(x(False)).alias("median_len_incorrect"), F.var_samp(x(True)).alias("_v1"), F.var_samp(x(False)).alias("_v0"),
    )
    effect = stats.auc(rows, "len", "is_correct", ["question_id"]).select("question_id", F.col("auc").alias("common_language_effect"))
    out = out.join(effect, "question_id")
    n1, n0 = F.col("n_correct"), F.col("n_incorrect")
    pooled = F.sqrt(((n1 - 1) * F.col("_v1") + (n0 - 1) * F.col("_v0")) / F.nullif(n1 + n0 - 2, F.lit(0)))
    delta = F.col("mean_len_correct") - F.col("mean_len_incorrect")
    enough = (n1 >= least) & (n0 >= least)
    out = out.withColumn("delta_mean", delta).withColumn("cohen_d", F.when((n1 < 2) | (n0 < 2) | (pooled == 0), F.lit(0.0)).otherwise(delta / pooled))
    out = out.withColumns({c: F.when(enough, F.col(c)) for c in ("mean_len_correct", "mean_len_incorrect", "median_len_correct", "median_len_incorrect", "cohen_d", "common_language_effect", "delta_mean")})
    return out.withColumn("direction", F.when(~enough, "insufficient_data").when(F.col("delta_mean") > 0, "correct_longer").when(F.col("delta_mean") < 0, "incorrect_longer").otherwise("equal")).drop("_v1", "_v0")


def length_summary(by_question: DataFrame) -> DataFrame:
    """One row over the questions with enough of both classes."""
    ok = by_question.filter("direction <> 'insufficient_data'")
    d = F.col("delta_mean")
    up, down = F.count_if(d > 0), F.count_if(d < 0)
    out = ok.agg(
        F.count(F.lit(1)).alias("n_valid_questions"), F.coalesce(F.sum(d * F.col("n_total")) / F.sum("n_total"), F.lit(0.0)).alias("weighted_mean_delta"), F.coalesce(F.avg(d), F.lit(0.0)).alias("unweighted_mean_delta"),
        F.coalesce(F.median(d), F.lit(0.0)).alias("median_delta"), up.alias("questions_correct_longer"), down.alias("questions_incorrect_longer"), F.count_if(d == 0).alias("questions_equal"),
        F.coalesce(up / F.nullif(up + down, F.lit(0)), F.lit(0.0)).alias("fraction_correct_longer"),
    )
    return out.withColumn("sign_test_p", stats.sign_test(F.col("questions_correct_longer"), F.col("questions_incorrect_longer")))


def nearest_length_pairs(traces: DataFrame, gap: int = 1) -> DataFrame:
    """For each successful trace the failed one of its question nearest in length, within `gap`; ties to the smaller trace_id.

    Candidates are first cut to one failed trace for each question and length, so a large question can't pair up all its traces.
    """
    rows = traces.select("question_id", "trace_id", "is_correct", F.size("tokens").alias("len"))
    failed = rows.filter(~F.col("is_correct")).groupBy("question_id", "len").agg(F.min("trace_id").alias("failure_id"))
    wanted = rows.filter("is_correct").withColumn("at", F.explode(F.sequence(F.col("len") - gap, F.col("len") + gap)))
    pairs = wanted.join(failed.select("question_id", F.col("len").alias("at"), "failure_id"), ["question_id", "at"])
    best = Window.partitionBy("trace_id").orderBy(F.abs(F.col("at") - F.col("len")), "failure_id")
    return pairs.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select("question_id", F.col("trace_id").alias("success_id"), "failure_id", F.col("len").alias("success_len"), F.col("at").alias("failure_len"))
