"""Motif cards, families, coverage, neighbours, and local analysis of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelith.functions import stats
from tracelith.functions.tokens import NOISE_TOKEN, first_place, ngrams, stage_of
from tracelith.operators.mining import class_counts, facts, name


def allowed(motif: Column, excluded: tuple[str, ...]) -> Column:
    return ~F.exists(motif, lambda t: F.lit(False) if not excluded else F.greatest(*(F.lower(t).contains(x) for x in excluded), F.lit(False)))


def first_position(tokens: Column, motif: Column) -> Column:
    """0 to 1: where the motif first stands; 0.5 if it is the whole trace."""
    n, w = F.size(tokens), F.size(motif)
    return F.when(n == w, F.lit(0.5)).otherwise(first_place(tokens, motif) / F.greatest(F.lit(1), n - w))


def motif_cards(traces: DataFrame, low: int = 2, high: int = 3, least: int = 8, examples: int = 3, excluded: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """One card for each motif, or for each motif of each of `by` (question bundles); `examples` holds the first traces by id."""
    rows = facts(traces, ngrams(F.col("tokens"), low, high), *dict.fromkeys([*by, "question_id", "trace_id", "is_correct", "tokens"]))
    seen = rows.groupBy(*by, "motif").agg(
        F.count(F.lit(1)).alias("support"), F.count_if("is_correct").alias("success_present"), F.count_distinct("question_id").alias("question_coverage"),
        F.avg(first_position(F.col("tokens"), F.col("motif"))).alias("avg_stage_position"), F.avg(F.size("tokens")).alias("avg_trace_length_present"), F.avg(F.array_contains("tokens", NOISE_TOKEN).cast("int")).alias("noise_cooccurrence_rate"),
    ).filter((F.col("support") >= least) & allowed(F.col("motif"), excluded))
    all_rows = traces.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if("is_correct").alias("total_success"))
    out = seen.join(all_rows, list(by)) if by else seen.crossJoin(F.broadcast(all_rows))
    a, b = F.col("success_present"), F.col("support") - F.col("success_present")
    c = F.col("total_success") - a
    d = F.col("total") - F.col("support") - c
    overall = F.col("total_success") / F.col("total")
    present = a / F.col("support")
    absent = F.coalesce(c / F.nullif(c + d, F.lit(0)), overall)
    ratio, ci_low, ci_high = stats.odds_ratio(a, b, c, d)
    out = out.withColumns({
        "failure_present": b, "prevalence": F.col("support") / F.col("total"), "success_rate_present": present, "success_rate_absent": absent, "support_difference": present - absent,
        "lift_overall_success": F.coalesce(present / F.nullif(overall, F.lit(0.0)), F.lit(0.0)), "odds_ratio": ratio, "odds_ratio_ci_low": ci_low, "odds_ratio_ci_high": ci_high,
        "fisher_p_value": stats.fisher(a, b, c, d, relative=False), "stage_bucket": stage_of(F.col("avg_stage_position")),
    })
    out = stats.benjamini_hochberg(out, "fisher_p_value", "fdr_q_value", list(by) or None).drop("total", "total_success")
    if not examples:
        return out
    # the first k ids of each motif, found task by task before they meet
    part = Window.partitionBy(*by, "motif").orderBy("trace_id")
    first = rows.select(*by, "motif", "trace_id").withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= examples).groupBy(*by, "motif").agg(F.array_sort(F.collect_list("trace_id")).alias("examples"))
    return out.join(first, [*by, "motif"])


def families(cards: DataFrame, k: int = 15) -> DataFrame:
    """The k best cards of the families top (|difference|), success and failure."""
    d = F.col("support_difference")
    of = lambda f, keep, order: cards.filter(keep).withColumn("family", F.lit(f)).orderBy(order, F.desc("support"), name("motif")).limit(k).withColumn("rank", F.row_number().over(Window.partitionBy("family").orderBy(order, F.desc("support"), name("motif"))))
    return of("top", F.lit(True), F.abs(d).desc()).unionByName(of("success", d > 0, d.desc())).unionByName(of("failure", d < 0, d.asc()))


def neighbours(traces: DataFrame, cards: DataFrame, low: int = 2, high: int = 3, k: int = 5) -> DataFrame:
    """Cards that share most traces with a card: overlap over the card's own traces; ties to the later name."""
    held = facts(traces, ngrams(F.col("tokens"), low, high), "trace_id").join(cards.select("motif"), "motif").withColumn("motif", F.array_join("motif", " "))
    own = held.groupBy("motif").agg(F.count(F.lit(1)).alias("n"))
    # pairs are made within a trace, whose motifs its length bounds, and counted at once
    pairs = held.groupBy("trace_id").agg(F.collect_list("motif").alias("m")).select(F.explode("m").alias("motif"), "m").select("motif", F.explode("m").alias("other")).filter("motif <> other")
    rate = pairs.groupBy("motif", "other").agg(F.count(F.lit(1)).alias("overlap")).join(own, "motif").withColumn("overlap_rate", F.col("overlap") / F.col("n"))
    best = Window.partitionBy("motif").orderBy(F.desc("overlap_rate"), F.desc("other"))
    return rate.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("motif", "rank", "other", "overlap", "overlap_rate")


def coverage(traces: DataFrame, cards: DataFrame) -> DataFrame:
    """Traces and questions that hold a chosen card; contiguous motifs of one to three tokens are looked at."""
    held = facts(traces, ngrams(F.col("tokens"), 1, 3), "trace_id", "question_id").join(cards.select("motif"), "motif", "left_semi")
    found = held.agg(F.count_distinct("trace_id").alias("covered_traces"), F.count_distinct("question_id").alias("covered_questions"))
    every = traces.agg(F.count(F.lit(1)).alias("traces"), F.count_distinct("question_id").alias("questions"))
    out = found.crossJoin(every)
    return out.withColumn("trace_fraction", F.col("covered_traces") / F.col("traces")).withColumn("question_fraction", F.col("covered_questions") / F.col("questions"))


def local_motifs(traces: DataFrame, low: int = 1, high: int = 3, least_class: int = 2, least: int = 2) -> DataFrame:
    """Motifs of each question with enough of both classes: counts, support difference, log odds, exact permutation p, q in the question.

    The permutation test's limit is exact: over all ways to deal the labels, those whose support
    difference is at least the observed one in size.
    """
    size = traces.groupBy("question_id").agg(F.count_if("is_correct").alias("success_total"), F.count_if(~F.col("is_correct")).alias("failure_total")).filter((F.col("success_total") >= least_class) & (F.col("failure_total") >= least_class))
    counts = class_counts(facts(traces, ngrams(F.col("tokens"), low, high), "question_id", "is_correct"), "question_id", "motif").withColumn("support_total", F.col("success_count") + F.col("failure_count"))
    rows = counts.filter(F.col("support_total") >= least).join(size, "question_id")
    s, f, n, m = (F.col(c) for c in ("success_count", "failure_count", "success_total", "failure_total"))
    rows = rows.withColumns({"support_delta": s / n - f / m, "log_odds_ratio": stats.log_odds(s, n, f, m), "p_correct_given_motif": s / F.col("support_total"), "p_value": exact_difference(s, f, n, m)})
    return stats.benjamini_hochberg(rows, "p_value", "q_value", ["question_id"])


def exact_difference(s: Column, f: Column, n: Column, m: Column) -> Column:
    """Share of the deals of s + f marks to n and m rows whose rates differ by as much as s / n and f / m do."""
    k, total = s + f, n + m
    fixed = stats.ln_factorial(n) + stats.ln_factorial(m) + stats.ln_factorial(k) + stats.ln_factorial(total - k) - stats.ln_factorial(total)
    low, high = stats.around(F.greatest(F.lit(0), k - m), F.least(n, k), k * n / total, F.sqrt(n / total * k * m / total * (total - k) / F.greatest(total - 1, F.lit(1))))
    row = F.struct(fixed.alias("fixed"), k.alias("k"), n.alias("n"), m.alias("m"), F.abs(s * m - f * n).alias("seen"), low.alias("low"), high.alias("high"))

    def body(t: Column) -> Column:
        far = F.filter(F.sequence(t["low"], t["high"]), lambda x: F.abs(x * t["m"] - (t["k"] - x) * t["n"]) >= t["seen"])
        p = F.transform(far, lambda x: F.exp(t["fixed"] - stats.ln_factorial(x) - stats.ln_factorial(t["n"] - x) - stats.ln_factorial(t["k"] - x) - stats.ln_factorial(t["m"] - t["k"] + x)))
        return F.least(F.lit(1.0), F.aggregate(p, F.lit(0.0), lambda a, b: a + b))

    return F.transform(F.array(row), body)[0]


def local_lists(local: DataFrame, k: int = 10, q: float = 0.10) -> DataFrame:
    """Each question's k best motifs of both directions, and those of them under the q threshold, as ranked lists."""
    d = F.col("log_odds_ratio")
    side = local.filter(d != 0).withColumn("direction", F.when(d > 0, "success").otherwise("failure"))
    order = [F.asc("q_value"), F.desc(F.abs(d)), F.desc("support_total"), name("motif")]
    top = side.withColumn("rank", F.row_number().over(Window.partitionBy("question_id", "direction").orderBy(*order)))
    return top.filter(F.col("rank") <= k).withColumn("significant", F.col("q_value") <= q)


def shared_lists(local: DataFrame, other: DataFrame, k: int = 10) -> DataFrame:
    """Questions of both analyses: how far their lists of best motifs overlap (intersection over union), by direction."""
    of = lambda x, c: local_lists(x, k).groupBy("question_id", "direction").agg(F.collect_set(name("motif")).alias(c))
    both = of(local, "a").join(of(other, "b"), ["question_id", "direction"])
    return both.select("question_id", "direction", F.size(F.array_intersect("a", "b")).alias("shared"), (F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))).alias("jaccard"))


def visible_globals(traces: DataFrame, global_motifs: DataFrame, k: int = 5) -> DataFrame:
    """For each question the first k global motifs (motif, place) that one of its traces holds."""
    held = facts(traces, ngrams(F.col("tokens"), 1, 5), "question_id").join(global_motifs, "motif").groupBy("question_id", "motif", "place").agg(F.count(F.lit(1)).alias("traces"))
    return held.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("place", name("motif")))).filter(F.col("rank") <= k)
