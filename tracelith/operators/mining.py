"""Motifs of labelled traces: n-grams, skip-grams, subsequences, rules, and their scores.

Each operator takes traces (trace_id, question_id, tokens, is_correct). Motifs are made inside a row
and counted by class in one aggregation; nothing is joined trace by trace.
"""

from __future__ import annotations

from pyspark.ml.fpm import PrefixSpan
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelith.functions import stats
from tracelith.functions.tokens import holds_subsequence, let, ngrams
from tracelith.sources.scratch import Scratch

SEPARATOR = "|"


def name(motif: Column | str) -> Column:
    return F.array_join(motif, SEPARATOR)


def skipgrams(tokens: Column, low: int, high: int, gap: int | None) -> Column:
    """Distinct sequences of low..high tokens whose neighbours skip `gap` tokens at most (None: any number)."""
    start = F.transform(tokens, lambda t, i: F.struct(F.array(t).alias("motif"), i.alias("last")))

    def longer(level: Column) -> Column:
        def each(s: Column) -> Column:
            last = F.size(tokens) - 1 if gap is None else F.least(F.size(tokens) - 1, s["last"] + gap + 1)
            grown = F.transform(F.sequence(s["last"] + 1, last), lambda j: F.struct(F.concat(s["motif"], F.array(F.get(tokens, j))).alias("motif"), j.alias("last")))
            return F.when(s["last"] + 1 <= last, grown).otherwise(F.filter(level, lambda _: F.lit(False)))

        return F.array_distinct(F.flatten(F.transform(level, each)))

    def rise(level: Column, n: int) -> Column:
        own = F.array_distinct(F.transform(level, lambda s: s["motif"])) if n >= low else F.expr("cast(array() as array<array<string>>)")
        return F.concat(own, let(longer(level), lambda next_level: rise(next_level, n + 1))) if n < high else own

    return let(start, lambda level: rise(level, 1))


def facts(traces: DataFrame, motifs: Column, *columns: str) -> DataFrame:
    """One row for each trace and distinct motif: the given columns and `motif`, an array of tokens."""
    return traces.select(*columns, F.explode(F.array_distinct(motifs)).alias("motif"))


def class_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """success_count and failure_count of each key; documents, as motifs are distinct in a trace."""
    return rows.groupBy(*keys).agg(F.count_if("is_correct").alias("success_count"), F.count_if(~F.col("is_correct")).alias("failure_count"))


def totals(traces: DataFrame) -> DataFrame:
    return traces.agg(F.count_if("is_correct").alias("success_total"), F.count_if(~F.col("is_correct")).alias("failure_total"))


def with_totals(counts: DataFrame, traces: DataFrame) -> DataFrame:
    """One row of totals goes to every motif."""
    return counts.crossJoin(F.broadcast(totals(traces)))


def scored(counts: DataFrame, traces: DataFrame, tests: bool = True) -> DataFrame:
    """Supports, difference, lift, log odds and, with `tests`, Fisher p and Benjamini-Hochberg q of motifs with class counts."""
    s, f, n, m = (F.col(c) for c in ("success_count", "failure_count", "success_total", "failure_total"))
    out = with_totals(counts, traces).withColumns({"success_support": stats.support(s, n), "failure_support": stats.support(f, m)})
    out = out.withColumns({"support_difference": F.col("success_support") - F.col("failure_support"), "lift": stats.lift(F.col("success_support"), F.col("failure_support")), "log_odds_ratio": stats.log_odds(s, n, f, m)})
    if tests:
        out = stats.benjamini_hochberg(out.withColumn("p_value", stats.fisher(s, n - s, f, m - f)), "p_value", "q_value")
    return out.withColumns({"abs_support_difference": F.abs("support_difference"), "abs_log_odds_ratio": F.abs("log_odds_ratio")}).drop("success_total", "failure_total")


def mine_ngrams(traces: DataFrame, low: int = 1, high: int = 3, least: int = 3, tests: bool = False) -> DataFrame:
    counts = class_counts(facts(traces, ngrams(F.col("tokens"), low, high), "is_correct"), "motif").filter(F.col("success_count") + F.col("failure_count") >= least)
    return scored(counts, traces, tests)


def mine_skipgrams(traces: DataFrame, low: int = 2, high: int = 4, gap: int = 2, least: int = 5, tests: bool = True) -> DataFrame:
    """The threshold is on both classes together."""
    counts = class_counts(facts(traces, skipgrams(F.col("tokens"), low, high, gap), "is_correct"), "motif").filter(F.col("success_count") + F.col("failure_count") >= least)
    return scored(counts, traces, tests)


def grown(traces: DataFrame, low: int, high: int, least: int, in_a_class: bool = False) -> DataFrame:
    """motif, success_count, failure_count of the subsequences with any gaps in `least` traces at least, or in so many of one class.

    Frequent prefixes grow by one token at a time: each trace keeps what follows a prefix's first place, and only
    what grows out of frequent prefixes is made. Levels are written once; each is counted and grown from.
    """
    scratch, out = Scratch(traces.sparkSession), None
    s, f = F.col("success_count"), F.col("failure_count")
    often = (F.greatest(s, f) if in_a_class else s + f) >= least
    level = traces.select("is_correct", F.expr("cast(array() as array<string>)").alias("motif"), F.col("tokens").alias("rest"))
    for n in range(1, high + 1):
        grow = F.transform(F.array_distinct("rest"), lambda t: F.struct(t.alias("token"), F.slice("rest", F.array_position("rest", t).cast("int") + 1, F.size("rest")).alias("after")))
        level = level.filter(F.size("rest") > 0).select("is_correct", "motif", F.explode(grow).alias("g")).select("is_correct", F.concat("motif", F.array("g.token")).alias("motif"), F.col("g.after").alias("rest"))
        level = scratch.write(level, f"level-{n}")
        counts = scratch.write(class_counts(level, "motif").filter(often), f"counts-{n}")
        level = level.join(counts.select("motif"), "motif", "left_semi")
        if n >= low:
            out = counts if out is None else out.unionByName(counts)
    return out


def frequent(traces: DataFrame, least: int, low: int, high: int, backend: str = "grow") -> DataFrame:
    """motif, count of the subsequences with any gaps in `least` traces at least.

    backend: `grow` grows frequent prefixes level by level, `prefixspan` leaves that to Spark's miner, and
    `enumerate` lists each trace's subsequences, whose number grows with the power `high` of its length.
    """
    if backend == "grow":
        return grown(traces, low, high, least).select("motif", (F.col("success_count") + F.col("failure_count")).alias("count"))
    if backend == "enumerate":
        return facts(traces, skipgrams(F.col("tokens"), low, high, None)).groupBy("motif").agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") >= least)
    n = traces.count()
    rows = traces.select(F.transform("tokens", lambda t: F.array(t)).alias("sequence"))
    # the miner takes a fraction: half a trace under the count, so that rounding can't lose the count itself
    found = PrefixSpan(minSupport=max(0.0, (least - 0.5) / max(1, n)), maxPatternLength=high, maxLocalProjDBSize=32_000_000).findFrequentSequentialPatterns(rows)
    return found.select(F.flatten("sequence").alias("motif"), F.col("freq").alias("count")).filter((F.size("motif") >= low) & (F.col("count") >= least))


def pattern_table(traces: DataFrame, low: int = 1, high: int = 4, least: int = 5, tests: bool = True) -> DataFrame:
    """Subsequences frequent in a class; a class under the threshold counts as 0."""
    keep = lambda c: F.when(F.col(c) >= least, F.col(c)).otherwise(F.lit(0)).cast("long")
    counts = grown(traces, low, high, least, in_a_class=True).withColumns({"success_count": keep("success_count"), "failure_count": keep("failure_count")})
    return scored(counts.filter(F.col("success_count") + F.col("failure_count") > 0), traces, tests)


def without_redundant(patterns: DataFrame, tolerance: float = 0.02, high: int = 4) -> DataFrame:
    """Drops a pattern that a longer kept one contains with both supports within the tolerance and no lower score.

    Only longer patterns decide on a pattern, so one pass for each length, from the longest down, keeps
    what the one-by-one rule keeps.
    """
    rows = patterns.withColumn("_n", F.size("motif"))
    kept = rows.filter(F.col("_n") >= high)
    for n in range(high - 1, 0, -1):
        longer = kept.select(F.col("motif").alias("_m"), F.col("success_support").alias("_s"), F.col("failure_support").alias("_f"), F.col("abs_support_difference").alias("_a"))
        # a longer pattern holds each token of the shorter: meet on its first one
        longer = longer.withColumn("_key", F.explode(F.array_distinct("_m")))
        level = rows.filter(F.col("_n") == n).withColumn("_key", F.get("motif", F.lit(0)))
        covers = (level["_key"] == longer["_key"]) & holds_subsequence(F.col("_m"), F.col("motif")) & (F.abs(F.col("success_support") - F.col("_s")) <= tolerance) & (F.abs(F.col("failure_support") - F.col("_f")) <= tolerance) & (F.col("_a") >= F.col("abs_support_difference"))
        kept = kept.unionByName(level.join(longer, covers, "left_anti").drop("_key"))
    return kept.drop("_n")


def mine_rules(traces: DataFrame, least: int = 5, high: int = 4, candidates: int = 80, tests: bool = True) -> DataFrame:
    """Sequential rules antecedent => consequent between the `candidates` most frequent patterns.

    A rule holds where its two sides joined are a subsequence, so its counts are those of the joined
    pattern: rules come from splitting frequent patterns, not from pairing patterns on every trace.
    """
    counts = grown(traces, 1, high, least).withColumn("count", F.col("success_count") + F.col("failure_count"))
    top = counts.orderBy(F.desc("count"), name("motif")).limit(candidates)
    side = lambda c, s: F.broadcast(top.select(F.col("motif").alias(c), F.col("success_count").alias(f"{s}_success"), F.col("failure_count").alias(f"{s}_failure")))
    whole = counts.drop("count").filter(F.size("motif") >= 2).withColumn("cut", F.explode(F.sequence(F.lit(1), F.size("motif") - 1)))
    split = whole.withColumns({"antecedent": F.slice("motif", F.lit(1), F.col("cut")), "consequent": F.slice("motif", F.col("cut") + 1, F.size("motif") - F.col("cut"))}).filter("antecedent <> consequent")
    rules = scored(split.join(side("antecedent", "a"), "antecedent").join(side("consequent", "c"), "consequent"), traces, tests)
    rules = rules.crossJoin(F.broadcast(totals(traces)))
    for c in ("success", "failure"):
        confidence = F.coalesce(F.col(f"{c}_count") / F.nullif(F.col(f"a_{c}"), F.lit(0)), F.lit(0.0))
        rules = rules.withColumn(f"{c}_confidence", confidence).withColumn(f"{c}_rule_lift", F.col(f"{c}_confidence") / (stats.support(F.col(f"c_{c}"), F.col(f"{c}_total")) + stats.EPSILON))
    return rules.withColumn("confidence_difference", F.col("success_confidence") - F.col("failure_confidence")).drop("cut", "a_success", "a_failure", "c_success", "c_failure", "success_total", "failure_total")


def ranked(table: DataFrame, k: int = 100) -> DataFrame:
    """The k best motifs of each direction, with `direction` and `rank`; ties by name."""
    up = [F.desc("support_difference"), F.desc("success_support"), F.desc("abs_log_odds_ratio"), name("motif")]
    down = [F.asc("support_difference"), F.desc("failure_support"), F.desc("abs_log_odds_ratio"), name("motif")]
    part = lambda d, order: table.orderBy(*order).limit(k).withColumn("direction", F.lit(d)).withColumn("rank", F.row_number().over(Window.partitionBy("direction").orderBy(*order)))
    return part("success", up).unionByName(part("failure", down))


def v1_motifs(traces: DataFrame, low: int = 2, high: int = 4) -> DataFrame:
    """Support, class shares as six-digit strings, enrichments and the dominant label of contiguous motifs."""
    c, i = F.col("success_count"), F.col("failure_count")
    six = lambda x: stats.fixed(x, 6)
    rows = class_counts(facts(traces, ngrams(F.col("tokens"), low, high), "is_correct"), "motif")
    return rows.select(
        "motif", F.array_join("motif", " -> ").alias("motif_pretty"), F.size("motif").alias("length"), (c + i).alias("support_total"), c.alias("support_correct"), i.alias("support_incorrect"),
        six(c / (c + i)).alias("p_correct"), six(i / (c + i)).alias("p_incorrect"), six((c + 1) / (i + 1)).alias("enrichment_correct"), six((i + 1) / (c + 1)).alias("enrichment_incorrect"),
        F.when(c > i, "correct").when(i > c, "incorrect").otherwise("tie").alias("dominant_label"),
    )


def indicators(traces: DataFrame, low: int = 1, high: int = 3, least: int = 3) -> DataFrame:
    """Motifs as indicators against the corpus's baseline rates."""
    counts = class_counts(facts(traces, ngrams(F.col("tokens"), low, high), "is_correct"), "motif")
    c, i = F.col("success_count"), F.col("failure_count")
    out = with_totals(counts.filter(c + i >= least), traces)
    n, m = F.col("success_total"), F.col("failure_total")
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    good, bad, base, base_bad = share(c, c + i), share(i, c + i), share(n, n + m), share(m, n + m)
    return out.select(
        "motif", F.size("motif").alias("motif_len"), (c + i).alias("support_total"), c.alias("support_correct"), i.alias("support_incorrect"), share(c + i, n + m).alias("support_rate"),
        good.alias("p_correct_given_motif"), bad.alias("p_incorrect_given_motif"), (good - base).alias("delta_correct_vs_baseline"), share(good, base).alias("lift_correct"), share(bad, base_bad).alias("lift_incorrect"),
        stats.log_odds(c, n, i, m).alias("log_odds_ratio"), F.when(good - base >= 0, "success").otherwise("failure").alias("indicator_direction"), F.abs(good - base).alias("indicator_strength"),
    )


def motif_index(stats_v1: DataFrame, least: int = 5) -> DataFrame:
    """Signals of v1 motifs: ln of the enrichment, where positive, times ln(1 + support)."""
    signal = lambda c: F.greatest(F.lit(0.0), F.log(F.col(c).cast("double"))) * F.log1p("support_total")
    return stats_v1.filter(F.col("support_total") >= least).select("motif", "support_total", F.col("p_correct").cast("double").alias("p_correct"), F.col("p_incorrect").cast("double").alias("p_incorrect"), signal("enrichment_correct").alias("success_signal"), signal("enrichment_incorrect").alias("failure_signal"))


def critical_steps(traces: DataFrame, index: DataFrame, low: int, high: int, k: int = 5, strings: bool = True) -> DataFrame:
    """Each trace's signals and, with `strings`, its strongest motifs and steps, by all places of indexed motifs in it."""
    hits = traces.select("trace_id", F.explode(ngrams(F.col("tokens"), low, high)).alias("motif")).join(index, "motif")
    per = hits.groupBy("trace_id", "motif").agg(F.count(F.lit(1)).alias("times"), F.sum("success_signal").alias("success"), F.sum("failure_signal").alias("failure"), F.first("p_correct").alias("p_correct"), F.first("p_incorrect").alias("p_incorrect"))
    # in order, so that traces with the same motifs have the same signals, which thresholds tell apart to the last bit
    added = [F.aggregate(F.array_sort(F.collect_list(c)), F.lit(0.0), lambda a, x: a + x).alias(f"{c}_signal") for c in ("success", "failure")]
    net = F.col("success_signal") - F.col("failure_signal")
    if not strings:
        sums = per.groupBy("trace_id").agg(*added)
        return traces.select("trace_id", "is_correct").join(sums, "trace_id", "left").fillna(0.0, ["success_signal", "failure_signal"]).withColumn("net_signal", net)
    steps = per.select("trace_id", "success", "failure", F.explode("motif").alias("step")).groupBy("trace_id", "step").agg(F.sum("success").alias("success"), F.sum("failure").alias("failure"))
    label = lambda c: F.format_string("%s (count=%d, score=%s, p_success=%s, p_fail=%s)", name("motif"), F.col("times"), *(stats.fixed(x, 3) for x in (c, "p_correct", "p_incorrect")))
    best = lambda items: F.array_join(F.transform(F.slice(F.array_sort(items), 1, k), lambda x: x["text"]), " || ")
    motifs = per.groupBy("trace_id").agg(
        *added,
        *(best(F.collect_list(F.when(F.col(c) > 0, F.struct((-F.round(c, 9)).alias("a"), (-F.col("times")).alias("b"), (-F.size("motif")).alias("c"), name("motif").alias("d"), label(c).alias("text"))))).alias(f"top_{c}_motifs") for c in ("success", "failure")),
    )
    tops = steps.groupBy("trace_id").agg(*(best(F.collect_list(F.when(F.col(c) > 0, F.struct((-F.round(c, 9)).alias("a"), F.col("step").alias("b"), F.format_string("%s (%s)", "step", stats.fixed(c, 3)).alias("text"))))).alias(f"top_{c}_steps") for c in ("success", "failure")))
    out = traces.select("trace_id", "is_correct").join(motifs, "trace_id", "left").join(tops, "trace_id", "left")
    out = out.fillna(0.0, ["success_signal", "failure_signal"]).fillna("")
    return out.withColumn("net_signal", net)


