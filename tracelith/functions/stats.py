"""Statistics as columns: supports and odds, exact tests, multiple testing, ranks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON, HALDANE = 1e-9, 0.5
RELATIVE_TOLERANCE, ABSOLUTE_TOLERANCE = 1e-7, 1e-12
SALTS = 16


def support(count: Column, total: Column) -> Column:
    return F.when(total > 0, count / total).otherwise(F.lit(0.0))


def fixed(x: Column | str, digits: int) -> Column:
    """A number as text with so many decimals, rounded by its exact value and ties to even, as printf does in C and SQL.

    format_string rounds the shortest decimal that stands for the number, and its ties up.
    """
    return F.call_function("format_number", F.col(x) if isinstance(x, str) else x, F.lit("0." + "0" * digits))


def lift(a: Column, b: Column) -> Column:
    return a / (b + EPSILON)


def log_odds(a: Column, n: Column, c: Column, m: Column, alpha: float = HALDANE) -> Column:
    """ln of the odds ratio of a in n against c in m, with alpha added to each cell."""
    return F.log((a + alpha) / (n - a + alpha)) - F.log((c + alpha) / (m - c + alpha))


def ln_factorial(n: Column) -> Column:
    """ln(n!) for any n: a table of sixteen, then Stirling's series."""
    small = F.array(*(F.lit(math.lgamma(i + 1)) for i in range(16)))
    x = F.greatest(n.cast("double"), F.lit(1.0))
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5)))
    return F.when(n < 16, F.get(small, n.cast("int"))).otherwise(series)


#: So many deviations from the mean no term counts.
REACH = 40


def around(low: Column, high: Column, mean: Column, spread: Column) -> tuple[Column, Column]:
    """The part of low .. high that is near enough to the mean to count."""
    return F.greatest(low.cast("long"), (mean - REACH * spread - 50).cast("long")), F.least(high.cast("long"), (mean + REACH * spread + 50).cast("long"))


def fisher(a: Column, b: Column, c: Column, d: Column, relative: bool = True) -> Column:
    """Two-sided exact p of [[a, b], [c, d]]: all tables as unlikely or more. A relative or an absolute tolerance counts ties in.

    Tables further than REACH deviations from the mean are less likely than the least double: an array holds some root of n terms.
    """
    r, k, n = a + b, a + c, a + b + c + d
    fixed = ln_factorial(r) + ln_factorial(n - r) + ln_factorial(k) + ln_factorial(n - k) - ln_factorial(n)
    low, high = around(F.greatest(F.lit(0), r + k - n), F.least(r, k), r * k / F.greatest(n, F.lit(1)), F.sqrt(r / F.greatest(n, F.lit(1)) * k * (n - r) / F.greatest(n, F.lit(1)) * (n - k) / F.greatest(n - 1, F.lit(1))))

    def body(s: Column) -> Column:
        p = lambda x: F.exp(s["fixed"] - ln_factorial(x) - ln_factorial(s["r"] - x) - ln_factorial(s["k"] - x) - ln_factorial(s["n"] - s["r"] - s["k"] + x))
        own = p(s["a"])
        most = own * (1 + RELATIVE_TOLERANCE) if relative else own + ABSOLUTE_TOLERANCE
        each = F.transform(F.sequence(s["low"], s["high"]), p)
        return F.transform(F.array(F.struct(each.alias("each"), most.alias("most"))), lambda t: F.least(F.lit(1.0), F.aggregate(F.filter(t["each"], lambda q: q <= t["most"]), F.lit(0.0), lambda z, q: z + q)))[0]

    table = F.struct(fixed.alias("fixed"), r.alias("r"), k.alias("k"), n.alias("n"), a.alias("a"), low.alias("low"), high.alias("high"))
    return F.transform(F.array(table), body)[0]


def sign_test(positive: Column, negative: Column) -> Column:
    """min(1, twice the lower tail) of a fair coin. Terms ten deviations under the first don't matter."""
    n, k = positive + negative, F.least(positive, negative)
    first = F.greatest(F.lit(0).cast("long"), (k - 5 * F.sqrt(n) - 50).cast("long"))
    terms = F.transform(F.sequence(first, k), lambda i: F.exp(ln_factorial(n) - ln_factorial(i) - ln_factorial(n - i) - n * math.log(2)))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)))


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column, Column]:
    """With a half added to each cell, and its 95 % Wald limits."""
    a, b, c, d = a + 0.5, b + 0.5, c + 0.5, d + 0.5
    ratio, error = (a * d) / (b * c), F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return ratio, F.exp(F.log(ratio) - 1.96 * error), F.exp(F.log(ratio) + 1.96 * error)


def benjamini_hochberg(df: DataFrame, p: str, q: str, by: list[str] | None = None) -> DataFrame:
    """Adds q: the least p * n / rank from this p on upwards, one at most. Null p stay null and don't count.

    Without `by` all tests are one family. Ranks come in two steps, within and over ranges of p, so that no task sorts all tests.
    """
    if by:
        inner = Window.partitionBy(*by)
        ranked = df.withColumn("_n", F.count(p).over(inner)).withColumn("_r", F.when(F.col(p).isNotNull(), F.row_number().over(inner.orderBy(F.col(p).asc_nulls_last()))))
        low = F.min(F.col(p) * F.col("_n") / F.col("_r")).over(inner.orderBy(F.col(p).desc_nulls_last(), F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0))
        return ranked.withColumn(q, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), low))).drop("_n", "_r")
    # distinct p values carry the counts: ties share the best of their ranks, which is the last
    sizes = df.filter(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_m"))
    # ranges that are fine at both ends: 64 to each halving of p, or of its distance from 1
    near_zero, near_one = F.floor(64 * F.log2(F.greatest(F.col("_p"), F.lit(1e-300)))), 64 - F.floor(64 * F.log2(1 - F.col("_p") + 1e-18))
    ranges = sizes.withColumn("_range", F.when(F.col("_p") < 0.5, near_zero).otherwise(near_one).cast("int"))
    inside = Window.partitionBy("_range").orderBy("_p")
    parts = ranges.groupBy("_range").agg(F.sum("_m").alias("_sum"))
    over = Window.orderBy("_range")
    parts = parts.withColumn("_before", F.coalesce(F.sum("_sum").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = F.sum("_sum").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    parts = parts.withColumn("_total", total).select("_range", "_before", "_total")
    # there are at most some 70,000 ranges, however many tests
    raw = ranges.join(F.broadcast(parts), "_range").withColumn("_raw", F.col("_p") * F.col("_total") / (F.col("_before") + F.sum("_m").over(inside)))
    down = Window.partitionBy("_range").orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)
    least = raw.groupBy("_range").agg(F.min("_raw").alias("_least"))
    later = least.withColumn("_later", F.min("_least").over(Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1))).select("_range", "_later")
    done = raw.withColumn("_own", F.min("_raw").over(down)).join(F.broadcast(later), "_range", "left").select("_p", F.least(F.lit(1.0), F.col("_own"), F.col("_later")).alias(q))
    # many tests share a p: each p's row goes to SALTS places, and the tests are dealt over them
    done = done.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return dealt.join(done, (dealt[p] == done["_p"]) & (dealt["_salt"] == done["_salt"]), "left").drop("_p", "_salt")


def correlation(x: str, y: str) -> Column:
    """Pearson's, 0 where it isn't defined."""
    return F.coalesce(F.nanvl(F.corr(x, y), F.lit(0.0)), F.lit(0.0))


def auc(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """AUC by counts of the distinct scores, ties half; 0.5 with one class. One row, or one for each of `by`."""
    keys = by or []
    at = df.groupBy(*keys, F.col(score).alias("_s")).agg(F.count_if(F.col(label)).alias("_p"), F.count_if(~F.col(label)).alias("_n"))
    if keys:
        w = Window.partitionBy(*keys).orderBy("_s")
        at = at.withColumn("_below", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    else:
        at = running_sum(at, "_s", "_n", "_below")
    wins = F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / 2.0))
    pos, neg = F.sum("_p"), F.sum("_n")
    return at.groupBy(*keys).agg(F.when((pos > 0) & (neg > 0), wins / (pos * neg)).otherwise(F.lit(0.5)).alias("auc"), pos.alias("positives"), neg.alias("negatives"))


def running_sum(df: DataFrame, order: str, value: str, name: str, ranges: int = 256) -> DataFrame:
    """Adds the sum of `value` over rows before this one in `order`, by ranges of the order: no task sees all rows."""
    bounds = df.select(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10_000).alias("b")).first().b or []
    table = F.array(*(F.lit(b) for b in sorted(set(bounds)))) if bounds else F.expr("cast(array() as array<double>)")
    ranged = df.withColumn("_range", F.size(F.filter(table, lambda b: b < F.col(order))))
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_range", "_before")
    return ranged.join(F.broadcast(parts), "_range").withColumn(name, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_range", "_before")
