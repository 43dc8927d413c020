"""Document fingerprints by closed syncmers, in DataFrame functions alone.

A text is a sequence of tokens: runs of non-space characters, and in place of a long run the few
characters from each of its places on, so that a character more or less changes the tokens around it
alone. A stretch of K tokens is chosen where the least of its inner pairs of tokens is its first or
its last pair. That depends on nothing outside the stretch, so equal passages choose equal anchors
wherever they stand. The fingerprint lists every anchor of the whole text in its order, each as one
hash of the stretch and of its distance in tokens to the next anchor: an anchor matches where the
stretch and its position beside the next one agree. Likeness is the share of common ones among the
distinct anchors of both texts, their Jaccard index, with no sketch or cap for long texts.

Texts with too few tokens, or no chosen stretch, have one anchor, the hash of all tokens. Null, empty
and blank texts have an empty fingerprint, alike (1.0) to another empty one and unlike (0.0) any other.

The next document is found without one global sort: doc_id falls into ranges by quantiles of all
doc_ids, rows are ordered within a range, and each range has as a guest the row that follows its
last. Rows with one doc_id go by hashes of their texts, and equal rows follow each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelith.llm.run import documents

#: Group 1: a whole run of at most 16 characters, or up to four characters from each place of a longer one.
TOKEN = r"(?=((?<!\S)\S{1,16}(?!\S)|\S{1,4}))(?:(?<!\S)\S{1,16}(?!\S)|\S)"
K = 5
ROWS_IN_RANGE, MOST_RANGES = 2000, 8192


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def syncmers(text: Column) -> Column:
    """The anchors in order of the text, as ints."""
    hashes = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1)), lambda t: F.xxhash64(t))
    whole = lambda h: F.array(F.hash(h))

    def chosen(h: Column) -> Column:
        pairs = F.zip_with(h, F.slice(h, F.lit(2), F.size(h)), lambda a, b: F.xxhash64(a, b))

        def pick(p: Column) -> Column:
            edge = lambda i: F.least(p[i], p[i + (K - 2)]) <= F.least(*(p[i + j] for j in range(1, K - 2)))
            gap = lambda at, i, j: F.coalesce(F.get(at, j + 1) - i, F.lit(0))
            return let(F.filter(F.sequence(F.lit(0), F.size(h) - K), edge), lambda at: F.transform(at, lambda i, j: F.hash(p[i], p[i + 2], h[i + 4], gap(at, i, j))))

        return let(pairs, pick)

    some = lambda h: let(chosen(h), lambda c: F.when(F.size(c) > 0, c).otherwise(whole(h)))
    return let(hashes, lambda h: F.when(F.size(h) >= K, some(h)).when(F.size(h) > 0, whole(h)).otherwise(F.array().cast("array<int>")))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints, from 0 to 1."""
    common = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(common / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - common))


def written(a: Column) -> Column:
    """A fingerprint as a string: eight hex digits for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def in_ranges(rows: DataFrame) -> DataFrame:
    """Adds `range`, by quantiles of doc_id, and as `guest` rows the document that follows each range's last one.

    Guests are one row for each range: the first row of the next lower range that isn't empty, or of the highest.
    """
    ids = rows.select("doc_id", "h1", "h2")
    n = ids.count()
    ranges = max(1, min(MOST_RANGES, n // ROWS_IN_RANGE))
    bounds = sorted(set(ids.select(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 100_000).alias("b")).first().b or [])) if ranges > 1 else []
    below = F.lit(0)
    if bounds:
        # binary search over a constant array: how many bounds lie under doc_id
        table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
        steps = F.array(*(F.lit(1 << i) for i in range(len(bounds).bit_length() - 1, -1, -1)))
        below = F.aggregate(steps, F.lit(0), lambda lo, s: F.when((lo + s <= len(bounds)) & (F.get(table, lo + s - 1) < F.col("doc_id")), lo + s).otherwise(lo))
    ranged = rows.withColumn("range", below)
    tops = ranged.groupBy("range").agg(F.max(F.struct("doc_id", "h1", "h2")).alias("place"))
    order = Window.orderBy("range")
    highest = F.last("place").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    wanted = tops.select("range", F.coalesce(F.lag("place").over(order), highest).alias("place")).select("range", "place.*")
    guests = rows.join(F.broadcast(wanted), ["doc_id", "h1", "h2"]).dropDuplicates(["range"])
    return ranged.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited.

    One shuffle of the texts, by range; both windows share its order.
    """
    rows = documents(docs).select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    order = Window.partitionBy("range").orderBy("guest", F.desc("doc_id"), F.desc("h1"), F.desc("h2"))
    led = in_ranges(rows).withColumn("next", F.coalesce(F.lead("text").over(order), F.lit(""))).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next", F.lit(1), half))
    led = led.select("range", "guest", "doc_id", "h1", "h2", "n_chars", syncmers(F.col("text")).alias("own"), F.when(F.col("guest"), F.lit("")).otherwise(edited).alias("edited"))
    led = led.withColumn("next", F.lead("own").over(order)).filter(~F.col("guest"))
    led = led.withColumn("changed", syncmers(F.col("edited")))
    return led.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written(F.col("own")).alias("fingerprint"), written(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"), "edited",
    )
