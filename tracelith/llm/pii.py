"""Personal data: fixed patterns, and terms that reveal what the patterns found; DataFrame functions alone.

Base spans are e-mail addresses, IPv4 addresses, card numbers and phone numbers. Each distinct value
found is a protected entity. The terms of the documents that hold an entity (words outside base spans)
are judged by the corpus: of all documents that hold the term, the share that holds this entity too
estimates how surely the term reveals it, and the information gained is
log2(P(entity | term) / P(entity)) bits. Terms over both disclosure thresholds, held with the entity by
SUPPORT different texts, become spans wherever they stand outside base spans, in documents without the
entity too: sanitised texts have `[KIND]` for base spans and `[TERM]` for terms. Counts cover all
documents, repeated rows each. What can't pass the thresholds leaves early, so nothing is lost by it: an
entity of more than 1 in 2**MIN_BITS documents, and a term that too many holders of other entities hold.

Base spans are found once, on each whole text; a text's many spans get their places by sums over blocks, so
that time grows with the text. Offsets are code points, the end exclusive. Null and empty texts have no
spans. Columns besides doc_id and text play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelith.llm.run import Scratch, documents

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns, in forms that look at each character a bounded number of times and don't recurse:
# runs are possessive, a local part or number starts where its run starts or the last match ended,
# and a card's group of digits must have 16 at least.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts without these have no match.
SIGNS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
BYTE = r"^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"
TERM = r"[\p{L}\p{N}]{3,}"
#: Whole words of a text in which GAP stands for each character of base spans; words that a span touches are none.
GAP = "\x01"
EDGE = r"[\p{L}\p{N}\x01]"
TERM_OUTSIDE = rf"(?<!{EDGE})[\p{{L}}\p{{N}}]{{3,}}+(?!\x01)"
SPANS = "array<struct<kind:string,start:int,stop:int,found:string>>"
#: Sums within blocks of so many matches, then over blocks.
RUN = 128

SUPPORT = 3
MIN_SHARE = 0.8
MIN_BITS = 4.0


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    return {
        "email": F.lit(True),
        "ip": F.forall(F.split(found, r"\."), lambda p: p.rlike(BYTE)),
        "card": let(digits, lambda d: F.length(d).between(16, 19) & F.when(F.length(d).between(16, 19), F.call_function("luhn_check", d)).otherwise(F.lit(False))),
        "phone": F.length(digits).between(8, 15),
    }[kind]


def running(numbers: Column) -> Column:
    """Of each number in an array, the sum of those before it."""

    def scan(x: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(x, start, lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    blocks = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / RUN).cast("int")), lambda i: F.slice(x, i * RUN + 1, F.lit(RUN)))
    total = lambda b: F.aggregate(b, F.lit(0), lambda acc, v: acc + v)
    joined_up = lambda b: F.flatten(F.zip_with(b, scan(F.transform(b, total)), lambda x, before: F.transform(scan(x), lambda v: v + before)))
    return F.when(F.size(numbers) <= RUN, scan(numbers)).otherwise(let(blocks(numbers), joined_up))


def located(text: Column, pattern: str | Column) -> Column:
    """Array of (start, stop, found): leftmost matches that don't overlap. What lies between comes from a split by the same pattern."""
    none = F.expr("cast(array() as array<struct<start:int,stop:int,found:string>>)")

    def place(found: Column) -> Column:
        steps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("found")))

        def put(steps: Column) -> Column:
            before = running(F.transform(steps, lambda x: x["gap"] + F.length(x["found"])))
            return F.zip_with(steps, before, lambda x, b: F.struct((b + x["gap"]).alias("start"), (b + x["gap"] + F.length(x["found"])).alias("stop"), x["found"].alias("found")))

        return let(steps, put)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(place(m)))


def base_spans(text: Column) -> Column:
    """Array of (kind, start, stop, found) in the order of KINDS, then of start."""
    none = F.expr(f"cast(array() as {SPANS})")

    def of(kind: str) -> Column:
        found = F.filter(located(text, PATTERNS[kind]), lambda s: valid(kind, s["found"]))
        tagged = F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["found"].alias("found")))
        return F.when(text.contains(SIGNS[kind]), tagged).otherwise(none)

    return F.concat(*(of(k) for k in KINDS))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with GAP for each character of its base spans, kind by kind; places stay as they are."""

    def without(text: Column, kind: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
        cover = lambda m: F.when(valid(kind, m), F.repeat(F.lit(GAP), F.length(m))).otherwise(m)
        built = F.array_join(F.zip_with(F.split(text, PATTERNS[kind], -1), found, lambda g, m: F.concat(g, F.coalesce(cover(m), F.lit("")))), "")
        return F.when(F.exists(spans, lambda s: s["kind"] == kind), built).otherwise(text)

    plain = F.translate(text, GAP, " ")
    for kind in KINDS:
        plain = let(plain, (lambda kind: lambda t: without(t, kind))(kind))
    return F.when(F.size(spans) == 0, F.translate(text, GAP, " ")).otherwise(plain)


def words(text: Column, pattern: str = TERM) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower))


def entity(span: Column) -> Column:
    kind, found = span["kind"], span["found"]
    return F.concat_ws(":", kind, F.when(kind == "email", F.lower(found)).when(kind == "ip", found).otherwise(F.regexp_replace(found, "[^0-9]", "")))


def disclosing(marked: DataFrame, scratch: Scratch) -> DataFrame:
    """h, terms: the terms of each text that reveal an entity, in whichever document. marked: h, spans and masked text of every document."""
    n = marked.count()
    free = marked.select("h", "spans", words(F.col("masked"), TERM_OUTSIDE).alias("free"))
    holders = free.filter(F.size("spans") > 0).select("h", F.array_distinct(F.transform("spans", entity)).alias("entities"), "free")
    # equal texts count by their number
    holders = scratch.write(holders.groupBy("h").agg(F.first("entities").alias("entities"), F.first("free").alias("free"), F.count(F.lit(1)).alias("n")), "holders")
    having = holders.select("n", F.explode("entities").alias("entity")).groupBy("entity").agg(F.sum("n").alias("having"), F.count(F.lit(1)).alias("support"))
    having = scratch.write(having.filter((F.col("support") >= SUPPORT) & (F.col("having") <= n / 2**MIN_BITS)).drop("support"), "having")
    inner = holders.select("n", F.explode("free").alias("term")).groupBy("term").agg(F.sum("n").alias("inner"), F.count(F.lit(1)).alias("support")).filter(F.col("support") >= SUPPORT)
    pairs = holders.select("n", "free", F.explode("entities").alias("entity")).join(having, "entity").select("n", "entity", "having", F.explode("free").alias("term"))
    pairs = pairs.groupBy("term", "entity", "having").agg(F.sum("n").alias("both"), F.count(F.lit(1)).alias("support")).filter(F.col("support") >= SUPPORT)
    likely = scratch.write(pairs.join(inner.select("term", "inner"), "term").filter(F.col("both") >= F.col("inner") * MIN_SHARE).select("term", "both", "having"), "likely")
    held = scratch.write(free.select("h", F.explode("free").alias("term")).join(likely.select("term").distinct(), "term", "left_semi"), "held")
    holding = held.groupBy("term").agg(F.count(F.lit(1)).alias("holding"))
    share = F.col("both") / F.col("holding")
    bits = F.log2(share * F.lit(float(n)) / F.col("having"))
    strong = scratch.write(likely.join(holding, "term").filter((share >= MIN_SHARE) & (bits >= MIN_BITS)).select("term").distinct(), "strong")
    return scratch.write(held.join(strong, "term").groupBy("h").agg(F.collect_set("term").alias("terms")), "terms")


def term_spans(text: Column, terms: Column) -> Column:
    """Where the terms, in lower case, stand in a masked text."""
    none = F.expr(f"cast(array() as {SPANS})")
    forms = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))), lambda w: F.array_contains(terms, F.lower(w)))

    def spelled(forms: Column) -> Column:
        pattern = F.concat(F.lit(f"(?<!{EDGE})(?:"), F.array_join(forms, "|"), F.lit(f")(?!{EDGE})"))
        return F.transform(located(text, pattern), lambda t: F.struct(F.lit("term").alias("kind"), t["start"].alias("start"), t["stop"].alias("stop"), F.lower(t["found"]).alias("found")))

    return F.when(F.size(F.coalesce(terms, F.array())) == 0, none).otherwise(let(forms, lambda f: F.when(F.size(f) == 0, none).otherwise(spelled(f))))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of spans that overlap, the one that starts first (then the longer) stays."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("less"), s["kind"].alias("kind"))))
    # spans that begin before an earlier one has ended go; the last pass leaves those that stay, with where each gap begins
    none = F.expr("cast(array() as array<struct<from:int,start:int,kind:string>>)")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def add(acc: Column, s: Column) -> Column:
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct((-s["less"]).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("from"), s["start"].alias("start"), s["kind"].alias("kind")))).alias("out")))

    def build(letters: Column) -> Column:
        piece = lambda g: F.concat(F.array_join(F.slice(letters, g["from"] + 1, g["start"] - g["from"]), ""), F.lit("["), F.upper(g["kind"]), F.lit("]"))
        rest = lambda at: F.array_join(F.slice(letters, at + 1, F.greatest(F.size(letters) - at, F.lit(0))), "")
        return F.aggregate(order, start, add, lambda acc: F.concat(F.array_join(F.transform(acc["out"], piece), ""), rest(acc["at"])))

    return F.when(F.size(spans) == 0, text).otherwise(let(F.split(text, ""), build))


def find(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term and, if asked for, the sanitised text."""
    scratch = Scratch(docs.sparkSession)
    rows = documents(docs).select("doc_id", "text", F.xxhash64("text").alias("h"), base_spans(F.col("text")).alias("spans"))
    marked = scratch.write(rows.select("doc_id", "h", "spans", masked(F.col("text"), F.col("spans")).alias("masked"), *["text"] * with_text), "marked")
    terms = disclosing(marked, scratch)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    told = marked.join(terms, "h", "left").withColumn("terms", term_spans(F.col("masked"), F.col("terms"))).withColumn("all", F.concat("spans", "terms"))
    return told.select("doc_id", *(count(k) for k in KINDS), F.sha2(joined(F.col("spans")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"), F.size("terms").cast("long").alias("n_term"), *[sanitised(F.col("text"), F.col("all")).alias("text")] * with_text)
