"""Token sequences as columns: parsers of the text formats, normalisers, positions and prefixes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "MISSING"
EMPTY = "cast(array() as array<string>)"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def full(parts: Column) -> Column:
    """Trimmed, without empty ones."""
    return F.filter(F.transform(parts, lambda t: F.trim(t)), lambda t: t != "")


def unless_missing(x: Column, tokens: Column) -> Column:
    text = F.trim(F.coalesce(x, F.lit("")))
    return F.when((text == "") | (F.upper(text) == MISSING), F.expr(EMPTY)).otherwise(tokens)


def delimited_tokens(x: Column, delimiter: str = "|") -> Column:
    return unless_missing(x, full(F.split(x, re.escape(delimiter))))


def spaced_tokens(x: Column) -> Column:
    """White space parts tokens; MISSING is a token."""
    return F.filter(F.split(F.trim(F.coalesce(x, F.lit(""))), r"\s+"), lambda t: t != "")


def web_tokens(x: Column) -> Column:
    """Bars part tokens, else arrows, else white space."""
    text = F.coalesce(x, F.lit(""))
    return F.when(text.contains("|"), full(F.split(text, r"\|"))).when(text.contains(" > "), full(F.split(text, " > "))).otherwise(spaced_tokens(text))


def list_tokens(x: Column) -> Column:
    """A JSON list where it is one, else commas and white space part tokens."""
    json = F.when(F.trim(x).startswith("["), F.from_json(x, "array<string>"))
    return unless_missing(x, F.coalesce(full(json), spaced_tokens(F.replace(x, F.lit(","), F.lit(" ")))))


def bag_tokens(x: Column) -> Column:
    json = F.when(F.trim(x).startswith("["), F.from_json(x, "array<string>"))
    return unless_missing(x, F.coalesce(full(json), F.filter(F.split(x, r"[\s,;|]+"), lambda t: t != "")))


def base_types(tokens: Column) -> Column:
    """Each token's part before its first colon."""
    return F.transform(tokens, lambda t: F.trim(F.substring_index(t, ":", 1)))


def compressed(tokens: Column) -> Column:
    """Without tokens that equal the one before."""
    return F.filter(tokens, lambda t, i: (i == 0) | (t != F.get(tokens, i - 1)))


# Kinds of typed tokens and the qualifier of noise.
TOKEN_KINDS = ("action", "strategy", "milestone", "noise")
NOISE_TOKEN = "noise:corrupted-span"


def typed_token(t: Column) -> Column:
    """kind:qualifier in canonical spelling, or null."""
    clean = F.regexp_replace(F.replace(F.lower(F.trim(t)), F.lit("_"), F.lit("-")), r"^[,.;]+|[,.;]+$", "")
    kind = F.trim(F.substring_index(clean, ":", 1))
    rest = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_extract(clean, r"^[^:]*:(.*)$", 1)), r"[^a-z0-9=+\-^]+", "-"), r"^-+|-+$", "")
    return F.when(kind == "noise", F.lit(NOISE_TOKEN)).when(kind.isin(*TOKEN_KINDS) & clean.contains(":") & (rest != ""), F.concat_ws(":", kind, rest))


def typed_tokens(tokens: Column) -> Column:
    return let(F.filter(F.transform(tokens, typed_token), lambda t: t.isNotNull()), compressed)


def position_bins(tokens: Column) -> Column:
    """`token@@bin` with the third of the trace that holds it."""
    rel = lambda i: (i + 0.5) / F.size(tokens)
    return F.transform(tokens, lambda t, i: F.concat_ws("@@", t, F.when(rel(i) < 1 / 3, "first").when(rel(i) < 2 / 3, "middle").otherwise("last")))


def prefix(tokens: Column, fraction: Column | float) -> Column:
    """The first ceil(fraction * n) tokens, one at least."""
    f = F.lit(fraction) if isinstance(fraction, float) else fraction
    return F.slice(tokens, F.lit(1), F.greatest(F.lit(1), F.ceil(F.size(tokens) * f).cast("int")))


def first_action(tokens: Column) -> Column:
    return F.coalesce(F.get(F.filter(tokens, lambda t: t.startswith("action:")), F.lit(0)), F.lit("__NO_FIRST_ACTION__"))


def qualifier_words(token: Column) -> Column:
    return F.lower(F.array_join(F.regexp_extract_all(F.regexp_extract(token, r"^[^:]*:(.*)$", 1), F.lit(r"[A-Za-z0-9]+"), F.lit(0)), " "))


def canonical(tokens: Column, synonyms: dict[str, str]) -> Column:
    """Base types through a synonym table."""
    pairs = F.create_map(*(F.lit(x) for kv in synonyms.items() for x in kv)) if synonyms else None
    known = (lambda t: F.coalesce(pairs[t], t)) if pairs is not None else (lambda t: t)
    return F.transform(tokens, lambda t: F.concat_ws(":", known(F.substring_index(t, ":", 1)), F.nullif(F.regexp_replace(F.lower(F.regexp_extract(t, r"^[^:]*:(.*)$", 1)), r"[\s_]+", "-"), F.lit(""))))


def holds_subsequence(tokens: Column, pattern: Column) -> Column:
    """Whether pattern's tokens stand in order, with any gaps."""
    return F.aggregate(tokens, F.lit(0), lambda i, t: F.when((i < F.size(pattern)) & (t == F.get(pattern, i)), i + 1).otherwise(i)) == F.size(pattern)


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """Contiguous n-grams as arrays, each time they stand."""
    of = lambda n: F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.slice(tokens, i, F.lit(n)))).otherwise(F.expr("cast(array() as array<array<string>>)"))
    return F.concat(*(of(n) for n in range(max(1, low), high + 1)))


def first_place(tokens: Column, motif: Column) -> Column:
    """Zero-based first place of a contiguous motif, or null."""
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(tokens) - F.size(motif))), lambda i: F.slice(tokens, i + 1, F.size(motif)) == motif)
    return F.get(at, F.lit(0))


def stage_of(position: Column) -> Column:
    return F.when(position < 0.34, "early").when(position < 0.67, "middle").otherwise("late")
