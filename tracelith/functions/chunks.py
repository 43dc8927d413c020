"""Texts of a tokenising model as columns: chunks, noise, JSON in prose, token sequences."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelith.functions.answers import nonempty, trimmed
from tracelith.functions.tokens import NOISE_TOKEN, compressed, let, spaced_tokens, typed_tokens

# Marks of corrupted spans, the names under which models give sequences.
NOISE_MARKS = ("runtimeexception", "mongodb", "httpservletresponse", "@repository", "stringutils", "fixture", "onclick", "<style", "userid", "json", "hostname")
SEQUENCE_LABELS = ("canonical token sequence", "tokenized trace", "token sequence", "tokens")
TEXT_KEYS = ("tokenized_trace", "canonical_token_sequence", "token_sequence_text", "tokens_text")
LIST_KEYS = ("token_sequence", "tokens", "canonical_tokens")
STEP_KEYS = ("step_alignment", "step_alignments", "steps", "alignment")
LONG_TEXT = 120


def is_noise(text: Column) -> Column:
    """Blank, with a mark of corrupted spans, or long with more symbols than letters and digits."""
    return let(trimmed(text), is_noise_trimmed)


def is_noise_trimmed(clean: Column) -> Column:
    """is_noise of a text without white space around it. It is looked at once: inside a lambda nothing else is shared."""
    marked = let(F.lower(clean), lambda low: reduce(or_, (low.contains(m) for m in NOISE_MARKS)))
    letters = F.length(F.regexp_replace(clean, r"(?U)[^\p{L}\p{N}]+", ""))
    symbols = F.length(F.regexp_replace(clean, r"(?U)[\p{L}\p{N}\s]+", ""))
    return (clean == "") | marked | ((F.length(clean) >= LONG_TEXT) & (symbols > letters))


def chunk_trace(trace: Column) -> Column:
    """Array of (text_span, span_type): paragraphs, neighbours of one type joined by a line break."""
    return let(trimmed(trace), chunks_of_trimmed)


def chunks_of_trimmed(clean: Column) -> Column:
    spans = F.filter(F.transform(F.split(clean, r"\n\s*\n+"), trimmed), lambda x: x != "")
    typed = F.transform(spans, lambda x: F.struct(x.alias("text_span"), F.when(is_noise_trimmed(x), "noise").otherwise("reasoning").alias("span_type")))
    empty = F.array(F.struct(F.lit("EMPTY_TRACE").alias("text_span"), F.lit("noise").alias("span_type")))
    return F.when(clean == "", empty).otherwise(let(typed, merged))


def merged(chunks: Column) -> Column:
    """Neighbours of one type as one: what stands from each change of type to the next, joined once."""
    changes = F.filter(F.transform(chunks, lambda c, i: F.when((i == 0) | (c["span_type"] != F.get(chunks, i - 1)["span_type"]), i)), lambda i: i.isNotNull())

    def joined(starts: Column) -> Column:
        def one(start: Column, j: Column) -> Column:
            part = F.slice(chunks, start + 1, F.coalesce(F.get(starts, j + 1), F.size(chunks)) - start)
            return F.struct(F.array_join(F.transform(part, lambda c: c["text_span"]), "\n").alias("text_span"), F.get(chunks, start)["span_type"].alias("span_type"))

        return F.transform(starts, one)

    return let(changes, joined)


def chunk_tokens(chunks: Column) -> Column:
    """A token for each chunk, runs compressed: what stands for a trace without tokens."""
    return let(F.transform(chunks, lambda c: F.when(c["span_type"] == "noise", NOISE_TOKEN).otherwise("action:analyze")), compressed)


def normalized_trace(tokenized: Column, chunks: Column) -> Column:
    tokens = let(typed_tokens(spaced_tokens(tokenized)), lambda t: F.when(F.size(t) > 0, t))
    usable = ~trimmed(F.coalesce(tokenized, F.lit(""))).isin("", "MISSING")
    return F.array_join(F.coalesce(F.when(usable, tokens), chunk_tokens(chunks)), " ")


def json_in(text: Column) -> Column:
    """The JSON in a text, as a string: the whole, a fenced block, the outermost object, the outermost list; or null."""
    clean = trimmed(text)
    fence = nonempty(F.regexp_extract(clean, r"(?is)```(?:json)?\s*(.*?)\s*```", 1))
    outer = [nonempty(F.regexp_extract(clean, p, 0)) for p in (r"(?s)\{.*\}", r"(?s)\[.*\]")]
    sound = lambda x: F.when(x.rlike(r"^\s*[\{\[]") & F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(*(sound(x) for x in (clean, fence, *outer)))


def sequence_in_json(json: Column) -> Column:
    """A token sequence by its known keys: as text, as a list, or as the tokens of steps."""
    at = lambda k: F.get_json_object(json, f"$.{k}")
    lists = [F.array_join(F.from_json(at(k), "array<string>"), " ") for k in LIST_KEYS]
    steps = [nonempty(F.array_join(F.filter(F.transform(F.from_json(at(k), "array<struct<token:string,type:string,qualifier:string>>"), lambda s: F.coalesce(s["token"], F.concat_ws(":", s["type"], s["qualifier"]))), lambda t: t != ""), " ")) for k in STEP_KEYS]
    return F.coalesce(*(at(k) for k in TEXT_KEYS), *lists, *steps)


def sequence_in_text(text: Column) -> Column:
    """What follows a label such as `tokens:`, or MISSING."""
    clean = trimmed(text)
    found = [F.when(clean.rlike(rf"(?i){label}\s*:\s*.+"), trimmed(F.regexp_extract(clean, rf"(?i){label}\s*:\s*(.+)", 1))) for label in SEQUENCE_LABELS]
    return F.coalesce(*found, F.lit("MISSING"))


def chunk_list(json: Column) -> Column:
    """Chunks that a model has told as a JSON list, or under `chunks`: text and type under any of their names.

    Blank ones go, an unknown type is told by the text, and neighbours of one type are joined.
    """
    parts = F.from_json(F.coalesce(F.get_json_object(json, "$.chunks"), F.when(json.rlike(r"^\s*\["), json)), "array<struct<text_span:string,text:string,span:string,span_type:string,type:string,label:string>>")
    first = lambda c, *names: F.coalesce(*(nonempty(c[n]) for n in names), F.lit(""))
    read = F.transform(F.filter(parts, lambda c: c.isNotNull()), lambda c: F.struct(trimmed(first(c, "text_span", "text", "span")).alias("t"), F.replace(F.lower(trimmed(first(c, "span_type", "type", "label"))), F.lit("_"), F.lit("-")).alias("k")))
    typed = F.transform(F.filter(read, lambda c: c["t"] != ""), lambda c: F.struct(c["t"].alias("text_span"), F.when(c["k"].isin("reasoning", "noise"), c["k"]).when(is_noise(c["t"]), "noise").otherwise("reasoning").alias("span_type")))
    return F.coalesce(let(typed, merged), F.expr("cast(array() as array<struct<text_span:string,span_type:string>>)"))
