"""Final answers in text as columns: extraction by marker, cleaning, normalising, matching; prompts and usage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelith.functions.tokens import let

# What marks an answer in a text.
FINAL_LINE = r"(?i)^\s*(?:FINAL(?:\s+ANSWER)?|ANSWER)\s*[:=\-]\s*(.+?)\s*$"
HASH_LINE = r"^\s*####\s*(.+?)\s*$"
BOXED = r"(?i)\\?(?:boxed|fbox)\s*\{"
ANSWER_PHRASE = r"(?i)(?:the\s+)?(?:final\s+)?answer\s+(?:is|=|:|-)\s*(.+?)\s*$"
RESULT_PHRASE = r"(?i)(?:we\s+get|we\s+obtain|this\s+gives|therefore|thus|hence),?\s*(.+?)\s*$"
LIST_PREFIX = r"^\s*(?:[-*+]|\d+[.)])\s+"
LEAD = r"(?i)^\s*(?:therefore|thus|hence),?\s*"
ANSWER_LEAD = r"(?i)^\s*(?:the\s+)?(?:final\s+)?answer\s+(?:is|=|:|-)\s*"
TAIL = r"(?is)\s+(?:as\s+required|as\s+desired|which\s+is\s+the\s+answer)\b.*$"
WRAPPED = r"^(?s)(?:\\\(\s*(.*?)\s*\\\)|\\\[\s*(.*?)\s*\\\]|\$\s*(.*?)\s*\$)$"
NUMBER_LIKE = r"\\frac|\\sqrt|\\pi|[0-9]"
NO_ANSWERS = ("none", "null", "n/a", "na", "no answer", "no valid answer", "no valid answer found", "unknown")
WRONG_SENTINEL = "__LLM_VALIDATED_WRONG__"
ORDERS = {"final": ("final", "hash", "boxed"), "hash": ("hash", "final", "boxed"), "boxed": ("boxed", "final", "hash")}
PROMPTS = {
    "hash": "Show your reasoning, then end with a final line exactly in the form: #### <answer>",
    "boxed": "Show your reasoning, then end with the final answer on its own line in the form: \\boxed{answer}",
    "final": "Show your reasoning, then end with a final line exactly in the form: FINAL: <answer>",
}
LAST_LINES, SHORT_ANSWER = 8, 80


def trimmed(x: Column) -> Column:
    # only from a run's start: else each place of a run inside the text looks through the rest of it
    return F.regexp_replace(x, r"^\s+|(?<!\s)\s+$", "")


def nonempty(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\r|\n")


def last_line(text: Column, pattern: str) -> Column:
    found = F.filter(lines(text), lambda x: x.rlike(pattern))
    return nonempty(F.regexp_extract(F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("")), pattern, 1))


def boxed(text: Column) -> Column:
    """What the last box holds, braces paired; null without a closed one."""
    parts = F.split(text, BOXED, -1)

    def closed(rest: Column) -> Column:
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("stop"))

        def step(s: Column, c: Column) -> Column:
            stop = F.when((s["stop"] < 0) & (c == "}") & (s["depth"] == 0), s["at"]).otherwise(s["stop"])
            depth = s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
            return F.struct(depth.alias("depth"), (s["at"] + 1).alias("at"), stop.alias("stop"))

        end = F.aggregate(F.split(rest, ""), start, step, lambda s: s["stop"])
        return let(end, lambda e: F.when(e >= 0, nonempty(trimmed(F.substring(rest, F.lit(1), e)))))

    return let(parts, lambda p: F.when(F.size(p) > 1, let(F.element_at(p, -1), closed)))


def cleaned(answer: Column) -> Column:
    """Without boxes, lead-ins, tails, markup and math delimiters."""
    text = trimmed(answer)
    text = let(text, lambda t: F.coalesce(boxed(t), t))
    text = trimmed(F.regexp_replace(F.regexp_replace(text, LEAD, ""), ANSWER_LEAD, ""))
    text = F.regexp_replace(trimmed(F.regexp_replace(text, TAIL, "")), r"^[`*_]+|[`*_]+$", "")
    text = F.regexp_replace(trimmed(text), r"[.,;:]+$", "")
    # delimiters go layer by layer, each of which has two characters at least
    peeled = lambda t: F.regexp_replace(F.regexp_replace(t, WRAPPED, "$1$2$3"), r"[.,;:]+$", "")
    layers = lambda t: F.when(t.rlike(r"^(?:\\[(\[]|\$)"), F.greatest(F.lit(1), F.floor(F.length(t) / 2).cast("int"))).otherwise(F.lit(1))
    text = let(text, lambda t: F.aggregate(F.sequence(F.lit(1), layers(t)), t, lambda acc, _: peeled(acc)))
    return trimmed(F.regexp_replace(text, r"\s+", " "))


def phrase(line: Column) -> Column:
    sure, likely = nonempty(F.regexp_extract(line, ANSWER_PHRASE, 1)), nonempty(F.regexp_extract(line, RESULT_PHRASE, 1))
    return F.coalesce(sure, let(cleaned(likely), lambda c: F.when((F.length(c) <= SHORT_ANSWER) & c.rlike(NUMBER_LIKE), likely)))


def phrase_near_end(text: Column) -> Column:
    full = F.filter(F.transform(lines(text), trimmed), lambda x: x != "")
    near = F.slice(F.reverse(full), 1, LAST_LINES)
    each = F.transform(near, lambda x: let(trimmed(F.regexp_replace(x, LIST_PREFIX, "")), lambda y: F.coalesce(boxed(y), phrase(y))))
    return F.get(F.filter(each, lambda x: x.isNotNull()), F.lit(0))


def final_answer(text: Column, answer_format: Column) -> Column:
    """The cleaned answer of a text by the format's order of markers, or null."""
    finders = {"final": last_line(text, FINAL_LINE), "hash": last_line(text, HASH_LINE), "boxed": boxed(text)}
    by = {f: F.coalesce(*(finders[k] for k in order), phrase_near_end(text)) for f, order in ORDERS.items()}
    return nonempty(cleaned(F.when(answer_format == "hash", by["hash"]).when(answer_format == "boxed", by["boxed"]).otherwise(by["final"])))


def normalized(answer: Column, answer_format: Column) -> Column:
    text = cleaned(answer)
    for piece in (r"\left", r"\right", "$", r"\,"):
        text = F.replace(text, F.lit(piece), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(text, r"\\(?:mathrm|text)\{([^{}]*)\}", "$1"), r"\s+", "")
    text = F.when(answer_format == "hash", F.replace(text, F.lit(","), F.lit(""))).otherwise(text)
    return F.regexp_replace(text, r"(?i)(?:\^?\\circ|°|degrees?)$", "")


def matches(predicted: Column, gold: Column, answer_format: Column) -> Column:
    return let(normalized(predicted, answer_format), lambda p: F.coalesce((p != "") & (p == normalized(gold, answer_format)), F.lit(False)))


def format_of_path(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.contains("gsm8k"), "hash").when(low.contains("math") | low.contains("aime"), "boxed").otherwise("final")


def prompt(question: Column, answer_format: Column) -> Column:
    suffix = F.when(answer_format == "hash", PROMPTS["hash"]).when(answer_format == "boxed", PROMPTS["boxed"]).otherwise(PROMPTS["final"])
    return F.concat(question, F.lit("\n\n"), suffix)


def short_error(message: Column, limit: int = 160) -> Column:
    text = trimmed(F.regexp_replace(message, r"\s+", " "))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, limit - 3)), F.lit("...")))


def is_no_answer(answer: Column) -> Column:
    return F.lower(trimmed(answer)).isin(*NO_ANSWERS)


def verified(extracted: Column, gold: Column, verdict: Column) -> Column:
    """The answer to keep under a verifier's verdict: without one of its own, the gold answer or the sentinel."""
    blank = (F.coalesce(extracted, F.lit("")) == "") | is_no_answer(extracted)
    return F.when(~blank, extracted).when(verdict, gold).otherwise(F.lit(WRONG_SENTINEL))


def usage(payload: Column) -> list[Column]:
    """prompt, completion and reasoning tokens of a JSON usage object; 0 falls through to the other name."""
    at = lambda *names: F.coalesce(*(F.nullif(F.get_json_object(payload, f"$.{n}").try_cast("int"), F.lit(0)) for n in names))
    reasoning = F.coalesce(F.get_json_object(payload, "$.reasoning_tokens").try_cast("int"), F.get_json_object(payload, "$.completion_tokens_details.reasoning_tokens").try_cast("int"))
    return [at("prompt_tokens", "input_tokens").alias("prompt_tokens"), at("completion_tokens", "output_tokens").alias("completion_tokens"), reasoning.alias("reasoning_tokens")]


def without_answer_line(text: Column, kind: Column) -> Column:
    """A response without its last line if that line gives the answer in this format; blank lines at the end go first."""
    every = lines(F.coalesce(text, F.lit("")))
    # the last line that isn't blank, counted from one
    last = F.aggregate(F.transform(every, lambda x, i: F.when(trimmed(x) != "", i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))

    def cut(n: Column) -> Column:
        said = trimmed(F.coalesce(F.try_element_at(every, F.greatest(n, F.lit(1))), F.lit("")))
        answers = ((kind == "hash") & said.startswith("####")) | ((kind == "final") & said.rlike(r"(?i)^FINAL\s*:")) | ((kind == "boxed") & said.contains("\\boxed{"))
        return F.when(n == 0, F.lit("")).otherwise(trimmed(F.array_join(F.slice(every, F.lit(1), F.when(answers, n - 1).otherwise(n)), "\n")))

    return let(last, cut)


def content_text(content: Column) -> Column:
    """A message's content: plain text, or the texts of its parts (a JSON list of strings and objects with text), joined."""
    parts = F.when(content.rlike(r"^\s*\["), F.from_json(content, "array<string>"))
    text = lambda x: F.when(x.rlike(r"^\s*\{"), F.coalesce(F.get_json_object(x, "$.text"), F.lit(""))).otherwise(x)
    return F.coalesce(F.array_join(F.transform(parts, text), ""), content, F.lit(""))


VERIFY = "Does the response below settle on an answer, and is it the reference answer? Say what it settles on, or none. Answer with JSON alone: {\"extracted_answer\": ..., \"is_correct\": true or false}."


def verify_prompt(question: Column, gold: Column, response: Column) -> Column:
    """What a verifier is asked about a response without a clear answer; `verified` reads its verdict."""
    return F.concat_ws("\n\n", F.lit(VERIFY), F.concat(F.lit("Question:\n"), question), F.concat(F.lit("Reference answer:\n"), gold), F.concat(F.lit("Response:\n"), response))
