"""A tokenising job: traces are cut into chunks, a question's reasoning chunks make a guide, and each trace becomes tokens under it.

A model answers three kinds of prompts; the client that asks it is the caller's, a function from prompt to
text. Each stage is a DataFrame: prompts are built by columns, one request is one row, and answers are
parsed by columns, so that a question's traces may be asked for in different tasks.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tracelith.functions.answers import trimmed
from tracelith.functions.chunks import chunk_list, chunk_trace, json_in, normalized_trace, sequence_in_json, sequence_in_text
from tracelith.functions.tokens import NOISE_TOKEN

Client = Callable[[str], str]
CHUNK_TASK = "Cut the trace below into chunks, in order. Call a chunk noise if it can't be read as reasoning, else reasoning. Answer with JSON alone: {\"chunks\": [{\"text_span\": ..., \"span_type\": \"reasoning\" or \"noise\"}]}."
GUIDE_TASK = "Below are the reasoning chunks of all attempts at one question. Write a guide for tokenising them: a shared vocabulary of tokens spelled kind:qualifier, each with a definition. Answer with JSON alone."
TOKEN_TASK = "Turn the chunks of this trace into a sequence of tokens from the guide's vocabulary, in order, a token for each step. Answer with JSON alone: {\"tokenized_trace\": \"...\"}."
#: The guide of a question without reasoning: noise is all that its traces can say.
NOISE_GUIDE = json.dumps({"guide_name": "noise only", "version": "1.0", "final_vocabulary": [{"token": NOISE_TOKEN.partition(":")[2], "token_type": "noise", "definition": "A span that can't be read."}]})


def indented(text: Column) -> Column:
    """Each line behind two blanks; an empty text is one such line."""
    return F.array_join(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.concat(F.lit("  "), x)), "\n")


def chunk_prompt(question_id: Column, sample_id: Column, trace: Column) -> Column:
    return F.concat_ws("\n", F.lit(CHUNK_TASK), F.lit(""), F.concat(F.lit("question: "), question_id), F.concat(F.lit("sample: "), sample_id), F.lit("trace: |"), indented(trace))


def guide_prompt(question_id: Column, reasoning: Column) -> Column:
    """reasoning: array of (sample_id, text_span) in order."""
    told = F.array_join(F.transform(reasoning, lambda c: F.concat(F.lit("- sample "), c["sample_id"], F.lit(": |\n"), indented(c["text_span"]))), "\n")
    return F.concat_ws("\n", F.lit(GUIDE_TASK), F.lit(""), F.concat(F.lit("question: "), question_id), told)


def token_prompt(question_id: Column, sample_id: Column, guide: Column, chunks: Column) -> Column:
    told = F.array_join(F.transform(chunks, lambda c: F.concat(F.lit("- "), c["span_type"], F.lit(": |\n"), indented(c["text_span"]))), "\n")
    return F.concat_ws("\n", F.lit(TOKEN_TASK), F.lit(""), F.concat(F.lit("question: "), question_id), F.concat(F.lit("sample: "), sample_id), F.concat(F.lit("guide: "), guide), told)


def asked(rows: DataFrame, client: Client, prompt: str, answer: str) -> DataFrame:
    """Adds the client's answer to each prompt; null prompts aren't asked."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(**{answer: [None if p is None else client(p) for p in f[prompt]]})

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField(answer, StringType())]))


def chunked(traces: DataFrame, client: Client) -> DataFrame:
    """Adds chunks of each trace (question_id, sample_id, reasoning_trace); answers that hold none leave it to paragraphs."""
    rows = traces.select("question_id", "sample_id", "reasoning_trace", chunk_prompt(F.col("question_id"), F.col("sample_id"), F.col("reasoning_trace")).alias("prompt"))
    told = chunk_list(json_in(F.col("said")))
    out = asked(rows, client, "prompt", "said").withColumn("told", told).withColumn("chunks", F.when(F.size("told") > 0, F.col("told")).otherwise(chunk_trace(F.coalesce("reasoning_trace", F.lit("")))))
    return traces.join(out.select("question_id", "sample_id", "chunks"), ["question_id", "sample_id"])


def guides(chunks: DataFrame, client: Client) -> DataFrame:
    """question_id, num_traces, sample_ids, metadata: a guide for each question, the noise guide where nothing is reasoning."""
    mine = F.transform(F.filter("chunks", lambda c: c["span_type"] == "reasoning"), lambda c: F.struct(F.col("sample_id").alias("sample_id"), c["text_span"].alias("text_span")))
    rows = chunks.select("question_id", "sample_id", mine.alias("mine")).groupBy("question_id").agg(F.count(F.lit(1)).alias("num_traces"), F.array_sort(F.collect_list("sample_id")).alias("sample_ids"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("sample_id", "mine"))), lambda x: x["mine"])).alias("reasoning"))
    rows = rows.select("question_id", "num_traces", "sample_ids", F.when(F.size("reasoning") > 0, guide_prompt(F.col("question_id"), F.col("reasoning"))).alias("prompt"))
    told = F.coalesce(json_in(F.col("said")), F.to_json(F.struct(trimmed(F.col("said")).alias("notes"))))
    return asked(rows, client, "prompt", "said").select("question_id", "num_traces", "sample_ids", F.when(F.col("prompt").isNull(), F.lit(NOISE_GUIDE)).otherwise(told).alias("metadata"))


def tokenized(chunks: DataFrame, guide: DataFrame, client: Client) -> DataFrame:
    """Adds tokenized_trace; traces of noise alone aren't asked about."""
    noise = F.forall("chunks", lambda c: c["span_type"] == "noise")
    rows = chunks.select("question_id", "sample_id", "chunks").join(guide.select("question_id", "metadata"), "question_id")
    rows = rows.withColumn("prompt", F.when(~noise, token_prompt(F.col("question_id"), F.col("sample_id"), F.col("metadata"), F.col("chunks"))))
    said = asked(rows.select("question_id", "sample_id", "prompt"), client, "prompt", "said")
    raw = F.coalesce(sequence_in_json(json_in(F.col("said"))), sequence_in_text(F.col("said")))
    out = chunks.join(said.drop("prompt"), ["question_id", "sample_id"]).withColumn("tokenized_trace", normalized_trace(F.when(F.col("said").isNull(), F.lit(NOISE_TOKEN)).otherwise(raw), F.col("chunks")))
    return out.drop("said")


def tokenize(traces: DataFrame, client: Client, keep=None) -> tuple[DataFrame, DataFrame]:
    """The traces with tokenized_trace (their chunks dropped), and the guides. keep(df, name), such as Scratch.write, stores a stage, so that no request is made twice."""
    keep = keep or (lambda df, name: df.persist())
    parts = keep(chunked(traces, client), "chunks")
    guide = keep(guides(parts, client), "guides")
    return tokenized(parts, guide, client).drop("chunks"), guide


def progress(chunks: DataFrame, guide: DataFrame, done: DataFrame) -> DataFrame:
    """Events of a job, as streaming.sinks appends them: event, question_id, count."""
    of = lambda rows, event, n: rows.groupBy("question_id").agg(n.alias("count")).select(F.lit(event).alias("event"), "question_id", "count")
    every = F.count(F.lit(1))
    return of(chunks, "trace_chunked", every).union(of(guide, "metadata_ready", F.lit(0).cast("long"))).union(of(done, "trace_tokenized", every))
