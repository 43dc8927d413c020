"""Acquisition of attempts: a client that the caller brings is asked for each question, and its answers graded."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelith.functions import answers
from tracelith.streaming.collect import collected

#: (prompt, attempt, temperature) to (response text, reasoning text, usage JSON)
Client = Callable[[str, int, float], tuple[str, str, str]]
RETRIES, FIRST_WAIT = 4, 0.5
PRESETS = {"gsm8k": "hash", "math": "boxed", "aime": "boxed"}


class Busy(Exception):
    """A client raises this when it should be asked again later."""


def ask(client: Client, prompt: str, attempt: int, temperature: float, wait: float = FIRST_WAIT) -> tuple[str, str, str, str]:
    """Response, reasoning, usage and error: a busy client is asked again a few times, other failures become the error."""
    for retry in range(RETRIES + 1):
        try:
            return *client(prompt, attempt, temperature), ""
        except Busy as e:
            if retry == RETRIES:
                return "", "", "{}", str(e)
            time.sleep(wait * 2**retry)
        except Exception as e:  # any other failure is an attempt without an answer
            return "", "", "{}", str(e)
    raise AssertionError


def schedule(temperatures: list[float], attempt: int) -> float:
    return temperatures[attempt % len(temperatures)]


def attempts(items: DataFrame, client: Client, most: int, temperatures: list[float] | None = None) -> DataFrame:
    """`most` attempts at each item (question_id, question, answer, answer_format): response, answer, whether it is clear and right.

    A question's attempts may run in different tasks; each is one request.
    """
    temps = temperatures or [0.0]
    asked = items.withColumn("prompt", answers.prompt(F.col("question"), F.col("answer_format"))).withColumn("attempt_index", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long"))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [ask(client, p, int(a), schedule(temps, int(a))) for p, a in zip(f["prompt"], f["attempt_index"], strict=True)]
            yield f.assign(response=[g[0] for g in got], reasoning_trace=[g[1] or g[0] for g in got], usage=[g[2] for g in got], error=[g[3] for g in got])

    columns = asked.schema.simpleString()[7:-1]
    raw = asked.mapInPandas(run, f"{columns},response:string,reasoning_trace:string,usage:string,error:string".replace(":", " "))
    graded = raw.withColumn("predicted_answer", answers.final_answer(F.col("response"), F.col("answer_format")))
    graded = graded.withColumn("has_clear_answer", F.col("predicted_answer").isNotNull()).withColumn("is_correct", answers.matches(F.col("predicted_answer"), F.col("answer"), F.col("answer_format")))
    return graded.select("*", *answers.usage(F.col("usage"))).withColumn("finish_reason", F.when(F.col("error") != "", "error").otherwise("stop"))


def collect_until(items: DataFrame, client: Client, goal: int, most: int) -> DataFrame:
    """The accepted attempts: clear ones, `goal` of each question at most, numbered by sample_id."""
    return collected(attempts(items, client, most), goal, most)


def sampled_items(items: DataFrame, n: int, seed: int) -> DataFrame:
    """n items by a seeded hash, in order of their ids; fewer than n raise."""
    have = items.count()
    if have < n:
        raise ValueError(f"{n} items asked for, {have} there")
    return items.orderBy(F.xxhash64(F.lit(seed), "question_id"), "question_id").limit(n).orderBy("question_id")


def in_levels(items: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    level = F.col("level").cast("int")
    return items.filter((level >= low if low is not None else F.lit(True)) & (level <= high if high is not None else F.lit(True)))


def resolved_format(spark: SparkSession, path: str, given: str | None = None) -> str:
    """The given answer format, else that of a preset of this name, else by the path."""
    if given:
        return given
    if path in PRESETS:
        return PRESETS[path]
    return spark.range(1).select(answers.format_of_path(F.lit(path))).first()[0]


def preset_names() -> list[str]:
    return sorted(PRESETS)
