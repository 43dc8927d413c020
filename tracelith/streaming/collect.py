"""Collection of accepted attempts: up to a goal for each question, in batch and as a stream with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def collected(attempts: DataFrame, goal: int, most: int) -> DataFrame:
    """Clear attempts among the first `most` of each question, until `goal` of them: sample_id counts them from 0."""
    w = Window.partitionBy("question_id").orderBy("attempt_index")
    kept = attempts.filter((F.col("attempt_index") < most) & F.col("has_clear_answer"))
    return kept.withColumn("sample_id", F.row_number().over(w) - 1).filter(F.col("sample_id") < goal)


def attempts_used(attempts: DataFrame, goal: int, most: int) -> DataFrame:
    """question_id, accepted, attempts_used: where collection stops."""
    kept = collected(attempts, goal, most).groupBy("question_id").agg(F.count(F.lit(1)).alias("accepted"), F.max("attempt_index").alias("last"))
    tried = attempts.filter(F.col("attempt_index") < most).groupBy("question_id").agg(F.count(F.lit(1)).alias("tried"))
    out = tried.join(kept, "question_id", "left").fillna(0, ["accepted"])
    return out.select("question_id", "accepted", F.when(F.col("accepted") >= goal, F.col("last") + 1).otherwise(F.col("tried")).alias("attempts_used"))


def scout_decision(accepted: Column, right: Column, wrong: Column, scout: int, densify: Column) -> Column:
    return (
        F.when(densify, "mixed_densified").when(accepted == 0, "no_accepted_traces").when((right > 0) & (wrong > 0), "mixed_target_reached")
        .when((accepted < scout) & (right > 0), "partial_all_correct_stop").when((accepted < scout) & (wrong > 0), "partial_all_wrong_stop").when(accepted < scout, "partial_no_signal_stop")
        .when(wrong == 0, "all_correct_stop").when(right == 0, "all_wrong_stop").otherwise("scout_stop")
    )


def adaptive(attempts: DataFrame, scout: int, target: int, most: int) -> DataFrame:
    """Scouts each question and goes on to the target where the scouted answers are mixed: one row for each question."""
    first = collected(attempts, scout, most).groupBy("question_id").agg(F.count(F.lit(1)).alias("accepted_scout"), F.count_if("is_correct").alias("right_scout"), F.count_if(~F.col("is_correct")).alias("wrong_scout"))
    final = collected(attempts, target, most).groupBy("question_id").agg(F.count(F.lit(1)).alias("a"), F.count_if("is_correct").alias("r"), F.count_if(~F.col("is_correct")).alias("w"))
    out = attempts.select("question_id").distinct().join(first, "question_id", "left").join(final, "question_id", "left").na.fill(0)
    densify = (F.col("right_scout") > 0) & (F.col("wrong_scout") > 0) & (F.col("accepted_scout") < target)
    pick = lambda a, b: F.when(densify, F.col(a)).otherwise(F.col(b))
    return out.select(
        "question_id", "accepted_scout", "right_scout", "wrong_scout", pick("a", "accepted_scout").alias("accepted_final"), pick("r", "right_scout").alias("right_final"), pick("w", "wrong_scout").alias("wrong_final"),
        densify.alias("was_densified"), scout_decision(F.col("accepted_scout"), F.col("right_scout"), F.col("wrong_scout"), scout, densify).alias("decision"),
    )


def collected_stream(attempts: DataFrame, goal: int, most: int) -> DataFrame:
    """The same as a stream: attempts may come late and out of order; each question's state holds what waits for earlier ones."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        accepted, following, waiting = state.get if state.exists else (0, 0, "[]")
        held = {int(r["attempt_index"]): r for r in (pd.read_json(waiting).to_dict("records") if waiting != "[]" else [])}
        for frame in frames:
            for r in frame.to_dict("records"):
                if r["attempt_index"] >= following:
                    held.setdefault(int(r["attempt_index"]), r)
        out = []
        while following in held:
            r = held.pop(following)
            following += 1
            if accepted < goal and following <= most and r["has_clear_answer"]:
                out.append((str(key[0]), following - 1, accepted, bool(r["is_correct"])))
                accepted += 1
        if accepted >= goal or following >= most:
            held = {}
        state.update((accepted, following, pd.DataFrame(list(held.values())).to_json(orient="records") if held else "[]"))
        yield pd.DataFrame(out, columns=["question_id", "attempt_index", "sample_id", "is_correct"])

    rows = attempts.select("question_id", "attempt_index", "has_clear_answer", "is_correct")
    return rows.groupBy("question_id").applyInPandasWithState(step, "question_id string, attempt_index long, sample_id long, is_correct boolean", "accepted long, following long, waiting string", "append", GroupStateTimeout.NoTimeout)
