import pytest
from pyspark.sql import functions as F

from tests.test_functions import traces
from tracelith.operators import oof
from tracelith.plans import cli
from tracelith.sources import attempts as A


def items(spark):
    rows = [("7", "two plus two?", "4", "final"), ("9", "half of six?", "3", "hash")]
    return spark.createDataFrame(rows, "question_id string, question string, answer string, answer_format string")


def scripted(prompt, attempt, temperature):
    if attempt == 0:
        raise RuntimeError("no network")
    right = "4" if "two plus" in prompt else "3"
    mark = "#### " if "####" in prompt else "FINAL: "
    return f"work\n{mark}{right if attempt != 2 else '5'}", "thinking", '{"prompt_tokens": 3}'


def test_acquisition_with_a_scripted_client(spark):
    got = A.collect_until(items(spark), scripted, 2, 4).orderBy("question_id", "sample_id").collect()
    assert [(g.question_id, g.sample_id, g.attempt_index, g.predicted_answer, g.is_correct) for g in got] == [("7", 0, 1, "4", True), ("7", 1, 2, "5", False), ("9", 0, 1, "3", True), ("9", 1, 2, "5", False)]
    failed = A.attempts(items(spark), scripted, 1).collect()
    assert all(f.finish_reason == "error" and not f.has_clear_answer for f in failed)


def test_busy_clients_are_asked_again():
    calls = []

    def busy(prompt, attempt, temperature):
        calls.append(1)
        if len(calls) < 3:
            raise A.Busy("429")
        return "r", "t", "{}"

    assert A.ask(busy, "p", 0, 0.0, wait=0.0) == ("r", "t", "{}", "") and len(calls) == 3


def test_sampling_levels_and_formats(spark):
    one = A.sampled_items(items(spark), 1, 5).collect()
    assert one == A.sampled_items(items(spark), 1, 5).collect() and len(one) == 1
    with pytest.raises(ValueError, match="asked"):
        A.sampled_items(items(spark), 3, 5)
    lv = spark.createDataFrame([(1, "2"), (2, "5")], "question_id int, level string")
    assert [r.question_id for r in A.in_levels(lv, 3).collect()] == [2]
    assert A.resolved_format(spark, "data/gsm8k.csv") == "hash" and A.resolved_format(spark, "math") == "boxed" and A.resolved_format(spark, "x", "final") == "final"


def test_out_of_fold_models(spark):
    df, _ = traces(spark, n=240)
    got = {r.model: r for r in oof.report(spark, df, ("M0", "M1", "M2"), folds=3).collect()}
    assert got["M2"].auc > 0.55 and 0 <= got["M1"].ece <= 1 and got["M0"].auc > 0.4
    assert oof.out_of_fold(spark, df, "M1", folds=2, strengths=(0.1, 1.0), inner=2, shuffled=True).count() == 240


def test_command_line(spark, tmp_path):
    df, _ = traces(spark)
    path = f"{tmp_path}/in"
    df.select("question_id", F.element_at(F.split("trace_id", ":"), 2).alias("sample_id"), "is_correct", F.array_join("tokens", " ").alias("tokenized_trace")).coalesce(1).write.option("header", True).csv(path)
    made = cli.run(spark, ["all", path, f"{tmp_path}/out", "--deduplicate", "question"])
    assert len(made) == 9
    rules = spark.read.csv(f"{tmp_path}/out/rules_all", header=True)
    assert rules.count() > 0 and "confidence_difference" in rules.columns
    for command in ("indicators", "lengths", "deltas", "positions", "cards", "local"):
        assert cli.run(spark, [command, path, f"{tmp_path}/{command}", "--min-questions", "2"])
