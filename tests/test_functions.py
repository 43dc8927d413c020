import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelith.functions import answers, chunks, labels, stats, tokens
from tracelith.operators import evaluate, mining, models, resample
from tracelith.plans import export
from tracelith.sources import traces as sources
from tracelith.streaming import collect


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_truth_values_differ_by_dialect(spark):
    words = ["True", " y ", "1", "no", "f", "maybe", None]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(labels.strict_bool(F.col("w")), labels.narrow_bool(F.col("w")), labels.wide_bool(F.col("w"))).collect()
    assert [r[0] for r in rows] == [True, True, True, False, False, None, None]
    assert [r[1] for r in rows] == [True, False, True, False, False, False, False]
    assert [r[2] for r in rows] == [True, True, True, False, False, False, False]
    with pytest.raises(Exception, match="truth"):
        spark.createDataFrame([("maybe",)], "w string").select(labels.strict_bool(F.col("w"), raises=True)).collect()


@pytest.mark.parametrize(
    ("parse", "text", "want"),
    [
        (tokens.delimited_tokens, "a||b|", ["a", "b"]), (tokens.delimited_tokens, " missing ", []), (tokens.spaced_tokens, "MISSING", ["MISSING"]), (tokens.web_tokens, "a | b|", ["a", "b"]), (tokens.web_tokens, "a > b", ["a", "b"]),
        (tokens.web_tokens, "a  b", ["a", "b"]), (tokens.list_tokens, '["a:b", "c"]', ["a:b", "c"]), (tokens.list_tokens, "a, b c", ["a", "b", "c"]), (tokens.bag_tokens, "a;b|c, d", ["a", "b", "c", "d"]), (tokens.list_tokens, None, []),
    ],
)
def test_token_formats(spark, parse, text, want):
    assert one(spark, parse(F.lit(text).cast("string"))) == want


def test_sequences(spark):
    t = F.array(*map(F.lit, ["a", "b", "b", "c", "d"]))
    assert one(spark, tokens.compressed(t)) == ["a", "b", "c", "d"]
    assert one(spark, tokens.prefix(t, 0.5)) == ["a", "b", "b"] and one(spark, tokens.prefix(t, 0.01)) == ["a"]
    assert one(spark, tokens.holds_subsequence(t, F.array(F.lit("a"), F.lit("c")))) and not one(spark, tokens.holds_subsequence(t, F.array(F.lit("c"), F.lit("b"))))
    assert one(spark, tokens.typed_tokens(F.array(F.lit("Action:Apply_Formula,"), F.lit("action:apply-formula"), F.lit("noise:x"), F.lit("what"), F.lit("action:")))) == ["action:apply-formula", "noise:corrupted-span"]
    got = {tuple(m) for m in one(spark, mining.skipgrams(F.array(*map(F.lit, "abcd")), 2, 2, 1))}
    assert got == {("a", "b"), ("a", "c"), ("b", "c"), ("b", "d"), ("c", "d")}


@pytest.mark.parametrize(
    ("text", "fmt", "want"),
    [
        ("Work\nFINAL: 42", "final", "42"), ("Work\n#### 17", "hash", "17"), ("Work\n\\boxed{\\frac{3}{4}}", "boxed", "\\frac{3}{4}"), ("x\nThe answer is $5$.", "final", "5"), ("so\nTherefore, 12", "final", "12"), ("nothing here", "final", None),
        ("FINAL: 1\n#### 2", "hash", "2"), ("", "final", None), ("\\boxed{open", "boxed", None), ("- we get x = \\frac{1}{2}.", "final", "x = \\frac{1}{2}"), ("we get lost", "final", None), ("Final answer: **7** as required", "final", "7"),
    ],
)
def test_final_answers(spark, text, fmt, want):
    assert one(spark, answers.final_answer(F.lit(text), F.lit(fmt))) == want


def test_matching_and_usage(spark):
    assert one(spark, answers.matches(F.lit("$1,000$"), F.lit("1000"), F.lit("hash"))) and not one(spark, answers.matches(F.lit("1,000"), F.lit("1000"), F.lit("final")))
    assert one(spark, answers.matches(F.lit("90^\\circ"), F.lit("\\text{90} degrees"), F.lit("final"))) and not one(spark, answers.matches(F.lit(""), F.lit(""), F.lit("final")))
    row = spark.range(1).select(*answers.usage(F.lit('{"prompt_tokens": 0, "input_tokens": 9, "output_tokens": 4, "completion_tokens_details": {"reasoning_tokens": 3}}'))).first()
    assert tuple(row) == (9, 4, 3)
    assert one(spark, answers.short_error(F.lit("a  b\n" * 100))).endswith("...")


def test_chunks_and_json(spark):
    text = "first part\n\n second part \n\n<style>x\n\n" + "#" * 130
    got = one(spark, chunks.chunk_trace(F.lit(text)))
    assert [(c.text_span, c.span_type) for c in got] == [("first part\nsecond part", "reasoning"), ("<style>x\n" + "#" * 130, "noise")]
    assert one(spark, chunks.chunk_trace(F.lit(" ")))[0].text_span == "EMPTY_TRACE"
    assert one(spark, chunks.json_in(F.lit('so ```json\n{"tokens": ["a"]}\n``` ok'))) == '{"tokens": ["a"]}'
    assert one(spark, chunks.json_in(F.lit("no json"))) is None
    assert one(spark, chunks.sequence_in_json(F.lit('{"steps": [{"type": "action", "qualifier": "x"}, {"token": "noise:y"}]}'))) == "action:x noise:y"
    assert one(spark, chunks.sequence_in_text(F.lit("Tokens : a b"))) == "a b" and one(spark, chunks.sequence_in_text(F.lit("-"))) == "MISSING"


def test_exact_tests_and_rates(spark):
    assert abs(one(spark, stats.fisher(F.lit(3), F.lit(1), F.lit(1), F.lit(3))) - 0.4857142857) < 1e-9
    assert abs(one(spark, stats.sign_test(F.lit(8).cast("long"), F.lit(2).cast("long"))) - 0.109375) < 1e-12
    big = one(spark, stats.ln_factorial(F.lit(5000)))
    assert abs(big - math.lgamma(5001)) < 1e-7
    r = random.Random(1)
    ps = [round(r.random() ** 2, 3) for _ in range(300)] + [None]
    got = {x.i: x.q for x in stats.benjamini_hochberg(spark.createDataFrame(list(enumerate(ps)), "i int, p double"), "p", "q").collect()}
    known = sorted((p, i) for i, p in enumerate(ps) if p is not None)
    low = 1.0
    for k in range(len(known), 0, -1):
        p, i = known[k - 1]
        low = min(low, p * len(known) / k)
        assert abs(got[i] - low) < 1e-9
    assert got[300] is None


def traces(spark, seed=1, n=300):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        tk = [r.choice("abcd") for _ in range(r.randrange(1, 7))]
        rows.append((f"{i % 12}:{i}", str(i % 12), tk, r.random() < (0.7 if "a" in tk else 0.3)))
    return spark.createDataFrame(rows, "trace_id string, question_id string, tokens array<string>, is_correct boolean"), rows


def test_redundancy_against_the_one_by_one_rule(spark):
    df, _ = traces(spark)
    table = mining.pattern_table(df, 1, 4, 5, tests=False)
    rows = sorted(((-len(x.motif), -x.abs_support_difference, tuple(x.motif), x.success_support, x.failure_support, x.abs_support_difference) for x in table.collect()))

    def inside(p, q):
        it = iter(q)
        return all(t in it for t in p)

    kept = []
    for n, _, m, s, f, a in rows:
        if not any(-k > -n and inside(m, m2) and abs(s - s2) <= 0.05 and abs(f - f2) <= 0.05 and a2 >= a for k, m2, s2, f2, a2 in kept):
            kept.append((n, m, s, f, a))
    got = {tuple(x.motif) for x in mining.without_redundant(table, 0.05).collect()}
    assert got == {m for _, m, *_ in kept} and len(got) < len(rows)


def test_logistic_descent_against_numpy(spark):
    df, _ = traces(spark)
    rows = models.feature_sets(df, 1, 2)
    model = models.sparse_logistic(rows, 12, epochs=40)
    vocab = models.vocabulary(rows, 12)
    data = rows.collect()
    x = np.array([[f in r.features for f in vocab] for r in data], float)
    y = np.array([r.is_correct for r in data], float)
    w, b = np.zeros(len(vocab)), 0.0
    for _ in range(40):
        e = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - 0.4 * (x.T @ e / len(y) + 1e-3 * w), b - 0.4 * e.mean()
    assert np.allclose([model.weights[f] for f in vocab], w) and abs(model.bias - b) < 1e-9
    by_steps = models.sparse_logistic(rows, 12, epochs=3, kinds=0)
    in_memory = models.sparse_logistic(rows, 12, epochs=3)
    assert all(abs(by_steps.weights[f] - in_memory.weights[f]) < 1e-9 for f in vocab)
    assert models.shared_features(model, by_steps)["shared"] == len(vocab)


def test_folds_hold_out_whole_questions(spark):
    df, rows = traces(spark)
    for folds in (evaluate.question_folds(spark, df, 5), evaluate.hashed_folds(df, 5), evaluate.group_folds(spark, df, 5)):
        got = folds.collect()
        assert len(got) == 12 == len({r.question_id for r in got})


def test_resampling(spark):
    df, _ = traces(spark)
    d = spark.createDataFrame([("t", float(i % 7)) for i in range(60)], "k string, v double")
    b = resample.bootstrap_mean(d, "k", "v", 300).first()
    assert b.ci95_low < b.mean < b.ci95_high
    s = resample.shuffled_labels(df, 3)
    sizes = {(r.draw, r.question_id): r.n for r in s.filter("is_correct").groupBy("draw", "question_id").agg(F.count("*").alias("n")).collect()}
    real = {r.question_id: r.n for r in df.filter("is_correct").groupBy("question_id").agg(F.count("*").alias("n")).collect()}
    assert all(sizes[k, q] == n for k in (1, 2, 3) for q, n in real.items())
    assert 0 < resample.length_permutation(df, 30).first().p_value <= 1


def test_collection_as_a_stream_equals_the_batch(spark, tmp_path):
    r = random.Random(2)
    rows = [(str(q), a, r.random() < 0.6, r.random() < 0.5) for q in range(6) for a in range(12)]
    schema = "question_id string, attempt_index long, has_clear_answer boolean, is_correct boolean"
    want = sorted(tuple(x) for x in collect.collected(spark.createDataFrame(rows, schema), 3, 10).select("question_id", "attempt_index", "sample_id", "is_correct").collect())
    r.shuffle(rows)
    for i in range(3):
        spark.createDataFrame(rows[i::3], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = collect.collected_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), 3, 10)
    query = stream.writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(tuple(x) for x in spark.table("kept").collect()) == want


def test_csv_round_trip_and_service(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('﻿quesiton_id,sample_id,is_correct,tokenized_trace,note\n1,0,True,a b,"two\nlines"\n1,1,no,MISSING,x\n2,0,maybe,c,y\n', encoding="utf-8")
    got = sources.trace_csv(spark, str(path), skip_bad=True).orderBy("trace_id").collect()
    assert [(g.trace_id, g.is_correct, g.tokens) for g in got] == [("1:0", True, ["a", "b"]), ("1:1", False, [])]
    with pytest.raises(ValueError, match="missing"):
        sources.trace_csv(spark, str(path), trace_col="other")
    df, _ = traces(spark)
    export.write_questions(df.withColumn("predicted_answer", F.lit("x")), f"{tmp_path}/e")
    service = export.Service(spark, f"{tmp_path}/e")
    assert service.overview()["total_traces"] == 300 and service.question("3")["total_traces"] == 25
    assert service.questions(mixed=True).count() == 12
    with pytest.raises(KeyError):
        service.question("99")
    export.write_csv(df.limit(0), f"{tmp_path}/empty")
    assert spark.read.csv(f"{tmp_path}/empty", header=True).columns == df.columns


def test_registered_draws_are_those_of_the_reference(spark):
    from tracelith.plans.reference import QUERIES

    d = "/root/testdata/sf0.001"
    # 50 draws can't give a p-value under 1/51
    assert QUERIES["length_permutation"](spark, d).first().p_value < 1 / 51
    assert QUERIES["permutation_null"](spark, d).count() == 500
    seen = {}
    real, resample.bootstrap_mean = resample.bootstrap_mean, lambda rows, key, value, draws: seen.update(draws=draws) or real(rows, key, value, 3)
    try:
        QUERIES["bootstrap_deltas"](spark, d)
    finally:
        resample.bootstrap_mean = real
    assert seen == {"draws": 10_000}
