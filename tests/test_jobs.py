import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tests.test_functions import traces
from tracelith.functions import answers, stats
from tracelith.operators import evaluate, mining, models, oof, resample, signals, summaries
from tracelith.plans import tokenizer
from tracelith.sources import tables
from tracelith.streaming import sinks


def test_exact_tests_against_sums_of_any_size(spark):
    def hyper(x, r, k, n):
        return math.exp(sum(math.lgamma(i + 1) for i in (r, n - r, k, n - k)) - sum(math.lgamma(i + 1) for i in (n, x, r - x, k - x, n - r - k + x)))

    def fisher(a, b, c, d):
        r, k, n = a + b, a + c, a + b + c + d
        own = hyper(a, r, k, n)
        return min(1.0, sum(p for x in range(max(0, r + k - n), min(r, k) + 1) if (p := hyper(x, r, k, n)) <= own * (1 + 1e-7)))

    r = random.Random(1)
    rows = [(0, 0, 0, 0), (0, 3, 4, 0), (5, 0, 0, 5), (1, 1, 1, 1)] + [tuple(r.randrange(m) for _ in range(4)) for m in (3, 30, 400, 20_000) for _ in range(12)]
    got = spark.createDataFrame(rows, "a long, b long, c long, d long").withColumn("p", stats.fisher(*map(F.col, "abcd"))).withColumn("s", stats.sign_test(F.col("a"), F.col("b"))).collect()
    for g in got:
        assert g.p == pytest.approx(fisher(g.a, g.b, g.c, g.d), rel=1e-6, abs=1e-12)
        n = g.a + g.b
        low = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(min(g.a, g.b) + 1))
        assert g.s == pytest.approx(min(1.0, 2 * low) if n else 1.0, rel=1e-6, abs=1e-12)
    big = spark.createDataFrame([(50_000_000, 50_000_000, 50_010_000, 49_990_000)], "a long, b long, c long, d long").select(stats.fisher(*map(F.col, "abcd")).alias("p")).first().p
    assert big == pytest.approx(math.erfc(10_000 / math.sqrt(50_000_000) / math.sqrt(2)), rel=1e-3)


def test_long_traces_grow_by_level(spark):
    r = random.Random(2)
    rows = [(f"q:{i}", "q", [r.choice("abcdefgh") for _ in range(200)], i % 2 == 0) for i in range(12)]
    t = spark.createDataFrame(rows, "trace_id string, question_id string, tokens array<string>, is_correct boolean")
    got = {tuple(x.motif): (x.success_count, x.failure_count) for x in mining.grown(t, 1, 3, 12).collect()}

    def holds(tokens, motif):
        it = iter(tokens)
        return all(m in it for m in motif)

    every = [(a,) for a in "abcdefgh"] + [(a, b) for a in "abcdefgh" for b in "abcdefgh"] + [(a, b, c) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    want = {m: (sum(holds(x[2], m) for x in rows if x[3]), sum(holds(x[2], m) for x in rows if not x[3])) for m in every}
    assert got == {m: c for m, c in want.items() if sum(c) >= 12}
    small, _ = traces(spark)
    for least, high in ((3, 3), (8, 4)):
        a = {tuple(x.motif): x["count"] for x in mining.frequent(small, least, 1, high).collect()}
        b = {tuple(x.motif): x["count"] for x in mining.frequent(small, least, 1, high, "enumerate").collect()}
        assert a == b


def test_wide_descent_takes_the_same_steps(spark):
    t, _ = traces(spark)
    rows = models.feature_sets(t, 1, 1)
    small, wide = (models.sparse_logistic(rows, 12, epochs=3, kinds=k) for k in (200_000, 0))
    assert small.weights.keys() == wide.weights.keys() and wide.bias == pytest.approx(small.bias)
    assert all(wide.weights[f] == pytest.approx(w) for f, w in small.weights.items())
    dealt = evaluate.question_folds(spark, t, 3)
    scored = models.hold_out(t, 3, least=5, dealt=dealt)
    assert scored.count() == t.count() and 0 <= scored.agg(F.min("score")).first()[0]


def test_models_across_corpora(spark):
    t, _ = traces(spark, n=200)
    assert models.transfer(t, t, 5).count() == 200
    curve = models.compression_curve(spark, t, (1, 3))
    assert [k for k, _ in curve] == [1, 3] and all(0 <= a <= 1 for _, a in curve)
    assert [r.m for r in spark.createDataFrame([(0.5,), (0.4,)], "r double").select(evaluate.mode_label(F.col("r")).alias("m")).collect()] == [1, 0]


def test_first_action_models_and_prefix_controls(spark):
    t, _ = traces(spark, n=120)
    got = {r.model: r for r in oof.report(spark, t, oof.FIRST_MODELS, folds=2).collect()}
    assert set(got) == set(oof.FIRST_MODELS) and all(0 <= r.auc <= 1 for r in got.values())
    rows, lines = oof.prefix_report(spark, t, ("M1",), (0.5, 1.0), folds=2)
    assert rows.count() == 4 and {(r.model, r.reordered) for r in lines.collect()} == {("M1", False), ("M1", True)}
    weights = oof.coefficients(t, "M2").collect()
    assert all(abs(r.coefficient) >= 1e-12 for r in weights)
    a = t.select(signals.shuffled_prefix(F.col("tokens"), F.col("trace_id")).alias("s"), "tokens").collect()
    assert all(sorted(r.s) == sorted(r.tokens) for r in a) and any(r.s != r.tokens for r in a)


def test_bootstraps(spark):
    lifts = spark.createDataFrame([("a", 2.0, 0.4, 0.2), ("b", 1.0, 0.1, 0.1), ("c", 3.0, 0.9, 0.3)], "token string, lift_ratio double, max_position_abs double, collapsed_abs double")
    g = resample.bootstrap_lifts(lifts, draws=400).first()
    assert (g.n_tokens_evaluated, g.n_tokens_ge_threshold) == (3, 2) and g.fraction_ge_threshold == pytest.approx(2 / 3)
    assert 0 <= g.fraction_ge_threshold_ci95_low <= 2 / 3 <= g.fraction_ge_threshold_ci95_high <= 1 and g.mean_excess_over_threshold == pytest.approx((0.1 - 0.05 + 0.45) / 3)
    assert 0 < g.paired_bootstrap_p_excess_le_zero < 0.3
    none = resample.bootstrap_lifts(lifts.limit(0), draws=10).first()
    assert none.n_tokens_evaluated == 0 and none.paired_bootstrap_p_excess_le_zero == 1.0
    m = spark.createDataFrame([(f"q{i}", float(i % 2) * 9 + i * 1e-3, float(i % 2)) for i in range(20)], "question_id string, a double, b double")
    s = resample.cluster_stability(m, ["a", "b"], lambda r, t, seed: models.clusters(r, t, k=2, seed=seed), draws=3).first()
    assert s.n_resamples_valid == 3 and s.ari_min == s.ari_max == 1.0


def test_signal_scores_against_plain_python(spark):
    rows = [("t1", 2.0, 1.0, 1.0, 4, True), ("t2", 0.0, 3.0, -3.0, 9, False), ("t3", 1.0, 1.0, 0.0, 5, True)]
    df = signals.signal_columns(spark.createDataFrame(rows, "trace_id string, success_signal double, failure_signal double, net_signal double, trace_length int, is_correct boolean"))
    known = [("net_signal", 1, 0.8, 0.5, -3.0, -1.0), ("trace_length", 2, -0.5, 4.5, 4.5, 6.0), ("unknown", 3, 0.9, 1.0, 0.0, 0.0)]
    m = spark.createDataFrame(known, "signal string, place int, pearson_with_correct double, mean_correct double, mean_incorrect double, best_threshold double")
    got = {r.trace_id: r for r in signals.success_scores(df, m).collect()}
    for t, _, _, net, n, _ in rows:
        parts = [0.8 * (net + 1) / 3.5, 0.5 * -(n - 6)]
        assert got[t].raw_score == pytest.approx(sum(parts)) and got[t].p_success == pytest.approx(1 / (1 + math.exp(-sum(parts))))
        assert got[t].signal_contributions == f"net_signal:{parts[0]:.3f} || trace_length:{parts[1]:.3f}"
    assert signals.metrics(df).count() == 6
    lines = signals.trajectory(spark.createDataFrame([("a", 1.0, 0.1), ("a", 2.0, 0.3), ("b", 1.0, 0.5), ("b", 2.0, 0.4), ("c", 1.0, 1.0)], "k string, x double, y double"), "x", "y", ("k",))
    assert {r.k: (round(r.slope, 9), r.monotonic_non_decreasing) for r in lines.collect()} == {"a": (0.2, True), "b": (-0.1, False), "c": (0.0, True)}


def test_tables_that_others_wrote(spark, tmp_path):
    (tmp_path / "m.csv").write_text("motif,length,success_count,failure_count,success_support,failure_support,support_difference,lift,log_odds_ratio,q_value\na|b,2,3,1,0.3,0.1,0.2,3,1.1,nan\nc,1,0,2,0,0.2,-0.2,0,-1,0.04\n")
    got = tables.motif_table(spark, str(tmp_path / "m.csv"), "global").orderBy("motif").collect()
    assert [(r.tokens, r.direction, r.q_value, r.scope) for r in got] == [(["a", "b"], "success", None, "global"), (["c"], "failure", 0.04, "global")]
    for model, text in (("x-1", "token,mean_delta\na,0.5\n,1\nb,oops\n"), ("y", "token,mean_delta\na,-1e-3\n")):
        (tmp_path / f"results_{model}").mkdir()
        (tmp_path / f"results_{model}" / "token_deltas_all.csv").write_text(text)
    assert sorted(tuple(r) for r in tables.token_deltas(spark, str(tmp_path)).collect()) == [("x-1", "a", 0.5), ("y", "a", -0.001)]
    (tmp_path / "s.csv").write_text("signal,pearson_with_correct,mean_correct,mean_incorrect,best_threshold,best_threshold_accuracy\nz,0.1,1,2,3,0.5\na,0.2,1,2,3,0.5\n")
    assert [r.signal for r in tables.signal_metrics(spark, str(tmp_path / "s.csv")).orderBy("place").collect()] == ["z", "a"]
    b = spark.createDataFrame([(" p1 ", "4", "u1", None), ("", "5", "u2", "s"), ("p3", " ", "u3", "s"), ("p4", "6", "u4", "s")], "problem string, answer string, url string, solution string")
    assert [(r.question_id, r.question, r.source_id, r.subject, r.solution) for r in tables.normalized_benchmark(b, "x", subject="alg").collect()] == [(0, "p1", "u1", "alg", None), (1, "p4", "u4", "alg", "s")]
    with pytest.raises(ValueError, match="answer"):
        tables.normalized_benchmark(b.drop("answer"), "x")
    (tmp_path / "e").write_text("# c\nexport A='1 2'\nB=old\n\nC\n")
    env = {"B": "kept"}
    assert tables.load_settings(str(tmp_path / "e"), env) == {"A": "1 2", "B": "old"} and env == {"A": "1 2", "B": "kept"}
    assert tables.file_suffix("org/Model v2.1") == "Model_v2.1"
    c = spark.createDataFrame([("",), (" 7 ",), ("x",), (None,)], "v string").select(tables.optional_int(F.col("v")).alias("i"), tables.optional_text(F.col("v")).alias("t")).collect()
    assert [(r.i, r.t) for r in c] == [(None, None), (7, "7" if c[1].t == "7" else " 7 "), (None, "x"), (None, None)]


def test_sinks_append_resume_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([("1", 0, "a,\"b\"\nc"), ("1", 1, ""), ("2", 0, None)], "question_id string, sample_id int, text string")
    path = str(tmp_path / "out")
    assert not sinks.start(spark, path, resume=True)
    sinks.append_rows(rows.limit(2), path, ["question_id", "sample_id", "text"])
    assert sinks.start(spark, path, resume=True)
    left = sinks.remaining(rows, path, ["question_id", "sample_id"])
    assert [(r.question_id, r.sample_id) for r in left.collect()] == [("2", 0)]
    sinks.append_rows(left, path, ["question_id", "sample_id", "text"])
    assert spark.read.csv(path, header=True, escape='"', multiLine=True).count() == 3 and sinks.remaining(rows, path, ["question_id", "sample_id"]).isEmpty()
    assert not sinks.start(spark, path, resume=False) and sinks.remaining(rows, path, ["question_id", "sample_id"]).count() == 3
    sinks.append_events(rows.select(F.lit("trace_chunked").alias("event"), "question_id"), str(tmp_path / "log"))
    log = spark.read.json(str(tmp_path / "log"))
    assert log.count() == 3 and log.filter("ts > 1.5e9").count() == 3
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        sinks.stream_rows(stream, str(tmp_path / "s"), str(tmp_path / "c"), once=True).awaitTermination()
    assert spark.read.csv(str(tmp_path / "s"), header=True, escape='"', multiLine=True).count() == 3
    sinks.stream_events(stream, str(tmp_path / "e"), str(tmp_path / "ec"), once=True).awaitTermination()
    assert spark.read.json(str(tmp_path / "e")).count() == 3


def test_tokenising_job(spark, tmp_path):
    rows = [("7", "0", "first we add\n\nRuntimeException at mongodb"), ("7", "1", "RuntimeException"), ("8", "0", None)]
    t = spark.createDataFrame(rows, "question_id string, sample_id string, reasoning_trace string")

    def client(prompt):
        if prompt.startswith(tokenizer.CHUNK_TASK):
            if "sample: 0" in prompt and "question: 7" in prompt:
                return 'Sure: ```json\n{"chunks": [{"text": "first we add", "label": "REASONING"}, {"span": "RuntimeException at mongodb"}, {"text_span": " "}]}\n```'
            return "no json here"
        if prompt.startswith(tokenizer.GUIDE_TASK):
            assert "question: 7" in prompt and "first we add" in prompt and "mongodb" not in prompt
            return '{"final_vocabulary": ["action:add"]}'
        assert "sample: 0" in prompt and '"final_vocabulary"' in prompt
        return '{"tokenized_trace": "Action:Add noise:xyz"}'

    done, guide = tokenizer.tokenize(t, client)
    got = {(r.question_id, r.sample_id): r.tokenized_trace for r in done.collect()}
    assert got == {("7", "0"): "action:add noise:corrupted-span", ("7", "1"): "noise:corrupted-span", ("8", "0"): "noise:corrupted-span"}
    g = {r.question_id: (r.num_traces, r.sample_ids, json.loads(r.metadata)) for r in guide.collect()}
    assert g["7"] == (2, ["0", "1"], {"final_vocabulary": ["action:add"]}) and g["8"][2] == json.loads(tokenizer.NOISE_GUIDE)
    assert tokenizer.progress(t, guide, done).count() == 6


def test_answer_lines_and_contents(spark):
    rows = [("work\n#### 4\n\n", "hash", "work"), ("work\nfinal : 4", "final", "work"), ("so\n\\boxed{4} ok", "boxed", "so"), ("a\nb", "hash", "a\nb"), ("", "final", ""), (None, "final", ""), ("\n \n", "hash", "")]
    df = spark.createDataFrame(rows, "t string, k string, want string")
    assert all(r.got == r.want for r in df.select(answers.without_answer_line(F.col("t"), F.col("k")).alias("got"), "want").collect())
    parts = [('["a", {"text": "b"}, {"image": 1}]', "ab"), ("plain", "plain"), (None, "")]
    assert all(r.got == r.want for r in spark.createDataFrame(parts, "c string, want string").select(answers.content_text(F.col("c")).alias("got"), "want").collect())


def test_summaries(spark):
    t, _ = traces(spark)
    raw = t.select("question_id", "sample_id").withColumn("text", F.lit("two words")) if "sample_id" in t.columns else None
    if raw is not None:
        assert summaries.with_raw_lengths(t, raw).filter("raw_words = 2 and raw_chars = 9").count() == t.count()
    ids = spark.createDataFrame([(q,) for q in ("10", "9", "b", "a", "011")], "question_id string")
    assert [r.question_id for r in ids.orderBy(summaries.place_of(F.col("question_id"))).collect()] == ["9", "10", "011", "a", "b"]
    assert {r.question_id for r in summaries.from_question(ids, "011").collect()} == {"011", "a", "b"} and summaries.from_question(ids, "zz").isEmpty() and summaries.from_question(ids, None).count() == 5
    assert summaries.nonzero(spark.createDataFrame([(0.0,), (1e-13,), (-1e-3,)], "coefficient double")).count() == 1


def test_service_over_http(spark, tmp_path):
    from urllib.error import HTTPError
    from urllib.request import urlopen
    from threading import Thread

    from tracelith.plans import export, service

    t, _ = traces(spark)
    t = t if "predicted_answer" in t.columns else t.withColumn("predicted_answer", F.lit("4"))
    export.write_questions(t, f"{tmp_path}/e", "pilot")
    web = service.server(export.Service(spark, f"{tmp_path}/e"), 0, lambda: spark.range(2))
    Thread(target=web.serve_forever, daemon=True).start()
    get = lambda p: json.loads(urlopen(f"http://127.0.0.1:{web.server_address[1]}{p}").read())
    assert get("/api/health") == {"status": "ok"} and get("/api/overview")["corpus_label"] == "pilot" and get("/api/status") == [{"id": 0}, {"id": 1}]
    listed = get("/api/questions?sort=trace_count")
    assert listed and get(f"/api/questions/{listed[0]['question_id']}")["total_traces"] == listed[0]["total_traces"]
    for wrong, code in (("/api/questions/none", 404), ("/x", 404), ("/api/questions?sort=y", 400)):
        with pytest.raises(HTTPError) as e:
            get(wrong)
        assert e.value.code == code
    web.shutdown()


def test_small_artifacts_and_readers(spark, tmp_path):
    from tracelith.operators import corpus
    from tracelith.plans import export
    from tracelith.sources import attempts, traces as source

    export.write_json({"b": 1, "a": [2]}, f"{tmp_path}/x.json")
    assert (tmp_path / "x.json").read_text() == '{\n  "a": [\n    2\n  ],\n  "b": 1\n}\n'
    df = spark.createDataFrame([("a", 1.0), ("b", -3.0), ("c", 2.0)], "name string, v double")
    assert [(r.place, r.label, r.value) for r in export.plot_data(df, "name", "v", k=2).collect()] == [(1, "b", -3.0), (2, "c", 2.0)]
    assert sorted((r.bin, r["count"]) for r in export.histogram(df, "v", 5).collect()) == [(0, 1), (4, 2)]
    (tmp_path / "t.csv").write_text("question_id,sample_id,is_correct,tokenized_trace\n1,0,true,a b\n1,1,maybe,a\n2,0,false,MISSING\n")
    assert tuple(source.load_counts(spark, f"{tmp_path}/t.csv").first()) == (3, 1, 1, 1) and source.table_file(spark, f"{tmp_path}/t.csv").count() == 3
    (tmp_path / "e.csv").write_text("question_id,sample_id,is_correct,tokenized_trace\n")
    with pytest.raises(ValueError, match="no rows"):
        source.trace_csv(spark, f"{tmp_path}/e.csv")
    with pytest.raises(ValueError, match="no reader"):
        source.table_file(spark, "x.txt")
    (tmp_path / "l.json").write_text('[{"a": 1}, {"a": 2}]')
    assert source.table_file(spark, f"{tmp_path}/l.json").count() == 2 and "gsm8k" in attempts.preset_names()
    t, _ = traces(spark)
    assert corpus.question_stats(t, least_right=1, least_wrong=1).filter("right < 1 or wrong < 1").isEmpty()
    many = "$" * 9 + "\\(x\\)" + "$" * 9
    got = spark.range(1).select(answers.cleaned(F.lit(many)).alias("c"), answers.verify_prompt(F.lit("q"), F.lit("4"), F.lit("r")).alias("p")).first()
    assert got.c == "x" and got.p.endswith("Response:\nr")
