import random

import corpus_pipeline
from tests.llm.test_neardup import brute as groups
from tests.llm.test_substrings import brute as windows
from tests.llm.test_toxicity import corpus


def test_stages_against_plain_python(spark, tmp_path):
    rows, labels = corpus(5, 260)
    r = random.Random(1)
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    passage = " ".join(f"p{r.randrange(99)}" for _ in range(60))
    clean = [i for i, bad in labels if not bad]
    text = dict(rows)
    text[clean[3]] += " " + passage
    text[clean[9]] += "\n" + passage + f' token = "{key}" x'
    text[1000] = text[clean[5]] + " one"
    text[1001] = text[clean[6]]
    text |= {1002: None, 1003: "", 1004: "\n "}
    spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in text.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, before = spark.read.parquet(f"{tmp_path}/documents.parquet"), text
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name == "packing":
            assert {x.doc_id for x in out.collect()} == set(before)
            break
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        after = {x.doc_id: x.text for x in docs.collect()}
        if name == "toxicity":
            bad = {i for i, y in labels if y}
            assert len(bad & set(after)) <= 4 and len(set(before) - set(after) - bad) <= 4
            assert all(after[k] == before[k] for k in after)
        elif name == "near_dedup":
            assert set(after) == {d for d, _, _, kept in groups(list(before.items()), 80) if kept}
            assert all(after[k] == before[k] for k in after)
        elif name == "substring_dedup":
            assert set(after) == set(before)
            for d, n, removed, _ in windows(sorted(before.items()), 20):
                assert after[d] == before[d] if not removed else len(after[d].split()) == n - removed
        elif name == "secret_scan":
            assert {k for k in after if after[k] != before[k]} == {clean[9]} & set(before)
            assert all(key not in (t or "") for t in after.values())
        before = after
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= len(before)


def test_null_and_shared_ids_stay(spark, tmp_path):
    r = random.Random(8)
    text = lambda n: " ".join(f"{r.choice('abcdefgh')}{r.randrange(10**6)}" for _ in range(n))
    a, b, c, d, long = text(40), text(40), text(40), text(40), text(90)
    passage = " ".join(long.split()[20:70])
    rows = [(1, a), (1, b), (1, a), (2, b + " end"), (None, c), (None, d), (None, c + " end"), (None, ""), (None, ""), (3, long), (3, text(4)), (None, text(30) + " " + passage)]
    docs = spark.createDataFrame([(i, t, "src", len(t)) for i, t in rows], "doc_id long, text string, source string, n_chars long")
    got = sorted(((x.doc_id, x.text) for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()), key=repr)
    none = [t for i, t in got if i is None]
    # of b and "b end" the smaller doc_id stays; of c and "c end" one
    assert [t for i, t in got if i == 1] == sorted([a, b]) and not [t for i, t in got if i == 2]
    assert sorted(t for i, t in got if i == 3) == sorted([long, rows[10][1]])
    assert none.count("") == 2 and d in none and (c in none) + (c + " end" in none) == 1 and rows[11][1] in none and len(none) == 5
    kept = spark.createDataFrame([(i, t, "src", len(t)) for i, t in got], docs.schema)
    out = corpus_pipeline.drop_substrings(spark, kept, "").collect()
    assert sorted((repr(x.doc_id) for x in out)) == sorted(repr(i) for i, _ in got)
    assert sum(passage in (x.text or "") for x in out) == 1 and sum(x.text in (a, b, d, rows[10][1], "") for x in out) == 6


def test_clashing_columns_maps_and_empty_tables(spark):
    from pyspark.sql import functions as F

    r = random.Random(9)
    text = lambda n: " ".join(f"{r.choice('abcdefgh')}{r.randrange(10**6)}" for _ in range(n))
    a, b = text(60), text(60)
    rows = [(1, a, {"k": 1}), (2, a, {"k": 2}), (None, b, None), (3, b + " " + text(40), {}), (3, "short", {"k": 3}), (4, None, None)]
    schema = "doc_id long, text string, m map<string,int>"
    extra = {"n_removed": F.lit(1), "kept_sha256": F.lit("x"), "kept_text": F.lit("y"), "row": F.lit(2), "_key": F.lit(3), "key": F.lit(4), "h": F.lit(5), "spans": F.lit("s"), "component_id": F.lit(6), "score": F.lit(0.1), "id": F.lit(7), "n_secrets": F.lit(8), "redacted": F.lit("r"), "a.b": F.lit(9)}
    docs = spark.createDataFrame(rows, schema).withColumns(extra)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.mode("overwrite").parquet("/tmp/tracelith-labels/labels.parquet")
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_near_duplicates, corpus_pipeline.drop_substrings, corpus_pipeline.redact_secrets):
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, "/tmp/tracelith-labels")
            assert out.columns == docs.columns
            got = out.collect()
            assert all(x["a.b"] == 9 and x["row"] == 2 and x["h"] == 5 for x in got)
            assert len(got) == (0 if given is not docs else 5 if stage is corpus_pipeline.drop_near_duplicates else 6)
    packed = corpus_pipeline.pack(spark, docs, "")
    assert {x.doc_id for x in packed.collect()} == {1, 2, 3, 4, None} and corpus_pipeline.pack(spark, docs.limit(0), "").count() == 0
