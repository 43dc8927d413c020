import random
import zlib

import numpy as np

from tracelith.llm import toxicity as T


def corpus(seed, n):
    r = random.Random(seed)
    plain = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(600)]
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(plain) for _ in range(r.choice([5, 40, 200]))]
        bad = r.random() < 0.3
        for _ in range(max(2, len(words) // 20) * bad):
            words.insert(r.randrange(len(words)), r.choice(["zorque", "quxxo", "mokk"]) + r.choice(["", "ta", "li", "ne"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_gradients_match_differences():
    net, r = T.Network(1), np.random.default_rng(3)
    x, n = r.normal(0, 1, (4, T.WINDOW, T.INPUT)).astype(np.float32), np.array([24, 5, 1, 24])
    g = np.array([1.0, -0.5, 0.3, 0.2], np.float32)
    out, saved = net.forward(x, n)
    grads, _ = net.gradients(g, saved)
    for k in net.p:
        i = tuple(r.integers(0, s) for s in net.p[k].shape)
        old, step = net.p[k][i], 1e-2
        net.p[k][i] = old + step
        up = net.forward(x, n)[0]
        net.p[k][i] = old - step
        down = net.forward(x, n)[0]
        net.p[k][i] = old
        assert abs(float(((up - down) * g).sum()) / (2 * step) - grads[k][i]) < 2e-2


def test_evaluation_equals_the_training_pass():
    net = T.Network(4)
    t = T.read([b"one two three", b"", b"x " * 60, b"The END, again!"])
    logits, start, n, _ = net.logits(t)
    x = net.inputs(t)[t.words[np.minimum(start[:, None] + np.arange(T.WINDOW), len(t.words) - 1)]]
    assert np.allclose(net.forward(x, n)[0], logits, atol=1e-4)


def test_held_out_accuracy_and_edge_rows(spark):
    rows, labels = corpus(1, 700)
    rows += [(9000, None), (9001, ""), (9002, "..."), (5, rows[5][1])]
    docs = spark.createDataFrame([(*x, 3) for x in rows], "doc_id long, text string, label int")
    marks = spark.createDataFrame([(*x, "z") for x in labels] + [(None, 1, ""), (6, None, ""), (99999, 1, "")], "doc_id long, toxic int, text string")
    got = {r.doc_id: r for r in T.toxicity(docs, marks).collect()}
    want = dict(labels)
    held = [i for i in want if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i in want)
    assert sum(got[i].predicted == want[i] for i in held) / len(held) > 0.9
    assert got[9000].score == got[9001].score == got[9002].score == 0.0


def test_one_kind_of_label_or_none(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in T.toxicity(docs, none).collect()] == [0.0, 0.0]
    assert T.toxicity(docs.limit(0), none).count() == 0


def test_a_passage_counts_wherever_it_stands():
    net, r = T.Network(4), random.Random(2)
    passage = " ".join(f"w{r.randrange(10**6)}" for _ in range(T.WINDOW))
    alone = net.logits(T.read([passage.encode()]))[0][0]
    for shift in range(20):
        logits, start, n, _ = net.logits(T.read([("pad " * shift + passage + " pad" * 30).encode()]))
        assert list(start) == list(range(shift + 31)) and (n == T.WINDOW).all()
        assert np.abs(logits - alone).min() < 1e-4


def test_held_out_ranking_on_the_labels():
    """AUC over the held-out labelled documents of the tables, from a network trained on the others."""
    import os

    import pandas as pd

    data = os.environ.get("TEST_TOXIC_DIR", "/root/testdata/sf0.1")
    rows = pd.read_parquet(f"{data}/documents.parquet").merge(pd.read_parquet(f"{data}/labels.parquet"), on="doc_id").drop_duplicates("doc_id")
    held = rows.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)
    sample = rows[~held].groupby("toxic").head(500)
    net = T.train([t.encode() for t in sample.text.fillna("")], (sample.toxic == 1).to_numpy())
    rest = rows[held]
    before = net.char.copy()
    scores = pd.Series(net.scores(T.read([t.encode() for t in rest.text.fillna("")])))
    toxic, ranks = (rest.toxic == 1).to_numpy(), scores.rank().to_numpy()
    auc = (ranks[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.9 and (before == net.char).all() and np.abs(net.char - T.Network(2).char)[:, 1:].max() > 0.01


def test_character_slopes_match_differences():
    net, r = T.Network(5), np.random.default_rng(6)
    t = T.read([b"hello wonderful worlds"])
    used = np.arange(len(t.buckets))
    spelled = net.spelled(t, used)
    slope = r.normal(0, 1, spelled[3].shape).astype(np.float32)
    before = net.char.copy()
    net.learn_grams(spelled, slope)
    change = before - net.char
    for g in np.unique(spelled[0])[:12]:
        for c in range(T.CHAR_DIM):
            net.char = before.copy()
            net.char[g, c] += 1e-3
            up = (net.spelled(t, used)[3] * slope).sum()
            net.char[g, c] -= 2e-3
            down = (net.spelled(t, used)[3] * slope).sum()
            assert abs((up - down) / 2e-3 - change[g, c]) < 2e-2
