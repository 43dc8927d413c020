import hashlib
import random
from collections import Counter

import numpy as np

from tracelith.llm import suffixes
from tracelith.llm.suffixes import drop_repeats, repeated_windows, suffix_ranks


def test_suffix_ranks_against_sorting():
    r = random.Random(1)
    for n in (1, 2, 3, 4, 5, 7, 50, 200):
        for _ in range(20):
            s = [r.randrange(1, r.choice([2, 3, 9]) + 1) for _ in range(n)]
            ranks = suffix_ranks(np.array(s, np.int64), 30)
            assert sorted(range(n), key=lambda i: s[i:]) == np.argsort(ranks, kind="stable").tolist()


def test_repeated_windows_against_counting():
    r = random.Random(2)
    for least in (4, 9, 30):
        texts = [bytes(r.choice(b"ab\0") for _ in range(r.randrange(least, 90))) for _ in range(12)]
        counts = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
        for t, got in zip(texts, repeated_windows(texts, least), strict=True):
            assert got.tolist() == [counts[t[i : i + least]] > 1 for i in range(len(t) - least + 1)]


def brute(rows, least):
    texts = [(d, (t or "").encode()) for d, t in rows]
    counts = Counter(t[i : i + least] for _, t in texts for i in range(len(t) - least + 1))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - least + 1):
            if counts[t[i : i + least]] > 1:
                gone[i : i + least] = True
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(t) else 0
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé日 ") for _ in range(r.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(r.randrange(20, 90))) for _ in range(6)]
    rows = []
    for i in range(50):
        parts = [r.choice(passages) if r.random() < 0.5 else " ".join(word() for _ in range(r.randrange(60))) for _ in range(r.randrange(4))]
        text = r.choice(["", " ", "x"]).join(parts)
        if text and r.random() < 0.4:
            k = r.randrange(len(text))
            text = text[:k] + "Z" + text[k + 1 :]
        rows.append((i, text))
    return rows + [(100, "ab" * 300), (101, "c" * 199), (102, "c" * 150), (103, None), (104, ""), rows[2], (7, "another text of row seven " * 3), (105, "d" * 200), (106, "e" * 201)]


def test_against_brute_force(spark, monkeypatch):
    for seed, most in ((1, 2000), (2, 1), (3, 3)):
        monkeypatch.setattr(suffixes, "MOST_STRETCHES", most)
        rows = corpus(seed)
        docs = spark.createDataFrame([(*x, 1, "s") for x in rows], "doc_id long, text string, h int, spans string")
        assert sorted(tuple(x) for x in drop_repeats(docs, keep_bytes=False).collect()) == brute(rows, 200)


def test_empty(spark):
    assert drop_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_ids_and_a_very_long_text(spark):
    r = random.Random(5)
    long = "".join(r.choice("abcdefghij ") for _ in range(1_500_000))
    rows = [(1, long), (None, "x" + long[5000:5300] + "y"), (None, "short"), (2, None)]
    got = {(x.doc_id, x.n_bytes): (x.n_removed, x.n_spans) for x in drop_repeats(spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, id int")).collect()}
    assert got == {(1, 1_500_000): (300, 1), (None, 302): (300, 1), (None, 5): (0, 0), (2, 0): (0, 0)}
