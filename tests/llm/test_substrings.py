import hashlib
import random

from tracelith.llm.substrings import drop_repeats


def brute(rows, window):
    seen, cover = {}, {}
    words = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in words:
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, (d, s)), (d, s))
    out = []
    for d, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (d, s):
                gone.update(range(s, s + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def corpus(seed, docs=60):
    r = random.Random(seed)
    vocab = [f"wörd{i}" for i in range(60)]
    passages = [[r.choice(vocab) for _ in range(r.randrange(15, 80))] for _ in range(6)]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(r.randrange(0, 5)):
            words += r.choice(passages) if r.random() < 0.5 else [r.choice(vocab) for _ in range(r.randrange(40))]
            if words and r.random() < 0.4:
                words[r.randrange(len(words))] = r.choice(vocab)
        rows.append((i * 7 % docs, r.choice([" ", "\n", "\t\x0b"]).join(words)))
    rows += [(1000, rows[0][1]), (1001, None), (1002, ""), (1003, " \n "), (1004, "a " * 300), (1005, "a b " * 40 + "c")]
    return rows + [rows[3]]


def test_against_brute_force(spark):
    for seed, window in ((1, 20), (2, 20), (3, 12)):
        rows = corpus(seed)
        docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, at string")
        got = sorted(tuple(r) for r in drop_repeats(docs, window, keep_text=False).collect())
        assert got == brute(rows, window)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert drop_repeats(docs).count() == 0


def test_shared_and_null_ids(spark):
    """Different texts of one doc_id are documents of their own; rows without one come last; clashing names don't matter."""
    w = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join([*w, "more"])), (2, "q " + " ".join(w[:100])), (2, "tiny text"), (None, "z " + " ".join(w[50:90])), (None, None)]
    docs = spark.createDataFrame([(d, t, 1, "x", {"k": 1}) for d, t in rows], "doc_id long, text string, n_removed int, kept_sha256 string, row map<string,int>")
    got = sorted(((x.doc_id, x.n_words, x.n_removed) for x in drop_repeats(docs).collect()), key=repr)
    assert got == sorted([(1, 201, 0), (2, 101, 100), (2, 2, 0), (None, 41, 40), (None, 0, 0)], key=repr)
    kept = drop_repeats(docs, keep_row=True).select("row.*").collect()
    assert sorted(map(repr, ((r.doc_id, r.text, r["row"]) for r in kept))) == sorted(map(repr, ((d, t, {"k": 1}) for d, t in rows)))


def test_hot_seed_with_many_surroundings(spark):
    """One passage of 12 words in 600 texts, with two, then one, then no further word alike on each side."""
    r = random.Random(6)
    core = [f"c{i}" for i in range(12)]
    side = lambda i: [f"{r.randrange(4)}", *(f"u{i}.{k}" for k in range(3)), f"s{r.randrange(2)}", "s", "t", f"{r.randrange(2)}x"]
    rows = [(i, " ".join(side(i) + core + side(-i)[::-1])) for i in range(600)]
    got = sorted(tuple(x) for x in drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=False).collect())
    assert got == brute(rows, 20)


def test_very_long_text(spark):
    r = random.Random(7)
    long = [f"v{r.randrange(5000)}" for _ in range(300_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[1000:1100])), (3, None)]
    got = sorted(tuple(x) for x in drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=False).collect())
    assert got == brute(rows, 20) and got[1][2] == 100
