import random

from tracelith.llm.components import components
from tracelith.llm.neardup import near_duplicates
from tracelith.llm.run import Scratch


def sets(rows):
    out = []
    for d, t in rows:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        out.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    return out


def brute(rows, percent=85):
    docs = sets(rows)
    parent = {d: d for d, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, a) in enumerate(docs):
        for e, b in docs[:i]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(d), root(e)))
                parent[y] = x
    return sorted((d, len(a), root(d), root(d) == d) for d, a in docs)


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["Ünï", "A", "THE"]
    rows = []
    for _ in range(25):
        words = [r.choice(vocab) for _ in range(r.choice([3, 5, 6, 40, 90, 200]))]
        for _ in range(r.randrange(1, 7)):
            copy = list(words)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            words = copy if r.random() < 0.5 else words  # chains of edits: ends of a chain need not be linked
            rows.append(" ".join(copy))
    r.shuffle(rows)
    rows = [(i * 3, t) for i, t in enumerate(rows)]
    return rows + [(9001, None), (9002, ""), (9003, " \n"), (9004, "a b"), (9005, "A  B"), (9006, rows[0][1].upper()), rows[5]]


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, u int")
        got = sorted(tuple(r) for r in near_duplicates(docs).collect())
        assert got == brute(rows)


def test_large_group_of_near_copies(spark):
    r = random.Random(3)
    base = [f"x{i}" for i in range(300)]
    rows = [(i, " ".join([*base[:100], f"y{i}", *base[101:]])) for i in range(700)] + [(5000 + i, " ".join(r.choice(base) for _ in range(50))) for i in range(40)]
    got = {x.doc_id: x.component_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 0 for i in range(700)) and all(got[i] == i for i in got if i >= 5000)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 400), (500, 600)], "u long, v long")
    got = {r.node: r.component for r in components(edges, Scratch(spark)).collect()}
    assert all(got[i] == 0 for i in range(101)) and got[400] == got[500] == got[600] == 400


def test_near_copies_below_the_threshold(spark):
    """2000 texts that share bands in pairs, none of them linked: no all-pairs output, and nothing joined."""
    r = random.Random(4)
    base = [f"x{i}" for i in range(300)]
    # eight changed words touch 40 of 296 shingles: about 0.76 between two texts
    rows = []
    for i in range(2000):
        words = list(base)
        for at in r.sample(range(5, 295, 10), 8):
            words[at] = f"y{i}-{at}"
        rows.append((i, " ".join(words)))
    linked = {d: c for d, _, c, _ in brute(rows[:150])}
    got = {x.doc_id: x.component_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(linked[i] == i for i in linked) and all(got[i] == i for i in got)


def test_recall_at_the_threshold(spark):
    """Of pairs with exactly 170 common shingles of 200, at least 0.999 are found; of those with 170 of 202 none."""
    n, rows = 1500, []
    for i in range(n):
        common = [f"{i}-{k}" for k in range(174)]
        rows += [(4 * i + j, " ".join(common + [f"{i}.{j}.{k}" for k in range(own)])) for j, own in enumerate((15, 15, 17))]
    assert [c for _, _, c, _ in brute(rows[:3])] == [0, 0, 2]
    got = {x.doc_id: x.component_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[4 * i + 1] == 4 * i for i in range(n)) >= 0.999 * n and all(got[4 * i + 2] == 4 * i + 2 for i in range(n))


def test_null_ids_and_shared_ids(spark):
    words = [f"w{i}" for i in range(50)]
    rows = [(None, " ".join(words)), (1, " ".join(words)), (2, "a b c d e f"), (2, " ".join([*words, "end"])), (3, "a b c d e f g")]
    got = sorted(((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(None, 46, None, True), (1, 46, 1, True), (2, 2, 1, False), (2, 47, 1, False), (3, 3, 3, True)], key=repr)
