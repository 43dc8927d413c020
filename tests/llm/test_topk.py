import math
import random

from tracelith.llm.topk import top_k


def brute(rows, k=10, step=100):
    keep = {}
    for i, v in rows:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            keep[i] = [math.floor(1024 * c) for c in v]
    out = []
    for q in sorted(keep):
        if q % step == 0:
            scores = sorted(((-sum(a * b for a, b in zip(keep[q], v)), i) for i, v in keep.items() if i != q and len(v) == len(keep[q])))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return out


def test_against_brute_force(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) * 2 ** -(d // 4) for d in range(24)]) for i in range(900)]
    rows += [(i, rows[7][1]) for i in range(900, 1300)]  # ties
    rows += [(2000, None), (2001, [1.0, None]), (2100, [float("nan")] * 24), (2200, [float("inf")] * 24), (2300, [1.0, 2.0]), (2301, [0.5, -1.0])]
    docs = spark.createDataFrame([(i, v, "z") for i, v in rows], "vec_id long, embedding array<double>, dims string")
    assert sorted(tuple(x) for x in top_k(docs).collect()) == brute(rows)


def test_empty_and_few(spark):
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [0.5]), (1, [0.5])], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in top_k(few).collect()] == [(0, 1, 1, 1024 * 512)]
