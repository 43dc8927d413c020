"""Exact top-k by columnar branch and bound.

Vectors become integers and lie dimension by dimension (vertically) in shards of bounded size; every
shard of queries meets every shard of candidates in one cell. In a cell, scores accumulate block by
block of dimensions. What the remaining dimensions can add is bounded by the product of the
remaining norms (the remaining mass): candidates whose best can't reach the k-th of the others'
worst leave, and the survivors are compacted. All arithmetic on scores is exact in 64-bit integers.

Vectors that are null, or hold a null or a non-finite component, take no part; vectors of different
lengths never meet. A row is never its own candidate: rows with the query's vec_id are left out.
Equal scores go to the smaller vec_id; repeated rows of one vec_id count as one if their vectors agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelith.llm.run import Scratch

SCALE, K, QUERY_STEP, DIM_BLOCK = 1024, 10, 100, 8
CANDIDATE_SHARD, QUERY_SHARD = 8192, 1024


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component, for the vectors that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    sound = F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c)).alias("v")).distinct()


def search(query: np.ndarray, columns: np.ndarray, rest: np.ndarray, k: int, block: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates (columns of a dimension-major array) that can be among the k best of a query, and their scores.

    rest: for every block boundary, each candidate's remaining norm. own: candidates left out.
    """
    dims = len(query)
    alive = np.flatnonzero(~own)
    scores = np.zeros(len(alive), np.int64)
    tail = np.sqrt(np.r_[np.cumsum((query.astype(np.float64) ** 2)[::-1])[::-1], 0.0])
    for i, d in enumerate(range(0, dims, block)):
        part = columns[d : d + block]
        scores += query[d : d + block] @ (part if len(alive) == part.shape[1] else part[:, alive])
        if len(alive) > k and d + block < dims:
            mass = tail[d + block] * rest[i + 1][alive] * (1 + 1e-9) + 1
            floor = np.partition(scores - mass, len(alive) - k)[len(alive) - k]
            keep = scores + mass >= floor
            if keep.mean() < 0.8:
                alive, scores = alive[keep], scores[keep]
    return alive, scores


def cell(queries: list[tuple], candidates: list[tuple], k: int, block: int) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of each query's k best in this cell."""
    ids = np.array([r[0] for r in candidates], np.int64)
    columns = np.ascontiguousarray(np.array([r[1] for r in candidates], np.int64).reshape(len(ids), -1).T)
    dims = len(columns)
    squares = np.cumsum((columns.astype(np.float64) ** 2)[::-1], axis=0)[::-1]
    rest = [np.sqrt(squares[d]) if d < dims else np.zeros(len(ids)) for d in range(0, dims + block, block)]
    out = []
    for query_id, v in queries:
        at, scores = search(np.array(v, np.int64), columns, rest, k, block, ids == query_id)
        best = np.lexsort((ids[at], -scores))[:k]
        out += [(query_id, int(ids[at[b]]), int(scores[b])) for b in best]
    return out


def top_k(vectors: DataFrame, k: int = K, query_step: int = QUERY_STEP, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products. Queries: vec_id divisible by `query_step`."""
    scratch = Scratch(vectors.sparkSession)
    whole = scratch.write(integers(vectors, scale).withColumn("dims", F.size("v")), "vectors")
    asked = whole.filter(F.col("vec_id") % query_step == 0)
    # shards by hash: their number comes from counts, so a shard's size is bounded whatever the table's
    sizes = whole.groupBy("dims").agg((F.floor(F.count(F.lit(1)) / CANDIDATE_SHARD) + 1).cast("int").alias("cs"), (F.floor(F.count(F.when(F.col("vec_id") % query_step == 0, 1)) / QUERY_SHARD) + 1).cast("int").alias("qs"))
    shard = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = whole.join(sizes, "dims").select("dims", shard("cs", 1).alias("c"), each("qs").alias("q"), F.lit(0).alias("side"), "vec_id", "v")
    left = asked.join(sizes, "dims").select("dims", each("cs").alias("c"), shard("qs", 2).alias("q"), F.lit(1).alias("side"), "vec_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])

        key, sides = None, ([], [])
        for batch in batches:
            for *now, side, vec_id, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != key:
                    if all(sides):
                        yield pack(cell(sides[1], sides[0], k, DIM_BLOCK))
                    key, sides = now, ([], [])
                sides[side].append((vec_id, v))
        if all(sides):
            yield pack(cell(sides[1], sides[0], k, DIM_BLOCK))

    found = left.union(right).repartition("dims", "c", "q").sortWithinPartitions("dims", "c", "q").mapInArrow(run, "query_id long, vec_id long, score long").distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: floor(1024 * x) of every component and all inner products of the queries.
ORACLE = """
WITH w AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM w q JOIN w c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
