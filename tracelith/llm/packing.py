"""Best-fit packing of token sequences by large-item matching.

Documents become ids and are cut only where they exceed the capacity. The plan needs the pieces'
lengths alone: counts by length, at most one for each length up to the capacity. Lengths above one
third of the capacity fit at most two to a sequence: from the longest down, each takes the longest
partner that still fits. Shorter lengths, from the longest down, go where they leave the least gap;
what fits nowhere opens sequences. Pieces find their places by their number among those of their
length, counted within tasks and summed over tasks, so no task holds more than its own rows.

Null texts are empty: one piece with the closing id alone. Repeated rows are packed each.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelith.llm.arrays import chunks
from tracelith.llm.bpe import CHUNK_CHARS, codec
from tracelith.llm.run import Scratch, documents, small_batches

CAPACITY, CLOSING_ID = 2048, 0


def closed_ids(path: str, texts: list[str]) -> list[np.ndarray]:
    """Each text's ids with the closing id."""
    ids, ends = codec(path).encode(texts)
    parts = np.split(ids.astype("<u4"), ends[:-1])
    return [np.r_[p, np.uint32(CLOSING_ID)].astype("<u4") for p in parts]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task, number (among the task's pieces of this length) and, if asked for, ids (little-endian, 32 bits)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, task = Counter(), TaskContext.get().partitionId()
        for batch in batches:
            for rows in chunks(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True), lambda r: len(r[1]), CHUNK_CHARS):
                out = []
                for (doc_id, _), ids in zip(rows, closed_ids(path, [t for _, t in rows]), strict=True):
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity].astype("<u4").tobytes()
                        n = len(part) // 4
                        out.append((doc_id, k, start, n, zlib.crc32(part), task, seen[n], *[part] * with_ids))
                        seen[n] += 1
                columns = zip(*out, strict=True)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number", "ids"][: 7 + with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names)

    return documents(docs).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths in order, how many such sequences) for the given counts by length."""
    left = Counter({n: c for n, c in counts.items() if c})
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by gap
    third = capacity // 3
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    rising = large[::-1]
    for n in large:
        while left[n]:
            at = bisect_left(rising, capacity - n + 1) - 1
            while at >= 0 and not left[rising[at]]:
                rising.pop(at)
                at -= 1
            m = rising[at] if at >= 0 else None
            if m == n and left[n] == 1:
                at -= 1
                while at >= 0 and not left[rising[at]]:
                    at -= 1
                m = rising[at] if at >= 0 else None
            if m is None:
                bins[capacity - n].append(((n,), left[n]))
                left[n] = 0
            elif m == n:
                bins[capacity - 2 * n].append(((n, n), left[n] // 2))
                left[n] %= 2
            else:
                times = min(left[n], left[m])
                bins[capacity - n - m].append(((n, m), times))
                left[n] -= times
                left[m] -= times
    gaps = sorted(bins)
    for n in sorted((n for n in left if left[n] and n <= third), reverse=True):
        while left[n]:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                each = capacity // n
                if left[n] >= each:
                    pattern, times = (n,) * each, left[n] // each
                else:
                    pattern, times = (n,) * left[n], 1
                left[n] -= len(pattern) * times
                gap = capacity - len(pattern) * n
                if gap not in bins or not bins[gap]:
                    insort(gaps, gap)
                bins[gap].append((pattern, times))
                continue
            gap = gaps[at]
            pattern, times = bins[gap].pop()
            if not bins[gap]:
                gaps.pop(at)
            each = min(gap // n, left[n])
            used = min(times, left[n] // each)
            for fresh, how_many in ((pattern + (n,) * each, used), (pattern, times - used)):
                if how_many:
                    rest = capacity - sum(fresh)
                    if not bins[rest]:
                        insort(gaps, rest)
                    bins[rest].append((fresh, how_many))
            left[n] -= each * used
    return [x for g in sorted(bins) for x in bins[g]]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: from which number on a slot holds, the sequence of its first piece, and the offset in it."""
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    taken: Counter = Counter()
    first = 0
    for pattern, times in patterns:
        offset = 0
        for n in pattern:
            slots[n].append((taken[n], first, offset))
            taken[n] += times
            offset += n
        first += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*s, strict=True)) for n, s in slots.items()}


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids, of every piece.

    To the driver go the counts by length, `capacity` rows at most. The pieces are written once; their
    numbers come from the task counts, summed in order of the tasks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    cut = scratch.write(pieces(docs, path, capacity, with_ids), "pieces")
    by_task = scratch.write(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "counts")
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = places(plan(counts, capacity))
    before = by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))).select("length", "task", F.coalesce("before", F.lit(0)).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(part):
                    begin, first, off = slots[int(length[part[0]])]
                    at = np.searchsorted(begin, number[part], "right") - 1
                    sequence[part], offset[part] = first[at] + number[part] - begin[at], off[at]
            names, more = ["doc_id", "piece", "start", "length", "ids_crc32"], ["ids"] * with_ids
            columns = [*map(batch.column, names), pa.array(sequence), pa.array(offset), *map(batch.column, more)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset", *more])

    ranked = cut.join(before, ["length", "task"]).withColumn("rank", F.col("number") + F.col("before"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids)
