"""Suffix-array dedup of byte strings, with difference-cover suffix sorting.

Bytes covered by a string of `least` bytes that also starts elsewhere go, in every place. Each window
of `least` bytes has an anchor, the leftmost of its k-byte stretches with the least hash, and equal
windows have equally placed anchors; so windows of different anchors needn't meet. Stretches (all
that an anchor's windows cover) that recur as a whole are settled by counting their hashes. Of
anchors with several different stretches, one of each comes with its bytes to the task of its anchor,
where a suffix array over them is built by the difference-cover algorithm: sort the sampled triples,
recurse on their names, merge the remaining suffixes, then compare adjacent prefixes. Anchors with
more stretches than a task should hold have their windows counted by two hashes instead.

Null and empty texts have no bytes. Matches never cross documents. Rows are documents of their own,
whatever their doc_id, or without one: a repeated row repeats all its strings. Columns besides doc_id
and text play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelith.llm.arrays import RangeHash, gather, owned_anchors, ragged
from tracelith.llm.run import Scratch, documents, slices, small_batches

LEAST, SEED_BYTES = 200, 64
MOST_STRETCHES, MOST_BYTES = 2000, 1 << 20
KEY = ["doc_id", "h"]


def order_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by the keys, and each row's name: equal rows have equal names, from 1 in order."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new) + 1
    return order, names


def suffix_ranks(s: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix of s (values from 1); suffixes that agree in 3**depth symbols or more may share one.

    s has up to 2**20 symbols, so that three ranks fit 64 bits.
    """
    n = len(s)
    if n < 3:
        return order_of(*(np.r_[s, np.zeros(3, np.int64)][i : i + n] for i in range(3)))[1]
    t = np.r_[s, np.zeros(5, np.int64)]
    ones, twos = np.arange(1, n + 1, 3), np.arange(2, n + 1, 3)
    sample = np.concatenate([ones, twos])
    _, names = order_of(t[sample], t[sample + 1], t[sample + 2])
    if names.max() < len(sample) and depth > 1:
        names = suffix_ranks(names, depth - 1)
    rank = np.zeros(n + 5, np.int64)
    rank[sample] = names
    # the rest: by symbol and the rank of what follows
    zero = np.arange(0, n, 3)
    size = np.int64(n + 3)
    place = zero[np.lexsort((rank[zero + 1], t[zero]))]
    pair = lambda i: t[i] * size + rank[i + 1]
    triple = lambda i: (t[i] * (t.max() + 1) + t[i + 1]) * size + rank[i + 2]
    by = np.argsort(rank[sample], kind="stable")
    sampled = sample[by][sample[by] < n]
    a, b = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    # merged: a suffix's rank is the number of smaller ones of its own kind and of each other kind
    final = np.zeros(n, np.int64)
    own = rank[sampled]
    final[sampled] = np.searchsorted(own, own)
    final[a] += np.searchsorted(pair(place), pair(a))
    final[b] += np.searchsorted(triple(place), triple(b))
    zero_keys = pair(place)
    final[place] = np.searchsorted(zero_keys, zero_keys) + np.searchsorted(pair(a), zero_keys) + np.searchsorted(triple(b), triple(place))
    return final + 1


def repeated_windows(texts: list[bytes], least: int) -> list[np.ndarray]:
    """For each text, whether the window at each start also stands in another place of these texts."""
    raw, starts, lengths = ragged(t + b"\0" for t in texts)
    s = raw.astype(np.int64) + 1
    s[starts + lengths - 1] = 257
    rank = suffix_ranks(s, int(np.ceil(np.log(least) / np.log(3))))
    at = np.concatenate([np.arange(a, a + n - least) for a, n in zip(starts, lengths, strict=True)]) if len(texts) else np.zeros(0, np.int64)
    order = at[np.argsort(rank[at], kind="stable")]
    same = np.zeros(len(order), bool)
    for i in range(0, len(order) - 1, 20_000):
        j = min(i + 20_000, len(order) - 1)
        left, right = order[i:j], order[i + 1 : j + 1]
        equal = np.ones(j - i, bool)
        for k in range(0, least, 50):
            live = np.flatnonzero(equal)
            cols = np.arange(k, min(k + 50, least))
            equal[live] = (s[left[live, None] + cols] == s[right[live, None] + cols]).all(axis=1)
        same[i:j] = equal
    hit = np.zeros(len(s), bool)
    hit[order[:-1][same[:-1]]] = True
    hit[order[1:][same[:-1]]] = True
    return [hit[a : a + max(0, n - least)] for a, n in zip(starts, lengths, strict=True)]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Start and length of each run of true."""
    edges = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return [(int(a), int(b - a)) for a, b in edges.reshape(-1, 2)]


def seeds(texts: DataFrame, least: int, k: int) -> DataFrame:
    """seed, stretch (two hashes in one row), doc_id, h, at, n of every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, starts, _ = ragged(batch.column("text").to_pylist())
            bounds = np.r_[starts, len(raw)]
            grams = RangeHash(raw, 21)
            place, first, n = owned_anchors(grams.fixed(k), bounds, k, least)
            stretch = RangeHash(raw, 22)(first, n + least - 1) + (place - first).astype(np.uint64)
            doc = np.searchsorted(bounds, first, "right") - 1
            ids, hs = (batch.column(c).to_numpy() for c in KEY)
            seed = grams(place, np.full(len(place), k))
            yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(stretch.view(np.int64)), pa.array(ids[doc]), pa.array(hs[doc]), pa.array((first - bounds[doc]).astype(np.int32)), pa.array(n.astype(np.int32))], ["seed", "stretch", *KEY, "at", "n"])

    return texts.mapInArrow(run, "seed long, stretch long, doc_id long, h long, at int, n int")


def repeats(texts: DataFrame, scratch: Scratch, least: int, k: int) -> DataFrame:
    """doc_id, h, at, n: windows at .. at+n-1 of the document also start elsewhere."""
    found = seeds(texts, least, k)
    shared = scratch.write(found.groupBy("seed").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("seed"), "shared")
    live = scratch.write(found.join(shared, "seed", "left_semi"), "seeds")
    classes = scratch.write(live.groupBy("seed", "stretch").agg(F.min(F.struct(*KEY, "at", "n")).alias("first"), F.count(F.lit(1)).alias("times")), "classes")
    whole = live.join(classes.filter("times > 1").select("seed", "stretch"), ["seed", "stretch"], "left_semi").select(*KEY, "at", "n")
    kinds = scratch.write(classes.groupBy("seed").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "kinds")
    edges = classes.join(kinds, "seed").select("seed", "first.*", "times", "kinds")
    asked = edges.groupBy(*KEY).agg(F.collect_list(F.struct("seed", "at", "n", "times", "kinds")).alias("asked"))
    pieces = scratch.write(cut_pieces(texts.dropDuplicates(KEY).join(asked, KEY), least), "pieces")
    few = pieces.filter(F.col("kinds") <= MOST_STRETCHES).repartition("seed").sortWithinPartitions("seed")
    by_suffix = scratch.write(few.mapInArrow(lambda b: sorted_windows(b, least), "doc_id long, h long, at int, n int"), "by-suffix")
    many = scratch.write(counted_windows(pieces.filter(F.col("kinds") > MOST_STRETCHES), least), "windows")
    again = scratch.write(many.groupBy("one", "two").agg(F.count(F.lit(1)).alias("count")).filter("count > 1").select("one", "two"), "again")
    by_count = many.join(again, ["one", "two"], "left_semi").select(*KEY, "at", F.lit(1).alias("n"))
    return scratch.write(whole.union(by_suffix).union(by_count), "repeats")


def cut_pieces(rows: DataFrame, least: int) -> DataFrame:
    """The bytes of each asked stretch: seed, doc_id, h, at, times, kinds, text."""
    each = rows.select(*KEY, "text", F.explode("asked").alias("a"))
    return each.select("a.seed", *KEY, "a.at", "a.times", "a.kinds", F.substring("text", F.col("a.at") + 1, F.col("a.n") + (least - 1)).alias("text"))


def sorted_windows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows of stretches ordered by seed; whole seeds share a suffix array of bounded size."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        flags = repeated_windows([r[6] for r in rows], least)
        out = [(r[1], r[2], r[3] + a, n) for r, f in zip(rows, flags, strict=True) if r[4] == 1 for a, n in runs(f)]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], [*KEY, "at", "n"])

    done: list[tuple] = []  # whole seeds
    open_: list[tuple] = []  # the seed being read
    size = 0
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("seed", *KEY, "at", "times", "kinds", "text")), strict=True):
            if open_ and open_[0][0] != r[0]:
                done += open_
                open_ = []
                size = sum(len(x[6]) + 1 for x in done) if not size else size
                if size > MOST_BYTES // 4:
                    yield settle(done)
                    done, size = [], 0
            open_.append(r)
            size += len(r[6]) + 1
    if done or open_:
        yield settle(done + open_)


def counted_windows(pieces: DataFrame, least: int) -> DataFrame:
    """doc_id, h, at, one, two: every window of the pieces with two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, starts, lengths = ragged(batch.column("text").to_pylist())
            n = lengths - (least - 1)
            at, _ = gather(np.arange(len(raw)), starts, n, np.arange(len(n)))
            row = np.repeat(np.arange(len(n)), n)
            size = np.full(len(at), least)
            ids, hs, first = (batch.column(c).to_numpy() for c in (*KEY, "at"))
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(hs[row]), pa.array((first[row] + at - starts[row]).astype(np.int32)), *(pa.array(RangeHash(raw, k)(at, size).view(np.int64)) for k in (23, 24))], [*KEY, "at", "one", "two"])

    return pieces.select("seed", *KEY, "at", "times", "kinds", "text").mapInArrow(run, "doc_id long, h long, at int, one long, two long")


def drop_repeats(docs: DataFrame, least: int = LEAST, k: int = SEED_BYTES, keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with `keep_bytes`, kept: the remaining bytes."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    rows = documents(docs)
    texts = rows.select(F.col("doc_id").alias("id"), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), F.xxhash64("text").alias("h"), F.encode("text", "UTF-8").alias("text"))
    spans = repeats(texts.drop("id"), scratch, least, k).groupBy(*KEY).agg(F.flatten(F.collect_list(F.array("at", "n"))).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for doc_id, text, found in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "spans")), strict=True):
                kept, removed, n_spans = text, 0, 0
                if found:
                    edges = np.zeros(len(text) + 1, np.int64)
                    at, n = np.array(found, np.int64).reshape(-1, 2).T
                    np.add.at(edges, at, 1)
                    np.add.at(edges, at + n + least - 1, -1)
                    gone = np.cumsum(edges[:-1]) > 0
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    removed, n_spans = int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum())
                out.append((doc_id, len(text), removed, n_spans, hashlib.sha256(kept).hexdigest(), *[kept] * keep_bytes))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + keep_bytes]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], types[i]) for i in range(len(names))], names)

    return texts.join(spans, KEY, "left").mapInArrow(run, schema)
