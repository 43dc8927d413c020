"""Substring dedup by seed and extend, over words.

Every window of `window` words has an anchor, the leftmost of its k-word stretches with the least
hash; equal windows have equally placed anchors. An anchor and the windows that it owns are found
where the text is, without its neighbours. Documents meet on anchors (seeds). Occurrences of a seed
whose whole surroundings agree (all that the owned windows cover) form a class, settled by its first
occurrence. First occurrences of different classes are extended: each is compared word by word, to
the left and to the right, with the first occurrence of the seed; where the maximal repeat has
`window` words or more, its windows are settled. Windows that this leaves can only equal each other,
in classes that differ from the first one alike; they are counted by two hashes.
No occurrence is held against all others, so a seed with many occurrences makes no pairs of them.

Words are runs without ASCII white space, unchanged. Null and empty texts have none. Repeated rows
are one document: equal windows at the same place aren't earlier than each other. Rows that share a
doc_id but not the text are documents of their own, ordered by a hash of the text, and rows without a
doc_id come after all others. Columns besides doc_id and text play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tracelith.llm.arrays import RangeHash, gather, mix, owned_anchors, ragged, word_ranges
from tracelith.llm.run import Scratch, keyed, slices, small_batches

WINDOW, SEED_WORDS = 20, 8
KEY = ["doc_id", "h"]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, each word's start, length and hash, and the words before each text, with all words last."""
    raw, text_starts, _ = ragged(texts)
    starts, lengths, bounds = word_ranges(raw, np.r_[text_starts, len(raw)])
    return raw, starts, lengths, RangeHash(raw)(starts, lengths), bounds


def made(columns: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    """A batch of columns; unsigned values go as signed ones."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, list(columns))


def seeds(docs: DataFrame, window: int, k: int) -> DataFrame:
    """One row for each seed: seed, stretch (a hash of all that its windows cover), doc_id, h, at (its first window), n (windows), off (words from there to the seed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            _, _, _, words, bounds = word_hashes(batch.column("text").to_pylist())
            grams = RangeHash(words, 1)
            place, first, n = owned_anchors(grams.fixed(k), bounds, k, window)
            stretch = RangeHash(words, 2)(first, n + window - 1) + (place - first).astype(np.uint64)
            doc = np.searchsorted(bounds, first, "right") - 1
            ids, h = (batch.column(c).to_numpy()[doc] for c in KEY)
            yield made({"seed": grams(place, np.full(len(place), k)), "stretch": stretch, "doc_id": ids, "h": h, "at": (first - bounds[doc]).astype(np.int32), "n": n.astype(np.int32), "off": (place - first).astype(np.int32)})

    return docs.mapInArrow(run, "seed long, stretch long, doc_id long, h long, at int, n int, off int")


def surroundings(docs: DataFrame, window: int, k: int) -> DataFrame:
    """Of each asked seed of docs (doc_id, h, text, asked): seed, pivot, doc_id, h, at, n, off and the hashes of the words beside it, left (outwards) and right, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            _, _, _, words, bounds = word_hashes(batch.column("text").to_pylist())
            asked = batch.column("asked")
            row = pc.list_parent_indices(asked).to_numpy()
            seed, pivot, at, n, off = (pc.struct_field(pc.list_flatten(asked), c).to_numpy(zero_copy_only=False) for c in ("seed", "pivot", "at", "n", "off"))
            place = bounds[row] + at + off
            left, left_ends = gather(words[::-1], len(words) - place, off.astype(np.int64), np.arange(len(row)))
            right, right_ends = gather(words, place + k, (n + window - 1 - off - k).astype(np.int64), np.arange(len(row)))
            cut = lambda flat, ends: pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends * 8].astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
            ids, h = (batch.column(c).to_numpy()[row] for c in KEY)
            yield made({"seed": seed, "pivot": pivot, "doc_id": ids, "h": h, "at": at, "n": n, "off": off, "left": cut(left, left_ends), "right": cut(right, right_ends)})

    return docs.mapInArrow(run, "seed long, pivot boolean, doc_id long, h long, at int, n int, off int, left binary, right binary")


def agreement(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """How many words from the front each two sides have in common."""
    (x, x_at, x_n), (y, y_at, y_n) = (ragged(s) for s in (a, b))
    x, y = x.view(np.uint64), y.view(np.uint64)
    out, n = np.zeros(len(a), np.int64), np.minimum(x_n, y_n) // 8
    live = np.flatnonzero(n > 0)
    while len(live):
        live = live[x[x_at[live] // 8 + out[live]] == y[y_at[live] // 8 + out[live]]]
        out[live] += 1
        live = live[out[live] < n[live]]
    return out


def extended(batches: Iterator[pa.RecordBatch], window: int, k: int) -> Iterator[pa.RecordBatch]:
    """Extends each seed against its pivot: doc_id, h, at, n of windows inside a maximal repeat of `window` words, and those left, one by one, with hashes one and two."""
    for batch in slices(batches, "left"):
        left, right = (batch.column(c).to_pylist() for c in ("left", "right"))
        lefts, rights = (agreement(a, batch.column(c).to_pylist()) for a, c in ((left, "pivot_left"), (right, "pivot_right")))
        ids, h, at, n, off, seed = (batch.column(c).to_numpy() for c in (*KEY, "at", "n", "off", "seed"))
        # a window is known by the words that it has left of its seed, off-n+1 .. off
        low, high = np.maximum(window - k - rights, off - n + 1), np.minimum(lefts, off)
        some = high >= low
        yield made({"doc_id": ids[some], "h": h[some], "at": (at + off - high)[some].astype(np.int32), "n": (high - low + 1)[some].astype(np.int32), "one": np.zeros(some.sum(), np.int64), "two": np.zeros(some.sum(), np.int64)})
        row = np.repeat(np.arange(len(n)), n)
        here = (off[row] - (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))).astype(np.int64)
        rest = ~(some[row] & (here >= low[row]) & (here <= high[row]))
        row, here = row[rest], here[rest]
        sides = [(flat.view(np.uint64), starts // 8) for flat, starts, _ in (ragged(left), ragged(right))]
        hashes = []
        for s in (3, 4):
            l, r = (RangeHash(flat, s)(starts[row], size) for (flat, starts), size in zip(sides, (here, window - k - here), strict=True))
            hashes.append(mix(mix(l, s) + mix(r, s + 1) + mix(seed.view(np.uint64)[row] + here.astype(np.uint64), s + 2)))
        yield made({"doc_id": ids[row], "h": h[row], "at": (at[row] + off[row] - here).astype(np.int32), "n": np.ones(len(row), np.int32), "one": hashes[0] | np.uint64(1), "two": hashes[1]})


def repeats(docs: DataFrame, scratch: Scratch, window: int = WINDOW, k: int = SEED_WORDS) -> DataFrame:
    """doc_id, h, at, n: windows at .. at+n-1 of the document start earlier elsewhere. docs: doc_id, h and text as bytes."""
    here = F.struct(*KEY, "at")
    found = seeds(docs, window, k)
    # tables that hot seeds are joined with are written first: Spark then splits the hot side
    shared = scratch.write(found.groupBy("seed").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("seed"), "shared")
    live = scratch.write(found.join(shared, "seed", "left_semi"), "seeds")
    classes = live.groupBy("seed", "stretch").agg(F.min(F.struct(*KEY, "at", "n", "off")).alias("first"), F.max(here).alias("last"), F.count(F.lit(1)).alias("times"))
    classes = scratch.write(classes, "classes")
    again = scratch.write(classes.filter((F.col("times") > 1) & (F.col("last") > F.struct(*(F.col("first")[c].alias(c) for c in (*KEY, "at"))))).select("seed", "stretch", F.struct(*(F.col("first")[c].alias(c) for c in (*KEY, "at"))).alias("first")), "again")
    later = live.join(again, ["seed", "stretch"]).filter(here > F.col("first")).select(*KEY, "at", "n")
    several = scratch.write(classes.groupBy("seed").agg(F.min("first").alias("pivot"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").drop("kinds"), "several")
    edge = classes.join(several, "seed").select("seed", (F.col("first") == F.col("pivot")).alias("pivot"), "first.*")
    asked = edge.groupBy(*KEY).agg(F.collect_list(F.struct("seed", "pivot", "at", "n", "off")).alias("asked"))
    beside = scratch.write(surroundings(docs.dropDuplicates(KEY).join(asked, KEY), window, k), "beside")
    pivots = scratch.write(beside.filter("pivot").select("seed", F.col("left").alias("pivot_left"), F.col("right").alias("pivot_right")), "pivots")
    told = beside.filter("not pivot").drop("pivot").join(pivots, "seed").mapInArrow(lambda b: extended(b, window, k), "doc_id long, h long, at int, n int, one long, two long")
    told = scratch.write(told, "extended")
    rest = told.filter("one <> 0")
    earliest = scratch.write(rest.groupBy("one", "two").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times"), "earliest")
    rest = rest.join(earliest, ["one", "two"]).filter(here > F.col("first"))
    return scratch.write(later.union(told.filter("one = 0").select(*KEY, "at", "n")).union(rest.select(*KEY, "at", "n")), "repeats")


def drop_repeats(docs: DataFrame, window: int = WINDOW, keep_text: bool = True, keep_row: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with `keep_text`, kept_text: the words not covered by repeated windows, joined by single spaces.

    keep_row: `row`, a struct of all columns of docs, goes along.
    """
    small_batches(docs.sparkSession)
    scratch, rows = Scratch(docs.sparkSession), keyed(docs)
    found = repeats(rows.drop("row"), scratch, window)
    spans = scratch.write(found.groupBy(*KEY).agg(F.flatten(F.collect_list(F.array("at", "n"))).alias("spans")), "spans")
    fields = [("doc_id", LongType(), pa.int64()), ("n_words", LongType(), pa.int64()), ("n_removed", LongType(), pa.int64()), ("kept_sha256", StringType(), pa.string()), ("kept_text", StringType(), pa.string())][: 4 + keep_text]
    schema = StructType([StructField(n, t) for n, t, _ in fields] + [StructField("row", docs.schema)] * keep_row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "row" if keep_row else "text"):
            out = []
            texts = [(t or "").encode() for t in pc.struct_field(batch.column("row"), "text").cast(pa.string()).to_pylist()] if keep_row else batch.column("text").to_pylist()
            for doc_id, text, spans in zip(batch.column("id").to_pylist(), texts, batch.column("spans").to_pylist(), strict=True):
                words = text.split()
                kept = words
                if spans:
                    edges = np.zeros(len(words) + 1, np.int64)
                    at, n = np.array(spans, np.int64).reshape(-1, 2).T
                    np.add.at(edges, at, 1)
                    np.add.at(edges, at + n + window - 1, -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
                joined = b" ".join(kept)
                out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), *[joined.decode()] * keep_text))
            columns = [pa.array([r[i] for r in out], t) for i, (_, _, t) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*columns, *([batch.column("row")] if keep_row else [])], [*(n for n, _, _ in fields), *["row"] * keep_row])

    body = ["row"] if keep_row else ["text"]
    return rows.select(*KEY, F.col("row.doc_id").cast("long").alias("id"), *body).join(spans, KEY, "left").select("id", *body, "spans").mapInArrow(run, schema)
