"""Near-duplicate documents by MinHash: universal hash minima, banding, verification, components.

Documents of one shingle set are one class, represented by its smallest doc_id. Representatives that
share a band meet in a bucket. First each is held against one document, the smallest of the buckets
that it shares most (a star). Components of these links tell which buckets still hold strangers; of
buckets with the same documents one is looked at. There, documents of the commonest component are one
side and the rest the other, cut into blocks of bounded size, and each cell of two blocks compares
signatures; a pair counts in the first of the buckets that it shares alone. Documents with a partner
that agrees bring their texts to the cell, full sets are compared there, and the cell gives back links that tie its components together: a spanning forest
and never all pairs. Components come from alternating large-star and small-star.

Words are runs without ASCII white space with A-Z lower-cased; a set is the distinct 5-word shingles,
the whole sequence if there are fewer words. Null, empty and blank texts have empty sets and stay
alone. Rows that share a doc_id are one document in the links: each has its own n_shingles and the
doc_id's component; equal texts fall together. Rows without a doc_id are linked with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelith.llm.arrays import RangeHash, mix
from tracelith.llm.components import components
from tracelith.llm.run import Scratch, documents, keyed, slices, small_batches
from tracelith.llm.substrings import word_hashes

SHINGLE, BANDS, ROWS = 5, 38, 5
#: A pair at the link threshold agrees in so few of its minima with a chance of about 1e-6 at 0.8, 1e-7 at 0.85.
SIGNATURE_SLACK = 0.14
#: A star's candidate shares so many bands; pairs with fewer are left to the cells.
STAR_BANDS = 4
#: Documents of one block, and shingles that its documents hold together on average; members of one star in a task.
BLOCK, BLOCK_SHINGLES, STAR = 512, 500_000, 256
CELL = ["bucket", "a", "b"]

_rng = np.random.default_rng(8)
FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes in order, end to end, and where the sets start, with the end last."""
    _, _, _, words, bounds = word_hashes([t.lower() for t in texts])
    n = np.diff(bounds)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(texts)), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + bounds[:-1][doc]
    hashes = RangeHash(words, 5)(at, np.minimum(n, size)[doc])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])] if len(doc) else np.zeros(0, bool)
    hashes, doc = hashes[new], doc[new]
    return hashes, np.r_[0, np.cumsum(np.bincount(doc, minlength=len(texts)))]


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The high half of each universal hash's least value over each set; zeros for empty sets."""
    out = np.zeros((len(bounds) - 1, len(FACTORS)), np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for j, (a, b) in enumerate(zip(FACTORS, SHIFTS, strict=True)):
            out[full, j] = np.minimum.reduceat(hashes * a + b, bounds[:-1][full]) >> np.uint64(32)
    return out


def sketches(texts: DataFrame) -> DataFrame:
    """doc_id, n_shingles, one, two (hashes of the whole set), bands, signature (the lowest byte of each minimum)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, bounds = shingle_sets(batch.column("text").to_pylist())
            minima = signatures(hashes, bounds)
            sums = [np.r_[np.uint64(0), np.cumsum(mix(hashes, s))] for s in (11, 12)]
            one, two = (mix(x[bounds[1:]] - x[bounds[:-1]] + np.diff(bounds).astype(np.uint64)) for x in sums)
            bands = np.zeros((batch.num_rows, BANDS), np.uint64)
            for j in range(BANDS):
                acc = np.full(batch.num_rows, j + 1, np.uint64)
                for r in range(ROWS):
                    acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + minima[:, j * ROWS + r], 3)
                bands[:, j] = acc
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                    pa.array(list(bands.view(np.int64)), pa.list_(pa.int64())), pa.array([x.tobytes() for x in minima.astype(np.uint8)], pa.binary()),
                ],
                ["doc_id", "n_shingles", "one", "two", "bands", "signature"],
            )

    return texts.mapInArrow(run, "doc_id long, n_shingles long, one long, two long, bands array<long>, signature binary")


def grouped(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[list[pa.RecordBatch]]:
    """The parts of each group of rows that lie together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in key]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        if held and any(held[-1].column(k)[-1].as_py() != c[0] for k, c in zip(key, columns, strict=True)):
            yield held
            held = []
        cuts = np.flatnonzero(new)
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows], strict=True):
            held.append(batch.slice(int(a), int(b - a)))
            if b < batch.num_rows:
                yield held
                held = []
    if held:
        yield held


def links_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([max(p) for p in pairs], pa.int64()), pa.array([min(p) for p in pairs], pa.int64())], ["u", "v"])


def star_links(asked: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """u, v: the asked pairs u, v whose sets agree. Each u's text moves once; v's goes to each STAR-sized part of its star."""
    cell = ["v", "parts", "part"]
    places = asked.select(F.col("u").alias("doc_id"), *cell, F.lit(1).alias("role")).union(asked.select(F.col("v").alias("doc_id"), *cell, F.lit(0).alias("role")).distinct())
    # one shuffle of the texts for both roles
    rows = texts.join(places.hint("merge"), "doc_id").select(*cell, "role", F.col("doc_id").alias("id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, hub = None, []
        for batch in slices(batches):
            sets, bounds = shingle_sets(batch.column("text").to_pylist())
            keys = zip(*(batch.column(c).to_pylist() for c in (*cell, "role", "id")), strict=True)
            out = []
            for i, (*k, role, doc_id) in enumerate(keys):
                if k != here:
                    here, hub = k, []
                own = sets[bounds[i] : bounds[i + 1]]
                if role == 0:
                    hub.append(own)
                elif any(linked(own, x, percent) for x in hub):
                    out.append((doc_id, k[0]))
            yield links_of(out)

    return rows.repartition(*cell).sortWithinPartitions(*cell, "role").mapInArrow(run, "u long, v long").distinct()


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b):
        return False
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def strangers(live: DataFrame, sketch: DataFrame, found: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """bucket, a, b, side, doc_id, component: documents with a partner of another component in their cell whose signature agrees."""
    member = live.select("bucket", "doc_id", "n_shingles").join(found.withColumnsRenamed({"node": "doc_id"}), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    member = scratch.write(member, "member")
    sizes = member.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"), F.sum(F.xxhash64("doc_id") % (1 << 40)).alias("content"))
    mixed = sizes.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("content").alias("content"), F.max_by(F.struct("component", "n", "w"), F.struct("n", "component")).alias("common"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    one = mixed.groupBy("n", "content").agg(F.min(F.struct("bucket", "w", "common")).alias("one")).select("n", "one.*")
    blocks = lambda n, w: F.ceil(F.greatest(n / BLOCK, w / BLOCK_SHINGLES)).cast("int")
    one = one.select("bucket", blocks(F.col("n"), F.col("w")).alias("na"), blocks(F.col("n") - F.col("common.n"), F.col("w") - F.col("common.w")).alias("nb"), F.col("common.component").alias("common"))
    row = scratch.write(member.join(scratch.write(one, "mixed"), "bucket"), "mixed-rows")
    row = row.join(sketch.select("doc_id", "signature", "bands"), "doc_id")
    mine = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    every = row.select("bucket", mine("na").alias("a"), each("nb").alias("b"), F.lit(0).alias("side"), "doc_id", "component", "signature", "bands")
    rest = row.filter("component <> common").select("bucket", each("na").alias("a"), mine("nb").alias("b"), F.lit(1).alias("side"), "doc_id", "component", "signature", "bands")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in grouped(batches, CELL):
            cell = pa.Table.from_batches(parts).combine_chunks()
            side, component = (cell.column(c).to_numpy() for c in ("side", "component"))
            agree = np.frombuffer(b"".join(cell.column("signature").to_pylist()), np.uint8).reshape(len(side), -1)
            bands, bucket = np.asarray(pc.list_flatten(cell.column("bands"))).reshape(len(side), -1), cell.column("bucket")[0].as_py()
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            keep = np.zeros(len(side), bool)
            for i in right if len(left) else ():
                share = (agree[left] == agree[i]).mean(axis=1)
                hit = left[(share >= percent / 100 - SIGNATURE_SLACK) & (component[left] != component[i])]
                hit = hit[~((bands[hit] == bands[i]) & (bands[i] < bucket)).any(axis=1)]
                keep[hit] = True
                keep[i] = len(hit) > 0
            if keep.any():
                yield from cell.drop_columns(["signature", "bands"]).filter(pa.array(keep)).combine_chunks().to_batches()

    return every.union(rest).repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(run, "bucket long, a int, b int, side int, doc_id long, component long")


def common_sizes(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many hashes each set on the left has in common with each on the right."""
    sets = left + right
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    column, owner = (np.cumsum(times > 1) - 1)[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (first, first + width))
        holds = np.zeros((len(sets), min(width, int(column[-1]) + 1 - first)), np.float32)
        holds[owner[a:b], column[a:b] - first] = 1
        out += holds[: len(left)] @ holds[len(left) :].T
    return out


def forest(ids: tuple[np.ndarray, np.ndarray], component: tuple[np.ndarray, np.ndarray], hit: np.ndarray) -> list[tuple[int, int]]:
    """Of the pairs that hit marks, enough to tie together all components that they tie."""
    i, j = np.nonzero(hit)
    names, at = np.unique(np.concatenate([component[0][i], component[1][j]]), return_inverse=True)
    a, b = at[: len(i)], at[len(i) :]
    _, first = np.unique(a * len(names) + b, return_index=True)
    parent, out = list(range(len(names))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for k, x, y in zip(first.tolist(), a[first].tolist(), b[first].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[y] = x
            out.append((int(ids[0][i[k]]), int(ids[1][j[k]])))
    return out


def cell_links(asked: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """u, v: links between components of each cell, found on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def with_sets() -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                sets, bounds = shingle_sets(batch.column("text").to_pylist())
                packed = pa.array([sets[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())
                yield batch.set_column(batch.schema.get_field_index("text"), "text", packed)

        for parts in grouped(with_sets(), CELL):
            cell = pa.Table.from_batches(parts)
            side, ids, component = (cell.column(c).to_numpy() for c in ("side", "doc_id", "component"))
            sets = [np.frombuffer(x, np.uint64) for x in cell.column("text").to_pylist()]
            both = [np.flatnonzero(side == s) for s in (0, 1)]
            if all(map(len, both)):
                sizes = np.array([len(x) for x in sets], np.float64)
                common = common_sizes(*([sets[i] for i in x] for x in both)).astype(np.float64)
                union = sizes[both[0]][:, None] + sizes[both[1]] - common
                hit = (100 * common >= percent * union) & (common > 0) & (component[both[0]][:, None] != component[both[1]])
                yield links_of(forest((ids[both[0]], ids[both[1]]), (component[both[0]], component[both[1]]), hit))

    rows = texts.join(asked.hint("merge"), "doc_id").select(*CELL, "side", "doc_id", "component", "text")
    return rows.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents linked where 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    texts = documents(docs).select("doc_id", F.encode("text", "UTF-8").alias("text"))
    sketch = scratch.write(sketches(texts), "sketches")
    full = sketch.filter("n_shingles > 0 and doc_id is not null")
    classes = scratch.write(full.groupBy("one", "two").agg(F.min("doc_id").alias("class_id")), "classes")
    members = scratch.write(full.select("doc_id", "one", "two").join(classes, ["one", "two"]).select("doc_id", "class_id").distinct(), "members")
    least = members.filter("doc_id = class_id").select("doc_id")
    first = scratch.write(full.join(least, "doc_id", "left_semi").dropDuplicates(["doc_id", "one", "two"]), "first")
    banded = first.select("doc_id", F.col("n_shingles").cast("int").alias("n_shingles"), F.explode("bands").alias("bucket"))
    hubs = banded.groupBy("bucket").agg(F.min(F.struct("doc_id", "n_shingles")).alias("hub"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("last > hub.doc_id").drop("last")
    live = scratch.write(banded.join(scratch.write(hubs, "hubs"), "bucket").distinct(), "buckets")
    near = (F.least("n_shingles", "hub.n_shingles") * 100 >= F.greatest("n_shingles", "hub.n_shingles") * percent) & (F.col("doc_id") > F.col("hub.doc_id"))
    votes = live.filter(near).groupBy("doc_id", F.col("hub.doc_id").alias("v")).agg(F.count(F.lit(1)).alias("votes"), F.max("n").alias("n")).filter(F.col("votes") >= STAR_BANDS)
    asked = votes.groupBy(F.col("doc_id").alias("u")).agg(F.max_by(F.struct("v", "n"), F.struct("votes", -F.col("v"))).alias("hub")).select("u", "hub.v", F.ceil(F.col("hub.n") / STAR).cast("int").alias("parts"))
    asked = scratch.write(asked.withColumn("part", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int")), "asked")
    links = scratch.write(star_links(asked, texts, percent), "star-links")
    found = components(links, scratch, "stars")
    met = scratch.write(strangers(live, first, found, percent, scratch), "strangers")
    # rows of one doc_id with different sets tie their classes
    several = members.groupBy("doc_id").agg(F.min("class_id").alias("v"), F.max("class_id").alias("w")).filter("w > v").select(F.col("doc_id").alias("u"))
    tied = members.filter("doc_id <> class_id").select(F.col("doc_id").alias("u"), F.col("class_id").alias("v")).join(several, "u", "left_semi")
    links = links.union(cell_links(met, texts, percent)).union(tied)
    found = components(scratch.write(links, "links"), scratch).select(F.col("node").alias("class_id"), F.col("component"))
    own = members.join(found, "class_id", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "class_id")).alias("component_id"))
    out = sketch.select("doc_id", "n_shingles").join(own, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, without near-duplicates: of each component the row with the smallest doc_id stays.

    A document is a doc_id with a text: rows equal in both are one, rows that share a doc_id fall together
    only where their texts are equal or linked, and rows without a doc_id are documents of their own, after
    all others; of these, blank ones all stay. Columns may have any type and any name.
    """
    lone = (F.col("doc_id") == (1 << 63) - 1) & F.col("row.doc_id").isNull() & ~F.decode("text", "UTF-8").rlike(r"[^ \t\n\x0b\f\r]")
    rows = keyed(docs).withColumn("key", F.xxhash64("row.doc_id", F.col("row.doc_id").isNull(), "text"))
    told = rows.filter(~lone)
    scratch = Scratch(docs.sparkSession)
    found = near_duplicates(told.select(F.col("key").alias("doc_id"), F.decode("text", "UTF-8").alias("text")), percent).select(F.col("doc_id").alias("key"), "component_id").distinct()
    ids = told.select("key", F.struct("doc_id", "h", "key").alias("place")).distinct()
    keep = scratch.write(ids.join(found, "key").groupBy("component_id").agg(F.min("place").getField("key").alias("key")).select("key"), "keep")
    # of rows equal in doc_id and text the one whose other columns hash least stays
    kept = told.join(keep, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.struct(F.xxhash64(F.to_json("row")))).alias("row")).select("row")
    return kept.unionAll(rows.filter(lone).select("row")).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
