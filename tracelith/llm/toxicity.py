"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word goes in as a learned vector of its hash bucket (word input) and the mean and maximum of the
learned vectors of its character 3- to 5-grams (character input); the first component of each starts as
the log-odds of the bucket in the labelled sample. The network reads all overlapping windows of WINDOW
words, one from each word on, over the whole text; attention pools the states of both directions. A
document is as toxic as its most toxic window; training takes each document's most toxic window under
the model so far, and a random one of the clean documents.

The sample is bounded (TOXIC and CLEAN documents, by a hash of doc_id) and learnt from in one task; every
text is scored. Labels, lang, source and doc_id are no inputs. Null, empty and blank texts score 0.
Repeated rows are scored alike. Labels other than 0 and 1 and labels without a document aren't used;
a sample without both labels gives the score 0 for all.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelith.llm.arrays import RangeHash, gather, mix, ragged, word_ranges
from tracelith.llm.run import documents, mapped, slices, small_batches

WINDOW, STRIDE = 16, 1
TOXIC, CLEAN = 700, 1600
BUCKETS, WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 1 << 16, 6, 6, 8, 8
INPUT = WORD_DIM + 2 * CHAR_DIM
GRAMS = (3, 4, 5)
ROUNDS, PASSES, BATCH, RATE = 3, 3, 192, 0.015
BLOCK = 4096
#: Log-odds of buckets that few texts hold shrink: they tell the sample's texts apart, not toxic from clean.
RARE = 8
#: Letters of scripts beyond ASCII count as they are; ASCII is lower-cased and its marks are no part of a word.
MARK = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def squash(x: np.ndarray) -> np.ndarray:
    """Softsign, the network's bounded function: it takes an eighth of the time of tanh. Gates are half of one plus it."""
    return x / (1 + np.abs(x))


def gate(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * squash(x)


def slope(y: np.ndarray) -> np.ndarray:
    """Of squash, where it is y; of a gate it is half of this, at twice the gate less one."""
    return (1 - np.abs(y)) ** 2


@dataclass
class Text:
    """Distinct words of some texts, the words of each text, and the buckets of each distinct word and its n-grams."""

    words: np.ndarray
    bounds: np.ndarray
    buckets: np.ndarray
    grams: np.ndarray  # word by word
    gram_starts: np.ndarray  # where each word's n-grams start, with the end last; no word is without


def read(texts: list[bytes]) -> Text:
    raw, starts, _ = ragged(t.lower() for t in texts)
    raw = np.where(MARK[raw], np.uint8(32), raw)
    at, n, bounds = word_ranges(raw, np.r_[starts, len(raw)])
    hashes, first, words = np.unique(RangeHash(raw, 6)(at, n), return_index=True, return_inverse=True)
    # distinct words with a mark on both sides
    spelled, ends = gather(raw, at, n, first)
    size = n[first] + 2
    flat = np.full(int(size.sum()), 32, np.uint8)
    inner = np.ones(len(flat), bool)
    begin = np.cumsum(size) - size
    inner[begin] = False
    inner[begin + size - 1] = False
    flat[inner] = spelled
    owner = np.repeat(np.arange(len(size)), size)
    bucket = lambda h: (mix(h, 9) % np.uint64(BUCKETS)).astype(np.int32)
    grams, gram_words = [], []
    for g in GRAMS:
        whole = RangeHash(flat, 7).fixed(g)
        ok = owner[: len(whole)] == owner[g - 1 :][: len(whole)] if len(whole) else np.zeros(0, bool)
        grams.append(bucket(whole[ok]))
        gram_words.append(owner[: len(whole)][ok].astype(np.int32))
    g, w = np.concatenate(grams), np.concatenate(gram_words)
    order = np.argsort(w, kind="stable")
    return Text(words.astype(np.int32), bounds, bucket(hashes), g[order], np.searchsorted(w[order], np.arange(len(hashes) + 1)))


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and text of every window; one from each word that WINDOW words follow on."""
    n = np.diff(bounds)
    count = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1), 0)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = bounds[:-1][text] + k * STRIDE
    return start, np.minimum(WINDOW, bounds[1:][text] - start), text


class Network:
    def __init__(self, seed: int = 2):
        r = np.random.default_rng(seed)
        init = lambda *shape: (r.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)
        self.word = (r.normal(0, 0.05, (BUCKETS, WORD_DIM))).astype(np.float32)
        self.char = (r.normal(0, 0.05, (BUCKETS, CHAR_DIM))).astype(np.float32)
        self.p = {"A": init(2 * HIDDEN, ATTENTION), "v": init(ATTENTION), "o": init(2 * HIDDEN + INPUT), "c": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": init(INPUT, 3 * HIDDEN), f"U{d}": init(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.shift = 0.0

    def spelled(self, t: Text, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct words: their n-grams end to end, those of each word, their vectors, and the words' character input."""
        count = np.diff(t.gram_starts)
        grams, ends = gather(t.grams, t.gram_starts[:-1], count, words)
        values, begin = self.char[grams], ends - count[words]
        if not len(words):
            return grams, count[words], values, np.zeros((0, 2 * CHAR_DIM), np.float32)
        return grams, count[words], values, np.concatenate([np.add.reduceat(values, begin) / count[words][:, None], np.maximum.reduceat(values, begin)], 1).astype(np.float32)

    def inputs(self, t: Text, size: int = 20_000) -> np.ndarray:
        """A vector for each distinct word."""
        parts = [self.spelled(t, np.arange(i, min(i + size, len(t.buckets))))[3] for i in range(0, len(t.buckets), size)]
        return np.concatenate([self.word[t.buckets], np.concatenate(parts) if parts else np.zeros((0, 2 * CHAR_DIM), np.float32)], 1)

    def learn_grams(self, spelled: tuple, slope: np.ndarray) -> None:
        """Carries the slope of words' character input to their n-grams: an equal part of the mean's, and all of the maximum's to where it stands."""
        grams, count, values, char = spelled
        word = np.repeat(np.arange(len(count)), count)
        top = values == char[word, CHAR_DIM:]
        np.subtract.at(self.char, grams, (slope[:, :CHAR_DIM] / count[:, None])[word] + top * slope[word, CHAR_DIM:])

    def forward(self, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, dict]:
        """Logits of windows, x (windows, WINDOW, INPUT) with n words each, and what the gradients need."""
        p, size, steps = self.p, len(x), x.shape[1]
        states = np.zeros((size, steps, 2 * HIDDEN), np.float32)
        saved: dict = {}
        for j, d in enumerate("fb"):
            xw = x @ p[f"W{d}"] + p[f"b{d}"]
            h = np.zeros((size, HIDDEN), np.float32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                on = (t < n)[:, None]
                hu = h @ p[f"U{d}"]
                zr = gate(xw[:, t, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = squash(xw[:, t, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
                saved[d, t] = (h, z, r, c, hu[:, 2 * HIDDEN :], on)
                h = np.where(on, (1 - z) * c + z * h, h)
                states[:, t, j * HIDDEN : (j + 1) * HIDDEN] = h
        u = squash(states @ p["A"])
        e = np.where(np.arange(steps) < n[:, None], u @ p["v"], -1e9)
        a = np.exp(e - e.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
        both = np.concatenate([states, x], 2)
        pooled = np.einsum("bt,bth->bh", a, both)
        return pooled @ p["o"] + p["c"][0], saved | {"u": u, "a": a, "both": both, "pooled": pooled, "x": x}

    def gates(self, x: np.ndarray) -> list[np.ndarray]:
        """What each distinct word adds to the gates, forward and backward."""
        return [x @ self.p[f"W{d}"] + self.p[f"b{d}"] for d in "fb"]

    def evaluate(self, gates: list[np.ndarray], plain: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Logits of the whole windows that start at each word but the last WINDOW - 1. Neighbouring windows read the same gate inputs, one place on."""
        p, k, size = self.p, HIDDEN, len(words) - WINDOW + 1
        u = {d: np.ascontiguousarray(p[f"U{d}"].T) for d in "fb"}
        g = {d: np.ascontiguousarray(x[words].T) for d, x in zip("fb", gates, strict=True)}
        value = plain[words]
        a, o = np.ascontiguousarray(p["A"].T), p["o"]

        def step(d: str, t: int, h: np.ndarray) -> np.ndarray:
            uh, x = u[d] @ h, g[d][:, t : t + size]
            zr, c = uh[: 2 * k], uh[2 * k :]
            zr += x[: 2 * k]
            zr /= 1 + np.abs(zr)
            zr *= 0.5
            zr += 0.5
            c *= zr[k:]
            c += x[2 * k :]
            c /= 1 + np.abs(c)
            new = h - c
            new *= zr[:k]
            new += c
            return new

        ahead, h = [], np.zeros((k, size), np.float32)
        for t in range(WINDOW):
            h = step("f", t, h)
            ahead.append(h)
        h, above, below = np.zeros((k, size), np.float32), np.zeros(size, np.float32), np.zeros(size, np.float32)
        for t in reversed(range(WINDOW)):
            h = step("b", t, h)
            both = np.concatenate([ahead[t], h])
            weight = np.exp(np.minimum(p["v"] @ squash(a @ both), 60))
            above += weight * (o[: 2 * k] @ both + value[t : t + size])
            below += weight
        return above / below + p["c"][0]

    def gradients(self, g: np.ndarray, s: dict) -> tuple[dict, np.ndarray]:
        """Of the parameters and of x, given the gradient of each logit."""
        p, x, steps = self.p, s["x"], s["x"].shape[1]
        out = {k: np.zeros_like(v) for k, v in p.items()}
        out["o"], out["c"][0] = s["pooled"].T @ g, g.sum()
        dpooled = g[:, None] * p["o"]
        dboth = s["a"][:, :, None] * dpooled[:, None, :]
        da = np.einsum("bth,bh->bt", s["both"], dpooled)
        de = s["a"] * (da - (s["a"] * da).sum(1, keepdims=True))
        out["v"] = np.einsum("bt,btk->k", de, s["u"])
        du = de[:, :, None] * p["v"] * slope(s["u"])
        states = s["both"][:, :, : 2 * HIDDEN]
        out["A"] = np.einsum("bth,btk->hk", states, du)
        dstates = dboth[:, :, : 2 * HIDDEN] + du @ p["A"].T
        dx = dboth[:, :, 2 * HIDDEN :].copy()
        for j, d in enumerate("fb"):
            W, U = p[f"W{d}"], p[f"U{d}"]
            dh = np.zeros((len(x), HIDDEN), np.float32)
            for t in reversed(range(steps)) if d == "f" else range(steps):
                h, z, r, c, hun, on = s[d, t]
                dh = dh + dstates[:, t, j * HIDDEN : (j + 1) * HIDDEN]
                live = np.where(on, dh, 0)
                dc = live * (1 - z) * slope(c)
                dz = live * (h - c) * slope(2 * z - 1) / 2
                dr = dc * hun * slope(2 * r - 1) / 2
                dg = np.concatenate([dz, dr, dc], 1)
                dhu = np.concatenate([dz, dr, dc * r], 1)
                out[f"U{d}"] += h.T @ dhu
                out[f"W{d}"] += x[:, t].T @ dg
                out[f"b{d}"] += dg.sum(0)
                dx[:, t] += dg @ W.T
                dh = np.where(on, live * z, dh) + dhu @ U.T
        return out, dx

    def logits(self, t: Text, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every window, with its first word, number of words and text. Texts shorter than a window go through the training pass, which masks."""
        start, n, text = windows(t.bounds)
        x, out = self.inputs(t), np.zeros(len(start), np.float32)
        gates, plain = self.gates(x), x @ self.p["o"][2 * HIDDEN :]
        whole, short = np.flatnonzero(n == WINDOW), np.flatnonzero(n != WINDOW)
        # windows across two texts are computed along and left out
        for i in range(0, len(t.words) - WINDOW + 1, size):
            a, b = np.searchsorted(start[whole], (i, i + size))
            if b > a:
                part = whole[a:b]
                out[part] = self.evaluate(gates, plain, t.words[i : i + size + WINDOW - 1])[start[part] - i]
        for i in range(0, len(short), size):
            part = short[i : i + size]
            out[part] = self.forward(x[t.words[np.minimum(start[part, None] + np.arange(WINDOW), len(t.words) - 1)]], n[part])[0]
        return out, start, n, text

    def scores(self, t: Text) -> np.ndarray:
        logits, _, _, text = self.logits(t)
        out = np.full(len(t.bounds) - 1, -np.inf)
        np.maximum.at(out, text, logits)
        return np.where(np.isinf(out), 0.0, sigmoid(np.where(np.isinf(out), 0.0, out) - self.shift))


class Odds:
    """Log-odds of buckets: how much likelier a toxic text holds one. Texts are counted some at a time."""

    def __init__(self, toxic: np.ndarray):
        self.toxic, self.counts = toxic, np.zeros((2, BUCKETS))

    def add(self, buckets: np.ndarray, text: np.ndarray) -> None:
        """Buckets that the texts hold; a text's come all at once."""
        pairs = np.unique(buckets.astype(np.int64) * len(self.toxic) + text)
        label = self.toxic[pairs % len(self.toxic)]
        for y in (0, 1):
            self.counts[y] += np.bincount(pairs[label == bool(y)] // len(self.toxic), minlength=BUCKETS)

    def values(self) -> np.ndarray:
        (in0, in1), a, b = self.counts, self.toxic.sum(), (~self.toxic).sum()
        odds = np.log((in1 + 0.5) / (a + 1)) - np.log((in0 + 0.5) / (b + 1))
        return odds * (in1 + in0) / (in1 + in0 + RARE)


def train(texts: list[bytes], toxic: np.ndarray, seed: int = 2) -> Network:
    net, r, t = Network(seed), np.random.default_rng(seed), read(texts)
    words, grams = Odds(toxic), Odds(toxic)
    for i in range(0, len(texts), 32):
        at = np.arange(t.bounds[i], t.bounds[min(i + 32, len(texts))])
        text = np.searchsorted(t.bounds, at, "right") - 1
        words.add(t.buckets[t.words[at]], text)
        found, ends = gather(t.grams, t.gram_starts[:-1], np.diff(t.gram_starts), t.words[at])
        grams.add(found, np.repeat(text, np.diff(np.r_[0, ends])))
    net.word[:, 0], net.char[:, 0] = words.values() / 4, grams.values() / 4
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    seen = 0
    weight = np.where(toxic, len(toxic) / (2 * toxic.sum()), len(toxic) / (2 * (~toxic).sum()))
    for _ in range(ROUNDS):
        logits, start, n, text = net.logits(t)
        best = np.lexsort((logits, text))
        best = best[np.r_[text[best][1:] != text[best][:-1], True]]
        other = np.flatnonzero(~toxic[text])
        chosen = np.concatenate([best, r.permutation(other)[: len(best)]])
        for _ in range(PASSES):
            r.shuffle(chosen)
            for i in range(0, len(chosen), BATCH):
                c = chosen[i : i + BATCH]
                used, words = np.unique(t.words[np.minimum(start[c, None] + np.arange(WINDOW), len(t.words) - 1)], return_inverse=True)
                words = words.reshape(len(c), WINDOW)
                spelled = net.spelled(t, used)
                out, saved = net.forward(np.concatenate([net.word[t.buckets[used]], spelled[3]], 1)[words], n[c])
                g = ((sigmoid(out) - toxic[text[c]]) * weight[text[c]] / len(c)).astype(np.float32)
                grads, dx = net.gradients(g, saved)
                seen += 1
                for k, v in grads.items():
                    m = moments[k]
                    m[0] += 0.1 * (v - m[0])
                    m[1] += 0.001 * (v * v - m[1])
                    net.p[k] -= RATE * (m[0] / (1 - 0.9**seen)) / (np.sqrt(m[1] / (1 - 0.999**seen)) + 1e-8)
                on = np.arange(WINDOW) < n[c][:, None]
                change = np.zeros((len(used), INPUT), np.float32)
                np.add.at(change, words[on], 0.5 * dx[on])
                np.subtract.at(net.word, t.buckets[used], change[:, :WORD_DIM])
                net.learn_grams(spelled, change[:, WORD_DIM:])
    # the decision threshold that errs least on the sample becomes 0.5
    logits, _, _, text = net.logits(t)
    best = np.full(len(texts), -30.0)
    np.maximum.at(best, text, logits)
    order = np.argsort(-best, kind="stable")
    wrong = np.cumsum(np.where(toxic[order], -1, 1))
    at = int(np.argmin(wrong))
    net.shift = float((best[order[at]] + best[order[min(at + 1, len(order) - 1)]]) / 2)
    return net


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> Network | None:
    """Trains on labelled documents that aren't held out, `toxic` and `clean` of them at most, in one task; the network comes back."""
    label = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null").filter(~held_out(F.col("doc_id")))
    label = label.groupBy("doc_id").agg(F.max("label").alias("label"))
    order = F.xxhash64("doc_id")
    picked = label.filter("label = 1").orderBy(order, "doc_id").limit(toxic).union(label.filter("label = 0").orderBy(order, "doc_id").limit(clean))
    sample = documents(docs).join(F.broadcast(picked), "doc_id").filter("length(text) > 0").select("doc_id", "label", "text").repartition(1)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted({r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)})
        marks = np.array([r[1] == 1 for r in rows], bool)
        if marks.any() and not marks.all():
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([r[2].encode() for r in rows], marks))], pa.binary())], ["net"])

    found = sample.mapInArrow(fit, "net binary").collect()
    return pickle.loads(found[0].net) if found else None


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, score, predicted for every row: a map, the network goes along with the tasks."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = shared.value.scores(read([t.encode() for t in batch.column("text").to_pylist()])) if shared.value else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return documents(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose texts score under 0.5."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = shared.value.scores(read([(t or "").encode() for t in batch.column("text").to_pylist()])) < 0.5 if shared.value else np.ones(batch.num_rows, bool)
            yield batch.filter(pa.array(keep))

    return mapped(docs, run)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
