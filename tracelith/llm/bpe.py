"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

Texts are cut into words with array operations; words that the worker hasn't seen are laid into one
flat symbol array and merged together, round by round. A round takes each word's lowest rank and joins
all places of that pair, left to right; ranks of pairs are found by binary search over the sorted pair
keys. Encoded words stay in a bounded table of the worker under a hash; the ids must spell the text
again, or the words are merged anew, so that a collision can't give wrong ids.

Null texts are empty: no ids, an empty decoded text. Repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tracelith.llm.arrays import RangeHash, chunks, gather, ragged
from tracelith.llm.run import documents, small_batches

#: The published word pattern and the byte alphabet of byte-level BPE.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

# Letters and numbers of Unicode versions after 16.0, which the tokenizers' word patterns don't know.
NEWER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x16FF4, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
# Capitals newer than Python's tables, with their small letters.
CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B, **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}}
NEW_CAPITAL = re.compile("[" + "".join(map(chr, CAPITALS)) + "]")

NO_RANK = np.int64(1 << 40)
#: Longer words are merged one by one with a heap: rounds would cost their length squared.
LONG_WORD = 2000
TABLE_ROWS = 1_500_000
CHUNK_CHARS = 1_000_000
SPACE, LETTER, NUMBER, OTHER = range(4)


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte."""
    spare = iter(range(256, 512))
    shown = set(PRINTABLE)
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def char_classes() -> np.ndarray:
    """Of every code point: SPACE, LETTER, NUMBER or OTHER, as the word pattern tells them apart."""
    every = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    out = np.full(len(every), OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    for first, last in NEWER:
        out[first : last + 1] = OTHER
    return out


_classes: list[np.ndarray] = []


def cut_words(texts: list[str], spaces: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes end to end, where each word of WORD_PATTERN starts, its length, and each text's words so far.

    Runs of one class are words; a run takes one space before it; the last of several white spaces
    before a run stands apart; a contraction ends after its letters. Without `spaces` no word holds
    white space, and each number character is a word.
    """
    if not _classes:
        _classes.append(char_classes())
    joined = "".join(texts)
    raw = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
    point = raw if len(raw) == len(joined) else np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(point)
    text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    if not n:
        return raw, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    kind = _classes[0][point]
    fresh = np.zeros(n + 1, bool)  # a text starts here
    fresh[np.r_[0, text_ends]] = True
    change = fresh[:-1] | np.r_[True, kind[1:] != kind[:-1]]
    blank = kind == SPACE
    if spaces:
        joins = np.r_[False, (point == 32)[:-1]] & ~fresh[:-1]  # one space before belongs to the run
        start = change & (blank | ~joins)
        start |= blank & np.r_[~blank[1:], False] & ~fresh[1:]
    else:
        start = change | (kind == NUMBER)
    quotes = np.flatnonzero((point == 39) & start)
    for q in quotes[quotes + 1 < n].tolist():
        tail = joined[q + 1 : q + 3]
        size = 1 if tail[0] in "stmd" else 2 if tail in ("re", "ve", "ll") else 0
        if size and not fresh[q + 1 : q + 1 + size].any():
            start[q + 1] = False
            if q + 1 + size < n and kind[q + 1 + size] == LETTER:
                start[q + 1 + size] = True
    at = np.flatnonzero(start)
    keep = np.ones(len(at), bool) if spaces else ~blank[at]
    word_ends = np.searchsorted(at[keep], text_ends)
    if len(raw) != n:
        wide = np.cumsum(1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000), dtype=np.int64)
        at = np.r_[0, wide][at]
    return raw, at[keep], np.diff(np.r_[at, len(raw)])[keep], word_ends


def lowered(text: str) -> str:
    """Composed and lower-cased letter by letter: a final sigma is no exception."""
    if text.isascii():
        return text.lower()
    low = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
    return low.translate(CAPITALS) if NEW_CAPITAL.search(low) else low


class Codec:
    """Encodes and decodes by a byte-level BPE file in the tokenizers format, without a tokenizer library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        alphabet = byte_alphabet()
        #: With a word-end mark, texts are composed (NFC) and lower-cased, and white space is dropped.
        self.mark = spec["model"].get("end_of_word_suffix") or ""
        self.byte_ids = np.array([vocab[c] for c in alphabet], np.int64)
        self.last_ids = np.array([vocab[c + self.mark] for c in alphabet], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        raw = {c: bytes([b]) for b, c in enumerate(alphabet)}
        tokens = [b""] * self.size
        for t, i in vocab.items():
            if t in self.special:
                continue
            tokens[i] = b"".join(raw[c] for c in (t.removesuffix(self.mark) if self.mark else t))
        for t, i in self.special.items():
            tokens[i] = t.encode()
        self.token_bytes = ragged(tokens)
        self.token_digits = ragged(b"%d," % i for i in range(self.size))
        self.clear()

    def clear(self) -> None:
        """Forgets the encoded words: sorted hashes, and each word's ids in a ragged array."""
        self.known = np.zeros(0, np.uint64)
        self.slots = self.starts = self.lengths = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merge_words(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, whose bytes lie end to end, and each word's number of ids."""
        symbols, owner = self.byte_ids[raw], np.repeat(np.arange(len(lengths)), lengths)
        if self.mark:
            last = np.cumsum(lengths) - 1
            symbols[last] = self.last_ids[raw[last]]
        done_ids, done_owner = [], []
        for w in np.flatnonzero(lengths > LONG_WORD):
            ids = self.merge_long(symbols[owner == w].tolist())
            done_ids.append(np.array(ids, np.int64))
            done_owner.append(np.full(len(ids), w))
        keep = lengths[owner] <= LONG_WORD
        symbols, owner = symbols[keep], owner[keep]
        rank = np.full(len(symbols), NO_RANK)
        rank[:-1] = np.where(owner[:-1] == owner[1:], self.rank(symbols[:-1], symbols[1:]), NO_RANK)
        while len(symbols):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            count = np.diff(np.r_[first, len(owner)])
            best = np.minimum.reduceat(rank, first)
            if (best == NO_RANK).any():
                live = np.repeat(best != NO_RANK, count)
                done_ids.append(symbols[~live])
                done_owner.append(owner[~live])
                symbols, owner, rank = symbols[live], owner[live], rank[live]
                best, count = best[best != NO_RANK], count[best != NO_RANK]
                if not len(symbols):
                    break
            hit = rank == np.repeat(best, count)
            # in a run of the same symbol the places overlap: every second one from the left is joined
            index = np.arange(len(hit))
            begin = hit & ~np.r_[False, hit[:-1]]
            since = index - np.maximum.accumulate(np.where(begin, index, 0))
            hit &= since % 2 == 0
            symbols[hit] = self.merged[rank[hit]]
            keep = ~np.r_[False, hit[:-1]]
            at = (np.cumsum(keep) - 1)[hit]
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            # only the pairs on both sides of a joined symbol have changed
            changed = np.concatenate([at, at[at > 0] - 1])
            right = np.minimum(changed + 1, len(symbols) - 1)
            inside = (right > changed) & (owner[right] == owner[changed])
            rank[changed] = np.where(inside, self.rank(symbols[changed], symbols[right]), NO_RANK)
        if not done_ids:
            return np.zeros(0, np.int64), np.zeros(len(lengths), np.int64)
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(lengths)).astype(np.int64)

    def merge_long(self, symbols: list[int]) -> list[int]:
        """The same merges for one very long word, by a heap of pairs over linked symbols."""
        n = len(symbols)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        pair_rank = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := pair_rank.get(symbols[i] * self.size + symbols[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i], symbols[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else -1
                if left >= 0 and right >= 0 and (r := pair_rank.get(symbols[left] * self.size + symbols[right])) is not None:
                    heapq.heappush(heap, (r, left, symbols[left], symbols[right]))
        return [s for s in symbols if s >= 0]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, and where each text's ids end."""
        if self.specials is None or not any(x in t for x in self.special for t in texts):
            return self.encode_plain(texts)
        pieces = [self.specials.split(t) for t in texts]
        flat = [p for x in pieces for p in x]
        ids, ends = self.encode_plain(["" if p in self.special else p for p in flat])
        parts = np.split(ids, ends[:-1])
        parts = [np.array([self.special[p]], np.int64) if p in self.special else x for p, x in zip(flat, parts, strict=True)]
        ends = np.cumsum([0, *map(len, parts)])
        return np.concatenate(parts), ends[np.cumsum([len(x) for x in pieces])]

    def encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw, starts, lengths, word_ends = cut_words([lowered(t) for t in texts], False) if self.mark else cut_words(texts)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        ids, ends = self.gather_ids(raw, starts, lengths)
        return ids, np.r_[0, ends][word_ends]

    def gather_ids(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes, first, inverse = np.unique(RangeHash(raw)(starts, lengths), return_index=True, return_inverse=True)
        if len(self.known) > TABLE_ROWS:
            self.clear()
        at = np.minimum(np.searchsorted(self.known, hashes), max(0, len(self.known) - 1))
        new = self.known[at] != hashes if len(self.known) else np.ones(len(hashes), bool)
        if new.any():
            spelled, spelled_ends = gather(raw, starts, lengths, first[new])
            ids, counts = self.merge_words(spelled, np.diff(np.r_[0, spelled_ends]))
            self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
            self.starts = np.concatenate([self.starts, len(self.flat) - len(ids) + np.cumsum(counts) - counts])
            self.lengths = np.concatenate([self.lengths, counts])
            slots = len(self.slots) + np.arange(len(counts))
            where = np.searchsorted(self.known, hashes[new])
            self.known, self.slots = np.insert(self.known, where, hashes[new]), np.insert(self.slots, where, slots)
            at = np.searchsorted(self.known, hashes)
        ids, ends = gather(self.flat, self.starts, self.lengths, self.slots[at][inverse])
        ids = ids.astype(np.int64)
        # two words of one hash would show here: the ids must spell the text
        words = gather(raw, starts, lengths, np.arange(len(starts)))[0] if self.mark else raw
        if not np.array_equal(gather(*self.token_bytes, ids)[0], words):
            ids, counts = self.merge_words(words, lengths)
            ends = np.cumsum(counts)
        return ids, ends

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of ids laid end to end; bytes that aren't UTF-8 become U+FFFD."""
        flat, byte_ends = gather(*self.token_bytes, ids)
        raw, at = flat.tobytes(), np.r_[0, byte_ends][np.r_[0, ends]].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]

    def digits(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Each text's ids in decimal, joined by commas."""
        flat, byte_ends = gather(*self.token_digits, ids)
        raw, at = flat.tobytes(), np.r_[0, byte_ends][np.r_[0, ends]].tolist()
        return [raw[a : max(a, b - 1)] for a, b in zip(at, at[1:], strict=False)]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One per worker process and file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_decode(docs: DataFrame, path: str, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with `ids`, the ids themselves and the decoded text.

    A map over the rows: no shuffle, memory bounded by a batch and the word table.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            n, shas, decoded_shas, all_ids, all_texts = [], [], [], [], []
            for texts in chunks(batch.column("text").to_pylist(), len, CHUNK_CHARS):
                flat, ends = c.encode(texts)
                decoded = c.decode(flat, ends)
                n += np.diff(np.r_[0, ends]).tolist()
                shas += [hashlib.sha256(x).hexdigest() for x in c.digits(flat, ends)]
                decoded_shas += [hashlib.sha256(x.encode()).hexdigest() for x in decoded]
                if ids:
                    all_ids += [x.astype(np.int32) for x in np.split(flat, ends[:-1])]
                    all_texts += decoded
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded_shas, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return documents(docs).mapInArrow(run, schema)
