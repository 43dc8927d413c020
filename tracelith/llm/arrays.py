"""Array tools over many texts at once: ragged gathers, hashes of ranges, sliding minima."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

CHUNK_BYTES = 1_000_000
#: bytes.split() cuts at the same six characters.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Powers of one odd number and of its inverse, modulo 2**64, kept up to KEPT of each in a worker.
ODD, KEPT = 0x9E3779B97F4A7C15, 1 << 21
_powers: list[np.ndarray] = []
_tables: dict[int, np.ndarray] = {}


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows `index` of a ragged array, laid end to end, and where each of them ends."""
    n = lengths[index]
    ends = np.cumsum(n)
    at = np.repeat(starts[index] - (ends - n), n)
    at += np.arange(len(at))
    return flat[at], ends


def ragged(rows: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = list(rows)
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.frombuffer(b"".join(rows), np.uint8), np.cumsum(lengths) - lengths, lengths


def chunks(rows: Iterable, size, most: int = CHUNK_BYTES) -> Iterator[list]:
    """Runs of whole rows with a total size of about `most`."""
    out, n = [], 0
    for r in rows:
        out.append(r)
        n += size(r)
        if n >= most:
            yield out
            out, n = [], 0
    if out:
        yield out


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> list[np.ndarray]:
    """n powers of ODD and of its inverse at least."""
    if not _powers or len(_powers[0]) < n:
        both = []
        for k in (ODD, pow(ODD, -1, 1 << 64)):
            x = np.full(max(n, 1 << 16), k, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        if n > KEPT:
            return both
        _powers[:] = both
    return _powers


def byte_values(raw: np.ndarray, seed: int) -> np.ndarray:
    """A random value for each byte; few seeds are in use, so their tables are kept."""
    if seed not in _tables:
        _tables[seed] = np.random.default_rng(seed).integers(1, 1 << 63, 256, np.uint64)
    return _tables[seed][raw]


class RangeHash:
    """64-bit hashes of any ranges of bytes or of 64-bit values, read off one prefix sum. Seeds differ in what symbols are worth."""

    def __init__(self, symbols: np.ndarray, seed: int = 0):
        self.seed = seed
        values = byte_values(symbols, seed) if symbols.dtype == np.uint8 else mix(symbols, seed + 100)
        power, self.back = powers(len(values) + 1)
        self.total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(np.multiply(values, power[: len(values)], out=values), out=self.total[1:])

    def __call__(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = (self.total[starts + lengths] - self.total[starts]) * self.back[starts]
        return mix(out + np.asarray(lengths).astype(np.uint64), self.seed)

    def fixed(self, n: int) -> np.ndarray:
        """Of every range of length n."""
        m = max(0, len(self.total) - n)
        return mix((self.total[n:] - self.total[:m]) * self.back[:m] + np.uint64(n), self.seed)


def word_ranges(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of each word between ASCII blanks, and the words before each of `bounds`; no word crosses a bound."""
    blank = np.ones(len(raw) + 1, bool)
    blank[:-1] = BLANK[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[bounds] = True
    word = ~blank
    first = word.copy()
    first[1:] &= blank[:-1] | cut[1:]
    starts = np.flatnonzero(first)
    last = word[:-1] & (blank[1:] | cut[1:])
    ends = np.flatnonzero(last) + 1
    return starts, ends - starts, np.searchsorted(starts, bounds)


def slide_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w values in a row."""
    if len(x) < w:
        return x[:0]
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def owned_anchors(hashes: np.ndarray, bounds: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of `window` symbols inside a document: the leftmost least hash among its k-grams is its anchor.

    hashes: of the k-gram at each symbol (those that cross a document's end aren't used). bounds: where
    documents start, with the end last. Returns each anchor's place, the first window that it owns
    and how many; an anchor's windows are neighbours, and equal windows have equally placed anchors.
    """
    n = int(bounds[-1])
    shift = max(1, int(n).bit_length())
    mask = np.uint64((1 << shift) - 1)
    key = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
    own = (slide_min(key, window - k + 1) & mask).astype(np.int64)
    lengths = np.diff(bounds)
    doc = np.repeat(np.arange(len(lengths)), np.maximum(0, lengths - window + 1))
    fit = np.maximum(0, lengths - window + 1)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(fit) - fit, fit) + bounds[:-1][doc]
    anchor = own[at]
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]) if len(at) else np.zeros(0, np.int64)
    return anchor[new], at[new], np.diff(np.r_[new, len(at)])
