"""Spark's xxhash64 in numpy: one key under many seeds at once, where a column function would make a row for each."""

from __future__ import annotations

import numpy as np

P1, P2, P3, P4, P5 = (np.array(p, np.uint64) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
ONE_52 = np.array((1 << 52) - 1, np.uint64)


def turn(h: np.ndarray, by: int, spare: np.ndarray) -> np.ndarray:
    """Rotates h in place."""
    np.right_shift(h, np.uint64(64 - by), out=spare)
    h <<= np.uint64(by)
    h |= spare
    return h


def finish(h: np.ndarray, spare: np.ndarray) -> np.ndarray:
    for by, p in ((33, P2), (29, P3), (32, None)):
        np.right_shift(h, np.uint64(by), out=spare)
        h ^= spare
        if p is not None:
            h *= p
    return h


def of_ints(values: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Hashes of 32-bit whole numbers, each under its seed; the two are broadcast."""
    h = (seeds + (P5 + np.uint64(4))) ^ ((values.astype(np.int64) & 0xFFFFFFFF).astype(np.uint64) * P1)
    spare = np.empty_like(h)
    turn(h, 23, spare)
    h *= P2
    h += P3
    return finish(h, spare)


def of_texts(texts: list[bytes], seeds: np.ndarray) -> np.ndarray:
    """A row for each seed, a column for each text."""
    sizes = np.array([len(t) for t in texts])
    known = np.unique(sizes)
    if len(known) == 1:
        return of_one_size(texts, seeds)
    out = np.empty((len(seeds), len(texts)), np.uint64)
    for n in known:
        at = np.flatnonzero(sizes == n)
        out[:, at] = of_one_size([texts[i] for i in at], seeds)
    return out


def of_one_size(texts: list[bytes], seeds: np.ndarray) -> np.ndarray:
    n = len(texts[0])
    raw = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), n)
    words = np.ascontiguousarray(raw[:, : n // 8 * 8]).view("<u8").reshape(len(texts), n // 8)
    start, at = seeds.astype(np.uint64)[:, None], 0
    h, spare = np.empty((len(seeds), len(texts)), np.uint64), np.empty((len(seeds), len(texts)), np.uint64)
    if n >= 32:
        lanes = [np.broadcast_to(start + p, h.shape).copy() for p in (P1 + P2, P2, np.zeros(1, np.uint64), np.zeros(1, np.uint64) - P1)]
        while at + 4 <= n // 8:
            for i, v in enumerate(lanes):
                v += words[:, at + i] * P2
                turn(v, 31, spare)
                v *= P1
            at += 4
        h[...] = 0
        for v, by in zip(lanes, (1, 7, 12, 18), strict=True):
            h += turn(v.copy(), by, spare)
        for v in lanes:
            v *= P2
            turn(v, 31, spare)
            v *= P1
            h ^= v
            h *= P1
            h += P4
        h += np.uint64(n)
    else:
        h[...] = start + (P5 + np.uint64(n))
    for i in range(at, n // 8):
        k = words[:, i] * P2
        h ^= turn(k, 31, np.empty_like(k)) * P1
        turn(h, 27, spare)
        h *= P1
        h += P4
    at = n // 8 * 8
    if at + 4 <= n:
        h ^= np.ascontiguousarray(raw[:, at : at + 4]).view("<u4").reshape(-1).astype(np.uint64) * P1
        turn(h, 23, spare)
        h *= P2
        h += P3
        at += 4
    for i in range(at, n):
        h ^= raw[:, i].astype(np.uint64) * P5
        turn(h, 11, spare)
        h *= P1
    return finish(h, spare)
