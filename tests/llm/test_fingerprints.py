import hashlib
import random
import re
import struct

import xxhash

from tracelith.llm import fingerprints
from tracelith.llm.fingerprints import fingerprints as run


def rows_of(seed, n):
    r = random.Random(seed)
    return [(i * 3 + 5, "".join(r.choice(["ab", "é", " ", "xyz", "\n", "q", "日本"]) for _ in range(r.choice([0, 1, 7, 60, 900])))) for i in range(n)]


def test_edited_texts_against_brute_force(spark, monkeypatch):
    for n, in_range in ((57, 2000), (57, 5), (1, 5), (2, 1)):
        monkeypatch.setattr(fingerprints, "ROWS_IN_RANGE", in_range)
        rows = rows_of(n, n)
        if n > 50:
            rows[3] = (rows[3][0], None)
        got = {x.doc_id: x for x in run(spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, range int")).collect()}
        falling = sorted(rows, reverse=True, key=lambda x: x[0])
        assert len(got) == n
        for k, (d, t) in enumerate(falling):
            t, after = t or "", falling[(k + 1) % n][1] or ""
            half = len(t) // 2
            edited = t[: len(t) - half] + after[:half]
            assert got[d].n_chars == len(t) and got[d].edited == edited
            assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert 0 <= got[d].near_edited <= 1
            if edited == t:
                assert got[d].near_edited == 1 and got[d].fingerprint == got[d].edited_fingerprint


def test_closed_syncmers_and_likeness_against_brute_force(spark):
    r = random.Random(5)
    words = [f"w{r.randrange(900)}" for _ in range(90)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:45] + [f"z{i}" for i in range(45)])), (3, "a b"), (4, "a b"), (5, ""), (5, " \n"), (6, "one two three four five")]
    got = run(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x)
    whole = lambda d: {by[d][0].fingerprint[i : i + 8] for i in range(0, len(by[d][0].fingerprint), 8)}
    assert by[3][0].fingerprint == by[4][0].fingerprint and by[4][0].near_next == 1.0
    assert all(x.fingerprint == "" and x.near_edited == 1.0 for x in by[5])
    assert len(by[6][0].fingerprint) == 8
    a, b = whole(1), whole(2)
    assert 0.2 < len(a & b) / len(a | b) < 0.5 and abs(by[2][0].near_next - len(a & b) / len(a | b)) < 1e-9
    kinds = sum(len(x) // 8 for x in [by[1][0].fingerprint])
    assert 20 < kinds <= 89


def test_empty(spark):
    assert run(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_shifted_passage_in_text_without_spaces(spark):
    r = random.Random(4)
    for alphabet in ("日本語中文字漢書東京大学生活水火木金土", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"):
        text = "".join(r.choice(alphabet) for _ in range(180))
        rows = [(3, text), (2, text[:3] + "x" + text[3:]), (1, text[:3] + text[5:])]
        got = {x.doc_id: x for x in run(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got[3].near_next > 0.7 and got[2].near_next > 0.7


def murmur(value, size, seed):
    """32-bit Murmur3 of an int of 4 or 8 bytes, signed."""
    h, mask = seed & 0xFFFFFFFF, 0xFFFFFFFF
    turn = lambda x, n: (x << n | x >> (32 - n)) & mask
    for (k,) in struct.iter_unpack("<I", (value & (1 << 8 * size) - 1).to_bytes(size, "little")):
        h = turn(h ^ turn(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask, 13) * 5 + 0xE6546B64 & mask
    h ^= size
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    return h ^ h >> 16


def brute(text):
    """The fingerprint by plain Python, for texts of five tokens or more that choose an anchor."""
    tokens = []
    for run_ in re.findall(r"\S+", text):
        tokens += [run_] if len(run_) <= 16 else [run_[i : i + 4] for i in range(len(run_))]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    h = [signed(xxhash.xxh64(t.encode(), seed=42).intdigest()) for t in tokens]
    long = lambda x, seed: xxhash.xxh64(struct.pack("<q", x), seed=seed & (1 << 64) - 1).intdigest()
    pairs = [signed(long(b, long(a, 42))) for a, b in zip(h, h[1:], strict=False)]
    at = [i for i in range(len(h) - 4) if min(pairs[i], pairs[i + 3]) <= min(pairs[i + 1], pairs[i + 2])]
    gaps = [b - a for a, b in zip(at, at[1:], strict=False)] + [0]
    return "".join(f"{murmur(g, 4, murmur(h[i + 4], 8, murmur(pairs[i + 2], 8, murmur(pairs[i], 8, 42)))):08x}" for i, g in zip(at, gaps, strict=True))


def test_anchors_against_plain_python(spark):
    r = random.Random(11)
    rows = [(i, "".join(r.choice(["ab", "é", " ", "xyz", " ", "\n", "q", "日本語", "long" * 5]) for _ in range(r.choice([60, 200, 5000])))) for i in range(30)]
    got = {x.doc_id: x.fingerprint for x in run(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == brute(t) for i, t in rows)


def test_one_inserted_character_and_long_texts(spark):
    r = random.Random(12)
    plain = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(600))
    prose = " ".join(f"w{r.randrange(5000)}" for _ in range(20_000))
    rows = [(4, plain), (3, "x" + plain), (2, prose), (1, prose[:50_000] + "Z" + prose[50_000:])]
    got = {x.doc_id: x for x in run(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[4].near_next > 0.9 and got[3].near_next < 0.05 and 0.999 < got[2].near_next < 1
