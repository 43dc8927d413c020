import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tracelith.llm.packing import closed_ids, pack, plan

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_match_the_library():
    r = random.Random(1)
    texts = ["", " ", "It's a TEST's\n\tİstanbul ΑΣ é x́", "a\x0bb\x0cc\xa0d　e", "<|endoftext|>a <|startoftext|> b<|endoftext|>", "\x1c\x85z ́ x"]
    texts += ["".join(chr(r.choice([r.randrange(9, 127), r.randrange(0xA0, 0x3000), r.randrange(0x1F300, 0x1FA00)])) for _ in range(r.randrange(200))) for _ in range(300)]
    library = Tokenizer.from_file(PATH)
    for t, ids in zip(texts, closed_ids(PATH, texts), strict=True):
        assert ids.tolist() == [*library.encode(t, add_special_tokens=False).ids, 0], repr(t)


def test_plan_is_complete_and_dense():
    r = random.Random(2)
    for case in range(30):
        cap = r.choice([12, 50, 2048])
        counts = Counter(min(cap, max(1, int(r.expovariate(1) * cap * r.choice([0.1, 0.4, 1])))) for _ in range(r.choice([0, 1, 5, 3000])))
        bins = plan(counts, cap)
        back = Counter()
        for pattern, times in bins:
            assert sum(pattern) <= cap and times > 0
            for n in pattern:
                back[n] += times
        assert +back == +counts
        total = sum(t for _, t in bins)
        least = -(-sum(n * c for n, c in counts.items()) // cap)
        half = sum(c for n, c in counts.items() if 2 * n > cap)
        assert total <= max(least, half) * 1.25 + 2


def test_query(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["alpha", "Beta", "né", "x1"]) for _ in range(r.choice([0, 3, 500, 900, 5000])))) for i in range(60)] + [(7, "dup"), (99, None)]
    got = pack(spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, task int"), PATH, with_ids=True).collect()
    digests = pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH)
    assert sorted((p.doc_id, p.piece, p.ids_crc32) for p in digests.collect()) == sorted((p.doc_id, p.piece, p.ids_crc32) for p in got)
    bins = defaultdict(list)
    for p in got:
        assert p.length == len(p.ids) // 4 and zlib.crc32(p.ids) == p.ids_crc32
        bins[p.sequence_id].append((p.offset, p.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    library = Tokenizer.from_file(PATH)
    for i, t in rows[:7] + rows[8:60] + [(99, "")]:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        mine = sorted((p for p in got if p.doc_id == i), key=lambda p: p.piece)
        assert [p.start for p in mine] == list(range(0, len(ids), 2048))
        assert np.frombuffer(b"".join(bytes(p.ids) for p in mine), "<u4").tolist() == ids


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
