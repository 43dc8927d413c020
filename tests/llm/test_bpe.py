import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracelith.llm.bpe import Codec, encode_decode

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "aaaaaaaaa aaaaaaa", "it's  we'll \n\n  x\t\ty  ", "'s's 're'lla !'s", "\x1c\x1d a\x1e\x85c᠎d​e﻿f　g\xa0h", "١٢٣ ½ ² Ⅷ 中文字符，。", "😀👨‍👩‍👧 é é ñ", "a" * 5000, "ab" * 3000 + " ", "x9" * 2500 + " " * 3000 + "z"]


@pytest.fixture(scope="module")
def both():
    return Codec(PATH), Tokenizer.from_file(PATH)


def test_ids_and_text_match_the_library(both):
    mine, library = both
    r = random.Random(1)
    texts = TEXTS + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xA0, 0x3000), r.randrange(0x1F300, 0x1FA00)])) for _ in range(r.randrange(200))) for _ in range(200)]
    ids, ends = mine.encode(texts)
    decoded, digits, at = mine.decode(ids, ends), mine.digits(ids, ends), [0, *ends.tolist()]
    for k, t in enumerate(texts):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids[at[k] : at[k + 1]].tolist() == want
        assert decoded[k] == library.decode(want, skip_special_tokens=False)
        assert digits[k] == ",".join(map(str, want)).encode()


def test_bytes_that_are_no_text_decode_as_the_library_does(both):
    mine, library = both
    ids, _ = mine.encode(["é"])
    import numpy as np

    broken = np.array(ids.tolist()[:1] + [220, 128, 255 % 200], np.int64)
    assert mine.decode(broken, np.array([len(broken)])) == [library.decode(broken.tolist(), skip_special_tokens=False)]


def test_query(spark):
    docs = spark.createDataFrame([(1, "hello world", 5), (1, "hello world", 6), (2, None, 7), (3, "", 8)], "doc_id long, text string, ids int")
    rows = sorted(encode_decode(docs, PATH).collect())
    assert [r.n_tokens for r in rows] == [2, 2, 0, 0]
    assert rows[0].decoded == "hello world" and rows[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert encode_decode(docs.limit(0), PATH, ids=False).count() == 0
