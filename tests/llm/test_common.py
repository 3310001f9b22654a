"""Words coded in Arrow against words cut one text at a time."""

import random

import numpy as np
import pyarrow as pa

from orrery.llm.common import coded_words, word_hashes, words


def test_coded_words():
    r = random.Random(3)
    bits = ["a", "B", "ÄÖ", "ä", "\u00a0", "\u2003", " ", "\t", "\x0b", "\x0c", "\r\n", "\x1c", "\x85", "İ", "🙂", "\x00"]
    texts = [None, "", " ", "x", " x ", *("".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(500))]
    codes, sizes, hashes = coded_words(pa.array(texts))
    at = 0
    for t, n in zip(texts, sizes, strict=True):
        assert (hashes[codes[at : at + n]] == word_hashes(words(t))).all() and n == len(words(t))
        at += n
    assert at == len(codes) and (np.diff(hashes.astype(object)) > 0).all()
    assert [len(x) for x in coded_words(pa.array([], pa.string()))] == [0, 0, 0]
