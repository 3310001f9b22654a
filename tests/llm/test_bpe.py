"""The token automaton against merging by rank, and against the library on all code points."""

import json
import random

import pytest

from orrery.llm import bpe

SPLIT = "'s|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def toy(r, n_merges, end="</w>"):
    """A tokenizer file with merges learnt from nothing: random pairs of what exists already."""
    letters = list("abcd")
    vocab = {t: i for i, t in enumerate([*letters, *(x + end for x in letters)])}
    inner, last, merges = list(letters), [x + end for x in letters], []
    while len(merges) < n_merges:
        a, b = r.choice(inner), r.choice(inner + last)
        if a + b not in vocab and len(a + b) < 12:
            vocab[a + b] = len(vocab)
            merges.append([a, b])
            (last if b.endswith(end) else inner).append(a + b)
    return {"model": {"vocab": vocab, "merges": merges, "end_of_word_suffix": end}, "added_tokens": [], "normalizer": {"normalizers": [{"type": "NFC"}, {"type": "Replace"}, {"type": "Lowercase"}]}, "pre_tokenizer": {"pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT}}]}}


def merged(word, spec):
    """All places of the earliest pair, from left to right, until no pair is left."""
    parts = [*word[:-1], word[-1] + "</w>"]
    rank = {tuple(m): i for i, m in enumerate(spec["model"]["merges"])}
    while len(parts) > 1:
        best = min(zip(parts, parts[1:]), key=lambda p: rank.get(p, 1 << 30))
        if best not in rank:
            break
        out, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and (parts[i], parts[i + 1]) == best:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return [spec["model"]["vocab"][p] for p in parts]


@pytest.mark.parametrize("seed", range(8))
def test_automaton_against_merging(seed):
    r = random.Random(seed)
    spec = toy(r, 60)
    a = bpe.Automaton(spec)
    for _ in range(1500):
        w = "".join(r.choice("abcd"[: 2 + seed % 3]) for _ in range(r.randint(1, 14)))
        assert a.encode(w) == merged(w, spec), w


def test_all_code_points_as_the_library():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib, a = Tokenizer.from_file(path), bpe.Automaton(json.load(open(path)))
    late = [c for x, y in bpe.LATE for c in (x - 1, x, y, y + 1)]
    points = sorted({*late, *bpe.NEW_LOWER, *bpe.NEW_LOWER.values(), *range(0, 0x3000), *range(0x3000, 0x110000, 41)} - set(range(0xD800, 0xE000)))
    texts = [f"xQ{chr(c)}wA" for c in points]
    for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert a.encode(t) == e.ids, hex(ord(t[2]))
        assert a.decode(e.ids) == lib.decode(e.ids, skip_special_tokens=False)


def test_frames(spark):
    """Empty tables, null ids and texts, repeated rows, a very long word, columns with clashing names."""
    P = pytest.importorskip("public_tokenizers")
    path = P.path("word_bpe_49k.json")
    d = spark.createDataFrame([(None, "a b", 1), (1, None, 1), (2, "", 1), (2, "", 1), (3, "ab" * 40000, 1)], "doc_id long, text string, n_tokens int")
    rows = bpe.encode_documents(d, path).collect()
    assert sorted((r.doc_id or 0, r.n_tokens > 0) for r in rows) == [(0, True), (1, False), (2, False), (2, False), (3, True)]
    assert "".join(bpe.compiled(open(path).read()).decode(rows[[r.doc_id for r in rows].index(3)].ids).split(" ")) == "ab" * 40000 + "</w>"
    assert bpe.encode_documents(d.where("false"), path).count() == 0
