"""The Katz model against one written per token, with dictionaries."""

import math
import zlib
from collections import Counter

import pytest

from orrery.llm import katz


def brute(texts):
    """{doc_id: (held, n_tokens, n_known, base, score)} by recursion over each token."""
    toks = {i: ["<s>", *(t or "").encode().lower().split(), "</s>"] for i, t in texts}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in toks}
    uni, bi = Counter(), Counter()
    for i, t in toks.items():
        if not held[i]:
            uni.update(t[1:])
            bi.update(zip(t[:-1], t[1:]))
    n, v = sum(uni.values()), len(uni)
    times = lambda c: [sum(x == r for x in c.values()) for r in range(1, katz.CUT + 2)]
    du, db = ([0.0, *katz.discounts(times(c))] for c in (uni, bi))
    disc = lambda d, c: (d[c] if c <= katz.CUT else katz.LARGE) * c
    p_uni = {w: disc(du, c) / n for w, c in uni.items()}
    unknown = 1 - sum(p_uni.values())
    by_h = {}
    for (h, w), c in bi.items():
        by_h.setdefault(h, {})[w] = c
    assert abs(sum(p_uni.values()) + unknown - 1) < 1e-12

    def prob(h, w):
        low = p_uni.get(w, unknown)
        if h not in by_h:
            return low
        ch = sum(by_h[h].values())
        if w in by_h[h]:
            return disc(db, by_h[h][w]) / ch
        rest = 1 - sum(disc(db, c) for c in by_h[h].values()) / ch
        return rest * low / (1 - sum(p_uni[x] for x in by_h[h]))

    for h in list(by_h)[:40]:  # exactly normalised over all words and the unknown one
        assert abs(sum(prob(h, w) for w in uni) + prob(h, "unknown word") - 1) < 1e-9
    return {i: (held[i], len(t) - 1, sum(uni[w] > 0 for w in t[1:]), sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t[1:]), sum(math.log10(prob(h, w)) for h, w in zip(t[:-1], t[1:]))) for i, t in toks.items()}, n


@pytest.mark.parametrize("bucket_bytes, shares", [(1 << 20, 1), (200, 1), (4000, 40), (1 << 20, 1 << 18)])
def test_against_brute_force(spark, bucket_bytes, shares):
    texts = [(i, " ".join(f"w{(i * j * j + j) % (5 + i % 11)}" for j in range(i % 30)) + (" The the END x%d" % (i % 3)) * (i % 4)) for i in range(60)] + [(60, None), (61, ""), (62, "never seen words here"), (63, "a " * 4000)]
    want, n = brute(texts)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in katz.score_documents(df, bucket_bytes=bucket_bytes, shares=shares).collect()}
    assert got.keys() == want.keys()
    for i, (held, toks, known, base, score) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, toks, known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-8)


def test_frequent_words_are_split(spark):
    """Words and bigrams that hold a bucket's share are found, counted exactly and spread over buckets."""
    texts = [(i, "the end of the line" if i % 3 else "the only x%d y%d" % (i, i * 7)) for i in range(400)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    shared = katz.frequent(df, 20)
    toks = {i: ["<s>", *t.encode().split(), "</s>"] for i, t in texts}
    uni, bi = Counter(), Counter()
    for t in toks.values():
        uni.update(t[1:])
        bi.update(zip(t[:-1], t[1:]))
    total = sum(uni.values())
    least = lambda c: sum(n * 20 >= total for n in c.values())
    assert least(uni) <= len(shared.w) <= 40 and least(bi) <= len(shared.pair) <= 40
    train = [t for i, t in toks.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    assert max(shared.cw) == sum(t.count(b"the") for t in train) and len(train) in shared.cw
    held = katz.deal(df, 20, shared).groupBy("bucket").count().collect()
    assert len(held) == 20
    want, _ = brute(texts)
    for r in katz.score_documents(df, bucket_bytes=600, shares=1).collect():
        assert (r.n_tokens, r.n_known) == want[r.doc_id][1:3] and r.score == pytest.approx(want[r.doc_id][4], rel=1e-8)


def test_repeated_and_null_ids(spark):
    """Rows of one id are one document; null ids are one, held out as '' is; ids at the end of the range stay; other columns are not read."""
    texts = [(i, "a b c d"[: 1 + i % 7]) for i in range(50)] + [(7, "a b"), (7, "a b"), (None, "a x"), (None, None), (-(2**63), "a b")]
    df = spark.createDataFrame([(i, t, 1.0, 2) for i, t in texts], "doc_id long, text string, score double, dest int").repartition(4)
    got = {r.doc_id: r for r in katz.score_documents(df, bucket_bytes=60, shares=4).collect()}
    assert len(got) == 52 and got.keys() >= {None, -(2**63)}
    assert got[7].n_tokens == len("a b c d"[:1].split()) + 1 + 6 and got[None].n_tokens == 4
    alone = {r.doc_id: r.score for r in katz.score_documents(spark.createDataFrame(texts, "doc_id long, text string").repartition(1)).collect()}
    assert {i: r.score for i, r in got.items()} == pytest.approx(alone, rel=1e-9)


def test_empty(spark):
    assert katz.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
