"""Katz backoff bigram model: Good-Turing discounts, exactly normalised backoff weights.

Counts and what is asked of them travel as packed arrays between three partitioned tables:

* by predicted word: a bucket holds all tokens of its words, so it knows c(w) and c(h, w). It
  answers each slice of documents with the counts of the slice's n-grams, and tells
* by history: each history's counts of counts, and which unknown bigrams wait for its backoff
  weight. A bucket of histories works out the weights, a(h) = (1 - what seen words keep) /
  (1 - P(seen words)), and answers the slices with them;
* by slice: all answers meet, and each token's probability is evaluated by recursion: from its
  discounted bigram, or else the backoff weight times its unigram, or else the unknown word's.

The answers of all word buckets are staged before the rest, as discounts need the counts of
counts of the whole corpus. No row is ever made for a token; a document costs as many bytes in
a large corpus as in a small one.

Two light passes over the texts find the frequent words and bigrams beforehand and count them
exactly (`frequent`): those with one of SHARES equal shares of all tokens, of which there can be
two for each share at most. Frequent bigrams are scored where their text is read and never
shuffled; other bigrams of a frequent word are split over buckets by their history.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import coded_words, mix, slices, stage

#: Counts up to CUT are discounted by Good-Turing; larger ones keep LARGE of themselves, so that
#: every history has something to give to unseen words. Text bytes that a bucket holds on average.
CUT, LARGE, BUCKET_BYTES = 5, 0.999, 8 << 20
#: Tokens that a worker counts before it reports the frequent ones; least number of shares.
UNIT, SHARES = 2 << 20, 1 << 18
#: Bytes of text that are cut into tokens at a time.
WIDE = 4 << 20
#: Rows of a bucket that go back to the JVM at a time.
BATCH = 16384
#: Buckets of words for one bucket of histories.
HIST_BUCKETS = 4
#: Documents whose remainder is HELD are scored only.
FOLDS, HELD = 7, 2
START, END = np.uint64(0x51ED270B0A7CF9E1), np.uint64(0xE4D1A7F05C3B9A65)

#: Columns of a history: bigrams seen 1..CUT times, tokens of those seen more often; the same of the words that follow it.
_HIST = 2 * (CUT + 1)
#: Kinds of packed rows: answers to slices, sums of a slice's own frequent bigrams, histories, unknown bigrams, backoff weights, counts of counts.
ANSWER, OWN, HISTORY, MISS, BACK, STAT = range(6)
SCHEMA = "kind byte, dest long, data binary, stat array<long>"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD


def _pack(*arrays: np.ndarray) -> bytes:
    body = b"".join(np.int64(a.nbytes).tobytes() + a.dtype.char.encode() + a.tobytes() for a in arrays)
    return zstandard.compress(body, 3)


def _unpack(data: bytes) -> list[np.ndarray]:
    body, at, out = memoryview(zstandard.decompress(data)), 0, []
    while at < len(body):
        n = int(np.frombuffer(body[at : at + 8], np.int64)[0])
        out.append(np.frombuffer(body[at + 9 : at + 9 + n], bytes(body[at + 8 : at + 9]).decode()))
        at += 9 + n
    return out


def _small(a: np.ndarray) -> np.ndarray:
    top = a.max() if len(a) else 0
    return a.astype(np.uint8 if top < 2**8 else np.uint16 if top < 2**16 else np.uint32)


class Grams:
    """The tokens of a batch of texts as codes: word w after history h in document d; vocab holds the sorted hashes."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        codes, sizes, hashes = coded_words(batch.column("text"))
        self.vocab = np.unique(np.concatenate([hashes, [START, END]]).astype(np.uint64))
        place = np.searchsorted(self.vocab, hashes)
        start, end = np.searchsorted(self.vocab, np.array([START, END], np.uint64))
        self.d = np.repeat(np.arange(len(sizes)), sizes + 1)
        last = np.cumsum(sizes + 1) - 1
        self.w = np.full(len(self.d), end)
        self.h = np.full(len(self.d), start)
        own = np.ones(len(self.d), bool)
        own[last] = False
        self.w[own] = place[codes]
        own = np.ones(len(self.d), bool)
        own[last - sizes] = False
        self.h[own] = place[codes]

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(w, h, d, count) of the distinct ones, by w, h and d."""
        docs = int(self.d[-1]) + 1 if len(self.d) else 1
        key = np.sort((self.w * len(self.vocab) + self.h) * docs + self.d)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        pair, d = np.divmod(key[first], docs)
        return *np.divmod(pair, len(self.vocab)), d, np.diff(np.append(first, len(key)))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(w, h, count) of the distinct bigrams, by w and h."""
        key = np.sort(self.w * len(self.vocab) + self.h)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        return *np.divmod(key[first], len(self.vocab)), np.diff(np.append(first, len(key)))


def _pair(w: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(h * np.uint64(0x9E3779B97F4A7C15) + w)


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted keys, and whether x is there."""
    if not len(keys):
        return np.zeros(len(x), int), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


class Frequent:
    """Words and bigrams that all workers know, sorted, with their exact counts in training documents."""

    def __init__(self, w: np.ndarray, pw: np.ndarray, ph: np.ndarray) -> None:
        self.w = np.sort(w.astype(np.uint64))
        key = _pair(pw.astype(np.uint64), ph.astype(np.uint64))
        order = np.argsort(key)
        self.pair, self.pw, self.ph = key[order], pw.astype(np.uint64)[order], ph.astype(np.uint64)[order]
        self.cw, self.cp = np.zeros(len(self.w), np.int64), np.zeros(len(key), np.int64)

    def rows(self, n_hist: int) -> pa.Table:
        """What buckets leave out: histories' sums over these bigrams, and counts of counts."""
        seen = self.cp > 0
        cp, cw = self.cp[seen], self.cw[_find(self.w, self.pw[seen])[0]] if seen.any() else self.cp[:0]
        out = _histories(self.ph[seen], cp, cw, n_hist, self.w)
        return _rows([*out, _stat(self.cp, self.cw)])


def frequent(docs: DataFrame, shares: int) -> Frequent:
    """Every word and bigram with 1 / shares of all tokens or more, at most 2 * shares of each.

    A worker reports what holds half that share of a unit of its tokens; what goes unreported adds
    up to less than the other half, so nothing is missed where reports reach half the share in all.
    """

    def report(parts: list[tuple[np.ndarray, ...]], tokens: int) -> Iterator[pa.RecordBatch]:
        w, h, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        for kind, key in ((0, w), (1, _pair(w, h))):
            # Parts that come alone are distinct bigrams by word already.
            order = np.argsort(key) if kind or len(parts) > 1 else np.arange(len(key))
            key = key[order]
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            first, count = order[edge], np.add.reduceat(n[order], edge).astype(np.int64)
            keep = count * 2 * shares >= tokens
            first, count = first[keep], count[keep]
            hist = h[first] if kind else np.zeros(len(first), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), kind), pa.int8()), pa.array(w[first].view(np.int64)), pa.array(hist.view(np.int64)), pa.array(count)], ["kind", "w", "h", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int8()), pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([tokens], pa.int64())], ["kind", "w", "h", "n"])

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, tokens = [], 0
        for batch in slices(batches, "text", WIDE):
            g = Grams(batch)
            w, h, n = g.pairs()
            parts.append((g.vocab[w], g.vocab[h], n))
            tokens += len(g.w)
            if tokens >= UNIT:
                yield from report(parts, tokens)
                parts, tokens = [], 0
        if tokens:
            yield from report(parts, tokens)

    names = "kind byte, w long, h long, n long"
    total = lambda f: docs.mapInArrow(f, names).groupBy("kind", "w", "h").agg(F.sum("n").alias("n"))
    reported = stage(total(propose), "reports")
    tokens = reported.where("kind = 2").agg(F.sum("n")).first()[0] or 0
    got = reported.where(F.col("kind") < 2).where(F.col("n") * 2 * shares >= tokens).select("kind", "w", "h").toArrow()
    kind, w, h = (got.column(i).to_numpy() for i in range(3))
    out = Frequent(w[kind == 0].view(np.uint64), w[kind == 1].view(np.uint64), h[kind == 1].view(np.uint64))
    keys, pairs, pw, ph = out.w, out.pair, out.pw, out.ph

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cw, cp = np.zeros(len(keys), np.int64), np.zeros(len(pairs), np.int64)
        for batch in slices(batches, "text", WIDE):
            batch = batch.filter(pa.array([not held_out(i) for i in batch.column("doc_id").to_pylist()], pa.bool_()))
            if batch.num_rows:
                g = Grams(batch)
                at, there = _find(keys, g.vocab)
                cw[at[there]] += np.bincount(g.w, minlength=len(g.vocab))[there]
                w, h, n = g.pairs()
                own = there[w]
                at, there = _find(pairs, _pair(g.vocab[w[own]], g.vocab[h[own]]))
                cp[at[there]] += n[own][there]
        a, b = np.flatnonzero(cw), np.flatnonzero(cp)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], [len(a), len(b)]), pa.int8()), pa.array(np.concatenate([keys[a], pw[b]]).view(np.int64)), pa.array(np.concatenate([np.zeros(len(a), np.uint64), ph[b]]).view(np.int64)), pa.array(np.concatenate([cw[a], cp[b]]))], ["kind", "w", "h", "n"])

    if len(keys):
        got = total(count).toArrow()
        kind, w, h, n = (got.column(i).to_numpy() for i in range(4))
        w, h = w.view(np.uint64), h.view(np.uint64)
        out.cw[_find(keys, w[kind == 0])[0]] = n[kind == 0]
        if len(pairs):
            out.cp[_find(pairs, _pair(w[kind == 1], h[kind == 1]))[0]] = n[kind == 1]
    return out


def _encode(hashes: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes as steps between places in sorted common ones, and those that aren't there."""
    at, there = _find(common, hashes)
    return _small(np.diff(at[there], prepend=0)), hashes[~there]


def _decode(steps: np.ndarray, rest: np.ndarray, common: np.ndarray) -> np.ndarray:
    return np.sort(np.concatenate([common[np.cumsum(steps, dtype=np.int64)], rest]))


def deal(docs: DataFrame, n_buckets: int, shared: Frequent) -> DataFrame:
    """(bucket, slice, kind, data): the tokens of slices of documents, packed for each bucket of predicted words.

    Rows of kind OWN are for the slice itself: its ids, and what frequent bigrams add to its documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", WIDE):
            name, number = part << 32 | number, number + 1
            ids = batch.column("doc_id").to_pylist()
            g = Grams(batch)
            vocab = g.vocab
            w, h, d, count = g.distinct()
            del g
            split = np.flatnonzero(_find(shared.w, vocab)[1][w])
            uw, uh = vocab[w[split]], vocab[h[split]]
            pair = _pair(uw, uh)
            at, there = _find(shared.pair, pair)
            there &= shared.cp[at] > 0 if len(shared.cp) else False
            own = split[there]
            wc = shared.cw[_find(shared.w, uw[there])[0]] if len(own) else np.zeros(0, np.int64)
            sums = evaluate(len(ids), d[own], count[own], shared.cp[at[there]] if len(own) else wc, wc, uw[there] == END)
            known = np.array([i is not None for i in ids], bool)
            numbers, kinds = [int(mix(np.uint64([name]))[0] % np.uint64(n_buckets))], [OWN]
            data = [_pack(known, np.array([i or 0 for i in ids], np.int64), *sums)]
            salt = vocab[w]
            salt[split] = pair
            rest = np.ones(len(w), bool)
            rest[own] = False
            w, h, d, count, salt = w[rest], h[rest], d[rest], count[rest], salt[rest]
            bucket = mix(salt) % np.uint64(n_buckets)
            bucket = bucket.astype(np.uint16 if n_buckets <= 1 << 16 else np.int64)
            held = np.array([held_out(i) for i in ids], bool)
            for b, of in _groups(bucket):
                iw, words = _runs(w[of])
                uh, ih = np.unique(h[of], return_inverse=True)
                numbers.append(b)
                kinds.append(ANSWER)
                data.append(_pack(np.packbits(held), *_encode(vocab[words], shared.w), *_encode(vocab[uh], shared.w), _small(d[of]), _small(iw), _small(ih), _small(count[of])))
            n = len(numbers)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([name] * n, pa.int64()), pa.array(kinds, pa.int8()), pa.array(data, pa.binary())], ["bucket", "slice", "kind", "data"])

    return docs.mapInArrow(run, "bucket int, slice long, kind byte, data binary")


def _groups(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, places) of equal keys, places in their order."""
    order = np.argsort(key, kind="stable")
    edges = np.flatnonzero(np.diff(np.concatenate([[-1], key[order].astype(np.int64), [-1]])))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(key[order[a]]), order[a:b]


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each value's run, the runs' values) of an array whose equal values lie together."""
    new = np.concatenate([[True], x[1:] != x[:-1]])[: len(x)]
    return np.cumsum(new) - 1, x[new]


def _rows(rows: list[tuple[int, int, bytes | None, list[int] | None]]) -> pa.Table:
    kind, dest, data, stat = zip(*rows, strict=True)
    table = pa.table([pa.array(kind, pa.int8()), pa.array(dest, pa.int64()), pa.array(data, pa.binary()), pa.array(stat, pa.list_(pa.int64()))], ["kind", "dest", "data", "stat"])
    return pa.Table.from_batches(table.to_batches(max_chunksize=BATCH), table.schema)


def _stat(cp: np.ndarray, cw: np.ndarray) -> tuple[int, int, None, list[int]]:
    """Counts of counts 1..CUT + 1 of bigrams and words, all word tokens, distinct words."""
    return STAT, 0, None, [int(x) for x in (*((c == r).sum() for c in (cp, cw) for r in range(1, CUT + 2)), cw.sum(), (cw > 0).sum())]


def _histories(h: np.ndarray, cp: np.ndarray, cw: np.ndarray, n_hist: int, common: np.ndarray) -> list[tuple[int, int, bytes, None]]:
    """Rows of histories from their distinct bigrams: counts of these and of the words they predict."""
    uh, ih = np.unique(h, return_inverse=True)
    out = []
    cols = [np.bincount(ih, weights=x, minlength=len(uh)).astype(np.int64) for c in (cp, cw) for x in (*(c == r for r in range(1, CUT + 1)), np.where(c > CUT, c, 0))]
    for g, of in _groups((mix(uh) % np.uint64(n_hist)).astype(np.int64)):
        steps, rest = _encode(uh[of], common)
        there = _find(common, uh[of])[1]
        order = np.concatenate([of[there], of[~there]])
        out.append((HISTORY, g, _pack(steps, rest, *(_small(c[order]) for c in cols)), None))
    return out


def evaluate(n: int, d: np.ndarray, c: np.ndarray, pc: np.ndarray, wc: np.ndarray, is_end: np.ndarray) -> list[np.ndarray]:
    """Sums for each of n documents over n-grams that occur c times in document d.

    pc, wc: how often the bigram and its word occur in training. The recursion on a token is
    seen bigram, else seen word, else unknown word; how often each case with a small count
    comes up is summed as such, as the discounts are not known yet, and the rest as logs.
    """
    per = lambda x: np.bincount(d, weights=x, minlength=n)
    log = lambda x: np.log10(np.maximum(x, 1))
    seen = pc > 0
    # Each word but the end is the history of the next token: c(h) of all tokens but the first.
    logs = np.where(pc > CUT, c * log(pc), 0.0) + np.where(~seen & (wc > CUT), c * log(wc), 0.0) - np.where(is_end, 0.0, c * log(wc))
    # 0: unknown word, 1..CUT: word, CUT + 1: frequent word; then the same from 1 for bigrams.
    case = np.where(seen, CUT + 1 + np.minimum(pc, CUT + 1), np.minimum(wc, CUT + 1))
    cases = np.bincount(d * (2 * CUT + 3) + case, weights=c, minlength=n * (2 * CUT + 3)).reshape(n, -1)
    return [per(c), per(np.where(wc > 0, c, 0)), per(c * np.log10(wc + 1.0)), per(logs), *cases.T]


def count_bucket(rows: pa.Table, shared: Frequent, n_hist: int) -> pa.Table:
    """The answers of one bucket of words to slices, and its rows for histories; shared words and bigrams count as they do in all buckets."""
    kinds, names, data = rows.column("kind").to_pylist(), rows.column("slice").to_pylist(), rows.column("data")
    out = [(OWN, s, x.as_py(), None) for s, k, x in zip(names, kinds, data, strict=True) if k == OWN]
    names = [s for s, k in zip(names, kinds, strict=True) if k == ANSWER]
    parts = [_unpack(x.as_py()) for x, k in zip(data, kinds, strict=True) if k == ANSWER]
    if not parts:
        return _rows(out)
    sizes = [len(p[5]) for p in parts]
    held = np.concatenate([np.unpackbits(p[0])[p[5]] for p in parts]).astype(bool)
    w = np.concatenate([_decode(p[1], p[2], shared.w)[p[6]] for p in parts])
    h = np.concatenate([_decode(p[3], p[4], shared.w)[p[7]] for p in parts])
    c = np.concatenate([p[8].astype(np.uint32) for p in parts])
    docs, places = [p[5] for p in parts], [p[6] for p in parts]
    del parts
    train = np.where(held, 0, c)
    uw, iw = np.unique(w, return_inverse=True)
    iw = iw.astype(np.int32)
    cw = np.rint(np.bincount(iw, weights=train, minlength=len(uw))).astype(np.int64)
    up, where, ip = np.unique(_pair(w, h), return_index=True, return_inverse=True)
    ip = ip.astype(np.int32)
    cp = np.rint(np.bincount(ip, weights=train, minlength=len(up))).astype(np.int64)
    del w, train, held
    at, split_w = _find(shared.w, uw)
    cw[split_w] = shared.cw[at[split_w]]
    at, split_p = _find(shared.pair, up)
    cp[split_p] = shared.cp[at[split_p]]
    edges = np.concatenate([[0], np.cumsum(sizes)])
    for k, name in enumerate(names):
        own = slice(edges[k], edges[k + 1])
        first = np.flatnonzero(np.concatenate([[True], np.diff(places[k].astype(np.int64)) != 0]))
        words = iw[own][first]
        is_end = np.flatnonzero(uw[words] == END)
        out.append((ANSWER, name, _pack(docs[k], _small(c[own]), _small(cp[ip[own]]), _small(np.diff(np.append(first, sizes[k]))), _small(cw[words]), is_end.astype(np.int32)), None))

    known = np.flatnonzero((cp > 0) & ~split_p)
    out += _histories(h[where[known]], cp[known], cw[iw[where[known]]], n_hist, shared.w)
    miss = np.flatnonzero(cp[ip] == 0)
    part = np.repeat(np.arange(len(names)), sizes)[miss]
    doc = np.concatenate(docs)[miss]
    for g, of in _groups((mix(h[miss]) % np.uint64(n_hist)).astype(np.int64)):
        up, ipart = np.unique(part[of], return_inverse=True)
        uh, ih = np.unique(h[miss[of]], return_inverse=True)
        out.append((MISS, g, _pack(np.array(names, np.int64)[up], _small(ipart), _small(doc[of]), *_encode(uh, shared.w), _small(ih), _small(c[miss[of]])), None))
    out.append(_stat(cp[~split_p], cw[~split_w]))
    return _rows(out)


def weigh_histories(rows: pa.Table, common: np.ndarray, model: Model) -> pa.Table:
    """What the backoff weights of one bucket of histories, c(h) a(h), add to documents of slices."""
    kinds = rows.column("kind").to_pylist()
    parts = {k: [_unpack(x.as_py()) for x, own in zip(rows.column("data"), kinds, strict=True) if own == k] for k in (HISTORY, MISS)}
    if not parts[MISS]:
        return _rows([(STAT, 0, None, None)]).slice(0, 0)
    keys, back = np.zeros(0, np.uint64), np.zeros(0)
    if parts[HISTORY]:
        h = np.concatenate([np.concatenate([common[np.cumsum(p[0], dtype=np.int64)], p[1]]) for p in parts[HISTORY]])
        keys, ih = np.unique(h, return_inverse=True)
        back = model.backoff([np.bincount(ih, weights=np.concatenate([p[2 + i] for p in parts[HISTORY]]), minlength=len(keys)) for i in range(_HIST)])
    sums: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for names, part, doc, steps, rest, ih, c in parts[MISS]:
        h = _decode(steps, rest, common)
        at, there = _find(keys, h)
        # A history that training does not have gives nothing away: its words are those of the unigram.
        add = np.where(there, back[at] if len(keys) else 0.0, 0.0)[ih] * c
        for k, of in _groups(part):
            sums.setdefault(int(names[k]), []).append((doc[of].astype(np.int64), add[of]))
    out = []
    for name, own in sums.items():
        d, x = (np.concatenate(v) for v in zip(*own, strict=True))
        ud, idd = np.unique(d, return_inverse=True)
        out.append((BACK, name, _pack(_small(ud), np.bincount(idd, weights=x)), None))
    return _rows(out)


def score_slice(rows: pa.Table, model: Model) -> pa.Table:
    """(doc_id, n_tokens, n_known, base, score) for each text of one slice, from all answers to it."""
    kinds = rows.column("kind").to_pylist()
    parts = {k: [_unpack(x.as_py()) for x, own in zip(rows.column("data"), kinds, strict=True) if own == k] for k in (OWN, ANSWER, BACK)}
    known, ids, *sums = parts[OWN][0]
    n, total = len(ids), np.array(sums, float)
    for d, c, pc, runs, wc, ends in parts[ANSWER]:
        is_end = np.zeros(len(wc), bool)
        is_end[ends] = True
        total += evaluate(n, d.astype(np.int64), c.astype(np.int64), pc.astype(np.int64), np.repeat(wc, runs).astype(np.int64), np.repeat(is_end, runs))
    toks, seen, base, logs, *cases = total
    score = logs + np.array(cases).T @ model.case_logs() - model.start_log
    for d, x in parts[BACK]:
        score[d] += x
    whole = [pa.array(ids, pa.int64(), mask=~known), *(pa.array(np.rint(x).astype(np.int64)) for x in (toks, seen)), pa.array(base), pa.array(score)]
    return pa.table(whole, ["doc_id", "n_tokens", "n_known", "base", "score"])


class Model:
    """Discounts and the probabilities of words by their counts, from the counts of counts of the whole corpus."""

    def __init__(self, stat: list[int], starts: int) -> None:
        self.bi, self.uni = discounts(stat[: CUT + 1]), discounts(stat[CUT + 1 : 2 * CUT + 2])
        self.n_all, self.v_all = stat[-2:]
        # P(w): discounted counts over N; what they lose is the unknown word's.
        total, times = max(self.n_all, 1), stat[CUT + 1 : 2 * CUT + 1]
        small = sum(r * n for r, n in zip(range(1, CUT + 1), times, strict=True))
        lost = sum((1 - x) * r * n for r, x, n in zip(range(1, CUT + 1), self.uni, times, strict=True)) + (1 - LARGE) * (self.n_all - small)
        self.unknown = lost / total if self.n_all else 1.0
        self.p_low = [self.unknown, *(x * r / total for r, x in zip(range(1, CUT + 1), self.uni, strict=True))]
        self.p_big = LARGE / total
        self.start_log = math.log10(max(1, starts))

    def case_logs(self) -> np.ndarray:
        """log10 of what a token of each case of evaluate() is worth beside its own logs."""
        return np.log10([*self.p_low, self.p_big, *(x * r for r, x in zip(range(1, CUT + 1), self.bi, strict=True)), LARGE])

    def backoff(self, cols: list[np.ndarray]) -> np.ndarray:
        """log10 of c(h) a(h): what seen words give away over what unseen ones have, from the columns of histories."""
        small, big, words, frequent_words = cols[:CUT], cols[CUT], cols[CUT + 1 : -1], cols[-1]
        given = sum(r * (1 - x) * b for r, x, b in zip(range(1, CUT + 1), self.bi, small, strict=True)) + (1 - LARGE) * big
        unseen = 1 - sum(p * b for p, b in zip(self.p_low[1:], words, strict=True)) - self.p_big * frequent_words
        return np.log10(given) - np.log10(np.maximum(unseen, self.unknown))


def discounts(n: list[int]) -> list[float]:
    """Katz's d_1..d_CUT from n_1..n_{CUT + 1}; where they fall outside (0, 1), as on small corpora, r / (r + 0.5)."""
    out = []
    common = (CUT + 1) * n[CUT] / n[0] if n[0] else 1.0
    for r in range(1, CUT + 1):
        ratio = (r + 1) * n[r] / (r * n[r - 1]) if n[r - 1] else 0.0
        d = (ratio - common) / (1 - common) if common < 1 else 0.0
        out.append(d if 0 < d < 1 else r / (r + 0.5))
    return out


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, shares: int = SHARES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per doc_id.

    Tokens are words, A-Z lower-cased, and one end per document; a history is the word before,
    or the start. Documents with crc32(doc_id as text) mod 7 = 2 are scored only. base_score is
    the add-one unigram model's, score the Katz model's log10 probability of the text.

    docs should be read from files, or staged: a task that is run again must see its rows in
    the same order. Null and empty texts are one end token. Rows that share a doc_id are one document of
    several texts (sums over them); null ids are one document, held out by the rule for ''.
    Without training documents N is 0 and every word is unknown. Empty input gives an empty
    result; other columns are not read.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD
    # A document's end takes room too.
    size, starts = d.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8), F.count(F.when(~held, 1))).first()
    # Beyond as many buckets as shares, buckets grow instead: what each worker knows of frequent words stays bounded.
    n_buckets = min(max(1, -(-(size or 0) // bucket_bytes)), max(shares, SHARES))
    n_hist = max(1, n_buckets // HIST_BUCKETS)
    shared = frequent(d, shares)
    dealt = deal(d, n_buckets, shared).repartition(n_buckets, "bucket").groupBy("bucket")
    spark: SparkSession = d.sparkSession
    counts = stage(dealt.applyInArrow(lambda rows: count_bucket(rows, shared, n_hist), SCHEMA), "counts")
    counts = counts.unionByName(spark.createDataFrame(shared.rows(n_hist), SCHEMA))
    stat = counts.where(F.col("kind") == STAT).select(*(F.sum(F.get("stat", F.lit(i))) for i in range(2 * CUT + 4))).first()
    model, common = Model([int(x or 0) for x in stat], starts), shared.w
    asked = counts.where(F.col("kind").isin(HISTORY, MISS)).repartition(n_hist, "dest").groupBy("dest")
    back = stage(asked.applyInArrow(lambda rows: weigh_histories(rows, common, model), SCHEMA), "backoff")
    answers = counts.where(F.col("kind").isin(OWN, ANSWER)).unionByName(back).groupBy("dest")
    scored = answers.applyInArrow(lambda rows: score_slice(rows, model), "doc_id long, n_tokens long, n_known long, base double, score double")
    whole = scored.groupBy("doc_id").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")))
    return whole.select(
        "doc_id",
        held.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.n_all).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * math.log10(model.n_all + model.v_all + 1)).alias("base_score"),
        "score",
    )
