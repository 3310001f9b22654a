"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

A bounded sample of labelled documents is the set of examples. Terms are words and, for longer
words, their fronts. A term's idf is measured against the examples that are not labelled toxic, so
that ordinary prose weighs little, and taken to a power; weights are (1 + ln tf) idf^1.5. The index
holds the examples in blocks of similar ones; for each word and block it knows the largest weight
there. A document's blocks are taken by the sum of these maxima, and the search ends when no block
left can reach the k-th best example: what it finds is exact. Each neighbour votes with its
cosine; the votes are turned into probabilities by a logistic curve that is fitted on the
examples, each judged by all others.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import slices, stage

#: Examples at most, smallest hashes of doc_id first, and the characters that they have in sum at most.
EXAMPLES, CHARACTERS = 8192, 48_000_000
#: Neighbours that vote; examples of a block; blocks that a search takes first.
NEIGHBOURS, BLOCK, FIRST = 25, 512, 3
#: A word counts if so many examples have it, and at most this share of those that are not toxic.
LEAST, SHARE = 8, 0.05
#: Letters of the fronts that stand for longer words, too; the power of the idf in a weight.
FRONT, POWER = 6, 1.5
#: Characters of a text whose words are counted at a time.
PIECE = 1 << 20

_NEIGHBOUR = pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.float64())])
_WORD = re.compile(r"[^\W\d_]+")


def bag(text: str | None) -> Counter:
    """How often each word occurs, and each front of longer words (with ~): words are runs of letters of the lower-cased text. Null counts as empty."""
    text, found, at = (text or "").lower(), Counter(), 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            # A piece ends with a whole word.
            end = _WORD.match(text, end).end() if _WORD.match(text, end) else end
        found.update(_WORD.findall(text, at, end))
        at = end
    for word in [w for w in found if len(w) > FRONT]:
        found[word[:FRONT] + "~"] += found[word]
    return found


class Index:
    """Unit vectors of examples as postings by block and word, with each word's largest weight in each block."""

    def __init__(self, words: list[str], counts: np.ndarray, numbers: np.ndarray, weights: np.ndarray, idf: np.ndarray, labels: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> None:
        """counts: postings of each word; numbers and weights: the postings, by word, weights of unit vectors."""
        self.words = {w: i for i, w in enumerate(words)}
        self.idf, self.n, n_words = idf, len(labels), max(len(words), 1)
        word = np.repeat(np.arange(len(words)), counts)
        # Alike examples lie together: those with the same commonest word.
        commonest = np.full(self.n, n_words)
        rank = np.empty(n_words, np.int64)
        rank[np.argsort(-np.bincount(word, minlength=n_words), kind="stable")] = np.arange(n_words)
        np.minimum.at(commonest, numbers, rank[word])
        self.given = np.argsort(commonest, kind="stable")
        place = np.empty(self.n, np.int64)
        place[self.given] = np.arange(self.n)
        self.labels, self.ids, self.hashes = labels[self.given], ids[self.given], hashes[self.given]
        self.n_words, self.n_blocks = n_words, max(-(-self.n // BLOCK), 1)
        at = place[numbers]
        key = (at // BLOCK) * n_words + word
        order = np.lexsort((at, key))
        small = np.int16 if self.n <= np.iinfo(np.int16).max else np.int32
        self.at, self.weight, key = at[order].astype(small), weights[order], key[order]
        self.start = np.searchsorted(key, np.arange(self.n_blocks * n_words + 1)).astype(np.int32 if len(key) < 1 << 31 else np.int64)
        most = np.zeros(self.n_blocks * n_words)
        np.maximum.at(most, key, self.weight)
        # Singles rounded up are bounds still.
        self.most = np.nextafter(np.ascontiguousarray(most.reshape(self.n_blocks, n_words).T).astype(np.float32), np.float32(np.inf)) * (most.reshape(self.n_blocks, n_words).T > 0)
        self.base = float(labels.mean()) if self.n else 0.0
        self.curve, self.shared = (0.0, 1.0), None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"shared": None}

    def broadcast(self, spark: SparkSession) -> Broadcast:
        """The index in every task; sent once, without the curve that is fitted later."""
        if self.shared is None:
            self.shared = spark.sparkContext.broadcast(self)
        return self.shared

    def vector(self, words: Counter) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights) of a unit vector, terms ascending; words that are not in the index are left out."""
        known = sorted((self.words[w], n) for w, n in words.items() if w in self.words)
        if not known:
            return np.empty(0, np.int64), np.empty(0)
        terms, times = np.array(known).T
        weight = (1 + np.log(times)) * self.idf[terms]
        size = np.sqrt((weight**2).sum())
        return terms, weight / size if size else weight

    def nearest(self, terms: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the k examples with the largest positive cosines, ties to the smaller place; `without` names a place to pass over."""
        best, score = np.empty(0, np.int64), np.empty(0)
        if not len(terms) or not self.n:
            return best, score
        bound = weight @ self.most[terms]
        order = np.argsort(-bound, kind="stable")
        at, take = 0, FIRST
        while at < len(order):
            least = score[k - 1] if len(score) >= k else 0.0
            chosen = order[at : at + take]
            # A hair is added to the bound, for sums in another order.
            chosen = chosen[(bound[chosen] * (1 + 1e-9) >= least) & (bound[chosen] > 0)]
            if not len(chosen):
                break
            key = (chosen[:, None] * self.n_words + terms[None]).ravel()
            lo = self.start[key].astype(np.int64)
            size = self.start[key + 1] - lo
            ends = np.cumsum(size)
            posting = np.arange(ends[-1]) + np.repeat(lo - ends + size, size)
            summed = np.bincount(self.at[posting], self.weight[posting] * np.repeat(np.tile(weight, len(chosen)), size), self.n)
            if without >= 0:
                summed[without] = 0
            found = np.flatnonzero(summed > 0)
            if len(found) > k:
                found = found[summed[found] >= np.partition(summed[found], len(found) - k)[len(found) - k]]
            best, score = np.concatenate([best, found]), np.concatenate([score, summed[found]])
            keep = np.lexsort((best, -score))[:k]
            best, score = best[keep], score[keep]
            at, take = at + take, len(order)
        return best, score

    def vote(self, best: np.ndarray, score: np.ndarray) -> float:
        """The toxic share of the neighbours, each counted by its cosine; that of all examples without neighbours."""
        return float((score * self.labels[best]).sum() / score.sum()) if len(best) else self.base

    def probability(self, vote: float, curve: tuple[float, float]) -> float:
        if not self.n:
            return 0.0
        a, b = curve
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, a + b * _spread(vote)))))


def _spread(vote: float) -> float:
    return math.log((vote + 0.01) / (1.01 - vote))


def fit_curve(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(a, b) of a logistic curve over spread votes by Newton steps, held near (0, 1) by a small penalty."""
    x = np.stack([np.ones(len(votes)), np.log((votes + 0.01) / (1.01 - votes))], 1)
    at, start = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -60, 60)))
        slope = x.T @ (labels - p) - 0.1 * (at - start)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), slope)
        at = at + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(max(at[1], 1e-3))


def examples(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, limit: int, characters: int) -> DataFrame:
    """(text, toxic): distinct texts of labelled documents, toxic the mean of their labels; a sample of bounded size."""
    own = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("double").alias("y")).where("i IS NOT NULL AND y IS NOT NULL")
    chosen = own.groupBy("i").agg(F.avg("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(limit)
    d = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = d.join(F.broadcast(chosen), "i").groupBy("text").agg(F.avg("y").alias("toxic"), F.min("i").alias("i")).withColumn("h", F.xxhash64("i", "text"))
    found = stage(found.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, 1)), "examples")
    sizes = found.select("h", "i", F.length("text").alias("n")).orderBy("h", "i").limit(limit).collect()
    whole = np.cumsum([r.n for r in sizes])
    last = int(np.searchsorted(whole, characters, "right"))
    return found.where(F.lit(False) if not last else (F.col("h") < sizes[last - 1].h) | ((F.col("h") == sizes[last - 1].h) & (F.col("i") <= sizes[last - 1].i)))


def _lists(known: DataFrame, least: int, share: float) -> Index:
    """The index over examples(text, toxic, h, i), its curve not fitted yet.

    Terms are counted task by task and summed; then each example is one row of the terms that
    count, so that no posting is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, clean = Counter(), Counter()
        for b in (s for x in batches for s in slices([x], "text")):
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                terms = bag(text).keys()
                every.update(terms)
                if toxic < 0.5:
                    clean.update(terms)
        yield pa.RecordBatch.from_arrays([pa.array(list(every), pa.string()), pa.array(list(every.values()), pa.int64()), pa.array([clean[t] for t in every], pa.int64())], ["term", "n", "n_clean"])

    rows = known.select("h", "i", "toxic").orderBy("h", "i").collect()
    labels = np.array([r.toxic for r in rows], float)
    clean = int((labels < 0.5).sum())
    counted = known.select("toxic", "text").mapInArrow(count, "term string, n long, n_clean long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("n_clean").alias("n_clean"))
    kept = counted.where((F.col("n") >= least) & (F.col("n_clean") <= share * max(clean, 1 / share))).select("term", "n_clean").orderBy("term").toArrow()
    terms = kept.column("term").to_pylist()
    idf = np.log((clean + 1) / (kept.column("n_clean").to_numpy() + 1)) ** POWER
    shared = known.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(terms)})

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in (s for x in batches for s in slices([x], "text")):
            found = [sorted((own[t], n) for t, n in bag(text).items() if t in own) for text in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("i"), *(pa.array([[x[k] for x in f] for f in found], pa.list_(pa.int32())) for k in (0, 1))], ["h", "i", "terms", "times"])

    coded = known.select("h", "i", "text").mapInArrow(code, "h long, i long, terms array<int>, times array<int>").orderBy("h", "i").toArrow()
    of, times = (coded.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("terms", "times"))
    numbers = np.repeat(np.arange(len(labels)), [len(x) for x in coded.column("terms")])
    weights = (1 + np.log(times)) * idf[of]
    size = np.sqrt(np.bincount(numbers, weights**2, len(labels)))
    order = np.lexsort((numbers, of))
    weights = weights / np.where(size > 0, size, 1)[numbers]
    return Index(terms, np.bincount(of, minlength=len(terms)), numbers[order], weights[order], idf, labels, np.array([r.i for r in rows], np.int64), np.array([r.h for r in rows], np.int64))


def _votes(known: DataFrame, index: Index) -> np.ndarray:
    """How all other examples vote on each, in order of place."""
    spark = known.sparkSession
    places = spark.createDataFrame([(int(h), int(i), p) for p, (h, i) in enumerate(zip(index.hashes, index.ids, strict=True))], "h long, i long, place long")
    shared = index.broadcast(spark)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in (s for x in batches for s in slices([x], "text")):
            at = b.column("place").to_pylist()
            votes = [own.vote(*own.nearest(*own.vector(bag(t)), without=p)) for t, p in zip(b.column("text").to_pylist(), at, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(votes, pa.float64())], ["place", "vote"])

    own = known.join(F.broadcast(places), ["h", "i"]).select("place", "text")
    return np.array([r.vote for r in own.mapInArrow(judge, "place long, vote double").orderBy("place").collect()])


def build(known: DataFrame, least: int = LEAST, share: float = SHARE) -> Index:
    """The index over examples(text, toxic, h, i), with its curve fitted on how they vote on each other."""
    index = _lists(known, least, share)
    if index.n:
        index.curve = fit_curve(_votes(known, index), index.labels)
    return index


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", evidence: bool = True) -> DataFrame:
    """(doc_id, score, neighbours) for each of docs: the probability of toxicity and, if asked for, the voting examples with their cosines, nearest first.

    Equal texts get equal scores; texts without a word of the index (null and empty ones, too)
    get that of the examples' share; without any example all scores are 0. Null ids are scored
    like others, repeated rows each.
    """
    shared, curve = index.broadcast(docs.sparkSession), index.curve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in (s for x in batches for s in slices([x], "text")):
            found = [own.nearest(*own.vector(bag(t))) for t in b.column("text").to_pylist()]
            cols = [b.column("doc_id"), pa.array([own.probability(own.vote(*f), curve) for f in found], pa.float64())]
            if evidence:
                cols.append(pa.array([[{"doc_id": int(own.ids[p]), "cosine": float(c), "toxic": float(own.labels[p])} for p, c in zip(*f, strict=True)] for f in found], pa.list_(_NEIGHBOUR)))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "score", "neighbours"][: len(cols)])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, score double" + ", neighbours array<struct<doc_id:long,cosine:double,toxic:double>>" * evidence)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", limit: int = EXAMPLES, characters: int = CHARACTERS, evidence: bool = True) -> DataFrame:
    """score() of docs by an index over the documents that labels(doc_id, toxic) names.

    Of the labelled documents at most `limit` are examples, those with the smallest hashes of
    doc_id, as far as they have at most `characters` in sum: both bound the index, which every
    task holds. Copies of a text are one example with the mean of their labels; ids labelled
    more than once count with their mean; null ids and labels are passed over. Other columns are
    not read.
    """
    return score(docs, build(examples(docs, labels, id_col, text_col, label_col, limit, characters)), id_col, text_col, evidence)
