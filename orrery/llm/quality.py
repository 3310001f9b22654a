"""Importance resampling: documents weighed by p_target / p_raw and drawn by Gumbel top-k.

Both models are bags of hashed byte n-grams with smoothed counts: the target model from
labelled good documents, the raw model from all documents. A document's log weight is the
mean over its n-grams of the log ratio of the two, times GRAMS: that of a text of GRAMS
n-grams like it, so that length decides nothing and the noise of the draw is worth the same
everywhere. Gumbel noise is added to it, and the k largest keys are drawn: close to the cut
chance decides, far from it the weight does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from orrery.llm.common import slices, stage, utf8

#: n-gram width in bytes and hash buckets (a table of 2 ** BITS doubles goes to each task).
WIDTH, BITS = 4, 15
#: Bytes of text whose n-grams are counted at a time; each takes eight bytes meanwhile.
COUNTED = 1 << 19
#: Most labelled rows that the target model is fitted on, smallest hashes of doc_id first.
LABEL_BOUND = 50_000
#: Pseudo-count of a bucket in the raw model.
PSEUDO = 2.0
#: n-grams of the text that a log weight stands for. Gumbel noise (standard deviation 1.28)
#: moves a document by 0.0025 nats an n-gram.
GRAMS = 512
#: Where no share is given: TARGET_LOSS of the labelled good documents may weigh less than the cut that sets k.
TARGET_LOSS = 0.004
_LOGW = "_orrery_log_weight"


def buckets(text: str | None) -> np.ndarray:
    """Hash buckets of a text's byte n-grams, a space added at both ends; empty for an empty text."""
    raw = utf8(text)
    if not raw:
        return np.empty(0, np.int64)
    b = np.frombuffer(b" " + raw + b" " * (WIDTH - 1), np.uint8).astype(np.uint32)
    h = b[: len(b) - WIDTH + 1].copy()
    for i in range(1, WIDTH):
        h = (h << np.uint32(8)) | b[i : len(b) - WIDTH + 1 + i]
    return ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)


def fit(docs: DataFrame, good_ids: np.ndarray) -> np.ndarray:
    """Log ratio for each bucket, from counts over all of docs(doc_id, text)."""
    size = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in slices(batches, "text", COUNTED):
            ids = batch.column("doc_id").to_pylist()
            known = np.isin(np.array([-1 if i is None else i for i in ids]), good_ids) & np.array([i is not None for i in ids])
            own = [buckets(text) for text in batch.column("text").to_pylist()]
            raw += np.bincount(np.concatenate(own), minlength=size)
            if known.any():
                target += np.bincount(np.concatenate([b for b, k in zip(own, known, strict=True) if k]), minlength=size)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    rows = docs.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.zeros(size), np.zeros(size)
    for at, r, t in rows:
        raw[at] += r
        target[at] += t
    if not target.sum():
        return np.zeros(size)
    # The target's pseudo-counts are scaled so that a bucket of equal shares weighs nothing.
    scale = target.sum() / raw.sum()
    target, raw = target + PSEUDO * scale, raw + PSEUDO
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weigh(docs: DataFrame, ratio: np.ndarray, text_col: str) -> DataFrame:
    """docs with its log weight in one more column."""
    names = [*docs.columns, _LOGW]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            w = [GRAMS * float(ratio[b].mean()) if len(b) else 0.0 for b in map(buckets, batch.column(text_col).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(w, pa.float64())], names)

    schema = StructType([*docs.schema.fields, StructField(_LOGW, DoubleType())])
    return docs.mapInArrow(run, schema)


def kth_largest(values: DataFrame, k: int, enough: int = 20_000) -> float:
    """The k-th largest of a column `v` of finite doubles, by histograms of bounded size; exact."""
    lo, hi = values.agg(F.min("v"), F.max("v")).first()
    while True:
        inside = values.where(F.col("v").between(lo, hi))
        n = inside.count()
        if n <= enough or lo == hi:
            return lo if lo == hi else sorted((r[0] for r in inside.collect()), reverse=True)[k - 1]
        step = (hi - lo) / 1024
        bins = inside.groupBy(F.least(F.floor((F.col("v") - lo) / step), F.lit(1023)).alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        for r in sorted(bins, key=lambda r: -r.b):
            if k <= r.n:
                lo, hi = r.lo, r.hi
                break
            k -= r.n


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """docs with log_weight, gumbel_key and selected: the k documents of largest log w + Gumbel noise.

    k is `share` of all documents (at least one, if there are any); share 0 draws none. Without
    a share it is the number of documents that the target model explains better than the raw
    one (log weight 0 or more), or that weigh as much as all but TARGET_LOSS of the labelled
    good ones (quality 1, not toxic) if that is less; so the share drawn follows the corpus.

    Ids are integers. Null and empty texts have no n-grams and log weight 0. Ties at the k-th
    key are all drawn; repeated rows get equal keys. Null ids are hashed like any value.
    Without labelled good rows, or with empty docs, every document is drawn (there is no
    target). Columns of the three names above are replaced; other columns pass through as
    they are.
    """
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long"))
    ids = np.array(sorted(r[0] for r in good.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABEL_BOUND).collect()), dtype=np.int64)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ratio = fit(plain, ids)
    u = (F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 11) + 0.5) / float(2**53)
    key = F.col(_LOGW) - F.log(-F.log(u))
    thin = weigh(docs.select(id_col, text_col), ratio, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(_LOGW).alias("w"), key.alias("v"))
    thin = stage(thin, "weights")
    if share is None:
        at = F.broadcast(thin.sparkSession.createDataFrame([(int(i),) for i in ids], "doc_id long"))
        cut = thin.join(at, "doc_id", "left_semi").agg(F.percentile("w", F.lit(TARGET_LOSS))).first()[0]
        k = thin.where(F.col("w") >= min(cut, 0.0)).count() if cut is not None else None
    else:
        k = min(max(math.ceil(share * (n := thin.count())), min(n, 1)), n) if share > 0 else 0
    limit = kth_largest(thin.select("v"), k) if k else float("inf" if k == 0 and not thin.isEmpty() else "-inf")
    rest = docs.drop("log_weight", "gumbel_key", "selected")
    out = weigh(rest, ratio, text_col).withColumn("gumbel_key", key).withColumn("selected", F.col("gumbel_key") >= F.lit(limit))
    return out.withColumnRenamed(_LOGW, "log_weight")
