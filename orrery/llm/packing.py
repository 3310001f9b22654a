"""Conflict-constrained best-fit packing of documents into bins of a fixed number of tokens.

Documents are dealt by a hash of their id into shards of bounded size; each shard packs its
documents, longest first, into the tightest open bin that holds neither their source nor
their duplicate cluster. Only ids, lengths, sources and clusters travel, never texts.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of a bin, and pieces that a shard holds on average.
CAPACITY, SHARD = 2048, 8000


class Bins:
    """Open bins by residual space; each carries bitmaps of its sources and clusters.

    Bins of one residual are kept by their source bitmap, so the successor search passes
    over all bins that hold the source at once.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity, self.residuals, self.by, self.n = capacity, [], {}, 0

    def _put(self, left: int, sources: int, clusters: int, number: int) -> None:
        if left <= 0:
            return
        if left not in self.by:
            insort(self.residuals, left)
            self.by[left] = {}
        self.by[left].setdefault(sources, []).append((clusters, number))

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) in the tightest compatible bin, the oldest of equals; a new bin if there is none."""
        for at in range(bisect_left(self.residuals, size), len(self.residuals)):
            left = self.residuals[at]
            fits = [(number, held, clusters) for held, bins in self.by[left].items() if not held & source for clusters, number in bins if not clusters & cluster]
            if fits:
                number, held, clusters = min(fits)
                self.by[left][held].remove((clusters, number))
                if not self.by[left][held]:
                    del self.by[left][held]
                if not self.by[left]:
                    del self.by[left]
                    self.residuals.pop(at)
                self._put(left - size, held | source, clusters | cluster, number)
                return number, self.capacity - left
        number, self.n = self.n, self.n + 1
        self._put(self.capacity - size, source, cluster, number)
        return number, 0


def pack_rows(rows: list[tuple[int, object, object]], capacity: int) -> list[tuple[int, int]]:
    """Packs (size, source, cluster) rows in the order given. A null source or cluster conflicts with nothing."""
    sources: dict[object, int] = {}
    times: dict[object, int] = {}
    for _, _, c in rows:
        times[c] = times.get(c, 0) + 1
    clusters: dict[object, int] = {}
    bins, out = Bins(capacity), []
    for size, s, c in rows:
        source = 0 if s is None else 1 << sources.setdefault(s, len(sources))
        cluster = 0 if c is None or times[c] < 2 else 1 << clusters.setdefault(c, len(clusters))
        out.append(bins.place(size, source, cluster))
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, id_col: str = "doc_id", length_col: str = "n_tokens", source_col: str = "source", cluster_col: str = "cluster") -> DataFrame:
    """(doc_id, piece, start, n_tokens, bin_id, offset) for each piece of each document.

    A document longer than a bin is cut: whole bins first, each closed at once, then the
    rest, which is packed. Documents of no tokens, or of null length, get one piece of
    length 0 with null bin and offset. No bin holds two pieces of one source or of one
    cluster; null sources and clusters conflict with nothing. Ties go to the smaller id,
    then the oldest bin; rows with one id are packed each on its own. Null ids are packed
    like others. Empty input gives an empty result; other columns are not read. bin_id is
    'shard:number', so bins of different shards never mix.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0)).alias("len"), F.col(source_col).cast("string").alias("src"), F.col(cluster_col).cast("string").alias("clu"))
    count = docs.count()
    n_shards = max(1, -(-count // shard))
    d = d.withColumn("shard", F.pmod(F.xxhash64("doc_id", "clu", "len"), F.lit(n_shards)))
    whole = F.floor(F.col("len") / capacity).cast("long")
    full = d.where(F.col("len") >= capacity).select("*", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("piece"))
    full = full.select("doc_id", "piece", (F.col("piece") * capacity).alias("start"), F.lit(capacity).cast("long").alias("n_tokens"), F.concat_ws(":", F.lit("full"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "piece").alias("bin_id"), F.lit(0).cast("long").alias("offset"))
    none = d.where("len = 0").select("doc_id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("long").alias("offset"))
    rest = d.withColumn("piece", whole).withColumn("n_tokens", F.col("len") % capacity).where("n_tokens > 0")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "clu", "src"], ascending=[False, True, True, True], kind="stable")
        text = lambda v: None if v is None or v != v else v
        got = pack_rows([(int(n), text(s), text(c)) for n, s, c in zip(pdf.n_tokens, pdf.src, pdf.clu, strict=True)], capacity)
        return pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "piece": pdf.piece, "start": pdf.piece * capacity, "n_tokens": pdf.n_tokens, "bin_id": [f"{key[0]}:{b}" for b, _ in got], "offset": [o for _, o in got]})

    packed = rest.select("shard", "doc_id", "piece", "n_tokens", "src", "clu").groupBy("shard").applyInPandas(run, "doc_id long, piece long, start long, n_tokens long, bin_id string, offset long")
    return packed.unionByName(full).unionByName(none)
