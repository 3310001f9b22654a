"""Hard negatives: exact searches under an orthogonal PCA rotation, with integer scores.

Vectors become integers, and an orthogonal rotation orders their directions by how much of all
squared length lies there. An inner product is summed over leading components, a few at a time;
what is left is at most the product of the two residual norms (Cauchy-Schwarz) plus a slack for
rounding. Pairs that cannot reach what their anchor still needs are discarded early, and the
integer product of the survivors decides.

Rows lie in blocks of bounded size, sorted by groups of labels. Anchors are sent to the blocks:
first to those of their label for positives, then to all for negatives. A task holds one block
and lets the anchors stream by; it reports at most a few rows for an anchor and block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import stage

#: Fixed values of the task: scale of the components, positives of an anchor, negatives of a positive, and the window in hundredths.
SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
#: Rows of a block at most on average, groups that labels are hashed into, anchors that meet a block at a time.
BLOCK, GROUPS, ASKED = 1 << 16, 4096, 512
#: Rows of a block that are scored first, whole, to bound what the rest must reach; rows scored at a time.
FIRST, AT_ONCE = 1024, 8192
#: Shares of the components after which partial products are looked at.
CUTS = (0.25, 0.5, 0.75)
_NONE = np.iinfo(np.int64).max


def integer_rows(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, x): components as floor(256 x). Null ids, labels, vectors, null and non-finite parts are out; of rows with one id the first by label, then vector, counts."""
    d = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    d = d.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    d = d.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * SCALE)).alias("x"))
    return d.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("row")).select("vec_id", "row.label", "row.x")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as integers, short ones filled with 0."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if (ends == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(ends), dim), np.int64)
    out[np.arange(dim)[None] < ends[:, None]] = flat
    return out


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """Orthogonal columns, those along which the rows have most squared length first."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            m = _matrix(b.column("x"), dim).astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    sums = rows.select("x").mapInArrow(moments, "i int, row array<double>").groupBy("i").agg(*(F.sum(F.col("row")[j]).alias(f"c{j}") for j in range(dim)))
    m = np.array([list(r)[1:] for r in sums.orderBy("i").collect()], float).reshape(-1, dim)
    if len(m) < dim or not np.isfinite(m).all() or not dim:
        return np.eye(dim)
    return np.linalg.eigh(m / max(1.0, np.abs(m).max()))[1][:, ::-1]


class Block:
    """The rows of one block, rotated, with the norms of what is left behind each cut."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, turn: np.ndarray, wide: bool) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.x, self.turn, self.wide = ids[order], labels[order], x[order], turn, wide
        self.dim = x.shape[1]
        self.cuts = sorted({int(self.dim * c) for c in CUTS} - {0, self.dim})
        self.z, self.left, self.norm = self.rotated(self.x)

    def rotated(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        f = x.astype(float)
        z = f @ self.turn
        left = np.stack([np.sqrt((z[:, c:] ** 2).sum(1)) for c in self.cuts], 1) if self.cuts else np.zeros((len(x), 0))
        return z, left, np.sqrt((f**2).sum(1))

    def exact(self, x: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Integer products of anchors x[a] with rows r; those beyond a long are set to its ends."""
        if not self.wide:
            return np.einsum("ij,ij->i", x[a], self.x[r])
        ends = np.iinfo(np.int64)
        return np.array([min(max(sum(int(p) * int(q) for p, q in zip(x[i], self.x[j], strict=True)), ends.min), ends.max) for i, j in zip(a, r, strict=True)], np.int64)

    def survivors(self, x: np.ndarray, rot: tuple[np.ndarray, np.ndarray, np.ndarray], rows: slice, need: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of the wanted pairs whose score may be `need` or more, all others discarded on the way."""
        z, left, norm = rot
        # Rotating and summing in doubles errs by less than this share of the norms' product.
        slack = 16 * (self.dim + 2) ** 1.5 * np.finfo(float).eps * norm[:, None] * self.norm[None, rows] + 1e-6
        partial, at, alive = np.zeros(wanted.shape), 0, wanted
        pairs = None
        for k, cut in enumerate(self.cuts):
            if pairs is None:
                partial = partial + z[:, at:cut] @ self.z[rows, at:cut].T
                alive = alive & (partial + left[:, k, None] * self.left[None, rows, k] + slack >= need[:, None])
                if alive.sum() * 8 < alive.size:
                    a, r = np.nonzero(alive)
                    pairs = a, r, partial[a, r]
            else:
                a, r, p = pairs
                p = p + np.einsum("ij,ij->i", z[a, at:cut], self.z[rows][r, at:cut])
                keep = p + left[a, k] * self.left[rows][r, k] + slack[a, r] >= need[a]
                pairs = a[keep], r[keep], p[keep]
            at = cut
        a, r, p = pairs if pairs is not None else (*np.nonzero(alive), None)
        if p is None:
            # Too many are left to take pair by pair: the last components of all.
            partial = partial + z[:, at:] @ self.z[rows, at:].T
            a, r = np.nonzero(alive & (partial + slack >= need[:, None]))
        r = r + rows.start
        score = self.exact(x, a, r)
        keep = score >= need[a]
        return a[keep], r[keep], score[keep]


def _best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each group's k best: highest score, then smallest id."""
    order = np.lexsort((ids, -score, group)) if not len(score) or score.min() > np.iinfo(np.int64).min else np.lexsort((ids, -score.astype(object), group))
    g = group[order]
    start = np.concatenate([[0], np.flatnonzero(np.diff(g)) + 1]) if len(g) else np.empty(0, np.int64)
    return order[np.arange(len(g)) - np.repeat(start, np.diff([*start, len(g)])) < k]


def _pieces(n: int) -> Iterator[slice]:
    """A block's rows: a first piece for a bound, then the rest."""
    if n:
        yield slice(0, min(FIRST, n))
        for lo in range(FIRST, n, AT_ONCE):
            yield slice(lo, min(lo + AT_ONCE, n))


def positives_in(block: Block, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, vec_id, score): each anchor's k best other rows of its label in the block."""
    rot, got = block.rotated(x), (np.empty(0, np.int64),) * 3
    need = np.full(len(ids), np.iinfo(np.int64).min).astype(float)
    for rows in _pieces(len(block.ids)):
        wanted = (labels[:, None] == block.labels[None, rows]) & (ids[:, None] != block.ids[None, rows])
        if not wanted.any():
            continue
        a, r, s = block.survivors(x, rot, rows, need, wanted)
        got = tuple(np.concatenate(p) for p in zip(got, (a, block.ids[r], s), strict=True))
        keep = _best(*(got[0], got[2], got[1]), k)
        got = tuple(p[keep] for p in got)
        full = np.bincount(got[0], minlength=len(ids)) == k
        worst = np.full(len(ids), np.inf)
        np.minimum.at(worst, got[0], got[2].astype(float))
        need = np.where(full, np.nextafter(worst, -np.inf), need)
    return got


def negatives_in(block: Block, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, window, vec_id, score): for each of an anchor's windows the k best rows of other labels that score from low to high there."""
    rot, windows = block.rotated(x), low.shape[1]
    got = (np.empty(0, np.int64),) * 3
    floor = np.where(low <= high, low.astype(float), np.inf)
    for rows in _pieces(len(block.ids)):
        need = floor.min(1) if windows else np.full(len(ids), np.inf)
        wanted = (labels[:, None] != block.labels[None, rows]) & (need < np.inf)[:, None]
        if not wanted.any():
            continue
        a, r, s = block.survivors(x, rot, rows, need, wanted)
        for w in range(windows):
            fits = (low[a, w] <= s) & (s <= high[a, w])
            got = tuple(np.concatenate(p) for p in zip(got, (a[fits] * windows + w, block.ids[r[fits]], s[fits]), strict=True))
        keep = _best(got[0], got[2], got[1], k)
        got = tuple(p[keep] for p in got)
        full = np.bincount(got[0], minlength=len(ids) * windows) == k
        worst = np.full(len(ids) * windows, np.inf)
        np.minimum.at(worst, got[0], got[2].astype(float))
        floor = np.where(full, np.nextafter(worst, -np.inf), floor.ravel()).reshape(floor.shape)
    return got[0] // max(windows, 1), got[0] % max(windows, 1), got[1], got[2]


def _streamed(batches: Iterator[pa.RecordBatch], dim: int, turn: np.ndarray, wide: bool, meet) -> Iterator[pa.RecordBatch]:
    """Blocks in order, each one's rows before its anchors: rows are held, anchors go by in portions."""
    key, held, block = None, [], None
    for batch in batches:
        keys, kinds = batch.column("block").to_numpy(), batch.column("anchor").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero((np.diff(keys) != 0) | (np.diff(kinds.astype(np.int8)) != 0)) + 1), len(keys)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if lo == hi:
                continue
            if keys[lo] != key:
                key, held, block = keys[lo], [], None
            part = batch.slice(lo, hi - lo)
            if not kinds[lo]:
                held.append((part.column("vec_id").to_numpy(), part.column("label").to_numpy(), _matrix(part.column("x"), dim)))
                continue
            if block is None:
                block = Block(*(np.concatenate(c) for c in zip(*held, strict=True)), turn, wide) if held else Block(np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, dim), np.int64), turn, wide)
                held = []
            for at in range(0, part.num_rows, ASKED):
                own = part.slice(at, ASKED)
                found = meet(block, own)
                if found.num_rows:
                    yield found


def hard_negatives(vectors: DataFrame, anchors: str, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors(vec_id, label, x); `anchors` is a condition on vec_id.

    x are integers (integer_rows makes them). An anchor's positives are its best other rows of
    the same label, all if fewer; the negatives of a positive are the best rows of other labels
    with low * positive_score <= 100 * negative_score <= high * positive_score, ranked from 1.
    Equal scores go by vec_id. Anchors without positives, and positives without rows in their
    window (always so for negative positive_score), give no rows. Vectors of different lengths
    are filled with zeros; scores beyond a long are set to its ends. Empty input gives an empty
    result; other columns are not read. Repeated ids must have been merged, as integer_rows does.
    """
    spark = vectors.sparkSession
    rows = stage(vectors.select("vec_id", "label", "x"), "vectors")
    sizes = rows.agg(F.count("*"), F.max(F.size("x")), F.max(F.greatest(F.abs(F.coalesce(F.array_max("x"), F.lit(0))), F.abs(F.coalesce(F.array_min("x"), F.lit(0))))), F.count(F.when(F.expr(f"exists(x, y -> y = {-(1 << 63) + 1} - 1)"), 1))).first()
    n, dim, largest = sizes[0], max(sizes[1] or 0, 1), sizes[2] or 0
    wide = bool(sizes[3]) or largest * largest * dim >= 1 << 62
    turn = rotation(rows, dim)
    # Blocks lie along label groups; the table of groups has GROUPS rows at most.
    n_blocks = max(-(-n // block), min(spark.sparkContext.defaultParallelism, -(-n // FIRST)), 1)
    group = F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int")
    counts = sorted((r.g, r.n) for r in rows.groupBy(group.alias("g")).agg(F.count("*").alias("n")).collect())
    spans, at = [], 0
    for g, k in counts:
        spans.append((g, at, k, at * n_blocks // n, (at + k - 1) * n_blocks // n))
        at += k
    spread = F.broadcast(spark.createDataFrame(spans, "g int, at long, k long, first int, last int"))
    placed = rows.withColumn("g", group).join(spread, "g")
    place = F.expr(f"CAST((at + pmod(xxhash64(vec_id), k)) * {n_blocks} DIV {n} AS INT)")
    members = placed.select(place.alias("block"), F.lit(False).alias("anchor"), "vec_id", "label", "x", F.lit(None).cast("array<long>").alias("low"), F.lit(None).cast("array<long>").alias("high"))
    asked = placed.where(anchors)

    def met(questions: DataFrame, meet, ddl: str) -> DataFrame:
        """Each block's rows, then the anchors sent to it, to one task."""
        both = members.unionByName(questions.select("block", F.lit(True).alias("anchor"), "vec_id", "label", "x", "low", "high"))
        dealt = both.repartitionById(n_blocks, F.col("block")).sortWithinPartitions("block", "anchor")
        return dealt.mapInArrow(lambda batches: _streamed(batches, dim, turn, wide, meet), ddl)

    def near(b: Block, own: pa.RecordBatch) -> pa.RecordBatch:
        ids = own.column("vec_id").to_numpy()
        a, i, s = positives_in(b, ids, own.column("label").to_numpy(), _matrix(own.column("x"), dim), positives)
        return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(i), pa.array(s)], ["anchor_id", "positive_id", "positive_score"])

    def far(b: Block, own: pa.RecordBatch) -> pa.RecordBatch:
        ids = own.column("vec_id").to_numpy()
        lo, hi = np.full((len(ids), positives), _NONE), np.full((len(ids), positives), -_NONE)
        for out, name in ((lo, "low"), (hi, "high")):
            col = own.column(name)
            out[np.arange(positives)[None] < np.diff(col.offsets.to_numpy())[:, None]] = col.flatten().to_numpy()
        a, w, i, s = negatives_in(b, ids, own.column("label").to_numpy(), _matrix(own.column("x"), dim), lo, hi, negatives)
        return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(w.astype(np.int32)), pa.array(i), pa.array(s)], ["anchor_id", "w", "negative_id", "negative_score"])

    none = F.lit(None).cast("array<long>")
    first = met(asked.select(F.explode(F.sequence("first", "last")).alias("block"), "vec_id", "label", "x", none.alias("low"), none.alias("high")), near, "anchor_id long, positive_id long, positive_score long")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    chosen = stage(first.withColumn("w", F.row_number().over(best) - 1).where(F.col("w") < positives), "positives")
    # low * p <= 100 s <= high * p, as bounds of s that are whole numbers.
    bounds = chosen.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("w", F.expr(f"CAST(ceil(CAST(positive_score AS DECIMAL(38,0)) * {low} / 100) AS LONG)").alias("lo"), F.expr(f"CAST(floor(CAST(positive_score AS DECIMAL(38,0)) * {high} / 100) AS LONG)").alias("hi")))).alias("b"))
    windows = asked.join(bounds, asked.vec_id == bounds.anchor_id).select("vec_id", "label", "x", F.col("b.lo").alias("low"), F.col("b.hi").alias("high"))
    second = met(windows.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "*"), far, "anchor_id long, w int, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "w").orderBy(F.desc("negative_score"), "negative_id"))
    kept = second.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return kept.join(chosen, ["anchor_id", "w"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
