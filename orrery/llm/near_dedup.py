"""MinHash near-duplicate groups with tensored banding.

Two small collections of hash triples, A and B, are computed per document. Table (i, j)
of the LSH index is keyed by the pair (A_i, B_j), so m * m tables cost only 2 * m triples
of minhashes. Documents meet when some A and some B collide. All candidate links are
confirmed on the full shingle sets.

How groups stay cheap without losing links:

* Equal shingle sets become one class first (a 128-bit digest of the set).
* The rows that travel are (A_i, all B of the document); a document goes on only if its
  A_i is shared, and then fans out into the tables of that A_i inside its partition.
* In each bucket every member is first compared with the smallest member only. Confirmed
  links are contracted to components, so a group of n copies costs n links, not n * n.
* Members of one bucket that are then still in different components are compared with each
  other, but only where their rarest shingles meet (the prefix filter, which is exact),
  the shingles that each has alone leave room for a link, and a one-byte-per-hash sketch
  agrees (its cut loses a true link with probability below 1e-9). Where both have been
  compared with the same smallest member, the prefix filter takes their differences from
  it instead of whole sets, so a group of loose copies is not multiplied out.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import mix, slices, stage, word_hashes, words
from orrery.llm.components import components

#: Triples in each of the two collections, and minhashes in a triple. At a similarity of
#: 0.8 a pair misses all m * m tables with probability 2 * (1 - 0.8 ** 3) ** 14 < 1e-4,
#: at 0.85 below 4e-6.
COLLECTION, HALF = 14, 3
#: Words of 64 bits in the filter of ids whose sets are wanted: at most 8 MB of keys and bits to broadcast.
FILTER_WORDS = 1 << 19
#: Bytes of an Arrow batch that goes to a Python worker: rows with two sets each would else be gathered by the ten thousand.
BATCH = "4m"
_ROUND = np.uint64(0x9E3779B97F4A7C15)


def _staged(df: DataFrame, name: str) -> DataFrame:
    return stage(df, name, batch=BATCH)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    Fewer words than `width`: the whole sequence is one shingle; no words: empty.
    """
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    h = word_hashes(w)
    k = min(width, len(h))
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = mix(out * _ROUND + np.uint64(i)) ^ h[i : len(h) - k + 1 + i]
    return np.unique(mix(out + np.uint64(k)))


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    draw = lambda: r.integers(0, 2**63, n, dtype=np.uint64)
    return draw() * np.uint64(2) + np.uint64(1), draw() ^ (draw() << np.uint64(1))


def minhashes(shingles: np.ndarray, n: int) -> np.ndarray:
    """n minima of multiplicative hashes over a non-empty set, in blocks of bounded size."""
    a, b = _FAMILIES.setdefault(n, _family(n))
    best = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(shingles), 2048):
        best = np.minimum(best, ((shingles[None, s : s + 2048] ^ b[:, None]) * a[:, None]).min(axis=1))
    return best


_FAMILIES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def band_keys(mins: np.ndarray, half: int) -> np.ndarray:
    """One 64-bit key for each run of `half` minhashes; the run's place is part of the key."""
    rows = mins.reshape(-1, half)
    key = np.arange(1, len(rows) + 1, dtype=np.uint64) * _ROUND
    for c in range(half):
        key = mix(key ^ rows[:, c]) * _ROUND
    return mix(key)


def sketch_cut(n: int, percent: int, loss: float = 1e-9) -> int:
    """The largest count t with P(fewer than t of n minhashes agree) < loss at the least similarity."""
    p, below, t = percent / 100, 0.0, 0
    while t < n and (below := below + comb(n, t) * p**t * (1 - p) ** (n - t)) < loss:
        t += 1
    return t


def signatures(docs: DataFrame, width: int, m: int, half: int) -> DataFrame:
    """(doc_id, n, s1, s2, a, b, sk) for each row of docs(doc_id, text)."""
    n_hash = 2 * m * half

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n, s, a, b, sk = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                x = shingle_set(text, width)
                n.append(len(x))
                d = xxhash.xxh3_128_intdigest(x.tobytes())
                s.append(((d >> 64) - 2**63, (d & (2**64 - 1)) - 2**63))
                if len(x):
                    mins = minhashes(x, n_hash)
                    keys = band_keys(mins, half)
                    a.append(keys[:m].view(np.int64))
                    b.append(keys[m:].view(np.int64) >> 32)
                    sk.append((mins & np.uint64(255)).astype(np.uint8).tobytes())
                else:
                    a.append([]), b.append([]), sk.append(b"")
            s1, s2 = zip(*s, strict=True) if s else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(a, pa.list_(pa.int64())), pa.array(b, pa.list_(pa.int32())), pa.array(sk, pa.binary())],
                ["doc_id", "n", "s1", "s2", "a", "b", "sk"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, a array<long>, b array<int>, sk binary")


def _shared_fit(percent: int) -> str:
    """An exact bound: sets of nx and ny shingles, of which sx and sy occur elsewhere, have at most least(sx, sy) in common."""
    return f"100 * least(sx, sy) >= {percent} * (nx + ny - least(sx, sy))"


def _sketches_fit(pairs: DataFrame, sketches: DataFrame, cut: int) -> DataFrame:
    """Pairs (x, y) whose sketches agree in at least `cut` places."""
    both = pairs.join(sketches.select(F.col("doc_id").alias("x"), F.col("sk").alias("kx")), "x").join(sketches.select(F.col("doc_id").alias("y"), F.col("sk").alias("ky")), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            kx, ky = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("kx", "ky"))
            keep = pa.array((kx == ky).sum(axis=1) >= cut)
            yield batch.select(["x", "y"]).filter(keep)

    return both.select("x", "y", "kx", "ky").mapInArrow(run, "x long, y long")


def _set_table(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, items): the sorted shingle set as bytes, made once per document that has candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            items = [shingle_set(text, width).tobytes() for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(items, pa.binary())], ["doc_id", "items"])

    return docs.mapInArrow(run, "doc_id long, items binary")


def _likely(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose id may be in ids (all that are, and some others), without a shuffle of texts.

    A Bloom filter of one hash: FILTER_WORDS words of 64 bits, made by an aggregation and
    broadcast as a table of at most FILTER_WORDS rows of two numbers, however many ids there are.
    """
    place = [f"CAST(pmod(h, {FILTER_WORDS}) AS LONG) AS w", "shiftleft(1L, CAST(shiftrightunsigned(h, 58) AS INT)) AS bit"]
    words_ = ids.select(F.xxhash64("doc_id").alias("h")).selectExpr(*place).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    marked = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).selectExpr("doc_id", "text", *place)
    return marked.join(F.broadcast(words_), "w").where("bits & bit <> 0").select("doc_id", "text")


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y, common, total): exact sizes of intersection and union of each pair's shingle sets."""
    both = pairs.join(sets.select(F.col("doc_id").alias("x"), F.col("items").alias("tx")), "x").join(sets.select(F.col("doc_id").alias("y"), F.col("items").alias("ty")), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, total = [], []
            for tx, ty in zip(batch.column("tx"), batch.column("ty"), strict=True):
                left, right = (np.frombuffer(v.as_buffer(), np.uint64) for v in (tx, ty))
                at = np.minimum(np.searchsorted(right, left), len(right) - 1)
                common.append(int((right[at] == left).sum()))
                total.append(len(left) + len(right) - common[-1])
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(common, pa.int64()), pa.array(total, pa.int64())], ["x", "y", "common", "total"])

    return both.select("x", "y", "tx", "ty").mapInArrow(run, "x long, y long, common long, total long")


def _in_several(rows: DataFrame, group: str, *key: str) -> DataFrame:
    """Rows whose key occurs in more than one group.

    Keys are summed up before the shuffle, and rows meet them in a join, which Spark splits
    where one key holds too many rows; a window would hold all rows of a key in one task.
    """
    keys = rows.groupBy(*key).agg(F.min(group).alias("_g0"), F.max(group).alias("_g1")).where("_g0 <> _g1").select(*key)
    return rows.join(keys, list(key), "left_semi")


def _main(rows: DataFrame, group: str, *key: str) -> DataFrame:
    """Adds main: the group with most rows of a key, so that only the others need meet everything."""
    sized = rows.groupBy(*key, group).agg(F.count("*").alias("_n"))
    most = sized.groupBy(*key).agg(F.max(F.struct("_n", group))[group].alias("main"))
    return rows.join(most, list(key))


def _prefixes(docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(d, n, g, c, tok, s): the rarest shingles of each document, as many as any link needs.

    Two sets with 100 * common >= percent * union share a shingle among the first
    n - ceil(percent * n / 100) + 1 of each, in any order common to all; here rare ones
    come first. A document with that many shingles of its own can't have a link.
    s counts the document's shingles that another document of `docs` has too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "items"):
            items = [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column("items")]
            sizes = [len(x) for x in items]
            out = [np.repeat(batch.column(c).to_numpy(), sizes) for c in ("d", "n", "g", "c")]
            yield pa.RecordBatch.from_arrays([*map(pa.array, out), pa.array(np.concatenate(items))], ["d", "n", "g", "c", "tok"])

    flat = docs.join(sets.withColumnRenamed("doc_id", "d"), "d").select("d", "n", "g", "c", "items").mapInArrow(run, "d long, n long, g long, c long, tok long")
    seen = flat.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
    ranked = flat.join(seen, "tok").withColumn("r", F.row_number().over(Window.partitionBy("d").orderBy("df", "tok"))).withColumn("shared", F.count("*").over(Window.partitionBy("d")))
    return ranked.where(f"n - shared + r <= n - ceil({percent} * n / 100.0D - 1e-9D) + 1").select("d", "n", "g", "c", "tok", F.col("shared").alias("s"))


def _apart(docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (x, y) with one centre c but different components, from docs(d, n, g, c, e, nc).

    e is the size of the symmetric difference of the sets of d and c, nc the size of c's
    set. With k = (100 - percent) / (100 + percent), two sets are linked when their
    difference has at most h = k * (nx + ny) shingles, so their differences from the
    centre have at least (ex + ey - h) / 2 in common. At least one of the two is not
    linked with the centre (else they would be in one component), that is e > k * (n + nc);
    so what they have in common is never nothing, and the prefix filter works on the
    differences: short, and distinct where all members of a group share most of their text.
    """
    k = (100 - percent) / (100 + percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "items"):
            found = []
            for own, centre in zip(batch.column("items"), batch.column("centre"), strict=True):
                x, r = (np.frombuffer(v.as_buffer(), np.uint64) for v in (own, centre))
                found.append((np.setdiff1d(x, r, True), np.setdiff1d(r, x, True)))
            sizes = [len(x) + len(y) for x, y in found]
            out = [np.repeat(batch.column(c).to_numpy(), sizes) for c in ("d", "n", "g", "c", "e", "nc")]
            tok = np.concatenate([v for pair in found for v in pair]).view(np.int64)
            lost = np.concatenate([np.repeat([0, 1], [len(x), len(y)]) for x, y in found]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*map(pa.array, out), pa.array(tok), pa.array(lost)], ["d", "n", "g", "c", "e", "nc", "tok", "lost"])

    both = docs.join(sets.withColumnRenamed("doc_id", "d"), "d").join(sets.select(F.col("doc_id").alias("c"), F.col("items").alias("centre")), "c")
    flat = both.select("d", "n", "g", "c", "e", "nc", "items", "centre").mapInArrow(run, "d long, n long, g long, c long, e long, nc long, tok long, lost long")
    seen = flat.groupBy("c", "tok").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("d")
    ranked = flat.join(seen, ["c", "tok"]).withColumn("r", F.row_number().over(own.orderBy("df", "tok")))
    ranked = ranked.withColumn("sl", F.sum("lost").over(own)).withColumn("sg", F.sum(1 - F.col("lost")).over(own)).withColumn("far", F.expr(f"e > {k!r}D * (n + nc) + 1e-9D"))
    # At least so much in common with any partner, and with one that is not linked with the centre.
    ranked = ranked.withColumn("la", F.expr(f"greatest(1, ceil(e - {(100 - percent) / percent!r}D * n - 1e-9D))")).withColumn("lb", F.expr(f"greatest(la, ceil((e + {k!r}D * (nc - n)) / 2 - 1e-9D))"))
    ranked = ranked.withColumn("at", F.expr("e - sl - sg + r")).withColumn("strict", F.expr("at <= e - lb + 1")).where("strict OR far AND at <= e - la + 1")
    ranked = _staged(ranked.select("d", "n", "g", "c", "e", "tok", "sl", "sg", "far", "strict"), "apart")
    prefix = _staged(_main(_in_several(ranked, "g", "c", "tok"), "g", "c", "tok"), "apart")
    side = lambda rows, v: rows.select("c", "tok", *[F.col(a).alias(b + v) for a, b in (("d", ""), ("n", "n"), ("g", "g"), ("e", "e"), ("sl", "sl"), ("sg", "sg"), ("far", "far"), ("strict", "strict"))], *["main"] * (v == "y"))
    fits = f"2 * (least(slx, sly) + least(sgx, sgy)) >= ex + ey - {k!r}D * (nx + ny) - 1e-9D AND 100 * least(nx, ny) >= {percent} * greatest(nx, ny)"
    roles = "(farx AND fary AND strictx AND stricty OR farx AND NOT fary AND stricty OR fary AND NOT farx AND strictx)"
    cross = side(prefix.where("g <> main"), "x").join(side(prefix, "y"), ["c", "tok"]).where(f"gx <> gy AND (gy = main OR gx < gy) AND {roles} AND {fits}")
    return cross.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, m: int = COLLECTION, half: int = HALF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate groups: (doc_id, n_shingles, component_id, kept) for each row of docs.

    Two documents are linked when 100 * |intersection| >= percent * |union| of their
    word-shingle sets; groups are the connected components.

    Null or empty texts have no shingles and are linked with nothing. A null id takes no
    part (component_id null, kept true). Rows with one id count as one vertex; repeated
    rows each get a row. Ties need no rule: the smallest id names a group. Empty input
    gives an empty result; other columns are never read, so their names don't matter.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sigs = _staged(signatures(docs, width, m, half), "signatures")
    usable = sigs.where("n > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"))
    rep = _staged(classes, "classes")
    vertex = usable.join(rep.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "s1", "s2"])

    # Tables. A document goes on only where its A_i is shared.
    tall = vertex.select("doc_id", "n", "b", F.explode("a").alias("a"))
    shared = tall.join(tall.groupBy("a").agg(F.count("*").alias("c")).where("c > 1").select("a"), "a", "left_semi")
    tables = shared.select("doc_id", "n", "a", F.posexplode("b").alias("j", "b")).select(F.xxhash64("a", "j", "b").alias("k"), F.col("doc_id").alias("d"), "n")
    tables = _staged(tables, "tables")
    full = tables.groupBy("k").agg(F.count("*").alias("c"), F.min("d").alias("first")).where("c > 1").select("k", "first")
    member = _staged(tables.join(full, "k"), "members")

    cut = sketch_cut(2 * m * half, percent)
    sketches = vertex.select("doc_id", "n", "sk").join(member.select(F.col("d").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sketches = _staged(sketches, "sketches")
    sets = _staged(_set_table(_likely(docs, sketches.select("doc_id")), width), "sets")

    # Every member against the smallest member of its bucket.
    stars = member.where("d <> first").select(F.col("d").alias("x"), F.col("first").alias("y")).distinct()
    stars = _staged(_overlaps(stars, sets), "stars")
    linked = f"100 * common >= {percent} * total"
    links = stars.where(linked).select(F.col("x").alias("u"), F.col("y").alias("v"))
    first = components(links)

    # What stars cannot see: links between members, other than the smallest, of one bucket
    # that are still in different components.
    # Buckets of one smallest member count as one here: a document then has a row for each first member, not
    # for each of its buckets, and what some bucket holds together still lies together.
    held = stars.select(F.col("y").alias("k"), F.col("x").alias("d")).join(first.withColumnRenamed("node", "d"), "d", "left").select("k", "d", F.coalesce("component", "d").alias("g"))
    # Members with one centre (the smallest first member at least half like them) are told apart by
    # their differences from it, others by their rarest shingles.
    near = stars.where("2 * common >= total").groupBy(F.col("x").alias("d")).agg(F.min(F.struct("y", F.expr("total - common").alias("e"), F.expr("total + common").alias("both"))).alias("m"))
    near = near.select("d", F.col("m.y").alias("c"), F.col("m.e").alias("e"), F.col("m.both").alias("both"))
    # An id of several texts has no one set to take differences from.
    several = sketches.groupBy("doc_id").agg(F.count("*").alias("texts")).where("texts > 1").select(F.col("doc_id").alias("d"))
    near = near.join(several, "d", "left_anti").join(several.withColumnRenamed("d", "c"), "c", "left_anti")
    sizes = sketches.select(F.col("doc_id").alias("d"), "n").distinct()
    open_ = _in_several(held, "g", "k").select("d", "g").distinct().join(sizes, "d").join(near, "d", "left")
    open_ = _staged(open_.select("d", "n", "g", F.coalesce("c", "d").alias("c"), "e", F.expr("both - n").alias("nc")), "open")
    prefix = _staged(_prefixes(open_, sets, percent), "prefix")
    keys = prefix.groupBy("tok").agg(F.min("g").alias("g0"), F.max("g").alias("g1"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("g0 <> g1 AND c0 <> c1").select("tok")
    prefix = _staged(_main(prefix.join(keys, "tok", "left_semi"), "c", "tok"), "prefix")
    few = prefix.where("c <> main").select("tok", F.col("d").alias("x"), F.col("n").alias("nx"), F.col("g").alias("gx"), F.col("s").alias("sx"), F.col("c").alias("cx"))
    rest = prefix.select("tok", F.col("d").alias("y"), F.col("n").alias("ny"), F.col("g").alias("gy"), F.col("s").alias("sy"), F.col("c").alias("cy"), "main")
    cross = few.join(rest, "tok").where(f"gx <> gy AND cx <> cy AND (cy = main OR cx < cy) AND {_shared_fit(percent)}")
    cross = cross.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).union(_apart(open_.where("e IS NOT NULL"), sets, percent)).distinct()
    more = _staged(_overlaps(_sketches_fit(cross, sketches, cut), sets), "more").where(linked).select(F.col("x").alias("u"), F.col("y").alias("v"))
    merged = components(links.union(more))

    whole = rep.join(merged.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    # Texts without shingles are no copies of each other, and need no class.
    thin = sigs.select("doc_id", "n", "s1", "s2")
    found = thin.where("n > 0").join(whole, ["s1", "s2"], "left").select("doc_id", "n", "component_id")
    out = found.unionByName(thin.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))
