"""Helpers shared by the corpus operators: words, hashes, staging in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from orrery.sources.tables import table  # noqa: F401
from orrery.staging import stage  # noqa: F401

#: Bytes of text that a Python worker works on at a time.
SLICE_BYTES = 2 << 20

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null counts as empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space: bytes.lower and bytes.split do exactly this."""
    return utf8(text).lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array of hashes."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), dtype=np.uint64, count=len(tokens))


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, sizes, hashes): the words of all texts as places in `hashes`, the sorted hashes of the distinct ones, and the words in each text.

    The same words and hashes as words() and word_hashes(), cut and coded in Arrow, so that
    only distinct words are hashed one by one. Null counts as empty.
    """
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    coded = cut.flatten().dictionary_encode()
    codes, kept = coded.indices.to_numpy(), coded.dictionary.cast(pa.binary()).to_pylist()
    owner = np.repeat(np.arange(len(cut)), np.diff(cut.offsets.to_numpy()))
    # White space at either end of a text leaves an empty word there.
    if b"" in kept:
        at = kept.index(b"")
        real = codes != at
        codes, owner = codes[real], owner[real]
        codes = codes - (codes > at)
        del kept[at]
    hashes = word_hashes(kept)
    order = np.argsort(hashes)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[codes], np.bincount(owner, minlength=len(cut)), hashes[order]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each slice holds about `limit` bytes of one text column."""
    for batch in batches:
        col = batch.column(column)
        start, held = 0, 0
        sizes = np.nan_to_num(np.asarray(pc.binary_length(col).to_numpy(zero_copy_only=False), dtype=float))
        for i, n in enumerate(sizes):
            held += n + 64
            if held >= limit:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)
