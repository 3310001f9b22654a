"""Audio features of 8-bit samples: polyphase resampling, log-mel frames, energy segments.

Stored media are mono 8-bit WAV files. Features are log-mel windows of one fixed shape,
(WINDOW frames, MELS), stored as an Arrow column of fixed-shape tensors with their time spans,
and activity segments by two energy thresholds. sounds() makes both, audio_table() stores them
and works on what it reads back. Spectra are made in blocks of frames, so beside a text, its file
and its tensors (an eighth of its bytes, a window at least) memory doesn't grow with length.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import slices, stage, utf8

RATE, UP, DOWN, TAPS = 8000, 4, 5, 8
OUT_RATE = RATE * UP // DOWN
FRAME, HOP, MELS, WINDOW = 256, 128, 16, 64
#: Decibels above FLOOR at which a segment begins and below which it ends, of a frame without its mean. Of frames of
#: prose nine in ten rise to the first and one in a hundred falls below the second; runs of one character, rules and
#: plain digits lie well below.
RISE, FALL, FLOOR = 105.0, 103.8, 1e-10
BLOCK = 1024


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes padded with zeros to a positive multiple of 64; null counts as empty."""
    raw = utf8(text)
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def _filter() -> np.ndarray:
    """Low-pass windowed sinc, one row of TAPS for each of UP phases, each of unit gain."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.hamming(n)
    rows = h.reshape(TAPS, UP).T
    return (rows / rows.sum(axis=1, keepdims=True)).astype(np.float32)


def _mel() -> np.ndarray:
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(to_mel(60), to_mel(OUT_RATE / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / OUT_RATE)
    lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid))).astype(np.float32).T


_POLY, _BANK, _HANN = _filter(), _mel(), np.hanning(FRAME).astype(np.float32)


def resampled_length(n: int) -> int:
    return -(-n * UP // DOWN)


def resample(x: np.ndarray, start: int, end: int) -> np.ndarray:
    """Outputs start..end of x (8-bit samples) at UP / DOWN times the rate; silence around x."""
    first = start * DOWN // UP - TAPS + 1
    last = (end - 1) * DOWN // UP + 1
    part = np.zeros(last - first, np.float32)
    a, b = max(first, 0), min(last, len(x))
    if a < b:
        part[a - first : b - first] = (x[a:b].astype(np.float32) - 128) / 128
    views = sliding_window_view(part, TAPS)
    out = np.empty(end - start, np.float32)
    for r in range(min(UP, end - start)):
        n = np.arange(start + r, end, UP)
        at = n * DOWN // UP - TAPS + 1 - first
        out[r::UP] = views[at[0] : at[-1] + 1 : DOWN] @ _POLY[n[0] * DOWN % UP][::-1]
    return out


def log_mel(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (log-mel frames in hundredths of log10, frame energies in dB). At least one frame; the last ones reach into silence."""
    total = resampled_length(len(x))
    frames = max(1, -(-max(0, total - FRAME) // HOP) + 1)
    for f in range(0, frames, BLOCK):
        k = min(BLOCK, frames - f)
        y = resample(x, f * HOP, (f + k - 1) * HOP + FRAME)
        frame = sliding_window_view(y, FRAME)[::HOP]
        p = np.fft.rfft(frame * _HANN, axis=1)
        power = p.real**2 + p.imag**2
        v = (frame - frame.mean(axis=1, keepdims=True)) * _HANN
        yield np.rint(100 * np.log10(power @ _BANK + FLOOR)).astype(np.int16), 10 * np.log10((v * v).sum(axis=1) + FLOOR)


def segments(db: np.ndarray) -> np.ndarray:
    """[start, end) frames of activity: on from RISE dB over the floor, off below FALL."""
    level = db - 10 * np.log10(FLOOR)
    mark = np.where(level >= RISE, 1, np.where(level < FALL, -1, 0))
    at = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.where(at >= 0, mark[at], -1) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return edge.reshape(-1, 2)


KIND = pa.fixed_shape_tensor(pa.int16(), (WINDOW, MELS))
SCHEMA = pa.schema([pa.field("mel", KIND), pa.field("start_s", pa.float64()), pa.field("end_s", pa.float64())])


def seconds(frames: np.ndarray | int) -> np.ndarray | float:
    return frames * (HOP / OUT_RATE)


def write_tensors(mel: np.ndarray) -> bytes:
    """An Arrow stream of windows of log-mel frames with their time spans; the last window is filled up with the floor."""
    n = -(-len(mel) // WINDOW)
    full = np.full((n * WINDOW, MELS), round(100 * np.log10(FLOOR)), np.int16)
    full[: len(mel)] = mel
    at = np.arange(n) * WINDOW
    last = np.minimum(at + WINDOW, len(mel)) - 1
    store = pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1)), WINDOW * MELS)
    cols = [pa.ExtensionArray.from_storage(KIND, store), pa.array(seconds(at)), pa.array(seconds(last) + FRAME / OUT_RATE)]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, SCHEMA) as out:
        out.write_batch(pa.RecordBatch.from_arrays(cols, schema=SCHEMA))
    return sink.getvalue().to_pybytes()


def read_tensors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(windows as (n, WINDOW, MELS) hundredths of log10, spans as (n, 2) seconds) of stored tensors."""
    table = pa.ipc.open_stream(data).read_all().combine_chunks()
    mel = table.column("mel").chunk(0).to_numpy_ndarray()
    return mel, np.stack([table.column(c).to_numpy() for c in ("start_s", "end_s")], axis=1)


def frames_of(data: bytes) -> np.ndarray:
    """The log-mel frames of stored tensors, without what fills up the last window."""
    mel, spans = read_tensors(data)
    rest = round((spans[-1, 1] - spans[-1, 0] - FRAME / OUT_RATE) * OUT_RATE / HOP) + 1
    return mel.reshape(-1, MELS)[: (len(mel) - 1) * WINDOW + rest]


def listen(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(log-mel frames, [start, end) frames of activity) of 8-bit samples."""
    mel, db = (np.concatenate(p) for p in zip(*log_mel(np.frombuffer(payload, np.uint8)), strict=True))
    return mel, segments(db)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def sounds(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media, tensors, segments): each text's file, log-mel tensors (read_tensors) and active time spans.

    One row for each row of docs. Ids are integers. Null and empty texts are 64 zero bytes with
    n_bytes 0. Repeated rows and null ids each give a row; other columns are not read; empty
    input gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            rows = []
            for text in batch.column("text").to_pylist():
                media = to_wav(payload_of(text))
                mel, active = listen(from_wav(media))
                spans = [{"start_s": a, "end_s": b} for a, b in zip(seconds(active[:, 0]).tolist(), (seconds(active[:, 1] - 1) + FRAME / OUT_RATE).tolist(), strict=True)]
                rows.append((len(utf8(text)), media, write_tensors(mel), spans))
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "n_bytes", "media", "tensors", "segments"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary, tensors binary, segments array<struct<start_s double, end_s double>>")


def digest(tensors: bytes, spans: list[dict[str, float]]) -> str:
    """frames:segments:active milliseconds:SHA-256 of the log-mel values in hundredths, from stored tensors and spans."""
    mel = frames_of(tensors)
    active = sum(round(1000 * (s["end_s"] - s["start_s"])) for s in spans)
    return f"{len(mel)}:{len(spans)}:{active}:{hashlib.sha256(mel.astype('<i2').tobytes()).hexdigest()}"


def audio_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature).

    sounds() of docs, stored in the shared folder; all but n_bytes comes from the files and
    tensors that are read back from there. Nulls, empties, repeats and clashes as in sounds().
    """
    stored = stage(sounds(docs, id_col, text_col), "sounds", compression="zstd")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", 1 << 20):
            rows = []
            for media, tensors, spans in zip(*(batch.column(c).to_pylist() for c in ("media", "tensors", "segments")), strict=True):
                payload = from_wav(media)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), digest(tensors, spans)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *cols], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
