"""Secret scans: fixed patterns, plus strings that look random to character Markov models.

Two first-order character models, of random strings and of ordinary identifiers, are
trained from labelled samples; a candidate string is a secret when its log-likelihood
ratio per character and in sum are high enough.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orrery.llm.common import slices

#: The base patterns, as the contract of the scan states them.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Order of kinds at equal starts.
KINDS = ("assign", "access", "hex", "random")
#: Words that assignments begin with, in lower case; a text without them has no assignment.
_HINTS = ("passw", "secret", "token", "apikey", "api_key")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_CODE = np.full(256, -1, np.int64)
_CODE[np.frombuffer(_ALPHABET.encode(), np.uint8)] = np.arange(len(_ALPHABET))
#: Nats per character and in sum that a random string must have over an identifier.
PER_CHAR, IN_SUM = 0.6, 20.0
#: Characters of a random string at least; what joins it to others in a run.
SHORTEST, _JOINTS = 20, "/_-=+"

#: Parts that labelled ordinary identifiers are put together from.
PARTS = (
    "get set list item index value name user file path data load save read write open close start stop find make build "
    "node edge graph table column row query filter count total error message request response client server config option "
    "default parse format print text line word token page link image button view model state event handler action update "
    "delete create insert select order group join merge split test case check assert result output input buffer stream "
    "thread process queue stack array string number integer float double boolean object class method function return "
    "the and with from this that have which their would there about other into more some time"
).split()


def labelled_samples(n: int = 4000) -> list[tuple[str, int]]:
    """(string, 1 if random) made by rule: digests in three alphabets, and joined identifier parts."""
    out = []
    for i in range(n):
        h = hashlib.sha512(f"sample {i}".encode()).digest()
        symbols = ("0123456789abcdef", _ALPHABET[:62], _ALPHABET[:64])[i % 3]
        out.append(("".join(symbols[b % len(symbols)] for b in h[: 20 + i % 40]), 1))
        parts = [PARTS[int.from_bytes(h[2 * k : 2 * k + 2]) % len(PARTS)] for k in range(2 + i % 5)]
        style = i % 6
        joined = {0: "_".join(parts), 1: parts[0] + "".join(p.title() for p in parts[1:]), 2: "-".join(parts), 3: "/".join(parts), 4: "_".join(parts).upper(), 5: "".join(parts)}[style]
        out.append((joined + (str(h[-1] % 100) if i % 7 == 0 else ""), 0))
    return out


@lru_cache(maxsize=1)
def models() -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood ratios, random over ordinary: of first characters and of transitions."""
    n = len(_ALPHABET)
    first, step = np.full((2, n), 1.0), np.full((2, n, n), 0.2)
    for text, label in labelled_samples():
        c = _CODE[np.frombuffer(text.encode(), np.uint8)]
        first[label, c[0]] += 1
        np.add.at(step[label], (c[:-1], c[1:]), 1)
    first, step = np.log(first / first.sum(axis=1, keepdims=True)), np.log(step / step.sum(axis=2, keepdims=True))
    return first[1] - first[0], step[1] - step[0]


def looks_random(s: str) -> bool:
    """Letters, and the ratio says random; same-letter runs, words and plain numbers don't pass."""
    if s.strip("0123456789-_=/+") == "":
        return False
    llr = ratios(s).sum()
    return bool(llr >= IN_SUM and llr >= PER_CHAR * len(s))


def ratios(s: str) -> np.ndarray:
    """The log-likelihood ratio of each character after the one before."""
    first, step = models()
    c = _CODE[np.frombuffer(s.encode(), np.uint8)]
    return np.concatenate([[first[c[0]]], step[c[:-1], c[1:]]])


def random_parts(s: str) -> list[tuple[int, int]]:
    """Spans of a run that look random: the run, or else its best windows, so that ordinary words around a key don't hide it.

    A window is grown to the separators around it if it looks random then, too, and is SHORTEST long at least;
    what lies to its left and right is searched in the same way.
    """
    found, todo = [], [(0, len(s))]
    while todo:
        at, end = todo.pop()
        if end - at < SHORTEST:
            continue
        if looks_random(s[at:end]):
            found.append((at, end))
            continue
        total = np.concatenate([[0.0], np.cumsum(ratios(s[at:end]) - PER_CHAR)])
        gain = total[1:] - np.minimum.accumulate(total)[:-1]
        b = int(np.argmax(gain)) + 1
        if gain[b - 1] <= 0:
            continue
        a, b = at + int(np.argmin(total[:b])), at + b
        left, right = max(at, *(s.rfind(ch, at, a) + 1 for ch in _JOINTS)), min(i if (i := s.find(ch, b, end)) >= 0 else end for ch in _JOINTS)
        for x, y in ((left, right), (a, right), (left, b), (a, b)):
            if y - x >= SHORTEST and looks_random(s[x:y]):
                a, b = x, y
                found.append((a, b))
                break
        todo += [(at, a), (b, end)]
    return sorted(found)


def _merged(found: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """What spans cover, as intervals apart from each other, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in found):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind in KINDS' order. Null: none.

    Base matches are leftmost and do not overlap within a kind; those that are too short are
    dropped. Random strings are looked for in what base spans leave of a run; runs and spans are
    walked through once, side by side.
    """
    if not text:
        return []
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS) or not low.isascii():
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    raw = text.encode("utf-8", "surrogatepass")
    if _has_run(raw, _IS_HEX, 24):
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if _has_run(raw, _CODE >= 0, 20):
        taken = _merged(found)
        i = 0
        for m in CANDIDATE.finditer(text):
            at, end = m.span()
            while i < len(taken) and taken[i][1] <= at:
                i += 1
            k = i
            while k < len(taken) and taken[k][0] < end:
                a, b = taken[k]
                found += [("random", at + x, at + y) for x, y in random_parts(text[at : max(at, a)])]
                at = max(at, b)
                k += 1
            found += [("random", at + x, at + y) for x, y in random_parts(text[at : max(at, end)])]
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


_IS_HEX = np.isin(np.arange(256), list(b"0123456789abcdef"))


def _has_run(raw: bytes, kind: np.ndarray, n: int) -> bool:
    """Whether n bytes in a row are of a kind."""
    off = np.flatnonzero(~kind[np.frombuffer(raw, np.uint8)])
    if not len(off):
        return len(raw) >= n
    return off[0] >= n or len(raw) - 1 - off[-1] >= n or bool(len(off) > 1 and np.diff(off).max() > n)


def written(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) for each row of docs.

    base_sha256 is of the base spans alone, written like spans. Null and empty texts have no
    spans (''). Repeated rows and null ids each give a row; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            cols: list[list] = [[] for _ in range(6)]
            for text in batch.column("text").to_pylist():
                found = scan(text)
                for c, kind in zip(cols, KINDS, strict=False):
                    c.append(sum(k == kind for k, _, _ in found))
                cols[4].append(hashlib.sha256(written([f for f in found if f[0] != "random"]).encode()).hexdigest())
                cols[5].append(written(found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], names)

    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span of the text replaced by the mark; overlapping spans become one mark.

    Rows without secrets, null texts included, stay as they are; so do all other columns.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for batch in slices(batches, text_col):
            out = []
            for text in batch.column(at).to_pylist():
                found = scan(text)
                if found:
                    parts, end = [], 0
                    for _, a, b in found:
                        if a >= end:
                            parts += [text[end:a], mark]
                        end = max(end, b)
                    text = "".join(parts) + text[end:]
                out.append(text)
            cols = list(batch.columns)
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, StructType(docs.schema.fields))
