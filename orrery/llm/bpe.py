"""Byte-pair encoding by a deterministic automaton over tokens.

The automaton is compiled merge by merge. At first one state has an arc for every base symbol.
The gadget of a merge (u, v) -> uv copies the state that v leads to, as it is then, for the new
label uv, takes the arc v away after u, and gives every state that has an arc u an arc uv. All
arcs of one label lead to one state, so a state is named by the label that leads to it.

Taking v away after u takes with it the labels that begin with v and are made later. Labels are
numbered so that these are a run of numbers next to v: in preorder over "is the left part of",
the latest first. So the row of a state, which is all that is kept of it, is a short sorted table
of the numbers at which arcs end and begin again, and a transition is one look into that table.

A prefix of a word has exactly one path that spells it, so each place of a word has one state:
encoding goes through the places once, from left to right, and writes down the arc that reaches
each place. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import slices

#: Closes a word; no byte symbol is written so.
STOP = "\0"
#: Most words whose tokens are kept in a worker before its table starts anew; it keeps the table before, too.
KEPT_WORDS = 250_000

#: First and last code points that the library's split leaves out of letters and numbers, as they came after Unicode 16.
LATE = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959),
    (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F),
    (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96),
    (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F),
    (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
#: Lower case of letters that Python's tables of Unicode 15.1 lack and the library's have.
NEW_LOWER = (
    {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
    | {c: c + 0x20 for c in range(0x10D50, 0x10D66)}
    | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


class Automaton:
    """Encoder and decoder of one tokenizer file of the word-BPE kind: words of letters, lower case, an end mark on the last symbol."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.label = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
            raise ValueError(f"not a tokenizer of the word-BPE kind: {kinds}")
        merges = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        self.number, self.rows = self._compile([(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in merges])
        self._spell()
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        late = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in LATE) + "]"
        for kind in ("L", "N"):
            pattern = pattern.replace(rf"\p{{{kind}}}", rf"[\p{{{kind}}}--{late}]")
        self.split = regex.compile(pattern, regex.V1)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes = byte_symbols()
        self.words = _Words(self)

    def _compile(self, merges: list[tuple[int, int, int]]) -> tuple[list[int], list[list[int]]]:
        """(the number of each label, for each state the numbers at which its arcs end or begin, in turn)."""
        size = max(self.label, default=-1) + 1
        later: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        made: set[int] = set()
        for time, (u, _, uv) in enumerate(merges):
            if uv not in made:
                made.add(uv)
                later[u].append((time, uv))
        number, ends, n = [0] * size, [0] * size, 0
        todo = [(i, False) for i in range(size) if i not in made]
        while todo:
            label, done = todo.pop()
            if done:
                ends[label] = n
            else:
                number[label] = n
                n += 1
                # The latest is popped, and numbered, first.
                todo += [(label, True), *((y, False) for _, y in later[label])]
        # A gadget: the new state is a copy of v's; u's loses v and what is made from v from now on.
        # Where u has no arc v any more, the merge never happens.
        gone: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        live = [i not in made for i in range(size)]
        for time, (u, v, uv) in enumerate(merges):
            if not (live[u] and live[v]) or any(a <= number[v] < b for a, b in gone[u]):
                continue
            if not live[uv]:
                live[uv] = True
                gone[uv] = gone[v].copy()
            first = next((y for t, y in later[v] if t >= time), None)
            gone[u].append((number[v], ends[first] if first is not None else number[v] + 1))
        rows = []
        for spans in gone:
            row: list[int] = []
            for a, b in sorted(spans):
                if row and a <= row[-1]:
                    row[-1] = max(row[-1], b)
                else:
                    row += [a, b]
            rows.append(row)
        self.arcs = {t: i for t, i in self.vocab.items() if live[i]}
        return number, rows

    def follows(self, state: int, label: int) -> bool:
        """Whether the state that label `state` leads to has an arc `label`."""
        return not bisect_right(self.rows[state], self.number[label]) & 1

    def _spell(self) -> None:
        """The matcher that finds all arcs of a word: spellings of labels, those with the end mark closed by STOP."""
        self.matcher, cut = ahocorasick.Automaton(), len(self.end)
        for t, i in self.arcs.items():
            spelt = t[: len(t) - cut] + STOP if cut and t.endswith(self.end) else t
            self.matcher.add_word(spelt, (len(spelt), self.number[i], i))
        self.matcher.make_automaton()

    def path(self, word: str) -> list[int]:
        """Labels of the path that spells a word of byte symbols; its last symbol carries the end mark."""
        whole = self.arcs.get(word + self.end)
        if whole is not None:
            return [whole]
        # The arc that reaches each place, and where it comes from; the start has every arc.
        n, rows = len(word) + bool(self.end), self.rows
        arc, back = [-1] * (n + 1), [0] * (n + 1)
        row_at: list[list[int]] = [[]] * (n + 1)
        for at, (length, number, label) in self.matcher.iter(word + STOP if self.end else word):
            at += 1
            if arc[at] < 0 and not bisect_right(row_at[at - length], number) & 1:
                arc[at], back[at], row_at[at] = label, at - length, rows[label]
        out = []
        while n:
            out.append(arc[n])
            n = back[n]
        return out[::-1]

    def token(self, text: str) -> list[int]:
        """The path of one pre-split word; a letter of ASCII stands for its byte."""
        return self.path(text if text.isascii() and text.isalpha() else "".join([self.bytes[b] for b in text.encode("utf-8", "surrogatepass")]))

    def pieces(self, text: str | None) -> list[tuple[str, str, int]]:
        """(ids, labels, count) of each chunk between white space; chunks without tokens are left out."""
        out: list[tuple[str, str, int] | None] = []
        for part in self.cut.split(text or "") if self.cut else [text or ""]:
            if part in self.special:
                out.append((str(self.special[part]), part, 1))
            elif part:
                out += map(self.words.__getitem__, _normal(part))
        return out if all(out) else list(filter(None, out))

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for ids, _, _ in self.pieces(text) for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, joined by a space, as the file names no decoder."""
        return " ".join(self.label[i] for i in ids)


class _Words(dict):
    """The tokens of chunks without white space, in lower case already, worked out when first asked for.

    When it is full, it becomes the old table, from which words are taken over as they come up again.
    """

    def __init__(self, automaton: Automaton) -> None:
        self.automaton, self.old = automaton, {}

    def __missing__(self, text: str) -> tuple[str, str, int] | None:
        if text in self.old:
            got = self.old[text]
        else:
            a = self.automaton
            parts = [text] if text.isalpha() else a.split.findall(text)
            if parts == [text]:
                ids = a.token(text)
                got = (" ".join(map(str, ids)), " ".join([a.label[i] for i in ids]), len(ids))
            elif parts:
                ids, labels, counts = zip(*map(self.__getitem__, parts), strict=True)
                got = (" ".join(ids), " ".join(labels), sum(counts))
            else:
                got = None
        if len(text) <= 64:
            if len(self) >= KEPT_WORDS:
                self.old = dict(self)
                self.clear()
            self[text] = got
        return got


_SPACE = regex.compile(r"\p{White_Space}+")
_NEW = regex.compile("[" + "".join(map(chr, NEW_LOWER)) + "]")


def _normal(text: str) -> list[str]:
    """NFC, white space as the separator, lower case letter by letter."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        if _NEW.search(text):
            text = text.translate(NEW_LOWER)
    odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
    return [c for c in _SPACE.split(text.lower()) if c] if odd else text.lower().split()


@lru_cache(maxsize=2)
def compiled(spec: str) -> Automaton:
    return Automaton(json.loads(spec))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) for each row of docs.

    `path` is a tokenizer file; its text travels with the job, so executors need not have it.
    Null and empty texts have no tokens and the digests of empty strings. Special tokens'
    strings in a text become those tokens. Repeated rows and null ids each give a row; other
    columns are not read. ids is null if with_ids is false.
    """
    spec = Path(path).read_text(encoding="utf-8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = compiled(spec)
        sha = lambda parts: hashlib.sha256(" ".join(parts).encode("utf-8", "surrogatepass")).hexdigest()
        for batch in slices(batches, "text"):
            n, ids, text_sha, all_ids = [], [], [], []
            for text in batch.column("text").to_pylist():
                of_ids, of_labels, counts = zip(*p, strict=True) if (p := a.pieces(text)) else ((), (), ())
                n.append(sum(counts))
                ids.append(sha(of_ids))
                text_sha.append(sha(of_labels))
                all_ids.append([int(i) for x in of_ids for i in x.split(" ")] if with_ids else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text_sha, pa.string()), pa.array(all_ids, pa.list_(pa.int32()))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>")
