"""URL verdicts: rules by host and path first, else logistic regression on hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (host, path prefix, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Words of the labelled URL table: sites and sections that are fine, names that say nothing, and what marks pages to block.
_FINE = "docs library news history science health museum school music garden recipes travel weather sports research archive support forum wiki maps books language courses physics cooking city council theatre nature software".split()
_PLAIN = "karlton meridian oberlin tandor velkin marisol brenner altona quillan fjordby sandoval harkness lindau petrov yamane corvalis rosedale wexford ibarra nakano".split()
_BLOCK = "casino poker slots betting bets jackpot lottery pills viagra pharmacy-cheap porn xxx adult-cam escort ads adserver banner tracker track popup spam spammer phishing malware keygen crack warez payday-loan fast-cash win-prize free-followers".split()
_SITES = ("example.com", "example.org", "example.net", "site.example", "co.example", "example.edu")
_FRONTS = ("", "www.", "m.", "blog.", "en.")


def _table() -> tuple[tuple[str, int], ...]:
    """(host and path, 1 for pages to block): words, fronts and sites in turn, so that both classes lie on the same sites, fronts and paths."""
    rows, turn = [], 0
    pick = lambda words, k: words[k % len(words)]
    for i, bad in enumerate(_BLOCK):
        for j in range(4):
            turn += 1
            site, front, n = pick(_SITES, turn), pick(_FRONTS, turn // 2), 37 * turn % 9973
            name, twin, fine, more, other = pick(_PLAIN, 3 * turn), pick(_PLAIN, 7 * turn + 5), pick(_FINE, i + 5 * j), pick(_FINE, 3 * turn + 2), pick(_BLOCK, i + 9 * j + 4)
            lang = ("en", "de", "fr", "es")[turn % 4]
            block = (f"{bad}-{name}.{site}/{lang}/{n}", f"{name}.{site}/{bad}/{other}.html", f"{more[:5]}-{bad}.{site}/{lang}/{n}.html", f"{bad}.{other}.{site}/{lang}/")[j]
            allow = (f"{fine}-{name}.{site}/{lang}/{n}", f"{name}.{site}/{fine}/{more}.html", f"{twin}{name[:3]}.{site}/{lang}/{n}.html", f"{fine}.{twin}.{site}/{lang}/")[j]
            rows += [(front + block, 1), (front + allow, 0), (f"{front}{twin[2:]}{name[:4]}.{site}/{lang}/{n + 7}", 0)]
    return tuple(rows)


#: The labelled URL table, made for this repository by the rule above.
LABELLED = _table()
BITS, SIZES = 14, (3, 4, 5)


def features(host: str, path: str) -> np.ndarray:
    """Distinct buckets of the character n-grams of host and of path, marked by which they come from."""
    grams = {f"{mark}{s[i : i + n]}" for mark, s in (("h", f"^{host}$"), ("p", f"^{path}$")) for n in SIZES for i in range(len(s) - n + 1)}
    return np.unique(np.array([xxhash.xxh32_intdigest(g.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for g in sorted(grams)], dtype=np.int64))


def train(labelled: tuple[tuple[str, int], ...] = LABELLED, rounds: int = 300, rate: float = 30.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient descent; the same every time. No rows: all zero."""
    w, bias = np.zeros(1 << BITS), 0.0
    rows = [(features(*_cut(u)), y) for u, y in labelled]
    for _ in range(rounds if rows else 0):
        grad, slope = decay * w, 0.0
        for x, y in rows:
            p = probability(w, bias, x) - y
            grad[x] += p / (len(rows) * np.sqrt(max(1, len(x))))
            slope += p / len(rows)
        w, bias = w - rate * grad, bias - 0.05 * rate * slope
    return w, bias


def _cut(url: str) -> tuple[str, str]:
    host, slash, path = url.partition("/")
    return host, slash + path


def probability(w: np.ndarray, bias: float, x: np.ndarray) -> float:
    z = bias + w[x].sum() / np.sqrt(max(1, len(x)))
    return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_probability) for each row.

    Host: after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; path: from
    there up to '?', '#' or the end. Null urls and urls without '://' have both empty; no rule
    fits them. A rule fits its host and all subdomains if the path starts with the rule's
    path; the longest rule wins (ties: the first). Without a rule the model decides, block
    from 0.5 on. Ids of any type may be null or repeated; each row gets a row; urls of any
    length are judged whole. Empty in, empty out. Other columns are not read.
    """
    url = F.col(url_col).cast("string")
    tail = F.when(F.instr(url, "://") > 0, F.expr(f"substring(cast(`{url_col}` as string), instr(cast(`{url_col}` as string), '://') + 3)")).otherwise(F.lit(""))
    raw = pages.select(F.col(id_col).alias("page_id"), F.coalesce(tail, F.lit("")).alias("_tail"))
    host = F.translate(F.regexp_extract("_tail", r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    d = raw.select("page_id", host.alias("host"), F.regexp_extract("_tail", r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The last that fits stays: longest last, and of equal ones the first.
    for h, p, v in sorted(reversed(rules), key=lambda r: len(r[0]) + len(r[1])):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    d = d.withColumn("rule", rule).withColumn("verdict", verdict)
    w, bias = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prob = [probability(w, bias, features(h, p)) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            verdict = [v or ("block" if p >= 0.5 else "allow") for v, p in zip(batch.column("verdict").to_pylist(), prob, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(verdict, pa.string()), pa.array(prob, pa.float64())], [*batch.schema.names[:5], "block_probability"])

    kind = d.schema["page_id"].dataType.simpleString()
    return d.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, block_probability double")
