"""Secrets in very long texts: time in proportion, results as on short ones."""

import random
import time

from orrery.llm import secrets_scan


def plain(text):
    """Random spans with all base spans looked through for every run."""
    base = [f for f in secrets_scan.scan(text) if f[0] != "random"]
    found = []
    for m in secrets_scan.CANDIDATE.finditer(text):
        at, end = m.span()
        for a, b in [*sorted((a, b) for _, a, b in base if a < end and at < b), (end, end)]:
            found += [("random", at + x, at + y) for x, y in secrets_scan.random_parts(text[at : max(at, a)])]
            at = max(at, b)
    return sorted(found)


def bits(r):
    key = lambda n: "".join(r.choice("abcdefABCDEF0123456789zQxKw-_/") for _ in range(n))
    return r.choice([f"password={key(9)}", f"token: {key(30)}", "AKIA" + key(18).upper().replace("-", "0"), "".join(r.choice("0123456789abcdef") for _ in range(40)), key(44), "word", "some_ordinary_identifier_name", "a/b/" + key(40) + "=" + "AKIA" + "Z" * 20])


def test_random_spans_beside_base_spans():
    r = random.Random(2)
    seen = 0
    for _ in range(400):
        text = "".join(bits(r) + r.choice([" ", "", "\n", "; "]) for _ in range(r.randint(1, 30)))
        got = sorted(f for f in secrets_scan.scan(text) if f[0] == "random")
        assert got == plain(text), text
        seen += len(got)
    assert seen > 300


def test_many_secrets_in_one_text():
    r = random.Random(3)
    part = " ".join(bits(r) for _ in range(2000))
    began = time.time()
    one = secrets_scan.scan(part)
    first = time.time() - began
    began = time.time()
    many = secrets_scan.scan("\n".join([part] * 16))
    assert time.time() - began < 16 * 4 * max(first, 0.05) and len(many) >= 16 * len(one) - 32


def test_twenty_megabytes():
    text = "some ordinary words in a row, nothing else. " * 460_000 + " password=abcdef1 " + "AKIA" + "A1" * 9
    began = time.time()
    assert [k for k, _, _ in secrets_scan.scan(text)] == ["assign", "access"]
    assert time.time() - began < 60
