"""Repair of conversations against a plain dynamic program and a plain reading of the damage."""

import hashlib
import random
import re
import time
import zlib

import pytest

from orrery.llm import queries, turn_repair

SCHEMA = "conv_id long, turn long, role string, text string, present int, copy int"


def plain(rows):
    """(cost, audit): least over all edits, by rounds over (rows read, roles so far as a state) without a heuristic."""
    legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    now = {"": (0, "")}

    def inserted(best):
        changed = True
        while changed:
            changed = False
            for state, (cost, audit) in list(best.items()):
                for role in "ua":
                    to = legal.get((state, role))
                    new = (cost + 2, audit + "I")
                    if to and new < best.get(to, (1 << 60, "")):
                        best[to], changed = new, True
        return best

    now = inserted(now)
    for role, fault in rows:
        new = {}

        def put(state, value):
            if value < new.get(state, (1 << 60, "")):
                new[state] = value

        for state, (cost, audit) in now.items():
            put(state, (cost + 3, audit + "D"))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if (state, role[:1]) in legal:
                    put(legal[state, role[:1]], (cost + more, audit + "K"))
                for to in "ua":
                    if (state, to) in legal:
                        put(legal[state, to], (cost + 2 + more, audit + "R"))
        now = inserted(new)
    return min(now[s] for s in ("", "a") if s in now)


def letters(rows):
    out = ""
    for role, fault in rows:
        known = role[:1] in ("s", "u", "a")
        out += "x" if fault in ("blank", "duplicate") else (role[:1].upper() if known else "_") if fault == "truncated" else role[:1] if known else "-"
    return out


def some_rows(r, n):
    return [(r.choice(["user", "assistant", "system", "user", "assistant", " ", ""]), r.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(n)]


def test_search_is_the_plain_minimum(monkeypatch):
    r = random.Random(3)
    for k in range(3000):
        rows = some_rows(r, r.randint(0, 9))
        assert turn_repair.cheapest(letters(rows)) == plain(rows), rows
    monkeypatch.setattr(turn_repair, "STRETCH", 4)
    for k in range(1500):
        rows = some_rows(r, r.randint(0, 40))
        assert turn_repair.cheapest(letters(rows)) == plain(rows), rows


def test_long_conversations_take_time_in_proportion():
    r = random.Random(4)
    rows = some_rows(r, 100_000)
    began = time.time()
    _, audit = turn_repair.cheapest(letters(rows))
    assert time.time() - began < 40 and sum(e in "KRD" for e in audit) == len(rows)
    assert turn_repair.cheapest(letters(rows[:5000])) == plain(rows[:5000])
    # Rows that all must go leave the state at its start.
    assert turn_repair.cheapest("x" * 5000) == (15_000, "D" * 5000)


def test_edits_give_legal_roles():
    r = random.Random(5)
    for _ in range(500):
        rows = [(role, "t") for role, _ in some_rows(r, r.randint(0, 8))]
        _, audit = turn_repair.cheapest(letters([(role, "") for role, _ in rows]))
        roles = "".join(role[0] for role, _ in turn_repair.edit(rows, audit))
        assert re.fullmatch("(s?(ua)+)?", roles), (rows, audit)


def brute(rows):
    """The stated result, one conversation at a time."""
    out, of = {}, {}
    for conv, turn, role, text in rows:
        own = of.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, own in of.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            real = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not real else "duplicate" if (role, text) in seen else "truncated" if real[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        cost, audit = plain([(role, f) for (_, role, _), f in zip(own, faults, strict=True)])
        done, at, roles = [], 0, ""
        for e in audit:
            wants = "assistant" if roles[-1:] == "u" else "user"
            if e == "I":
                done.append((wants, ""))
            else:
                if e != "D":
                    done.append((own[at][1] if e == "K" else wants, own[at][2]))
                at += 1
            if e != "D":
                roles += done[-1][0][0]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in done).encode()).hexdigest())
    return out


def got(frame):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in frame.collect()}


@pytest.fixture
def edge_rows():
    r = random.Random(6)
    texts = [None, "", " \t\x0b\n", "Yes.", "no", "Why?  \n", "Äh…", " ", "x" * 200_000, "ok!\x0c", "."]
    rows = [(r.choice([None, 1, 2, 3, *range(4, 40)]), r.choice([None, 0, 1, 2, 3, 4, 5, 9, -3]), r.choice(["user", "assistant", "system", None, "", "tool", "user", "assistant"]), r.choice(texts)) for _ in range(600)]
    return [*rows, *rows[:60], *((500 + k, k, "user", "a.") for k in range(60)), *((777, k, "ua"[k % 2] + "x", f"t{k // 3}") for k in range(900))]


def test_query_matches_brute_force(spark, tmp_path, edge_rows):
    spark.createDataFrame([(*x, 1, 2) for x in edge_rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    want = brute(edge_rows)
    rows = queries.op11_repair(spark, str(tmp_path)).collect()
    assert len(rows) == len(want)
    assert got(queries.op11_repair(spark, str(tmp_path))) == want
    assert any(v[5] == 0 and v[6] == "" for v in want.values()), "a conversation that lost all rows"


def test_query_on_given_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert got(queries.op11_repair(spark, "/root/testdata/sf0.001")) == brute([(r.conv_id, r.turn, r.role, r.text) for r in d.collect()])


def test_empty_table(spark):
    assert turn_repair.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    assert "present" not in turn_repair.repair(spark.createDataFrame([], SCHEMA)).columns
