"""Repair of conversation structure: the cheapest edits that make a conversation's roles legal, by A* on the edit lattice.

A node of the lattice is (rows read, state); the state is what the roles so far are: nothing,
a system turn, ending with a user turn, or ending with an assistant turn. Edges keep, rerole or
delete the next row, or insert an empty turn. The heuristic is the suffix sum of the charges
that no way avoids: 3 for a row that must go, 1 for a truncated one (charged if it stays, and
its deletion costs more). Open nodes are keyed (cost plus heuristic, audit), so the first end
node taken has the least cost and, of equals, the audit that is least in ASCII.

Spark deals conversations by id, marks faults and sorts turns; a task walks its sorted stream
and holds one conversation at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import slices

#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows that one search spans; longer conversations are searched in stretches.
STRETCH = 512
#: White space at which texts are trimmed.
SPACE = " \t\n\x0b\x0c\r"

#: States: nothing yet, a system turn, a user turn last, an assistant turn last.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: The role that must come next and the state it leads to.
_WANTS = {_START: ("u", _USER), _SYSTEM: ("u", _USER), _USER: ("a", _ASSISTANT), _ASSISTANT: ("u", _USER)}
_ROLE = {"u": "user", "a": "assistant"}
#: What a state can cost more than another and still be of use: from the second, all ways out of the first can be had for so much.
_WORTH = {(_START, _ASSISTANT): 3, (_SYSTEM, _ASSISTANT): 0, (_USER, _ASSISTANT): 2, (_ASSISTANT, _USER): 2}


def _search(rows: str, roots: dict[int, tuple[int, str]], final: bool) -> dict[int, tuple[int, str]]:
    """Cheapest (cost, audit) of each state behind the rows; only that of the cheapest legal end if final.

    A row is a letter: its role's initial (s, u, a, or - for others), in upper case if it is
    truncated, or x if it must go.
    """
    n = len(rows)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + (DELETE if rows[i] == "x" else TRUNCATED if rows[i].isupper() or rows[i] == "_" else 0)
    heap = [(cost + rest[0], audit, 0, state, cost) for state, (cost, audit) in roots.items()]
    heapq.heapify(heap)
    closed, ends = set(), {}
    while heap:
        _, audit, i, state, cost = heapq.heappop(heap)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        if i == n:
            ends[state] = (cost, audit)
            if final and state in (_START, _ASSISTANT):
                return {state: (cost, audit)}
            if len(ends) == 4:
                break
        wants, to = _WANTS[state]
        steps = [(i, to, INSERT, "I")]
        if i < n:
            row = rows[i]
            steps.append((i + 1, state, DELETE, "D"))
            if row != "x":
                more = TRUNCATED if row.isupper() or row == "_" else 0
                if row.lower() == wants:
                    steps.append((i + 1, to, more, "K"))
                else:
                    steps.append((i + 1, to, REROLE + more, "R"))
                    if state == _START and row in "sS":
                        steps.append((i + 1, _SYSTEM, more, "K"))
        for j, state_to, price, edit in steps:
            if (j, state_to) not in closed:
                heapq.heappush(heap, (cost + price + rest[j], audit + edit, j, state_to, cost + price))
    return ends


def cheapest(rows: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest legal edit of a conversation; rows as in _search().

    In a conversation of more than STRETCH rows the search stops at the end of each stretch with
    the best way to each state, drops those that no cheapest way can use, and goes on from the
    rest, so that time grows with the rows.
    """
    roots, settled = {_START: (0, "")}, []
    for lo in range(0, max(len(rows), 1), STRETCH):
        final = lo + STRETCH >= len(rows)
        roots = _search(rows[lo : lo + STRETCH], roots, final)
        for (a, b), worth in _WORTH.items():
            if a in roots and b in roots and roots[a][0] > roots[b][0] + worth:
                del roots[a]
        same = commonprefix([audit for _, audit in roots.values()])
        settled.append(same)
        roots = {s: (cost, audit[len(same) :]) for s, (cost, audit) in roots.items()}
    ((cost, audit),) = roots.values()
    return cost, "".join(settled) + audit


_short = lru_cache(1 << 14)(cheapest)


def edit(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The (role, text) rows that an audit makes of others."""
    out, at, state = [], 0, _START
    for step in audit:
        wants, to = _WANTS[state]
        if step == "D":
            at += 1
            continue
        if step == "I":
            out.append((_ROLE[wants], ""))
        else:
            role, text = rows[at]
            at += 1
            if step == "K" and state == _START and role[:1] == "s":
                to = _SYSTEM
            out.append((role if step == "K" else _ROLE[wants], text))
        state = to
    return out


_LEGAL = {"su", "ua", "au"}
_OUT = pa.schema(
    [("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))]
)
_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role:string,text:string>>"


def _conversation(conv: int | None, turns: list, roles: list[str], texts: list[str], faults: list[int]) -> dict:
    known = [t for t in turns if t is not None]
    initials = [r[:1] for r in roles]
    letters = "".join("x" if f in (1, 2) else "-" if i not in ("s", "u", "a") and f == 0 else "_" if i not in ("s", "u", "a") else i.upper() if f == 3 else i for i, f in zip(initials, faults, strict=True))
    cost, audit = (_short if len(letters) <= 16 else cheapest)(letters)
    return {
        "conv_id": conv,
        "gaps": known[-1] - known[0] + 1 - len(set(known)) if known else 0,
        "blank": faults.count(1),
        "duplicate": faults.count(2),
        "truncated": faults.count(3),
        "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False)),
        "cost": cost,
        "audit": audit,
        "repaired": edit(list(zip(roles, texts, strict=True)), audit),
    }


def _batch(found: list[dict]) -> pa.RecordBatch:
    kept = [x["repaired"] for x in found]
    ends, role, text = [0], [], []
    for own in kept:
        role += [r for r, _ in own]
        text += [t for _, t in own]
        ends.append(len(role))
    repaired = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(role, pa.string()), pa.array(text, pa.string())], ["role", "text"]))
    return pa.RecordBatch.from_arrays([*(pa.array([x[f.name] for x in found], f.type) for f in list(_OUT)[:-1]), repaired.cast(_OUT.field("repaired").type)], schema=_OUT)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of a partition that is sorted by id and, within, by turn."""
    none = object()
    conv, own, found, held = none, ([], [], [], []), [], 0
    for batch in (s for b in batches for s in slices([b], "text")):
        cols = [batch.column(c).to_pylist() for c in ("conv_id", "present", "turn", "role", "text", "fault")]
        for c, present, *row in zip(*cols, strict=True):
            if c != conv or conv is none:
                if conv is not none:
                    found.append(_conversation(conv, *own))
                conv, own = c, ([], [], [], [])
            if present:
                held += len(row[2])
                for put, value in zip(own, row, strict=True):
                    put.append(value)
        if held > 1 << 20 and found:
            yield _batch(found)
            found, held = [], 0
    if conv is not none:
        found.append(_conversation(conv, *own))
    if found:
        yield _batch(found)


def faults(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text, present) with `fault`: 0 none, 1 blank, 2 duplicate of an earlier row, 3 truncated; partitioned by conversation."""
    ends = F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1)
    earlier = Window.partitionBy("conv_id", "present", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    d = rows.repartition("conv_id").withColumn("copy", F.row_number().over(earlier) > 1)
    return d.withColumn("fault", F.when(ends == "", 1).when(F.col("copy"), 2).when(~ends.isin(".", "!", "?"), 3).otherwise(0)).drop("copy")


def repair(rows: DataFrame, present: str | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) for each conversation of rows(conv_id, turn, role, text).

    Rows of a conversation go by turn (nulls first), then role, then text, so that ties and
    repeated rows have one order. A row's first fault counts: blank (nothing but ASCII white
    space), duplicate (role and text seen earlier), truncated (last other character not one of
    . ! ?). gaps: whole turns missing between the smallest and the largest; illegal: neighbours
    whose role initials are not su, ua or au. audit has a letter for each edit (K keep, R
    rerole, D delete, I insert), repaired the rows after it: an optional system turn, then user
    and assistant in pairs, or nothing. Roles count by their first letter; an empty role fits
    nowhere. A null role or text is one space: such a role fits nowhere, such a text is blank. A
    null conv_id is one conversation. `present` names a boolean column: rows where it is not true only say that
    their conversation exists, and one without other rows has zeros and an empty audit. Other
    columns are not read; empty input gives an empty result. A conversation is one row of the
    result, so its texts meet in one task, whatever its share of the table.
    """
    d = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        (F.coalesce(F.col(present), F.lit(False)) if present else F.lit(True)).alias("present"),
    )
    ready = faults(d).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    return ready.select("conv_id", "present", "turn", "role", "text", "fault").mapInArrow(_walk, _DDL)
