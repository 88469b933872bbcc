"""Repairs against a search over all edits, and conversations that run over many partitions."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from snaptrail.llm import queries, repair

PATTERN = re.compile("(s?(ua)+)?")
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def cheapest(rows):
    """(cost, audit, repaired rows): edits in the order of cost and audit until the pattern fits."""
    queue = [(0, "", 0, "", ())]
    while queue:
        cost, audit, i, initials, kept = heapq.heappop(queue)
        if i == len(rows) and PATTERN.fullmatch(initials):
            return cost, audit, list(kept)
        if re.fullmatch("s?(ua)*u?", initials) is None:
            continue
        for role in ("user", "assistant"):
            heapq.heappush(queue, (cost + 2, audit + "I", i, initials + role[0], (*kept, (role, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, initials, kept))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                heapq.heappush(queue, (cost + extra, audit + "K", i + 1, initials + role[:1], (*kept, (role, text))))
                for to in ("user", "assistant"):
                    heapq.heappush(queue, (cost + 2 + extra, audit + "R", i + 1, initials + to[0], (*kept, (to, text))))
    raise AssertionError("no edits fit")


def judged(rows):
    """(role, text, fault) of rows in order."""
    seen, out = set(), []
    for role, text in rows:
        shown = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def brute(rows):
    """Rows (turn, role, text) of one conversation, damaged already, in order."""
    full = judged([(r, t) for _, r, t in rows])
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    cost, audit, kept = cheapest(full)
    counts = [sum(f == x for _, _, f in full) for x in ("blank", "duplicate", "truncated")]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code:
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            out[conv] += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


ROWS = st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", " "]), st.sampled_from(["Yes.", "No", " ", "Why?", "And ", "So. "]))


@settings(max_examples=150, deadline=None)
@given(st.lists(ROWS, max_size=5))
def test_tables_equal_a_search_over_all_edits(rows):
    rows = judged(rows)
    table = repair.tables()
    kinds = {"": repair.EMPTY, "s": repair.S, "u": repair.U, "a": repair.A}
    symbols = np.array([repair.DELETE if f in ("blank", "duplicate") else kinds.get(r[:1], repair.OTHER) + 5 * (f == "truncated") for r, _, f in rows], np.int64)
    codes = table.blocks(symbols)
    vectors, total = table.costs_back(codes, np.array([table.end]))
    steps, state = table.walk(codes, vectors[:, 0], repair.START)
    audit = "".join("I" * len(b) + e[0] for b, e in steps) + "I" * len(table.closing(state))
    cost, want, _ = cheapest(rows)
    assert (int(total[0]) + table.vectors[vectors[0, 0]][repair.START], audit) == (cost, want)
    assert table.exits(codes, vectors)[0, repair.START] == state


@pytest.mark.parametrize("parts", ["1", "7"])
def test_repair_equals_brute_force(spark, parts):
    rng = random.Random(int(parts))
    rows = []
    for conv in [None, *range(40)]:
        for turn in rng.sample([None, *range(8)], rng.randint(0, 5)):
            rows.append((conv, turn, rng.choice(["system", "user", "assistant", "assistant", "user", None, "", "tool"]), rng.choice(["Yes.", "No", "Why?", None, "", " \t", "And so on"])))
    rows += [(50, 1, "user", "Same."), (50, 1, "user", "Same."), (50, 1, "assistant", "Tie."), (50, 1, "assistant", "Another tie.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        out = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair.repair(repair.damage(df), df.withColumn("audit", df.text)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out == {c: brute(r) for c, r in damaged(rows).items()}
    assert repair.repair(repair.damage(df.filter("false")), df.filter("false")).count() == 0


def test_one_long_conversation_over_partitions(spark, monkeypatch):
    """The same edits whether a conversation lies in one partition or in many."""
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["Yes.", "No", " ", "Why?", f"Turn {t}."])) for c, n in ((1, 3), (2, 3000), (3, 1), (4, 900)) for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = sorted(tuple(r) for r in repair.repair(repair.damage(df), df).collect())
    monkeypatch.setattr(repair, "PARTITION_BYTES", 4000)
    faults = repair.faults(repair.damage(df))
    ordered = repair.in_order(faults)
    assert ordered.rdd.getNumPartitions() > 20
    assert sorted(tuple(r) for r in repair.repair(repair.damage(df), df).collect()) == whole
    # the tables' costs are those of rows one by one
    table = repair.tables()
    for conv, _, _, _, _, _, cost, audit, _ in [(r[0], *r[1:]) for r in whole]:
        full = judged([(r, t) for _, r, t in damaged(rows)[conv]])
        vector = repair.with_inserts([0, float("inf"), float("inf"), 0])
        for r, _, f in reversed(full):
            kind = {"": repair.EMPTY, "s": repair.S, "u": repair.U, "a": repair.A}.get(r[:1], repair.OTHER)
            vector = repair.before_row(repair.DELETE if f in ("blank", "duplicate") else kind + 5 * (f == "truncated"), tuple(vector))
        assert cost == vector[repair.START] and len(audit) - audit.count("I") == len(full)
    assert len(table.vectors) < 40
