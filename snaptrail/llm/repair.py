"""Cheapest repairs of conversations' turn structure by block tables.

Rows of a conversation must give role initials ``(s?(ua)+)?``. A row is kept (free), given the role user or assistant (2) or
deleted (3; blank rows and duplicates must be); an empty user or assistant row may be inserted anywhere (2); a truncated row
that stays costs 1.

The state of a reading is how far the pattern is: nothing yet, after s, after u, after a. The costs from a row on are a
vector over the four states; without its least entry it is one of few normalised vectors. A table made once holds, for every
such vector and every block of ``BLOCK`` symbols (what matters of a row), the vector before the block and what it costs more.
Costs run backward through a conversation block by block, by lookup. Edits are then traced forward: each block is expanded
backward from the vector after it, and of equally cheap edits the least initial is taken, which gives the least audit.

A conversation may be longer than any task should read: rows are ranged over partitions by conversation and order. A
partition reports, for its first and its last conversation, what it makes of each vector after it and each state before it
(two rows a partition); these maps compose over the partitions of a conversation, and a second pass traces with both ends
known. Only the digest of the repaired rows is a chain; one task streams a conversation's rows for it, at a fixed size.

Defined results: null roles and texts are one blank, which is no role initial of the pattern; rows with equal turns are
ordered by role, then text; equal rows are counted, of which all but the first are duplicates; an empty role adds nothing to
the initials; null conversation ids are one conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaptrail.llm.common import cut

BLANKS = " \t\n\x0b\x0c\r"
BLOCK = 3
PARTITION_BYTES = 32 << 20
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: role initials as symbols: none of the pattern's, an empty one, and those of the pattern; +5 if the row is truncated
OTHER, EMPTY, S, U, A = range(5)
DELETE, NOTHING = 10, 11  # a row that must go; no row (fills the last block)
SYMBOLS = 12
#: where an initial leads from each state
_KEEP = {(START, S): AFTER_S, (START, U): AFTER_U, (AFTER_S, U): AFTER_U, (AFTER_U, A): AFTER_A, (AFTER_A, U): AFTER_U} | {(s, EMPTY): s for s in range(4)}
#: where the one fitting row of user or assistant leads
_GIVEN = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}
KEEP_COST, ROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 2, 3, 2, 1
ROWS_TYPE = "conv_id long, turn long, role string, text string, n long, initial string, fault string, before string, edit string, after string"
RESULT_TYPE = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

Vector = tuple[int, int, int, int]


def with_inserts(costs: list[float]) -> list[float]:
    for _ in range(2):
        costs = [min(c, INSERT_COST + costs[_GIVEN[s]]) for s, c in enumerate(costs)]
    return costs


def edits(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(initial, cost, next state) of the edits that use up a row, in the order of their initials."""
    yield "D", DELETE_COST, state
    if symbol != DELETE:
        extra = TRUNCATED_COST * (symbol >= 5)
        if (kept := _KEEP.get((state, symbol % 5))) is not None:
            yield "K", KEEP_COST + extra, kept
        yield "R", ROLE_COST + extra, _GIVEN[state]


def before_row(symbol: int, after: Vector) -> list[float]:
    """Costs from a row on, given those from the next row on."""
    if symbol == NOTHING:
        return list(after)
    return with_inserts([min(cost + after[to] for _, cost, to in edits(symbol, s)) for s in range(4)])


class BlockTables:
    """All normalised vectors that can come up, and what every block makes of each."""

    def __init__(self) -> None:
        end = with_inserts([0, math.inf, math.inf, 0])
        self.vectors: list[Vector] = []
        self.number: dict[Vector, int] = {}
        self.end = self.known(end)[0]
        follow, cost, i = [], [], 0
        while i < len(self.vectors):  # grows while symbols lead to new vectors
            steps = [self.known(before_row(x, self.vectors[i])) for x in range(SYMBOLS)]
            follow.append([v for v, _ in steps])
            cost.append([c for _, c in steps])
            i += 1
        self.follow, self.cost = np.array(follow), np.array(cost)
        # blocks are read from their last row to their first
        shape = (len(follow), *[SYMBOLS] * BLOCK)
        at, total = np.broadcast_to(np.arange(len(follow)).reshape(-1, *[1] * BLOCK), shape), np.zeros(shape, np.int64)
        for place in reversed(range(BLOCK)):
            symbol = np.arange(SYMBOLS).reshape([-1 if k == place + 1 else 1 for k in range(BLOCK + 1)])
            at, total = self.follow[at, symbol], total + self.cost[at, symbol]
        self.block_follow, self.block_cost = at.reshape(len(follow), -1), total.reshape(len(follow), -1)
        self.traced: dict[tuple[int, int, int], tuple[tuple[tuple[str, str], ...], int]] = {}

    def known(self, costs: list[float]) -> tuple[int, int]:
        """The number of the normalised vector and the least cost."""
        least = min(costs)
        vector = tuple(int(c - least) for c in costs)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector], int(least)

    @staticmethod
    def blocks(symbols: np.ndarray) -> np.ndarray:
        """Codes of the blocks of a run of rows; the last block is filled up."""
        padded = np.full(-(-len(symbols) // BLOCK) * BLOCK, NOTHING)
        padded[: len(symbols)] = symbols
        return padded.reshape(-1, BLOCK) @ SYMBOLS ** np.arange(BLOCK - 1, -1, -1)

    def costs_back(self, codes: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors after every block (blocks, starts) and, in the first row, before all; and the costs, for several vectors at the end."""
        vectors, total = np.empty((len(codes) + 1, len(after)), np.int64), np.zeros(len(after), np.int64)
        vectors[len(codes)] = after
        for i in range(len(codes) - 1, -1, -1):
            total += self.block_cost[vectors[i + 1], codes[i]]
            vectors[i] = self.block_follow[vectors[i + 1], codes[i]]
        return vectors, total

    def trace(self, code: int, after: int, state: int) -> tuple[tuple[tuple[str, str], ...], int]:
        """(roles inserted before, edit) of each row of a block entered in ``state``, and the state after it."""
        key = (code, after, state)
        found = self.traced.get(key)
        if found is None:
            symbols = [code // SYMBOLS ** (BLOCK - 1 - k) % SYMBOLS for k in range(BLOCK)]
            vectors = [self.vectors[after]]
            for x in reversed(symbols):  # expanded backward
                vectors.append(tuple(before_row(x, vectors[-1])))
            out = []
            for x, here, later in zip(symbols, vectors[:0:-1], vectors[-2::-1], strict=True):
                if x == NOTHING:
                    continue
                inserted = ""
                while True:
                    best = next((e, to) for e, cost, to in sorted([*edits(x, state), ("I", INSERT_COST, -1)]) if cost + (later[to] if to >= 0 else here[_GIVEN[state]]) == here[state])
                    if best[0] != "I":
                        break
                    state = _GIVEN[state]
                    inserted += "u" if state == AFTER_U else "a"
                # the role that an edit gives follows from the state
                given = "ua"[best[1] == AFTER_A] if best[0] == "R" else ""
                out.append((inserted, best[0] + given))
                state = best[1]
            found = self.traced[key] = (tuple(out), state)
        return found

    def walk(self, codes: np.ndarray, vectors: np.ndarray, state: int) -> tuple[list[tuple[str, str]], int]:
        """The edits of all rows of a run entered in ``state``; ``vectors`` are those after its blocks."""
        out: list[tuple[str, str]] = []
        for code, after in zip(codes.tolist(), vectors[1:].tolist(), strict=True):
            rows, state = self.trace(code, after, state)
            out += rows
        return out, state

    def exits(self, codes: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """The state after a run by the vector at its end (a column of ``vectors``) and the state before it."""
        pairs, at = np.unique(codes[:, None] * len(self.vectors) + vectors[1:], return_inverse=True)
        out = np.array([[self.trace(int(x) // len(self.vectors), int(x) % len(self.vectors), s)[1] for s in range(4)] for x in pairs]).reshape(-1, 4)
        states = np.tile(np.arange(4), (vectors.shape[1], 1))
        for block in at.reshape(vectors[1:].shape):
            states = np.take_along_axis(out[block], states, 1)
        return states

    def closing(self, state: int) -> str:
        """Roles inserted after the last row."""
        out = ""
        while state in (AFTER_S, AFTER_U):
            state = _GIVEN[state]
            out += "u" if state == AFTER_U else "a"
        return out


@functools.cache
def tables() -> BlockTables:
    return BlockTables()


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): rows dropped, emptied, cut, repeated or re-roled by the checksum of their place."""
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    marked = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), (F.crc32(place) % 20).alias("code")).filter("code <> 0")
    code = F.col("code")
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return marked.select("conv_id", "turn", F.when(code == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(code == 3, 2).otherwise(1).cast("long").alias("n"))


def faults(rows: DataFrame) -> DataFrame:
    """Equal rows once, with their number ``n``, role initial and first fault (blank, duplicate, truncated or none)."""
    same = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    hashed = same.withColumns({"t1": F.xxhash64("role", "text"), "t2": F.xxhash64(F.lit(1), "text", "role")})
    place = F.struct(F.col("turn").isNotNull().alias("told"), F.col("turn").alias("turn"))
    # few rows are left: texts that a conversation repeats
    repeated = hashed.groupBy("conv_id", "t1", "t2").agg(F.min(place).alias("first"), F.count("*").alias("places")).filter("places > 1")
    repeated = repeated.select(F.col("conv_id").alias("c"), F.col("t1").alias("r1"), F.col("t2").alias("r2"), "first")
    both = hashed.join(repeated, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("t1") == F.col("r1")) & (F.col("t2") == F.col("r2")), "left")
    shown = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(shown == "", "blank").when(F.col("first").isNotNull() & (place != F.col("first")), "duplicate").when(~F.right(shown, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    return both.select("conv_id", "turn", "role", "text", "n", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


def in_order(rows: DataFrame) -> DataFrame:
    """Rows ranged over partitions by conversation and order, written once so that both passes see the same partitions."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text") + 64)).head()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PARTITION_BYTES))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    return cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order))


def symbol_column() -> Column:
    initial = F.element_at(F.create_map(*itertools.chain(*((F.lit(k), F.lit(v)) for k, v in {"": EMPTY, "s": S, "u": U, "a": A}.items()))), F.col("initial"))
    return F.when(F.col("fault").isin("blank", "duplicate"), DELETE).otherwise(F.coalesce(initial, F.lit(OTHER)) + 5 * (F.col("fault") == "truncated").cast("int")).cast("int")


def runs_of(batch: pa.RecordBatch) -> Iterator[tuple[object, int, int]]:
    """(conversation, start, end) of rows next to each other."""
    conv = batch.column(0)
    told, values = conv.is_valid().to_numpy(zero_copy_only=False), conv.fill_null(0).to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]) | (told[1:] != told[:-1])])[: len(values)])
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(values)], strict=True):
        yield (int(values[a]) if told[a] else None), a, b


def ends_of_partitions(rows: DataFrame) -> dict[int, tuple[int, int, int, bool]]:
    """By partition: the state before its first conversation, the vectors after its first and after its last one, and whether that goes on."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, first, last = tables(), None, None
        for batch in batches:
            symbols = batch.column(1).to_numpy()
            for conv, a, b in runs_of(batch):
                if last is None or last[0] != conv:
                    first, last = first or last, (conv, [])
                last[1].append(symbols[a:b])
        out = []
        for place, one in enumerate([x for x in (first, last) if x is not None]):
            codes = table.blocks(np.concatenate(one[1]))
            vectors, _ = table.costs_back(codes, np.arange(len(table.vectors)))
            out.append((TaskContext.get().partitionId(), place, one[0], vectors[0].tolist(), table.exits(codes, vectors).ravel().tolist()))
        names = ["part", "place", "conv_id", "vectors", "states"]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, types, strict=True)], names)

    # two rows a partition
    told = rows.select("conv_id", symbol_column().alias("symbol")).mapInArrow(summary, "part int, place int, conv_id long, vectors array<int>, states array<int>").collect()
    told = sorted(told, key=lambda r: (r["part"], r["place"]))
    end = tables().end
    after = [end] * len(told)
    for i in range(len(told) - 2, -1, -1):
        if told[i]["conv_id"] == told[i + 1]["conv_id"] and told[i]["part"] != told[i + 1]["part"]:
            after[i] = told[i + 1]["vectors"][after[i + 1]]
    state, found = START, {}
    for i, r in enumerate(told):
        goes_on = i > 0 and told[i - 1]["conv_id"] == r["conv_id"] and told[i - 1]["part"] != r["part"]
        state = state if goes_on else START
        before = found.get(r["part"], (state, after[i]))
        found[r["part"]] = (*before[:2], after[i], i + 1 < len(told) and told[i + 1]["conv_id"] == r["conv_id"])
        state = r["states"][4 * after[i] + state]
    return found


def trace(rows: DataFrame) -> DataFrame:
    """Rows in order with the cheapest edits: roles inserted before and after, and the edit (K, D, Ru or Ra)."""
    ends = ends_of_partitions(rows)
    sent = rows.sparkSession.sparkContext.broadcast(ends)
    names = [c.split()[0] for c in ROWS_TYPE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = tables(), TaskContext.get().partitionId()
        before_first, after_first, after_last, goes_on = sent.value.get(part, (START, table.end, table.end, False))
        waiting: list[pa.RecordBatch] = []
        n_done = 0

        def edited(last: bool) -> pa.RecordBatch:
            nonlocal n_done
            only = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            symbols = only.column(len(names) - 3).to_numpy()
            first = n_done == 0
            after = after_last if last else after_first if first else table.end
            codes = table.blocks(symbols)
            vectors, _ = table.costs_back(codes, np.array([after]))
            steps, state = table.walk(codes, vectors[:, 0], before_first if first else START)
            # a conversation that goes on in the next partition is closed there
            closing = [""] * (len(steps) - 1) + ["" if last and goes_on else table.closing(state)]
            n_done += 1
            waiting.clear()
            columns = [pa.array([s[0] for s in steps]), pa.array([s[1] for s in steps]), pa.array(closing)]
            return pa.RecordBatch.from_arrays([*only.columns[:-1], *columns], names)

        current: object = run
        for batch in batches:
            for conv, a, b in runs_of(batch):
                if waiting and conv != current:
                    yield edited(last=False)
                current = conv
                waiting.append(batch.slice(a, b - a))
        if waiting:
            yield edited(last=True)

    return rows.select(*names[:-3], symbol_column().alias("symbol")).mapInArrow(run, ROWS_TYPE)


class Repaired:
    """What is told of one conversation, row by row in order."""

    def __init__(self) -> None:
        self.turn = self.first_turn = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.audit: list[str] = []
        self.digest, self.begun = hashlib.sha256(), False

    def line(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.begun else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.begun = True

    def insert(self, roles: str) -> None:
        for r in roles:
            self.audit.append("I")
            self.cost += INSERT_COST
            self.line(_ROLES[r], "")

    def row(self, turn: int | None, role: str, text: str, n: int, initial: str, fault: str, before: str, edit: str, after: str) -> None:
        if turn is not None:
            self.turns += turn != self.turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.turn = turn
        self.illegal += (self.last is not None and self.last + initial not in _LEGAL) + n - 1
        self.last = initial
        self.blank += n * (fault == "blank")
        self.duplicate += n if fault == "duplicate" else (n - 1) * (fault != "blank")
        self.truncated += fault == "truncated"
        self.insert(before)
        self.audit.append(edit[0] + "D" * (n - 1))
        self.cost += DELETE_COST * (n - 1)
        if edit == "D":
            self.cost += DELETE_COST
        else:
            self.cost += TRUNCATED_COST * (fault == "truncated") + ROLE_COST * (edit[0] == "R")
            self.line(_ROLES[edit[1]] if edit[0] == "R" else role, text)
        self.insert(after)

    def told(self, conv: int | None) -> tuple:
        gaps = self.turn - self.first_turn + 1 - self.turns if self.turns else 0
        return conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


_ROLES, _LEGAL = {"u": "user", "a": "assistant"}, {"su", "ua", "au"}


def told(traced: DataFrame) -> DataFrame:
    """One row a conversation, streamed in order at a fixed size but for its audit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = run, Repaired()
        for batch in batches:
            done, columns = [], [c.to_pylist() for c in batch.columns[1:]]
            for conv, a, b in runs_of(batch):
                if current is not run and conv != current:
                    done.append(state.told(current))
                    state = Repaired()
                current = conv
                for values in zip(*(c[a:b] for c in columns), strict=True):
                    state.row(*values)
            if done:
                yield record(done)
        if current is not run:
            yield record([state.told(current)])

    def record(rows: list[tuple]) -> pa.RecordBatch:
        names = [c.split() for c in RESULT_TYPE.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if t == "long" else pa.string()) for c, (_, t) in zip(zip(*rows, strict=True), names, strict=True)], [n for n, _ in names])

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    return traced.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, RESULT_TYPE)


def repair(rows: DataFrame, all_ids: DataFrame) -> DataFrame:
    """Faults, cost, edits and digest of every conversation of ``all_ids``; those without rows (conv_id, turn, role, text, n) have nothing to repair."""
    found = told(trace(in_order(faults(rows))))
    ids = all_ids.select(F.col("conv_id").cast("long").alias("every_id")).distinct()
    both = ids.join(found, F.col("every_id").eqNullSafe(F.col("conv_id")), "left")
    empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    others = [c.split()[0] for c in RESULT_TYPE.split(", ")[1:]]
    return both.select(F.col("every_id").alias("conv_id"), *[F.coalesce(c, empty.get(c, F.lit(0).cast("long"))).alias(c) for c in others])
