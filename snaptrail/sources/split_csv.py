"""Strict CSV files read in blocks, also where line breaks stand inside quotes.

Spark reads a text file as lines in blocks of bytes, each in a task of its own. Whether a line begins a record depends on
all quotes before it. A first pass tells, for every block, in which state it ends for both states that it may begin in
(between records, inside quotes), and where its first and last records end and begin then; these maps are combined along each
file, which gives every block's true state. A second pass joins the lines of records inside a block, and records over the edge
of blocks are put together from their lines, the only rows that are shuffled.

A data source of its own would have to open paths itself, which only Spark's readers can do for every store.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaptrail.operators.cuts import cut
from snaptrail.sources.readers import checked_rows, heads_of


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that begins inside quotes, or not, ends inside quotes. A quote opens a field only at its begin."""
    at = 0
    while True:
        if inside:
            if (quote := line.find('"', at)) < 0:
                return True
            at = quote + 1
            if line.startswith('"', at):
                at += 1
                continue
            inside = False
        else:
            while line.startswith((" ", "\t"), at):
                at += 1
            if line.startswith('"', at):
                at, inside = at + 1, True
                continue
        if (comma := line.find(",", at)) < 0:
            return False
        at = comma + 1


def lines_of(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, block, id, value): lines in file order by block and id."""
    raw = spark.read.option("lineSep", "\n").text(paths)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")


def runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """((file, block), start, end) of lines of one block next to each other."""
    if not batch.num_rows:
        return
    files, blocks = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
    codes, names = files.indices.to_numpy(), files.dictionary.to_pylist()
    new = np.flatnonzero((codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])) + 1
    for a, b in itertools.pairwise([0, *new.tolist(), len(blocks)]):
        yield (names[codes[a]], int(blocks[a])), a, b


class Block(NamedTuple):
    """What a first pass tells of a block; places are ids of lines."""

    first: int
    #: whether it ends inside quotes if it begins outside them, and inside them
    ends: tuple[bool, bool]
    #: where the record that is open at its end begins, in both cases (None: before the block, or no record is open)
    opened: tuple[int | None, int | None]
    #: the last line of the record that it begins inside of (None: all of its lines belong to that one)
    closed: int | None


def blocks_of(lines: DataFrame) -> dict[str, dict[int, Block]]:
    """Blocks of each file, in order; one row a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list] = {}
        for batch in batches:
            ids = batch.column(2).to_numpy()
            for key, a, b in runs(batch):
                told = found.setdefault(key, [int(ids[a]), False, True, None, None, None])
                values = batch.column(3).slice(a, b - a)
                quoted = ids[a:b][values.is_valid().to_numpy(zero_copy_only=False)].tolist()
                _, one, two, from_one, from_two, closed = told
                for at, line in zip(quoted, values.drop_null().to_pylist(), strict=True):
                    before_one, before_two = one, two
                    one = ends_inside(line, before_one)
                    two = one if before_one == before_two else ends_inside(line, before_two)
                    from_one = (from_one if before_one else at) if one else None
                    from_two = (from_two if before_two else at) if two else None
                    if closed is None and not two:
                        closed = at
                told[1:] = one, two, from_one, from_two, closed
        rows = [(*key, *told) for key, told in found.items()]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["file", "block", "first", "out", "in", "out_at", "in_at", "closed"])

    quoted = F.when(F.contains("value", F.lit('"')), F.col("value"))  # lines without quotes change no state
    told = lines.select("file", "block", "id", quoted.alias("value")).mapInArrow(run, "file string, block long, first long, out boolean, in boolean, out_at long, in_at long, closed long")
    files: dict[str, dict[int, Block]] = {}
    for file, block, first, out, inside, out_at, in_at, closed in sorted(map(tuple, told.collect()), key=lambda r: r[:2]):
        files.setdefault(file, {})[block] = Block(first, (out, inside), (out_at, in_at), closed)
    return files


def states_and_edges(files: dict[str, dict[int, Block]]) -> tuple[dict[tuple[str, int], bool], list[tuple]]:
    """Whether each block begins inside quotes, and the lines of records over the edge of blocks.

    An edge (file, block, number, upto, tail, since): lines up to ``upto`` (null: all) belong to the record ``number``, the lines
    since ``since`` to the record ``tail``; numbers count a file's records that are open at the end of a block.
    """
    states, edges = {}, []
    for file, blocks in files.items():
        inside, number = False, 0
        for block, told in blocks.items():
            states[file, block] = inside
            since = told.opened[inside] if told.ends[inside] else None
            if inside or since is not None:
                edges.append((file, block, number if inside else None, told.closed, None if since is None else number + 1, since))
                number += since is not None
            inside = told.ends[inside]
    return states, edges


def whole_records(lines: DataFrame, states: Broadcast) -> DataFrame:
    """(file, pos, record) of records that begin and end in one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, inside, head, begun, held = None, False, False, None, []
        for batch in batches:
            ids, quoted = batch.column(2).to_numpy(), pc.match_substring(batch.column(3), '"').to_numpy(zero_copy_only=False)
            for key, a, b in runs(batch):
                if key != current:
                    if key not in states.value:
                        raise ValueError("files were split in other blocks than before: keep spark.sql.files settings while a file is read")
                    current, inside, held = key, states.value[key], []
                    head = inside
                values = batch.column(3).slice(a, b - a)
                # the state behind a line is that behind the last line with quotes
                marks, after = np.flatnonzero(quoted[a:b]), [inside]
                for line in values.take(pa.array(marks)).to_pylist():
                    inside = ends_inside(line, inside)
                    after.append(inside)
                place = np.zeros(b - a, np.int64)
                place[marks] = np.arange(1, len(marks) + 1)
                stops = np.flatnonzero(~np.array(after)[np.maximum.accumulate(place)]) + 1
                if not len(stops):
                    if not head:
                        begun = begun if held else int(ids[a])
                        held += values.to_pylist()
                    continue
                bounds = np.r_[0, stops].astype(np.int32)
                records = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), values.slice(0, int(stops[-1]))), "\n")
                places = ids[a:b][bounds[:-1]]
                if held:
                    records = pa.concat_arrays([pa.array(["\n".join([*held, records[0].as_py()])], records.type), records.slice(1)])
                    places = np.r_[begun, places[1:]]
                if head:
                    records, places, head = records.slice(1), places[1:], False
                rest = int(stops[-1])
                held, begun = values.slice(rest).to_pylist(), int(ids[a + rest]) if a + rest < b else None
                n = len(records)
                yield pa.RecordBatch.from_arrays([pa.repeat(key[0], n), pa.repeat(key[1], n), pa.array(places, pa.int64()), records], ["file", "block", "id", "record"])

    return lines.mapInArrow(run, "file string, block long, id long, record string").select("file", F.struct("block", "id").alias("pos"), "record")


def split_records(lines: DataFrame, edges: list[tuple]) -> DataFrame:
    """(file, pos, record) of records over the edge of blocks; only their lines are shuffled."""
    known = lines.sparkSession.createDataFrame(edges, "file string, block long, number long, upto long, tail long, since long")
    of = F.when(F.col("number").isNotNull() & F.coalesce(F.col("id") <= F.col("upto"), F.lit(True)), F.col("number")).when(F.col("id") >= F.col("since"), F.col("tail"))
    split = lines.join(F.broadcast(known), ["file", "block"]).select("file", F.struct("block", "id").alias("pos"), "value", of.alias("of")).filter("of IS NOT NULL")
    in_order = F.array_sort(F.collect_list(F.struct("pos", "value")))
    joined = split.groupBy("file", "of").agg(F.min("pos").alias("pos"), F.array_join(F.transform(in_order, lambda p: p["value"]), "\n").alias("record"))
    return joined.select("file", "pos", "record")


#: lines from a file's begin among which its header is looked for first
LEAD = 1000


def read_csv_blocks(spark: SparkSession, paths: str | list[str], columns: list[str], expected: list[str], skip_lines: int = 0) -> tuple[DataFrame, DataFrame]:
    """As ``read_csv_strict``, but a file is read by as many tasks as it has blocks."""
    names = [f"_{i}" for i in range(len(columns))]
    record = F.regexp_replace(F.regexp_replace("record", "^\\x{FEFF}", ""), "\r\\z", "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "escape": '"', "multiLine": "true"}
    schema = ", ".join([*(f"`{n}` string" for n in names), "`__bad` string"])

    def parsed(records: DataFrame) -> DataFrame:
        shown = records.select("file", "pos", record.alias("record")).filter(F.trim("record") != "")
        # as a generated row, a record is parsed once; a filter on its columns would else be pushed down together with the parser
        return shown.select("file", "pos", F.inline(F.array(F.from_csv("record", schema, options))))

    lines = lines_of(spark, paths)
    files = blocks_of(lines)
    states, edges = states_and_edges(files)
    sent = spark.sparkContext.broadcast(states)
    records = whole_records(lines, sent)
    located = parsed(records.unionByName(split_records(lines, edges)) if edges else records)
    # headers are found without reading the files once more, but for files that don't show theirs in their first lines
    begins = spark.createDataFrame([(f, 0, blocks[0].first + skip_lines + LEAD) for f, blocks in files.items() if 0 in blocks], "file string, block long, upto long")
    lead = lines.join(F.broadcast(begins), ["file", "block"]).filter("id < upto").select(lines.columns)
    heads = cut(heads_of(parsed(whole_records(lead, sent)), columns, expected, skip_lines).filter("head_pos IS NOT NULL"))
    missing = files.keys() - {r["file"] for r in heads.select("file").collect()}  # one row a file
    if missing:
        others = located.join(F.broadcast(spark.createDataFrame([(f,) for f in missing], "file string")), "file", "left_semi")
        heads = heads.unionByName(cut(heads_of(others, columns, expected, skip_lines)))
    return checked_rows(located, columns, expected, heads)
