"""Substring dedup: words covered by a window that was seen before go.

A window is ``WINDOW`` consecutive words. Counting all windows exactly would shuffle one row a word, so a count-min sketch
comes first. It counts anchors: of the runs of ``GRAM`` words in a window, the one with the smallest hash, once for each
place where it stands. Windows with equal words have equal anchors, so an anchor's count is at least that of each of its
windows, and far fewer anchors than windows exist. The sketch is cut into blocks of two rows of 2^16 cells, as many blocks
as the input needs (one for about a million characters), so it filters alike at every size. Parts of a partition send their
anchors' cells to the blocks, where they merge by adding up; each block answers with the places whose two cells were both
counted twice or more. Nothing of it passes the driver or is sent to all executors. A second pass takes every window whose
anchor is estimated to repeat, and only those are grouped exactly (by 95 bits of hash): all but the earliest of a group are
repeats. The sketch never underestimates, so no repeated window is lost.

Texts equal to the text of a smaller id hold nothing new: they go whole, and their windows are neither sketched nor
grouped. Copies of a window inside one batch are reduced to the earliest before the shuffle, so a window that fills a third of the
corpus brings one row a batch.

Defined results: null text has no words; texts shorter than a window are never cut; a null id sorts before all others;
rows of one id and one text are one document; texts of one id are told apart by the text; an empty table gives an empty
result; extra columns are ignored. Words are split at spaces, tabs, line feeds, vertical tabs, form feeds and carriage
returns, and compared unchanged. A text's words before the cut are not joined with those after it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snaptrail.llm import hashes
from snaptrail.llm.common import cut, few, freed, parts_of

WINDOW, GRAM = 20, 8
#: characters of text for which the sketch gets one block
BLOCK_CHARS = 1 << 20
_NO_PLACE = np.uint32(0xFFFFFFFF)
TEXT_BYTES = 2 << 20
WAITING_BYTES = 4 << 20
SEPARATORS = re.compile("[ \t\n\v\f\r]+")


def anchors(texts: pa.Array, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, words of each text, first words of the windows, and the place of each window's anchor."""
    h, sizes = hashes.words(texts)
    start = np.flatnonzero(hashes.of_texts(sizes, window))
    if not len(start):
        return h, sizes, start, start
    # the smallest gram of each window, the leftmost of equal ones: hash and place in one number
    key = (hashes.runs(h, gram) & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h) - gram + 1, dtype=np.uint64)
    span, have = window - gram + 1, 1
    while have * 2 <= span:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    if have < span:
        key = np.minimum(key[: len(key) - (span - have)], key[span - have :])
    return h, sizes, start, (key[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def blocks_for(docs: DataFrame) -> int:
    """A power of two of blocks, about one for ``BLOCK_CHARS`` characters."""
    chars = docs.agg(F.sum(F.length("text"))).head()[0] or 0
    return 1 << int(chars // BLOCK_CHARS).bit_length()


def cells_of(gram_hash: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block, and the cells of its two rows in one number of 32 bits."""
    return (gram_hash & np.uint64(blocks - 1)).astype(np.int64), (hashes.mix(gram_hash ^ hashes.SECOND) >> np.uint64(32)).astype(np.uint32)


def halves(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of the two rows of a block."""
    return (cells & np.uint32(0xFFFF)).astype(np.int64), (cells >> np.uint32(16)).astype(np.int64)


def twice(cells: np.ndarray, counts: Sequence[np.ndarray]) -> np.ndarray:
    """Which entries of one block have both cells counted at least twice."""
    low, high = halves(cells)
    return (counts[0][low] > 1) & (counts[1][high] > 1)


def counted_twice(cells: np.ndarray) -> np.ndarray:
    """The same where these are all entries of the block."""
    return twice(cells, [np.bincount(x, minlength=1 << 16) for x in halves(cells)])


def _binaries(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Runs of an array, each from a place of ``first`` on, as binary values."""
    offsets = np.append(first, len(values)).astype(np.int32) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def repeated_anchors(docs: DataFrame, blocks: int, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, variant, text) -> doc_id, variant, ordinals (of the text's anchors that are estimated to repeat; 32-bit numbers)."""
    columns = ["block", "part", "cells", "places", "docs", "variants", "counts", "known"]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in parts_of(batch, 2, 4 * TEXT_BYTES):
                h, sizes, _, place = anchors(piece.column(2), window, gram)
                if not len(place):
                    continue
                part += 1
                at = np.unique(place)
                _, first, group, n = np.unique(hashes.runs(h, gram)[at], return_index=True, return_inverse=True, return_counts=True)
                # an anchor met again in this part is known to repeat: it counts twice and asks for no answer
                known = np.flatnonzero(n[group] > 1).astype("<u4")
                block, cells = cells_of(hashes.runs(h, gram)[at[first]], blocks)
                times = np.minimum(n, 2)
                block, cells, ask = np.repeat(block, times), np.repeat(cells, times), np.repeat(np.where(n > 1, _NO_PLACE, first.astype(np.uint32)), times)
                order = np.argsort(block, kind="stable")
                block, cells, ask = block[order], cells[order].astype("<u4"), ask[order].astype("<u4")
                begin = np.flatnonzero(np.diff(block, prepend=-1))
                rows = len(begin)
                none = pa.nulls(rows, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(block[begin]), pa.array(np.full(rows, part)), _binaries(cells, begin), _binaries(ask, begin), none, none, none, none], columns)
                counts = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[at], minlength=len(sizes)).astype("<u4")
                ids = [piece.column(c).to_numpy(zero_copy_only=False).astype("<i8") for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([part]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), *[pa.array([x.tobytes()], pa.binary()) for x in (*ids, counts, known)]], columns)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by block. A cell counted twice stays so: what is known to repeat is answered as soon as some rows
        # wait, and what goes on waiting has a cell counted once, of which a block has few, however often an anchor comes.
        current, counts, new, size = None, None, [], 0
        open_ones = nothing = [np.zeros(0, np.int64), np.zeros(0, "<u4"), np.zeros(0, "<u4")]

        def settled() -> pa.RecordBatch:
            nonlocal open_ones, new, size
            cells, places = (np.frombuffer(b"".join(r[i] for r in new), "<u4") for i in (1, 2))
            part = np.repeat(np.array([r[0] for r in new], np.int64), [len(r[1]) // 4 for r in new])
            new, size = [], 0
            for row, seen in zip(counts, halves(cells), strict=True):
                np.minimum(row + np.bincount(seen, minlength=1 << 16), 2, out=row)
            asked = places != _NO_PLACE
            part, cells, places = (np.concatenate([old, x[asked]]) for old, x in zip(open_ones, (part, cells, places), strict=True))
            known = twice(cells, counts)
            open_ones = [part[~known], cells[~known], places[~known]]
            part, places = part[known], places[known]
            begin = np.flatnonzero(np.diff(part, prepend=-1))
            return pa.RecordBatch.from_arrays([pa.array(part[begin], pa.int64()), _binaries(places, begin)], ["part", "places"])

        for batch in batches:
            for block, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if block != current:
                    if new:
                        yield settled()
                    current, counts, open_ones = block, np.zeros((2, 1 << 16), np.int64), nothing
                new.append(row)
                size += len(row[1])
                if size > WAITING_BYTES:
                    yield settled()
        if new:
            yield settled()

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, variants, counts, known, lists in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                place = np.sort(np.frombuffer(b"".join([known, *(lists or [])]), "<u4")).astype(np.int64)
                ends = np.cumsum(np.frombuffer(counts, "<u4").astype(np.int64))
                doc = np.searchsorted(ends, place, side="right")
                begin = np.flatnonzero(np.diff(doc, prepend=-1))
                ordinal = (place - (ends - np.frombuffer(counts, "<u4"))[doc]).astype("<u4") if len(doc) else place.astype("<u4")
                ids = [pa.array(np.frombuffer(x, "<i8")[doc[begin]], pa.int64()) for x in (docs, variants)]
                yield pa.RecordBatch.from_arrays([*ids, _binaries(ordinal, begin)], ["doc_id", "variant", "ordinals"])

    schema = "block long, part long, cells binary, places binary, docs binary, variants binary, counts binary, known binary"
    # parts are numbered as they come, so what they send and what they keep must come from one run
    sketched = cut(docs.select("doc_id", "variant", "text").mapInArrow(freed(sketch), schema))
    sent = sketched.filter("block >= 0").select("block", "part", "cells", "places")
    answered = sent.repartition("block").sortWithinPartitions("block").mapInArrow(freed(merge), "part long, places binary")
    lists = answered.groupBy("part").agg(F.collect_list("places").alias("lists"))
    kept = sketched.filter("block < 0").select("part", "docs", "variants", "counts", "known").join(lists, "part", "left")
    resolved = kept.select("docs", "variants", "counts", "known", "lists").mapInArrow(resolve, "doc_id long, variant long, ordinals binary")
    # a repeated row has its text's anchors twice
    return resolved.groupBy("doc_id", "variant").agg(F.max("ordinals").alias("ordinals"))


def repeats(docs: DataFrame, all_docs: DataFrame, window: int = WINDOW, gram: int = GRAM, blocks: int | None = None) -> DataFrame:
    """(doc_id, variant, text) -> doc_id, variant, starts of windows that also start earlier.

    ``all_docs`` holds ``docs``; its texts are shuffled as the caller joins them, so both use one exchange.
    """
    marked = repeated_anchors(docs, blocks or blocks_for(docs), window, gram)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, 2, TEXT_BYTES):
                h, sizes, start, place = anchors(part.column(2), window, gram)
                if not len(start):
                    continue
                # the anchors' ordinals count on from text to text
                at = np.unique(place)
                n_anchors = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[at], minlength=len(sizes))
                first = np.cumsum(n_anchors) - n_anchors
                own = [np.frombuffer(x, "<u4").astype(np.int64) + f for x, f in zip(part.column(3).to_pylist(), first, strict=True)]
                maybe = np.zeros(len(at), bool)
                maybe[np.concatenate(own)] = True
                start = start[maybe[np.searchsorted(at, place)]]
                if not len(start):
                    continue
                k = hashes.runs(h, window)[start].view(np.int64)
                second = hashes.runs(h, window, hashes.SECOND)[start]
                text = np.repeat(np.arange(len(sizes)), sizes)[start]
                at = start - (np.cumsum(sizes) - sizes)[text]
                doc, variant = (part.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                doc, variant = doc[text], variant[text]
                # of equal windows in this part only the earliest goes on as a candidate; the others are repeats already
                order = np.lexsort((at, doc, second, k))
                same = np.zeros(len(order), bool)
                a, b = order[1:], order[:-1]
                same[1:] = (k[a] == k[b]) & (second[a] == second[b])
                first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
                lead = order[first]
                known = np.empty(len(order), bool)
                known[order] = same & ((doc[order] != doc[lead]) | (at[order] != at[lead]))
                # repeats are spread evenly: they need no group
                spread = hashes.mix(k.view(np.uint64) + np.arange(len(k), dtype=np.uint64) + hashes.FIRST * (doc.view(np.uint64) + np.uint64(1))).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.where(known, spread, k)), pa.array(np.where(known, 0, second >> np.uint64(33)).astype(np.int32)), pa.array(known), pa.array(doc), pa.array(variant), pa.array(at.astype(np.int32))],
                    ["k1", "k2", "known", "doc_id", "variant", "at"],
                )

    chosen = all_docs.select("doc_id", "variant", "text").join(marked, ["doc_id", "variant"]).select("doc_id", "variant", "text", "ordinals")
    found = chosen.mapInArrow(freed(candidates), "k1 long, k2 int, known boolean, doc_id long, variant long, at int")
    # equal windows meet, at most one a part; rank 1 is the earliest (and the same place of a repeated row)
    order = Window.partitionBy("k1", "k2", "known").orderBy("doc_id", "at")
    later = found.withColumn("rank", F.rank().over(order)).filter(F.col("known") | (F.col("rank") > 1))
    return later.groupBy("doc_id", "variant").agg(F.collect_list("at").alias("starts"))


def later_copies(keyed: DataFrame) -> DataFrame:
    """(doc_id, variant) of the texts that equal the text of a smaller id."""
    hashed = keyed.filter("text IS NOT NULL").select("doc_id", "variant", F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit(1)).alias("t2"))
    firsts = hashed.groupBy("t1", "t2").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return cut(hashed.join(firsts, ["t1", "t2"]).filter("doc_id > first_id").select("doc_id", "variant").distinct())


def cut_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, blocks: int | None = None) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, n_removed, kept (words left, joined by one space)."""
    none = -(1 << 63)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(none)).alias("doc_id"), "text")
    # only where an id has several rows is the text needed to tell them apart
    twins = docs.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    keyed = docs.select("doc_id", (F.xxhash64("text") if twins else F.lit(0).cast("long")).alias("variant"), "text")
    later = later_copies(keyed)
    found = repeats(keyed.join(few(later), ["doc_id", "variant"], "left_anti"), keyed, window, gram, blocks).withColumn("whole", F.lit(False))
    found = found.unionByName(later.select("*", F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("whole")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, 1, TEXT_BYTES):
                n_words, n_removed, kept = [], [], []
                for text, starts, whole in zip(part.column(1).to_pylist(), part.column(2), part.column(3).to_pylist(), strict=True):
                    words = [w for w in SEPARATORS.split(text or "") if w]
                    n_words.append(len(words))
                    if whole and len(words) >= window:
                        words = []
                    elif starts.is_valid:
                        change = np.zeros(len(words) + 1, np.int64)
                        at = np.unique(starts.values.to_numpy())
                        change[at] += 1
                        change[at + window] -= 1
                        left = np.cumsum(change[:-1]) == 0
                        words = [words[i] for i in np.flatnonzero(left)]
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(" ".join(words))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    texts = keyed.select("doc_id", "variant", "text")
    done = texts.join(found, ["doc_id", "variant"], "left").select("doc_id", "text", "starts", "whole").mapInArrow(freed(run), "doc_id long, n_words long, n_removed long, kept string")
    return done.withColumn("doc_id", F.nullif("doc_id", F.lit(none)))
