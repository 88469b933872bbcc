"""Best-fit packing with certified bin counts.

Documents are tokenised where they lie and cut into pieces of at most ``capacity`` tokens. Pieces are dealt evenly over
partitions and packed there by best-fit decreasing. A lower bound from dual-feasible functions tells how many sequences
a partition needs at least; where the count meets it, the packing is certified. Partitions with a gap give up their
emptiest sequences; these exchange documents in new partitions and are packed again, and the new packing is kept only
where it takes fewer sequences.

Defined results: null text is the empty text, which is one piece holding only the end id; repeated rows are packed as
often as they occur; a null id stays null; an empty table gives an empty result; other columns are ignored. Very long
documents are cut, never shortened. Ties in length are broken by row number.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaptrail.llm.common import cut, freed, parts_of

CAPACITY = 2048
END_ID = 0
PIECES_TYPE = "doc_id long, piece int, start long, length long, ids binary"
#: bounds of a worker's table of words
CACHE_WORDS, CACHE_BYTES = 400_000, 16 << 20
TEXT_BYTES = 2 << 20
GROUP = 50_000


def _gather(flat: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Runs of ``flat`` one after another, each by its begin and length."""
    some = n > 0
    begin, n = begin[some], n[some]
    if not len(n):
        return flat[:0]
    # begins of the runs, then steps of one: a running sum gives every place
    ends = np.cumsum(n)
    index = np.ones(int(ends[-1]), np.int64)
    index[0] = begin[0]
    index[ends[:-1]] = begin[1:] - (begin[:-1] + n[:-1] - 1)
    return flat[np.cumsum(index)]


class WordTokenizer:
    """Ids of many texts by a vocabulary file whose tokens never span a space or a line break.

    Splitting at spaces and line breaks and joining the ids of the words gives the ids of the whole text. A word of Latin
    letters and then ASCII marks, which lower-casing alone normalises, is a stem and an end, each of which the vocabulary's
    model reads alone; all other words take the tokenizer's whole path. Stems, ends and other words are read once while
    they stay in a table that is bounded in rows and bytes.
    """

    # no apostrophe (it may begin a contraction) and no sign of the special tokens
    simple = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*[!-&(-/:;=?@\\[\\\\\\]^_`{}~]*$"
    stem, end = "^[a-z\u00df-\u00f6\u00f8-\u00ff]*", "[^a-z\u00df-\u00f6\u00f8-\u00ff]+$"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, 0x100)}
        self.reset()

    def reset(self) -> None:
        """Only the empty word is known, as row 0."""
        self.known = pa.array([""], pa.string())
        self.flat, self.begin, self.count = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def learn(self, words: pa.Array, ids: list[list[int]]) -> None:
        counts = np.fromiter((len(i) for i in ids), np.int64, len(ids))
        begin = len(self.flat) + np.cumsum(counts) - counts
        self.flat = np.concatenate([self.flat, np.fromiter((x for i in ids for x in i), np.uint32, int(counts.sum()))])
        self.begin, self.count = np.append(self.begin, begin), np.append(self.count, counts)
        self.known = pa.concat_arrays([self.known, words])

    def rows_of(self, simple: pa.Array, others: pa.Array) -> np.ndarray:
        """Rows of the table, of stems and ends first, then of the words that need the tokenizer's whole path."""
        words = pa.concat_arrays([simple, others])
        row = pc.fill_null(pc.index_in(words, self.known), -1).to_numpy().astype(np.int64)
        if (missing := np.flatnonzero(row < 0)).size:
            row[missing] = len(self.known) + np.arange(len(missing))
            new = words.take(pa.array(missing))
            texts, n = new.to_pylist(), int((missing < len(simple)).sum())
            read = self.tokenizer.model.tokenize
            ids = [[t.id for t in read(w if w.isascii() else w.translate(self.letters))] for w in texts[:n]]
            self.learn(new, ids + [e.ids for e in self.tokenizer.encode_batch_fast(texts[n:], add_special_tokens=False)])
        return row

    def word_rows(self, words: pa.Array) -> np.ndarray:
        """(words, 2) rows of the stem and the end of distinct words."""
        if len(self.known) > CACHE_WORDS or self.known.nbytes > CACHE_BYTES:
            self.reset()
        simple = pc.match_substring_regex(words, self.simple)
        own = simple.to_numpy(zero_copy_only=False)
        low = pc.utf8_lower(words.filter(simple))
        stems = pc.replace_substring_regex(low, self.end, "").dictionary_encode()
        ends = pc.replace_substring_regex(low, self.stem, "").dictionary_encode()
        row = self.rows_of(pa.concat_arrays([stems.dictionary, ends.dictionary]), words.filter(pc.invert(simple)))
        n, m = len(stems.dictionary), len(ends.dictionary)
        rows = np.zeros((len(words), 2), np.int64)
        rows[own, 0], rows[own, 1] = row[:n][stems.indices.to_numpy()], row[n : n + m][ends.indices.to_numpy()]
        rows[~own, 0] = row[n + m :]
        return rows

    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        rows = self.word_rows(coded.dictionary)
        # the ids of each distinct word, then those of the words in their order
        parts = rows.ravel()
        flat, n = _gather(self.flat, self.begin[parts], self.count[parts]), self.count[rows].sum(1)
        at = coded.indices.to_numpy()
        begin, n = (np.cumsum(n) - n)[at], n[at]
        sizes = np.add.reduceat(n, split.offsets.to_numpy()[:-1] - split.offsets[0].as_py())
        return _gather(flat, begin, n), sizes


@functools.cache
def word_tokenizer(path: str) -> WordTokenizer:
    """One a Python worker, so that its tasks share the words they know."""
    return WordTokenizer(path)


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece with its ids (little-endian unsigned 32-bit); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path)
        for batch in batches:
            for part in parts_of(batch, 1, TEXT_BYTES):
                ids, sizes = tokenizer.encode_many(part.column(1))
                # the end id behind every text
                ends = np.cumsum(sizes)
                ids = np.insert(ids, ends, END_ID).astype("<u4")
                sizes = sizes + 1
                first = np.cumsum(sizes) - sizes
                pieces = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, sizes[doc] - start)
                begin = (first[doc] + start) * 4
                offsets = np.append(begin, len(ids) * 4).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), data], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(freed(run), PIECES_TYPE)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every piece, and the number of bins."""
    order = np.argsort(-lengths, kind="stable")
    bins, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, made = 0, 0  # a bit for each room that some bin has
    for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = open_rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            room, b, made = capacity, made, made + 1
        bins[i], offset[i] = b, capacity - room
        if room > length:
            by_room[room - length].append(b)
            open_rooms |= 1 << (room - length)
    return bins, offset, made


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences needed at least: the largest sum over dual-feasible functions of the sizes.

    Two families: sizes above 1-e count 1 and those below e count 0; and the rounding functions u_k, which map x to
    floor((k+1)x)/k unless (k+1)x is whole.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    total, number = np.cumsum(count * size), np.cumsum(count)
    e = np.arange(0, capacity // 2 + 1)
    large = number[-1] - number[capacity - e]
    middle = total[capacity - e] - np.where(e > 0, total[np.maximum(e - 1, 0)], 0)
    best = int((-(-(large * capacity + middle) // capacity)).max())
    for k in range(1, 33):
        scaled = (k + 1) * size
        whole = scaled % capacity == 0
        # k * capacity times the function, so that all is in whole numbers
        value = np.where(whole, k * size, scaled // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def _packer(capacity: int, base: int):
    """Packs a group; a repacked one takes its old sequences where it saves none. Emits which rows may be repacked."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["length"].to_numpy(np.int64)
        rows = rows.assign(row=rows["row"].to_numpy(np.int64)).sort_values("row", ignore_index=True)
        lengths = rows["length"].to_numpy(np.int64)
        bins, offset, made = best_fit_decreasing(lengths, capacity)
        sequence = base + (rows["part"].to_numpy(np.int64) << 32) + bins
        old = rows["sequence_id"].to_numpy(np.int64)
        before = len(np.unique(old)) if (old >= 0).all() else made + 1
        if made >= before:
            sequence, offset, made = old, rows["offset"].to_numpy(np.int64), before
        gap = made - lower_bound(lengths, capacity)
        _, place = np.unique(sequence, return_inverse=True)
        fill = np.bincount(place, lengths).astype(np.int64)
        give = np.zeros(len(fill), bool)
        if gap > 0:
            emptiest = np.argsort(fill, kind="stable")[: max(64, 16 * gap)]
            give[emptiest[fill[emptiest] < capacity]] = True
        return pd.DataFrame({"row": rows["row"], "length": lengths, "sequence_id": sequence, "offset": offset, "open": give[place], "gap": np.int64(gap)})

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int = 3) -> DataFrame:
    """(row, length) -> (row, length, sequence_id, offset). ``row`` is unique; groups hold about ``group`` pieces.

    Full pieces are sequences of their own. ``pieces`` should be a checkpointed table: it is read once a round.
    """
    full = pieces.filter(F.col("length") == capacity).select("row", "length", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    todo = pieces.filter(F.col("length") < capacity).select("row", "length", F.lit(-1).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done = full
    schema = "row long, length long, sequence_id long, offset long, open boolean, gap long"
    for r in range(rounds):
        n = todo.count()
        if not n:
            break
        # rows of one sequence stay together when they are dealt anew
        key = F.col("row") if r == 0 else F.col("sequence_id")
        parts = max(1, math.ceil(n / group))
        dealt = todo.withColumn("part", F.pmod(F.xxhash64(key, F.lit(r)), F.lit(parts)).cast("long"))
        packed = cut(dealt.groupBy("part").applyInPandas(_packer(capacity, r << 56), schema))
        done = done.unionByName(packed.filter(~F.col("open")).drop("open", "gap"))
        todo = packed.filter("open").drop("open", "gap")
        if parts == 1:
            break
    return done.unionByName(todo)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    pieces = pieces_of(docs, tokenizer_path, capacity).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    pieces = cut(pieces).withColumn("row", F.monotonically_increasing_id())
    return pieces.join(pack(pieces.select("row", "length"), capacity, group).select("row", "sequence_id", "offset"), "row").drop("row")
