"""Alignment of two tokenizers' readings of the same texts.

Both readings tile the bytes of a blank and the text. Every token points to the token of the other reading that reaches
farthest to the right among those it overlaps; the successors are doubled until all tokens of a component point to its last
one, which labels the group. Links are the pairs of tokens that overlap; how often two ids are linked is counted over the
whole corpus.

How it runs: texts are read once, where they lie, words and runs of pieces from tables of known ones, bounded in rows; each
text's pairs of ids are kept in a checkpoint (some 0.8 of the text's size). Pairs are counted within a task before they are
shuffled. At most ``frequent`` pairs can hold a ``frequent``-th of all links each; only those are sent to the executors (a
proven bound) and settled where the texts' pairs lie. All other pairs meet their counts in a join, in which no pair holds
more than that share of rows.

Defined results: null and empty texts, and texts that a reading doesn't give back byte for byte, have no tokens (zeros and an
empty digest); special strings in texts are plain text; repeated rows count as often as they occur and stay repeated; other
columns pass through if they are asked for, columns named like new ones are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from snaptrail.llm.common import cut, freed, parts_of
from snaptrail.llm.packing import _gather
from snaptrail.llm.transducers import Splitter, byte_alphabet, character_classes, cut_bytes, string_bytes

FREQUENT = 500_000
TEXT_BYTES = 2 << 20
KNOWN_WORDS = 500_000
PAIRS = 1 << 21
NEW = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Readings:
    """Ids of words, each read once while it stays in a bounded table."""

    def __init__(self, read: Callable[[list[bytes]], list[list[int]]], token_bytes: list[bytes]) -> None:
        self.read, self.token_bytes = read, token_bytes
        self.lengths = np.array([len(t) for t in token_bytes], np.int64)
        self.reset()

    def reset(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.flat, self.begin, self.n, self.same = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def learn(self, words: list[bytes]) -> None:
        ids = self.read(words)
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(n.sum()))
        self.begin = np.append(self.begin, len(self.flat) + np.cumsum(n) - n)
        self.flat, self.n = np.append(self.flat, flat), np.append(self.n, n)
        # the bytes of all tokens against those of all words, and one by one only where they differ
        known, same = self.token_bytes, np.ones(len(words), bool)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.concatenate([[0], np.cumsum(self.lengths[flat])])[np.cumsum(n)]
        if not np.array_equal(ends, np.cumsum(sizes)) or b"".join([known[i] for i in flat.tolist()]) != b"".join(words):
            same = np.array([b"".join([known[i] for i in x]) == w for x, w in zip(ids, words, strict=True)])
        self.same = np.append(self.same, same)
        self.rows.update(zip(words, range(len(self.rows), len(self.rows) + len(words)), strict=True))

    def tokens(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids one after another, how many each word has, and whether their bytes are the word's."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.rows) > KNOWN_WORDS:
            self.reset()
        if missing := [w for w in distinct if w not in self.rows]:
            self.learn(missing)
        row = np.fromiter(map(self.rows.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        return _gather(self.flat, self.begin[row], self.n[row]), self.n[row], self.same[row]


def byte_readings(path: str) -> Readings:
    """By a byte-level BPE of the tokenizers library; special strings are plain text."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    alphabet = byte_alphabet()
    as_text = {b: c for c, b in alphabet.items()}
    table = str.maketrans({chr(b): c for b, c in as_text.items()})
    token_bytes = [b""] * (max(vocabulary.values()) + 1)
    for t, i in vocabulary.items():
        token_bytes[i] = bytes(alphabet[c] for c in t)
    model = tokenizer.model  # a word is one unit of the splitter, so only the model is left to ask
    return Readings(lambda words: [[t.id for t in model.tokenize(w.decode("latin-1").translate(table))] for w in words], token_bytes)


def piece_readings(path: str) -> Readings:
    """By a sentencepiece model whose pieces hold no blank after another character; a word begins with the blank the model adds."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any("▁" in p.lstrip("▁") for i, p in enumerate(pieces) if not model.is_control(i)):
        raise ValueError("pieces across words can't be read word by word")
    token_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    blank = [model.piece_to_id("▁")]

    def read(words: list[bytes]) -> list[list[int]]:
        return [ids or blank for ids in model.encode([w[1:].decode() for w in words], num_threads=1)]

    return Readings(read, token_bytes)


def counted(values: np.ndarray, kind: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs."""
    values = np.sort(values, kind=kind)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])[: len(values)])
    return values[first], np.diff(first, append=len(values))


def groups_of(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of every token of either reading, by the bytes where tokens end; both end at the same byte.

    A token points to the overlapping token that ends farthest to the right; of tokens that end alike, that of the first
    reading. Doubling the successors leads every token to the last one of its component.
    """
    own = np.arange(len(a_end))
    over = np.searchsorted(b_end, a_end)  # holds the token's last byte
    successor = np.concatenate([np.where(b_end[over] > a_end, len(a_end) + over, own), np.searchsorted(a_end, b_end)]) if len(a_end) else own
    while True:
        farther = successor[successor]
        if np.array_equal(farther, successor):
            break
        successor = farther
    last = successor[: len(a_end)] == own
    number = np.cumsum(last) - last
    label = number[successor]
    return label[: len(a_end)], label[len(a_end) :]


class Aligner:
    """Reads texts both ways and aligns them; one a Python worker."""

    def __init__(self, byte_path: str, piece_path: str, classes: tuple[np.ndarray, np.ndarray]) -> None:
        self.splitter, self.a, self.b = Splitter(classes), byte_readings(byte_path), piece_readings(piece_path)
        self.n_b = len(self.b.token_bytes)
        ids = [[f"{i}{mark}" for i in range(len(r.token_bytes)) for mark in marks] for r, marks in ((self.a, ",|"), (self.b, (",", ";", "")))]
        self.written, self.b_written = pa.array(ids[0] + ids[1]), len(ids[0])

    def read(self, texts: pa.Array) -> Aligned:
        texts = pc.fill_null(texts.cast(pa.string()), "")
        told = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
        spaced = pc.binary_join_element_wise(pa.scalar(" "), texts.filter(pa.array(told)), "")
        words, starts, offsets = self.splitter.words(spaced)
        data, _ = string_bytes(spaced)
        blank = data == 0x20
        runs = np.flatnonzero(blank & ~np.concatenate([[False], blank[:-1]]) | np.isin(np.arange(len(data)), offsets[:-1], kind="table")) if len(data) else np.zeros(0, np.int64)
        kept, sides = np.ones(len(offsets) - 1, bool), []
        for readings, values, at in ((self.a, words, starts), (self.b, cut_bytes(data, runs), runs)):
            ids, n, same = readings.tokens(values)
            text = np.searchsorted(offsets, at, side="right") - 1
            kept &= np.bincount(text[~same], minlength=len(kept)) == 0
            sides.append((ids, np.repeat(text, n), readings.lengths[ids]))
        place = np.flatnonzero(told)
        aligned = Aligned(self, len(texts))
        for ids, text, length in sides:
            own = kept[text]
            aligned.sides.append((ids[own].astype(np.int64), place[text[own]], np.cumsum(length[own])))
        return aligned


class Aligned:
    """Tokens of a slice of texts, one reading after the other: ids, texts and the bytes where they end."""

    def __init__(self, by: Aligner, n: int) -> None:
        self.by, self.n, self.sides = by, n, []

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Text and pair of ids of every link: between two ends next to each other just one pair of tokens overlaps."""
        (a, text, a_end), (b, _, b_end) = self.sides
        ends, _ = counted(np.concatenate([a_end, b_end]), kind="stable")  # two runs in order
        i = np.searchsorted(a_end, ends)
        return text[i], a[i] * self.by.n_b + b[np.searchsorted(b_end, ends)]

    def described(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Tokens of both readings, groups, and the digest of the groups of each text."""
        (a, a_text, a_end), (b, b_text, b_end) = self.sides
        a_group, b_group = groups_of(a_end, b_end)
        n_groups = int(a_group[-1]) + 1 if len(a) else 0
        of_group = np.zeros(n_groups, np.int64)
        of_group[a_group] = a_text
        a_sum, b_sum = (np.cumsum(np.bincount(g, minlength=n_groups)) for g in (a_group, b_group))
        in_order = np.empty(len(a) + len(b), np.int64)
        a_last = np.append(a_group[1:] != a_group[:-1], True)[: len(a)]
        b_last = np.append(b_group[1:] != b_group[:-1], True)[: len(b)]
        text_last = np.append(b_text[1:] != b_text[:-1], True)[: len(b)]
        in_order[np.arange(len(a)) + (b_sum - np.bincount(b_group, minlength=n_groups))[a_group]] = 2 * a + a_last
        in_order[np.arange(len(b)) + a_sum[b_group]] = self.by.b_written + 3 * b + b_last + text_last
        data, offsets = string_bytes(self.by.written.take(pa.array(in_order)))
        n_a, n_b, groups = (np.bincount(t, minlength=self.n) for t in (a_text, b_text, of_group))
        ends = offsets[np.concatenate([[0], np.cumsum(n_a + n_b)])]
        raw = data.tobytes()
        return n_a, n_b, groups, [hashlib.sha256(raw[x:y]).hexdigest() if y > x else "" for x, y in zip(ends[:-1], ends[1:], strict=True)]


@functools.cache
def aligner(byte_path: str, piece_path: str, first: bytes, kind: bytes) -> Aligner:
    return Aligner(byte_path, piece_path, (np.frombuffer(first, np.int32), np.frombuffer(kind, np.uint8)))


def read_links(docs: DataFrame, made: tuple, text: str, kept: list[str]) -> DataFrame:
    """Every text read both ways: what is told of it, and ``__links``, each pair of ids with how often it is linked (pair << 32 | times)."""
    names = [c.split()[0] for c in NEW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = aligner(*made)
        for batch in batches:
            for part in parts_of(batch, len(kept), TEXT_BYTES):
                read = by.read(part.column(len(kept)))
                n_a, n_b, groups, digests = read.described()
                owner, pair = read.links()
                n_links, nothing = np.bincount(owner, minlength=read.n), np.zeros(read.n, np.int64)
                key, n = counted(owner << 32 | pair)
                ends = np.concatenate([[0], np.cumsum(np.bincount(key >> 32, minlength=read.n))]).astype(np.int32)
                links = pa.ListArray.from_arrays(pa.array(ends), pa.array((key & 0xFFFFFFFF) << 32 | n))
                counts = [pa.array(x.astype(np.int64)) for x in (n_a, n_b, groups, n_links, nothing, nothing)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *counts, pa.array(digests, pa.string()), links], [*kept, *names, "__links"])

    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))
    return rows.mapInArrow(freed(run), StructType([*rows.schema.fields[:-1], *StructType.fromDDL(f"{NEW}, __links array<long>").fields]))


def count_pairs(read: DataFrame) -> DataFrame:
    """(pair, n): how many links of the corpus hold a pair of ids; a task's pairs meet before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [np.zeros(0, np.int64)], 0  # pair << 32 | times

        def merged() -> tuple[np.ndarray, np.ndarray]:
            both = np.sort(np.concatenate(waiting))
            waiting.clear()
            pairs, n = counted(both >> 32, kind="stable")
            return pairs, np.add.reduceat(both & 0xFFFFFFFF, np.cumsum(n) - n) if len(n) else n

        def record(pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])

        for batch in batches:
            waiting.append(batch.column(0).flatten().to_numpy())
            size += len(waiting[-1])
            if size > PAIRS:
                yield record(*merged())
                size = 0
        if waiting:
            yield record(*merged())

    return read.select("__links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text", keep: Sequence[str] | None = None, frequent: int = FREQUENT) -> DataFrame:
    """The kept columns (all but the text, if none are named) with counts of tokens, groups and links, and the groups' digest."""
    import sentencepiece

    names = [c.split()[0] for c in NEW.split(", ")]
    kept = [c for c in (docs.columns if keep is None else keep) if c != text and c not in names]
    made = (byte_path, piece_path, *(a.tobytes() for a in character_classes(byte_path)))
    n_b = sentencepiece.SentencePieceProcessor(model_file=piece_path).get_piece_size()
    # rows of a checkpoint stay where they are, so their places number them
    read = cut(read_links(docs, made, text, kept)).withColumn("__row", F.monotonically_increasing_id())
    counts = cut(count_pairs(read)).withColumn("b", F.col("pair") % n_b)
    # one row an id of the second vocabulary
    highest = counts.groupBy("b").agg(F.max("n").alias("highest"))
    counts = counts.join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    total = counts.agg(F.sum("n")).head()[0] or 0
    # at most ``frequent`` rows
    often = counts.filter(F.col("n") * frequent >= total).sort("pair").toArrow()
    sent = docs.sparkSession.sparkContext.broadcast(tuple(often.column(c).to_numpy() for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times, best = sent.value
        for batch in batches:
            links = batch.column(1)
            sizes, packed = links.value_lengths().to_numpy(), links.flatten().to_numpy()
            pair, n, owner = packed >> 32, packed & 0xFFFFFFFF, np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(known, pair), max(0, len(known) - 1))
            own = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            sums = [np.zeros(len(sizes), np.int64) for _ in range(2)]
            np.add.at(sums[0], owner[own], n[own] * best[at[own]])
            np.add.at(sums[1], owner[own], n[own] * times[at[own]])
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner[~own], minlength=len(sizes)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums), pa.ListArray.from_arrays(pa.array(ends), pa.array(packed[~own]))], ["__row", "__best", "__sum", "__rare"])

    settled = cut(read.select("__row", "__links").mapInArrow(run, "__row long, __best long, __sum long, __rare array<long>"))
    rare = settled.select("__row", F.explode("__rare").alias("x")).select("__row", F.shiftright("x", 32).alias("pair"), F.col("x").bitwiseAND(0xFFFFFFFF).alias("times"))
    others = rare.join(counts, "pair").select("__row", (F.col("times") * F.col("best").cast("long")).alias("__best"), (F.col("times") * F.col("n")).alias("__sum"))
    sums = settled.select("__row", "__best", "__sum").unionByName(others).groupBy("__row").agg(F.sum("__best").alias("__best"), F.sum("__sum").alias("__sum"))
    both = read.drop("__links").join(sums, "__row")
    return both.withColumns({"n_best": F.col("__best"), "count_sum": F.col("__sum")}).select(*kept, *names)
