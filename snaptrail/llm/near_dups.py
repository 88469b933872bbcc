"""Near-duplicate documents by BagMinHash.

A text is the bag of its runs of five words. Each distinct run with weight w starts a Poisson process over (time, level)
for every dyadic interval of levels that begins below w; points above w are thinned out by their level. So texts that
share a run share its points up to the lower weight, and the earliest point in each signature place agrees with
probability equal to the weighted Jaccard similarity. Processes that can no longer beat the signature stop, so most runs
yield one point only. (The intervals are a fixed hierarchy, the halves of which are not split again while points are
drawn: weights are counts of runs, and a count of w takes log2(w) processes.)

Signatures are cut to bands; texts that share a band are candidates, verified by exact bag overlap. Equal texts are one
node from the start. In a band's bucket every node is compared with one centre, the node whose bands are shared most (a
star, not all pairs); verified links join nodes to components. Only where a bucket still holds several components are
nodes compared across them, and only pairs that no exact bound rules out: the sizes of the bags, and for nodes with many
such partners the runs that no other such node has, then an overlap of the bags in 16-bit cells, which is never too small.
So no link is lost to a centre or a bound, and a link is lost only if the pair shares no band (5e-8 at 0.8) and nothing
else joins it.

Defined results: null text is the empty text; a text of one to four words is one run; texts without words are alike only
if equal; equal similarity to the threshold counts; rows with one id and several texts belong to the class of each; an
empty table gives an empty result; extra columns are ignored. The class id is the smallest doc_id of the class.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snaptrail.llm import hashes
from snaptrail.llm.common import cut, few, freed, parts_of

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 32, 4
LINKS_A_PART = 500_000
TEXT_BYTES = 2 << 20
#: partners in other components up to which a node's pairs are formed by size alone
FEW_PARTNERS = 64
#: pairs of one node that are compared in one place
PAIRS_A_COPY = 512
#: runs of a bag up to which its cells are compared before its text is fetched
CELLS = 1 << 13
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of all texts: text, hash, count; sorted by text and hash."""
    h, sizes = hashes.words(hashes.lower_words(texts))
    n = len(sizes)
    run = hashes.runs(h, SHINGLE)
    inside = hashes.of_texts(sizes, SHINGLE)
    of = np.repeat(np.arange(n), sizes)
    text, run = of[: len(inside)][inside], run[inside]
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    if len(short):
        # all words of a short text are one run
        first = np.cumsum(sizes) - sizes
        power = np.uint64(0x94D049BB133111EB)
        own = [hashes.mix(np.array([reduce(lambda a, b: (a * int(power) + int(b)) & ((1 << 64) - 1), h[first[i] : first[i] + sizes[i]].tolist(), int(sizes[i]))], np.uint64))[0] for i in short]
        text, run = np.append(text, short), np.append(run, np.array(own, np.uint64))
    if not len(text):
        return text.astype(np.int64), run, np.zeros(0, np.int64)
    order = np.lexsort((run, text))
    text, run = text[order], run[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (run[1:] != run[:-1])
    at = np.flatnonzero(new)
    return text[at], run[at], np.diff(np.append(at, len(text)))


def _uniform(seed: np.ndarray) -> np.ndarray:
    return ((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(text: np.ndarray, run: np.ndarray, weight: np.ndarray, n: int, places: int = BANDS * ROWS) -> np.ndarray:
    """(n, places) times of the earliest points; infinity for empty bags. Arguments as from ``bags``."""
    out = np.full(n * places, np.inf)
    # dyadic intervals of levels: [0,1), [1,2), [2,4), ...; one process each, of rate the interval's length
    depth = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    item = np.repeat(np.arange(len(text)), depth)
    level = np.arange(len(item)) - np.repeat(np.cumsum(depth) - depth, depth)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    width = np.where(level > 0, 2.0 ** (level - 1), 1.0)
    doc, top = text[item], weight[item].astype(np.float64)
    state = hashes.mix(run[item] + level.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    time = np.zeros(len(item))
    step = 0
    while len(item):
        step += 1
        state = state + _GOLD
        a = hashes.mix(state)
        time = time - np.log(_uniform(a)) / width
        b = hashes.mix(a ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        place = (b >> np.uint64(40)).astype(np.int64) % places
        # the point's level inside the interval: the coin tosses down the interval's tree
        inside = low + width * ((b & np.uint64((1 << 40) - 1)).astype(np.float64) * 2.0**-40) < top
        np.minimum.at(out, doc[inside] * places + place[inside], time[inside])
        worst = out.reshape(n, places).max(1)
        alive = time < worst[doc]
        if not alive.all():
            doc, top, state, time, low, width, item = doc[alive], top[alive], state[alive], time[alive], low[alive], width[alive], item[alive]
    return out.reshape(n, places)


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(n, bands) keys; equal in a place iff all times of the band are."""
    bits = sig.view(np.uint64).reshape(len(sig), bands, -1)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _GOLD, bits.shape[:2])
    for j in range(bits.shape[2]):
        key = hashes.mix(key ^ bits[:, :, j])
    return key.view(np.int64)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact weighted Jaccard similarity of two bags (sorted hashes, counts)."""
    total = int(a[1].sum() + b[1].sum())
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (total - both) if total > both else 0.0


def text_keys(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2")]


def banded(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, t1, t2, bands (none for texts without words), size (runs in the bag); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, 3, TEXT_BYTES):
                text, h, weight = bags(part.column(3))
                keys = band_keys(signatures(text, h, weight, part.num_rows))
                full = np.zeros(part.num_rows, bool)
                full[text] = True
                offsets = np.append(0, np.cumsum(full * BANDS)).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[full].ravel()))
                size = np.bincount(text, weight, part.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], bands, pa.array(size)], ["doc_id", "t1", "t2", "bands", "size"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_keys(F.col("text")), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, t1 long, t2 long, bands array<long>, size long")


def bags_of(text: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sorted hashes, counts) of each text."""
    of, h, count = bags(text)
    at = np.searchsorted(of, np.arange(len(text) + 1))
    return [(h[i:j], count[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]


def with_side(pairs: DataFrame, values: DataFrame, value: str, side: str, other: str, ids: DataFrame) -> DataFrame:
    """Pairs with the value of one side; ids: the pairs without values.

    A node of many pairs has its value copied once for so many, so that no task gets them all.
    """
    own = values.select(F.col("node").alias(side), F.col(value).alias(f"{value}_{side}"))
    many = cut(ids.groupBy(side).agg(F.floor(F.count("*") / PAIRS_A_COPY).cast("int").alias("copies")).filter("copies > 0"))
    if many.isEmpty():
        return pairs.join(own, side)
    many = few(many)
    dealt = pairs.join(many, side, "left").withColumn("copy", F.pmod(F.xxhash64(other), F.coalesce("copies", F.lit(0)) + 1)).drop("copies")
    copied = own.join(many, side, "left").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(0)).cast("long")))).drop("copies")
    return dealt.join(copied, [side, "copy"]).drop("copy")


def with_both(pairs: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """a, b, value of a, value of b of distinct pairs. values: node, value."""
    ids = pairs.select("a", "b")
    return with_side(with_side(ids, values, value, "b", "a", ids), values, value, "a", "b", ids).select("a", "b", f"{value}_a", f"{value}_b")


def verified(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose bags overlap enough. pairs: distinct. texts: node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, 2, TEXT_BYTES):
                # a centre's text comes many times in a row
                centres = part.column(3).dictionary_encode()
                index, right = centres.indices.to_numpy(), bags_of(centres.dictionary)
                keep = [overlap(x, right[index[i]]) >= similar - 1e-12 for i, x in enumerate(bags_of(part.column(2)))]
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in part.columns[:2]], ["a", "b"])

    return with_both(pairs, texts, "text").mapInArrow(freed(run), "a long, b long")


def numbered(cells: np.ndarray) -> np.ndarray:
    """Sorted cells made distinct: the second of equal ones meets only another second."""
    first = np.searchsorted(cells, cells)
    return (np.arange(len(cells)) - first) << 16 | cells.astype(np.int64)


def cells_of(texts: DataFrame, most: int = CELLS) -> DataFrame:
    """node, cells: each bag's run hashes cut to 16 bits, numbered where they repeat; null for bags of more than ``most`` runs.

    Two bags have at least as many cells in common as runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, 1, TEXT_BYTES):
                cells = [numbered(np.sort(np.repeat((h >> np.uint64(48)).astype(np.uint16), count))) if count.sum() <= most else None for h, count in bags_of(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cells, pa.list_(pa.int32()))], ["node", "cells"])

    return texts.select("node", "text").mapInArrow(freed(run), "node long, cells array<int>")


def unshared(texts: DataFrame) -> DataFrame:
    """node, alone: how many runs of a text (with repeats) no other of the texts has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, 1, TEXT_BYTES):
                of, h, count = bags(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), pa.array(h.view(np.int64)), pa.array(count.astype(np.int32))], ["node", "h", "n"])

    runs = texts.select("node", "text").mapInArrow(freed(run), "node long, h long, n int")
    single = runs.groupBy("h").agg(F.count("*").alias("nodes"), F.min("node").alias("node"), F.min("n").alias("n")).filter("nodes = 1")
    return single.groupBy("node").agg(F.sum("n").alias("alone"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that links lead to. Labels fall along links and jump to their label's label.

    Only linked nodes take part; tables are kept in as few partitions as their rows need.
    """
    parts = 1 + links.count() // LINKS_A_PART
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().coalesce(parts))
    label = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node").coalesce(parts))
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = label.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = cut(lower.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("next", "root")).alias("root")).coalesce(parts))
        label = after.select("node", "root")
        if after.filter("old <> root").isEmpty():
            break
    return cut(nodes.select("node").join(label, "node", "left").select("node", F.coalesce("root", "node").alias("root")))


def across(placed: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """(a, b): nodes of different components that share a band and may be alike, from (key, node, root, size); each pair once.

    In a bucket the nodes outside its largest component meet the others. Two bags are no more similar than the smaller is
    large against the larger. Of nodes with many partners more is known: the runs that no other such node has lie outside
    every overlap of two of them, which drops most of them before they meet anyone; and their bags' cells are compared.
    """
    of_root = placed.groupBy("key", "root").agg(F.count("*").alias("own"), F.min("size").alias("least"))
    largest = F.max(F.struct("own", "root"))
    of_key = of_root.groupBy("key").agg(F.sum("own").alias("all"), F.min("least").alias("least"), largest.alias("main"), F.count("*").alias("roots")).filter("roots > 1")
    of_key = of_key.select("key", "all", "least", F.col("main.root").alias("main"), (F.col("all") - F.col("main.own")).alias("outside"))
    mixed = cut(placed.join(of_root.drop("least").join(of_key, "key"), ["key", "root"]))
    nodes = mixed.groupBy("node").agg(F.sum(F.col("all") - F.col("own")).alias("partners"), F.collect_list("key").alias("keys"))
    nodes = cut(nodes.withColumn("busy", F.col("partners") > FEW_PARTNERS).drop("partners"))
    busy = texts.join(few(nodes.filter("busy").select("node")), "node", "left_semi")
    known = cut(cells_of(busy).join(unshared(busy), "node", "left"))
    nodes = nodes.join(known, "node", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
    rows = mixed.select("key", "node", "root", "size", "main", "least", "outside").join(nodes, "node")
    # where many nodes are outside the largest component all nodes have many partners, the smallest of which is ``least``
    lonely = (F.col("outside") > FEW_PARTNERS) & ((F.col("size") - F.col("alone")) * (1 + similar) < (F.col("size") + F.col("least")) * (similar - 1e-12))
    rows = cut(rows.filter(~lonely).drop("least", "outside"))
    other = rows.select(*[F.col(c).alias(f"other_{c}") for c in rows.columns])
    once = (F.col("root") != F.col("other_root")) & ((F.col("other_root") == F.col("main")) | (F.col("root") < F.col("other_root")))
    alike = F.least("size", "other_size") >= F.greatest("size", "other_size") * (similar - 1e-12)
    enough = (F.col("size") + F.col("other_size")) * (similar - 1e-12)
    both = F.least(F.col("size") - F.col("alone"), F.col("other_size") - F.col("other_alone"))
    bound = ~(F.col("busy") & F.col("other_busy")) | (both * (1 + similar) >= enough)
    # a pair comes from the smallest of its shared bands only
    first = F.array_min(F.array_intersect("keys", "other_keys")) == F.col("key")
    cells = F.col("cells").isNull() | F.col("other_cells").isNull() | (F.size(F.array_intersect("cells", "other_cells")) * (1 + similar) >= enough)
    met = (F.col("key") == F.col("other_key")) & once & alike & bound & first & cells
    pairs = rows.filter("root <> main").join(other, met)
    return pairs.select(F.greatest("node", "other_node").alias("a"), F.least("node", "other_node").alias("b"))


def centres(member: DataFrame) -> DataFrame:
    """key, centre: of every bucket of several nodes the node whose buckets are the largest, from (key, node)."""
    shared = member.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    known = member.join(shared, "key").groupBy("node").agg(F.sum("n").alias("n"), F.collect_list("key").alias("keys"))
    return known.select(F.struct("n", "node").alias("rank"), F.explode("keys").alias("key")).groupBy("key").agg(F.max("rank").alias("rank")).select("key", F.col("rank.node").alias("centre"))


def classes_of_texts(docs: DataFrame, similar: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t1, t2) of every row, and t1, t2, first_id, copies, root of every distinct text."""
    sigs = cut(banded(docs))
    # equal texts are one node; node numbers are in no order of the texts
    classes = sigs.groupBy("t1", "t2").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("size").alias("size"))
    nodes = cut(classes).withColumn("node", F.monotonically_increasing_id())
    member = nodes.select("node", F.explode("bands").alias("key"))
    # only buckets of several nodes matter from here on
    member = cut(member.join(centres(member), "key").select("key", "node", "centre"))
    wanted = nodes.join(member.select("node").distinct(), "node", "left_semi").select("node", "t1", "t2", "first_id")
    source = docs.select(F.col("doc_id").cast("long").alias("first_id"), *text_keys(F.col("text")), F.coalesce("text", F.lit("")).alias("text"))
    texts = source.join(wanted, (source.t1 == wanted.t1) & (source.t2 == wanted.t2) & source.first_id.eqNullSafe(wanted.first_id)).select("node", "text")
    # a repeated row gives its node's text twice
    texts = cut(texts.dropDuplicates(["node"]))
    star = cut(member.select(F.col("node").alias("a"), F.col("centre").alias("b")).filter("a <> b").distinct())
    links = cut(verified(star, texts, similar))
    root = components(nodes, links)
    more = across(member.select("key", "node").join(root.join(nodes.select("node", "size"), "node"), "node"), texts, similar)
    more = cut(verified(cut(more), texts, similar))
    if not more.isEmpty():
        root = components(nodes, links.unionByName(more))
    return sigs.select("doc_id", "t1", "t2"), nodes.select("node", "t1", "t2", "first_id", "copies").join(root, "node")


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id, class_size: every row's class of near duplicates."""
    rows, placed = classes_of_texts(docs, similar)
    ids = placed.groupBy("root").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_size"))
    by_text = placed.join(ids, "root").select("t1", "t2", "class_id", "class_size")
    return rows.join(by_text, ["t1", "t2"]).select("doc_id", "class_id", "class_size")


def representatives(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """first_id, t1, t2 (as from ``text_keys``): the text that stays of each class, that of the smallest doc_id.

    An id that is null comes after all others; of several texts under that id the one with the smallest hashes stays.
    """
    _, placed = classes_of_texts(docs, similar)
    least = F.min(F.struct(F.col("first_id").isNull(), "first_id", "t1", "t2"))
    return placed.groupBy("root").agg(least.alias("r")).select("r.first_id", "r.t1", "r.t2")
