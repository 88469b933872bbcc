"""Benchmark decontamination: short test items found inside long documents.

Texts are lower-case words (runs of letters and digits), shingled by five; an item of fewer words is one run of all its
words, and documents are shingled by that length too if such items exist. Items are partitioned by size, the power of two
below their number of shingles. An item's sketch is its smallest shingle hashes (bottom-k MinHash); k is set by the size
partition so that a document holding at least ``threshold`` of the item's shingles must hold some of the sketch: of n
shingles at most n - threshold * n are missing, and the sketch has more than that. Documents need no sketch of their own:
their shingles probe the sketches of those size partitions that aren't too large for them to hold. Candidates, those with
as many hits as the bound demands, are verified by exact shingle containment, so nothing is lost. DataFrame functions only.

Defined results: null text has no words; an item without words can't be found; repeated rows of an id count once; of an id
with several texts each text is searched, or looked for, by itself and the best pair counts; documents without an id are
searched like others, under one null id; items without an id are looked for but name no pair; tied items are all
reported; empty tables give an empty result; extra columns are ignored. Sketches are sent to the executors only if they
are few (counted first), else joined by shuffling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaptrail.llm.common import cut, few, words_of

SHINGLE = 5
THRESHOLD = 0.8


def shingles_of(words: str, n: int = SHINGLE) -> Column:
    """Hashes of all runs of n words in an array column."""
    w = F.col(words)
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(n)]))).otherwise(F.array().cast("array<bigint>"))


def with_shingles(df: DataFrame, *keep: str, short: tuple[int, ...] = ()) -> DataFrame:
    """Runs of five words, and of the lengths ``short``.

    Explode ``shingles`` by explode_outer: a filter on them would be pushed below the split and split anew for each word.
    """
    return df.select(*keep, words_of(F.col("text")).alias("words")).select(*keep, F.concat(shingles_of("words"), *[shingles_of("words", n) for n in short]).alias("shingles"))


def sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """item (hash of the text), n_words (at most five), shingles, n_item, size_class, least (hits a match must have), sketch of every distinct text."""
    texts = items.filter("text IS NOT NULL").select(F.xxhash64("text").alias("item"), "text").dropDuplicates(["item"])
    n_words = F.least(F.size("words"), F.lit(SHINGLE))
    whole = F.when(n_words == 0, F.array().cast("array<bigint>"))
    for n in range(1, SHINGLE):
        whole = whole.when(n_words == n, shingles_of("words", n))
    known = cut(texts.select("item", words_of(F.col("text")).alias("words")).select("item", n_words.alias("n_words"), whole.otherwise(shingles_of("words")).alias("shingles")))
    known = known.withColumn("shingles", F.array_sort(F.array_distinct("shingles"))).filter(F.size("shingles") > 0)
    n = F.size("shingles")
    sized = known.withColumns({"n_item": n.cast("long"), "size_class": F.floor(F.log2(n)).cast("int")})
    largest = F.least(F.pow(F.lit(2), F.col("size_class") + 1).cast("int") - 1, F.lit(1 << 30))
    missing = F.floor(F.col("n_item") - F.ceil(F.col("n_item") * threshold - 1e-9)).cast("int")
    k = F.least(F.floor(largest * (1 - threshold) + 1e-9).cast("int") + 1, n)
    return sized.withColumn("sketch", F.slice("shingles", 1, k)).withColumn("least", F.size("sketch") - missing)


def found_texts(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, t, item (hashes of the two texts), n_shared, n_item of every pair of texts at or above the threshold."""
    items = cut(sketches(items, threshold))
    # at most four lengths
    short = tuple(sorted(r["n_words"] for r in items.filter(F.col("n_words") < SHINGLE).select("n_words").distinct().collect()))
    # the fewest shingles that a document must have to hold enough of an item of the size partition
    room = F.ceil(F.pow(F.lit(2), F.col("size_class")) * threshold - 1e-9).cast("int")
    probes = few(items.select("item", "least", room.alias("room"), F.explode("sketch").alias("h")))
    keyed = docs.filter("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("t"), "text")
    probed = with_shingles(keyed, "doc_id", "t", short=short).select("doc_id", "t", F.size("shingles").alias("n"), F.explode_outer("shingles").alias("h")).filter("h IS NOT NULL")
    hits = probed.join(probes, "h").filter("n >= room").groupBy("doc_id", "t", "item").agg(F.countDistinct("h").alias("hits"), F.first("least").alias("least"))
    candidates = cut(hits.filter("hits >= least").select("doc_id", "t", "item"))
    # only candidates are shingled again
    wanted = candidates.groupBy(F.col("doc_id").alias("d"), F.col("t").alias("u")).agg(F.collect_set("item").alias("items"))
    both = keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("u")))
    again = with_shingles(both, "doc_id", "t", "items", short=short).select("doc_id", "t", "items", F.explode_outer(F.array_distinct("shingles")).alias("h")).filter("h IS NOT NULL")
    exact = again.join(few(items.select("item", "n_item", F.explode("shingles").alias("h"))), "h").filter(F.array_contains("items", F.col("item")))
    shared = exact.groupBy("doc_id", "t", "item").agg(F.countDistinct("h").alias("n_shared"), F.first("n_item").alias("n_item"))
    return shared.filter(F.col("n_shared") >= F.col("n_item") * threshold - 1e-9)


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of every pair at or above the threshold."""
    found = found_texts(docs, items, threshold)
    ids = items.filter("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", F.xxhash64("text").alias("item")).distinct()
    share = F.col("n_shared") / F.col("n_item")
    best = found.join(few(ids), "item").groupBy("doc_id", "item_id").agg(F.max(F.struct(share.alias("containment"), "n_shared", "n_item")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_shared", "best.n_item", "best.containment")
