"""Row identity and canonical form.

A row's digest is the SHA-256 of its values as a compact JSON array. Its identity adds the occurrence number among equal
rows, so exact duplicates stay apart and a duplicate that goes is a change. A set of rows hashes to one value that depends
on the multiset only.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snaptrail.operators import scans
from snaptrail.operators.cuts import cut


def encoded(df: DataFrame, name: str) -> Column:
    """A value as JSON text; null is ``null``."""
    kind, c = dict(df.dtypes)[name], F.col(f"`{name}`")
    if kind == "string":
        text = F.to_json(F.array(c))
        return F.substring(text, F.lit(2), F.length(text) - 2)
    if kind.startswith("array"):
        return F.coalesce(F.to_json(c), F.lit("null"))
    if kind == "timestamp":
        c = F.to_json(F.array(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")))
        return F.coalesce(F.when(F.col(f"`{name}`").isNotNull(), F.substring(c, F.lit(2), F.length(c) - 2)), F.lit("null"))
    if kind in ("date", "timestamp_ntz") or kind.startswith("decimal"):
        return F.coalesce(F.concat(F.lit('"'), c.cast("string"), F.lit('"')), F.lit("null"))
    return F.coalesce(c.cast("string"), F.lit("null"))


def row_digest(df: DataFrame, cols: list[str] | None = None) -> Column:
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *[encoded(df, c) for c in cols or df.columns]), F.lit("]")), 256)


def _identity(digest: Column, number: Column) -> Column:
    return F.sha2(F.concat(F.unhex(digest), F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0"))), 256)


#: the column that numbers equal rows
NUMBER = "__n"


def numbered(df: DataFrame) -> DataFrame:
    """df with the number of each row among equal ones (``__n``, from 0).

    Equal rows are counted first and numbered afterwards, so a row repeated 10^8 times is one row in the shuffle.
    """
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("__count"))
    return counted.select(*df.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__count") - 1)).alias(NUMBER))


def identified(df: DataFrame, values: list[str]) -> DataFrame:
    """Numbered rows with ``row_hash`` in place of the number; a projection, so rows need no hash before they are where it is needed."""
    return df.withColumn("row_hash", _identity(row_digest(df, values), F.col(NUMBER))).drop(NUMBER)


def row_identity(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """df with ``row_hash``, within each group of ``by`` columns."""
    return identified(numbered(df), [c for c in df.columns if c not in by])


#: rows that a leaf of a hash tree holds on average, at most
LEAF_ROWS = 4096
LEVEL = 2  # hexadecimal digits a level


def tree_depths(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., depth): digits of the leaves of each tree, two at least and as many as its number of rows needs."""
    digits = F.ceil((F.log2(F.count("*") / LEAF_ROWS)) / (4 * LEVEL)) * LEVEL
    return rows.groupBy(*by).agg(F.greatest(F.lit(LEVEL), digits).cast("int").alias("depth"))


def hash_tree(rows: DataFrame, by: list[str], depths: DataFrame | None = None) -> DataFrame:
    """(by..., depth, prefix, n, h, leaf): a tree of hashes over the multiset of row hashes of each ``by`` group.

    A leaf hashes its sorted row hashes with their numbers, an inner node its children's prefixes and hashes, the root
    (depth 0) stands for all. Leaves are as deep as the count demands, so none holds more than a bounded share of rows.
    ``depths`` gives the leaves' depths of other trees, to be compared with them.
    """
    # equal row hashes (when identities were not numbered) are counted, not repeated
    counted = rows.groupBy(*by, "row_hash").agg(F.count("*").alias("n"))
    deep = cut(tree_depths(counted, by) if depths is None else depths.select(*by, "depth"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"d.{c}")) for c in by]
    placed = counted.alias("r").join(deep.alias("d"), same, "left").select("r.*", F.coalesce("depth", F.lit(LEVEL)).alias("depth"))

    level = _folded(placed.withColumns({"prefix": F.expr("substring(row_hash, 1, depth)"), "times": F.col("n").cast("string")}), by, "row_hash", "times")
    return _tree_above(cut(level), by)


def _folded(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return df.groupBy(*by, "depth", "prefix").agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(pairs, lambda p: F.concat(p["o"], F.lit(":"), p["v"])), ","), 256).alias("h"))


def _tree_above(leaves: DataFrame, by: list[str]) -> DataFrame:
    """Leaves (by..., depth, prefix, n, h; kept somewhere) and the nodes above them."""
    tree = leaves.withColumn("leaf", F.lit(True))
    deepest = tree.agg(F.max("depth")).head()[0] or 0
    for depth in range(deepest - LEVEL, -1, -LEVEL):
        children = tree.filter(F.col("depth") == depth + LEVEL).withColumn("child", F.substring("prefix", depth + 1, LEVEL))
        parents = _folded(children.withColumns({"depth": F.lit(depth), "prefix": F.substring("prefix", 1, depth) if depth else F.lit("")}), by, "child", "h")
        tree = tree.unionByName(cut(parents).withColumn("leaf", F.lit(False)))
    return tree


def _bytes_of(name: str) -> Column:
    """Row hashes (lower-case hexadecimal) as bytes, half as many."""
    raw = F.unhex(name)
    return F.when(F.lower(F.hex(raw)) == F.col(name), raw).otherwise(F.raise_error(F.concat(F.lit("not a row hash: "), name)))


def canonical_hash(rows: DataFrame, by: list[str], table: str = "table") -> DataFrame:
    """(by..., table, row_hash) -> by..., canonical_hash; equal iff the multisets of row hashes are equal.

    Row hashes (lower-case hexadecimal) of a table are hashed by their first ``LEVEL`` digits, these hashes a table, and the
    tables a group: a fixed form, whatever the size. The leaves of large tables are large, so they are streamed in order.
    """
    leaf = [*by, table, "__prefix"]
    sure = _bytes_of("row_hash")
    # half as many bytes as digits are shuffled, once; equal row hashes (when identities were not numbered) are counted behind it
    dealt = rows.select(*by, table, F.substring("row_hash", 1, LEVEL).alias("__prefix"), sure.alias("__raw")).repartition(*leaf)
    counted = dealt.groupBy(*leaf, "__raw").agg(F.count("*").alias("__n"))
    pieces = counted.sortWithinPartitions(*leaf, "__raw").select(*leaf, F.concat(F.lower(F.hex("__raw")), F.lit(":"), "__n").alias("__piece"))
    schema = T.StructType([*[pieces.schema[c] for c in leaf], T.StructField("h", T.StringType())])
    level = pieces.mapInArrow(_chained(schema, b",", str.encode), schema)
    for order in ("__prefix", table):
        pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("h").alias("v"))))
        rest = [c for c in level.columns if c not in (order, "h")]
        level = level.groupBy(*rest).agg(F.sha2(F.array_join(F.transform(pairs, lambda p: F.concat(p["o"], F.lit(":"), p["v"])), ","), 256).alias("h"))
    return level.withColumnRenamed("h", "canonical_hash")


def differing_leaves(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """(by..., prefix, depth) of the deepest nodes in which two trees differ, found from the roots down.

    A level is compared only below nodes that differ, so equal parts of the tables are never looked at.
    """
    deepest = a.unionByName(b).agg(F.max("depth")).head()[0] or 0
    found = inner = None
    for depth in range(0, deepest + 1, LEVEL):
        sides = [t.filter(F.col("depth") == depth).select(*by, "prefix", F.col("h").alias(f"{x}_h"), F.col("leaf").alias(f"{x}_leaf")) for t, x in ((a, "a"), (b, "b"))]
        if inner is not None:
            parent = F.substring("prefix", 1, depth - LEVEL) if depth > LEVEL else F.lit("")
            above = inner.select(*by, F.col("prefix").alias("parent"))
            sides = [s.withColumn("parent", parent).join(above, [*by, "parent"], "left_semi").drop("parent") for s in sides]
        differ = sides[0].join(sides[1], [*by, "prefix"], "full_outer").filter(~F.col("a_h").eqNullSafe(F.col("b_h")))
        # where one side ends here, what lies deeper on the other one is part of the difference
        differ = cut(differ.select(*by, "prefix", F.lit(depth).alias("depth"), F.coalesce(F.greatest("a_leaf", "b_leaf"), F.lit(False)).alias("leaf")))
        inner, leaves = differ.filter("NOT leaf"), differ.filter("leaf").drop("leaf")
        found = leaves if found is None else found.unionByName(leaves)
    return found


def write_rows_by_hash(rows: DataFrame, path: str) -> None:
    """Rows in folders by the first digits of their hash, in order inside: a leaf is a folder and a range."""
    first = F.substring("row_hash", 1, LEVEL)
    rows.withColumn("bucket", first).repartitionByRange("bucket", "row_hash").sortWithinPartitions("bucket", "row_hash").write.partitionBy("bucket").parquet(path)


def rows_of_leaves(stored: DataFrame, leaves: DataFrame) -> DataFrame:
    """The stored rows (see ``write_rows_by_hash``) of some leaves of one tree; other folders aren't read."""
    prefixes = cut(leaves.select("prefix", F.length("prefix").alias("digits")).distinct())
    # at most 256 folders, and one length a level
    folders = sorted({r[0] for r in prefixes.select(F.substring("prefix", 1, LEVEL)).distinct().collect()})
    lengths = sorted(r[0] for r in prefixes.select("digits").distinct().collect())
    rows = stored if "" in folders else stored.filter(F.col("bucket").isin(folders))
    keys = F.array(*[F.substring("row_hash", 1, n) for n in lengths]) if lengths else F.array().cast("array<string>")
    keyed = rows.withColumn("__leaf", F.explode(keys))
    return keyed.join(prefixes.select(F.col("prefix").alias("__leaf")), "__leaf", "left_semi").drop("__leaf")


#: rows that a task sorts into leaves, at most, when shuffles have too few partitions for that
TASK_ROWS = 2_000_000
LEAVES = "depth int, prefix string, n long, h string, row_hashes binary, bucket string"


def _leaf_hash(rows: np.ndarray) -> str:
    """The hash of a leaf as ``hash_tree`` makes it, of its sorted row hashes (one row of bytes each)."""
    places = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)])
    digits, times = rows[places].tobytes().hex().encode(), np.diff(np.r_[places, len(rows)])
    width = 2 * rows.shape[1]
    if len(places) < len(rows):
        return hashlib.sha256(b",".join(b"%s:%d" % (digits[i * width : (i + 1) * width], n) for i, n in enumerate(times))).hexdigest()
    text = np.empty((len(rows), width + 3), np.uint8)
    text[:, :width], text[:, width:] = np.frombuffer(digits, np.uint8).reshape(-1, width), np.frombuffer(b":1,", np.uint8)
    return hashlib.sha256(text.tobytes()[:-1]).hexdigest()


def _into_leaves(schema: T.StructType, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(by..., depth, bytes of the row hash), in order, to leaves (schema); only the leaf that is being read is held."""
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, done = None, [], []

        def close() -> None:
            if held:
                rows = np.concatenate(held)
                done.append((*key[:-1], key[-1].hex(), len(rows), _leaf_hash(rows), rows.tobytes()))
                held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            *keys, raw = batch.columns
            kinds = [*(k.type for k in keys), pa.string(), pa.int64(), pa.string(), pa.binary()]
            rows = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(-1, width)
            new = np.zeros(len(rows), bool)
            for k in keys:
                codes = k.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            # a tree's leaves are equally deep
            for a, b in itertools.pairwise([0, *np.flatnonzero(new).tolist(), len(rows)]):
                group = [k[a].as_py() for k in keys]
                lead = rows[a:b, : group[-1] // 2]
                for c, d in itertools.pairwise([a, *(a + 1 + np.flatnonzero((lead[1:] != lead[:-1]).any(axis=1))).tolist(), b]):
                    now = (*group, lead[c - a].tobytes())
                    if now != key:
                        close()
                        key = now
                    held.append(rows[c:d])
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names)

    return run


def write_leaves(rows: DataFrame, path: str, by: list[str], counts: DataFrame) -> None:
    """Rows (by..., row_hash) stored as the leaves of their hash trees, in folders by group and first digits.

    A leaf is one row: its depth, prefix, number of rows, hash, and its sorted row hashes as bytes, one behind the other. Rows
    are shuffled once, as bytes, by ranges that no leaf crosses. ``counts`` has as many rows (by...) in each group as ``rows``.
    """
    deep = cut(tree_depths(counts, by))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"d.{c}")) for c in by]
    placed = rows.select(*by, _bytes_of("row_hash").alias("__raw")).alias("r").join(F.broadcast(deep.alias("d")), same, "left").select("r.*", F.coalesce("depth", F.lit(LEVEL)).alias("depth"))
    parts = counts.count() // TASK_ROWS + 1
    lead = F.expr("substring(__raw, 1, depth div 2)")
    dealt = placed.repartitionByRange(parts, lead) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else placed.repartitionByRange(lead)
    kinds = {f.name: f for f in placed.schema}
    schema = T.StructType([*[kinds[c] for c in [*by, "depth"]], *T.StructType.fromDDL("prefix string, n long, h string, row_hashes binary")])
    leaves = dealt.sortWithinPartitions(*by, "__raw").select(*by, "depth", "__raw").mapInArrow(_into_leaves(schema, 32), schema)
    leaves.withColumn("bucket", F.substring("prefix", 1, LEVEL)).write.partitionBy(*by, "bucket").parquet(path)


def stored_tree(leaves: DataFrame, by: list[str]) -> DataFrame:
    """The trees (as ``hash_tree`` makes them) above stored leaves, whose row hashes aren't read."""
    return _tree_above(cut(leaves.select(*by, "depth", "prefix", "n", "h")), by)


def diff_of_leaves(a: DataFrame, b: DataFrame, differing: DataFrame) -> DataFrame:
    """(row_hash, side) of rows added and removed between the stored leaves of two trees, of which only the differing ones are read.

    Leaves are shuffled as they are stored, and their rows are compared where the leaves meet.
    """
    prefixes = cut(differing.select("prefix", F.length("prefix").alias("digits")).distinct())
    # at most 256 folders, and one length a level
    folders = sorted({r[0] for r in prefixes.select(F.substring("prefix", 1, LEVEL)).distinct().collect()})
    lengths = sorted(r[0] for r in prefixes.select("digits").distinct().collect())
    sides = []
    for stored, was in ((a, True), (b, False)):
        read = stored if "" in folders else stored.filter(F.col("bucket").isin(folders))
        keys = F.array(*[F.substring("prefix", 1, n) for n in lengths]) if lengths else F.array().cast("array<string>")
        keyed = read.select(F.explode(F.array_distinct(keys)).alias("prefix"), "n", "row_hashes")
        sides.append(keyed.join(prefixes.select("prefix"), "prefix", "left_semi").withColumn("was", F.lit(was)))
    # dealt by leaves, so equal rows of both sides are together
    met = sides[0].unionByName(sides[1]).repartition("prefix")
    at = F.sequence(F.lit(0), F.col("n").cast("int") - 1)
    each = met.select("prefix", "was", F.explode(F.transform(at, lambda i: F.substring("row_hashes", i * 32 + 1, F.lit(32)))).alias("raw"))
    told = each.groupBy("prefix", "raw").agg(F.bool_or("was").alias("was"), F.bool_and("was").alias("gone")).filter("NOT was OR gone")
    return told.select(F.lower(F.hex("raw")).alias("row_hash"), F.when(F.col("gone"), "removed").otherwise("added").alias("side"))


def _chained(schema: T.StructType, separator: bytes, to_bytes: Callable[[str], bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """SHA-256 over the joined last column of rows in order, a key (the columns before it); a chain, so nothing is held in memory."""
    names, width = schema.names, len(schema.names) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, begun = None, None, False

        def record(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names)

        for batch in batches:
            kinds, done = [*batch.schema.types[:width], pa.string()], []
            for *now, value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if state is None or now != key:
                    if state is not None:
                        done.append((*key, state.hexdigest()))
                    key, state, begun = now, hashlib.sha256(), False
                if value is not None:
                    state.update((separator if begun else b"") + to_bytes(value))
                    begun = True
            if done:
                yield record(done)
        if state is not None:
            yield record([(*key, state.hexdigest())])

    return run


def combine_hashes(parts: DataFrame, by: list[str], order: str, digest: str) -> DataFrame:
    """One SHA-256 over part digests (hex) joined by ``|`` in part order; parts without a digest are left out.

    The digest is a chain, so a group's parts are streamed through it in order; none is held in memory.
    """
    schema = T.StructType([*[parts.schema[c] for c in by], T.StructField("combined_hash", T.StringType())])

    places = [F.col(c).asc_nulls_first() for c in [*by, order, digest]]
    return parts.select(*by, order, digest).repartition(*by).sortWithinPartitions(*places).select(*by, digest).mapInArrow(_chained(schema, b"|", bytes.fromhex), schema)


def unchanged(runs: DataFrame, source: str = "source", order: tuple[str, ...] = ("fetched_at", "id")) -> DataFrame:
    """runs with ``unchanged``: complete, and of the same hash as the run just before."""
    rows, keys, places = scans.dealt(runs, [source], list(order)), [source], list(order)
    shown = F.struct(F.when(F.col("complete"), F.col("canonical_hash")).alias("hash"))
    told = scans.carried(rows, keys, {"__last": scans.last_of(places, shown)}, [{"__before": lambda earlier: F.last("__last").over(earlier)}])
    inside = Window.partitionBy(source, scans.PART).orderBy(*[F.col(c).asc_nulls_first() for c in places])
    before = F.coalesce(F.lag(shown).over(inside), "__before.value")["hash"]
    return told.withColumn("unchanged", F.coalesce(F.col("complete") & (F.col("canonical_hash") == before), F.lit(False))).select(*runs.columns, "unchanged")


def dedupe(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key (by ``order``); map-side partial aggregation keeps hot keys small."""
    others = [c for c in df.columns if c not in key]
    first = df.groupBy(*key).agg(F.min_by(F.struct(*others), F.col(order)).alias("__first"))
    return first.select(*[F.col(c) if c in key else F.col(f"__first.{c}").alias(c) for c in df.columns])


def canonical_csv(df: DataFrame) -> DataFrame:
    """(line): a header and the sorted rows as CSV text, quoted only where needed; the sort is a distributed range sort."""

    def cell(name: str) -> Column:
        c = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
        return F.when(c.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)

    line = F.concat_ws(",", *[cell(c) for c in df.columns])
    header = df.sparkSession.createDataFrame([(0, ",".join(df.columns))], "part int, line string")
    body = df.orderBy(*[F.col(f"`{c}`").cast("string").asc_nulls_first() for c in df.columns]).select(F.lit(1).alias("part"), line.alias("line"))
    return header.unionByName(body).select("line")
