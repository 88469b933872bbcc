"""Names that are nearly the same, found without comparing all with all.

A name is the set of its runs of three characters, relaxed as for publications. Two sets of a similarity (Jaccard) of at
least ``least`` share a run among the few rarest of each (prefix filter) and are nearly of one size (length filter); what
meets so is compared exactly. Rarity is counted in a table of fixed size, which is sent to all executors: any order of runs
gives the same result, a good one gives few candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snaptrail.operators.cuts import cut
from snaptrail.operators.history import relaxed_name
from snaptrail.operators.lookup import grams

BUCKETS = 1 << 16
_SLACK = 1e-9


def runs_of(names: DataFrame, key: str) -> DataFrame:
    """(name, runs): distinct names that are not null, with their distinct runs."""
    padded = F.concat(F.lit("  "), relaxed_name(F.col("name")), F.lit(" "))
    return names.select(F.col(key).alias("name")).filter("name IS NOT NULL").distinct().withColumn("runs", grams(padded))


def bucket(run: Column) -> Column:
    return F.pmod(F.xxhash64(run), F.lit(BUCKETS)).cast("int")


def rarest(names: DataFrame, counts: DataFrame, least: float) -> DataFrame:
    """(name, size, run): the runs of each name of which a similar name must have one."""
    each = names.select("name", F.size("runs").alias("size"), F.explode("runs").alias("run")).withColumn("bucket", bucket(F.col("run")))
    # at most BUCKETS rows
    ranked = each.join(F.broadcast(counts), "bucket", "left").groupBy("name", "size").agg(F.array_sort(F.collect_list(F.struct("count", "run"))).alias("ranked"))
    some = F.col("size") - F.ceil(F.col("size") * least - _SLACK) + 1
    return ranked.select("name", "size", F.explode(F.slice("ranked", F.lit(1), some.cast("int"))).alias("r")).select("name", "size", F.col("r.run").alias("run"))


def candidates(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(a_name, b_name) that may be similar, each once; a, b as from ``runs_of``."""
    counts = a.select(F.explode("runs").alias("run")).unionByName(b.select(F.explode("runs").alias("run"))).groupBy(bucket(F.col("run")).alias("bucket")).count()
    sides = [rarest(x, counts, least).select("run", *[F.col(c).alias(f"{p}_{c}") for c in ("name", "size")]) for x, p in ((a, "a"), (b, "b"))]
    near = (F.col("a_size") >= F.col("b_size") * least - _SLACK) & (F.col("b_size") >= F.col("a_size") * least - _SLACK)
    return sides[0].join(sides[1], "run").filter(near).select("a_name", "b_name").distinct()


def similar_names(a: DataFrame, b: DataFrame, key: str, least: float = 0.7) -> DataFrame:
    """(a_name, b_name, similarity) of all pairs of distinct names that are similar enough."""
    left, right = cut(runs_of(a, key)), cut(runs_of(b, key))
    pairs = candidates(left, right, least)
    pairs = pairs.join(left.select(F.col("name").alias("a_name"), F.col("runs").alias("a_runs")), "a_name")
    pairs = pairs.join(right.select(F.col("name").alias("b_name"), F.col("runs").alias("b_runs")), "b_name")
    same = F.size(F.array_intersect("a_runs", "b_runs"))
    return pairs.select("a_name", "b_name", (same / (F.size("a_runs") + F.size("b_runs") - same)).alias("similarity")).filter(F.col("similarity") >= least)


def paired_names(similar: DataFrame) -> DataFrame:
    """The pairs that are each other's best: most similar, then first by name. No name is in two pairs."""
    ranks = {}
    for side, other in (("a_name", "b_name"), ("b_name", "a_name")):
        ranks[side] = F.row_number().over(Window.partitionBy(side).orderBy(F.desc("similarity"), other))
    return similar.withColumns({"__a": ranks["a_name"], "__b": ranks["b_name"]}).filter("__a = 1 AND __b = 1").drop("__a", "__b")


def reconcile_similar(a: DataFrame, b: DataFrame, key: str, least: float = 0.7) -> DataFrame:
    """(a_name, b_name, similarity, where): names of both publications in pairs, and those of either that have no counterpart."""
    pairs = cut(paired_names(similar_names(a, b, key, least)))
    alone = []
    for names, side, where in ((a, "a_name", "a only"), (b, "b_name", "b only")):
        rest = names.select(F.col(key).alias(side)).filter(F.col(side).isNotNull()).distinct().join(pairs, side, "left_anti")
        alone.append(rest.select(*[F.col(c) if c == side else F.lit(None).cast("string").alias(c) for c in ("a_name", "b_name")], F.lit(None).cast("double").alias("similarity"), F.lit(where).alias("where")))
    return pairs.withColumn("where", F.lit("both")).unionByName(alone[0]).unionByName(alone[1])
