"""Snapshots stored as the leaves of their hash trees."""

import pytest
from pyspark.sql import functions as F

from snaptrail.operators import history, identity
from snaptrail.plans import history_queries


def hashes(spark, n, salt=""):
    return spark.range(n).select(F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt)), 256).alias("row_hash"))


def shuffled(spark):
    """Bytes that this session has shuffled so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    return sc.statusStore().executorList(True).head().totalShuffleWrite()


@pytest.mark.parametrize("n_b", [9000, 300, 0])
def test_stored_leaves_are_the_tree_of_the_rows(spark, tmp_path, monkeypatch, n_b):
    monkeypatch.setattr(identity, "LEAF_ROWS", 8)
    a = hashes(spark, 9000)
    b = hashes(spark, n_b).filter(~F.col("row_hash").startswith("3")).union(hashes(spark, 3, "new") if n_b else hashes(spark, 0))
    rows = a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))
    identity.write_leaves(rows, str(tmp_path / "leaves"), ["side"], rows.select("side"))
    stored = spark.read.schema(f"{identity.LEAVES}, side string").parquet(str(tmp_path / "leaves"))
    assert stored.agg(F.sum("n")).head()[0] == rows.count() and stored.filter(F.length("row_hashes") != F.col("n") * 32).isEmpty()
    tree = identity.stored_tree(stored, ["side"])
    nodes = ["side", "depth", "prefix", "n", "h", "leaf"]
    assert sorted(map(tuple, tree.select(nodes).collect())) == sorted(map(tuple, identity.hash_tree(rows, ["side"]).select(nodes).collect()))
    trees, sides = [[x.filter(F.col("side") == s).drop("side") for s in "ab"] for x in (tree, stored)]
    got = sorted(map(tuple, identity.diff_of_leaves(*sides, identity.differing_leaves(*trees, [])).collect()))
    assert got == sorted(map(tuple, history.diff_snapshots(a, b).filter("side <> 'unchanged'").collect()))


def test_leaf_with_repeated_rows(spark):
    """As in the tree of the rows, equal row hashes are counted."""
    import hashlib

    import numpy as np

    raw = sorted(hashlib.sha256(str(i).encode()).digest() for i in (1, 1, 2, 3, 3, 3))
    want = ",".join(f"{h.hex()}:{raw.count(h)}" for h in sorted(set(raw)))
    assert identity._leaf_hash(np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 32)) == hashlib.sha256(want.encode()).hexdigest()


def test_tree_diff_shuffles_rows_few_times(spark, sf_dir):
    """Values once, hashes once as bytes, differing leaves once: some 90 bytes a row, where it took over 500."""
    rows = history_queries.st.licence_obs(spark, sf_dir).filter("snapshot_id <= 2").count()
    before = shuffled(spark)
    history_queries.tree_diff(spark, sf_dir).write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before < 250 * rows
