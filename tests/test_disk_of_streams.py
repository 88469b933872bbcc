"""What streams of snapshots and histories in buckets leave on disk."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from snaptrail.operators import history as hist
from snaptrail.operators import identity
from snaptrail.plans import file_queries as fq
from snaptrail.plans import history_queries as hq
from snaptrail.sources import readers
from snaptrail.streaming import streams


def size(*folders):
    return sum(os.path.getsize(f"{d}/{f}") for folder in folders for d, _, fs in os.walk(folder) for f in fs)


def lines(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


def observed(spark, rows):
    return spark.createDataFrame(rows, "snapshot_id long, at timestamp_ntz, name string, kind int, __n long")


KEY = ("name", "kind", "__n")


def stored(spark, root, at, present):
    """A history of snapshots that came one by one; row k has no name if it is 0."""
    rows = [(i, at[i], f"name {k}" if k else None, k % 3, 0) for i in at for k in present(i)]
    for n, i in enumerate(sorted(at)):
        streams.absorb(observed(spark, [r for r in rows if r[0] == i]), n, root, None, KEY)
    return rows


def test_pieces_take_little_disk(spark, sf_dir):
    """Shuffled and kept, what the pieces take is a few times the stored history, not tens of times."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before = size(shared)
    history = fq.streamed_pieces(spark, sf_dir)
    taken = size(shared) - before
    one = f"{shared}/one_{random.random()}"
    hq.history(spark, sf_dir).drop("row_hash").write.parquet(one)
    assert taken < 10 * size(one)
    assert history.count() == hq.history(spark, sf_dir).count()


def test_late_snapshots_leave_no_checkpoints(spark, tmp_path):
    at = {i: dt.datetime(2024, 1, i) for i in (1, 3, 5)}
    root = str(tmp_path / "root")
    rows = stored(spark, root, at, lambda i: range(30) if i != 5 else range(20))
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    kept = size(folder.get().removeprefix("file:")) if folder.isDefined() else 0
    for n, (i, gone) in enumerate(((4, 7), (2, 5))):
        more = [(i, dt.datetime(2024, 1, i), f"name {k}" if k else None, k % 3, 0) for k in range(35) if k % gone]
        streams.absorb(observed(spark, more), 10 + n, root, None, KEY)
        rows, at = rows + more, at | {i: dt.datetime(2024, 1, i)}
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    assert (size(folder.get().removeprefix("file:")) if folder.isDefined() else 0) == kept
    snapshots = spark.createDataFrame(list(at.items()), "snapshot_id long, at timestamp_ntz")
    want = hist.history_of_rows(observed(spark, rows).drop("at", "__n"), snapshots)
    assert lines(streams.streamed_rows(spark, root)) == lines(want)


@pytest.mark.parametrize("seed", range(3))
def test_versions_with_voided_rows(spark, tmp_path, seed):
    """Those found with a first look at few keys are those found by splicing."""
    rng = random.Random(seed)
    at = {i: dt.datetime(2024, 1, i) for i in (1, 2, 4, 5, 6, 7)}
    root = str(tmp_path / "root")
    # row k goes in the end, at a snapshot of its own; some come and go before
    until = {k: rng.choice([1, 2, 4, 5, 6]) for k in range(40)}
    stored(spark, root, at, lambda i: [k for k in until if i <= until[k] and not (k % 8 == 1 and i == 2)] + [99])
    closed = streams.stored_rows(spark, root, streams.logged(spark, root)).filter("closed = 1")
    before, after, late = (2, at[2]), (4, at[4]), (3, dt.datetime(2024, 1, 3))
    for missing in (set(), {k for k in until if until[k] == 6}, {k for k in until if until[k] >= 4}, set(rng.sample(range(40), 3))):
        rows = observed(spark, [(3, late[1], f"name {k}" if k else None, k % 3, 0) for k in until if until[k] >= 4 and k not in missing] + [(3, late[1], "name 99", 0, 0)]).drop("snapshot_id", "at")
        near = closed.filter(hist.near_snapshot(before, after))
        changes = hist.splice_changes(near, rows, late, before, after, KEY)
        want = sorted(r[0] for r in changes.filter("change = 'void'").select("version").distinct().collect())
        assert streams.voided(near, rows, late, before, after, KEY) == want


def test_applying_in_ranges(spark):
    """As by hash: rows of several snapshots, with nulls and other columns than those of the key."""
    at = {i: dt.datetime(2024, 1, i) for i in range(1, 5)}
    rows = [(i, at[i], f"name {k}" if k % 7 else None, k % 3, k) for i in at for k in range(60) if (k * i) % 5 != 1]
    obs = observed(spark, rows).withColumn("more", F.concat(F.lit("m"), "__n"))
    marks = [F.lit(None).cast("long" if m.endswith("_id") else "timestamp_ntz").alias(m) for m in hist.MARKS]
    none = obs.filter("false").drop("snapshot_id", "at").select("*", *marks)
    out = [hist.apply_snapshots(none, obs.drop("at"), list(at.items()), None, KEY, ranges=r) for r in (None, 5)]
    assert lines(out[0]) == lines(out[1]) and out[0].count() > 60
    assert "rangepartitioning" in out[1]._jdf.queryExecution().executedPlan().toString()
    late = (5, dt.datetime(2024, 1, 5))
    spliced = [hist.spliced_versions(out[0].filter("last_seen_snapshot_id = 4"), obs.filter("snapshot_id = 2").drop("snapshot_id", "at"), late, (4, at[4]), None, KEY, ranges=r) for r in (None, 5)]
    assert lines(spliced[0].drop("change")) == lines(spliced[1].drop("change"))


def test_buckets_take_little_disk(spark, sf_dir):
    """Two stored versions take a few times the room of the history's values, as no hash is stored."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before = size(shared)
    history = fq.history_in_buckets(spark, sf_dir)
    taken = size(shared) - before
    one = f"{shared}/one_{random.random()}"
    hq.history(spark, sf_dir).drop("row_hash").coalesce(1).write.parquet(one)
    assert taken < 2.5 * size(one)
    assert history.count() == hq.history(spark, sf_dir).count()


@pytest.mark.parametrize("buckets", [4, 7])
def test_applying_to_buckets_of_values(spark, tmp_path, buckets):
    """Rows without hashes, some null, some many times, meet a table in buckets of their values; the table isn't shuffled if shuffles have as many partitions."""
    at = {i: dt.datetime(2024, 1, i) for i in range(1, 5)}
    rows = [(i, f"name {k}" if k % 7 else None, k % 3 if k % 5 else None) for i in at for k in range(60) for _ in range(200 if k == 7 else 1 + k % 2) if (k * i) % 5 != 1]
    obs = spark.createDataFrame(rows, "snapshot_id long, name string, kind int")
    snapshots = spark.createDataFrame(list(at.items()), "snapshot_id long, at timestamp_ntz")
    name, path = f"values_{os.getpid()}_{buckets}", str(tmp_path / "table")
    old = hist.history_of_rows(obs.filter("snapshot_id < 4"), snapshots.filter("snapshot_id < 4"))
    readers.write_history_table(old, name, path, buckets, ("name", "kind"))
    try:
        fourth = identity.numbered(obs.filter("snapshot_id = 4").drop("snapshot_id")).withColumn("snapshot_id", F.lit(4).cast("long"))
        new = hist.apply_snapshots(spark.table(name), fourth, [(4, at[4])], 3, KEY)
        assert lines(new) == lines(hist.history_of_rows(obs, snapshots))
        if buckets == 4:
            plan = new._jdf.queryExecution().executedPlan().toString()
            assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
            readers.write_history_table(new, f"{name}_next", f"{path}_next", buckets, ("name", "kind"))
            assert lines(spark.table(f"{name}_next")) == lines(new)
            assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) <= buckets
    finally:
        spark.sql(f"DROP TABLE {name}")
        spark.sql(f"DROP TABLE IF EXISTS {name}_next")
