"""Histories of snapshots that come late, in pieces or twice; questions at many points."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from snaptrail.operators import history as hist
from snaptrail.operators.intervals import meeting, stabbed
from snaptrail.streaming import streams

def made(spark, seed, n_snapshots=6, n_rows=12):
    rng = random.Random(seed)
    at = {i: dt.datetime(2024, 1, i) for i in range(1, n_snapshots + 1)}
    rows = [(i, at[i], f"h{k:02d}", f"v{k}") for i in at for k in range(n_rows) if rng.random() < 0.6 and i != 4]
    return rows, at


def frames(spark, rows, at):
    obs = spark.createDataFrame(rows, "snapshot_id long, at timestamp_ntz, row_hash string, value string")
    snapshots = spark.createDataFrame(list(at.items()), "snapshot_id long, at timestamp_ntz")
    return obs, snapshots


def lines(history):
    return sorted(map(tuple, history.select("row_hash", "value", *hist.MARKS).collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_splicing_in_any_order_equals_rebuilding(spark, seed):
    rows, at = made(spark, seed)
    obs, snapshots = frames(spark, rows, at)
    order = random.Random(seed).sample(list(at), len(at))
    done, history = {}, obs.filter("false").select("row_hash", "value", *[F.lit(None).cast("long" if m.endswith("_id") else "timestamp_ntz").alias(m) for m in hist.MARKS])
    for i in order:
        before = max(((k, t) for k, t in done.items() if k < i), default=None)
        after = min(((k, t) for k, t in done.items() if k > i), default=None)
        spliced = hist.splice_snapshot(history, obs.filter(F.col("snapshot_id") == i).select("row_hash", "value"), (i, at[i]), before, after)
        history = spark.createDataFrame(spliced.collect(), history.schema)
        done[i] = at[i]
    assert lines(history) == lines(hist.build_history(obs.drop("at"), snapshots))


def written(spark, folder, rows, pieces):
    """Rows of each piece as a file of its own, in order."""
    obs, _ = frames(spark, rows, {})
    for n, piece in enumerate(pieces):
        path = f"{folder}/piece={n:03d}"
        spark.createDataFrame(piece, obs.schema).coalesce(1).write.parquet(path)
        for f in os.listdir(path):
            os.utime(f"{path}/{f}", (1_700_000_000 + 60 * n, 1_700_000_000 + 60 * n))
    return spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


@pytest.mark.parametrize(("seed", "with_log"), [(1, True), (2, False)])
def test_stream_of_late_and_split_snapshots(spark, tmp_path, seed, with_log):
    rows, at = made(spark, seed, n_snapshots=5, n_rows=9)
    obs, snapshots = frames(spark, rows, at)
    if not with_log:  # a snapshot without rows is only known from a log
        snapshots = snapshots.filter("snapshot_id <> 4")
    rng = random.Random(seed)
    pieces = [[r for r in rows if r[0] == i and int(r[2][1:]) % 2 == k] for i in at for k in range(2)]
    pieces = [p for p in pieces if p]
    rng.shuffle(pieces)
    pieces.append([*pieces.pop(), *pieces.pop()])  # two snapshots in one batch
    log = None if not with_log else lambda s: snapshots.join(obs.groupBy("snapshot_id").agg(F.count("*").alias("n_rows")), "snapshot_id", "left").na.fill(0)
    root = str(tmp_path / "root")
    stream = written(spark, str(tmp_path / "in"), rows, pieces)
    streams.stream_history(stream, root, str(tmp_path / "state"), log).awaitTermination()
    assert lines(streams.streamed_rows(spark, root)) == lines(hist.build_history(obs.drop("at"), snapshots))
    if with_log:
        assert streams.waiting(spark, root, log(spark)).isEmpty()


def test_a_snapshot_waits_until_it_is_whole(spark, tmp_path):
    rows, at = made(spark, 5, n_snapshots=2)
    first, second = [r for r in rows if r[0] == 1], [r for r in rows if r[0] == 2]
    root = str(tmp_path / "root")
    declared = lambda s: s.createDataFrame([(1, at[1], len(first)), (2, at[2], len(second) + 1)], "snapshot_id long, at timestamp_ntz, n_rows long")
    stream = written(spark, str(tmp_path / "in"), rows, [second, first])
    streams.stream_history(stream, root, str(tmp_path / "state"), declared).awaitTermination()
    assert {r["last_seen_snapshot_id"] for r in streams.streamed_rows(spark, root).collect()} == {1}
    left = streams.waiting(spark, root, declared(spark)).collect()
    assert [(r["snapshot_id"], r["n_rows"] - r["arrived"]) for r in left] == [(2, 1)]


def test_untouched_closed_rows_are_not_written_again(spark, tmp_path):
    """A late snapshot rewrites only the versions that hold changed closed rows."""
    at = {i: dt.datetime(2024, 1, i) for i in (1, 2, 3, 4, 6, 7)}
    # row k is in the snapshots up to k; one row, in all but the late one
    rows = [(i, at[i], f"h{k}", f"v{k}") for k in range(1, 8) for i in at if i <= k and i != 6] + [(i, at[i], "h9", "v9") for i in at if i != 6]
    root = str(tmp_path / "root")
    stream = written(spark, str(tmp_path / "in"), rows, [[r for r in rows if r[0] == i] for i in (1, 2, 3, 4, 7)])
    streams.stream_history(stream, root, str(tmp_path / "state")).awaitTermination()
    files = lambda: {f"{d}/{f}" for d, _, fs in os.walk(f"{root}/history") for f in fs if f.endswith(".parquet") and "closed=1" in d}
    old = files()
    streams.late(spark, root, (6, at[6]), frames(spark, [(6, at[6], "h7", "v7")], {})[0].select("row_hash", "value"), False)
    replaced = {r["replaces"] for r in streams.logged(spark, root).filter("replaces IS NOT NULL").collect()}
    assert old <= files() and replaced == {4}  # version 4 closed the rows last seen in snapshot 4
    both, _ = frames(spark, [*rows, (6, at[6], "h7", "v7")], at)
    assert lines(streams.streamed_rows(spark, root)) == lines(hist.build_history(both.drop("at"), frames(spark, [], at)[1]))


@pytest.mark.parametrize("seed", range(2))
def test_stabbing_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    spans = [(rng.choice([1, 1, 1, 2, None]), i, a, None if rng.random() < 0.2 else a + int(2 ** rng.uniform(0, 20))) for i in range(300) for a in [rng.randrange(-1000, 10**6)]] + [(1, 300, None, 5)]
    asked = [(rng.choice([1, 1, 2, 3, None]), i, rng.choice([None, rng.randrange(-2000, 10**6 + 10)])) for i in range(200)]
    left = spark.createDataFrame(spans, "k long, i long, a long, z long")
    right = spark.createDataFrame(asked, "k long, q long, at long")
    df = stabbed(left, right, ["k"], "at", "a", "z")
    got = sorted((r["i"], r["q"]) for r in df.collect())
    want = sorted((i, q) for k, i, a, z in spans for j, q, p in asked if k == j and k is not None and None not in (a, p) and a <= p and (z is None or z > p))
    assert got == want
    plan = df._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # without a key: all pairs by time alone
    free = stabbed(left.drop("k"), right.drop("k"), [], "at", "a", "z")
    assert sorted((r["i"], r["q"]) for r in free.collect()) == sorted((i, q) for _, i, a, z in spans for _, q, p in asked if None not in (a, p) and a <= p and (z is None or z > p))
    assert stabbed(left, right.filter("false"), ["k"], "at", "a", "z").count() == 0


def test_stabbing_meets_few_intervals_in_vain(spark):
    """Rows of the join grow with the answer: few candidates a match, whether intervals are short, long or open."""
    left = spark.range(4000).select(F.col("id").alias("i"), (F.col("id") * 250).alias("a"), F.when(F.col("id") % 2 == 0, F.col("id") * 250 + 40).when(F.col("id") % 5 == 0, F.col("id") * 250 + 9000).alias("z")).withColumn("k", F.col("i") % 50)
    right = spark.range(2000).select(F.col("id").alias("q"), (F.col("id") * 499).alias("at"), (F.col("id") % 50).alias("k"))
    df = stabbed(left, right, ["k"], "at", "a", "z")
    n = df.count()
    candidates = meeting(left, right, ["k"], "at", "a", "z").count()
    assert n > 1000 and n <= candidates < 1.5 * n + 1000


def test_applying_to_a_bucketed_history_shuffles_the_snapshot_only(spark, tmp_path):
    from snaptrail.sources import readers

    rows, at = made(spark, 9, n_snapshots=3, n_rows=200)
    obs, snapshots = frames(spark, rows, at)
    old = hist.build_history(obs.filter("snapshot_id < 3").drop("at"), snapshots.filter("snapshot_id < 3"))
    name = f"history_{os.getpid()}"
    readers.write_history_table(old, name, str(tmp_path / "table"), 8)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = hist.apply_snapshot(spark.table(name), obs.filter("snapshot_id = 3").select("row_hash", "value"), F.lit(3).cast("long"), F.lit(at[3]), newest=F.lit(2).cast("long"))
        plan = new._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(row_hash") == 1 and "SortMergeJoin" in plan
        # the one exchange stands over the snapshot's rows, which come from a local table or scan without marks
        below = plan[plan.index("Exchange hashpartitioning(row_hash") :].split("+- ", 1)[1]
        assert "first_seen_snapshot_id" not in below.split("Exchange")[0].split("Union")[0]
        assert lines(new) == lines(hist.build_history(obs.drop("at"), snapshots))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.sql(f"DROP TABLE {name}")
