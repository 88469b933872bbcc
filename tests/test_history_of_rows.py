"""Histories made of rows without identities: one shuffle, no hashes in it."""

import datetime as dt

from pyspark.sql import functions as F

from snaptrail.operators import history as hist
from snaptrail.operators import identity
from snaptrail.plans import history_queries as hq


def lines(df):
    return sorted(repr(r) for r in df.select(sorted(df.columns)).collect())


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning")


def observed(spark, n):
    """Rows that come, go and come back in n snapshots, some of them twice, some null."""
    obs = spark.range(40).withColumn("snapshot_id", F.explode(F.sequence(F.lit(1), F.lit(n)))).filter("(id * 7 + snapshot_id * snapshot_id) % 5 <> 0")
    copies = F.when((F.col("id") + F.col("snapshot_id")) % 4 == 0, 3).otherwise(1)
    obs = obs.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    rows = obs.select(F.col("snapshot_id").cast("long"), F.when(F.col("id") % 9 != 0, F.concat(F.lit("é\""), "id")).alias("name"), (F.col("id") % 3).alias("kind"))
    days = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(days=i)) for i in range(1, n + 2)]
    return rows, spark.createDataFrame(days, "snapshot_id long, at timestamp_ntz")


def test_history_of_rows(spark):
    for n in (3, 37):
        rows, snapshots = observed(spark, n)
        built = hist.build_history_of_rows(rows, snapshots)
        assert lines(built) == lines(hist.build_history(identity.row_identity(rows, by=["snapshot_id"]), snapshots))
        assert built.filter("name IS NULL").count() > 0
        assert hist.build_history_of_rows(rows, snapshots.filter("snapshot_id < 0")).count() == 0


def test_history_takes_one_shuffle(spark, sf_dir):
    assert shuffles(hq.history(spark, sf_dir)) == 1


def test_several_snapshots_at_once(spark):
    """As one by one, on rows with and without hashes, refusing what isn't newer, in more than one round."""
    rows, snapshots = observed(spark, 7)
    told = [(r["snapshot_id"], r["at"]) for r in snapshots.orderBy("snapshot_id").collect()]
    hashed = identity.row_identity(rows, by=["snapshot_id"])
    numbered, key = hist.numbered_rows(rows, snapshots).drop("at"), ("name", "kind", identity.NUMBER)
    marks = [F.lit(None).cast("long" if m.endswith("_id") else "timestamp_ntz").alias(m) for m in hist.MARKS]
    want = lines(hist.build_history(hashed, snapshots))
    for obs, by in ((hashed, hist.KEY), (numbered, key)):
        out = obs.filter("false").drop("snapshot_id").select("*", *marks)
        for some, newest in ((told[:3], None), (told[3:], 3), (told[1:4], 8)):
            out = hist.apply_snapshots(out, obs, some, newest, by)
        assert lines(out if by == hist.KEY else identity.identified(out, ["name", "kind"])) == want


def test_applying_takes_a_shuffle_for_two_snapshots(spark, sf_dir):
    assert shuffles(hq.history_applied(spark, sf_dir)) <= 4


def test_splicing_rows_without_hashes(spark):
    rows, snapshots = observed(spark, 5)
    told = {r["snapshot_id"]: r["at"] for r in snapshots.collect()}
    key = ("name", "kind", identity.NUMBER)
    stored = hist.history_of_rows(rows.filter("snapshot_id <> 3"), snapshots.filter("snapshot_id <> 3"))
    late = identity.numbered(rows.filter("snapshot_id = 3").drop("snapshot_id"))
    out = hist.splice_snapshot(stored, late, (3, told[3]), (2, told[2]), (4, told[4]), key)
    assert lines(out) == lines(hist.history_of_rows(rows, snapshots))


def test_intervals_take_few_buckets(spark):
    """A version is repeated a few times at most before it meets points, however long it is."""
    from snaptrail.operators.intervals import leveled, touched

    spans = spark.range(5000).select((F.col("id") * 977).alias("__lo")).withColumn("__hi", F.col("__lo") + F.pow(F.lit(1.004), F.col("__lo") / 977).cast("long"))
    assert leveled(spans).agg(F.max(F.size(touched()))).head()[0] <= 4
