"""First sightings over days, runs taken up by their manifests, and names that are nearly the same."""

import datetime as dt
import json
import os
import random

from pyspark.sql import functions as F

from snaptrail.operators import history as hist
from snaptrail.operators import names
from snaptrail.streaming import streams

WATCH = "domain string, watched boolean, ts timestamp"
ROWS = "host string, kind string, jurisdiction string, ts timestamp"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def put(spark, folder, n, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/n={n:02d}")


def test_first_sightings_over_days_and_changes_of_the_list(spark, tmp_path):
    rows, changes, out, state = (str(tmp_path / n) for n in ("rows", "changes", "out", "state"))
    a, b, sub = ("a.com", "blocklist", "X"), ("www.b.com", "licensees", None), ("x.a.com", "blocklist", "X")
    steps = [
        ([(*a, day(0)), (*b, day(0)), (*a, day(0))], [("a.com", True, day(-1))], [("a.com", "a.com")]),
        ([(*a, day(3)), (*sub, day(3))], [], [("a.com", "x.a.com")]),  # a repeat after three days, and a new host below
        ([(*b, day(10))], [("b.com", True, day(9))], [("b.com", "www.b.com")]),  # added later: its next row is told
        ([(*b, day(20)), (*a, day(400))], [], []),
        ([(*a, day(402))], [("a.com", False, day(401))], []),  # taken off
        ([(*a, day(404)), (*sub, day(403))], [("a.com", True, day(404))], [("a.com", "a.com")]),  # added anew; an older row isn't told
    ]
    told = []
    for n, (seen, changed, want) in enumerate(steps):
        put(spark, rows, n, seen, ROWS)
        put(spark, changes, n, changed, WATCH)
        watch = spark.readStream.schema(WATCH).option("recursiveFileLookup", "true").parquet(changes)
        stream = spark.readStream.schema(ROWS).option("recursiveFileLookup", "true").parquet(rows)
        found = streams.stream_domain_watch(stream, watch)
        q = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
        now = sorted((r["domain"], r["host"]) for r in spark.read.schema(found.schema).parquet(out).collect())
        told = sorted(told + want)
        assert now == told, n


def test_runs_are_taken_up_when_their_manifest_is_there(spark, tmp_path):
    root, target, state = (str(tmp_path / n) for n in ("runs", "target", "state"))
    at = {k: day(k) for k in range(1, 5)}
    rows = [(k, at[k], f"h{i}", f"v{i}") for k in at for i in range(10) if (i + k) % 3]

    def store(k, complete=True, manifest=True):
        folder = f"{root}/reg/2024-01-0{k}/run{k}"
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/main.csv", "w") as f:
            f.writelines(f"{h},{v}\n" for s, _, h, v in rows if s == k)
        if manifest:
            with open(f"{folder}/manifest.json", "w") as f:
                json.dump({"run_id": f"run{k}", "slug": "reg", "complete": complete}, f)

    def parse(runs, folders):
        snapshot = F.regexp_extract("_metadata.file_path", r"/run(\d+)/", 1).cast("long")
        lines = spark.read.schema("row_hash string, value string").csv([f"{f}/main.csv" for f in folders])
        times = spark.createDataFrame(list(at.items()), "snapshot_id long, at timestamp")
        return lines.withColumn("snapshot_id", snapshot).join(times, "snapshot_id")

    def go():
        streams.stream_history_of_runs(streams.stream_runs(spark, root, most=1), target, state, parse).awaitTermination()
        log = streams.logged(spark, target)
        return sorted(r[0] for r in log.select("snapshot_id").filter("snapshot_id IS NOT NULL").collect()) if log is not None else []

    store(3)
    store(1, manifest=False)  # still goes on
    store(4, complete=False)
    assert go() == [3]
    store(1)
    store(2)
    assert go() == [1, 2, 3] and go() == [1, 2, 3]
    obs = spark.createDataFrame([r for r in rows if r[0] < 4], "snapshot_id long, at timestamp, row_hash string, value string")
    want = hist.build_history(obs.drop("at"), obs.select("snapshot_id", "at").distinct())
    got = streams.streamed_rows(spark, target)
    assert sorted(map(repr, map(tuple, got.select(*want.columns).collect()))) == sorted(map(repr, map(tuple, want.collect())))


def jaccard(x, y):
    def runs(s):
        s = "  " + names_relaxed(s) + " "
        return {s[i : i + 3] for i in range(len(s) - 2)}

    a, b = runs(x), runs(y)
    return len(a & b) / len(a | b)


def names_relaxed(s):
    import re

    return re.sub(r"[\s,]*\b(?:ltd|limited|inc|plc|llc)\b\.?\s*$", "", s.lower()).strip()


def test_similar_names_equal_brute_force(spark):
    rng = random.Random(7)
    stems = ["Royal Games", "Royal Game House", "Northern Star Betting", "Nothern Star Betting", "Lucky 7", "Lucky 77", "é漢字 Co", "", "A"]
    made = lambda: [rng.choice(stems) + rng.choice(["", " Ltd", " LIMITED", " of Malta", " (UK)", "s"]) for _ in range(60)] + [None, "  "]
    left, right = made(), made()
    a, b = (spark.createDataFrame([(n,) for n in x], "name string") for x in (left, right))
    for least in (0.5, 0.7, 1.0):
        got = {(r["a_name"], r["b_name"]): r["similarity"] for r in names.similar_names(a, b, "name", least).collect()}
        want = {(x, y): jaccard(x, y) for x in set(left) - {None} for y in set(right) - {None} if jaccard(x, y) >= least}
        assert got == want
    pairs = names.paired_names(names.similar_names(a, b, "name", 0.5)).collect()
    assert len({r["a_name"] for r in pairs}) == len({r["b_name"] for r in pairs}) == len(pairs) > 5
    where = names.reconcile_similar(a, b, "name", 0.5).groupBy("where").count().collect()
    n = {r["where"]: r["count"] for r in where}
    assert n["both"] == len(pairs) and n["both"] + n.get("a only", 0) == len(set(left) - {None}) and n["both"] + n.get("b only", 0) == len(set(right) - {None})


def test_few_names_are_compared(spark):
    """The pairs that are compared exactly are few beside all pairs, though common words are in every name."""
    made = spark.range(3000).select(F.concat(F.lit("Grand Casino "), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 12), F.lit(" Gaming")).alias("name"))
    side = names.runs_of(made, "name")
    assert names.candidates(side, side, 0.7).count() < 3000 * 3000 / 30
    assert names.similar_names(made, made, "name").count() >= 3000
