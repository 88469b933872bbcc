"""Hash trees and their differences, rules scanned over partitions of one key, and the search index."""

import random
import re

import pytest
from pyspark.sql import functions as F

from snaptrail.operators import extract, history, identity, lookup, runlog, scans


def hashes(spark, n, salt=""):
    return spark.range(n).select(F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt)), 256).alias("row_hash"), F.lit("t").alias("table"))


@pytest.fixture
def small_leaves(monkeypatch):
    monkeypatch.setattr(identity, "LEAF_ROWS", 8)


def test_tree_depth_follows_the_count(spark, small_leaves):
    small, large = identity.hash_tree(hashes(spark, 500), ["table"]), identity.hash_tree(hashes(spark, 9000), ["table"])
    assert {r["depth"] for r in small.filter("leaf").collect()} == {2} and {r["depth"] for r in large.filter("leaf").collect()} == {4}
    for tree, n in ((small, 500), (large, 9000)):
        assert {r["depth"]: r["n"] for r in tree.groupBy("depth").agg(F.sum("n").alias("n")).collect()}[0] == n
        assert tree.filter("leaf").agg(F.max("n")).head()[0] < 30
    # repeated rows count, their order does not
    again = identity.hash_tree(hashes(spark, 9000).orderBy(F.rand(1)), ["table"])
    assert again.filter("depth = 0").head()["h"] == large.filter("depth = 0").head()["h"]
    twice = identity.hash_tree(hashes(spark, 9000).union(hashes(spark, 1)), ["table"])
    assert twice.filter("depth = 0").head()["h"] != large.filter("depth = 0").head()["h"]


@pytest.mark.parametrize(("n_a", "n_b"), [(9000, 9000), (500, 9000), (0, 300), (300, 300)])
def test_difference_reads_differing_folders_only(spark, tmp_path, small_leaves, n_a, n_b):
    a = hashes(spark, n_a)
    b = hashes(spark, n_b).filter(~F.col("row_hash").startswith("3")).union(hashes(spark, 3, "new")) if n_a == n_b == 9000 else hashes(spark, n_b)
    trees = [identity.hash_tree(x, ["table"]) for x in (a, b)]
    leaves = identity.differing_leaves(*trees, ["table"])
    stored = []
    for name, rows in (("a", a), ("b", b)):
        identity.write_rows_by_hash(rows.select("row_hash"), str(tmp_path / name))
        stored.append(spark.read.schema("row_hash string, bucket string").parquet(str(tmp_path / name)))
    sides = [identity.rows_of_leaves(s, leaves) for s in stored]
    got = sorted(map(tuple, history.diff_snapshots(*sides).filter("side <> 'unchanged'").collect()))
    assert got == sorted(map(tuple, history.diff_snapshots(a, b).filter("side <> 'unchanged'").collect()))
    if n_a == n_b == 9000:
        plan = sides[0]._jdf.queryExecution().executedPlan().toString()
        named = re.search(r"PartitionFilters: \[(.*?)\]", plan)[1]
        assert 16 <= len(set(re.findall(r"\b[0-9a-f]{2}\b", named))) <= 19 and sides[0].count() < 700
    if n_a == n_b == 300:
        assert leaves.isEmpty() and sides[0].isEmpty()


def test_digest_of_a_group_is_streamed(spark):
    import hashlib

    rows = [("a", i, hashlib.sha256(str(i).encode()).hexdigest() if i % 3 else None) for i in range(50)] + [(None, 1, "ab"), ("c", 1, None)]
    df = spark.createDataFrame(rows, "source string, id int, h string").repartition(3)
    got = {r["source"]: r["combined_hash"] for r in identity.combine_hashes(df, ["source"], "id", "h").collect()}
    want = b"|".join(bytes.fromhex(h) for _, _, h in rows[:50] if h)
    assert got == {"a": hashlib.sha256(want).hexdigest(), None: hashlib.sha256(b"\xab").hexdigest(), "c": hashlib.sha256(b"").hexdigest()}


@pytest.fixture
def many_parts(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])


def hot_rows(spark, n=600, seed=4):
    """Nine in ten rows have one key."""
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.9 else rng.choice(["a", "b", None]), i, rng.randrange(0, 3000)) for i in range(n)]


def test_slots_of_a_hot_host(spark, many_parts):
    rows = hot_rows(spark)
    df = spark.createDataFrame(rows, "host string, id int, arrival_ms long")
    parts = scans.dealt(df, ["host"], ["arrival_ms", "id"]).filter("host = 'hot'").groupBy(scans.PART).count().collect()
    assert len(parts) >= 7 and max(r["count"] for r in parts) < 150
    want, before = {}, {}
    for host, i, at in sorted(rows, key=lambda r: (str(r[0]), r[2], r[1])):
        want[i] = before[host] = max(at, before[host] + 7) if host in before else at
    assert {r["id"]: r["slot_ms"] for r in runlog.request_slots(df, 7).collect()} == want


@pytest.mark.parametrize("once", [False, True])
def test_headings_of_a_hot_document(spark, many_parts, once):
    rows = [(k, i, v % 11 == 0, f"h{v}" if v % 3 else "") for k, i, v in hot_rows(spark, seed=6)]
    df = spark.createDataFrame(rows, "doc string, pos int, head boolean, value string")
    want, above, free = {}, {}, {}
    for k, i, head, value in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if head:
            above[k], free[k] = value, True
        elif not once:
            want[i] = above.get(k)
        elif free.get(k, True):
            want[i], free[k] = above.get(k) or None, False
    got = extract.carry_heading(df, "doc", "pos", F.col("head"), F.col("value"), once)
    assert {r["pos"]: r["heading"] for r in got.collect()} == want and got.columns == [*df.columns, "heading"]


def test_unchanged_runs_of_a_hot_source(spark, many_parts):
    rows = [(k, v, i, v % 5 != 0, f"c{v % 3}") for k, i, v in hot_rows(spark, seed=8)]
    df = spark.createDataFrame(rows, "source string, fetched_at long, id int, complete boolean, canonical_hash string")
    want, before = {}, {}
    for k, at, i, complete, h in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        want[i] = complete and before.get(k) == h
        before[k] = h if complete else None
    assert {r["id"]: r["unchanged"] for r in identity.unchanged(df).collect()} == want


def test_index_finds_what_a_scan_finds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lookup, "BLOCK_ROWS", 20)
    rng = random.Random(1)
    words = ["Ring", "string", "100%", "a_b", "ÉTÉ", "x", "", None, "漢字漢", "spring"]
    rows = [(i, " ".join(w or "" for w in rng.choices(words, k=3)), rng.choice([None, ["one", "Two"], []]), rng.choice(words)) for i in range(300)] + [(1, "same Ring", None, "x")] * 7
    tables = {"a": spark.createDataFrame(rows, "id int, t string, l array<string>, u string"), "b": spark.createDataFrame([(1, "RING")], "k int, v string"), "c": spark.createDataFrame([], "k int, v string")}
    root = str(tmp_path / "index")
    lookup.write_search_index(tables, root)
    for q in ("ring", "Ring", "100%", "a_b", "été", "x", "e T", "字漢", "ng s", "nowhere", "ne tw", "spring string"):
        want = sorted(map(tuple, lookup.search(tables, q, 4).collect()))
        assert sorted(map(tuple, lookup.search_index(spark, root, q, 4).collect())) == want, q
    # few lists and the rows of few blocks are read
    stored = spark.read.parquet(f"{root}/lists")
    assert stored.agg(F.max(F.size("places"))).head()[0] < 60
    assert lookup.found_rows(spark, root, "nowhere").isEmpty()


def test_rows_of_domains(spark):
    index = spark.createDataFrame([("www.a.com", "blocklist", 1), ("x.a.com", "licensees", 2), ("ba.com", "blocklist", 3), (None, "blocklist", 4)], "host string, kind string, n int")
    watch = spark.createDataFrame([("https://A.com/",), ("a.com",), (None,), ("ba.com",)], "domain string")
    assert sorted(map(tuple, lookup.domain_rows(index, watch).select("domain", "match", "n").collect())) == [("a.com", "exact", 1), ("a.com", "subdomain", 2), ("ba.com", "exact", 3)]


def test_canonical_hash_is_the_same_form_at_any_size(spark, monkeypatch):
    """Large tables are hashed by the first two digits like small ones; repeated row hashes count."""
    import hashlib

    rows = hashes(spark, 3000).select("table", "row_hash", F.lit(1).alias("r"))
    rows = rows.union(rows.limit(1))
    monkeypatch.setattr(identity, "LEAF_ROWS", 4)
    leaves, counts = {}, {}
    for r in rows.collect():
        counts[r["row_hash"]] = counts.get(r["row_hash"], 0) + 1
    for h in sorted(counts):
        leaves.setdefault(h[:2], []).append(f"{h}:{counts[h]}")
    sha = lambda parts: hashlib.sha256(",".join(parts).encode()).hexdigest()
    table = rows.head()["table"]
    want = sha([f"{table}:{sha([f'{k}:{sha(v)}' for k, v in sorted(leaves.items())])}"])
    assert identity.canonical_hash(rows, ["r"]).head()["canonical_hash"] == want
