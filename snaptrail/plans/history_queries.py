"""Queries over cells, row identity and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaptrail.functions import scalars
from snaptrail.operators import history as hist
from snaptrail.operators import identity, names
from snaptrail.plans import standins as st
from snaptrail.plans.scratch import scratch
from snaptrail.spec import Column, TableSpec

SPEC = TableSpec("licences", (Column("account", "bigint", True), Column("licence_number", "text", True), Column("activity", "int"), Column("status", "text", True), Column("quantity", "int"), Column("note", "text"), Column("ends_on", "date")))


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.row_identity(st.licence_obs(spark, sf_dir), by=["snapshot_id"])


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hist.build_history_of_rows(st.licence_obs(spark, sf_dir), st.snapshots(spark))


#: what tells rows apart before they have hashes
KEY = (*st.VALUES, identity.NUMBER)


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshots' rows (snapshot_id, at, values) with their numbers among equal ones."""
    return hist.numbered_rows(st.licence_obs(spark, sf_dir), st.snapshots(spark))


def with_hash(history: DataFrame) -> DataFrame:
    return identity.identified(history, st.VALUES).select("row_hash", *st.VALUES, *hist.MARKS)


def clean_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = st.table(spark, sf_dir, "conversations")
    raw = F.concat(F.lit("  "), F.col("text"), F.lit("\t\n"))
    return c.select("conv_id", "turn", scalars.clean(raw).alias("cleaned"))


def read_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    forms = [F.date_format(d, p) for p in ("yyyy-MM-dd", "d/M/yyyy", "d.M.yyyy", "dd MMMM yyyy", "d MMM yyyy", "dd-MM-yyyy")] + [F.concat(F.date_format(d, "d.M.yyyy"), F.lit(" 0:00:00")), F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T10:20:30.123Z")), F.lit("not a date")]
    written = F.element_at(F.array(*forms), (F.col("o_orderkey") % 9 + 1).cast("int"))
    return st.table(spark, sf_dir, "orders").select("o_orderkey", scalars.to_date(written).alias("read"))


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.table(spark, sf_dir, "pages").select("page_id", scalars.host(F.col("url")).alias("host"), scalars.strip_www(scalars.host(F.col("url"))).alias("bare"), scalars.is_domain(scalars.host(F.col("url"))).alias("well_formed"))


def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws("; ", "p_name", "p_brand", F.lit(" "), "p_type")
    return st.table(spark, sf_dir, "part").select("p_partkey", F.array_join(scalars.split_list(text), "|").alias("items"), F.size(scalars.split_list(text)).alias("n"))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = st.table(spark, sf_dir, "part")
    return p.select(
        "p_partkey", scalars.pad_company_id(F.col("p_partkey").cast("string")).alias("company_id"), scalars.normalise_code(F.concat(F.lit(" "), F.replace(F.col("p_type"), F.lit(" "), F.lit("_")))).alias("code"),
        scalars.licence_stem(F.concat_ws("-", "p_brand", F.col("p_size").cast("string"))).alias("stem"), scalars.contains_ci(F.col("p_name"), "RING").alias("is_ring"),
    )


def local_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.table(spark, sf_dir, "events").select("event_id", scalars.local_date_prefix(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("day"))


def coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = st.licence_obs(spark, sf_dir).filter("snapshot_id = 1").select(F.concat(F.lit(" "), F.col("account")).alias("account"), F.concat(F.lit(" "), F.col("licence_number")).alias("licence_number"), F.when(F.col("activity") > 5, "many").otherwise(F.col("activity").cast("string")).alias("activity"), "status", "quantity")
    return scalars.coerce(raw, SPEC)


def row_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = st.licence_obs(spark, sf_dir).filter("snapshot_id = 2")
    return o.withColumn("digest", identity.row_digest(o, st.VALUES)).select("licence_number", "activity", "digest")


def row_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.row_identity(st.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus"))


def canonical_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = identity.identified(numbered(spark, sf_dir), st.VALUES)
    return identity.canonical_hash(rows.withColumn("table", F.col("status")), ["snapshot_id"])


def canonical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.canonical_csv(st.table(spark, sf_dir, "nation").select("n_name", "n_regionkey"))


def combined_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = st.runs(spark, sf_dir).select("source", "id", "canonical_hash")
    return identity.combine_hashes(parts, ["source"], "id", "canonical_hash")


def unchanged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.unchanged(st.runs(spark, sf_dir)).select("source", "id", "unchanged")


def first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.dedupe(st.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hashed(spark, sf_dir)
    return hist.diff_snapshots(h.filter("snapshot_id = 1"), h.filter("snapshot_id = 2"))


def tree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows added and removed between two snapshots, read from the leaves in which their hash trees differ."""
    obs, path = st.licence_obs(spark, sf_dir).filter("snapshot_id <= 2"), scratch(spark)
    rows = identity.identified(hist.numbered_rows(obs, st.snapshots(spark).filter("snapshot_id <= 2")), st.VALUES)
    identity.write_leaves(rows, path, ["snapshot_id"], obs.select("snapshot_id"))
    stored = spark.read.schema(f"{identity.LEAVES}, snapshot_id long").parquet(path)
    tree = identity.stored_tree(stored, ["snapshot_id"]).withColumn("table", F.lit("licences"))
    differing = identity.differing_leaves(*[tree.filter(F.col("snapshot_id") == i) for i in (1, 2)], ["table"])
    return identity.diff_of_leaves(*[stored.filter(F.col("snapshot_id") == i) for i in (1, 2)], differing)


def history_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history by applying snapshots in order, two at a time; the second one comes late once more, with rows of the first, and changes nothing."""
    obs, snaps = numbered(spark, sf_dir), [(r["snapshot_id"], r["at"]) for r in st.snapshots(spark).orderBy("snapshot_id").collect()]  # one row a snapshot
    out = obs.filter("false").select(*KEY, *[F.lit(None).cast("long" if m.endswith("_id") else "timestamp_ntz").alias(m) for m in hist.MARKS])
    out = hist.apply_snapshots(out, obs, snaps[:2], None, KEY)
    out = hist.apply_snapshots(out, obs, snaps[2:], snaps[1][0], KEY)
    late = obs.filter("snapshot_id = 1").withColumn("snapshot_id", F.lit(2).cast("long"))
    return with_hash(hist.apply_snapshots(out, late, [snaps[1]], snaps[-1][0], KEY))


def current_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hist.current_view(history(spark, sf_dir))


def as_of_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hist.as_of(history(spark, sf_dir), 2).select("row_hash", *st.VALUES)


def as_of_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every order, the licence rows of its account at a time made of its date (hours around the four snapshots)."""
    day = F.datediff("o_orderdate", F.lit("1992-01-01"))
    points = st.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("account"), F.expr("timestamp_ntz'2023-12-31'").alias("from_day"), day.alias("day"))
    points = points.select("account", (F.col("from_day") + F.make_dt_interval(hours=F.col("day") % 130)).alias("asked_at"))
    # versions meet points before they have hashes
    held = hist.history_of_rows(st.licence_obs(spark, sf_dir), st.snapshots(spark)).select(*KEY, "first_seen_snapshot_id", "first_seen_at", "removed_at")
    met = identity.identified(hist.as_of_many(held, points, ["account"], "asked_at"), st.VALUES)
    return met.select("account", "asked_at", "row_hash", "licence_number", "activity", "first_seen_snapshot_id")


def splice_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history when the second snapshot comes after all others."""
    obs, snaps = st.licence_obs(spark, sf_dir), st.snapshots(spark)
    stored = hist.history_of_rows(obs.filter("snapshot_id <> 2"), snaps.filter("snapshot_id <> 2"))
    time = {r["snapshot_id"]: r["at"] for r in snaps.collect()}  # one row a snapshot
    late = identity.numbered(obs.filter("snapshot_id = 2").select(*st.VALUES))
    return with_hash(hist.splice_snapshot(stored, late, (2, time[2]), (1, time[1]), (3, time[3]), KEY))


def changes_in_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hist.changes_in(history(spark, sf_dir), 3).select("row_hash", *st.VALUES, "kind")


def changes_since_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(spark, sf_dir).withColumn("table", F.lit("licences"))
    base = st.snapshots(spark).agg(F.min("snapshot_id").alias("baseline_id")).withColumn("table", F.lit("licences"))
    return hist.changes_since(h, base, F.expr("timestamp_ntz'2024-01-02'")).select("kind", "rank", "row_hash", "changed_in", "changed_at")


def renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = hist.changes_in(history(spark, sf_dir), 2).withColumn("changed_in", F.lit(2).cast("long"))
    return hist.pair_renumbered(changes, "account", "licence_number", "activity", ["licence_number", "status", "quantity"])


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = st.table(spark, sf_dir, "customer").select(F.concat("c_name", F.lit(" Ltd")).alias("name"))
    b = st.table(spark, sf_dir, "customer").filter("c_custkey % 17 <> 0").select(F.when(F.col("c_custkey") % 13 == 0, F.concat(F.upper("c_name"), F.lit(" LIMITED"))).otherwise(F.concat("c_name", F.lit(" Ltd"))).alias("name"))
    strict = hist.reconcile_publications(a, b, "name").groupBy("where").count().select(F.lit("strict").alias("match"), "where", F.col("count").alias("n"))
    return strict.unionByName(hist.reconcile_publications(a, b, "name", relaxed=True).groupBy("where").count().select(F.lit("relaxed").alias("match"), "where", F.col("count").alias("n")))


def named(spark: SparkSession, sf_dir: str, misspelt: bool) -> DataFrame:
    """Company names made of parts; misspelt: one in four is missing, and the others lack a letter or have a suffix."""
    p = st.table(spark, sf_dir, "part")
    name = F.concat_ws(" ", F.initcap("p_name"), F.initcap("p_type"), F.replace("p_brand", F.lit("Brand#"), F.lit("No ")))
    if not misspelt:
        return p.select(name.alias("name"))
    k, at = F.col("p_partkey"), (F.col("p_partkey") % 7 + 3).cast("int")
    shorter = F.concat(F.substring(name, F.lit(1), at), F.substring(name, at + 2, F.length(name)))
    return p.filter(k % 4 != 0).select(F.when(k % 3 == 0, F.concat(F.upper(name), F.lit(" LTD."))).when(k % 3 == 1, shorter).otherwise(name).alias("name"))


def alike_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.reconcile_similar(named(spark, sf_dir, False), named(spark, sf_dir, True), "name")


def evolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hist.evolve_schema(hist.current_view(history(spark, sf_dir)), SPEC).groupBy("status").agg(F.count("*").alias("n"), F.count("note").alias("notes"), F.count("ends_on").alias("ends"))


def changes_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hist.change_counts(history(spark, sf_dir), ["status"])


def applied_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(spark, sf_dir)
    return hist.apply_stats(hist.as_of(h, 3).withColumn("removed_snapshot_id", F.lit(None).cast("long")), hashed(spark, sf_dir).filter("snapshot_id = 4"))


V = "account, licence_number, activity, status, quantity"
H = f"WITH {st.HISTORY_SQL} "
QUERIES = {
    "clean_cells": (clean_cells, "SELECT conv_id, turn, nullif(trim(replace(nfc_normalize(text), chr(160), ' '), ' ' || chr(9) || chr(10) || chr(13)), '') AS cleaned FROM conversations"),
    "read_dates": (read_dates, "SELECT o_orderkey, CASE WHEN o_orderkey % 9 < 8 THEN CAST(o_orderdate AS DATE) END AS read FROM orders"),
    "hosts": (hosts, f"SELECT page_id, h AS host, regexp_replace(h, '^www\\.', '') AS bare, regexp_full_match(h, '(?:[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?\\.)+[a-z]{{2,63}}') AS well_formed FROM (SELECT page_id, {st.HOST_SQL} AS h FROM pages)"),
    "list_items": (list_items, "SELECT p_partkey, p_name || '|' || p_brand || '|' || p_type AS items, 3 AS n FROM part"),
    "codes": (codes, "SELECT p_partkey, CASE WHEN p_partkey < 10000000 THEN lpad(CAST(p_partkey AS VARCHAR), 8, '0') ELSE CAST(p_partkey AS VARCHAR) END AS company_id, upper(replace(p_type, ' ', '-')) AS code, p_brand AS stem, contains(lower(p_name), 'ring') AS is_ring FROM part"),
    "local_dates": (local_dates, "SELECT event_id, CAST(ts AS DATE) AS day FROM events"),
    "coerced": (coerced, f"WITH {st.OBS_SQL} SELECT account, licence_number, CASE WHEN activity <= 5 THEN activity END AS activity, status, quantity, CAST(NULL AS VARCHAR) AS note, CAST(NULL AS DATE) AS ends_on FROM obs WHERE snapshot_id = 1"),
    "row_digests": (row_digests, f"WITH {st.OBS_SQL} SELECT licence_number, activity, {st.DIGEST_SQL} AS digest FROM obs WHERE snapshot_id = 2"),
    "row_identities": (row_identities, """SELECT l_orderkey, l_returnflag, l_linestatus, sha256(unhex(sha256('[' || l_orderkey || ',"' || l_returnflag || '","' || l_linestatus || '"]') || lpad(to_hex(row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus) - 1), 8, '0'))) AS row_hash FROM lineitem"""),
    "canonical_hashes": (canonical_hashes, f"""WITH {st.HASHED_SQL}, b AS (SELECT snapshot_id, status, substring(row_hash, 1, 2) AS bucket, sha256(string_agg(row_hash || ':1', ',' ORDER BY row_hash)) AS h FROM hashed GROUP BY ALL),
      t AS (SELECT snapshot_id, status, sha256(string_agg(bucket || ':' || h, ',' ORDER BY bucket)) AS h FROM b GROUP BY ALL) SELECT snapshot_id, sha256(string_agg(status || ':' || h, ',' ORDER BY status)) AS canonical_hash FROM t GROUP BY snapshot_id"""),
    "canonical_lines": (canonical_lines, "SELECT 'n_name,n_regionkey' AS line UNION ALL SELECT n_name || ',' || n_regionkey FROM nation"),
    "combined_hashes": (combined_hashes, f"WITH {st.RUNS_SQL} SELECT source, sha256(unhex(string_agg(canonical_hash, '7C' ORDER BY id))) AS combined_hash FROM runs GROUP BY source"),
    "unchanged_runs": (unchanged_runs, f"WITH {st.RUNS_SQL} SELECT source, id, coalesce(complete AND canonical_hash = lag(CASE WHEN complete THEN canonical_hash END) OVER (PARTITION BY source ORDER BY fetched_at, id), false) AS unchanged FROM runs"),
    "first_of_each": (first_of_each, "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL"),
    "snapshot_diff": (snapshot_diff, f"WITH {st.HASHED_SQL} SELECT row_hash, CASE WHEN max(snapshot_id) = 1 THEN 'removed' WHEN min(snapshot_id) = 2 THEN 'added' ELSE 'unchanged' END AS side FROM hashed WHERE snapshot_id <= 2 GROUP BY row_hash"),
    "tree_diff": (tree_diff, f"WITH {st.HASHED_SQL} SELECT row_hash, CASE WHEN max(snapshot_id) = 1 THEN 'removed' ELSE 'added' END AS side FROM hashed WHERE snapshot_id <= 2 GROUP BY row_hash HAVING count(*) = 1"),
    "history_built": (history, H + "SELECT * FROM history"),
    "history_applied": (history_applied, H + "SELECT * FROM history"),
    "current_rows": (current_rows, H + f"SELECT {V}, first_seen_snapshot_id, last_seen_snapshot_id, first_seen_at, last_seen_at FROM history WHERE removed_snapshot_id IS NULL"),
    "as_of_snapshot": (as_of_snapshot, f"WITH {st.HASHED_SQL} SELECT row_hash, {V} FROM hashed WHERE snapshot_id = 2"),
    "as_of_points": (as_of_points, H + """, p AS (SELECT o_orderkey AS account, TIMESTAMP '2023-12-31' + to_hours(CAST(datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) % 130 AS INT)) AS asked_at FROM orders)
      SELECT account, asked_at, row_hash, licence_number, activity, first_seen_snapshot_id FROM p JOIN history USING (account) WHERE first_seen_at <= asked_at AND (removed_at IS NULL OR removed_at > asked_at)"""),
    "splice_late": (splice_late, H + "SELECT * FROM history"),
    "changes_in_snapshot": (changes_in_snapshot, H + f"SELECT row_hash, {V}, CASE WHEN first_seen_snapshot_id = 3 THEN 'added' ELSE 'removed' END AS kind FROM history WHERE first_seen_snapshot_id = 3 OR removed_snapshot_id = 3"),
    "changes_since_day": (changes_since_day, H + """, c AS (SELECT 'added' AS kind, row_hash, first_seen_snapshot_id AS changed_in, first_seen_at AS changed_at FROM history WHERE first_seen_at >= '2024-01-02' AND first_seen_snapshot_id <> 1
      UNION ALL SELECT 'removed', row_hash, removed_snapshot_id, removed_at FROM history WHERE removed_at >= '2024-01-02'),
      r AS (SELECT kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY changed_at DESC, row_hash) AS INT) AS rank, row_hash, changed_in, changed_at FROM c) SELECT * FROM r WHERE rank <= 200"""),
    "renumbered": (renumbered, H + """, c AS (SELECT *, CASE WHEN first_seen_snapshot_id = 2 THEN 'added' ELSE 'removed' END AS kind, regexp_replace(licence_number, '-[^-]*$', '') AS stem FROM history WHERE first_seen_snapshot_id = 2 OR removed_snapshot_id = 2),
      n AS (SELECT *, row_number() OVER (PARTITION BY kind, account, stem, activity ORDER BY licence_number, row_hash) AS n FROM c),
      p AS (SELECT o.row_hash AS oh, w.row_hash AS wh, o.licence_number AS ol, w.licence_number AS wl, o.status AS os, w.status AS ws, o.quantity AS oq, w.quantity AS wq
        FROM (SELECT * FROM n WHERE kind = 'removed') o FULL JOIN (SELECT * FROM n WHERE kind = 'added') w ON o.account = w.account AND o.stem = w.stem AND o.activity = w.activity AND o.n = w.n)
      SELECT CAST(2 AS BIGINT) AS changed_in, CASE WHEN oh IS NULL THEN 'added' WHEN wh IS NULL THEN 'removed' ELSE 'renumbered' END AS kind, coalesce(wh, oh) AS row_hash, CASE WHEN wh IS NOT NULL THEN oh END AS other_hash,
        CASE WHEN oh IS NOT NULL AND wh IS NOT NULL THEN concat_ws(',', CASE WHEN ol IS DISTINCT FROM wl THEN 'licence_number' END, CASE WHEN os IS DISTINCT FROM ws THEN 'status' END, CASE WHEN oq IS DISTINCT FROM wq THEN 'quantity' END) END AS changed FROM p"""),
    "publications": (publications, """WITH a AS (SELECT c_name || ' Ltd' AS s, lower(c_name) AS r FROM customer), b AS (SELECT CASE WHEN c_custkey % 13 = 0 THEN upper(c_name) || ' LIMITED' ELSE c_name || ' Ltd' END AS s, lower(c_name) AS r FROM customer WHERE c_custkey % 17 <> 0),
      j AS (SELECT 'strict' AS match, a.s AS x, b.s AS y FROM a FULL JOIN b ON a.s = b.s UNION ALL SELECT 'relaxed', a.r, b.r FROM a FULL JOIN b ON a.r = b.r)
      SELECT match, CASE WHEN y IS NULL THEN 'a only' WHEN x IS NULL THEN 'b only' ELSE 'both' END AS "where", count(*) AS n FROM j GROUP BY ALL"""),
    "alike_publications": (alike_publications, r"""WITH p AS (SELECT p_partkey AS k, array_to_string(list_transform(string_split(lower(p_name || ' ' || p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' ' || replace(p_brand, 'Brand#', 'No ') AS name FROM part),
      b0 AS (SELECT CASE k % 3 WHEN 0 THEN upper(name) || ' LTD.' WHEN 1 THEN substr(name, 1, k % 7 + 3) || substr(name, k % 7 + 5) ELSE name END AS name FROM p WHERE k % 4 <> 0),
      n AS (SELECT DISTINCT 'a' AS side, name FROM p UNION ALL SELECT DISTINCT 'b', name FROM b0),
      t AS (SELECT side, name, '  ' || trim(regexp_replace(lower(name), '[\s,]*\b(?:ltd|limited|inc|plc|llc)\b\.?\s*$', '')) || ' ' AS s FROM n),
      g AS (SELECT DISTINCT side, name, unnest(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) AS gram FROM t), size AS (SELECT side, name, count(*) AS n FROM g GROUP BY ALL),
      j AS (SELECT x.name AS a_name, y.name AS b_name, count(*) AS n FROM g x JOIN g y USING (gram) WHERE x.side = 'a' AND y.side = 'b' GROUP BY ALL),
      s AS (SELECT a_name, b_name, j.n / (p.n + q.n - j.n) AS similarity FROM j JOIN size p ON p.side = 'a' AND p.name = a_name JOIN size q ON q.side = 'b' AND q.name = b_name WHERE j.n / (p.n + q.n - j.n) >= 0.7),
      m AS (SELECT *, row_number() OVER (PARTITION BY a_name ORDER BY similarity DESC, b_name) AS r, row_number() OVER (PARTITION BY b_name ORDER BY similarity DESC, a_name) AS q FROM s),
      pr AS (SELECT a_name, b_name, similarity FROM m WHERE r = 1 AND q = 1)
      SELECT *, 'both' AS "where" FROM pr UNION ALL SELECT name, NULL, NULL, 'a only' FROM n WHERE side = 'a' AND name NOT IN (SELECT a_name FROM pr) UNION ALL SELECT NULL, name, NULL, 'b only' FROM n WHERE side = 'b' AND name NOT IN (SELECT b_name FROM pr)"""),
    "evolved": (evolved, H + "SELECT status, count(*) AS n, CAST(0 AS BIGINT) AS notes, CAST(0 AS BIGINT) AS ends FROM history WHERE removed_snapshot_id IS NULL GROUP BY status"),
    "changes_counted": (changes_counted, H + "SELECT status, snapshot_id, kind, count(*) AS n FROM (SELECT status, first_seen_snapshot_id AS snapshot_id, 'added' AS kind FROM history UNION ALL SELECT status, removed_snapshot_id, 'removed' FROM history WHERE removed_snapshot_id IS NOT NULL) GROUP BY ALL"),
    "applied_stats": (applied_stats, f"WITH {st.HASHED_SQL}, s AS (SELECT row_hash, min(snapshot_id) AS a, max(snapshot_id) AS b FROM hashed WHERE snapshot_id >= 3 GROUP BY row_hash) SELECT count(*) FILTER (a = 4) AS inserted, count(*) FILTER (b = 3) AS removed, count(*) FILTER (a = 3 AND b = 4) AS unchanged FROM s"),
}
