"""Registers, run logs and domain lists derived from the given tables, as DataFrames and as the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaptrail.functions.scalars import host

NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Narrow rows of which pages are made, over as many tasks as shuffles have.

    One small file (one row group) holds very many, which one task would have to read as pages. The number is named, as few
    bytes a row would else be put together to few tasks again.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run log: one run an event."""
    e = table(spark, sf_dir, "events")
    complete = F.col("event_type").isin("purchase", "view", "click")
    reason = F.when(F.col("event_type") == "signup", "AWAITING_PARSE").when(F.col("event_type") == "error", "PAGE_GAP:0/1 main:HTTP_503")
    return e.select(
        F.col("user_id").alias("source"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp_ntz").alias("fetched_at"), complete.alias("complete"), reason.alias("reason"),
        F.when(complete, F.floor("value").cast("int")).alias("record_count"), F.sha2(F.floor(F.col("value") / 40).cast("string"), 256).alias("canonical_hash"), (F.col("event_id") % 4 + 1).cast("int").alias("pages_expected"),
        F.when(complete | (F.col("event_type") == "signup"), (F.col("event_id") % 4 + 1).cast("int")).otherwise(0).alias("pages_ok"), "event_type",
    )


RUNS_SQL = """runs AS (SELECT user_id AS source, event_id AS id, ts AS fetched_at, event_type IN ('purchase', 'view', 'click') AS complete,
  CASE event_type WHEN 'signup' THEN 'AWAITING_PARSE' WHEN 'error' THEN 'PAGE_GAP:0/1 main:HTTP_503' END AS reason,
  CASE WHEN event_type IN ('purchase', 'view', 'click') THEN CAST(floor(value) AS INT) END AS record_count, sha256(CAST(CAST(floor(value / 40) AS BIGINT) AS VARCHAR)) AS canonical_hash,
  CAST(event_id % 4 + 1 AS INT) AS pages_expected, CASE WHEN event_type <> 'error' THEN CAST(event_id % 4 + 1 AS INT) ELSE 0 END AS pages_ok, event_type FROM events)"""


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch log entries: source, run id, url, status, attempts, waits, bytes, validators."""
    e = table(spark, sf_dir, "events")
    status = F.expr("CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 304 WHEN 'click' THEN 429 ELSE 200 END")
    return e.select(
        F.col("user_id").alias("source"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp_ntz").alias("fetched_at"),
        F.concat(F.lit("https://h"), F.col("user_id") % 21, F.lit(".example.com/p"), F.col("event_id") % 5).alias("url"), status.alias("status_code"), (F.col("event_id") % 3 + 1).cast("int").alias("attempt_no"),
        (F.col("event_id") % 700).alias("bucket_wait_ms"), (F.col("event_id") * 37 % 100000).alias("bytes"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("e"), F.col("event_id"))).alias("etag"),
        F.when(F.col("event_id") % 3 == 0, F.col("ts").cast("string")).alias("last_modified"), F.when(F.col("event_id") % 50 == 0, "disallowed").otherwise("allowed").alias("robots_decision"),
    )


FETCHES_SQL = """fetches AS (SELECT user_id AS source, event_id AS id, ts AS fetched_at, 'https://h' || user_id % 21 || '.example.com/p' || event_id % 5 AS url,
  CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 304 WHEN 'click' THEN 429 ELSE 200 END AS status_code, CAST(event_id % 3 + 1 AS INT) AS attempt_no, event_id % 700 AS bucket_wait_ms, event_id * 37 % 100000 AS bytes,
  CASE WHEN event_id % 2 = 0 THEN 'e' || event_id END AS etag, CASE WHEN event_id % 3 = 0 THEN CAST(ts AS VARCHAR) END AS last_modified, CASE WHEN event_id % 50 = 0 THEN 'disallowed' ELSE 'allowed' END AS robots_decision FROM events)"""


def licence_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four snapshots of a licence register: snapshot_id, account, licence_number, activity, status, quantity."""
    number = F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 6, "0"), "l_returnflag", F.lpad(F.col("l_partkey").cast("string"), 6, "0"), F.when((F.col("k") >= 2) & (F.col("l_orderkey") % 9 == 0), "011").otherwise("010"))
    rows = table(spark, sf_dir, "lineitem").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(4))))
    return rows.filter((F.col("l_orderkey") + F.col("k")) % 7 != 0).select(
        F.col("k").cast("long").alias("snapshot_id"), F.col("l_orderkey").alias("account"), number.alias("licence_number"), F.col("l_linenumber").alias("activity"),
        F.when((F.col("k") >= 3) & (F.col("l_orderkey") % 11 == 0), "Revoked").otherwise(F.col("l_linestatus")).alias("status"), F.col("l_quantity").cast("int").alias("quantity"),
    )


OBS_SQL = """obs AS (SELECT k AS snapshot_id, l_orderkey AS account,
  lpad(CAST(l_orderkey AS VARCHAR), 6, '0') || '-' || l_returnflag || '-' || lpad(CAST(l_partkey AS VARCHAR), 6, '0') || '-' || CASE WHEN k >= 2 AND l_orderkey % 9 = 0 THEN '011' ELSE '010' END AS licence_number,
  l_linenumber AS activity, CASE WHEN k >= 3 AND l_orderkey % 11 = 0 THEN 'Revoked' ELSE l_linestatus END AS status, CAST(l_quantity AS INT) AS quantity
  FROM lineitem, (SELECT unnest([1, 2, 3, 4])::BIGINT AS k) WHERE (l_orderkey + k) % 7 <> 0)"""
VALUES = ["account", "licence_number", "activity", "status", "quantity"]
#: the digest of a licence row, and its identity with the occurrence number n among equal rows
DIGEST_SQL = """sha256('[' || account || ',' || CAST(to_json(licence_number) AS VARCHAR) || ',' || activity || ',' || CAST(to_json(status) AS VARCHAR) || ',' || quantity || ']')"""
HASHED_SQL = f"""{OBS_SQL},
hashed AS (SELECT snapshot_id, account, licence_number, activity, status, quantity, sha256(unhex(d || lpad(to_hex(n), 8, '0'))) AS row_hash
  FROM (SELECT *, {DIGEST_SQL} AS d, row_number() OVER (PARTITION BY ALL_COLUMNS) - 1 AS n FROM obs))""".replace("ALL_COLUMNS", "snapshot_id, account, licence_number, activity, status, quantity")
SNAPS_SQL = "snaps AS (SELECT unnest([1, 2, 3, 4])::BIGINT AS snapshot_id, unnest([TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-04']) AS at)"
HISTORY_SQL = f"""{HASHED_SQL}, {SNAPS_SQL},
island AS (SELECT *, snapshot_id - row_number() OVER (PARTITION BY row_hash ORDER BY snapshot_id) AS g FROM hashed),
span AS (SELECT row_hash, g, any_value(account) AS account, any_value(licence_number) AS licence_number, any_value(activity) AS activity, any_value(status) AS status, any_value(quantity) AS quantity, min(snapshot_id) AS lo, max(snapshot_id) AS hi FROM island GROUP BY row_hash, g),
history AS (SELECT row_hash, account, licence_number, activity, status, quantity, lo AS first_seen_snapshot_id, hi AS last_seen_snapshot_id, r.snapshot_id AS removed_snapshot_id, f.at AS first_seen_at, l.at AS last_seen_at, r.at AS removed_at
  FROM span JOIN snaps f ON f.snapshot_id = lo JOIN snaps l ON l.snapshot_id = hi LEFT JOIN snaps r ON r.snapshot_id = hi + 1)"""


def snapshots(spark: SparkSession) -> DataFrame:
    return spark.range(1, 5).select(F.col("id").alias("snapshot_id"), F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, cast(id - 1 as int))").alias("at"))


def domain_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host, kind, jurisdiction, register of licensed and blocked domains."""
    p = table(spark, sf_dir, "pages").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("page_id") % 25 == F.col("n_nationkey"))
    kinds = F.array_compact(F.array(F.when(F.col("page_id") % 2 == 0, "licensees"), F.when(F.col("page_id") % 3 == 0, "blocklist")))
    return p.select(host(F.col("url")).alias("host"), F.explode(kinds).alias("kind"), F.col("n_name").alias("jurisdiction"), "page_id").filter("host IS NOT NULL").withColumn("register", F.concat_ws("_", F.lower("jurisdiction"), "kind"))


HOST_SQL = r"regexp_replace(regexp_extract(regexp_replace(regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*://)?([^/?#]*)', 1), '^.*@', ''), '^([^:]*)', 1), '\.+$', '')"
DOMAINS_SQL = f"""domains AS (SELECT {HOST_SQL} AS host, kind, n_name AS jurisdiction, page_id, lower(n_name) || '_' || kind AS register
  FROM pages JOIN nation ON page_id % 25 = n_nationkey, (SELECT unnest(['licensees', 'blocklist']) AS kind) WHERE (kind = 'licensees' AND page_id % 2 = 0 OR kind = 'blocklist' AND page_id % 3 = 0) AND contains({HOST_SQL}, '.'))"""


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains to look for: the last three labels of every host, and three parents."""
    labels = F.split("host", r"\.")
    last3 = domain_index(spark, sf_dir).select(F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".").alias("domain")).distinct()
    return last3.unionByName(spark.createDataFrame([("example.com",), ("example.net",), ("example.org",)], "domain string")).distinct()


WATCH_SQL = "watch AS (SELECT DISTINCT array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - 2, 1), len(string_split(host, '.'))), '.') AS domain FROM domains UNION SELECT unnest(['example.com', 'example.net', 'example.org']))"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, slug, jurisdiction, enabled: the users of the event log, and one without any run."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("source")).distinct().unionByName(spark.createDataFrame([(-1,)], "source long"))
    return e.select("source", F.concat(F.lit("s"), F.col("source")).alias("slug"), F.concat(F.lit("NATION_"), F.pmod("source", F.lit(25))).alias("jurisdiction"), (F.pmod("source", F.lit(13)) != 5).alias("enabled"))


SOURCES_SQL = "sources AS (SELECT source, 's' || source AS slug, 'NATION_' || ((source % 25) + 25) % 25 AS jurisdiction, ((source % 13) + 13) % 13 <> 5 AS enabled FROM (SELECT DISTINCT user_id AS source FROM events UNION SELECT -1))"
