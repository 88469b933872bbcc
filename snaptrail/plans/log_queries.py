"""Queries over checks, run logs and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snaptrail import spec as sp
from snaptrail.functions import scalars
from snaptrail.operators import lookup, runlog, validate
from snaptrail.plans import standins as st
from snaptrail.plans.scratch import scratch

TNOW = f"TIMESTAMP '{st.NOW}'"
GOOD = "(complete OR reason IS NOT DISTINCT FROM 'AWAITING_PARSE')"
CHECKED = sp.TableSpec("licences", (sp.Column("account", "bigint", True), sp.Column("status", "text", True)), min_rows=10, known_values={"status": frozenset({"O", "Revoked"})})


def now() -> Column:
    return F.lit(st.NOW).cast("timestamp_ntz")


def parts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    content = F.expr("CASE event_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN '<!DOCTYPE html><p>down' WHEN 2 THEN 'a,b\n1,2' WHEN 3 THEN '<table>' ELSE '{}' END")
    return st.table(spark, sf_dir, "events").select(
        e, F.when(e % 3 == 0, "html").otherwise("csv").alias("kind"), F.encode(content, "UTF-8").alias("content"), F.expr("CASE event_id % 4 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'application/json' WHEN 2 THEN 'text/csv' END").alias("content_type"),
    )


def part_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.check_parts(parts_of(spark, sf_dir)).select("event_id", "problem", "transient")


def blanked(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = st.licence_obs(spark, sf_dir)
    return o.withColumn("status", F.when((F.col("snapshot_id") == 2) & (F.col("account") % 10 == 0), "").otherwise(F.col("status")))


def table_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blanked(spark, sf_dir)
    counts = rows.groupBy("snapshot_id").count()
    runs = spark.range(1, 6).select(F.col("id").alias("snapshot_id"))  # the fifth run brought no rows
    base = counts.select((F.col("snapshot_id") + 1).alias("snapshot_id"), (F.col("count") * F.when(F.col("snapshot_id") == 2, 2).otherwise(1)).alias("baseline"))
    out = validate.check_tables(rows, CHECKED, ["snapshot_id"], base, runs=runs)
    return out.select("snapshot_id", "n", F.array_join("problems", " ").alias("problems"), F.array_join("warnings", " ").alias("warnings"))


def gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = st.runs(spark, sf_dir)
    return r.select(F.concat(F.lit("r"), F.col("source") % 7).alias("register"), F.concat(F.lit("t"), F.col("source")).alias("table"), F.col("id").alias("run_id"), "record_count", (F.col("event_type") != "view").alias("clean"), (F.col("id") % 11 == 0).alias("accept")).filter("record_count IS NOT NULL OR run_id % 2 = 0").withColumnRenamed("record_count", "n")


def count_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.count_delta_gate(gate_counts(spark, sf_dir))


GATE_SQL = f"""WITH RECURSIVE {st.RUNS_SQL}, c AS MATERIALIZED (SELECT 'r' || source % 7 AS register, 't' || source AS "table", id AS run_id, CAST(record_count AS BIGINT) AS n, event_type <> 'view' AS clean, id % 11 = 0 AS accept, row_number() OVER (PARTITION BY source ORDER BY id) AS i FROM runs WHERE record_count IS NOT NULL OR id % 2 = 0),
g AS (SELECT register, "table", run_id, n, CAST(NULL AS BIGINT) AS baseline, false AS held, i, CASE WHEN n IS NOT NULL AND clean THEN n END AS nxt, CASE WHEN n IS NOT NULL AND clean THEN 0 ELSE 1 END AS age FROM c WHERE i = 1
  UNION ALL SELECT register, "table", run_id, n, base, held, i, CASE WHEN n IS NOT NULL AND clean AND NOT held THEN n ELSE base END, CASE WHEN n IS NOT NULL AND clean AND NOT held THEN 0 ELSE age + 1 END FROM (
    SELECT *, coalesce(n IS NOT NULL AND base > 0 AND n <> base AND abs(n - base) / base > 0.1 AND NOT accept, false) AS held FROM (
      SELECT c.*, CASE WHEN g.age < 14 THEN g.nxt END AS base, g.age FROM g JOIN c ON c."table" = g."table" AND c.i = g.i + 1)))
SELECT register, "table", run_id, n, baseline, held FROM g"""


def verdict_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    l = st.table(spark, sf_dir, "lineitem")  # noqa: E741
    parts = l.select(F.col("l_orderkey").alias("run_id"), F.concat(F.lit("p"), "l_partkey").alias("part"), F.col("l_partkey").alias("ordinal"), (F.col("l_linenumber") < 7).alias("expected"), F.when(F.col("l_quantity") < 4, "EMPTY").alias("problem"))
    tables = l.filter("l_orderkey % 9 <> 0").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("table")).agg(F.count("*").alias("n")).withColumn("problems", F.when(F.col("n") > 3, F.array(F.lit("TOO_MANY"), F.lit("X"))).otherwise(F.array().cast("array<string>")))
    return parts, tables


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, tables = verdict_inputs(spark, sf_dir)
    # runs with numbers divisible by 3 must have the table N, those with numbers that end in 3 a table Z, which never comes
    runs = parts.select("run_id").distinct()
    declared = runs.filter("run_id % 3 = 0").select("run_id", F.lit("N").alias("table")).unionByName(runs.filter("run_id % 10 = 3").select("run_id", F.lit("Z").alias("table")))
    return validate.run_verdict(parts, tables, declared)


def carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = st.table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("source"), (F.col("event_id") % 2).alias("part"), F.col("event_id").alias("run_no"), (F.col("event_type").isin("view", "click", "signup")).alias("not_modified"), F.col("props"))
    numbered = rows.withColumn("run_no", F.expr("dense_rank() OVER (PARTITION BY source, part ORDER BY run_no)").cast("long") + F.when(F.col("run_no") % 10 == 0, 0).otherwise(0))
    body = F.when(~F.col("not_modified"), F.encode("props", "UTF-8"))
    full = numbered.select("source", "part", "run_no", "not_modified", F.when(~F.col("not_modified"), F.when(F.col("run_no") % 8 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("props", 256))).alias("digest"), body.alias("content"), F.when(~F.col("not_modified") & (F.col("run_no") % 6 == 0), "HTML_BODY").alias("problem"))
    return validate.carry_forward(full).select("source", "part", "run_no", "carried_digest", "carried_problem")


CARRY_SQL = """WITH n AS (SELECT user_id AS source, event_id % 2 AS part, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id) AS run_no, event_type IN ('view', 'click', 'signup') AS nm, props FROM events),
p AS (SELECT *, CASE WHEN NOT nm THEN CASE WHEN run_no % 8 = 0 THEN sha256('other') ELSE sha256(props) END END AS digest, CASE WHEN NOT nm AND run_no % 6 = 0 THEN 'HTML_BODY' END AS problem FROM n),
l AS (SELECT p.*, max(CASE WHEN NOT nm THEN run_no END) OVER (PARTITION BY source, part ORDER BY run_no) AS base FROM p)
SELECT l.source, l.part, l.run_no, CASE WHEN NOT l.nm THEN l.digest WHEN b.problem IS NULL AND b.digest = sha256(b.props) THEN b.digest END AS carried_digest,
  CASE WHEN l.nm AND NOT coalesce(b.problem IS NULL AND b.digest = sha256(b.props), false) THEN 'NOT_MODIFIED_WITHOUT_PRIOR' ELSE l.problem END AS carried_problem
FROM l LEFT JOIN p b ON b.source = l.source AND b.part = l.part AND b.run_no = l.base AND l.nm"""


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = st.runs(spark, sf_dir).withColumn("pages_ok", F.when(F.col("id") % 31 == 0, -1).otherwise(F.col("pages_ok"))).withColumn("reason", F.when(F.col("id") % 17 == 0, F.lit(None)).otherwise(F.col("reason")))
    return validate.audit_snapshots(log, F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")).select("id", F.array_join("broken", ",").alias("broken"))


def bad_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.last_bad_status(st.fetches(spark, sf_dir), ["source"], "id")


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = st.sources(spark, sf_dir)
    return runlog.upsert_sources(s, s.filter("source % 2 = 0").select("slug", F.lit(False).alias("enabled")).unionByName(spark.createDataFrame([("new", True)], "slug string, enabled boolean")))


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.latest_snapshot(st.runs(spark, sf_dir), complete_only=True).select("source", "id", "fetched_at", "record_count")


def due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.due_sources(st.sources(spark, sf_dir), st.runs(spark, sf_dir), now()).select("source", "slug")


def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.recent_snapshots(st.runs(spark, sf_dir)).select("source", "id", "rank")


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.source_health(st.sources(spark, sf_dir), st.runs(spark, sf_dir), now())


def stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.staleness(health(spark, sf_dir), now()).select("source", "hours_since_good", "stale")


def url_validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.validators(st.fetches(spark, sf_dir))


def pages_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.previous_pages_ok(st.runs(spark, sf_dir))


def host_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.fetch_stats(st.fetches(spark, sf_dir))


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    req = st.table(spark, sf_dir, "events").select((F.col("user_id") % 21).alias("host"), F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("arrival_ms"))
    return runlog.request_slots(req, 3_000_000).select("id", "slot_ms")


SLOTS_SQL = """WITH n AS (SELECT user_id % 21 AS host, event_id AS id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id % 21 ORDER BY epoch_us(ts) // 1000, event_id) - 1 AS n FROM events)
SELECT id, CAST(max(t - n * 3000000) OVER (PARTITION BY host ORDER BY t, id ROWS UNBOUNDED PRECEDING) + n * 3000000 AS BIGINT) AS slot_ms FROM n"""


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.orphan_sources(st.sources(spark, sf_dir), st.runs(spark, sf_dir), F.col("source") < 10).select("source", "action")


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = st.runs(spark, sf_dir).select(F.to_date("fetched_at").alias("batch"), F.concat(F.lit("s"), "source").alias("slug"), F.when(F.col("complete"), "complete").when(F.col("event_type") == "signup", "skipped").otherwise("incomplete").alias("outcome"))
    out = runlog.batch_outcome(r)
    return out.select("batch", "complete", F.array_join("incomplete", ",").alias("incomplete"), F.array_join("skipped", ",").alias("skipped"))


def slugs_of_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = st.runs(spark, sf_dir).select(F.to_date("fetched_at").alias("batch"), F.concat(F.lit("s"), "source").alias("slug"), F.when(F.col("complete"), "complete").when(F.col("event_type") == "signup", "skipped").otherwise("incomplete").alias("outcome"))
    return runlog.batch_slugs(r)


def page_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.rows(st.table(spark, sf_dir, "part").select("p_name", "p_partkey", "p_brand", "p_type"), q="RING", filters={"p_type": "ECONOMY"}, limit=20, offset=5)[1]


def total_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.rows(st.table(spark, sf_dir, "part"), q="ring")[0]


def searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"part": st.table(spark, sf_dir, "part").select("p_partkey", "p_name"), "pages": st.table(spark, sf_dir, "pages").select("page_id", "url"), "documents": st.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "conversations": st.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")}
    return lookup.search(tables, "ring", None).groupBy("table", "total").agg(F.max("rank").cast("long").alias("shown"))


def searched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five rows of each table that hold a term, by an index of its runs of three characters."""
    root = f"{scratch(spark)}/index"
    tables = {"part": st.table(spark, sf_dir, "part").select("p_partkey", "p_name"), "pages": st.table(spark, sf_dir, "pages").select("page_id", "url"), "conversations": st.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")}
    lookup.write_search_index(tables, root)
    return lookup.search_index(spark, root, "Ring")


def rows_of_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.domain_rows(st.domain_index(spark, sf_dir), st.watchlist(spark, sf_dir)).select("domain", "match", "host", "kind", "jurisdiction", "page_id")


def one_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lookup.check_domain(st.domain_index(spark, sf_dir), "https://www.EXAMPLE.com/")
    return out.select("domain", F.array_join("licensed_in", ",").alias("licensed_in"), F.array_join("blocked_in", ",").alias("blocked_in"), "n_exact", "n_subdomain")


def many_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lookup.check_domains(st.domain_index(spark, sf_dir), st.watchlist(spark, sf_dir))
    return out.select("domain", F.array_join("licensed_in", ",").alias("licensed_in"), F.array_join("blocked_in", ",").alias("blocked_in"), "n_exact", "n_subdomain")


def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lookup.domain_conflicts(st.domain_index(spark, sf_dir))
    return out.select("host", F.array_join("licensed_in", ",").alias("licensed_in"), F.array_join("blocked_in", ",").alias("blocked_in"))


def catalogued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog of one register a nation, joined with its rows: columns and rows a jurisdiction."""
    nations = st.table(spark, sf_dir, "nation")
    registers = [sp.RegisterSpec(f"{k}_register", "", k, (sp.TableSpec("domains", (sp.Column("host", "text", True), sp.Column("page_id", "bigint"))),)) for k in ("licensees", "blocklist")]
    kinds = [sp.resolve(registers, f"{r.slug}.domains")[0].kind for r in registers]
    columns = sp.catalog(spark, registers).groupBy("kind").agg(F.count("*").alias("columns"))  # one row a kind
    rows = st.domain_index(spark, sf_dir).groupBy("jurisdiction", "kind").agg(F.count("*").alias("rows"))
    wanted = nations.select(F.col("n_name").alias("jurisdiction"), F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind"))
    return wanted.join(F.broadcast(columns), "kind").join(rows, ["jurisdiction", "kind"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


HOLDERS = (sp.Column("account", "bigint", True), sp.Column("holder", "text", True), sp.Column("nation", "int"), sp.Column("segment", "text"))


def read_lines(parts: DataFrame) -> DataFrame:
    """Licences published as lines: number, holder and nation between semicolons."""
    cells = F.split("body", ";")
    return parts.select(cells[0].alias("account"), cells[1].alias("holder"), cells[2].alias("nation"))


def read_records(parts: DataFrame) -> DataFrame:
    """Blocked holders published as JSON records with a nested place."""
    r = F.from_json("body", "id string, name string, place struct<nation: string, segment: string>")
    return parts.select(r["id"].alias("account"), r["name"].alias("holder"), r["place"]["nation"].alias("nation"), r["place"]["segment"].alias("segment"))


REGISTERS = [
    sp.RegisterSpec("lines", "AA", "licensees", (sp.TableSpec("holders", HOLDERS, parse=read_lines),)),
    sp.RegisterSpec("records", "BB", "blocklist", (sp.TableSpec("holders", HOLDERS, parse=read_records),)),
]


def parsed_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two registers that publish the same kind of table in two forms, each read by its own table's ``parse``."""
    raw = {
        "lines": st.table(spark, sf_dir, "supplier").select(F.concat_ws(";", "s_suppkey", F.concat(F.lit(" "), "s_name", F.lit("  ")), "s_nationkey").alias("body")),
        "records": st.table(spark, sf_dir, "customer").select(F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("place"))).alias("body")),
    }

    def one(slug: str) -> DataFrame:
        register, declared = sp.resolve(REGISTERS, f"{slug}.holders")
        return scalars.parsed(raw[slug], declared).select(F.lit(register.slug).alias("slug"), F.lit(register.kind).alias("kind"), *declared.names)

    return one("lines").unionByName(one("records"))


D = f"WITH {st.DOMAINS_SQL}, bare AS (SELECT regexp_replace(host, '^www\\.', '') AS host, kind, jurisdiction FROM domains) "
SETS = "coalesce(string_agg(DISTINCT jurisdiction, ',' ORDER BY jurisdiction) FILTER (kind = 'licensees'), '') AS licensed_in, coalesce(string_agg(DISTINCT jurisdiction, ',' ORDER BY jurisdiction) FILTER (kind = 'blocklist'), '') AS blocked_in"
R = f"WITH {st.RUNS_SQL}, {st.SOURCES_SQL} "
QUERIES = {
    "part_checks": (part_checks, """WITH p AS (SELECT event_id, event_id % 3 = 0 AS html, event_id % 5 AS c, event_id % 4 AS t FROM events),
      q AS (SELECT event_id, CASE WHEN c = 0 THEN 'EMPTY' WHEN NOT html AND (c = 1 OR (c = 3 AND t = 0)) THEN 'HTML_BODY' WHEN html AND t IN (1, 2) THEN CASE t WHEN 1 THEN 'CONTENT_TYPE:application/json' ELSE 'CONTENT_TYPE:text/csv' END END AS problem FROM p)
      SELECT event_id, problem, problem IS NOT NULL AS transient FROM q"""),
    "table_checks": (table_checks, f"""WITH {st.OBS_SQL}, b AS (SELECT *, CASE WHEN snapshot_id = 2 AND account % 10 = 0 THEN '' ELSE status END AS s FROM obs), c0 AS (SELECT snapshot_id, count(*) AS n, count(*) FILTER (s = '') AS m, string_agg(DISTINCT s, '|' ORDER BY s) FILTER (s NOT IN ('', 'O', 'Revoked')) AS odd FROM b GROUP BY 1),
      c AS (SELECT snapshot_id, coalesce(n, 0) AS n, coalesce(m, 0) AS m, odd FROM (SELECT unnest([1, 2, 3, 4, 5])::BIGINT AS snapshot_id) LEFT JOIN c0 USING (snapshot_id)),
      d AS (SELECT c.*, p.n * CASE WHEN p.snapshot_id = 2 THEN 2 ELSE 1 END AS base FROM c LEFT JOIN c p ON p.snapshot_id + 1 = c.snapshot_id)
      SELECT snapshot_id, n, CASE WHEN n < 10 THEN 'NO_ROWS:' || n || '<10' ELSE concat_ws(' ', CASE WHEN m / n > 0.02 THEN 'MISSING:status:' || m || '/' || n END, CASE WHEN base > 0 AND abs(n - base) / base > 0.1 THEN 'COUNT_DELTA:' || base || '->' || n END) END AS problems,
        CASE WHEN n < 10 THEN '' ELSE concat_ws(' ', CASE WHEN m > 0 AND m / n <= 0.02 THEN 'MISSING:status:' || m || '/' || n END, CASE WHEN odd IS NOT NULL THEN 'UNKNOWN_VALUE:status:' || odd END) END AS warnings FROM d"""),
    "count_gate": (count_gate, GATE_SQL),
    "verdicts": (verdicts, """WITH p AS (SELECT l_orderkey AS run_id, 'p' || l_partkey AS part, l_partkey AS ordinal, l_linenumber < 7 AS expected, CASE WHEN l_quantity < 4 THEN 'EMPTY' END AS problem FROM lineitem),
      a AS (SELECT run_id, count(*) FILTER (expected) AS wanted, count(*) FILTER (expected AND problem IS NULL) AS good, coalesce(string_agg(part || ':' || problem, ' ' ORDER BY ordinal, part) FILTER (expected AND problem IS NOT NULL), '') AS bad FROM p GROUP BY 1),
      t0 AS (SELECT l_orderkey AS run_id, l_returnflag AS tb, count(*) AS n FROM lineitem WHERE l_orderkey % 9 <> 0 GROUP BY ALL),
      q AS (SELECT DISTINCT l_orderkey AS run_id, 'N' AS tb FROM lineitem WHERE l_orderkey % 3 = 0 UNION ALL SELECT DISTINCT l_orderkey, 'Z' FROM lineitem WHERE l_orderkey % 10 = 3),
      t AS (SELECT run_id, tb, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'NO_TABLE' WHEN n > 3 THEN 'TOO_MANY,X' END AS pr FROM q FULL JOIN t0 USING (run_id, tb)),
      b AS (SELECT run_id, count(*) AS k, CAST(sum(n) AS BIGINT) AS n, coalesce(string_agg(tb || ':' || pr, ' ' ORDER BY tb) FILTER (pr IS NOT NULL), '') AS bad FROM t GROUP BY 1),
      j AS (SELECT a.*, b.n, coalesce(b.bad, '') AS bt, wanted > 0 AND good = wanted AND coalesce(k, 0) > 0 AND coalesce(b.bad, '') = '' AS complete FROM a LEFT JOIN b USING (run_id))
      SELECT run_id, complete, substring(CASE WHEN wanted = 0 THEN 'NO_PARTS' WHEN good < wanted THEN 'PAGE_GAP:' || good || '/' || wanted || ' ' || bad WHEN NOT complete THEN 'INVALID ' || bt END, 1, 500) AS reason, CASE WHEN complete THEN n END AS record_count FROM j"""),
    "carried": (carried, CARRY_SQL),
    "audited": (audited, f"""WITH {st.RUNS_SQL}, r AS (SELECT id, complete, record_count, pages_expected, fetched_at, CASE WHEN id % 31 = 0 THEN -1 ELSE pages_ok END AS ok, CASE WHEN id % 17 <> 0 THEN reason END AS reason FROM runs),
      b AS (SELECT id, concat_ws(',', CASE WHEN complete AND record_count IS NULL THEN 'complete_without_count' END, CASE WHEN complete AND ok <> pages_expected THEN 'complete_with_page_gap' END, CASE WHEN NOT complete AND reason IS NULL THEN 'incomplete_without_reason' END, CASE WHEN fetched_at > '2024-01-30 12:00:00' THEN 'in_future' END, CASE WHEN ok < 0 THEN 'negative_pages' END) AS broken FROM r) SELECT * FROM b WHERE broken <> ''"""),
    "bad_statuses": (bad_statuses, f"WITH {st.FETCHES_SQL} SELECT source, coalesce(max_by(status_code, id) FILTER (status_code NOT IN (200, 304)), 200) AS http_status FROM fetches GROUP BY source"),
    "upserted": (upserted, f"WITH {st.SOURCES_SQL} SELECT source, slug, jurisdiction, CASE WHEN source % 2 = 0 THEN false ELSE enabled END AS enabled FROM sources UNION ALL SELECT NULL, 'new', NULL, true"),
    "latest": (latest, f"WITH {st.RUNS_SQL} SELECT source, id, fetched_at, record_count FROM runs WHERE complete QUALIFY row_number() OVER (PARTITION BY source ORDER BY fetched_at DESC, id DESC) = 1"),
    "due": (due, R + f"SELECT source, slug FROM sources WHERE source NOT IN (SELECT source FROM runs WHERE {GOOD} AND fetched_at > {TNOW} - INTERVAL 20 HOUR)"),
    "recent": (recent, f"WITH {st.RUNS_SQL} SELECT source, id, CAST(row_number() OVER (PARTITION BY source ORDER BY fetched_at DESC, id DESC) AS INT) AS rank FROM runs QUALIFY rank <= 14"),
    "health": (health, R + f", p AS (SELECT source, max(fetched_at) AS last_fetch, max(fetched_at) FILTER ({GOOD}) AS last_good, arg_max_null(reason, (fetched_at, id)) AS last_reason, count(*) FILTER (NOT {GOOD} AND fetched_at > {TNOW} - INTERVAL 7 DAY) AS failed_7d FROM runs GROUP BY 1) SELECT s.*, last_fetch, last_good, last_reason, coalesce(failed_7d, 0) AS failed_7d FROM sources s LEFT JOIN p USING (source) WHERE enabled"),
    "stale": (stale, R + f", p AS (SELECT source, max(fetched_at) FILTER ({GOOD}) AS g FROM runs GROUP BY 1), h AS (SELECT source, epoch_us({TNOW}) - epoch_us(g) AS us FROM sources LEFT JOIN p USING (source) WHERE enabled) SELECT source, round(us / 3.6e9, 1) AS hours_since_good, coalesce(us / 3.6e9 > 26, true) AS stale FROM h"),
    "url_validators": (url_validators, f"WITH {st.FETCHES_SQL}, l AS (SELECT source, max((fetched_at, id)) AS m FROM fetches GROUP BY 1) SELECT f.source, url, etag, last_modified FROM fetches f JOIN l ON f.source = l.source AND (f.fetched_at, f.id) = m WHERE status_code IN (200, 304) AND (etag IS NOT NULL OR last_modified IS NOT NULL)"),
    "pages_before": (pages_before, f"WITH {st.RUNS_SQL} SELECT source, pages_ok FROM runs WHERE {GOOD} QUALIFY row_number() OVER (PARTITION BY source ORDER BY fetched_at DESC, id DESC) = 1"),
    "host_stats": (host_stats, f"WITH {st.FETCHES_SQL} SELECT regexp_extract(url, '//([^/]*)', 1) AS host, count(*) AS attempts, count(*) FILTER (attempt_no > 1) AS retries, count(*) FILTER (status_code = 429) AS too_many, CAST(sum(bucket_wait_ms) AS BIGINT) AS wait_ms, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (robots_decision = 'disallowed') AS disallowed FROM fetches GROUP BY 1"),
    "slots": (slots, SLOTS_SQL),
    "orphans": (orphans, R + "SELECT source, CASE WHEN source IN (SELECT source FROM runs) THEN 'disable' ELSE 'delete' END AS action FROM sources WHERE source < 10"),
    "batches": (batches, f"WITH {st.RUNS_SQL} SELECT CAST(fetched_at AS DATE) AS batch, count(*) FILTER (complete) AS complete, coalesce(string_agg('s' || source, ',' ORDER BY 's' || source) FILTER (event_type = 'error'), '') AS incomplete, coalesce(string_agg('s' || source, ',' ORDER BY 's' || source) FILTER (event_type = 'signup'), '') AS skipped FROM runs GROUP BY 1"),
    "slugs_of_batches": (slugs_of_batches, f"""WITH {st.RUNS_SQL}, e AS (SELECT CAST(fetched_at AS DATE) AS batch, 's' || source AS slug, max(CASE WHEN complete THEN 0 WHEN event_type = 'signup' THEN 1 ELSE 2 END) AS o, count(*) AS runs, count_if(complete) AS good FROM runs GROUP BY ALL)
      SELECT batch, slug, CASE o WHEN 0 THEN 'complete' WHEN 1 THEN 'skipped' ELSE 'incomplete' END AS outcome, runs, CAST(sum(good) OVER (PARTITION BY batch) AS BIGINT) AS complete FROM e"""),
    "searched_rows": (searched_rows, """WITH f AS (SELECT 'part' AS "table", to_json({p_partkey: p_partkey, p_name: p_name})::VARCHAR AS row FROM part WHERE contains(lower(p_name), 'ring') UNION ALL SELECT 'pages', to_json({page_id: page_id, url: url})::VARCHAR FROM pages WHERE contains(lower(url), 'ring')
      UNION ALL SELECT 'conversations', to_json({conv_id: conv_id, turn: turn, text: text})::VARCHAR FROM conversations WHERE contains(lower(text), 'ring'))
      SELECT * FROM (SELECT "table", count(*) OVER (PARTITION BY "table") AS total, row_number() OVER (PARTITION BY "table" ORDER BY row) AS rank, row FROM f) WHERE rank <= 5"""),
    "rows_of_domains": (rows_of_domains, D + f", {st.WATCH_SQL}, w AS (SELECT DISTINCT regexp_replace(domain, '^www\\.', '') AS domain FROM watch), d AS (SELECT *, regexp_replace(host, '^www\\.', '') AS b FROM domains) SELECT domain, CASE WHEN b = domain THEN 'exact' ELSE 'subdomain' END AS match, host, kind, jurisdiction, page_id FROM w JOIN d ON b = domain OR ends_with(b, '.' || domain)"),
    "page_of_rows": (page_of_rows, "SELECT p_name, p_partkey, p_brand, p_type FROM part WHERE p_type = 'ECONOMY' AND (contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring')) ORDER BY 1 NULLS LAST, 2 NULLS LAST LIMIT 20 OFFSET 5"),
    "total_of_rows": (total_of_rows, "SELECT count(*) AS total FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring')"),
    "searched": (searched, """SELECT "table", n AS total, n AS shown FROM (SELECT 'part' AS "table", count(*) AS n FROM part WHERE contains(lower(p_name), 'ring') UNION ALL SELECT 'pages', count(*) FROM pages WHERE contains(lower(url), 'ring') UNION ALL SELECT 'documents', count(*) FROM documents WHERE contains(lower(text), 'ring') UNION ALL SELECT 'conversations', count(*) FROM conversations WHERE contains(lower(text), 'ring')) WHERE n > 0"""),
    "one_domain": (one_domain, D + f"SELECT 'example.com' AS domain, {SETS}, count(*) FILTER (host = 'example.com') AS n_exact, count(*) FILTER (host <> 'example.com') AS n_subdomain FROM bare WHERE host = 'example.com' OR ends_with(host, '.example.com')"),
    "many_domains": (many_domains, D + f", {st.WATCH_SQL}, w AS (SELECT DISTINCT regexp_replace(domain, '^www\\.', '') AS domain FROM watch) SELECT domain, {SETS}, count(*) FILTER (host = domain) AS n_exact, count(*) FILTER (host <> domain) AS n_subdomain FROM w JOIN bare ON host = domain OR ends_with(host, '.' || domain) GROUP BY domain"),
    "conflicts": (conflicts, D + f"SELECT host, {SETS} FROM bare GROUP BY host HAVING count(*) FILTER (kind = 'licensees') > 0 AND count(*) FILTER (kind = 'blocklist') > 0"),
    "catalogued": (catalogued, f"WITH {st.DOMAINS_SQL} SELECT n_name AS jurisdiction, k.kind, CAST(2 AS BIGINT) AS columns, count(d.host) AS rows FROM nation CROSS JOIN (SELECT unnest(['licensees', 'blocklist']) AS kind) k LEFT JOIN domains d ON d.jurisdiction = n_name AND d.kind = k.kind GROUP BY ALL"),
    "parsed_registers": (parsed_registers, """SELECT 'lines' AS slug, 'licensees' AS kind, s_suppkey AS account, s_name AS holder, s_nationkey AS nation, CAST(NULL AS VARCHAR) AS segment FROM supplier
      UNION ALL SELECT 'records', 'blocklist', c_custkey, c_name, c_nationkey, c_mktsegment FROM customer"""),
}
