"""Queries over files, documents and streams. Files are written from the given tables to the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snaptrail.functions.scalars import host
from snaptrail.operators import extract as ex
from snaptrail.operators import history as hist
from snaptrail.operators import identity
from snaptrail.plans import history_queries as hq
from snaptrail.plans import log_queries as lq
from snaptrail.plans import standins as st
from snaptrail.plans.scratch import scratch
from snaptrail.sources import readers, split_csv
from snaptrail.streaming import streams


def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    c = st.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("Key"), F.concat(F.lit("  "), "c_name").alias("Name"), F.when(F.col("c_custkey") % 5 != 0, F.concat(F.col("c_mktsegment"), F.lit(', "x"'))).alias("Segment"))
    c.write.csv(path, header=True, escape='"')
    rows, _ = readers.read_csv_strict(spark, path, ["key", "name", "segment"], ["Key", "Name", "Segment"])
    return rows


def csv_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of files whose fields hold quotes and line breaks, each file read in blocks."""
    path = scratch(spark)
    o = st.table(spark, sf_dir, "orders")
    note = F.concat(F.lit("line one,\n"), F.when(F.col("o_orderkey") % 3 == 0, '"quoted",\n\n').otherwise(""), "o_orderpriority", F.when(F.col("o_orderkey") % 7 == 0, "\n\"").otherwise(""))
    o.select(F.col("o_orderkey").cast("string").alias("Key"), note.alias("Note"), F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("5\" "), "o_orderstatus")).alias("Status")).write.csv(path, header=True, escape='"')
    return split_csv.read_csv_blocks(spark, path, ["key", "note", "status"], ["Key", "Note", "Status"])[0]


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    c = st.table(spark, sf_dir, "customer")
    files = c.groupBy(F.floor(F.col("c_custkey") / 100)).agg(F.to_json(F.struct(F.collect_list(F.struct("c_custkey", "c_name")).alias("data"))).alias("value"))
    files.select("value").repartition(4).write.option("lineSep", " ").text(path)
    lines = spark.read.text(path, lineSep="\n")
    # one JSON document a file is the format; here each document is written to a file of its own
    one = scratch(spark)
    parts = lines.select(F.explode(F.split(F.regexp_replace("value", r"\}\s*\{\"data\"", "}\n{\"data\""), "\n")).alias("value"))
    parts.write.option("maxRecordsPerFile", 1).text(one)
    rows, _ = readers.read_json_records(spark, one, T.StructType.fromDDL("c_custkey long, c_name string"))
    return rows.select("c_custkey", "c_name")


def xml_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    st.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("_Lp"), F.col("s_name").alias("Name")).write.format("xml").option("rowTag", "Entry").option("rootTag", "Entries").save(path)
    return readers.read_xml_entries(spark, path, "Entry", {"_Lp": "entry_no", "Name": "name"})


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    s = st.table(spark, sf_dir, "pages")
    s.select(F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("# "), "url")).when(F.col("page_id") % 4 == 1, "").otherwise(F.concat(F.lit("  "), "url", F.lit("\r")))).write.text(path)
    return readers.read_text_lines(spark, path).select("line")


def blob_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark)
    s = st.table(spark, sf_dir, "supplier")
    for k in range(5):  # the layout's folders, one a register
        readers.write_text_blobs(s.filter(F.col("s_nationkey") % 5 == k).select("s_name"), f"{root}/r{k}/2024-01-0{k + 1}/run{k}")
    return readers.read_blobs(spark, root).select("slug", "run_date", "run_id", "kind", F.decode("content", "UTF-8").alias("body"), "digest").filter("body <> ''")


def manifest_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark)
    c = st.table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    problems = F.when(F.col("n") % 2 == 0, F.array(F.lit("EMPTY"))).otherwise(F.array().cast("array<string>"))
    part = F.struct(F.lit("main").alias("name"), F.lit("csv").alias("kind"), F.lit(True).alias("expected"), problems.alias("problems"), F.sha2("c_mktsegment", 256).alias("digest"))
    tables = F.create_map(F.lower("c_mktsegment"), F.struct(F.col("n").alias("rows"), problems.alias("problems")))
    m = F.struct(F.concat_ws("-", "c_nationkey", "c_mktsegment").alias("run_id"), F.concat(F.lit("r"), "c_nationkey").alias("slug"), (F.col("n") % 2 == 1).alias("complete"), F.array(part).alias("parts"), tables.alias("tables"))
    c.select(F.to_json(m).alias("value")).write.option("maxRecordsPerFile", 1).text(root)
    runs, parts, judged = readers.read_manifests(spark, root, "part-*")
    found = runs.join(parts.select("run_id", "ordinal", F.array_join("problems", ",").alias("problems"), "digest"), "run_id")
    return found.join(judged.select("run_id", "table", "rows"), "run_id")


def published_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark)
    readers.write_history(hq.history(spark, sf_dir), f"{root}/history", 1)
    readers.write_snapshot_log(spark.createDataFrame([(1,)], "version long"), f"{root}/log")
    return readers.read_history(spark, f"{root}/history", f"{root}/log")


def history_in_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of three snapshots as a bucketed table, to which the fourth is applied, stored as the next version."""
    obs, root, buckets = st.licence_obs(spark, sf_dir), scratch(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, snaps = f"history_{root.rsplit('/', 1)[1]}", st.snapshots(spark)
    old = hist.history_of_rows(obs.filter("snapshot_id < 4"), snaps.filter("snapshot_id < 4"))
    readers.write_history_table(old, f"{name}_3", f"{root}/3", buckets, st.VALUES)
    fourth = identity.numbered(obs.filter("snapshot_id = 4").select(*st.VALUES)).withColumn("snapshot_id", F.lit(4).cast("long"))
    told = [(r["snapshot_id"], r["at"]) for r in snaps.filter("snapshot_id = 4").collect()]  # one row a snapshot
    new = hist.apply_snapshots(spark.table(f"{name}_3"), fourth, told, 3, hq.KEY)
    readers.write_history_table(new, f"{name}_4", f"{root}/4", buckets, st.VALUES)
    return hq.with_hash(spark.table(f"{name}_4"))


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = st.table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("name"), F.split("p_name", " ").alias("words"))
    return readers.export_rows(p)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.extract_links(st.table(spark, sf_dir, "pages"), '<a href="([^"]*)"', "page_id")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark, sf_dir).select("page_id", F.col("pos").cast("long").alias("pos"), "url")


def first_of_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.first_links(links(spark, sf_dir), "page_id", ex.part_name(F.substring_index("url", ",", 1), "th"))


def newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.newest_link(links(spark, sf_dir), "page_id", [F.length("link"), F.col("link")])


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = st.table(spark, sf_dir, "customer")
    expected, found = c.filter("c_custkey % 3 = 0").select(F.col("c_name").alias("part")), c.filter("c_custkey % 2 = 0").select(F.col("c_name").alias("part"), F.concat(F.lit("http://x/"), "c_custkey").alias("url"))
    return ex.reconcile_parts(expected, found)


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.expand_pages(st.table(spark, sf_dir, "pages").withColumn("html", F.concat("url", F.lit(" "), F.when(F.col("page_id") % 50 == 0, "?page=700").otherwise(""))), "page_id")


def made_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.when(F.col("c_custkey") % 7 == 0, "<tr><th>Other</th></tr>").otherwise("<tr><th>Name <b>of</b></th><th>Segment</th></tr>")
    body = F.concat(F.lit("<tr><td> "), "c_name", F.lit("<td>"), "c_mktsegment", F.lit("&amp;co<tr><td></td></tr><tr><td>second</td><td> </td></tr>"))
    page = F.when(F.col("c_custkey") % 11 == 0, "<p>none</p>").otherwise(F.concat(F.lit("<div><table>"), head, body, F.lit("</table>")))
    return st.dealt(st.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey").select("c_custkey", page.alias("html"))


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = ex.html_tables(made_tables(spark, sf_dir), ["Name of", "Segment"], "c_custkey")
    return rows.select("c_custkey", "row_no", F.col("Name of").alias("name"), F.col("Segment").alias("segment"))


def table_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.html_tables(made_tables(spark, sf_dir), ["Name of", "Segment"], "c_custkey")[1]


def key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.concat(F.lit("<table><tr><td>Company</td><td>"), "s_name", F.lit("</td></tr><tr><td>Nation</td><td>"), "s_nationkey", F.lit("</td></tr><tr><td>Nation</td><td>n"), "s_nationkey", F.lit("</td></tr></table><table><tr><td>x</td><td>y</td></tr></table>"))
    suppliers = st.dealt(st.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), "s_suppkey")
    rows = ex.table_rows(suppliers.select("s_suppkey", page.alias("html")), "s_suppkey")
    return ex.kv_tables(rows, "s_suppkey", "Company").select("s_suppkey", F.col("record")["Company"].alias("company"), F.col("record")["Nation"].alias("nation"))


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.carry_heading(st.table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "signup", F.col("props")).select("event_id", "heading")


def headed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise("")
    return ex.carry_heading(st.table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "signup", value, once=True).select("event_id", "heading")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.explode_list(st.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit(", ")), F.lit(" - "), "p_brand").alias("item")), "item")


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.when(F.col("p_partkey") % 2 == 0, "Licence holder").otherwise("Operator"), F.lit(": "), "p_name", F.lit("\nBrand : "), "p_brand")
    return st.table(spark, sf_dir, "part").select("p_partkey", ex.labelled_field(text, ["licence holder", "operator"]).alias("holder"), ex.labelled_field(text, ["BRAND"]).alias("brand"))


def unpivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(*[F.when(F.col("p_size") % (i + 2) == 0, " ● ").otherwise("") for i in range(4)])
    labels = spark.createDataFrame([(0, "dice", "shop"), (1, "dice", "net"), (2, "cards", "shop"), (3, "cards", "net")], "pos int, game string, channel string")
    return ex.unpivot_matrix(st.table(spark, sf_dir, "part").select("p_partkey", cells.alias("cells")), ["p_partkey"], labels)


def merged_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = st.table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), F.col("event_id").alias("pos"), F.col("event_type").alias("label"), F.col("event_id").cast("string").alias("value"))
    return ex.merge_repeated_labels(kv, "item", {"error": "errors", "signup": "signups"})


def headers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = st.table(spark, sf_dir, "customer")
    def row(no: int, *cells: Column) -> Column:
        return F.struct(F.lit(no).alias("row_no"), F.array(*cells).alias("cells"))

    rows = F.array(row(0, F.lit("Title")), row(1, F.when(F.col("c_custkey") % 5 == 0, "Namen").otherwise("Name"), F.lit("Segment")), row(2, F.col("c_name"), F.col("c_mktsegment")), row(3, F.lit("last")))
    sheets = c.select("c_custkey", F.lit(0).alias("sheet_no"), F.when(F.col("c_custkey") % 7 == 0, "B").otherwise("A").alias("sheet"), F.inline(rows))
    return ex.find_header(sheets, ["Name", "Segment"], "c_custkey", sheet="A")


def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers(spark, sf_dir)[0].select("c_custkey", "row_no", F.col("Name").alias("name"), F.col("Segment").alias("segment"))


def sheet_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers(spark, sf_dir)[1]


def plain_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.concat(F.lit("<p>\n <b>"), "p_name", F.lit("</b>&nbsp;&amp; "), "p_brand", F.lit("</p><script>x<1</script><!-- c -->"))
    return st.table(spark, sf_dir, "part").select("p_partkey", ex.html_text(F.when(F.col("p_partkey") % 2 == 0, page).otherwise(F.concat(F.lit("<i>"), "p_type", F.lit("</i>")))).alias("text"))


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.create_map(F.col("event_type"), F.lit(None).cast("string"), F.lit("id"), F.col("event_id").cast("string"))
    one, two = ex.route_by_keys(st.table(spark, sf_dir, "events").select("event_id", record.alias("record")), ["view", "click"])
    return one.select("event_id", F.lit("first").alias("goes_to")).unionByName(two.select("event_id", F.lit("second").alias("goes_to")))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("List of domains\n  "), host(F.col("url")), F.lit("   "), F.col("page_id") % 28 + 1, F.lit(".02.2024 \nend"))
    return ex.regex_listing(st.table(spark, sf_dir, "pages").select("page_id", line.alias("text")), "page_id", "text")


def stream_of(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A stream of a derived table, by way of files."""
    path = scratch(spark)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def sink(spark: SparkSession, df: DataFrame) -> DataFrame:
    path = scratch(spark)
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}_state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def streamed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark)
    streams.stream_history(stream_of(spark, hq.numbered(spark, sf_dir)), root, f"{root}/state", key=hq.KEY).awaitTermination()
    return hq.with_hash(streams.streamed_rows(spark, root))


def streamed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of snapshots that arrive in pieces and out of order, each applied when as many rows have come as its run declared."""
    obs, snaps = st.licence_obs(spark, sf_dir), st.snapshots(spark)
    root, arriving, counted = scratch(spark), scratch(spark), scratch(spark)
    # rows are counted and put in order once, and all pieces made of that
    hist.counted_rows(obs, snaps).sortWithinPartitions(*st.VALUES).write.parquet(counted, compression=streams.STORED)
    rows = hist.rows_of_counts(spark.read.parquet(counted), snaps)
    obs.groupBy("snapshot_id").agg(F.count("*").alias("n_rows")).join(F.broadcast(snaps), "snapshot_id").write.parquet(f"{root}/declared")
    for snapshot, half in ((2, 0), (4, 0), (2, 1), (1, 0), (3, 0), (4, 1), (1, 1), (3, 1)):
        rows.filter((F.col("snapshot_id") == snapshot) & (F.col("account") % 2 == half)).write.parquet(f"{arriving}/{snapshot}_{half}", compression=streams.STORED)
        # the stream goes on from its checkpoint with what has come since
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(arriving)
        streams.stream_history(stream, root, f"{root}/state", lambda s: s.read.parquet(f"{root}/declared"), hq.KEY).awaitTermination()
    return hq.with_hash(streams.streamed_rows(spark, root))


def streamed_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sink(spark, streams.stream_gate(stream_of(spark, lq.gate_counts(spark, sf_dir))))


def streamed_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sink(spark, streams.stream_failures(stream_of(spark, st.runs(spark, sf_dir))))
    return out.select("source", F.col("start").cast("timestamp_ntz").alias("start"), "failed", "good")


def streamed_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = st.domain_index(spark, sf_dir).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    return sink(spark, streams.stream_domain_watch(stream_of(spark, rows), st.watchlist(spark, sf_dir))).select("domain", "host", "kind", "jurisdiction")


def watched_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sightings when every row comes a second time, three days later: none is told twice."""
    path, rows = scratch(spark), st.domain_index(spark, sf_dir)
    for day in ("2024-01-01", "2024-01-04"):
        rows.withColumn("ts", F.lit(day).cast("timestamp")).repartition(2).write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 2).parquet(path)
    return sink(spark, streams.stream_domain_watch(stream, st.watchlist(spark, sf_dir))).select("domain", "host", "kind", "jurisdiction")


def runs_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of runs stored as files, each taken up when its manifest is there."""
    root, target = scratch(spark), scratch(spark)
    obs = hq.numbered(spark, sf_dir)
    for k in range(1, 5):
        folder = f"{root}/licences/2024-01-0{k}/run{k}"
        obs.filter(F.col("snapshot_id") == k).write.parquet(f"{folder}/rows.parquet")
        spark.createDataFrame([(f"run{k}", "licences", True)], "run_id string, slug string, complete boolean").coalesce(1).write.json(f"{folder}/manifest")

    def parse(runs: DataFrame, folders: list[str]) -> DataFrame:
        return spark.read.parquet(*[f"{f.rsplit('/', 1)[0]}/rows.parquet" for f in folders])

    streams.stream_history_of_runs(streams.stream_runs(spark, root, "part-*.json"), target, f"{target}/state", parse, hq.KEY).awaitTermination()
    return hq.with_hash(streams.streamed_rows(spark, target))


LINKS = """l AS (SELECT page_id, url AS page, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS ls FROM pages), k AS (SELECT page_id, unnest(ls) AS link, generate_subscripts(ls, 1) - 1 AS pos, regexp_extract(page, '^([a-zA-Z]+://[^/?#]*)', 1) AS origin FROM l), links AS (SELECT page_id, pos, link, origin || link AS url FROM k)"""
WATCHED = lq.D + f", {st.WATCH_SQL}, w AS (SELECT DISTINCT domain FROM watch) SELECT DISTINCT domain, d.host, d.kind, d.jurisdiction FROM w JOIN domains d ON regexp_replace(d.host, '^www\\.', '') = domain OR ends_with(regexp_replace(d.host, '^www\\.', ''), '.' || domain)"
QUERIES = {
    "csv_rows": (csv_rows, "SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment || ', \"x\"' END AS segment FROM customer"),
    "csv_blocks": (csv_blocks, """SELECT CAST(o_orderkey AS VARCHAR) AS key, 'line one,' || chr(10) || CASE WHEN o_orderkey % 3 = 0 THEN '"quoted",' || chr(10) || chr(10) ELSE '' END || o_orderpriority || CASE WHEN o_orderkey % 7 = 0 THEN chr(10) || '"' ELSE '' END AS note,
      CASE WHEN o_orderkey % 5 <> 0 THEN '5" ' || o_orderstatus END AS status FROM orders"""),
    "json_rows": (json_rows, "SELECT c_custkey, c_name FROM customer"),
    "xml_rows": (xml_rows, "SELECT CAST(s_suppkey AS VARCHAR) AS entry_no, s_name AS name FROM supplier"),
    "text_lines": (text_lines, "SELECT url AS line FROM pages WHERE page_id % 4 > 1"),
    "blob_parts": (blob_parts, "SELECT 'r' || s_nationkey % 5 AS slug, CAST('2024-01-01' AS DATE) + CAST(s_nationkey % 5 AS INT) AS run_date, 'run' || s_nationkey % 5 AS run_id, 'txt' AS kind, s_name || chr(10) AS body, sha256(s_name || chr(10)) AS digest FROM supplier"),
    "manifest_tables": (manifest_tables, """WITH m AS (SELECT c_nationkey AS k, c_mktsegment AS s, count(*) AS n FROM customer GROUP BY ALL)
      SELECT k || '-' || s AS run_id, 'r' || k AS slug, n % 2 = 1 AS complete, CAST(0 AS INT) AS ordinal, CASE WHEN n % 2 = 0 THEN 'EMPTY' ELSE '' END AS problems, sha256(s) AS digest, lower(s) AS "table", n AS rows FROM m"""),
    "published_history": (published_history, hq.H + "SELECT * FROM history"),
    "history_in_buckets": (history_in_buckets, hq.H + "SELECT * FROM history"),
    "exported": (exported, "SELECT p_partkey || ',' || CASE WHEN p_partkey % 3 <> 0 THEN p_name ELSE '' END || ',' || replace(p_name, ' ', ';') AS line FROM part"),
    "page_links": (page_links, f"WITH {LINKS} SELECT page_id, pos, url FROM links"),
    "first_of_part": (first_of_part, f"WITH {LINKS}, n AS (SELECT page_id, pos, url, regexp_replace(regexp_replace(lower(regexp_extract(regexp_replace(string_split(url, ',')[1], '[?#].*$', ''), '([^/]*)/?$', 1)), '\\.csv$', ''), '^th', '') AS part FROM links) SELECT page_id, part, min_by(url, pos) AS url FROM n GROUP BY ALL"),
    "newest": (newest, f"WITH {LINKS} SELECT page_id, max_by(url, (length(link), link, pos)) AS url FROM links GROUP BY page_id"),
    "reconciled": (reconciled, "SELECT c_name AS part, CASE WHEN c_custkey % 2 = 0 THEN 'http://x/' || c_custkey END AS url, c_custkey % 3 = 0 AS expected, CASE WHEN c_custkey % 2 <> 0 THEN 'NOT_LISTED' END AS problem FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0"),
    "paged": (paged, """WITH n AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS stem, least(100, greatest(coalesce(try_cast(nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') AS INT), 0), CASE WHEN page_id % 50 = 0 THEN 700 ELSE 0 END)) AS n FROM pages)
      SELECT page_id, CAST(p AS INT) AS page, stem || '?page=' || p AS page_url FROM (SELECT page_id, stem, unnest(range(0, n + 1)) AS p FROM n)"""),
    "table_cells": (table_cells, "SELECT c_custkey, CAST(r AS INT) AS row_no, CASE r WHEN 1 THEN c_name ELSE 'second' END AS name, CASE r WHEN 1 THEN c_mktsegment || '&co' END AS segment FROM customer, (SELECT unnest([1, 2]) AS r) WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0"),
    "table_problems": (table_problems, "SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'NO_TABLE' ELSE 'HEADER_MISMATCH' END AS problem FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 11 = 0"),
    "key_values": (key_values, "SELECT s_suppkey, s_name AS company, 'n' || s_nationkey AS nation FROM supplier"),
    "headed": (headed, "SELECT event_id, h AS heading FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'signup' THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h FROM events) WHERE event_type <> 'signup'"),
    "headed_once": (headed_once, """WITH n AS (SELECT *, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY event_id) AS no FROM events), h AS (SELECT user_id, no, CASE WHEN event_id % 2 = 0 THEN props END AS heading FROM n WHERE event_type = 'signup')
      SELECT event_id, heading FROM (SELECT event_id, user_id, no, row_number() OVER (PARTITION BY user_id, no ORDER BY event_id) AS r FROM n WHERE event_type <> 'signup') LEFT JOIN h USING (user_id, no) WHERE r = 1"""),
    "items": (items, "SELECT p_partkey, unnest(list_append(string_split(p_name, ' '), p_brand)) AS item FROM part"),
    "fields": (fields, "SELECT p_partkey, p_name AS holder, p_brand AS brand FROM part"),
    "unpivoted": (unpivoted, "SELECT p_partkey, ['dice', 'dice', 'cards', 'cards'][i + 1] AS game, ['shop', 'net', 'shop', 'net'][i + 1] AS channel FROM part, (SELECT unnest([0, 1, 2, 3]) AS i) WHERE p_size % (i + 2) = 0"),
    "merged_labels": (merged_labels, "SELECT user_id AS item, string_agg(CAST(event_id AS VARCHAR), ' | ' ORDER BY event_id) FILTER (event_type = 'error') AS errors, string_agg(CAST(event_id AS VARCHAR), ' | ' ORDER BY event_id) FILTER (event_type = 'signup') AS signups FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1"),
    "sheet_rows": (sheet_rows, "SELECT c_custkey, CAST(r AS INT) AS row_no, CASE r WHEN 2 THEN c_name ELSE 'last' END AS name, CASE r WHEN 2 THEN c_mktsegment END AS segment FROM customer, (SELECT unnest([2, 3]) AS r) WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0"),
    "sheet_problems": (sheet_problems, "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'NO_SHEET' ELSE 'HEADER_MISMATCH' END AS problem FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 7 = 0"),
    "plain_texts": (plain_texts, "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' & ' || p_brand ELSE p_type END AS text FROM part"),
    "routed": (routed, "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'first' ELSE 'second' END AS goes_to FROM events"),
    "listing": (listing, f"SELECT page_id, {st.HOST_SQL} AS domain, CAST('2024-02-01' AS DATE) + CAST(page_id % 28 AS INT) AS listed_on FROM pages"),
    "streamed_history": (streamed_history, hq.H + "SELECT * FROM history"),
    "streamed_pieces": (streamed_pieces, hq.H + "SELECT * FROM history"),
    "streamed_gate": (streamed_gate, lq.GATE_SQL),
    "streamed_failures": (streamed_failures, f"""WITH {st.RUNS_SQL}, m AS (SELECT max(fetched_at) - INTERVAL 1 DAY AS mark FROM runs), w AS (SELECT source, {lq.GOOD} AS g, date_trunc('day', fetched_at) - to_days(CAST(k AS INT)) AS start FROM runs, (SELECT unnest(range(0, 7)) AS k))
      SELECT source, CAST(start AS TIMESTAMP) AS start, count(*) FILTER (NOT g) AS failed, count(*) FILTER (g) AS good FROM w, m WHERE start + INTERVAL 7 DAY <= mark GROUP BY ALL"""),
    "runs_of_files": (runs_of_files, hq.H + "SELECT * FROM history"),
    "watched_again": (watched_again, WATCHED),
    "streamed_watch": (streamed_watch, WATCHED),
}
