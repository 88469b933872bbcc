"""Cell functions, checks, history and readers on cases of their own."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from snaptrail import spec as sp
from snaptrail.functions import scalars
from snaptrail.operators import extract, identity, lookup, runlog, validate
from snaptrail.operators import history as hist
from snaptrail.sources import readers


def one(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_clean(spark):
    assert one(spark, scalars.clean, [None, "", "  ", " a  b ", " x ", "é", "\x1cq\x85"]) == [None, None, None, "a  b", "x", "é", "q"]


def test_dates(spark):
    good = ["2024-03-05", "2024-03-05T10:11:12.123Z", "2024-03-05T10:11:12Z", "2024-03-05T10:11:12", "2024-03-05 10:11:12.5", "05/03/2024", "5.3.2024", "05.03.2024 10:11:12", "5 March 2024", "05 mar 2024", "05-03-2024", "5.3.2024 0:00:00", "5.3.2024 (new)"]
    assert one(spark, scalars.to_date, good) == [dt.date(2024, 3, 5)] * len(good)
    assert one(spark, scalars.to_date, ["31.02.2024", "3.8:2024", "soon", "2024-13-01", "2024-03-05T10:11:12.5", None]) == [None] * 6


def test_hosts(spark):
    cases = {"https://www.Bet.pt/": "www.bet.pt", "bet.com": "bet.com", "http://u:p@x.org:81/a?b": "x.org", "no dot": None, "localhost": None, "a b.com": None, "x.com.": "x.com", "": None, "http://[::1]/": None}
    assert one(spark, scalars.host, list(cases)) == list(cases.values())


def test_other_scalars(spark):
    assert one(spark, scalars.pad_company_id, ["123", "12345678", "a1"]) == ["00000123", "12345678", "a1"]
    assert one(spark, scalars.licence_stem, ["000102-N-317976-010"]) == ["000102-N-317976"]
    assert one(spark, scalars.normalise_code, [" us_nj "]) == ["US-NJ"]
    assert one(spark, scalars.split_list, ["a, b;c - d  e", None]) == [["a", "b", "c", "d", "e"], []]
    assert one(spark, lambda c: scalars.contains_ci(c, "50%_"), ["x 50%_ y", "x 50ab y"]) == [True, False]


SPEC = sp.TableSpec("t", (sp.Column("a", "text", True), sp.Column("n", "int"), sp.Column("d", "date"), sp.Column("l", "text[]"), sp.Column("ts", "timestamptz"), sp.Column("q", "numeric"), sp.Column("b", "bool")))


def test_coerce(spark):
    df = spark.createDataFrame([(" x ", " 12 ", "1.2.2024", "one", "2024-01-01T00:00:00Z", "1.5", True), ("", "1x", "?", None, "?", "?", None)], "a string, n string, d string, l string, ts string, q string, b boolean")
    rows = scalars.coerce(df, SPEC).orderBy(F.col("a").desc_nulls_last()).collect()
    assert (rows[0]["a"], rows[0]["n"], rows[0]["d"], rows[0]["l"], float(rows[0]["q"]), rows[0]["b"]) == ("x", 12, dt.date(2024, 2, 1), ["one"], 1.5, True)
    assert [rows[1][c] for c in "andqb"] == [None] * 5 and rows[1]["ts"] is None
    with pytest.raises(ValueError, match="UNDECLARED_COLUMNS"):
        scalars.coerce(df.withColumn("zz", F.lit(1)), SPEC)
    with pytest.raises(ValueError):
        sp.Column("Bad")


def test_identity_keeps_duplicates_apart(spark):
    df = spark.createDataFrame([("x", 1), ("x", 1), ("y", None)], "a string, n int")
    out = identity.row_identity(df).collect()
    digest = hashlib.sha256(b'["x",1]').digest()
    assert {r["row_hash"] for r in out if r["a"] == "x"} == {hashlib.sha256(digest + n.to_bytes(4, "big")).hexdigest() for n in (0, 1)}
    assert len({r["row_hash"] for r in out}) == 3
    again = identity.row_identity(df.limit(1).union(df.filter("a = 'y'"))).collect()
    assert {r["row_hash"] for r in again} < {r["row_hash"] for r in out}


def test_canonical_hash_ignores_order(spark):
    rows = spark.createDataFrame([(1, "t", f"{i:02x}") for i in range(50)], "r int, table string, row_hash string")
    a, b = (identity.canonical_hash(df, ["r"]).head()["canonical_hash"] for df in (rows, rows.orderBy(F.desc("row_hash")).repartition(7)))
    assert a == b != identity.canonical_hash(rows.limit(49), ["r"]).head()["canonical_hash"]


def test_parts_table(spark):
    cases = [(b"", "csv", None, "EMPTY"), (b" \n", "csv", None, "EMPTY"), (b"\xef\xbb\xbf<!DOCTYPE html>", "csv", None, "HTML_BODY"), (b"<x>", "csv", "text/html", "HTML_BODY"), (b"a,b", "csv", "text/html", None), (b"<p>", "html", "application/json; q", "CONTENT_TYPE:application/json"), (b"<p>", "html", "text/html", None), (None, "csv", None, "EMPTY")]
    df = spark.createDataFrame([(i, None if c is None else bytearray(c), k, t) for i, (c, k, t, _) in enumerate(cases)], "i int, content binary, kind string, content_type string")
    assert [r["problem"] for r in validate.check_parts(df).orderBy("i").collect()] == [c[3] for c in cases]


def test_gate_holds_until_accepted(spark):
    counts = spark.createDataFrame([("r", "t", i, n, True, acc) for i, (n, acc) in enumerate([(3, False), (1, False), (1, True), (1, False), (None, False), (1, False)])], "register string, table string, run_id long, n long, clean boolean, accept boolean")
    assert [(r["baseline"], r["held"]) for r in validate.count_delta_gate(counts).orderBy("run_id").collect()] == [(None, False), (3, True), (3, False), (1, False), (1, False), (1, False)]


def test_rebuild_equals_fold(spark):
    days = {1: "ab", 2: "bc", 3: "", 4: "ab"}
    obs = spark.createDataFrame([(s, h, h * 2) for s, hs in days.items() for h in hs], "snapshot_id long, row_hash string, v string")
    snaps = spark.createDataFrame([(s, dt.datetime(2024, 1, s)) for s in days], "snapshot_id long, at timestamp_ntz")
    built = hist.build_history(obs, snaps)
    folded = built.filter("false")
    for s in days:
        for _ in range(2):  # applying again changes nothing
            folded = hist.apply_snapshot(folded, obs.filter(F.col("snapshot_id") == s).drop("snapshot_id"), F.lit(s).cast("long"), F.lit(dt.datetime(2024, 1, s)).cast("timestamp_ntz"))
    key = lambda df: sorted(map(str, df.select(*built.columns).collect()))
    assert key(built) == key(folded) and built.count() == 5
    for s, hs in days.items():
        assert sorted(r["row_hash"] for r in hist.as_of(built, s).collect()) == sorted(hs)


def test_renumbering(spark):
    rows = [("added", "h1", "102", "102-N-1-011", "Active"), ("removed", "h2", "102", "102-N-1-010", "Active"), ("removed", "h3", "103", "103-R-2-001", "Active"), ("added", "h4", "103", "103-R-2-001", "Revoked"), ("added", "h5", "104", "104-R-3-001", "Active")]
    df = spark.createDataFrame([(2, *r, "Bingo") for r in rows], "changed_in long, kind string, row_hash string, account string, licence string, status string, activity string")
    out = {r["row_hash"]: (r["kind"], r["other_hash"], r["changed"]) for r in hist.pair_renumbered(df, "account", "licence", "activity", ["licence", "status"]).collect()}
    assert out == {"h1": ("renumbered", "h2", "licence"), "h4": ("renumbered", "h3", "status"), "h5": ("added", None, None)}


def test_slots(spark):
    df = spark.createDataFrame([("h", 0, 0), ("h", 1, 10), ("h", 2, 500), ("g", 3, 7)], "host string, id int, arrival_ms long")
    assert [r["slot_ms"] for r in runlog.request_slots(df, 100).orderBy("id").collect()] == [0, 100, 500, 7]


def test_rows_and_domains(spark):
    df = spark.createDataFrame([("b", 1, ["x"]), (None, 2, ["100%"]), ("a", 3, [])], "n string, k int, l array<string>")
    total, page = lookup.rows(df, q="%")
    assert total.head()["total"] == 1 and [r["k"] for r in lookup.rows(df)[1].collect()] == [3, 1, 2] and page.count() == 1
    tied = spark.createDataFrame([("a", 1, i) for i in (3, 1, 2)], "a string, b int, c int").repartition(3)
    assert [lookup.rows(tied, limit=1, offset=i)[1].head()["c"] for i in range(3)] == [1, 2, 3]
    with pytest.raises(ValueError):
        lookup.rows(df, filters={"nope": "1"})
    index = spark.createDataFrame([("nj.bet365.com", "licensees", "US-NJ"), ("www.bet365.com", "blocklist", "CH"), ("notbet365.com", "blocklist", "PL")], "host string, kind string, jurisdiction string")
    row = lookup.check_domain(index, "https://www.BET365.com/").head()
    assert (row["licensed_in"], row["blocked_in"], row["n_exact"], row["n_subdomain"]) == (["US-NJ"], ["CH"], 1, 1)
    with pytest.raises(ValueError):
        lookup.check_domain(index, "not a domain")


def test_csv_reader(spark, tmp_path):
    files = {"ok": "﻿A, B\r\n 1 ,x\r\n\r\n2,\r\n", "ragged": "A,B\n1,2,3\n4,5\n", "other": "A,C\n1,2\n"}
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    rows, problems = readers.read_csv_strict(spark, str(tmp_path), ["a", "b"], ["A", "B"])
    assert sorted((r["a"], r["b"] or "") for r in rows.collect()) == [("1", "x"), ("2", ""), ("4", "5")]
    assert {r["file"].rsplit("/", 1)[1]: r["problem"] for r in problems.collect()} == {"ragged.csv": "RAGGED_ROWS:1", "other.csv": "HEADER_MISMATCH"}
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "title.csv").write_text("Register of things\nA,B\n1,2\n")
    assert [tuple(r) for r in readers.read_csv_strict(spark, str(tmp_path / "t"), ["a", "b"], ["A", "B"], skip_lines=1)[0].collect()] == [("1", "2")]


def test_json_blobs_and_manifests(spark, tmp_path):
    (tmp_path / "APLUS.json").write_text(json.dumps({"data": [{"id": 1}, {"id": 2}]}))
    (tmp_path / "BPLUS.json").write_text(json.dumps({"data": {"id": 1}}))
    from pyspark.sql.types import StructType

    rows, problems = readers.read_json_records(spark, str(tmp_path), StructType.fromDDL("id long"))
    assert sorted((r["class"], r["id"]) for r in rows.collect()) == [("APLUS", 1), ("APLUS", 2)] and [r["problem"] for r in problems.collect()] == ["UNEXPECTED_JSON"]
    run = tmp_path / "blobs" / "gb" / "2024-01-02" / "r1"
    run.mkdir(parents=True)
    (run / "main.CSV").write_bytes(b"abc")
    (run / "manifest.json").write_text(json.dumps({"run_id": "r1", "slug": "gb", "complete": True, "parts": [{"name": "main", "url": None, "kind": "csv", "expected": True, "problems": [], "digest": "d"}], "tables": {"t": {"rows": 3, "baseline_rows": 3, "problems": [], "warnings": []}}}))
    blob = readers.read_blobs(spark, str(tmp_path / "blobs")).filter("part = 'main'").head()
    assert (blob["slug"], blob["run_date"], blob["run_id"], blob["kind"], blob["digest"]) == ("gb", dt.date(2024, 1, 2), "r1", "csv", hashlib.sha256(b"abc").hexdigest())
    runs, parts, tables = readers.read_manifests(spark, str(tmp_path / "blobs"))
    assert runs.head()["slug"] == "gb" and parts.head()["name"] == "main" and tables.head()["rows"] == 3


def test_history_versions_are_not_written_over(spark, tmp_path):
    h = spark.createDataFrame([("h", None), ("g", 2)], "row_hash string, removed_snapshot_id long")
    readers.write_history(h, str(tmp_path / "h"), 1)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        readers.write_history(h, str(tmp_path / "h"), 1)


def test_tables_in_pages(spark):
    page = "<table><tr><th>A</th><th>B</th></tr><tr><td>1<td><table><tr><td>in</td></tr></table>x</table>"
    df = spark.createDataFrame([(1, page), (2, "<p>"), (3, "<table><tr><td>Z</td></tr></table>")], "k int, html string")
    rows, problems = extract.html_tables(df, ["A", "B"], "k")
    assert [(r["A"], r["B"]) for r in rows.collect()] == [("1", "x")]
    assert {(r["k"], r["problem"]) for r in problems.collect()} == {(2, "NO_TABLE"), (3, "HEADER_MISMATCH")}


def test_a_page_is_judged_by_itself(spark):
    """Also where a key is null or repeated."""
    good, other = "<table><tr><td>A</td></tr><tr><td>1</td></tr></table>", "<table><tr><td>B</td></tr><tr><td>2</td></tr></table>"
    df = spark.createDataFrame([(None, good), (5, good), (5, other), (6, None), (7, other + good)], "k int, html string")
    rows, problems = extract.html_tables(df, ["A"], "k")
    assert sorted((r["k"] or 0, r["table_no"], r["row_no"], r["A"]) for r in rows.collect()) == [(0, 0, 1, "1"), (5, 0, 1, "1"), (7, 1, 1, "1")]
    assert sorted(map(tuple, problems.collect())) == [(5, "HEADER_MISMATCH"), (6, "NO_TABLE")]


@pytest.mark.parametrize("query", ["table_cells", "table_problems", "key_values"])
def test_pages_are_read_once_by_all_tasks(spark, sf_dir, query):
    """The pages made of one small file are dealt before they are read, and none is read a second time to be joined."""
    from snaptrail.plans import file_queries

    plan = file_queries.QUERIES[query][0](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "REPARTITION_BY_NUM" in plan[plan.index("MapInArrow") :]


def test_urls(spark):
    base = "https://x.org/a/b?c"
    cases = {"http://y.de/z": "http://y.de/z", "//y.de/z": "https://y.de/z", "/r": "https://x.org/r", "f.csv": "https://x.org/a/f.csv", "?p=1": "https://x.org/a/b?p=1", "#t": "https://x.org/a/b?c#t"}
    assert one(spark, lambda c: extract.resolve_url(c, F.lit(base)), list(cases)) == list(cases.values())
    assert one(spark, lambda c: extract.part_name(c, "register-"), ["https://x/y/Register-Names.csv?v=1"]) == ["names"]


def test_fill_left(spark):
    df = spark.createDataFrame([(["a", "", None, "b", ""],)], "c array<string>")
    assert df.select(extract.fill_left(F.col("c")).alias("o")).head()["o"] == ["a", "a", "a", "b", "b"]


def test_search_ranks_every_match_without_one_task(spark, monkeypatch):
    from snaptrail.plans import log_queries

    n = 1_000_020
    many = spark.range(n).select(F.concat(F.lit("ring "), F.col("id") % 70_000).alias("text"), *[F.lit(c).alias(c) for c in ("p_partkey", "page_id", "doc_id", "lang", "conv_id", "turn")])
    few = many.limit(0).select("*", F.col("text").alias("p_name"), F.col("text").alias("url"))
    monkeypatch.setattr(log_queries.st, "table", lambda spark, sf_dir, name: many if name == "documents" else few)
    assert [tuple(r) for r in log_queries.searched(spark, "").select("table", "total", "shown").collect()] == [("documents", n, n)]
    tables = {"a": spark.createDataFrame([(f"ring {i % 7}",) for i in range(40)], "x string"), "b": spark.createDataFrame([("Ring",), ("no",)], "x string")}
    rows = sorted(json.dumps({"x": f"ring {i % 7}"}, separators=(",", ":")) for i in range(40))
    want = [("a", 40, k + 1, r) for k, r in enumerate(rows)] + [("b", 1, 1, '{"x":"Ring"}')]
    for limit in (None, 3, 2000):
        assert sorted(tuple(r) for r in lookup.search(tables, "ring", limit).collect()) == [w for w in want if limit is None or w[2] <= limit]


@pytest.mark.parametrize("width", [1, 2])
def test_unknown_values_fill_the_message(spark, width):
    values = [chr(0x4E00 + i) * width for i in range(120)]
    spec = sp.TableSpec("t", (sp.Column("c", "text"),), known_values={"c": ("ok",)})
    out = validate.check_tables(spark.createDataFrame([(1, v) for v in values], "run long, c string"), spec, ["run"]).head()
    assert out["warnings"] == ["UNKNOWN_VALUE:c:" + "|".join(values)[:200]]


def test_runs_without_rows_and_absent_tables_are_judged(spark):
    spec = sp.TableSpec("t", (sp.Column("c", "text", True),), min_rows=1)
    rows = spark.createDataFrame([(1, "a")], "run_id long, c string")
    runs = spark.createDataFrame([(1,), (2,)], "run_id long")
    out = {r["run_id"]: r for r in validate.check_tables(rows, spec, ["run_id"], runs=runs).collect()}
    assert out[1]["problems"] == [] and (out[2]["n"], out[2]["problems"]) == (0, ["NO_ROWS:0<1"])
    parts = spark.createDataFrame([(i, "p", 0, True, None) for i in (1, 2, 3)], "run_id long, part string, ordinal int, expected boolean, problem string")
    tables = validate.check_tables(rows, spec, ["run_id"], runs=runs).select("run_id", F.lit("t").alias("table"), "n", "problems")
    declared = spark.createDataFrame([(i, "t") for i in (1, 2, 3)], "run_id long, table string")
    verdicts = {r["run_id"]: (r["complete"], r["reason"], r["record_count"]) for r in validate.run_verdict(parts, tables, declared).collect()}
    assert verdicts == {1: (True, None, 1), 2: (False, "INVALID t:NO_ROWS:0<1", None), 3: (False, "INVALID t:NO_TABLE", None)}


def test_gate_looks_back_a_bounded_number_of_runs(spark):
    rows = [("r", "t", 1, 100, True, False)] + [("r", "t", 1 + i, None, False, False) for i in range(1, 15)] + [("r", "t", 16, 10, True, False)]
    counts = spark.createDataFrame(rows, "register string, table string, run_id long, n long, clean boolean, accept boolean")
    last = lambda k: validate.count_delta_gate(counts, look_back=k).filter("run_id = 16").head()
    assert (last(14)["baseline"], last(14)["held"]) == (None, False) and (last(15)["baseline"], last(15)["held"]) == (100, True)


def test_late_snapshot_changes_nothing(spark):
    marks = {m: None for m in hist.MARKS}
    empty = spark.createDataFrame([], "row_hash string, v int, " + ", ".join(f"{m} {'long' if m.endswith('_id') else 'timestamp_ntz'}" for m in marks))
    at = lambda s: F.lit(dt.datetime(2024, 1, s)).cast("timestamp_ntz")
    rows = lambda *h: spark.createDataFrame([(x, 1) for x in h], "row_hash string, v int")
    one = hist.apply_snapshot(empty, rows("a", "b"), F.lit(1).cast("long"), at(1))
    three = hist.apply_snapshot(one, rows("a"), F.lit(3).cast("long"), at(3))
    late = hist.apply_snapshot(three, rows("a", "c"), F.lit(2).cast("long"), at(2))
    assert sorted(map(str, late.collect())) == sorted(map(str, three.collect())) and late.count() == 2
    # an empty snapshot counts as applied too
    four = hist.apply_snapshot(three, rows("a").filter("false"), F.lit(4).cast("long"), at(4))
    assert hist.apply_snapshot(four, rows("d"), F.lit(4).cast("long"), at(4)).filter("removed_snapshot_id IS NULL").count() == 0
