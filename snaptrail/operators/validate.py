"""Checks that a snapshot must pass before it may change the history."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snaptrail.spec import TableSpec

MISSING_TOLERANCE = 0.02
LOOK_BACK = 14
_BOM_AND_SPACE = r"^[\x{EF}\x{BB}\x{BF} \t\r\n]+"


def check_parts(parts: DataFrame) -> DataFrame:
    """parts (kind, content, content_type) with ``problem`` (null if good) and ``transient`` (worth one more try)."""
    head = F.lower(F.regexp_replace(F.decode(F.substring("content", 1, 1024), "iso-8859-1"), _BOM_AND_SPACE, ""))
    whole_blank = F.coalesce(F.octet_length("content"), F.lit(0)) == 0
    blank = whole_blank | (~F.decode("content", "iso-8859-1").rlike(r"[^ \t\r\n\x0b\x0c]"))
    kind = F.lower(F.trim(F.substring_index(F.coalesce("content_type", F.lit("")), ";", 1)))
    markup = head.rlike("^(?:<!doctype|<html|<head|<body)") | (F.contains(F.lower(F.coalesce("content_type", F.lit(""))), F.lit("html")) & head.startswith("<"))
    other = (kind != "") & ~F.contains(kind, F.lit("html")) & ~kind.isin("text/plain", "application/xml", "text/xml")
    problem = F.when(blank, "EMPTY").when((F.col("kind") != "html") & markup, "HTML_BODY").when((F.col("kind") == "html") & other, F.concat(F.lit("CONTENT_TYPE:"), kind))
    return parts.withColumn("problem", problem).withColumn("transient", F.coalesce(F.col("problem").startswith("HTML_BODY") | F.col("problem").startswith("CONTENT_TYPE") | (F.col("problem") == "EMPTY"), F.lit(False)))


def check_tables(rows: DataFrame, spec: TableSpec, by: list[str], baselines: DataFrame | None = None, tolerance: float = 0.10, accept: bool = False, most_values: int = 101, runs: DataFrame | None = None) -> DataFrame:
    """by..., n, problems, warnings of every run's table, from one aggregation.

    runs: by... of every run and table that must be judged; one without rows is counted as 0 rows. Without it only runs
    that have rows are judged.

    baselines: by..., baseline (row count of the last passed version). Unknown values are kept as the first
    ``most_values`` in order: 101 values of one character and what is between them fill the 200 characters that the message shows.
    """
    required = [c.name for c in spec.columns if c.required]
    empty = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    counted = rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(empty(c)).alias(f"__missing_{c}") for c in required])
    if runs is not None:
        grid = runs.select(*by).distinct().join(counted, by, "left")
        counted = grid.select(*by, *[F.coalesce(c, F.lit(0)).alias(c) for c in counted.columns if c not in by])
    for c, known in sorted(spec.known_values.items()):
        value = F.col(c).cast("string")
        odd = rows.filter(~empty(c) & ~value.isin(*sorted(known))).groupBy(*by, value.alias("v")).count()
        ranked = odd.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("v"))).filter(F.col("r") <= most_values)
        listed = ranked.groupBy(*by).agg(F.substring(F.array_join(F.array_sort(F.collect_list("v")), "|"), 1, 200).alias(f"__odd_{c}"))
        counted = counted.join(listed, by, "left")
    counted = counted.join(baselines, by, "left") if baselines is not None else counted.withColumn("baseline", F.lit(None).cast("long"))
    n, b = F.col("n"), F.col("baseline")
    few = n < spec.min_rows
    missing = lambda c: F.concat(F.lit(f"MISSING:{c}:"), F.col(f"__missing_{c}"), F.lit("/"), n)
    many = lambda c: F.col(f"__missing_{c}") / n > MISSING_TOLERANCE
    moved = (b > 0) & (n != b) & (F.abs(n - b) / b > tolerance)
    delta = F.concat(F.lit("COUNT_DELTA:"), b, F.lit("->"), n)
    problems = [F.when(many(c), missing(c)) for c in required] + ([] if accept else [F.when(moved, delta)])
    warnings = [F.when((F.col(f"__missing_{c}") > 0) & ~many(c), missing(c)) for c in required] + ([F.when(moved, delta)] if accept else []) + [F.when(F.col(f"__odd_{c}").isNotNull(), F.concat(F.lit(f"UNKNOWN_VALUE:{c}:"), F.col(f"__odd_{c}"))) for c in sorted(spec.known_values)]
    none = F.array().cast("array<string>")
    return counted.select(
        *by, "n", F.when(few, F.array(F.concat(F.lit("NO_ROWS:"), n, F.lit(f"<{spec.min_rows}")))).otherwise(F.array_compact(F.array(*problems)) if problems else none).alias("problems"),
        F.when(few, none).otherwise(F.array_compact(F.array(*warnings)) if warnings else none).alias("warnings"),
    )


def next_baseline(n: int | None, baseline: int | None, tolerance: float, accept: bool, clean: bool) -> tuple[int | None, bool]:
    """The baseline after a run, and whether the run was held. n is null for a parse that failed."""
    if n is None:
        return baseline, False
    held = bool(baseline) and n != baseline and abs(n - baseline) / baseline > tolerance and not accept
    return (n if clean and not held else baseline), held


GATE_TYPE = "register string, table string, run_id long, n long, baseline long, held boolean"


def count_delta_gate(counts: DataFrame, tolerance: float = 0.10, look_back: int = LOOK_BACK) -> DataFrame:
    """Replays counts (register, table, run_id, n, clean, accept) in run order; a held move stays held until accepted.

    ``clean``: no other problem of the table. The baseline is the count of the newest passed run among the ``look_back``
    runs before; if none of them passed there is none. The state is one number and its age a table; rows are counts, one
    a run, streamed in order, so a table with many runs is never held in memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, baseline, age = None, None, 0
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if (r.register, r.table) != key:
                    key, baseline, age = (r.register, r.table), None, 0
                before, n = baseline if age < look_back else None, None if pd.isna(r.n) else int(r.n)
                baseline, held = next_baseline(n, before, tolerance, bool(r.accept), bool(r.clean))
                age = 0 if n is not None and bool(r.clean) and not held else age + 1
                out.append((r.register, r.table, r.run_id, n, before, held))
            yield pd.DataFrame(out, columns=["register", "table", "run_id", "n", "baseline", "held"]).astype({"n": "Int64", "baseline": "Int64"})

    ordered = counts.select("register", "table", F.col("run_id").cast("long"), F.col("n").cast("long"), F.coalesce("clean", F.lit(True)).alias("clean"), F.coalesce("accept", F.lit(False)).alias("accept"))
    return ordered.repartition("register", "table").sortWithinPartitions("register", "table", "run_id").mapInPandas(run, GATE_TYPE)


def run_verdict(parts: DataFrame, tables: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """run_id, complete, reason, record_count. parts: run_id, part, ordinal, expected, problem. tables: run_id, table, n, problems.

    declared: run_id, table of every table that a run must have; one that was not judged is a problem of its run.
    """
    if declared is not None:
        found = tables.select("run_id", "table", "n", "problems", F.lit(True).alias("__judged"))
        absent = F.col("__judged").isNull()
        tables = declared.select("run_id", "table").distinct().join(found, ["run_id", "table"], "full_outer")
        tables = tables.select("run_id", "table", F.when(absent, 0).otherwise(F.col("n")).cast("long").alias("n"), F.when(absent, F.array(F.lit("NO_TABLE"))).otherwise(F.col("problems")).alias("problems"))
    bad = F.col("expected") & F.col("problem").isNotNull()
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(bad, F.struct("ordinal", F.concat_ws(":", "part", "problem").alias("m"))))), lambda x: x["m"]), " ")
    p = parts.groupBy("run_id").agg(F.count_if("expected").alias("wanted"), F.count_if(F.col("expected") & F.col("problem").isNull()).alias("good"), listed.alias("bad_parts"))
    invalid = F.when(F.size("problems") > 0, F.struct("table", F.concat(F.col("table"), F.lit(":"), F.array_join("problems", ",")).alias("m")))
    t = tables.groupBy("run_id").agg(F.count("*").alias("n_tables"), F.sum("n").alias("n_rows"), F.array_join(F.transform(F.array_sort(F.collect_list(invalid)), lambda x: x["m"]), " ").alias("bad_tables"))
    j = p.join(t, "run_id", "left").withColumn("bad_tables", F.coalesce("bad_tables", F.lit("")))
    ok = (F.col("wanted") > 0) & (F.col("good") == F.col("wanted")) & (F.coalesce("n_tables", F.lit(0)) > 0) & (F.col("bad_tables") == "")
    reason = (
        F.when(F.col("wanted") == 0, "NO_PARTS")
        .when(F.col("good") < F.col("wanted"), F.concat(F.lit("PAGE_GAP:"), F.col("good"), F.lit("/"), F.col("wanted"), F.lit(" "), F.col("bad_parts")))
        .when(~ok, F.concat(F.lit("INVALID "), F.col("bad_tables")))
    )
    return j.select("run_id", ok.alias("complete"), F.substring(reason, 1, 500).alias("reason"), F.when(ok, F.col("n_rows")).alias("record_count"))


def carry_forward(parts: DataFrame, source: str = "source") -> DataFrame:
    """Parts (source, part, run_no, not_modified, digest, content, problem) with what a 304 part takes from before.

    run_no numbers all runs of a source without gaps, so a missing run breaks the chain. Adds carried_digest,
    carried_content and carried_problem.
    """
    order = Window.partitionBy(source, "part").orderBy("run_no")
    # a chain of 304 runs begins at the last real answer; any gap, bad answer or damaged copy before it breaks the chain
    begins = ~F.col("not_modified") | (F.col("run_no") - F.lag("run_no").over(order) != 1) | F.lag("run_no").over(order).isNull()
    good = ~F.col("not_modified") & F.col("problem").isNull() & F.col("content").isNotNull() & (F.sha2("content", 256) == F.col("digest"))
    marked = parts.withColumn("__begins", begins).withColumn("__good", good)
    chained = marked.withColumn("__chain", F.sum(F.col("__begins").cast("int")).over(order))
    in_chain = Window.partitionBy(source, "part", "__chain").orderBy("run_no")
    first = F.first(F.struct("__good", "digest", "content")).over(in_chain)
    out = chained.withColumn("__first", first)
    ok = F.col("not_modified") & F.col("__first.__good")
    return out.select(
        *parts.columns, F.when(F.col("not_modified"), F.when(ok, F.col("__first.digest"))).otherwise(F.col("digest")).alias("carried_digest"),
        F.when(F.col("not_modified"), F.when(ok, F.col("__first.content"))).otherwise(F.col("content")).alias("carried_content"), F.when(F.col("not_modified") & ~ok, "NOT_MODIFIED_WITHOUT_PRIOR").otherwise(F.col("problem")).alias("carried_problem"),
    )


def audit_snapshots(log: DataFrame, now: Column) -> DataFrame:
    """Log rows that break a rule, with the names of the rules."""
    done = F.col("complete")
    rules = {
        "complete_without_count": done & F.col("record_count").isNull(), "complete_with_page_gap": done & (F.coalesce("pages_ok", F.lit(-1)) != F.coalesce("pages_expected", F.lit(-2))),
        "incomplete_without_reason": ~done & F.col("reason").isNull(), "in_future": F.col("fetched_at") > now, "negative_pages": (F.col("pages_ok") < 0) | (F.col("pages_expected") < 0),
    }
    return log.withColumn("broken", F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))).filter(F.size("broken") > 0)


def last_bad_status(fetches: DataFrame, by: list[str], order: str = "ordinal", status: str = "status_code") -> DataFrame:
    """by..., http_status: the last status that is not 200 or 304, else 200."""
    bad = ~F.col(status).isin(200, 304)
    return fetches.groupBy(*by).agg(F.coalesce(F.max_by(F.when(bad, F.col(status)), F.when(bad, F.col(order))), F.lit(200)).alias("http_status"))


