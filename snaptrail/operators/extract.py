"""Semi-structured documents to rows: links, tables, headings, labels, matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StringType

from snaptrail.operators import scans
from snaptrail.functions.scalars import split_list, strip, to_date

MOST_PAGES = 100


def resolve_url(link: Column, base: Column) -> Column:
    """A link as an absolute address."""
    scheme, origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)?", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", ""))
    whole = F.regexp_replace(base, "#.*$", "")
    return (
        F.when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("#"), F.concat(whole, link)).when(link.startswith("?"), F.concat(origin, F.when(path == "", "/").otherwise(path), link)).otherwise(F.concat(origin, folder, link))
    )


def extract_links(docs: DataFrame, pattern: str, key: str, html: str = "html", base: str = "url") -> DataFrame:
    """(key, pos, link, url): what the pattern's first group finds, in page order."""
    found = docs.select(key, base, F.posexplode(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))).alias("pos", "link"))
    return found.select(key, "pos", "link", resolve_url(F.col("link"), F.col(base)).alias("url"))


def part_name(url: Column, prefix: str = "") -> Column:
    """The last path segment without query, ending and prefix, in lower case."""
    last = F.lower(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]*)/?$", 1))
    return F.regexp_replace(F.regexp_replace(last, r"\.csv$", ""), f"^{prefix}", "")


def first_links(links: DataFrame, key: str, name: Column) -> DataFrame:
    """(key, part, url): the first link of each part name wins."""
    return links.withColumn("part", name).groupBy(key, "part").agg(F.min_by("url", "pos").alias("url"))


def newest_link(links: DataFrame, key: str, dated: list[Column]) -> DataFrame:
    """(key, url): the link whose keys (date first) are greatest; links without a date don't count."""
    return links.filter(dated[0].isNotNull()).groupBy(key).agg(F.max_by("url", F.struct(*dated, F.col("pos"))).alias("url"))


def reconcile_parts(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(part, url, expected, problem): what was expected but isn't listed, and what is listed but wasn't expected."""
    e, f = expected.select("part", F.lit(True).alias("__e")), found.select("part", "url").withColumn("__f", F.lit(True))
    j = e.join(f, "part", "full_outer")
    return j.select("part", "url", F.coalesce("__e", F.lit(False)).alias("expected"), F.when(F.col("__f").isNull(), "NOT_LISTED").alias("problem"))


def expand_pages(docs: DataFrame, key: str, html: str = "html", base: str = "url") -> DataFrame:
    """(key, page, page_url): addresses of pages 0 to the greatest ``page=n`` of a document, 100 at most (a crawl bound)."""
    numbers = F.transform(F.regexp_extract_all(html, F.lit(r"[?&](?:amp;)?page=([0-9]{1,9})"), F.lit(1)), lambda x: x.cast("int"))
    last = F.least(F.coalesce(F.array_max(numbers), F.lit(0)), F.lit(MOST_PAGES))
    stem = F.regexp_replace(base, r"[?#].*$", "")
    return docs.select(key, stem.alias("stem"), F.explode(F.sequence(F.lit(0), last)).alias("page")).select(key, "page", F.concat("stem", F.lit("?page="), F.col("page")).alias("page_url"))


class _Tables(HTMLParser):
    """Cells of all tables: (table number, row number, cells). A nested table is a table of its own."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, int, list[str]]] = []
        self.stack: list[dict] = []
        self.count = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.stack.append({"no": self.count, "row": 0, "cells": None, "text": None})
            self.count += 1
        elif self.stack:
            t = self.stack[-1]
            if tag == "tr":
                self.end_row(t)
                t["cells"] = []
            elif tag in ("td", "th"):
                self.end_cell(t)
                t["cells"] = [] if t["cells"] is None else t["cells"]
                t["text"] = []
            elif tag == "br" and t["text"] is not None:
                t["text"].append(" ")

    def handle_endtag(self, tag: str) -> None:
        if not self.stack:
            return
        t = self.stack[-1]
        if tag in ("td", "th"):
            self.end_cell(t)
        elif tag == "tr":
            self.end_row(t)
        elif tag == "table":
            self.end_row(t)
            self.stack.pop()

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1]["text"] is not None:
            self.stack[-1]["text"].append(data)

    def end_cell(self, t: dict) -> None:
        if t["text"] is not None:
            t["cells"].append(" ".join("".join(t["text"]).split()))
            t["text"] = None

    def end_row(self, t: dict) -> None:
        self.end_cell(t)
        if t["cells"] is not None and any(t["cells"]):
            self.rows.append((t["no"], t["row"], t["cells"]))
            t["row"] += 1
        t["cells"] = None

    def close(self) -> None:
        super().close()
        while self.stack:
            self.end_row(self.stack.pop())


def _rows_of(page: str | None) -> list[tuple[int, int, list[str]]]:
    parser = _Tables()
    parser.feed(page or "")
    parser.close()
    return parser.rows


def _each_page(docs: DataFrame, key: str, html: str, found: Callable[[str | None], list[tuple]], columns: str) -> DataFrame:
    """(key, columns...): what is found in each page, read once."""
    schema = T.StructType([docs.schema[key], *T.StructType.fromDDL(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32() if f.dataType == T.IntegerType() else pa.list_(pa.string()) if isinstance(f.dataType, T.ArrayType) else pa.string() for f in schema.fields[1:]]
        for batch in batches:
            places, out = [], []
            for i, page in enumerate(batch.column(1).to_pylist()):
                rows = found(page)
                places += [i] * len(rows)
                out += rows
            keys = batch.column(0).take(pa.array(places, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *[pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]], schema.names)

    return docs.select(key, html).mapInArrow(run, schema)


def table_rows(docs: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, table_no, row_no, cells) of every non-empty table row; a document at a time."""
    return _each_page(docs, key, html, _rows_of, "table_no int, row_no int, cells array<string>")


def html_tables(docs: DataFrame, expected: list[str], key: str, html: str = "html") -> tuple[DataFrame, DataFrame]:
    """(rows, problems): rows below a first row equal to the header; NO_TABLE or HEADER_MISMATCH otherwise.

    A page is judged where it is read, once for either result; nothing is shuffled.
    """

    def below_header(page: str | None) -> list[tuple]:
        rows = _rows_of(page)
        good = {table for table, row, cells in rows if row == 0 and cells == expected}
        return [r for r in rows if r[1] > 0 and r[0] in good]

    def problem(page: str | None) -> list[tuple]:
        firsts = [cells for _, row, cells in _rows_of(page) if row == 0]
        return [] if expected in firsts else [("HEADER_MISMATCH" if firsts else "NO_TABLE",)]

    good = _each_page(docs, key, html, below_header, "table_no int, row_no int, cells array<string>")
    rows = good.select(key, "table_no", "row_no", *[strip(F.get("cells", i)).alias(e) for i, e in enumerate(expected)])
    return rows, _each_page(docs, key, html, problem, "problem string")


def kv_tables(rows: DataFrame, key: str, wanted: str) -> DataFrame:
    """(key, table_no, record): two-cell rows as a map (the last of equal keys wins), of tables that have the wanted key."""
    pairs = rows.filter(F.size("cells") == 2).select(key, "table_no", "row_no", F.get("cells", 0).alias("k"), F.get("cells", 1).alias("v"))
    last = pairs.groupBy(key, "table_no", "k").agg(F.max_by("v", "row_no").alias("v"))
    return last.groupBy(key, "table_no").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("record")).filter(F.map_contains_key("record", wanted))


def carry_heading(rows: DataFrame, doc: str, pos: str, is_heading: Column, value: Column, once: bool = False) -> DataFrame:
    """The rows between headings with ``heading``: the last heading's value above them.

    once: a heading serves the first row below it only, and an empty heading clears the one before.
    """
    marked = scans.dealt(rows.withColumns({"__is": is_heading, "__value": value}), [doc], [pos])
    w = scans.inside([doc], [pos])
    if not once:
        shown = F.when(F.col("__is"), F.col("__value"))
        told = scans.carried(marked, [doc], {"__last": scans.last_of([pos], shown)}, [{"__before": lambda earlier: F.last("__last", ignorenulls=True).over(earlier)}])
        return told.withColumn("heading", F.coalesce(F.last(shown, ignorenulls=True).over(w), "__before.value")).filter("NOT __is").select(*rows.columns, "heading")
    # the last row before: a heading serves a row only if it stands right above
    kind = F.struct(F.col("__is").alias("is"), F.when(F.col("__is"), F.nullif(F.col("__value"), F.lit(""))).alias("value"))
    above = Window.partitionBy(doc, scans.PART).orderBy(F.col(pos).asc_nulls_first())
    told = scans.carried(marked, [doc], {"__last": scans.last_of([pos], kind)}, [{"__before": lambda earlier: F.last("__last").over(earlier)}])
    # of the rows before a document's first heading, the first one is told
    valued = told.withColumn("__above", F.coalesce(F.lag(kind).over(above), "__before.value"))
    return valued.filter(~F.col("__is") & (F.col("__above").isNull() | F.col("__above.is"))).withColumn("heading", F.col("__above.value")).select(*rows.columns, "heading")


def fill_left(cells: Column) -> Column:
    """Blank header cells take the label to their left."""
    blank = lambda x: x.isNull() | (x == "")
    folded = F.aggregate(cells, F.array().cast("array<string>"), lambda acc, x: F.concat(acc, F.array(F.when(blank(x), F.try_element_at(acc, F.lit(-1))).otherwise(x))))
    return folded


def explode_list(df: DataFrame, col: str, seps: str = r"[,;\n]| - |\s{2,}") -> DataFrame:
    """One row a non-empty item; rows without items go."""
    return df.withColumn(col, F.explode(split_list(F.col(col), seps)))


def labelled_field(text: Column, labels: list[str]) -> Column:
    """The value behind ``Label:`` up to the line's end; the first label that has one."""
    return F.coalesce(*[strip(F.regexp_extract(text, rf"(?i)(?:^|[\n>])\s*{label}\s*:[ \t]*([^\n<]*)", 1)) for label in labels])


def unpivot_matrix(rows: DataFrame, keys: list[str], labels: DataFrame, marker: str = "●") -> DataFrame:
    """(keys..., labels...): one row for each marked cell; labels: pos and label columns, a row a column of the sheet."""
    cells = rows.select(*keys, F.posexplode("cells").alias("pos", "cell")).filter(F.contains("cell", F.lit(marker)))
    return cells.join(F.broadcast(labels), "pos").drop("pos", "cell")


def merge_repeated_labels(kv: DataFrame, item: str, known: dict[str, str], sep: str = " | ") -> DataFrame:
    """(item, columns...): labels become columns; values of a repeated label are joined in order; others are ignored."""
    joined = lambda label: F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("label") == label, F.struct("pos", "value")))), lambda x: x["value"]), sep), F.lit(""))
    return kv.filter(F.col("label").isin(*known)).groupBy(item).agg(*[joined(label).alias(c) for label, c in known.items()])


def find_header(rows: DataFrame, expected: list[str], doc: str, sheet: str | None = None, within: int = 10) -> tuple[DataFrame, DataFrame]:
    """(rows below the header, problems) of sheets (doc, sheet_no, sheet, row_no, cells): the header is the first equal row
    among a sheet's first ten. NO_SHEET or HEADER_MISMATCH otherwise."""
    head = F.array(*[F.lit(e) for e in expected])
    own = rows if sheet is None else rows.filter(F.col("sheet") == sheet)
    at = own.filter((F.col("row_no") < within) & (F.slice("cells", 1, len(expected)) == head)).groupBy(doc).agg(F.min(F.struct("sheet_no", "row_no")).alias("at"))
    below = own.join(at, doc).filter((F.col("sheet_no") == F.col("at.sheet_no")) & (F.col("row_no") > F.col("at.row_no")))
    found = below.select(doc, "row_no", *[strip(F.get("cells", i)).alias(e) for i, e in enumerate(expected)])
    named = F.max(F.lit(True) if sheet is None else F.col("sheet") == sheet)
    state = rows.groupBy(doc).agg(named.alias("named")).join(at, doc, "left")
    problem = F.when(~F.col("named"), "NO_SHEET").when(F.col("at").isNull(), "HEADER_MISMATCH")
    return found, state.select(doc, problem.alias("problem")).filter("problem IS NOT NULL")


@F.pandas_udf(StringType())
def _decoded(s: pd.Series) -> pd.Series:
    return s.map(unescape, na_action="ignore")


def html_text(c: Column) -> Column:
    """Tags gone, references decoded, white space folded; only text with a reference leaves the JVM."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    decoded = F.coalesce(_decoded(F.when(F.contains(bare, F.lit("&")), bare)), bare)
    return strip(F.regexp_replace(decoded, r"(?U)\s+", " "))


def route_by_keys(records: DataFrame, keys: list[str], record: str = "record") -> tuple[DataFrame, DataFrame]:
    """(records that have any of the keys, the others); a key with a null value is there."""
    has = F.coalesce(F.arrays_overlap(F.map_keys(record), F.array(*[F.lit(k) for k in keys])), F.lit(False))
    return records.filter(has), records.filter(~has)


def regex_listing(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, domain, listed_on) of the lines that are a domain and a dd.mm.yyyy date."""
    pattern = r"^\s*([a-z0-9](?:[a-z0-9.-]*[a-z0-9])?\.[a-z]{2,63})\s+([0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})\s*$"
    lines = docs.select(key, F.explode(F.split(F.lower(text), "\n")).alias("line")).filter(F.col("line").rlike(pattern))
    return lines.select(key, F.regexp_extract("line", pattern, 1).alias("domain"), to_date(F.regexp_extract("line", pattern, 2)).alias("listed_on"))
