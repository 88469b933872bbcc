"""Readers of snapshot files, and writers of histories and exports. Only Spark opens paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snaptrail.functions.scalars import nfc, strip
from snaptrail.operators.cuts import cut

#: files whose headers may be sent to every executor
HEADS = 100_000
BLOB = r".*/([^/]+)/([0-9]{4}-[0-9]{2}-[0-9]{2})/([^/]+)/([^/]+)\.([^./]+)$"


def text_of(content: Column) -> Column:
    """Bytes as text: UTF-8 (a byte order mark goes), else Latin-1."""
    utf8 = F.is_valid_utf8(content.cast("string"))
    return F.regexp_replace(F.when(utf8, F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1")), "^\\x{FEFF}", "")


def read_csv_strict(spark: SparkSession, paths: str | list[str], columns: list[str], expected: list[str], skip_lines: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows, problems): rows of files whose header is exactly the expected one; cells cleaned, empty ones null.

    problems: file, problem (HEADER_MISMATCH, or RAGGED_ROWS:n for rows of another width; blank rows don't count).
    """
    names = [f"_{i}" for i in range(len(columns))]
    schema = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField("__bad", T.StringType())])
    raw = spark.read.csv(paths, schema=schema, header=False, multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE", columnNameOfCorruptRecord="__bad", encoding="UTF-8", escape='"')
    # a file is read by one task, so positions in it are in order
    located = raw.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos"), *names, "__bad")
    # files are read for their headers once, and once for their rows
    return checked_rows(located, columns, expected, cut(heads_of(located, columns, expected, skip_lines)))


def filled_rows(located: DataFrame, columns: list[str]) -> DataFrame:
    """Parsed records (file, pos, which orders the records of a file, ``_0``, ``_1``, ... and ``__bad``) with cleaned cells; blank rows go."""
    names = [f"_{i}" for i in range(len(columns))]
    cells = [strip(F.regexp_replace(F.col(n), "^\\x{FEFF}", "") if i == 0 else F.col(n)) for i, n in enumerate(names)]
    row = F.struct(F.col("__bad").isNotNull().alias("ragged"), *[c.alias(n) for c, n in zip(cells, names, strict=True)])
    # as a generated row, cells are cleaned once, not again in every filter on them
    cleaned = located.select("file", "pos", F.inline(F.array(row)))
    return cleaned.filter(F.col("ragged") | F.coalesce(*names).isNotNull())


def heads_of(located: DataFrame, columns: list[str], expected: list[str], skip_lines: int) -> DataFrame:
    """(file, head_pos, ok): the header of each file, and whether it is the expected one."""
    names, lead = [f"_{i}" for i in range(len(columns))], filled_rows(located, columns)
    # the header is the first row behind those skipped; each task keeps its own first rows of a file before they meet
    firsts = F.get(F.array_sort(F.collect_list(F.struct("pos", "ragged", *names))), F.lit(skip_lines)) if skip_lines else F.min(F.struct("pos", "ragged", *names))
    if skip_lines:
        lead = lead.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("pos"))).filter(F.col("n") <= skip_lines + 1)
    heads = lead.groupBy("file").agg(firsts.alias("head"))
    is_expected = F.array(*[F.col(f"head.{n}") for n in names]) == F.array(*[F.lit(e) for e in expected])
    return heads.select("file", F.col("head.pos").alias("head_pos"), (F.coalesce(is_expected, F.lit(False)) & ~F.coalesce("head.ragged", F.lit(True))).alias("ok"))


def checked_rows(located: DataFrame, columns: list[str], expected: list[str], heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, problems) of parsed records (see ``filled_rows``) and the files' headers (see ``heads_of``; kept somewhere)."""
    names = [f"_{i}" for i in range(len(columns))]
    body = filled_rows(located, columns).join(F.broadcast(heads) if heads.limit(HEADS + 1).count() <= HEADS else heads, "file").filter("ok AND pos > head_pos")
    # Spark reads the broken-row column only together with another one
    ragged = body.filter(F.col("ragged") & (F.length(F.concat_ws("", *names)) >= 0)).groupBy("file").agg(F.concat(F.lit("RAGGED_ROWS:"), F.count("*")).alias("problem"))
    problems = heads.filter("NOT ok").select("file", F.lit("HEADER_MISMATCH").alias("problem")).unionByName(ragged)
    return body.filter("NOT ragged").select(*[nfc(F.col(n)).alias(c) for n, c in zip(names, columns, strict=True)]), problems


def read_json_records(spark: SparkSession, paths: str | list[str], record: T.StructType, array_field: str = "data") -> tuple[DataFrame, DataFrame]:
    """(records with their file's class name, problems): one list of records a file; anything else is UNEXPECTED_JSON."""
    schema = T.StructType([T.StructField(array_field, T.ArrayType(record)), T.StructField("__bad", T.StringType())])
    files = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), text_of(F.col("content")).alias("body"))
    parsed = files.withColumn("j", F.from_json("body", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    name = F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1)
    good = F.col(f"j.{array_field}").isNotNull()
    records = parsed.filter(good).select(name.alias("class"), F.inline(F.col(f"j.{array_field}")))
    return records, parsed.filter(~good).select("file", F.lit("UNEXPECTED_JSON").alias("problem"))


def read_xml_entries(spark: SparkSession, path: str, row_tag: str, fields: dict[str, str]) -> DataFrame:
    """One row an element; fields maps attribute (``_name``) or child names to columns. Files split where Spark can."""
    schema = T.StructType([T.StructField(source, T.StringType()) for source in fields])
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    return rows.select(*[strip(F.col(f"`{source}`")).alias(target) for source, target in fields.items()])


def read_text_lines(spark: SparkSession, paths: str | list[str], comment: str = "#") -> DataFrame:
    """(file, line): stripped lines that are neither blank nor comments."""
    files = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), F.explode(F.split(text_of(F.col("content")), r"\r\n|\r|\n")).alias("line"))
    return files.select("file", strip(F.col("line")).alias("line")).filter(F.col("line").isNotNull() & ~F.col("line").startswith(comment))


def read_blobs(spark: SparkSession, root: str) -> DataFrame:
    """Parts stored as root/slug/date/run/part.ext, with the SHA-256 of their bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    part = lambda i: F.regexp_extract("path", BLOB, i)
    known = files.filter(F.col("path").rlike(BLOB))
    return known.select(part(1).alias("slug"), part(2).cast("date").alias("run_date"), part(3).alias("run_id"), part(4).alias("part"), F.lower(part(5)).alias("kind"), "content", F.sha2("content", 256).alias("digest"))


def write_text_blobs(texts: DataFrame, path: str) -> None:
    """A file a row. Files are written by as many tasks as there are cores, and put in their place by these, not by the driver."""
    dealt = texts.repartition(max(2, texts.sparkSession.sparkContext.defaultParallelism))
    dealt.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)


MANIFEST = (
    "run_id string, slug string, complete boolean, parts array<struct<name:string,url:string,kind:string,expected:boolean,problems:array<string>,digest:string>>, "
    "tables map<string,struct<rows:long,baseline_rows:long,problems:array<string>,warnings:array<string>>>"
)


def read_manifests(spark: SparkSession, root: str, name: str = "manifest.json") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, run_parts, run_tables) of the manifests below a folder; ``name``: their file name or a glob."""
    m = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).json(root, schema=MANIFEST, multiLine=True)
    parts = m.select("run_id", F.posexplode("parts").alias("ordinal", "p")).select("run_id", "ordinal", "p.*")
    tables = m.select("run_id", F.explode("tables").alias("table", "t")).select("run_id", "table", "t.*")
    return m.select("run_id", "slug", "complete"), parts, tables


def write_history(history: DataFrame, root: str, version: int) -> str:
    """A new version of a history, current rows apart from closed ones; an existing version is never written over."""
    path = f"{root}/version={version:010d}"
    history.withColumn("is_current", F.col("removed_snapshot_id").isNull()).write.partitionBy("is_current").mode("errorifexists").parquet(path)
    return path


def write_history_table(history: DataFrame, name: str, path: str, buckets: int, key: tuple[str, ...] = ("row_hash",)) -> None:
    """A version of a history as a table in buckets of ``key``, its files below ``path``; an existing table is never written over.

    Applying a snapshot to such a table shuffles the snapshot's rows only: ``apply_snapshot`` on ``spark.table`` for buckets of
    ``row_hash``, ``apply_snapshots`` for buckets of columns of its key. Rows without hashes take a fraction of the room; all
    copies of a row lie in its bucket then. The same number of buckets must be kept from version to version; a bucket should
    fit a task. With as many buckets as shuffles have partitions, rows counted by ``key`` come in buckets already.
    """
    stored = history.write.bucketBy(buckets, *key).sortBy(*key).option("path", path).option("compression", "zstd")
    stored.mode("errorifexists").saveAsTable(name)


def write_snapshot_log(log: DataFrame, path: str) -> None:
    """Appends run rows; appending the version's row is what publishes a history."""
    log.write.mode("append").parquet(path)


def read_history(spark: SparkSession, root: str, log: str) -> DataFrame:
    """The newest published version; a version without a log row was never committed."""
    newest = spark.read.parquet(log).agg(F.max("version")).head()[0]
    return spark.read.parquet(f"{root}/version={newest:010d}").drop("is_current")


def write_evidence(parts: DataFrame, path: str) -> None:
    """Raw bytes, once."""
    parts.write.mode("errorifexists").parquet(path)


def export_rows(df: DataFrame, fmt: str = "csv") -> DataFrame:
    """(line): rows as CSV or JSON text; null is empty, lists are joined by semicolons."""
    flat = df.select(*[(F.concat_ws(";", c) if t.startswith("array") else F.col(c)).alias(c) for c, t in df.dtypes])
    if fmt == "json":
        return flat.select(F.to_json(F.struct(*flat.columns)).alias("line"))
    if fmt != "csv":
        raise ValueError(f"unknown format {fmt!r}")
    return flat.select(F.to_csv(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in flat.columns]), {"emptyValue": "", "quoteAll": "false"}).alias("line"))
