"""Questions over many tables: pages of rows, text search, domains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snaptrail.functions.scalars import contains_ci, host, strip_www
from snaptrail.operators.cuts import cut

MOST_ROWS = 1000


def text_columns(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t in ("string", "array<string>")]


def matches(df: DataFrame, q: str) -> Column:
    """Whether any text or list column holds q, literally and caseless."""
    found = [contains_ci(F.concat_ws(" ", c), q) for c in text_columns(df)]
    return F.coalesce(reduce(lambda a, b: a | b, found), F.lit(False)) if found else F.lit(False)


def rows(view: DataFrame, q: str | None = None, filters: dict[str, str] | None = None, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(total, page): rows whose columns equal the filters' values and that match q, ordered by the first two columns.

    Ties are settled by ``row_hash``, or by all other columns where there is none, so pages neither repeat nor miss a row.
    """
    unknown = sorted(set(filters or {}) - set(view.columns))
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    kinds = dict(view.dtypes)
    for c, v in (filters or {}).items():
        view = view.filter(F.array_contains(c, v) if kinds[c] == "array<string>" else F.col(c).cast("string") == v)
    if q:
        view = view.filter(matches(view, q))
    first, rest = view.columns[:2], view.columns[2:]
    ties = ["row_hash"] if "row_hash" in rest else [c for c in rest if not kinds[c].startswith(("map", "variant"))]
    page = view.orderBy(*[F.col(c).asc_nulls_last() for c in first + ties]).offset(offset).limit(min(limit, MOST_ROWS))
    return view.agg(F.count("*").alias("total")), page


def ranked(found: DataFrame) -> DataFrame:
    """found (table, row) with ``rank``: every row's place in its table. Rows are dealt by ranges of (table, row), so no table meets in one task.

    Equal rows are counted before they are numbered.
    """
    counted = found.groupBy("table", "row").agg(F.count("*").alias("copies"))
    dealt = cut(counted.repartitionByRange("table", "row")).withColumn("part", F.spark_partition_id())
    sums = dealt.groupBy("table", "part").agg(F.sum("copies").alias("inside"))
    before = sums.select("table", "part", (F.sum("inside").over(Window.partitionBy("table").orderBy("part")) - F.col("inside")).alias("before"))
    up_to = F.sum("copies").over(Window.partitionBy("table", "part").orderBy("row")) + F.col("before")
    placed = dealt.join(F.broadcast(before), ["table", "part"]).withColumn("last", up_to)
    return placed.select("table", "row", F.explode(F.sequence(F.col("last") - F.col("copies") + 1, F.col("last"))).alias("rank"))


def search(tables: dict[str, DataFrame], q: str, limit: int | None = 5) -> DataFrame:
    """table, total, rank, row (JSON): every table with a match, its total, and ``limit`` rows (a report), or all.

    One pass over the union of the tables; totals come from an aggregation. Up to ``MOST_ROWS`` rows a table, each task
    keeps its own first rows before they meet; beyond that all rows are ranked by ranges.
    """
    found = reduce(DataFrame.unionByName, [df.filter(matches(df, q)).select(F.lit(name).alias("table"), F.to_json(F.struct(*df.columns)).alias("row")) for name, df in tables.items()])
    totals = found.groupBy("table").agg(F.count("*").alias("total"))
    if limit is None or limit > MOST_ROWS:
        top = ranked(found)
        top = top if limit is None else top.filter(F.col("rank") <= limit)
    else:
        top = found.withColumn("rank", F.row_number().over(Window.partitionBy("table").orderBy("row"))).filter(F.col("rank") <= limit).withColumn("rank", F.col("rank").cast("long"))
    return top.join(F.broadcast(totals), "table").select("table", "total", "rank", "row")


GRAM = 3
#: rows that a block of a search index holds on average; lists of an index hold at most a block's rows
BLOCK_ROWS = 1000
RAREST = 4
#: blocks that are named to the reader, so that it skips the others
NAMED_BLOCKS = 5000


def grams(text: Column) -> Column:
    """The distinct runs of three characters of a text."""
    # characters are split off a fixed number of times, not once a run: a long text costs no more a character than a short one
    chars, n = F.split(text, ""), F.length(text)
    after = lambda k: F.slice(chars, k + 1, F.greatest(n - GRAM + 1, F.lit(0)))
    runs = reduce(lambda x, y: F.zip_with(x, y, lambda c, d: F.concat(c, d)), [after(k) for k in range(GRAM)])
    return F.when(n >= GRAM, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def write_search_index(tables: dict[str, DataFrame], root: str) -> None:
    """Rows in blocks, and for every three characters the places of rows that hold them, below ``root``; one index a history version.

    Rows: table, block, place, row (JSON), texts (lower case). Lists: gram, table, block, places. A block is a share of
    the rows' hashes, so a list never holds more than a block's rows, however common its characters are.
    """
    parts = []
    for name, df in tables.items():
        blocks = max(1, -(-df.count() // BLOCK_ROWS))
        rows = df.select(F.lit(name).alias("table"), F.to_json(F.struct(*df.columns)).alias("row"), F.array(*[F.lower(F.concat_ws(" ", c)) for c in text_columns(df)]).cast("array<string>").alias("texts"))
        parts.append(rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")))
    rows = reduce(DataFrame.unionByName, parts)
    counted = rows.groupBy("table", "block", "row", "texts").agg(F.count("*").alias("copies"))
    place = F.row_number().over(Window.partitionBy("table", "block").orderBy("row"))
    counted.withColumn("place", place).repartitionByRange("table", "block").sortWithinPartitions("table", "block", "place").write.parquet(f"{root}/rows")
    stored = tables[next(iter(tables))].sparkSession.read.parquet(f"{root}/rows")
    each = stored.select("table", "block", "place", F.explode(F.array_distinct(F.flatten(F.transform("texts", grams)))).alias("gram"))
    lists = each.groupBy("gram", "table", "block").agg(F.array_sort(F.collect_list("place")).alias("places"))
    lists.repartitionByRange("gram", "table", "block").sortWithinPartitions("gram", "table", "block").write.parquet(f"{root}/lists")


def found_rows(spark: SparkSession, root: str, q: str) -> DataFrame:
    """(table, row, copies) of the rows that hold q, literally and caseless, by an index; terms under three characters are looked for in all rows."""
    rows, wanted = spark.read.parquet(f"{root}/rows"), q.lower()
    holds = F.exists("texts", lambda t: F.contains(t, F.lit(wanted)))
    if len(wanted) >= GRAM:
        terms = sorted({wanted[i : i + GRAM] for i in range(len(wanted) - GRAM + 1)})
        lists = spark.read.parquet(f"{root}/lists").filter(F.col("gram").isin(terms))
        sizes = {r["gram"]: r["n"] for r in lists.groupBy("gram").agg(F.sum(F.size("places")).alias("n")).collect()}  # one row a run of the term
        rarest = sorted(terms, key=lambda g: sizes.get(g, 0))[:RAREST]
        met = lists.filter(F.col("gram").isin(rarest)).groupBy("table", "block").agg(F.collect_list("places").alias("lists")).filter(F.size("lists") == len(rarest))
        both = F.aggregate("lists", F.element_at("lists", 1), lambda acc, x: F.array_intersect(acc, x))
        places = cut(met.select("table", "block", both.alias("places")).filter(F.size("places") > 0))
        blocks = [r[0] for r in places.select("block").distinct().limit(NAMED_BLOCKS + 1).collect()]
        if len(blocks) <= NAMED_BLOCKS:
            rows = rows.filter(F.col("block").isin(blocks))
        rows = rows.join(places.select("table", "block", F.explode("places").alias("place")), ["table", "block", "place"], "left_semi")
    return rows.filter(holds).select("table", "row", "copies")


def search_index(spark: SparkSession, root: str, q: str, limit: int = 5) -> DataFrame:
    """As ``search``, by an index: table, total, rank, row of every table with a match."""
    found = found_rows(spark, root, q)
    totals = found.groupBy("table").agg(F.sum("copies").alias("total"))
    up_to = F.sum("copies").over(Window.partitionBy("table").orderBy("row"))
    # equal rows are one here; no table needs more of them than rows are asked for
    first = found.withColumn("n", F.row_number().over(Window.partitionBy("table").orderBy("row"))).filter(F.col("n") <= limit).withColumn("last", up_to)
    ranks = first.select("table", "row", F.explode(F.sequence(F.col("last") - F.col("copies") + 1, F.least("last", F.greatest(F.col("last") - F.col("copies") + 1, F.lit(limit))))).alias("rank"))
    return ranks.filter(F.col("rank") <= limit).join(F.broadcast(totals), "table").select("table", "total", "rank", "row")


def domain_rows(index: DataFrame, watch: DataFrame) -> DataFrame:
    """domain, match (exact or subdomain) and all columns of every row whose host is a domain of the list or below one."""
    exploded = index.withColumn("__bare", strip_www(F.col("host"))).withColumn("domain", F.explode(suffixes(F.col("__bare"))))
    asked = watch.select(strip_www(host(F.col("domain"))).alias("domain")).filter("domain IS NOT NULL").distinct()
    match = F.when(F.col("__bare") == F.col("domain"), "exact").otherwise("subdomain")
    return exploded.join(asked, "domain").select("domain", match.alias("match"), *index.columns)


def check_domain(index: DataFrame, domain: str) -> DataFrame:
    """domain, licensed_in, blocked_in, n_exact, n_subdomain for one domain; index: host, kind, jurisdiction."""
    target = index.sparkSession.range(1).select(strip_www(host(F.lit(domain))).alias("t")).head()[0]
    if target is None:
        raise ValueError(f"not a domain: {domain!r}")
    bare = strip_www(F.col("host"))
    exact = bare == target
    hits = index.filter(exact | bare.endswith(f".{target}"))
    return hits.agg(*_answer(exact)).withColumn("domain", F.lit(target))


def _answer(exact: Column) -> list[Column]:
    place = lambda kind: F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.col("jurisdiction"))))
    return [place("licensees").alias("licensed_in"), place("blocklist").alias("blocked_in"), F.count_if(exact).alias("n_exact"), F.count_if(~exact).alias("n_subdomain")]


def suffixes(c: Column) -> Column:
    """A host and its parents of two labels at least: a.b.c gives a.b.c and b.c."""
    labels = F.split(c, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def check_domains(index: DataFrame, watch: DataFrame) -> DataFrame:
    """check_domain for every domain of a list: hosts are exploded to their parents, so the match is an equi-join.

    Hosts are counted by kind and jurisdiction first, so a host in a billion rows is a few rows in the join.
    """
    counted = index.withColumn("bare", strip_www(F.col("host"))).groupBy("bare", "kind", "jurisdiction").count()
    exploded = counted.withColumn("domain", F.explode(suffixes(F.col("bare"))))
    asked = watch.select(strip_www(host(F.col("domain"))).alias("domain")).filter("domain IS NOT NULL").distinct()
    hits = exploded.join(asked, "domain")
    exact, place = F.col("bare") == F.col("domain"), lambda kind: F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.col("jurisdiction"))))
    return hits.groupBy("domain").agg(place("licensees").alias("licensed_in"), place("blocklist").alias("blocked_in"), F.sum(F.when(exact, F.col("count")).otherwise(0)).alias("n_exact"), F.sum(F.when(~exact, F.col("count")).otherwise(0)).alias("n_subdomain"))


def domain_conflicts(index: DataFrame) -> DataFrame:
    """Hosts that are licensed somewhere and blocked somewhere."""
    exact = F.lit(True)
    return index.groupBy(strip_www(F.col("host")).alias("host")).agg(*_answer(exact)[:2]).filter((F.size("licensed_in") > 0) & (F.size("blocked_in") > 0))
