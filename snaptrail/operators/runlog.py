"""Analytics over the log of runs. A run is good if it is complete or only waits to be parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snaptrail.functions.scalars import host
from snaptrail.operators import scans

WAITING = "AWAITING_PARSE"


def is_good() -> Column:
    return F.col("complete") | F.coalesce(F.col("reason") == WAITING, F.lit(False))


def newest() -> Column:
    return F.struct("fetched_at", "id")


def upsert_sources(existing: DataFrame, incoming: DataFrame, key: str = "slug") -> DataFrame:
    """Incoming values win, null or not, for the columns that come in; other columns are kept."""
    e, i = existing.alias("e"), incoming.withColumn("__in", F.lit(True)).alias("i")
    new = set(incoming.columns)
    joined = e.join(i, F.col(f"e.{key}") == F.col(f"i.{key}"), "full_outer")
    pick = lambda c: F.coalesce(f"e.{c}", f"i.{c}") if c == key else F.when(F.col("i.__in"), F.col(f"i.{c}")).otherwise(F.col(f"e.{c}")) if c in new else F.col(f"e.{c}")
    return joined.select(*[pick(c).alias(c) for c in existing.columns])


def latest_snapshot(log: DataFrame, complete_only: bool = False) -> DataFrame:
    rows = log.filter("complete") if complete_only else log
    return rows.groupBy("source").agg(F.max_by(F.struct(*[c for c in log.columns if c != "source"]), newest()).alias("s")).select("source", "s.*")


def due_sources(sources: DataFrame, log: DataFrame, now: Column, within_h: int = 20) -> DataFrame:
    """Sources without a good run in the last hours; failed runs don't count."""
    fresh = log.filter(is_good() & (F.col("fetched_at") > now - F.make_interval(hours=F.lit(within_h)))).select("source").distinct()
    return sources.join(fresh, "source", "left_anti")


def recent_snapshots(log: DataFrame, n: int = 14) -> DataFrame:
    """The newest runs of each source; each task keeps n a source before the shuffle."""
    order = Window.partitionBy("source").orderBy(F.col("fetched_at").desc(), F.col("id").desc())
    return log.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def source_health(sources: DataFrame, log: DataFrame, now: Column) -> DataFrame:
    """Enabled sources with last fetch, last good fetch, the newest run's reason and failures in seven days."""
    failed = ~is_good() & (F.col("fetched_at") > now - F.make_interval(days=F.lit(7)))
    per = log.groupBy("source").agg(F.max("fetched_at").alias("last_fetch"), F.max(F.when(is_good(), F.col("fetched_at"))).alias("last_good"), F.max_by("reason", newest()).alias("last_reason"), F.count_if(failed).alias("failed_7d"))
    return sources.filter("enabled").join(per, "source", "left").withColumn("failed_7d", F.coalesce("failed_7d", F.lit(0)))


def staleness(health: DataFrame, now: Column, stale_after_h: float = 26) -> DataFrame:
    hours = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_good").cast("timestamp"))) / F.lit(3.6e9)
    return health.withColumn("hours_since_good", F.round(hours, 1)).withColumn("stale", F.coalesce(hours > stale_after_h, F.lit(True)))


def validators(fetches: DataFrame) -> DataFrame:
    """source, url, etag, last_modified from each source's newest run; only answers 200 or 304 that carry one."""
    last = fetches.groupBy("source").agg(F.max(newest())["id"].alias("id"))
    kept = fetches.join(last, ["source", "id"], "left_semi").filter(F.col("status_code").isin(200, 304) & (F.col("etag").isNotNull() | F.col("last_modified").isNotNull()))
    return kept.groupBy("source", "url").agg(F.max_by(F.struct("etag", "last_modified"), "attempt_no").alias("v")).select("source", "url", "v.*")


def previous_pages_ok(log: DataFrame) -> DataFrame:
    return log.filter(is_good()).groupBy("source").agg(F.max_by("pages_ok", newest()).alias("pages_ok"))


def fetch_stats(fetches: DataFrame) -> DataFrame:
    """Attempts, retries, refusals, waits and bytes by host."""
    return fetches.groupBy(host(F.col("url")).alias("host")).agg(
        F.count("*").alias("attempts"), F.count_if(F.col("attempt_no") > 1).alias("retries"), F.count_if(F.col("status_code") == 429).alias("too_many"), F.sum("bucket_wait_ms").alias("wait_ms"),
        F.sum("bytes").alias("bytes"), F.count_if(F.col("robots_decision") == "disallowed").alias("disallowed"),
    )


def request_slots(requests: DataFrame, interval_ms: int, by: str = "host", arrival: str = "arrival_ms", order: str = "id") -> DataFrame:
    """requests with ``slot_ms``: each at least an interval after the one before, none before its arrival.

    Closed form of slot = max(arrival, slot before + interval): a running maximum of arrival - n * interval, n the number of
    requests before. Both are scanned over ranges of a host's requests, so a host with most of them is many tasks.
    """
    keys, places = [by], [arrival, order]
    rows = scans.dealt(requests, keys, places)
    w = scans.inside(keys, places)
    numbered = rows.withColumn("__n", (F.row_number().over(w) - 1).cast("long"))
    lead = F.col(arrival) - F.col("__n") * interval_ms
    count, most = F.count("*"), F.max(lead)
    told = scans.carried(
        numbered, keys, {"__count": count, "__most": most},
        [{"__before": lambda earlier: F.coalesce(F.sum("__count").over(earlier), F.lit(0))}, {"__led": lambda earlier: F.max(F.col("__most") - F.col("__shift")).over(earlier)}],
        {"__shift": F.col("__before") * interval_ms},
    )
    n = F.col("__n") + F.coalesce("__before", F.lit(0))
    # the partition's own maximum counts from its first request, so it moves back by those before
    own = F.max(lead).over(w) - F.coalesce("__before", F.lit(0)) * interval_ms
    return told.withColumn("slot_ms", F.greatest(own, F.coalesce("__led", own)) + n * interval_ms).select(*requests.columns, "slot_ms")


def orphan_sources(sources: DataFrame, log: DataFrame, retired: Column) -> DataFrame:
    """Retired sources with ``action``: delete if never run, else disable."""
    ran = log.select("source").distinct().withColumn("__ran", F.lit(True))
    return sources.filter(retired).join(ran, "source", "left").withColumn("action", F.when(F.col("__ran"), "disable").otherwise("delete")).drop("__ran")


def batch_slugs(results: DataFrame) -> DataFrame:
    """One row a batch and slug: batch, slug, outcome (the worst of its runs), runs, and the batch's number of complete runs."""
    order = F.when(F.col("outcome") == "complete", 0).when(F.col("outcome") == "skipped", 1).otherwise(2)
    each = results.groupBy("batch", "slug").agg(F.max(F.struct(order.alias("order"), "outcome"))["outcome"].alias("outcome"), F.count("*").alias("runs"), F.count_if(F.col("outcome") == "complete").alias("__good"))
    sums = each.groupBy("batch").agg(F.sum("__good").alias("complete"))  # one row a batch
    return each.drop("__good").join(sums, "batch")


def batch_outcome(results: DataFrame) -> DataFrame:
    """batch, complete, incomplete (slugs), skipped (slugs): a report of one row a batch; ``batch_slugs`` for batches of any size."""
    slugs = lambda o: F.array_sort(F.collect_list(F.when(F.col("outcome") == o, F.col("slug"))))
    return results.groupBy("batch").agg(F.count_if(F.col("outcome") == "complete").alias("complete"), slugs("incomplete").alias("incomplete"), slugs("skipped").alias("skipped"))
