"""Line dedup by distinct-site spread.

A line that many sites carry is boilerplate. Every site's lines feed a HyperLogLog sketch per line hash; sketches merge by
aggregation. Lines whose estimate is clearly at or above ``min_sites`` are boilerplate; lines near the threshold get an
exact distinct count. Then boilerplate lines are cut out of every text. Lists of lines
that are few (they are counted) are sent to the executors, so the corpus's lines are shuffled as sketches only. DataFrame
functions only.

Lines are split at line feeds and compared trimmed of spaces, tabs and carriage returns; lines of fewer than ``min_chars``
code points are never boilerplate. Defined results: null text stays null, with no lines; a null site counts as no site;
a text whose lines all go becomes empty; kept lines stay as they are, in order; repeated rows are treated alike; an
empty table gives an empty result; extra columns pass through, except ``n_lines`` and ``n_removed``, which are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaptrail.llm.common import cut, few

MIN_SITES = 10
LG_K = 12


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def spread(lines: DataFrame, min_sites: int, lg_k: int = LG_K) -> DataFrame:
    """(h1, h2, site) -> (h1, h2, estimate) of lines that may reach ``min_sites``; one shuffle of merged sketches."""
    error = 3 * 1.04 / math.sqrt(1 << lg_k)
    sketches = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("estimate"))
    return sketches.filter(F.col("estimate") >= math.floor(min_sites * (1 - error)))


def boilerplate(lines: DataFrame, min_sites: int, lg_k: int = LG_K) -> DataFrame:
    """(h1, h2) of lines on at least ``min_sites`` sites: sketched, then counted exactly near the threshold."""
    error = 3 * 1.04 / math.sqrt(1 << lg_k)
    candidates = cut(spread(lines, min_sites, lg_k))
    sure = candidates.filter(F.col("estimate") > math.ceil(min_sites * (1 + error)))
    near = candidates.filter(F.col("estimate") <= math.ceil(min_sites * (1 + error)))
    counted = lines.join(few(near.select("h1", "h2")), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.countDistinct("site").alias("sites")).filter(F.col("sites") >= min_sites)
    return cut(sure.select("h1", "h2").unionByName(counted.select("h1", "h2")))


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_chars: int = 1, lg_k: int = LG_K) -> DataFrame:
    """docs with boilerplate lines cut out of ``text``, and ``n_lines``, ``n_removed``."""
    # columns are numbered inside, so that names of theirs can't clash with names used here
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    inside = {c: f"in{i}" for i, c in enumerate(kept)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inside.items()])
    text = F.col(inside["text"])
    line = trimmed(F.col("line"))
    exploded = rows.select(text.alias("text"), F.col(inside[site]).cast("string").alias("site"), F.posexplode_outer(F.split(text, "\n")).alias("place", "line"))
    exploded = exploded.select(F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit(1)).alias("t2"), "site", "place", line.alias("line"))
    lines = exploded.filter(F.length("line") >= max(1, min_chars)).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64("line", F.lit(1))})
    gone = boilerplate(lines.select("h1", "h2", "site"), min_sites, lg_k)
    # the places to cut, by text: equal texts lose equal lines
    flagged = lines.select("t1", "t2", "place", "h1", "h2").join(few(gone), ["h1", "h2"], "left_semi").groupBy("t1", "t2").agg(F.collect_set("place").alias("cut"))
    keyed = rows.withColumns({"t1": F.xxhash64(text), "t2": F.xxhash64(text, F.lit(1))}).join(flagged, ["t1", "t2"], "left")
    # places are distinct, so the difference of the two sets of places is linear and keeps their order
    places = F.array_except(F.sequence(F.lit(0), F.size("whole") - 1), "cut")
    left = F.when(F.col("cut").isNull(), F.col("whole")).otherwise(F.transform(places, lambda i: F.col("whole")[i]))
    done = keyed.withColumn("whole", F.split(text, "\n")).withColumn("left", left)
    n, m = F.size("whole"), F.size("left")
    counts = {"n_lines": F.coalesce(n, F.lit(0)).cast("long"), "n_removed": F.coalesce(n - m, F.lit(0)).cast("long")}
    return done.select(*[(F.array_join("left", "\n") if c == "text" else F.col(k)).alias(c) for c, k in inside.items()], *[c.alias(k) for k, c in counts.items()])
