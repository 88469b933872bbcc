"""Questions at many points over many intervals, as equi-joins.

An interval is put into the buckets that it touches at one width, the least power of four at which it touches few of them: a
long interval takes a few wide buckets, a short one a few narrow ones. A point lies in one bucket of each width in use, so a
point and an interval meet in at most one bucket, and the exact condition is checked there. Bucket numbers are part of the
join key, so a key with a third of all rows is spread over time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: buckets that an interval may touch beyond its first one
FEW = 2


def position(df: DataFrame, name: str) -> Column:
    """A number or a time as a whole number that never falls as the value rises (times: seconds)."""
    kind, c = dict(df.dtypes)[name], F.col(f"`{name}`")
    if kind == "timestamp":
        return F.unix_seconds(c)
    if kind == "timestamp_ntz":  # by the clock, whatever the session's zone
        return F.unix_date(c.cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    if kind == "date":
        return F.unix_date(c).cast("long")
    return F.floor(c).cast("long")


def leveled(held: DataFrame) -> DataFrame:
    """Intervals (``__lo`` to ``__hi``) with the ``__level`` of their buckets, which are 4 to the power of it wide."""
    wide = F.greatest(F.lit(0), F.ceil(F.log2((F.col("__hi") - F.col("__lo")) / FEW) / 2)).cast("int")
    return held.withColumn("__level", F.when(F.col("__hi") - F.col("__lo") <= FEW, 0).otherwise(wide))


def touched() -> Column:
    """The buckets that an interval touches at its level."""
    return F.sequence(F.expr("shiftright(__lo, 2 * __level)"), F.expr("shiftright(__hi, 2 * __level)"))


def meeting(intervals: DataFrame, points: DataFrame, by: list[str], at: str, first: str, gone: str) -> DataFrame:
    """Every point with the intervals of equal ``by`` columns that lie in one bucket with it, before the exact condition."""
    clash = (set(points.columns) & set(intervals.columns)) - set(by)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    asked = points.filter(F.col(at).isNotNull()).withColumn("__at", position(points, at))
    # one row: where points lie, and the widths in use below
    span = asked.agg(F.min("__at").alias("lo"), F.max("__at").alias("hi")).head()
    low, high = span["lo"] or 0, span["hi"] or 0
    begin, end = F.greatest(position(intervals, first), F.lit(low)), F.least(F.coalesce(position(intervals, gone), F.lit(high)), F.lit(high))
    held = intervals.filter(F.col(first).isNotNull()).withColumns({"__lo": begin, "__hi": end}).filter("__lo <= __hi")
    held = leveled(held)
    levels = sorted(r[0] for r in held.select("__level").distinct().collect())
    bucketed = held.withColumn("__bucket", F.explode(touched()))
    probes = F.array(*[F.struct(F.lit(k).alias("__level"), F.shiftright("__at", 2 * k).alias("__bucket")) for k in levels] or [F.struct(F.lit(-1).alias("__level"), F.lit(0).cast("long").alias("__bucket"))])
    probing = asked.select(*points.columns, F.inline(probes))
    return bucketed.join(probing, [*by, "__level", "__bucket"])


def stabbed(intervals: DataFrame, points: DataFrame, by: list[str], at: str, first: str, gone: str) -> DataFrame:
    """Every point with the intervals of equal ``by`` columns that hold it: first <= at, and gone is null or later than at.

    Null keys match nothing, null points and null firsts neither; equal rows on either side all meet. Columns of the
    points other than ``by`` come after those of the intervals and must have names of their own.
    """
    inside = (F.col(first) <= F.col(at)) & (F.col(gone).isNull() | (F.col(gone) > F.col(at)))
    met = meeting(intervals, points, by, at, first, gone).filter(inside)
    return met.select(*intervals.columns, *[c for c in points.columns if c not in by])
