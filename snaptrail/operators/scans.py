"""Rules that go through the rows of a key in order, also where one key has most of all rows.

Rows are dealt over partitions by ranges of (key, order). Inside a partition a window does the work; what it must know of the
partitions before is a summary of each, combined in order. Only keys that go over the edge of a partition need it, at most
two of them a partition, so these summaries are few whatever the rows are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from snaptrail.operators.cuts import cut

PART = "__part"


def dealt(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with ``__part``: their place in ranges of (by, order), fixed by a checkpoint. Rows that are equal in all of them stay together."""
    return cut(rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in [*by, *order]])).withColumn(PART, F.spark_partition_id())


def inside(by: list[str], order: list[str]) -> WindowSpec:
    """The window over a key's rows of one partition, up to the current one."""
    return Window.partitionBy(*by, PART).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def carried(rows: DataFrame, by: list[str], totals: dict[str, Column], over: list[dict[str, Callable[[WindowSpec], Column]]], made: dict[str, Column] | None = None) -> DataFrame:
    """Dealt rows with what the partitions before tell of their key; null where there are none.

    totals: aggregates of a key's rows in one partition. over: steps of columns made from these (and from steps before) over
    the window of all earlier partitions of the key. made: columns that later steps need of the first one.
    """
    sums = rows.groupBy(*by, PART).agg(*[c.alias(n) for n, c in totals.items()])
    parts = Window.partitionBy(*by)
    sums = sums.withColumn("__parts", F.count("*").over(parts)).filter("__parts > 1")
    before = parts.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    for step in over:
        sums = sums.withColumns({n: f(before) for n, f in step.items()})
        if step is over[0] and made:
            sums = sums.withColumns(made)
    names = [n for step in over for n in step]
    keys = {c: f"__key_{i}" for i, c in enumerate([*by, PART])}
    few = sums.select(*[F.col(c).alias(k) for c, k in keys.items()], *names)
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()]
    return rows.join(F.broadcast(few), same, "left").drop(*keys.values())


def last_of(order: list[str], value: Column) -> Column:
    """A total: the last non-null value in order, in a struct."""
    place = F.struct(*[F.struct(F.col(c).isNotNull().alias("told"), F.col(c).alias("value")) for c in order])
    return F.max_by(F.when(value.isNotNull(), F.struct(value.alias("value"))), F.when(value.isNotNull(), place))
