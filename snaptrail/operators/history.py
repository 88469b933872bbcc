"""First-seen / last-seen / removed history of snapshots.

A history row is a version: the row's own columns, ``row_hash``, and the snapshots (id and time) at which it was first
seen, last seen and found removed. A row that comes back opens a new version. Closed versions never change, so only the
current part of a history takes part in applying a snapshot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snaptrail.functions.scalars import licence_stem
from snaptrail.operators.identity import NUMBER, identified
from snaptrail.operators.intervals import stabbed
from snaptrail.spec import TableSpec

MARKS = ["first_seen_snapshot_id", "last_seen_snapshot_id", "removed_snapshot_id", "first_seen_at", "last_seen_at", "removed_at"]


def diff_snapshots(prev: DataFrame, cur: DataFrame, key: str = "row_hash") -> DataFrame:
    """(key, side): added, removed or unchanged; one shuffle a side."""
    p, c = prev.select(key, F.lit(True).alias("was")), cur.select(key, F.lit(True).alias("is"))
    side = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").otherwise("unchanged")
    return p.join(c, key, "full_outer").select(key, side.alias("side"))


def newest_applied(history: DataFrame) -> int | None:
    """The newest snapshot that opened, kept or closed a version."""
    return history.agg(F.max(F.greatest("last_seen_snapshot_id", "removed_snapshot_id"))).head()[0]


def apply_snapshot(history: DataFrame, incoming: DataFrame, snapshot_id: Column, at: Column, newest: Column | None = None) -> DataFrame:
    """The history after one more snapshot (rows with ``row_hash``); applying it again changes nothing.

    A snapshot not newer than the last applied one is refused by leaving the history as it is.
    ``newest`` is the last applied one, as a caller's log knows it; without it the history is asked (one number).
    """
    own = [c for c in history.columns if c not in MARKS and c != "row_hash"]
    if newest is None:
        newest = F.lit(newest_applied(history)).cast("long")
    incoming = incoming.filter(newest.isNull() | (newest < snapshot_id))
    closed = history.filter(F.col("removed_snapshot_id").isNotNull())
    current = history.filter(F.col("removed_snapshot_id").isNull()).alias("h")
    joined = current.join(incoming.select("row_hash", *own).alias("i"), F.col("h.row_hash") == F.col("i.row_hash"), "full_outer")
    here, there = F.col("i.row_hash").isNotNull(), F.col("h.row_hash").isNotNull()
    late = F.coalesce(F.col("h.last_seen_snapshot_id") >= snapshot_id, F.lit(False))
    merged = joined.select(
        F.coalesce("h.row_hash", "i.row_hash").alias("row_hash"), *[F.when(there, F.col(f"h.{c}")).otherwise(F.col(f"i.{c}")).alias(c) for c in own],
        F.coalesce("h.first_seen_snapshot_id", snapshot_id).alias("first_seen_snapshot_id"),
        F.when(here & ~late, snapshot_id).otherwise(F.col("h.last_seen_snapshot_id")).alias("last_seen_snapshot_id"),
        F.when(~here & ~late, snapshot_id).alias("removed_snapshot_id"),
        F.coalesce("h.first_seen_at", at).alias("first_seen_at"), F.when(here & ~late, at).otherwise(F.col("h.last_seen_at")).alias("last_seen_at"), F.when(~here & ~late, at).alias("removed_at"),
    )
    return closed.unionByName(merged.select(*history.columns))


Snapshot = tuple[int, object]  # an applied snapshot's id and time
KEY = ("row_hash",)
#: snapshots that are applied in one shuffle: bits of a number, but the sign and that of the history
BITS = 62


def apply_snapshots(history: DataFrame, observations: DataFrame, snapshots: list[Snapshot], newest: int | None, key: tuple[str, ...] = KEY, ranges: int | None = None) -> DataFrame:
    """The history after several more snapshots, ``BITS`` a shuffle; equals applying them one by one, in order.

    observations: snapshot_id, the columns of ``key`` and others. ``newest``: the last applied snapshot's id, None if there
    is none; snapshots that aren't newer are refused by leaving the history as it is. The columns of ``key`` tell rows apart
    (``row_hash``, or all values and their number). Current rows and rows of snapshots meet in one aggregation.
    ``ranges``: they meet in so many ranges of the key, not by its hash, which takes a second look at them but keeps the
    order in which they are stored.
    """
    fresh = sorted(s for s in snapshots if newest is None or s[0] > newest)
    own = [c for c in history.columns if c not in (*MARKS, *key)]
    kinds = dict(history.dtypes)
    for some in [fresh[i : i + BITS] for i in range(0, len(fresh), BITS)]:
        told = [(None, None, 0)] + [(i, t, n) for n, (i, t) in enumerate(some, 1)]
        ordinal = history.sparkSession.createDataFrame(told, f"snapshot_id {kinds['first_seen_snapshot_id']}, at {kinds['first_seen_at']}, ordinal int")
        olds = [m for m in MARKS if not m.startswith("removed")]
        current = history.filter(F.col("removed_snapshot_id").isNull()).select(*key, *own, F.lit(0).alias("__o"), *[F.col(m).alias(f"__{m}") for m in olds])
        # looked up, not joined: rows keep the partitions in which they come
        places = F.create_map(*[x for i, _, n in told[1:] for x in (F.lit(i).cast(kinds["first_seen_snapshot_id"]), F.lit(n))])
        coming = observations.withColumn("__o", F.try_element_at(places, F.col("snapshot_id").cast(kinds["first_seen_snapshot_id"]))).filter("__o IS NOT NULL")
        coming = coming.select(*key, *own, "__o", *[F.lit(None).cast(kinds[m]).alias(f"__{m}") for m in olds])
        bit = F.expr("shiftleft(1L, __o)")
        # a row keeps the values that it came with first
        values = [F.min_by(F.struct(*own), "__o").alias("__own")] if own else []
        # in this order Spark sees that both are dealt alike, if they are (a table in buckets, rows counted by its columns)
        both = coming.unionByName(current)
        met = (both.repartitionByRange(ranges, *key) if ranges else both).groupBy(*key).agg(F.bit_or(bit).alias("__bits"), *values, *[F.max(f"__{m}").alias(f"__{m}") for m in olds])
        at = F.filter(F.array(*[F.lit(i) for i in range(len(some) + 1)]), lambda i: F.getbit("__bits", i) == 1)
        rows = versions(met.select(*key, *[F.col(f"__own.{c}") for c in own], *[f"__{m}" for m in olds], at.alias("__at")), ordinal)
        merged = rows.withColumns({m: F.coalesce(m, f"__{m}") for m in olds}).select(*history.columns)
        history = history.filter(F.col("removed_snapshot_id").isNotNull()).unionByName(merged)
    return history


def near_snapshot(before: Snapshot | None, after: Snapshot | None) -> Column:
    """Versions that a snapshot between two neighbours can change: those seen at one of them."""
    seen = [(F.col("first_seen_snapshot_id") <= s[0]) & (F.col("last_seen_snapshot_id") >= s[0]) for s in (before, after) if s]
    return reduce(lambda a, b: a | b, seen, F.lit(False))


def _mark(row: dict[str, Column], which: str, snapshot: Snapshot | None) -> dict[str, Column]:
    """A version's marks with one of them set to a snapshot, or cleared."""
    return row | {f"{which}_snapshot_id": F.lit(snapshot[0] if snapshot else None).cast("long"), f"{which}_at": F.lit(snapshot[1] if snapshot else None)}


def joined(a: DataFrame, x: str, b: DataFrame, y: str, key: tuple[str, ...], how: str) -> DataFrame:
    """a and b under names x and y, joined on the columns of ``key`` (nulls are equal); ``__x`` and ``__y`` are true where there is a row."""
    same = reduce(lambda m, n: m & n, [F.col(f"{x}.`{c}`").eqNullSafe(F.col(f"{y}.`{c}`")) if len(key) > 1 else F.col(f"{x}.`{c}`") == F.col(f"{y}.`{c}`") for c in key])
    left = a if f"__{x}" in a.columns else a.withColumn(f"__{x}", F.lit(True)).alias(x)
    return left.join(b.withColumn(f"__{y}", F.lit(True)).alias(y), same, how)


def _meeting(near: DataFrame, incoming: DataFrame, key: tuple[str, ...], ranges: int | None) -> DataFrame:
    """A version (struct ``h``; ``__h``: there is one) and an incoming row (``i``, ``__i``) of each key, at most one of either, met in one aggregation."""
    own = [c for c in incoming.columns if c not in key]
    rest = [c for c in near.columns if c not in (*key, *own)]
    kinds = dict(near.dtypes)
    values = lambda is_in: [F.when(F.lit(is_in), F.struct(*own))] if own else []
    left = near.select(*key, *[v.alias("__h_own") for v in values(True)], *[v.alias("__i_own") for v in values(False)], F.lit(True).alias("__h"), F.lit(None).cast("boolean").alias("__i"), *[F.col(c).alias(f"__h_{c}") for c in rest])
    right = incoming.select(*key, *[v.alias("__h_own") for v in values(False)], *[v.alias("__i_own") for v in values(True)], F.lit(None).cast("boolean").alias("__h"), F.lit(True).alias("__i"), *[F.lit(None).cast(kinds[c]).alias(f"__h_{c}") for c in rest])
    both = left.unionByName(right)
    owns = [F.any_value(f"__{x}_own", ignoreNulls=F.lit(True)).alias(f"__{x}_own") for x in "hi" if own]
    met = (both.repartitionByRange(ranges, *key) if ranges else both).groupBy(*key).agg(*owns, *[F.max(c).alias(c) for c in ("__h", "__i", *[f"__h_{c}" for c in rest])])
    h = F.struct(*key, *[F.col(f"__h_own.`{c}`").alias(c) for c in own], *[F.col(f"__h_{c}").alias(c) for c in rest])
    return met.select(h.alias("h"), F.struct(*key, *[F.col(f"__i_own.`{c}`").alias(c) for c in own]).alias("i"), "__h", "__i")


def _spliced(near: DataFrame, incoming: DataFrame, snapshot: Snapshot, before: Snapshot | None, after: Snapshot | None, key: tuple[str, ...], whole: bool, ranges: int | None = None) -> DataFrame:
    """``splice_changes``, or (``whole``) the versions that come out of ``near``."""
    own = [c for c in incoming.columns if c not in key]
    others = [c for c in near.columns if c not in (*key, *own, *MARKS)]
    kinds = dict(near.dtypes)
    old = {c: F.col(f"h.`{c}`") for c in (*key, *own, *MARKS)}
    new = {c: F.col(f"i.`{c}`") for c in (*key, *own)} | dict.fromkeys(MARKS, F.lit(None))
    new = _mark(_mark(_mark(new, "first_seen", snapshot), "last_seen", snapshot), "removed", after)

    def version(row: dict[str, Column], change: str, kept: bool = False) -> Column:
        return F.struct(*[v.cast(kinds[c]).alias(c) for c, v in row.items()], *[(F.col(f"h.`{c}`") if kept else F.lit(None).cast(kinds[c])).alias(c) for c in others], F.lit(change).alias("change"))

    # what becomes of a version: it is voided and others are added, or it stays
    gone = [] if whole else [version(old, "void", kept=True)]
    stays = F.array(version(old, "add", kept=True)) if whole else F.array().cast(f"array<{void_type(near, others, own, key)}>")
    here, there = F.col("__i").isNotNull(), F.col("__h").isNotNull()
    is_over = (F.col("h.first_seen_snapshot_id") <= before[0]) & (F.col("h.last_seen_snapshot_id") >= after[0]) if before and after else F.lit(False)
    ends = F.col("h.last_seen_snapshot_id") == before[0] if before else F.lit(False)
    begins = F.col("h.first_seen_snapshot_id") == after[0] if after else F.lit(False)
    split = F.array(*gone, version(_mark(_mark(old, "last_seen", before), "removed", snapshot), "add"), version(_mark(old, "first_seen", after), "add"))
    changes = (
        F.when(~there, F.array(version(new, "add")))
        .when(is_over, F.when(here, stays).otherwise(split))
        .when(ends, F.when(here, F.array(*gone, version(_mark(old, "last_seen", snapshot), "add"))).otherwise(F.array(*gone, version(_mark(old, "removed", snapshot), "add"))))
        .when(begins & here, F.array(*gone, version(_mark(old, "first_seen", snapshot), "add")))
        .otherwise(stays)
    )
    return _meeting(near, incoming, key, ranges).select(F.inline(changes))


def splice_changes(near: DataFrame, incoming: DataFrame, snapshot: Snapshot, before: Snapshot | None, after: Snapshot | None, key: tuple[str, ...] = KEY, ranges: int | None = None) -> DataFrame:
    """What a snapshot between two applied ones changes: versions to void and to add (column ``change``).

    ``near``: the versions that ``near_snapshot`` keeps, at most one a row hash, as neighbours have no snapshot between
    them. A version over both neighbours is split where the row is missing, one that ends before or begins after the
    snapshot moves its end or beginning, and a row that only the snapshot has becomes a version of its own. Other columns
    of ``near`` go with voided versions and are null in added ones. ``ranges``: as for ``apply_snapshots``.
    """
    return _spliced(near, incoming, snapshot, before, after, key, False, ranges)


def spliced_versions(near: DataFrame, incoming: DataFrame, snapshot: Snapshot, before: Snapshot | None, after: Snapshot | None, key: tuple[str, ...] = KEY, ranges: int | None = None) -> DataFrame:
    """The versions that come out of ``near`` (see ``splice_changes``); other columns of ``near`` are null in those that are new."""
    return _spliced(near, incoming, snapshot, before, after, key, True, ranges)


def amend_changes(history: DataFrame, more: DataFrame, snapshot: Snapshot, before: Snapshot | None, after: Snapshot | None, key: tuple[str, ...] = KEY) -> DataFrame:
    """What more rows of an applied snapshot change: as ``splice_changes``, for rows that weren't known to be in it.

    A version that ended before the snapshot and one that begins after it become one version.
    """
    own = [c for c in more.columns if c not in key]
    others = [c for c in history.columns if c not in (*key, *own, *MARKS)]
    kinds = dict(history.dtypes)
    first, last = F.col("first_seen_snapshot_id"), F.col("last_seen_snapshot_id")
    known = history.filter((first <= snapshot[0]) & (last >= snapshot[0]))
    missing = joined(more, "i", known, "k", key, "left_anti")
    left = history.filter(last == before[0] if before else F.lit(False))
    right = history.filter(first == after[0] if after else F.lit(False))
    sides = joined(joined(missing, "i", left, "l", key, "left"), "i", right, "r", key, "left")
    is_left, is_right = F.col("__l").isNotNull(), F.col("__r").isNotNull()
    side = lambda s: {c: F.col(f"{s}.`{c}`") for c in (*key, *own, *MARKS)}
    added = {c: F.col(f"i.`{c}`") for c in (*key, *own)}
    marks = {m: F.when(is_left, F.col(f"l.{m}")).otherwise(F.lit(snapshot[n]).cast(kinds[m])) for n, m in enumerate(("first_seen_snapshot_id", "first_seen_at"))}
    marks |= {m: F.when(is_right, F.col(f"r.{m}")).otherwise(F.lit(snapshot[n]).cast(kinds[m])) for n, m in enumerate(("last_seen_snapshot_id", "last_seen_at"))}
    marks |= {m: F.when(is_right, F.col(f"r.{m}")).otherwise(F.lit(after[n] if after else None).cast(kinds[m])) for n, m in enumerate(("removed_snapshot_id", "removed_at"))}

    def version(row: dict[str, Column], change: str, kept: str | None = None) -> Column:
        return F.struct(*[row[c].cast(kinds[c]).alias(c) for c in (*key, *own, *MARKS)], *[(F.col(f"{kept}.`{c}`") if kept else F.lit(None).cast(kinds[c])).alias(c) for c in others], F.lit(change).alias("change"))

    changes = F.filter(F.array(F.when(is_left, version(side("l"), "void", "l")), F.when(is_right, version(side("r"), "void", "r")), version(added | marks, "add")), lambda x: x.isNotNull())
    return sides.select(F.inline(changes))


def void_type(near: DataFrame, others: list[str], own: list[str], key: tuple[str, ...]) -> str:
    kinds = dict(near.dtypes)
    return "struct<" + ",".join(f"`{c}`:{kinds[c]}" for c in (*key, *own, *MARKS, *others)) + ",change:string>"


def changed_by(history: DataFrame, changes: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """The history without voided and with added versions."""
    gone = changes.filter("change = 'void'").select(*key, "first_seen_snapshot_id")
    left = joined(history, "a", gone, "b", (*key, "first_seen_snapshot_id"), "left_anti")
    return left.select(*history.columns).unionByName(changes.filter("change = 'add'").select(*history.columns))


def splice_snapshot(history: DataFrame, incoming: DataFrame, snapshot: Snapshot, before: Snapshot | None, after: Snapshot | None, key: tuple[str, ...] = KEY) -> DataFrame:
    """The history as if the snapshot had come in its turn; equals rebuilding from all snapshots.

    ``before`` and ``after``: its neighbours among the applied snapshots, by id. Only versions seen at one of them meet the
    snapshot, once; all others are passed on as they are.
    """
    near = near_snapshot(before, after)
    met = spliced_versions(history.filter(near), incoming, snapshot, before, after, key)
    return history.filter(~near).unionByName(met.select(*history.columns))


def apply_stats(before: DataFrame, incoming: DataFrame) -> DataFrame:
    """(inserted, removed, unchanged) of applying ``incoming``."""
    sides = diff_snapshots(before.filter(F.col("removed_snapshot_id").isNull()), incoming)
    return sides.agg(*[F.count_if(F.col("side") == s).alias(n) for s, n in (("added", "inserted"), ("removed", "removed"), ("unchanged", "unchanged"))])


def build_history(observations: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The whole history from all complete snapshots at once; equals applying them one by one.

    observations: snapshot_id, row_hash and own columns. snapshots: snapshot_id, at (complete ones, also those without
    rows). A row's snapshots are gathered as one sorted set of small numbers, in one shuffle with partial aggregation; its
    versions are the runs of consecutive numbers.
    """
    own = [c for c in observations.columns if c not in ("snapshot_id", "row_hash")]
    ordinal = ordinals(snapshots)
    seen = observations.join(F.broadcast(ordinal), "snapshot_id")
    rows = seen.groupBy("row_hash").agg(F.any_value(F.struct(*own) if own else F.lit(None)).alias("own"), F.array_sort(F.collect_set("ordinal")).alias("at"))
    return versions(rows.select("row_hash", *[f"own.{c}" for c in own], F.col("at").alias("__at")), ordinal)


#: snapshots whose counts are columns of one aggregation
AT_ONCE = 16


def counted_rows(observations: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Distinct rows (own columns) with ``__held``: ordinal and count of each snapshot that holds them, in order.

    One shuffle with partial aggregation, of fixed-size counts (two beyond ``AT_ONCE`` snapshots).
    """
    own = [c for c in observations.columns if c != "snapshot_id"]
    total = snapshots.select("snapshot_id").distinct().count()  # one row a snapshot
    seen = observations.join(F.broadcast(ordinals(snapshots).select("snapshot_id", (F.col("ordinal") - 1).alias("__o"))), "snapshot_id")
    places = range(min(total, AT_ONCE) or 1)
    counts = [F.count_if(F.col("__o") % AT_ONCE == i).alias(f"__{i}") for i in places]
    first = F.lit(1) if total <= AT_ONCE else F.col("__block") * AT_ONCE + 1
    held = F.filter(F.array(*[F.struct((first + i).cast("int").alias("o"), F.col(f"__{i}").alias("n")) for i in places]), lambda x: x["n"] > 0)
    if total <= AT_ONCE:
        return seen.groupBy(*own).agg(*counts).select(*own, held.alias("__held"))
    blocks = seen.groupBy(*own, F.floor(F.col("__o") / AT_ONCE).alias("__block")).agg(*counts).select(*own, F.struct("__block", held.alias("held")).alias("__held"))
    return blocks.groupBy(*own).agg(F.array_sort(F.collect_list("__held")).alias("__held")).withColumn("__held", F.flatten(F.col("__held.held")))


def numbered_rows(observations: DataFrame, snapshots: DataFrame) -> DataFrame:
    """snapshot_id, at, own columns and ``__n``, the number among equal rows of a snapshot; a row's snapshots lie together."""
    return rows_of_counts(counted_rows(observations, snapshots), snapshots)


def rows_of_counts(counted: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``numbered_rows`` from ``counted_rows``, row by row."""
    own = [c for c in counted.columns if c != "__held"]
    each = counted.select(*own, F.inline("__held")).join(F.broadcast(ordinals(snapshots)), F.col("o") == F.col("ordinal"))
    return each.select("snapshot_id", "at", *own, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias(NUMBER))


def history_of_rows(observations: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The whole history of rows without identities (snapshot_id and own columns), with ``__n`` in place of ``row_hash``.

    ``identified`` makes the row hashes of it, and the result equals ``build_history`` on ``row_identity``. Neither hashes
    nor a row's snapshots are shuffled. The n-th of equal rows is in the snapshots that hold more than n of them.
    """
    own = [c for c in observations.columns if c != "snapshot_id"]
    most = F.array_max(F.col("__held.n"))
    apart = counted_rows(observations, snapshots).select("*", F.explode(F.sequence(F.lit(0).cast("long"), most - 1)).alias(NUMBER))
    at = F.transform(F.filter("__held", lambda x: x["n"] > F.col(NUMBER)), lambda x: x["o"])
    return versions(apart.select(*own, NUMBER, at.alias("__at")), ordinals(snapshots))


def build_history_of_rows(observations: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``build_history`` of rows without identities."""
    own = [c for c in observations.columns if c != "snapshot_id"]
    return identified(history_of_rows(observations, snapshots), own).select("row_hash", *own, *MARKS)


def ordinals(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, at, ordinal), from 1; one row a snapshot: small, whatever the rows are."""
    return snapshots.select("snapshot_id", "at", F.dense_rank().over(Window.orderBy("snapshot_id")).alias("ordinal"))


def versions(rows: DataFrame, ordinal: DataFrame) -> DataFrame:
    """Rows with the sorted ordinals of their snapshots (``__at``) as versions: runs of consecutive ordinals, with their marks."""
    others = [c for c in rows.columns if c != "__at"]
    begins = F.filter("__at", lambda x, i: (i == 0) | (F.get("__at", i - 1) != x - 1))
    ends = F.filter("__at", lambda x, i: (i == F.size("__at") - 1) | (F.get("__at", i + 1) != x + 1))
    spans = rows.select(*others, F.inline(F.arrays_zip(begins.alias("__lo"), ends.alias("__hi"))))

    def at(prefix: str) -> DataFrame:
        return F.broadcast(ordinal.select(F.col("ordinal").alias(f"{prefix}_o"), F.col("snapshot_id").alias(f"{prefix}_snapshot_id"), F.col("at").alias(f"{prefix}_at")))

    out = spans.join(at("first_seen"), F.col("__lo") == F.col("first_seen_o")).join(at("last_seen"), F.col("__hi") == F.col("last_seen_o")).join(at("removed"), F.col("__hi") + 1 == F.col("removed_o"), "left")
    return out.select(*others, *MARKS)


def current_view(history: DataFrame) -> DataFrame:
    return history.filter(F.col("removed_snapshot_id").isNull()).drop("removed_snapshot_id", "removed_at", "row_hash")


def as_of(history: DataFrame, snapshot_id: int | None = None, at: Column | None = None) -> DataFrame:
    """Rows that were present at a snapshot or a time."""
    x, first, gone = (F.lit(snapshot_id), "first_seen_snapshot_id", "removed_snapshot_id") if snapshot_id is not None else (at, "first_seen_at", "removed_at")
    return history.filter((F.col(first) <= x) & (F.col(gone).isNull() | (F.col(gone) > x)))


def as_of_many(history: DataFrame, points: DataFrame, by: list[str], at: str = "at", axis: str = "at") -> DataFrame:
    """Every point (``by`` columns, ``at`` and others) with the versions of its key that were present then.

    ``axis``: at (times) or snapshot_id. No point meets more versions than a few times those it is answered with, whatever
    the length of a history (see ``intervals``).
    """
    return stabbed(history, points, by, at, f"first_seen_{axis}", f"removed_{axis}")


def changes_in(history: DataFrame, snapshot_id: int) -> DataFrame:
    """Versions that a snapshot opened or closed, with ``kind``."""
    kind = F.when(F.col("first_seen_snapshot_id") == snapshot_id, "added").otherwise("removed")
    return history.filter((F.col("first_seen_snapshot_id") == snapshot_id) | (F.col("removed_snapshot_id") == snapshot_id)).withColumn("kind", kind)


def changes_since(history: DataFrame, baselines: DataFrame, since: Column, limit: int = 200, by: str = "table") -> DataFrame:
    """Added and removed versions since a time, newest first, ``limit`` a table and kind (a report).

    ``baselines``: (by, baseline_id), the first complete snapshot; its rows are never reported as added.
    """
    known = history.join(F.broadcast(baselines), by)  # one row a declared table
    added = known.filter((F.col("first_seen_at") >= since) & (F.col("first_seen_snapshot_id") != F.col("baseline_id"))).withColumns({"kind": F.lit("added"), "changed_at": F.col("first_seen_at"), "changed_in": F.col("first_seen_snapshot_id")})
    removed = known.filter(F.col("removed_at") >= since).withColumns({"kind": F.lit("removed"), "changed_at": F.col("removed_at"), "changed_in": F.col("removed_snapshot_id")})
    newest = Window.partitionBy(by, "kind").orderBy(F.col("changed_at").desc(), "row_hash")
    return added.unionByName(removed).withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= limit).drop("baseline_id")


def pair_renumbered(changes: DataFrame, account: str, licence: str, activity: str, compare: list[str]) -> DataFrame:
    """Pairs a removed with an added row of one snapshot, account, licence stem and activity, one to one.

    (changed_in, kind, row_hash, other_hash, changed): kind is renumbered (changed columns named), added or removed.
    """
    keyed = changes.withColumn("stem", licence_stem(F.col(licence)))
    keys = ["changed_in", account, "stem", activity]
    ranked = keyed.withColumn("n", F.row_number().over(Window.partitionBy(*keys, "kind").orderBy(licence, "row_hash")))
    side = lambda kind, p: ranked.filter(F.col("kind") == kind).select(*keys, "n", F.col("row_hash").alias(f"{p}_hash"), *[F.col(c).alias(f"{p}_{c}") for c in compare])
    both = side("removed", "old").join(side("added", "new"), [*keys, "n"], "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")), F.lit(c)) for c in compare]))
    pair = F.col("old_hash").isNotNull() & F.col("new_hash").isNotNull()
    return both.select(
        "changed_in", F.when(pair, "renumbered").when(F.col("old_hash").isNull(), "added").otherwise("removed").alias("kind"),
        F.coalesce("new_hash", "old_hash").alias("row_hash"), F.when(pair, F.col("old_hash")).alias("other_hash"), F.array_join(F.when(pair, changed), ",").alias("changed"),
    )


def relaxed_name(c: Column) -> Column:
    """Lower case without company suffixes, for publications that spell names differently."""
    return F.trim(F.regexp_replace(F.lower(c), r"[\s,]*\b(?:ltd|limited|inc|plc|llc)\b\.?\s*$", ""))


def reconcile_publications(a: DataFrame, b: DataFrame, key: str, relaxed: bool = False) -> DataFrame:
    """(key, where): in a only, in b only, or in both; by the relaxed key if asked."""
    k = relaxed_name(F.col(key)) if relaxed else F.col(key)
    left, right = a.select(k.alias(key)).distinct().withColumn("in_a", F.lit(True)), b.select(k.alias(key)).distinct().withColumn("in_b", F.lit(True))
    where = F.when(F.col("in_b").isNull(), "a only").when(F.col("in_a").isNull(), "b only").otherwise("both")
    return left.join(right, key, "full_outer").select(key, where.alias("where"))


def evolve_schema(history: DataFrame, spec: TableSpec) -> DataFrame:
    """Adds declared columns that are missing, as null; never drops or retypes."""
    return history.withColumns({f.name: F.lit(None).cast(f.dataType) for f in spec.schema if f.name not in history.columns})


def change_counts(history: DataFrame, by: list[str]) -> DataFrame:
    """(by..., snapshot_id, kind, n): versions opened and closed."""
    marks = F.array(F.struct(F.col("first_seen_snapshot_id").alias("snapshot_id"), F.lit("added").alias("kind")), F.struct(F.col("removed_snapshot_id").alias("snapshot_id"), F.lit("removed").alias("kind")))
    return history.select(*by, F.inline(marks)).filter("snapshot_id IS NOT NULL").groupBy(*by, "snapshot_id", "kind").agg(F.count("*").alias("n"))
