"""Running sums in order of a value, and runs of rows in time, without sorting everything in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A value's range is found among SIDE * SIDE of them in two steps of SIDE comparisons.
SIDE = 32


def with_ranges(points: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adds range__, a number that ascends with ``value`` within ``keys``; about as many points lie in each range.

    Cuts are approximate quantiles: they decide how evenly the work is dealt, not the result.
    """
    n = SIDE * SIDE
    found = points.groupBy(*[F.col(k).alias(f"at_{k}__") for k in keys]).agg(F.percentile_approx(value, [i / n for i in range(1, n)], 10_000).alias("cuts__"))
    if keys:
        joined = points.join(found, [F.col(k).eqNullSafe(F.col(f"at_{k}__")) for k in keys])
    else:
        joined = points.withColumn("one__", F.lit(1)).join(F.broadcast(found.withColumn("one__", F.lit(1))), "one__")
    below = lambda cuts: F.size(F.filter(cuts, lambda c: c < F.col(value)))
    coarse = F.transform(F.sequence(F.lit(1), F.lit(SIDE - 1)), lambda j: F.get("cuts__", j * SIDE - 1))
    rough = joined.withColumn("rough__", below(coarse))
    fine = below(F.slice("cuts__", F.col("rough__") * SIDE + 1, F.lit(SIDE - 1)))
    return rough.withColumn("range__", F.col("rough__") * SIDE + fine).select(*points.columns, "range__")


def running(points: DataFrame, value: str, sums: Sequence[str], keys: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """For points of distinct ``value`` within ``keys``: adds next__, the value that follows, and per sum before_ and total_.

    Only one row a range and key meets in the window over ranges.
    """
    along = F.desc if descending else F.asc
    ranged = with_ranges(points, value, keys)
    inside = Window.partitionBy(*keys, "range__").orderBy(along(value))
    head = F.max if descending else F.min
    totals = ranged.groupBy(*[F.col(k).alias(f"at_{k}__") for k in keys], F.col("range__").alias("at__")).agg(head(value).alias("head__"), *[F.sum(s).alias(f"sum_{s}__") for s in sums])
    across = Window.partitionBy(*[f"at_{k}__" for k in keys]).orderBy(along("at__"))
    whole = Window.partitionBy(*[f"at_{k}__" for k in keys])
    offsets = totals.select(
        *[f"at_{k}__" for k in keys], "at__", F.lead("head__").over(across).alias("head__"),
        *[F.coalesce(F.sum(f"sum_{s}__").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"offset_{s}__") for s in sums],
        *[F.sum(f"sum_{s}__").over(whole).alias(f"total_{s}") for s in sums],
    )
    marked = ranged.withColumns(
        {"own__": F.lead(value).over(inside)} | {f"own_{s}__": F.coalesce(F.sum(s).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for s in sums}
    )
    joined = marked.join(offsets if keys else F.broadcast(offsets), [F.col("range__") == F.col("at__"), *[F.col(k).eqNullSafe(F.col(f"at_{k}__")) for k in keys]])
    return joined.select(
        *points.columns, F.coalesce("own__", "head__").alias("next__"), *[(F.col(f"own_{s}__") + F.col(f"offset_{s}__")).alias(f"before_{s}") for s in sums], *[f"total_{s}" for s in sums]
    )


def _buckets(rows: DataFrame, keys: Sequence[str], time: str, width: int) -> tuple[DataFrame, Window, list[str]]:
    cut = rows.withColumn("bucket__", F.floor(F.col(time) / width))
    return cut, Window.partitionBy(*[f"at_{k}" for k in keys]).orderBy("at__"), [f"at_{k}" for k in keys]


def _met(rows: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(edges, [F.col("bucket__").eqNullSafe(F.col("at__")), *[F.col(k).eqNullSafe(F.col(f"at_{k}")) for k in keys]])


def with_runs(rows: DataFrame, keys: Sequence[str], gap: int, time: str = "time", tie: str = "row_id", strict: bool = True, width: int = 86_400) -> DataFrame:
    """Adds run__: 1, 2, ... for runs of rows in time, per key; a run ends where the next row is more than ``gap`` later (``gap`` or more, if not strict).

    Rows are cut into buckets of time. Within a bucket gaps are found by lag; its
    first row is compared with the last one before, from one row a bucket. A run's
    number is the bucket's offset plus its own running count, so only rows a
    bucket, not all of a busy key, meet in one window.
    """
    far = lambda d: d > gap if strict else d >= gap
    cut, across, names = _buckets(rows, keys, time, width)
    inside = Window.partitionBy(*keys, "bucket__").orderBy(time, tie)
    marked = cut.withColumn("fresh__", F.coalesce(far(F.col(time) - F.lag(time).over(inside)).cast("int"), F.lit(0)))
    marked = marked.withColumn("own__", F.sum("fresh__").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    edges = marked.groupBy(*[F.col(k).alias(f"at_{k}") for k in keys], F.col("bucket__").alias("at__")).agg(F.min(time).alias("first__"), F.max(time).alias("last__"), F.max("own__").alias("most__"))
    opened = F.coalesce(far(F.col("first__") - F.lag("last__").over(across)).cast("int"), F.lit(1))
    offsets = edges.withColumn("opened__", opened).select(
        *names, "at__", (F.sum("opened__").over(across.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("most__").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("offset__")
    )
    return _met(marked, offsets, keys).select(*rows.columns, (F.col("offset__") + F.col("own__")).alias("run__"))


def with_previous(rows: DataFrame, keys: Sequence[str], time: str = "time", tie: str = "row_id", width: int = 86_400) -> DataFrame:
    """Adds previous__: the time of the row before, per key; null for the first. Bucketed like ``with_runs``."""
    cut, across, names = _buckets(rows, keys, time, width)
    inside = Window.partitionBy(*keys, "bucket__").orderBy(time, tie)
    marked = cut.withColumn("own__", F.lag(time).over(inside))
    edges = marked.groupBy(*[F.col(k).alias(f"at_{k}") for k in keys], F.col("bucket__").alias("at__")).agg(F.max(time).alias("last__"))
    before = edges.select(*names, "at__", F.lag("last__").over(across).alias("before__"))
    return _met(marked, before, keys).select(*rows.columns, F.coalesce("own__", "before__").alias("previous__"))


def first_by_hash(rows: DataFrame, cls: str, quota: Column, order: Column, key: str) -> DataFrame:
    """The first ``quota`` rows of each class in the order of a hexadecimal hash, then of ``key``.

    Rows are counted by class and the hash's first four digits; whole ranges are
    kept or left, and only those at the cut are ranked row by row.
    """
    hashed = rows.withColumn("hash__", order).withColumn("range__", F.substring("hash__", 1, 4))
    counts = hashed.groupBy(F.col(cls).alias("class__"), F.col("range__").alias("at__")).agg(F.count("*").alias("n__"))
    upto = Window.partitionBy("class__").orderBy("at__").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before__", F.coalesce(F.sum("n__").over(upto), F.lit(0)))
    met = hashed.join(before, F.col(cls).eqNullSafe(F.col("class__")) & (F.col("range__") == F.col("at__"))).withColumn("quota__", quota)
    sure = met.where(F.col("before__") + F.col("n__") <= F.col("quota__"))
    edge = met.where((F.col("before__") < F.col("quota__")) & (F.col("before__") + F.col("n__") > F.col("quota__")))
    ranked = edge.withColumn("rank__", F.row_number().over(Window.partitionBy(cls, "range__").orderBy("hash__", key)))
    return sure.select(*rows.columns).unionByName(ranked.where(F.col("before__") + F.col("rank__") <= F.col("quota__")).select(*rows.columns))
