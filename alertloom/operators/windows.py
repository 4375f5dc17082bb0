"""Row-count windows, splits in time, phases and folds over ordered groups.

``rows`` are numbered (rn from 1, n_rows), see ``groups.numbered_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.operators.ranges import with_previous, with_runs


def with_windows(rows: DataFrame, granularity: float) -> DataFrame:
    """Adds win_idx: windows of max(1, int(g*n)) rows; the last takes the rest."""
    size = F.greatest(F.lit(1), F.floor(F.lit(granularity) * F.col("n_rows")))
    count = F.greatest(F.lit(1), F.floor(F.col("n_rows") / size))
    return rows.withColumn("win_idx", F.least(F.floor((F.col("rn") - 1) / size), count - 1).cast("bigint"))


def train_end(start: Column, end: Column, fraction: float) -> Column:
    """Where a window's training part ends: half-even rounding, at least one row on each side."""
    return F.least(F.greatest(start + F.bround((end - start) * fraction), start + 1), end - 1).cast("bigint")


def window_bounds(windowed: DataFrame, fraction: float = 0.7) -> DataFrame:
    """Per window: first and one-past-last row number from 0, and the end of its training part."""
    bounds = windowed.groupBy("win_idx").agg(F.min(F.col("rn") - 1).alias("start"), F.max("rn").alias("end"), F.min("start_ts").alias("first_ts"), F.max("start_ts").alias("last_ts"))
    return bounds.withColumn("train_end", train_end(F.col("start"), F.col("end"), fraction))


def holdout(rows: DataFrame, fraction: float = 0.3) -> DataFrame:
    """Adds part: train for the first int((1-f)*n) rows, else test."""
    return rows.withColumn("part", F.when(F.col("rn") <= F.floor((1 - F.lit(fraction)) * F.col("n_rows")), "train").otherwise("test"))


def walk_forward(windowed: DataFrame) -> DataFrame:
    """Pairs of neighbouring windows: train on i, test on i+1, with their counts."""
    per = windowed.groupBy("win_idx").agg(F.count("*").alias("n"), F.count_if(F.col("group_label") == "attack").alias("attacks"))
    following = per.select((F.col("win_idx") - 1).alias("before"), F.col("n").alias("n_test"), F.col("attacks").alias("attacks_test"))
    return per.join(following, F.col("win_idx") == F.col("before")).select(
        F.col("win_idx").alias("train_idx"), (F.col("win_idx") + 1).alias("test_idx"), F.col("n").alias("n_train"), F.col("attacks").alias("attacks_train"), "n_test", "attacks_test"
    )


def valid_split(rows: DataFrame, fraction: float = 0.7) -> DataFrame:
    """The split (rows before it) nearest to the target that leaves both classes on both sides, the lower of two as near.

    Rows before the split hold both classes from the later of the classes' first
    rows on; rows after it, up to the earlier of their last rows. So four minima
    and maxima decide, and no running counts are needed.
    """
    attack = F.col("group_label") == "attack"
    edges = rows.where(F.col("group_label").isin("attack", "benign")).agg(
        F.min(F.when(attack, F.col("rn"))).alias("a0"), F.max(F.when(attack, F.col("rn"))).alias("a1"),
        F.min(F.when(~attack, F.col("rn"))).alias("b0"), F.max(F.when(~attack, F.col("rn"))).alias("b1"), F.max("n_rows").alias("n"),
    )
    low = F.greatest("a0", "b0", F.lit(2))
    high = F.least(F.col("a1") - 1, F.col("b1") - 1, F.col("n") - 2)
    target = F.floor(F.col("n") * fraction)
    return edges.select(F.when(low <= high, F.least(F.greatest(target, low), high)).cast("bigint").alias("split"), target.alias("target"), F.col("n").alias("n_rows"))


def single_class(rows: DataFrame, fraction: float = 0.7) -> DataFrame:
    """Whether the head or the tail holds fewer than two classes."""
    head = F.col("rn") <= F.floor(F.col("n_rows") * fraction)
    return rows.agg(
        (F.countDistinct(F.when(head, F.col("group_label"))) < 2).alias("head_single"), (F.countDistinct(F.when(~head, F.col("group_label"))) < 2).alias("tail_single")
    )


def islands(rows: DataFrame, keys: list[str], time: str, gap: int, strict: bool = True, tie: str = "row_id") -> DataFrame:
    """Runs of rows per key whose neighbours are at most ``gap`` apart (below it, if not strict), with bounds and counts."""
    numbered = with_runs(rows, keys, gap, time, tie, strict, width=max(86_400, gap)).withColumnRenamed("run__", "island")
    return numbered.groupBy(*keys, "island").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"))


def streams(rows: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Streams split at gaps of ``gap`` or more, with their rate per second."""
    return islands(rows, keys, "time", gap, strict=False).withColumn("rate", F.try_divide(F.col("n").cast("double"), F.greatest(F.col("end") - F.col("start"), F.lit(1))))


def inter_arrival(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows but the first of each key, with the time since the row before."""
    return with_previous(rows, keys).where("previous__ is not null").withColumn("gap", F.col("time") - F.col("previous__")).drop("previous__")


def phase_cuts(phases: DataFrame, keys: list[str]) -> DataFrame:
    """Midpoints between neighbouring phases."""
    order = Window.partitionBy(*keys).orderBy("start")
    return phases.withColumn("cut", (F.lag("end").over(order) + F.col("start")) / 2).where("cut is not null").select(*keys, "island", "cut")


def phase_folds(rows: DataFrame, phases: DataFrame, keys: list[str]) -> DataFrame:
    """Expanding folds: rows before a phase's cut train, rows from it to the next cut test; counted.

    Each row is counted once, under the number of its key's cuts up to it.
    """
    cuts = phase_cuts(phases, keys).groupBy(*[F.col(k).alias(f"{k}__") for k in keys]).agg(F.array_sort(F.collect_list("cut")).alias("cuts__"))
    on = [F.col(k) == F.col(f"{k}__") for k in keys]
    part = F.size(F.filter("cuts__", lambda c: c <= F.col("time")))
    counts = rows.join(cuts, on).groupBy(*keys, part.alias("part__")).agg(F.count("*").alias("n__"))
    grid = cuts.select(*[f"{k}__" for k in keys], F.posexplode(F.concat(F.array(F.lit(None).cast("double")), "cuts__")).alias("at__", "cut"))
    met = grid.join(counts, [F.col("at__") == F.col("part__"), *on], "left").withColumn("n_test", F.coalesce("n__", F.lit(0)))
    upto = Window.partitionBy(*[f"{k}__" for k in keys]).orderBy("at__").rowsBetween(Window.unboundedPreceding, -1)
    summed = met.withColumn("n_train", F.coalesce(F.sum("n_test").over(upto), F.lit(0))).where("at__ > 0")
    return summed.select(*[F.col(f"{k}__").alias(k) for k in keys], "cut", "n_train", "n_test")


def leave_one_out(rows: DataFrame, key: str) -> DataFrame:
    """Folds that hold out one value of a key each: rows in and out of it, from one count a value."""
    per = rows.groupBy(F.col(key).alias("held_out")).agg(F.count("*").alias("n_test"))
    return per.select("held_out", (F.sum("n_test").over(Window.partitionBy()) - F.col("n_test")).alias("n_train"), "n_test")


def sliding(rows: DataFrame, width: int, step: int) -> DataFrame:
    """A row for each half-open window [w, w+width) that holds it, windows starting at multiples of ``step``."""
    first = F.ceil((F.col("time") - width + 1) / step)
    return rows.withColumn("window_start", F.explode(F.transform(F.sequence(first, F.floor(F.col("time") / step)), lambda k: k * step)))


def effective_start(start: Column, split: Column, n: Column, fraction: float) -> Column:
    return F.greatest(start, split - F.floor(n * fraction))
