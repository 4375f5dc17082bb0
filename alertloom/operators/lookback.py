"""Look-back sequences: what the same host saw before and during a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interval_join(groups: DataFrame, alerts: DataFrame, window: int, bucket: int | None = None) -> DataFrame:
    """Alerts of a group's host within [start - window, end], both ends included.

    Time is cut into buckets as wide as the window; a group meets the buckets
    that its span touches, an alert its own. The join is on host and bucket, so
    a busy host is split by time.
    """
    width = bucket or max(window, 1)
    begin, end = F.col("start_ts") - window, F.coalesce("end_ts", F.col("start_ts"))
    left = groups.select("gid", F.col("host").alias("of_host"), begin.alias("begin"), end.alias("finish"), F.explode(F.sequence(F.floor(begin / width), F.floor(end / width))).alias("bin"))
    right = alerts.select("host", "time", "row_id", "short", F.floor(F.col("time") / width).alias("at_bin"))
    return left.join(right, (F.col("of_host") == F.col("host")) & (F.col("bin") == F.col("at_bin")) & F.col("time").between(F.col("begin"), F.col("finish")))


def lookback_steps(groups: DataFrame, alerts: DataFrame, window: int = 600, step: int = 60) -> DataFrame:
    """Adds context_steps: distinct codes per time step, in order; empty where there are none.

    ``groups``: gid, host, start_ts, end_ts (several rows where a group has several hosts).
    """
    found = interval_join(groups, alerts, window).where("short is not null")
    steps = found.groupBy("gid", F.floor(F.col("time") / step).alias("step")).agg(F.array_sort(F.collect_set("short")).alias("codes"))
    ordered = steps.groupBy("gid").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "codes"))), lambda x: x["codes"]).alias("context_steps"))
    named = groups.select("gid").distinct()
    return named.join(ordered.withColumnRenamed("gid", "of__"), F.col("gid") == F.col("of__"), "left").select("gid", F.coalesce("context_steps", F.array().cast("array<array<string>>")).alias("context_steps"))


def hosts_of(items: Column) -> Column:
    """Hosts among a group's items."""
    return F.transform(F.filter(items, lambda t: t.startswith("host:")), lambda t: F.substring(t, F.lit(6), F.length(t)))


def novelty(test: DataFrame, train: DataFrame, *keys: str) -> DataFrame:
    """How many test rows, and distinct keys, have a key that training rows lack; nulls equal nulls."""
    from functools import reduce

    seen = train.select(*[F.col(k).alias(f"{k}__") for k in keys]).distinct()
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}__")) for k in keys])
    fresh = test.join(seen, on, "left_anti")
    return fresh.agg(F.count("*").alias("n_unseen"), F.countDistinct(F.struct(*keys)).alias("n_unseen_keys"))
