"""Building groups from grouped alerts, their labels, and statistics over groupings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.functions.tokens import BENIGN, feature_tokens

LABELS = {"benign": 0, "attack": 1}


def label_of(labels: Column, when_empty: str | None = None) -> Column:
    """Label of a group from its alerts' labels: mixed where both kinds occur."""
    attack, benign = F.exists(labels, lambda x: x != BENIGN), F.exists(labels, lambda x: x == BENIGN)
    out = F.when(attack & benign, "mixed").when(attack, "attack").when(benign, "benign")
    return out if when_empty is None else out.otherwise(when_empty)


def label_aggregate(label: Column, when_empty: str | None = None) -> Column:
    """The same as an aggregate, without collecting the labels."""
    attack, benign = F.coalesce(F.bool_or(label != BENIGN), F.lit(False)), F.coalesce(F.bool_or(label == BENIGN), F.lit(False))
    out = F.when(attack & benign, "mixed").when(attack, "attack").when(benign, "benign")
    return out if when_empty is None else out.otherwise(when_empty)


def with_tokens(alerts: DataFrame) -> DataFrame:
    """Adds tokens: short, host and the signature's letter runs."""
    letters = F.regexp_extract_all(F.lower(F.coalesce("signature", F.lit(""))), F.lit("([a-z]+)"), F.lit(1))
    return alerts.withColumn("tokens", feature_tokens(F.col("short"), F.col("host"), letters))


def build_groups(tokenised: DataFrame) -> DataFrame:
    """One row a group: bounds, count, label, item union, ordered token sets, addresses and labels."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct("time", "row_id", "tokens"))), lambda x: x["tokens"])
    return tokenised.groupBy("group_id", "method").agg(
        F.min("time").alias("start_ts"),
        F.max("time").alias("end_ts"),
        F.count("*").alias("n_alerts"),
        label_aggregate(F.col("label")).alias("group_label"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tokens")))).alias("raw_items"),
        steps.alias("sorted_items"),
        F.array_sort(F.collect_set("ip")).alias("alert_ips"),
        F.array_sort(F.collect_set("label")).alias("alert_labels"),
    ).withColumn("status", F.lit("closed")).withColumn("weight", F.lit(1.0))


def summaries(grouped: DataFrame) -> DataFrame:
    """The scalar part of ``build_groups``: nothing is collected."""
    return grouped.groupBy("group_id").agg(
        F.min("time").alias("start_ts"), F.max("time").alias("end_ts"), F.count("*").alias("n_alerts"), label_aggregate(F.col("label")).alias("group_label")
    )


def labelled(groups: DataFrame) -> DataFrame:
    return groups.where(F.col("group_label").isin(*LABELS))


def label_number(label: Column) -> Column:
    return F.when(label == "benign", 0).when(label == "attack", 1)


def prepare(groups: DataFrame) -> DataFrame:
    """Items trimmed and not blank; groups without items or label go."""
    tidy = F.array_sort(F.array_distinct(F.filter(F.transform("raw_items", lambda x: F.trim(x)), lambda x: x != "")))
    return groups.withColumn("raw_items", tidy).where((F.size("raw_items") > 0) & F.col("group_label").isNotNull())


def mixed_as_attack(groups: DataFrame) -> DataFrame:
    return groups.withColumn("group_label", F.when(F.col("group_label") == "mixed", "attack").otherwise(F.col("group_label")))


def grouping_metrics(grouped: DataFrame) -> DataFrame:
    """One row about a grouping: reduction, sizes, purities, diversity, spans and minority exposure.

    Counts are of alert rows. A missing label counts as attack.
    """
    attack = (F.coalesce("label", F.lit("")) != BENIGN).cast("int")
    g = grouped.groupBy("group_id").agg(
        F.count("*").alias("n"),
        F.sum(attack).alias("attacks"),
        F.countDistinct("host").alias("hosts"),
        F.greatest(F.countDistinct("signature"), F.lit(1)).alias("signatures"),
        (F.max("time") - F.min("time")).alias("span"),
    )
    mixed = (F.col("attacks") > 0) & (F.col("attacks") < F.col("n"))
    share = lambda c: F.avg(c.cast("double"))
    median = lambda c: F.percentile(c, 0.5)
    return g.agg(
        F.count("*").alias("n_groups"),
        F.sum("n").alias("n_alerts"),
        (1 - F.count("*") / F.sum("n")).alias("volume_reduction"),
        F.avg("n").alias("size_mean"),
        median("n").alias("size_median"),
        F.max("n").alias("size_max"),
        share(F.col("attacks") == 0).alias("pure_benign"),
        share(F.col("attacks") == F.col("n")).alias("pure_attack"),
        share(mixed).alias("mixed"),
        share(F.col("hosts") <= 1).alias("host_purity"),
        F.avg("signatures").alias("signatures_mean"),
        F.max("signatures").alias("signatures_max"),
        F.avg("span").alias("span_mean"),
        median("span").alias("span_median"),
        F.max("span").alias("span_max"),
        F.coalesce(F.try_divide(F.sum(F.when(mixed, F.least("attacks", F.col("n") - F.col("attacks")))), F.sum(F.when(mixed, F.col("n")))), F.lit(0.0)).alias("minority_exposure"),
    )


def coverage(records: DataFrame) -> DataFrame:
    """Share of records that are no outliers, and the rest."""
    covered = F.count_if(~F.coalesce("is_outlier", F.lit(False))) / F.count("*")
    return records.agg(covered.alias("coverage"), (1 - covered).alias("ungroupable"))


def code_properties(grouped: DataFrame) -> DataFrame:
    """Shares of mixed and of ambiguous attack groups: those whose codes all occur in benign groups too."""
    attack = F.coalesce("label", F.lit("")) != BENIGN
    groups = grouped.groupBy("group_id").agg(F.bool_or(attack).alias("a"), F.bool_or(~attack).alias("b"))
    kinds = groups.select(F.col("group_id").alias("of__"), F.when(F.col("a") & F.col("b"), "mixed").when(F.col("a"), "attack").otherwise("benign").alias("kind"))
    codes = grouped.select("group_id", "short").distinct().join(kinds, F.col("group_id") == F.col("of__"))
    seen = codes.where("kind = 'benign'").select(F.col("short").alias("seen__")).distinct()
    attacks = codes.where("kind = 'attack'").join(seen, F.col("short") == F.col("seen__"), "left")
    ambiguous = attacks.groupBy("group_id").agg(F.bool_and(F.col("seen__").isNotNull()).alias("all_seen"))
    left = kinds.agg(F.count("*").alias("n_groups"), F.avg((F.col("kind") == "mixed").cast("double")).alias("mixed_share"), F.avg((F.col("kind") == "attack").cast("double")).alias("attack_share"))
    right = ambiguous.agg(F.avg(F.col("all_seen").cast("double")).alias("ambiguous_attack_share"))
    return left.withColumn("k", F.lit(1)).join(right.withColumn("k", F.lit(1)), "k").drop("k")


def split_stats(groups: DataFrame, fraction: float = 0.7) -> DataFrame:
    """Counts in the first int(n * fraction) groups by time and in the rest; mixed counts as positive."""
    numbered = numbered_rows(groups)
    part = F.when(F.col("rn") <= F.floor(F.col("n_rows") * fraction), "head").otherwise("tail")
    return numbered.groupBy(part.alias("part")).agg(
        F.count("*").alias("n"), F.count_if(F.col("group_label").isin("attack", "mixed")).alias("n_positive"), F.min("start_ts").alias("first_ts"), F.max("end_ts").alias("last_ts")
    )


def numbered_rows(rows: DataFrame, time: str = "start_ts", *ties: str, width: int = 600) -> DataFrame:
    """Adds rn (1, 2, ... by time and ties) and n_rows, without sorting everything in one task.

    Rows are numbered within buckets of time; a bucket's offset is the running
    sum of the counts before it. Only one row a bucket meets in a window. Ties
    must make the order total (by default group_id).
    """
    order = [time, *(ties or ("group_id",))]
    cut = rows.withColumn("bucket__", F.floor(F.col(time) / width))
    inside = cut.withColumn("own__", F.row_number().over(Window.partitionBy("bucket__").orderBy(*order)))
    sizes = cut.groupBy("bucket__").agg(F.count("*").alias("size__"))
    running = Window.orderBy("bucket__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("bucket__").alias("at__"), F.coalesce(F.sum("size__").over(running), F.lit(0)).alias("offset__"), F.sum("size__").over(Window.partitionBy()).alias("n_rows"))
    joined = inside.join(offsets, F.col("bucket__").eqNullSafe(F.col("at__")))
    return joined.select(*rows.columns, (F.col("own__") + F.col("offset__")).alias("rn"), "n_rows")
