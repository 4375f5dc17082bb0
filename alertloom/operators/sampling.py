"""Samples that repeat: by the order of a hash of id and seed, not of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.operators.ranges import first_by_hash


def hash_order(key: str, seed: int) -> Column:
    return F.sha1(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def sample_rows(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """min(n, all) rows."""
    return rows.orderBy(hash_order(key, seed), key).limit(n)


def _per_class(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(F.col(label).alias("l__")).agg(F.count("*").alias("n__"))


def undersample(rows: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    """As many rows of each class as the smallest has."""
    least = _per_class(rows, label).agg(F.min("n__").alias("least__")).withColumn("k__", F.lit(1))
    sized = rows.withColumn("k__", F.lit(1)).join(F.broadcast(least), "k__").drop("k__")
    return first_by_hash(sized, label, F.col("least__"), hash_order(key, seed), key).select(*rows.columns)


def guided(rows: DataFrame, label: str, inlier: str, key: str, seed: int = 0) -> DataFrame:
    """All positives, and as many negatives: half inliers, half outliers, each as far as there are."""
    positives = rows.where(F.col(label) == 1)
    n = positives.agg(F.count("*").alias("n__")).select(F.ceil(F.col("n__") / 2).alias("in__"), F.floor(F.col("n__") / 2).alias("out__"), F.lit(1).alias("k__"))
    negatives = rows.where(F.col(label) == 0).withColumn("k__", F.lit(1)).join(F.broadcast(n), "k__").drop("k__")
    quota = F.when(F.col(inlier), F.col("in__")).otherwise(F.col("out__"))
    return positives.unionByName(first_by_hash(negatives, inlier, quota, hash_order(key, seed), key).select(*rows.columns))


def class_weight(rows: DataFrame, label: str) -> DataFrame:
    return rows.agg(F.try_divide(F.count_if(F.col(label) == 0).cast("double"), F.count_if(F.col(label) == 1)).alias("scale_pos_weight"))


def quantile_edges(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """Interior exact quantiles, distinct, below the maximum: (edge)."""
    points = [i / bins for i in range(1, bins)]
    q = rows.agg(F.percentile(value, F.array(*[F.lit(p) for p in points])).alias("q"), F.max(value).alias("m"))
    return q.select(F.explode(F.array_distinct("q")).alias("edge"), "m").where("edge < m").select("edge")
