"""Adapters from the supplied tables to alerts and baskets, and file scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.schemas import RAW_ALERT


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts from ``events``: a user is a host, an event type a signature, errors are attacks."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"),
        F.floor(F.unix_micros(ts) / 1_000_000).cast("bigint").alias("time"),
        F.col("event_type").alias("signature"),
        F.lit(None).cast("string").alias("ip"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("host"),
        F.concat(F.upper(F.substring("event_type", 1, 1)), F.lit("-"), F.col("event_type")).alias("short"),
        F.when(F.col("event_type") == "error", "attack").otherwise("false_positive").alias("label"),
        F.col("value"),
    )


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A basket per order: items brand, type and size class of its parts; attack where a line was returned."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    size = F.when(F.col("p_size") <= 15, "small").when(F.col("p_size") <= 35, "medium").otherwise("large")
    items = F.array(F.concat(F.lit("brand:"), "p_brand"), F.concat(F.lit("type:"), "p_type"), F.concat(F.lit("size:"), size))
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select("l_orderkey", "l_returnflag", items.alias("of_part"))
        .groupBy("l_orderkey")
        .agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("of_part")))).alias("items"),
            F.max((F.col("l_returnflag") == "R").cast("int")).alias("is_attack"),
            F.count("*").alias("n_lines"),
        )
        .select(F.col("l_orderkey").alias("gid"), "items", F.when(F.col("is_attack") == 1, "attack").otherwise("benign").alias("group_label"), "n_lines")
    )


def read_alert_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV of alerts under the legacy names ``name`` and ``time_label``; the count of bad rows is ``_bad`` per row."""
    raw = spark.read.option("header", True).schema(
        "time string, name string, ip string, host string, short string, time_label string, event_label string, _corrupt_record string"
    ).csv(path, mode="PERMISSIVE")
    return raw.select(
        F.col("time"), F.col("name").alias("signature"), "ip", "host", "short", F.col("time_label").alias("label"), "event_label", F.col("_corrupt_record").isNotNull().alias("_bad")
    )


def read_alert_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """JSON alerts, an array or one per line, under the current or the legacy names."""
    raw = spark.read.option("multiLine", multi_line).schema(RAW_ALERT + ", name string, time_label string").json(path)
    return raw.select("time", F.coalesce("signature", "name").alias("signature"), "ip", "host", "short", F.coalesce("label", "time_label").alias("label"), "event_label")


def write_encoded(df: DataFrame, path: str) -> None:
    """Encoded features as Parquet and CSV; ``+`` and ``/`` in column names become ``_``."""
    safe = df.toDF(*[c.replace("+", "_").replace("/", "_") for c in df.columns])
    safe.write.mode("overwrite").parquet(f"{path}/parquet")
    safe.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
