"""Attribute features of a group: one builder for mining and for encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.functions.tokens import family, normalize_host, short_levels
from alertloom.operators.mining import long_items

#: Marks a similarity that doesn't apply.
NOT_APPLICABLE = -1.0
#: The protocol that a category implies.
CATEGORY_PROTOCOL = {"DNS": 17, "SNMP": 17, "NTP": 17, "WEB_SERVER": 6, "SMTP": 6, "FTP": 6}


def similarities(columns: list[str]) -> Column:
    """Similarity columns as a map; missing ones are left out."""
    pairs = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value"))) for c in columns]))
    return F.map_from_entries(pairs)


def missing_address(value: Column) -> Column:
    """'-1' and blank addresses are null."""
    return F.when(~value.isin("-1", ""), value)


def is_multiple(value: Column) -> Column:
    """A flag for fields that stand for several values: null, -1 or '-1'."""
    return F.coalesce(value.cast("string").isin("-1"), F.lit(True))


def cve_age(start_ts: Column, refs: Column) -> Column:
    """Years from the oldest reference to the group's start; null without references."""
    years = F.transform(refs, lambda r: F.substring(r, 5, 4).cast("int"))
    return F.year(F.timestamp_seconds(start_ts)) - F.array_min(years)


def proto_mismatch(category: Column, proto: Column) -> Column:
    """A known category whose protocol is known and another one."""
    expected = F.try_element_at(F.create_map(*[F.lit(x) for kv in CATEGORY_PROTOCOL.items() for x in kv]), category)
    return F.coalesce((proto != -1) & (proto != expected), F.lit(False))


def set_fields(items: Column) -> dict[str, Column]:
    """Set-valued fields of a group's items, with the codes' two coarser levels."""
    shorts = family(items, "short:")
    return {
        "short": shorts,
        "short_top": F.array_distinct(F.transform(shorts, lambda s: short_levels(s)[0])),
        "short_mid": F.array_distinct(F.transform(shorts, lambda s: short_levels(s)[1])),
        "sig": family(items, "sig:"),
        "host": F.array_distinct(F.transform(family(items, "host:"), normalize_host)),
    }


def candidate_features(groups: DataFrame, sims: list[str] | None = None) -> DataFrame:
    """Adds every candidate feature: set fields, protocol mismatch, reference age, and value and presence per similarity."""
    out = groups.withColumns(set_fields(F.col("raw_items")))
    if "category" in groups.columns and "proto" in groups.columns:
        out = out.withColumn("proto_mismatch", proto_mismatch(F.col("category"), F.col("proto")))
    if "cve_refs" in groups.columns:
        out = out.withColumn("cve_age", F.coalesce(cve_age(F.col("start_ts"), F.col("cve_refs")), F.lit(-1)))
    for s in sims or []:
        value = F.coalesce(F.try_element_at("attr_similarities", F.lit(s)), F.lit(NOT_APPLICABLE))
        out = out.withColumn(f"sim_{s}", value).withColumn(f"has_{s}", value != NOT_APPLICABLE)
    if sims:
        any_layer = F.lit(False)
        for s in sims:
            any_layer |= F.col(f"has_{s}")
        out = out.withColumn("has_any", any_layer)
    return out


def pregrouped_features(sims: list[str]) -> list[Column]:
    """Base and full columns of a pre-grouped row; missing values get their sentinels."""
    base = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("proto", "ext_port", "int_port")]
    return [*base, F.col("n_alerts"), F.coalesce("signature_matches_per_day", F.lit(0.0)).alias("signature_matches_per_day"), *[F.coalesce(F.try_element_at("attr_similarities", F.lit(s)), F.lit(NOT_APPLICABLE)).alias(s) for s in sims]]


def impute(rows: DataFrame, train: DataFrame, columns: list[str], sentinel: float = NOT_APPLICABLE) -> DataFrame:
    """Sentinels become the training rows' exact median of real values; a column without any becomes 0."""
    medians = train.agg(*[F.coalesce(F.percentile(F.when(F.col(c) != sentinel, F.col(c)), 0.5), F.lit(0.0)).alias(f"{c}__m") for c in columns]).withColumn("k__", F.lit(1))
    joined = rows.withColumn("k__", F.lit(1)).join(F.broadcast(medians), "k__")
    return joined.select(*[F.when(F.col(c) == sentinel, F.col(f"{c}__m")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def bin_items(rows: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    """(gid, group_label, item): the half-open bin (lo, hi] that a value lies in, from a table of edges."""
    ordered = F.array_sort(F.collect_list("edge"))
    table = edges.agg(ordered.alias("edges")).withColumn("k__", F.lit(1))
    joined = rows.withColumn("k__", F.lit(1)).join(F.broadcast(table), "k__")
    below = F.filter("edges", lambda e: e < F.col(value))
    above = F.filter("edges", lambda e: e >= F.col(value))
    name = lambda x, other: F.coalesce(F.round(x, 6).cast("string"), F.lit(other))
    low, high = F.try_element_at(below, F.lit(-1)), F.try_element_at(above, F.lit(1))
    return joined.where(F.col(value).isNotNull()).select("gid", "group_label", F.concat(F.lit(f"{value}:("), name(low, "-inf"), F.lit(","), name(high, "inf"), F.lit("]")).alias("item"))


def item_table(groups: DataFrame, binned: DataFrame) -> DataFrame:
    """Long items of baskets and bins together."""
    return long_items(groups).unionByName(binned).distinct()
