"""Exploration tables: signatures, labels, activity over time, concentration, hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.functions.tokens import BENIGN
from alertloom.operators.ranges import running, with_previous


def is_attack() -> Column:
    return F.coalesce(F.col("label") != BENIGN, F.lit(False))


def signature_classes(alerts: DataFrame) -> DataFrame:
    """Per signature: counts, attack rate in percent, class, active days and hours, first and last."""
    a, at = F.count_if(is_attack()), F.timestamp_seconds("time")
    return alerts.groupBy("signature").agg(
        F.count("*").alias("n"), a.alias("n_attack"), (F.count("*") - a).alias("n_benign"), (a * 100.0 / F.count("*")).alias("attack_pct"),
        F.when(a == 0, "benign").when(a == F.count("*"), "attack").otherwise("mixed").alias("cls"),
        F.countDistinct(F.to_date(at)).alias("active_days"), F.countDistinct(F.date_trunc("hour", at)).alias("active_hours"), F.min("time").alias("first_ts"), F.max("time").alias("last_ts"),
    )


def activity_by_bin(alerts: DataFrame, unit: str = "day") -> DataFrame:
    """Distinct active signatures per time bin, by class."""
    classes = signature_classes(alerts).select(F.col("signature").alias("s__"), "cls")
    active = alerts.select(F.date_trunc(unit, F.timestamp_seconds("time")).alias("bin"), "signature").distinct().join(classes, F.col("signature") == F.col("s__"))
    return active.groupBy(F.date_format("bin", "yyyy-MM-dd HH:mm:ss").alias("bin")).agg(*[F.count_if(F.col("cls") == c).alias(c) for c in ("benign", "attack", "mixed")], F.count("*").alias("total"))


def label_distribution(alerts: DataFrame) -> DataFrame:
    """Count, share of all and share of attacks per label."""
    per = alerts.groupBy("label").agg(F.count("*").alias("n"))
    whole = Window.partitionBy()
    attack = F.col("label") != BENIGN
    return per.select("label", "n", (F.col("n") * 100.0 / F.sum("n").over(whole)).alias("pct"), F.when(attack, F.col("n") * 100.0 / F.sum(F.when(attack, F.col("n"))).over(whole)).alias("attack_pct"))


def attacks_per_period(alerts: DataFrame, unit: str = "day") -> DataFrame:
    """Counts and attack rate per period, and whether both classes occur."""
    a = F.count_if(is_attack())
    return alerts.groupBy(F.date_format(F.date_trunc(unit, F.timestamp_seconds("time")), "yyyy-MM-dd HH:mm:ss").alias("period")).agg(
        F.count("*").alias("n"), a.alias("n_attack"), (a / F.count("*")).alias("attack_rate"), ((a > 0) & (a < F.count("*"))).alias("both_classes")
    )


def overview(alerts: DataFrame) -> DataFrame:
    a = F.count_if(is_attack())
    return alerts.agg(
        F.count("*").alias("n"), a.alias("n_attack"), (a * 100.0 / F.count("*")).alias("attack_pct"), F.countDistinct("host").alias("hosts"), F.countDistinct("signature").alias("signatures"), (F.max("time") - F.min("time")).alias("duration")
    )


def concentration(alerts: DataFrame, key: str, share: float = 0.9, top: int = 3) -> DataFrame:
    """Share of the top values of a field, and how many values make up a share of all rows."""
    per = alerts.groupBy(key).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("c")).withColumn("rows", F.col("n") * F.col("c"))
    # Values of the same count are one point: before_c values and before_rows rows come ahead of it.
    points = running(per, "n", ["c", "rows"], descending=True)
    taken = F.greatest(F.least("c", F.lit(top) - F.col("before_c")), F.lit(0)) * F.col("n")
    lacking = F.lit(share) * F.col("total_rows") - F.col("before_rows")
    reached = F.when(lacking <= F.col("rows"), F.col("before_c") + F.greatest(F.ceil(lacking / F.col("n") - 1e-9), F.lit(1)))
    return points.agg((F.sum(taken) / F.max("total_rows")).alias("top_share"), F.min(reached).cast("int").alias("n_for_share"), F.max("total_c").alias("n_values"))


def temporal_concentration(alerts: DataFrame, bins: int = 1000, shares: tuple[float, ...] = (0.01, 0.05, 0.1)) -> DataFrame:
    """Share of attacks in the busiest bins of equal width, and the largest deviation from an even spread."""
    times = alerts.where(is_attack()).select("time")
    ends = alerts.agg(F.min("time").alias("lo"), F.max("time").alias("hi")).withColumn("k__", F.lit(1))
    binned = times.withColumn("k__", F.lit(1)).join(F.broadcast(ends), "k__")
    number = F.least(F.floor((F.col("time") - F.col("lo")) * bins / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))), F.lit(bins - 1))
    per = binned.groupBy(number.alias("bin")).agg(F.count("*").alias("n"))
    ranked = per.select("bin", "n", F.row_number().over(Window.orderBy(F.desc("n"), "bin")).alias("r"), F.sum("n").over(Window.partitionBy()).alias("t"), F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)).alias("c"))
    tops = [(F.sum(F.when(F.col("r") <= max(1, int(s * bins)), F.col("n"))) / F.max("t")).alias(f"busiest_{int(s * 100)}pct") for s in shares]
    return ranked.agg(F.max(F.abs(F.col("c") / F.col("t") - (F.col("bin") + 1) / bins)).alias("max_deviation"), *tops)


def host_summary(alerts: DataFrame, top: int = 5) -> DataFrame:
    """Per host: counts, its most frequent codes, median gap between alerts."""
    codes = alerts.groupBy("host", "short").agg(F.count("*").alias("n"))
    ranked = codes.withColumn("r", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "short"))).where(F.col("r") <= top)
    tops = ranked.groupBy(F.col("host").alias("h__")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "short"))), lambda x: x["short"]), ",").alias("top_codes"))
    per = with_previous(alerts, ["host"]).withColumn("gap", F.col("time") - F.col("previous__")).groupBy("host").agg(F.count("*").alias("n"), F.count_if(is_attack()).alias("n_attack"), F.percentile("gap", 0.5).alias("median_gap"))
    return per.join(tops, F.col("host") == F.col("h__")).drop("h__")


def purity(rows: DataFrame, fields: list[str], min_count: int = 1) -> DataFrame:
    """Per field and value: rows, attacks, rate, purity, direction and lift over the base rate."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    long = rows.select("y", pairs.alias("p")).select("y", "p.field", "p.value")
    per = long.groupBy("field", "value").agg(F.count("*").alias("n"), F.sum("y").alias("attacks")).where(F.col("n") >= min_count)
    w = Window.partitionBy("field")
    rate, base = F.col("attacks") / F.col("n"), F.sum("attacks").over(w) / F.sum("n").over(w)
    return per.select("field", "value", "n", "attacks", rate.alias("rate"), F.greatest(rate, 1 - rate).alias("purity"), F.when(rate >= 0.5, "attack").otherwise("benign").alias("direction"), F.try_divide(rate, base).alias("lift"))


def local_rates(rows: DataFrame, field: str) -> DataFrame:
    """Attack rate per value, and how far it is from the base rate; null is a value."""
    per = rows.groupBy(field).agg(F.count("*").alias("support"), F.sum("y").alias("attacks"))
    whole = Window.partitionBy()
    rate = F.col("attacks") / F.col("support")
    return per.select(F.col(field).alias("value"), "support", rate.alias("rate"), (rate - F.sum("attacks").over(whole) / F.sum("support").over(whole)).alias("deviation"))
