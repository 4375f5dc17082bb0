"""Reports over patterns, rules and results: funnels, diagnoses, summaries, joins to dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(rows: DataFrame, dimension: DataFrame, key: str, value: str) -> DataFrame:
    """Adds a dimension's value; fails at run time where a key is missing. Of repeated keys the smallest value counts."""
    d = dimension.groupBy(F.col(key).alias("k__")).agg(F.min(value).alias(value))
    missing = F.raise_error(F.concat(F.lit(f"no {value} for "), F.col(key).cast("string"))).cast(d.schema[value].dataType)
    return rows.join(d, F.col(key) == F.col("k__"), "left").withColumn(value, F.when(F.col("k__").isNull(), missing).otherwise(F.col(value))).drop("k__")


def context_sequences(events: DataFrame, n: int, timeout: int) -> DataFrame:
    """Adds context: up to n signatures before an event on the same host, within a timeout."""
    order = Window.partitionBy("host").orderBy("time", "row_id").rowsBetween(-n, -1)
    before = F.collect_list(F.struct("time", "signature")).over(order)
    return events.withColumn("context", F.transform(F.filter(before, lambda x: x["time"] >= F.col("time") - timeout), lambda x: x["signature"]))


def delta_grid(low: int = -7, high: int = 13, bases: tuple[float, ...] = (1.0, 1.5)) -> Column:
    """Array of gap lengths base * 2**i."""
    powers = F.transform(F.sequence(F.lit(low), F.lit(high)), lambda i: F.pow(F.lit(2.0), i))
    grids = [F.zip_with(powers, F.array_repeat(F.lit(b), high - low + 1), lambda x, y: x * y) for b in bases]
    return F.concat(*grids)


def best_per_key(rows: DataFrame, key: str, score: Column, tie: str) -> DataFrame:
    """One row a key: the best score, then the smallest tie-breaker."""
    return rows.withColumn("r__", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), tie))).where("r__ = 1").drop("r__")


def top_per_class(rows: DataFrame, cls: str, order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("r__", F.row_number().over(Window.partitionBy(cls).orderBy(*order))).where(F.col("r__") <= n).drop("r__")


def lean(diff: Column, threshold: float) -> Column:
    return F.when(diff >= threshold, "attack").when(diff <= -threshold, "benign").otherwise("neutral")


def funnel(rows: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """How many rows pass each stage and all stages before it."""
    passed, out = F.lit(True), [F.count("*").alias("mined")]
    for name, test in stages.items():
        passed &= F.coalesce(test, F.lit(False))
        out.append(F.count_if(passed).alias(name))
    return rows.agg(*out)


def equivalence(firing: DataFrame, carried: DataFrame, least: float = 0.9) -> DataFrame:
    """Best Jaccard of each feature's firing groups with any signature's groups: (feature, gid), (gid, signature)."""
    f = firing.select("feature", F.col("gid").alias("g__")).distinct()
    c = carried.select("gid", "signature").distinct()
    nf, nc = f.groupBy(F.col("feature").alias("a__")).agg(F.count("*").alias("nf")), c.groupBy(F.col("signature").alias("b__")).agg(F.count("*").alias("nc"))
    shared = f.join(c, F.col("g__") == F.col("gid")).groupBy("feature", "signature").agg(F.count("*").alias("n"))
    joined = shared.join(nf, F.col("feature") == F.col("a__")).join(nc, F.col("signature") == F.col("b__"))
    scored = joined.select("feature", "signature", (F.col("n") / (F.col("nf") + F.col("nc") - F.col("n"))).alias("jaccard"))
    best = best_per_key(scored, "feature", F.round("jaccard", 12), "signature")
    return best.withColumn("equivalent", F.col("jaccard") >= least)


def seen_recall(scored: DataFrame, seen: DataFrame, key: str, threshold: float) -> DataFrame:
    """Recall over positives whose key occurs in training, and over those whose key doesn't."""
    known = seen.select(F.col(key).alias("k__")).distinct()
    rows = scored.where("y = 1").join(known, F.col(key) == F.col("k__"), "left")
    hit = (F.col("score") >= threshold).cast("double")
    return rows.agg(F.avg(F.when(F.col("k__").isNotNull(), hit)).alias("recall_seen"), F.avg(F.when(F.col("k__").isNull(), hit)).alias("recall_unseen"), F.count("k__").alias("n_seen"), (F.count("*") - F.count("k__")).alias("n_unseen"))


def coverage_by_direction(flagged: DataFrame, rows: DataFrame) -> DataFrame:
    """Share of rows and of attacks under a flagged value, per direction: flagged (field value, direction), rows (gid, y, item)."""
    met = rows.join(flagged.select(F.col("item").alias("i__"), "direction"), F.col("item") == F.col("i__")).select("gid", "y", "direction").distinct()
    totals = rows.select("gid", "y").distinct().agg(F.count("*").alias("n"), F.sum("y").alias("a")).withColumn("k__", F.lit(1))
    per = met.groupBy("direction").agg(F.count("*").alias("c"), F.sum("y").alias("ca")).withColumn("k__", F.lit(1)).join(F.broadcast(totals), "k__")
    return per.select("direction", (F.col("c") / F.col("n")).alias("share"), F.try_divide(F.col("ca"), F.col("a")).alias("attack_share"))


def pooled(rows: DataFrame, arm: str, seed: str, value: str, hits: str, positives: str) -> DataFrame:
    """Mean over steps per seed with recall pooled over them, then mean and deviation over seeds."""
    per = rows.groupBy(arm, seed).agg(F.avg(value).alias("v"), F.try_divide(F.sum(hits), F.sum(positives)).alias("r"))
    return per.groupBy(arm).agg(F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"), F.avg("r").alias("pooled_recall"), F.count("*").alias("n_seeds"))


def dropped_reasons(candidates: DataFrame, kept: DataFrame, growth: float, coverage: float) -> DataFrame:
    """Why a candidate was dropped: not discriminating, or too little covered."""
    gone = candidates.join(kept.select(F.col("pattern").alias("p__")), F.col("pattern") == F.col("p__"), "left_anti")
    flat = (F.col("growth_rate") < growth) & ((F.col("support_benign") == 0) | (F.col("growth_rate") > 1 / growth))
    return gone.select("pattern", F.when(flat, "not_discriminative").when(F.greatest("support_attack", "support_benign") < coverage, "low_coverage").otherwise("side_coverage").alias("reason"))


def set_delta(a: DataFrame, b: DataFrame, key: str, keys: list[str]) -> DataFrame:
    """Per group of keys: how many values only a has, only b has, and both have."""
    left, right = a.select(*keys, key).distinct().withColumn("a__", F.lit(1)), b.select(*keys, key).distinct().withColumn("b__", F.lit(1))
    joined = left.join(right, [*keys, key], "full")
    return joined.groupBy(*keys).agg(F.count_if(F.col("b__").isNull()).alias("only_a"), F.count_if(F.col("a__").isNull()).alias("only_b"), F.count_if(F.col("a__").isNotNull() & F.col("b__").isNotNull()).alias("both"))


def per_day(rows: DataFrame, flag: Column, time: str = "time") -> DataFrame:
    """Flagged rows a day over the span of the rows; null for a single moment."""
    days = (F.max(time) - F.min(time)) / 86_400
    return rows.agg(F.count_if(flag).alias("n_flagged"), F.when(days > 0, F.count_if(flag) / days).alias("per_day"))


def survivor_curve(rows: DataFrame, value: str, thresholds: list[float]) -> DataFrame:
    cut = rows.select(value, F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    return cut.groupBy("threshold").agg(F.count_if(F.col(value) >= F.col("threshold")).alias("n_survivors"))


def dynamic_predicates(stats: DataFrame, numeric: DataFrame) -> DataFrame:
    """Predicate ids of a deployed schema: items as they are, thresholds numbered by value per field and operator."""
    order = Window.partitionBy("field", "op").orderBy("value")
    many = F.count("*").over(Window.partitionBy("field", "op")) > 1
    name = F.concat(F.lit("num:"), "field", F.lit("_"), "op")
    numbered = numeric.select(F.when(many, F.concat(name, F.lit("#"), F.row_number().over(order).cast("string"))).otherwise(name).alias("predicate_id"))
    return stats.select(F.concat(F.lit("cat:"), "pattern").alias("predicate_id")).unionByName(numbered)


def routing(rows: DataFrame, score: str, threshold: float, alerts: str = "n_alerts") -> DataFrame:
    """Escalated and suppressed groups and alerts."""
    up = F.col(score) >= threshold
    return rows.agg(F.count_if(up).alias("escalated"), F.count_if(~up).alias("suppressed"), F.coalesce(F.sum(F.when(up, F.col(alerts))), F.lit(0)).alias("alerts_escalated"), F.coalesce(F.sum(F.when(~up, F.col(alerts))), F.lit(0)).alias("alerts_suppressed"))
