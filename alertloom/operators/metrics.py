"""Evaluation metrics from scored rows (y: 0 or 1, score: double), exact and without sorting everything in one task.

Everything is computed from counts by distinct score. Running sums over
distinct scores are taken within ranges that hold about as many scores each and
offset by the ranges' totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.operators.ranges import running


def by_score(rows: DataFrame) -> DataFrame:
    """Per distinct score: positives and negatives at it, and at or above it (tp, fp)."""
    points = rows.groupBy("score").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n"))
    summed = running(points, "score", ["p", "n"], descending=True)
    return summed.select("score", "p", "n", (F.col("p") + F.col("before_p")).alias("tp"), (F.col("n") + F.col("before_n")).alias("fp"), F.col("total_p").alias("pos"), F.col("total_n").alias("neg"))


def roc_auc(rows: DataFrame) -> DataFrame:
    """Mann-Whitney AUC; ties count half; null for a single class."""
    won = F.sum(F.col("n") * (F.col("tp") - F.col("p")) + F.col("n") * F.col("p") * 0.5)
    return by_score(rows).agg(F.try_divide(won, F.max("pos") * F.max("neg")).alias("auc"), F.max("pos").alias("n_pos"), F.max("neg").alias("n_neg"))


def average_precision(rows: DataFrame) -> DataFrame:
    """Sum of recall steps times precision, equal scores as one block; null without positives."""
    return by_score(rows).agg(F.try_divide(F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.max("pos")).alias("average_precision"))


def confusion(rows: DataFrame, threshold: float) -> DataFrame:
    """Counts, precision, recall, F1, accuracy and false-positive rate at a threshold."""
    hit = F.col("score") >= threshold
    t = rows.agg(
        F.count_if(hit & (F.col("y") == 1)).alias("tp"), F.count_if(hit & (F.col("y") == 0)).alias("fp"), F.count_if(~hit & (F.col("y") == 1)).alias("fn"), F.count_if(~hit & (F.col("y") == 0)).alias("tn")
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return t.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(fp, fp + tn).alias("fpr"))


def workload_at_recall(rows: DataFrame, targets: list[float]) -> DataFrame:
    """Per recall target: the highest threshold that reaches it, its confusion, and the share of rows below it."""
    points = by_score(rows).select("*", F.explode(F.array(*[F.lit(t) for t in targets])).alias("target"))
    ok = points.where(F.col("tp") >= (F.col("target") - 1e-9) * F.col("pos"))
    best = ok.groupBy("target").agg(F.max_by(F.struct("score", "tp", "fp", "pos", "neg"), "score").alias("b")).select("target", "b.*")
    n = F.col("pos") + F.col("neg")
    return best.select("target", F.col("score").alias("threshold"), "tp", "fp", (F.col("pos") - F.col("tp")).alias("fn"), (F.col("neg") - F.col("fp")).alias("tn"), ((n - F.col("tp") - F.col("fp")) / n).alias("workload_reduction"))


def psi(expected: Column, observed: Column, eps: float = 1e-6) -> Column:
    """Population stability index of a rate, in two buckets."""
    clip = lambda x: F.least(F.greatest(x, F.lit(eps)), F.lit(1 - eps))
    e, o = clip(expected), clip(observed)
    return (o - e) * F.log(o / e) + ((1 - o) - (1 - e)) * F.log((1 - o) / (1 - e))


def effect_size(eta2: Column) -> Column:
    return F.when(eta2.isNull(), "n/a").when(eta2 >= 0.14, "large").when(eta2 >= 0.06, "medium").when(eta2 >= 0.01, "small").otherwise("negligible")


def anova(rows: DataFrame, factor: str, value: str) -> DataFrame:
    """One-way analysis of variance: eta squared, F, and the range of level means."""
    levels = rows.groupBy(factor).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    total = levels.select("*", (F.sum(F.col("n") * F.col("m")).over(Window.partitionBy()) / F.sum("n").over(Window.partitionBy())).alias("grand"))
    s = total.agg(F.sum(F.col("n") * (F.col("m") - F.col("grand")) ** 2).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"), F.count("*").alias("levels"), F.sum("n").alias("n"), (F.max("m") - F.min("m")).alias("effect_range"))
    many = F.col("levels") > 1
    eta = F.when(many, F.try_divide(F.col("between"), F.col("between") + F.col("within")))
    f = F.when(many, F.try_divide(F.col("between") / (F.col("levels") - 1), F.try_divide(F.col("within"), F.col("n") - F.col("levels"))))
    return s.select("levels", eta.alias("eta2"), f.alias("f"), "effect_range", effect_size(eta).alias("effect"))


def main_effects(rows: DataFrame, factor: str, value: str) -> DataFrame:
    return rows.groupBy(factor).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count(value).alias("n"))


def contingency(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Counts by pair with both margins and the total; nulls left out."""
    cells = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count("*").alias("n"))
    over = lambda *k: F.sum("n").over(Window.partitionBy(*k))
    return cells.select("n", over(x).alias("nx"), over(y).alias("ny"), over().alias("total"), F.col(x).alias("x"), F.col(y).alias("y"))


def cramers_v(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Association of two fields, without bias correction; null below two levels."""
    c = contingency(rows, x, y).agg(F.sum(F.col("n") * F.col("n") / (F.col("nx") * F.col("ny"))).alias("s"), F.countDistinct("x").alias("kx"), F.countDistinct("y").alias("ky"))
    return c.select(F.when(F.least("kx", "ky") > 1, F.sqrt(F.greatest(F.col("s") - 1, F.lit(0.0)) / (F.least("kx", "ky") - 1))).alias("cramers_v"))


def mutual_information(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Plug-in mutual information of two discrete fields, in nats."""
    return contingency(rows, x, y).agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny")))).alias("mutual_information"))


def average_ranks(rows: DataFrame, block: str, method: str, value: str) -> DataFrame:
    """Mean rank of each method over blocks, the best value first, ties averaged."""
    inside = Window.partitionBy(block)
    rank = F.rank().over(inside.orderBy(F.desc(value))) + (F.count("*").over(Window.partitionBy(block, value)) - 1) / 2
    return rows.withColumn("rank__", rank).groupBy(method).agg(F.avg("rank__").alias("average_rank"), F.count("*").alias("n_blocks"))


def summarize(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, deviation (0 for one row), bounds, variation and tenth percentile per configuration; null keys are kept."""
    std = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return rows.groupBy(*keys).agg(
        F.avg(value).alias("mean"), std.alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"), F.try_divide(std, F.avg(value)).alias("cv"), F.percentile(value, 0.1).alias("p10")
    )


def rank_configs(summary: DataFrame, weight: float = 1.0, band: float | None = None, size: str | None = None) -> DataFrame:
    """By mean minus weighted deviation; with a band, scores within one band tie and the smaller configuration wins."""
    scored = summary.withColumn("score", F.col("mean") - weight * F.col("std"))
    return scored.orderBy(F.desc(F.bround(F.col("score") / band)), F.col(size)) if band and size else scored.orderBy(F.desc("score"))
