"""Models, comparisons and reports over results tables."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.operators.ranges import running


def balanced_weight(rows: DataFrame, label: str = "y") -> DataFrame:
    """Adds weight: rows of both classes weigh the same in sum."""
    sizes = rows.groupBy(F.col(label).alias("l__")).agg(F.count("*").alias("n__"))
    total = sizes.select("l__", (F.sum("n__").over(Window.partitionBy()) / (2.0 * F.col("n__"))).alias("weight"))
    return rows.join(F.broadcast(total), F.col(label) == F.col("l__")).drop("l__")


MODELS = {
    "logreg": lambda n: LogisticRegression(labelCol="y", weightCol="weight", maxIter=50),
    "logreg_l1": lambda n: LogisticRegression(labelCol="y", weightCol="weight", maxIter=50, elasticNetParam=1.0, regParam=0.01),
    "rf": lambda n: RandomForestClassifier(labelCol="y", weightCol="weight", numTrees=40, maxDepth=8, seed=0),
    "mlp": lambda n: MultilayerPerceptronClassifier(labelCol="y", layers=[n, 16, 2], seed=0, maxIter=50),
}


def fit_and_score(train: DataFrame, test: DataFrame, columns: list[str], model: str = "logreg") -> DataFrame:
    """Test rows with y and score, from a model fitted on balanced training rows; a single class scores its own label."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}")
    classes = [r[0] for r in train.select("y").distinct().collect()]
    if len(classes) < 2:
        return test.withColumn("score", F.lit(float(classes[0]) if classes else 0.0))
    assembler = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")
    fitted = MODELS[model](len(columns)).fit(assembler.transform(balanced_weight(train.na.fill(0, columns))))
    scored = fitted.transform(assembler.transform(test.na.fill(0, columns)))
    return scored.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def paired_bootstrap(rows: DataFrame, n_boot: int = 200, seed: int = 0) -> DataFrame:
    """Bootstrap of the difference a - b over paired blocks (block, a, b): mean, 95 % interval, share at or below zero.

    Poisson(1) weights from a hash of block and replicate stand for resampling
    with replacement, so replicates need no driver and no cross product of rows:
    each block just yields its weights.
    """
    u = lambda i: F.pmod(F.xxhash64(F.col("block"), i, F.lit(seed)), F.lit(10**9)) / 1e9
    # Inverse distribution function of Poisson(1).
    steps = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582]
    weight = lambda v: sum((F.when(v >= s, 1).otherwise(0) for s in steps), F.lit(0))
    reps = rows.select("block", (F.col("a") - F.col("b")).alias("d"), F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("rep"))
    weighted = reps.withColumn("w", weight(u(F.col("rep"))))
    per = weighted.groupBy("rep").agg(F.try_divide(F.sum(F.col("w") * F.col("d")), F.sum("w")).alias("m")).where("m is not null")
    return per.agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.avg((F.col("m") <= 0).cast("double")).alias("p_not_better"))


def compare_arms(rows: DataFrame, key: str, arm: str, value: str, base: str) -> DataFrame:
    """Per arm: mean difference to the base arm over shared keys, wins, losses and ties."""
    b = rows.where(F.col(arm) == base).select(F.col(key).alias("k__"), F.col(value).alias("base__"))
    d = F.col(value) - F.col("base__")
    joined = rows.where(F.col(arm) != base).join(b, F.col(key) == F.col("k__"))
    return joined.groupBy(arm).agg(F.avg(d).alias("mean_delta"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"))


def feasible(rows: DataFrame, constraints: dict[str, Column]) -> DataFrame:
    """A pass flag per constraint (null fails), their number and whether all pass."""
    flags = {f"ok_{k}": F.coalesce(c, F.lit(False)) for k, c in constraints.items()}
    out = rows.withColumns(flags)
    n = sum((F.col(k).cast("int") for k in flags), F.lit(0))
    return out.withColumn("n_passed", n).withColumn("feasible", F.col("n_passed") == len(flags))


def select_by_metric(summary: DataFrame, metric: str = "mean", std: str = "std", size: str = "n_features") -> DataFrame:
    """The smallest configuration within a tolerance of the best: the larger of its own and the median deviation."""
    tops = summary.agg(F.max_by(F.struct(F.col(metric).alias("m"), F.col(std).alias("s")), metric).alias("b"), F.percentile(std, 0.5).alias("med")).withColumn("k__", F.lit(1))
    joined = summary.withColumn("k__", F.lit(1)).join(F.broadcast(tops), "k__")
    near = joined.where(F.col(metric) >= F.col("b.m") - F.greatest("b.s", "med"))
    return near.orderBy(size, F.desc(metric)).select(*summary.columns).limit(1)


def decay(rows: DataFrame, config: str, horizon: str, value: str) -> DataFrame:
    """First and last horizon's value per configuration, and the drop."""
    per = rows.groupBy(config).agg(F.min_by(value, horizon).alias("first"), F.max_by(value, horizon).alias("last"), F.count("*").alias("n_horizons"))
    return per.withColumn("drop", F.col("first") - F.col("last"))


def ranked(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the rank of each row's value from 1, ties averaged, from counts by distinct value."""
    points = rows.groupBy(F.col(value).alias("v__")).agg(F.count("*").alias("c__"))
    ranks = running(points, "v__", ["c__"]).select("v__", (F.col("before_c__") + (F.col("c__") + 1) / 2).alias(name))
    return rows.join(ranks, F.col(value) == F.col("v__")).drop("v__")


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation, ties averaged; pairs with a null are left out."""
    pairs = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x__"), F.col(y).alias("y__"))
    return ranked(ranked(pairs, "x__", "rx"), "y__", "ry").agg(F.corr("rx", "ry").alias("spearman"))


def kendall(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Kendall's tau of two rankings of few items: concordant minus discordant pairs over all pairs."""
    other = rows.select(F.col(key).alias("k__"), F.col(x).alias("x__"), F.col(y).alias("y__"))
    s = F.signum(F.col(x) - F.col("x__")) * F.signum(F.col(y) - F.col("y__"))
    return rows.join(other, F.col(key) < F.col("k__")).agg(F.avg(s).alias("tau"))


def model_overlap(importances: DataFrame, k: int) -> DataFrame:
    """Per pair of models: Jaccard of their top-k features and how many they share."""
    order = Window.partitionBy("model").orderBy(F.desc(F.abs("importance")), "feature")
    tops = importances.withColumn("r__", F.row_number().over(order)).where((F.col("r__") <= k) & (F.col("importance") != 0)).select("model", "feature")
    sizes = tops.groupBy("model").agg(F.count("*").alias("n"))
    other = tops.select(F.col("model").alias("other"), F.col("feature").alias("f__"))
    shared = tops.join(other, (F.col("feature") == F.col("f__")) & (F.col("model") < F.col("other"))).groupBy("model", "other").agg(F.count("*").alias("shared"))
    a, b = sizes.select(F.col("model").alias("a__"), F.col("n").alias("na")), sizes.select(F.col("model").alias("b__"), F.col("n").alias("nb"))
    joined = shared.join(a, F.col("model") == F.col("a__")).join(b, F.col("other") == F.col("b__"))
    return joined.select("model", "other", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


def cross_granularity(coarse: DataFrame, fine: DataFrame) -> DataFrame:
    """Per coarse window and feature: in how many of the fine windows inside it the feature occurs, any and all.

    ``coarse``, ``fine``: (start, end, feature).
    """
    spans = fine.select(F.col("start").alias("fs"), F.col("end").alias("fe")).distinct()
    windows = coarse.select(F.col("start").alias("cs"), F.col("end").alias("ce")).distinct()
    inside = windows.join(F.broadcast(spans), (F.col("fs") >= F.col("cs")) & (F.col("fe") <= F.col("ce")))
    n = inside.groupBy("cs", "ce").agg(F.count("*").alias("n_fine"))
    met = inside.join(fine.select(F.col("start").alias("s__"), F.col("end").alias("e__"), F.col("feature").alias("f__")), (F.col("fs") == F.col("s__")) & (F.col("fe") == F.col("e__")))
    hits = met.groupBy(F.col("cs").alias("hs"), F.col("ce").alias("he"), "f__").agg(F.count("*").alias("n_present"))
    base = coarse.join(n, (F.col("start") == F.col("cs")) & (F.col("end") == F.col("ce")))
    joined = base.join(hits, (F.col("start") == F.col("hs")) & (F.col("end") == F.col("he")) & (F.col("feature") == F.col("f__")), "left")
    present = F.coalesce("n_present", F.lit(0))
    return joined.select("start", "end", "feature", "n_fine", present.alias("n_present"), (present > 0).alias("in_any"), (present == F.col("n_fine")).alias("in_all"))


def restatements(firing: DataFrame, carried: DataFrame) -> DataFrame:
    """Features for which one signature is in every firing group: (feature, gid), (gid, signature)."""
    sizes = firing.groupBy(F.col("feature").alias("f__")).agg(F.countDistinct("gid").alias("n"))
    met = firing.select("feature", F.col("gid").alias("g__")).distinct().join(carried.distinct(), F.col("g__") == F.col("gid"))
    per = met.groupBy("feature", "signature").agg(F.count("*").alias("c"))
    return sizes.join(per, F.col("feature") == F.col("f__"), "left").groupBy(F.col("f__").alias("feature")).agg(F.coalesce(F.bool_or(F.col("c") == F.col("n")), F.lit(False)).alias("restates"))


def dbscan(points: DataFrame, eps: float, least: int) -> DataFrame:
    """DBSCAN within each key (key, point_id, vector array): adds cluster, -1 for noise; a key's points fit one task."""
    import numpy as np
    import pandas as pd

    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("point_id").reset_index(drop=True)
        x = np.stack(frame["vector"].to_numpy()) if len(frame) else np.zeros((0, 1))
        near = [np.flatnonzero(((x - row) ** 2).sum(1) <= eps * eps) for row in x]
        core, labels, current = [len(n) >= least for n in near], np.full(len(x), -1), 0
        for i in range(len(x)):
            if not core[i] or labels[i] >= 0:
                continue
            labels[i], todo = current, [i]
            while todo:
                for j in near[todo.pop()]:
                    if labels[j] < 0:
                        labels[j] = current
                        if core[j]:
                            todo.append(j)
            current += 1
        return frame[["key", "point_id"]].assign(cluster=labels)

    schema = f"key {points.schema['key'].dataType.simpleString()}, point_id {points.schema['point_id'].dataType.simpleString()}, cluster bigint"
    return points.select("key", "point_id", "vector").groupBy("key").applyInPandas(cluster, schema)
