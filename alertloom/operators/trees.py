"""Rule trees, rule covering and rule registries on exact split statistics.

A tree is grown level by level: one job per level aggregates, for every open
node and feature, class weights by feature value, and finds the best Gini split
from running sums over ranges of the distinct values. Only the chosen splits reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.operators.ranges import running
from alertloom.operators.rules import Predicate, Rule, RuleSet, rule_id, tightest

LEAST_DECREASE = 1e-9


@dataclass(frozen=True)
class Leaf:
    """A path of predicates with its rows by class."""

    path: tuple[Predicate, ...]
    n_attack: int
    n_benign: int

    @property
    def prediction(self) -> str:
        return "attack" if self.n_attack >= self.n_benign else "benign"

    @property
    def precision(self) -> float:
        return max(self.n_attack, self.n_benign) / max(1, self.n_attack + self.n_benign)


def _node_column(paths: dict[int, list[Predicate]]) -> Column:
    out = F.lit(None).cast("int")
    for node, path in paths.items():
        test = F.lit(True)
        for p in path:
            test &= p.column()
        out = F.when(test, node).otherwise(out)
    return out


def best_splits(rows: DataFrame, features: list[str], min_leaf: int) -> DataFrame:
    """The best split of each node: (node, feature, threshold, decrease); ``rows``: node, y, weight, features."""
    long = rows.select("node", "y", "weight", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("x")).select("node", "y", "weight", "x.*").where("v is not null")
    y = F.col("y") == 1
    points = long.groupBy("node", "feature", "v").agg(F.sum(F.when(y, F.col("weight")).otherwise(0.0)).alias("p"), F.sum(F.when(~y, F.col("weight")).otherwise(0.0)).alias("n"), F.count("*").alias("c"))
    left = lambda c: F.col(f"before_{c}") + F.col(c)
    c = running(points, "v", ["p", "n", "c"], ["node", "feature"]).select(
        "node", "feature", "v", F.col("next__").alias("next"), left("p").alias("lp"), left("n").alias("ln"), left("c").alias("lc"), F.col("total_p").alias("tp"), F.col("total_n").alias("tn"), F.col("total_c").alias("tc")
    )
    gini = lambda p, n: (p + n) - (p * p + n * n) / F.greatest(p + n, F.lit(1e-300))
    decrease = gini(F.col("tp"), F.col("tn")) - gini(F.col("lp"), F.col("ln")) - gini(F.col("tp") - F.col("lp"), F.col("tn") - F.col("ln"))
    ok = F.col("next").isNotNull() & (F.col("lc") >= min_leaf) & (F.col("tc") - F.col("lc") >= min_leaf)
    scored = c.where(ok).select("node", "feature", ((F.col("v") + F.col("next")) / 2).alias("threshold"), F.round(decrease, 12).alias("decrease")).where(F.col("decrease") > LEAST_DECREASE)
    first = Window.partitionBy("node").orderBy(F.desc("decrease"), "feature", "threshold")
    return scored.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def fit_tree(rows: DataFrame, features: list[str], max_depth: int = 3, min_leaf: int = 20) -> list[Leaf]:
    """Leaves of an exact Gini tree with evenly weighted classes; ``rows``: y and numeric features."""
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return [Leaf((), sizes.get(1, 0), sizes.get(0, 0))]
    weight = F.when(F.col("y") == 1, 0.5 / sizes[1]).otherwise(0.5 / sizes[0])
    weighted = rows.withColumn("weight", weight)
    open_nodes: dict[int, list[Predicate]] = {0: []}
    done: list[list[Predicate]] = []
    for _ in range(max_depth):
        splits = {r.node: r for r in best_splits(weighted.withColumn("node", _node_column(open_nodes)).where("node is not null"), features, min_leaf).collect()}
        following: dict[int, list[Predicate]] = {}
        for node, path in open_nodes.items():
            if node not in splits:
                done.append(path)
                continue
            s = splits[node]
            for op in ("<=", ">"):
                following[len(following)] = tightest([*path, Predicate(s.feature, op, s.threshold)])
        open_nodes = following
        if not open_nodes:
            break
    paths = dict(enumerate([*done, *open_nodes.values()]))
    counted = rows.withColumn("node", _node_column(paths)).where("node is not null").groupBy("node").agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b"))
    found = {r.node: (r.a, r.b) for r in counted.collect()}
    return [Leaf(tuple(path), *found.get(node, (0, 0))) for node, path in paths.items()]


def leaf_rules(leaves: list[Leaf], min_precision: float = 0.0) -> RuleSet:
    """Leaves as rules, named by their conditions."""
    rules = [Rule(f"leaf_{rule_id([p.token() for p in x.path])}", predicates=x.path, source_label=x.prediction) for x in leaves if x.path and x.precision >= min_precision]
    return RuleSet(rules)


def diverse_rounds(rows: DataFrame, features: list[str], rounds: int = 3, max_depth: int = 2, min_leaf: int = 20, least_precision: float = 0.6) -> RuleSet:
    """Rules of several trees; each round leaves out the features that earlier ones split on first."""
    left, out = list(features), RuleSet([])
    for _ in range(rounds):
        if not left:
            break
        leaves = fit_tree(rows, left, max_depth, min_leaf)
        out = RuleSet([*out.rules, *leaf_rules(leaves, least_precision).rules], out.version)
        used = {x.path[0].attribute for x in leaves if x.path}
        if not used:
            break
        left = [f for f in left if f not in used]
    return out


def cover_rules(firing: DataFrame, groups: DataFrame, max_rules: int = 5, least_precision: float = 0.6, least_gain: int = 1) -> list[tuple[str, int, int]]:
    """Greedy covering of attack groups by items: (item, attacks newly covered, benign newly covered).

    Each round is one aggregate by item over the groups not yet covered; only
    its best row reaches the driver. ``firing``: (gid, group_label, item).
    """
    chosen: list[tuple[str, int, int]] = []
    left = firing
    for _ in range(max_rules):
        per = left.groupBy("item").agg(F.count_if(F.col("group_label") == "attack").alias("a"), F.count_if(F.col("group_label") == "benign").alias("b"))
        good = per.where((F.col("a") >= least_gain) & (F.col("a") / (F.col("a") + F.col("b")) >= least_precision))
        best = good.orderBy(F.desc(F.col("a") * F.log2(2 * F.col("a") / (F.col("a") + F.col("b")))), "item").first()
        if best is None:
            break
        chosen.append((best.item, best.a, best.b))
        covered = left.where(F.col("item") == best.item).select(F.col("gid").alias("g__")).distinct()
        left = left.join(covered, F.col("gid") == F.col("g__"), "left_anti")
    return chosen


def top_sequences(sequences: DataFrame, n_groups: Column | int, attack_share: float, k: int) -> DataFrame:
    """Sequences by weighted relative accuracy: (steps, count_attack, count_benign) in."""
    total = F.col("count_attack") + F.col("count_benign")
    wracc = total / n_groups * (F.col("count_attack") / total - F.lit(attack_share))
    return sequences.withColumn("wracc", wracc).orderBy(F.desc(F.round("wracc", 12)), F.size("steps"), "steps").limit(k)


def versions(history: DataFrame) -> DataFrame:
    """Deployed versions with the time each was superseded."""
    return history.withColumn("superseded_at", F.lead("deployed_at").over(Window.orderBy("deployed_at", "version")))
