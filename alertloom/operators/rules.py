"""Rules as data, compiled into column expressions: predicates, AND clauses, ORs of clauses, ordered steps.

A rule set is small (tens to hundreds of rules), so it lives on the driver.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.operators.mining import contains_items_in_order, contains_steps_in_order
from alertloom.operators.ranges import running

OPERATORS = ("==", "!=", ">", "<=")


@dataclass(frozen=True)
class Predicate:
    """attribute, operator, value; on an array attribute == and != mean membership."""

    attribute: str
    operator: str
    value: float | str | bool
    is_set: bool = False

    def column(self) -> Column:
        """False where the attribute is null."""
        at, value = F.col(self.attribute), F.lit(self.value)
        if self.is_set:
            test = {"==": F.array_contains(at, value), "!=": ~F.array_contains(at, value)}.get(self.operator, F.lit(False))
        else:
            test = {"==": at == value, "!=": at != value, ">": at > value, "<=": at <= value}[self.operator]
        return F.coalesce(test, F.lit(False))

    def token(self) -> str:
        words = {"==": "_is_", "!=": "_not_", ">": "_gt_", "<=": "_le_"}
        return self.attribute + words[self.operator] + str(self.value)


def all_of(predicates: list[Predicate]) -> Column:
    """Conjunction; the empty one is true."""
    return reduce(lambda a, b: a & b, [p.column() for p in predicates], F.lit(True))


@dataclass(frozen=True)
class Rule:
    """A named feature: an OR of item clauses, or ordered steps; with its class."""

    name: str
    clauses: tuple[tuple[str, ...], ...] = ()
    steps: tuple[tuple[str, ...], ...] = ()
    predicates: tuple[Predicate, ...] = ()
    source_label: str = "attack"

    def column(self, items: str = "items", steps: str = "context_steps") -> Column:
        """Whether a group fires: any clause a subset of its items, the steps in order, or all predicates."""
        strings = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
        if self.predicates:
            return all_of(list(self.predicates))
        if self.steps:
            if all(len(s) == 1 for s in self.steps):
                return contains_items_in_order(F.col(steps), strings([s[0] for s in self.steps]))
            return contains_steps_in_order(F.col(steps), F.array(*[strings(s) for s in self.steps]))
        return reduce(lambda a, b: a | b, [F.size(F.array_except(strings(c), F.col(items))) == 0 for c in self.clauses], F.lit(False))


@dataclass
class RuleSet:
    """Rules with a version; names are unique, the first of a name stays."""

    rules: list[Rule] = field(default_factory=list)
    version: str = "0.1.0"

    def __post_init__(self) -> None:
        self.rules = list({r.name: r for r in reversed(self.rules)}.values())[::-1]

    def next_version(self) -> str:
        major, minor, _ = map(int, self.version.split("."))
        return f"{major}.{minor + 1}.0"

    def merged(self, other: RuleSet) -> RuleSet:
        return RuleSet([*self.rules, *other.rules], self.next_version())

    def top(self, k: int) -> RuleSet:
        return RuleSet(self.rules[:k], self.version)

    def without_cross_host(self) -> RuleSet:
        """Without ORs that span hosts."""
        hosts = lambda r: {i for c in r.clauses for i in c if i.startswith("host:")}
        return RuleSet([r for r in self.rules if len(r.clauses) < 2 or len(hosts(r)) < 2], self.version)

    def dumps(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def loads(text: str) -> RuleSet:
        raw = json.loads(text)
        clauses = lambda x: tuple(tuple(c) for c in x)
        return RuleSet([Rule(r["name"], clauses(r["clauses"]), clauses(r["steps"]), tuple(Predicate(**p) for p in r["predicates"]), r["source_label"]) for r in raw["rules"]], raw["version"])

    def fingerprint(self) -> str:
        return hashlib.sha256(self.dumps().encode()).hexdigest()[:16]


def encode(groups: DataFrame, rules: RuleSet, keep: list[str], columns: list[str] | None = None) -> DataFrame:
    """0/1 features; columns asked for but not produced are 0."""
    made = {r.name: r.column().cast("int") for r in rules.rules}
    names = list(made) if columns is None else columns
    return groups.select(*keep, *[made.get(n, F.lit(0)).alias(n) for n in names])


def firing(groups: DataFrame, rules: RuleSet, keep: list[str]) -> DataFrame:
    """Long form: (keep, feature) for each rule that fires; no wide matrix for large rule sets."""
    names = F.array_compact(F.array(*[F.when(r.column(), F.lit(r.name)) for r in rules.rules]))
    return groups.select(*keep, F.explode(names).alias("feature"))


def rule_rates(fired: DataFrame) -> DataFrame:
    """Fires and attack rate per feature."""
    return fired.groupBy("feature").agg(F.count("*").alias("n_fires"), F.avg((F.col("group_label") == "attack").cast("double")).alias("attack_rate"))


def rule_id(conditions: list[str]) -> str:
    """The same for any order of the conditions."""
    return hashlib.sha256("&".join(sorted(conditions)).encode()).hexdigest()[:12]


def column_name(condition: str, taken: set[str]) -> str:
    """A condition as a column name; a clash gets part of its SHA-1."""
    plain = condition.replace("==", " is ").replace("!=", " not ").replace("<=", " le ").replace(">", " gt ")
    name = re.sub(r"[^0-9A-Za-z_]+", "_", plain).strip("_").lower()
    return name if name not in taken else f"{name}_{hashlib.sha1(condition.encode()).hexdigest()[:8]}"


def tightest(path: list[Predicate]) -> list[Predicate]:
    """A tree path with the tightest bound for each attribute and operator."""
    best: dict[tuple[str, str], Predicate] = {}
    for p in path:
        key = (p.attribute, p.operator)
        old = best.get(key)
        if old is None or (p.operator == ">" and p.value > old.value) or (p.operator == "<=" and p.value < old.value):
            best[key] = p
    return list(best.values())


def deploy(history: DataFrame, version: int, deployed_at: datetime, body: str) -> DataFrame:
    """The version history with one more row; ``superseded_at`` follows from the next deployment."""
    row = history.sparkSession.createDataFrame([(version, deployed_at, body)], "version int, deployed_at timestamp, body string")
    return history.select("version", "deployed_at", "body").unionByName(row)


def schema_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Added, removed and turned rules between two versions (rule_id, prediction), and churn on the first."""
    b = before.select(F.col("rule_id").alias("b"), F.col("prediction").alias("bp"))
    a = after.select(F.col("rule_id").alias("a"), F.col("prediction").alias("ap"))
    both = b.join(a, F.col("b") == F.col("a"), "full")
    counted = both.agg(
        F.count_if(F.col("b").isNull()).alias("added"), F.count_if(F.col("a").isNull()).alias("removed"), F.count_if(F.col("bp") != F.col("ap")).alias("changed"), F.count("b").alias("before")
    )
    return counted.withColumn("churn", F.coalesce(F.try_divide((F.col("added") + F.col("removed") + F.col("changed")).cast("double"), F.col("before")), F.lit(0.0)))


def stump(rows: DataFrame, feature: str, label: str = "y") -> DataFrame:
    """The exact best split of one numeric feature by Gini, classes weighted evenly; ties take the lower threshold."""
    points = rows.where(F.col(feature).isNotNull()).groupBy(F.col(feature).cast("double").alias("v")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    share = lambda c: (F.col(f"before_{c}") + F.col(c)) / F.col(f"total_{c}")
    c = running(points, "v", ["p", "n"]).where("next__ is not null").select("v", "next__", share("p").alias("lp"), share("n").alias("ln"))
    gini = lambda p, n: (p + n) * (1 - (p / (p + n)) ** 2 - (n / (p + n)) ** 2)
    scored = c.select(((F.col("v") + F.col("next__")) / 2).alias("threshold"), ((gini(F.col("lp"), F.col("ln")) + gini(1 - F.col("lp"), 1 - F.col("ln"))) / 2).alias("impurity"))
    return scored.orderBy(F.round("impurity", 12), "threshold").limit(1)
