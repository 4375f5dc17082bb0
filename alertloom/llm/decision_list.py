"""Quality rules: counts of a text's surface, and a learned decision list over them.

Every feature is a column expression over one row. The list is learned by
sequential covering: a rule for low quality grows one threshold test at a time
by information gain on two thirds of the labelled rows, is pruned from its last
test backwards on the remaining third, and is kept only if precise enough on
both; the rows that it covers leave, and the next rule grows on the rest. The
ordered rules become one chain of conditional expressions.

Learning reads at most ``MAX_TRAIN`` labelled rows, those with the smallest
hash of their doc_id: a bound on what reaches the driver (a dozen numbers a
row), whatever the corpus holds. The bounded set of ids is what is broadcast.

Defined results: a null or empty text has no words and fails the base rules;
labels that are null or for unknown documents are ignored, and several for one
document all count; with no labels there are no learned rules; repeated rows
are judged alike; empty tables give empty results; extra columns are ignored by
``judge`` and kept by ``keep_good``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import BLANKS, UPPER, checked_columns, sheltered, words_of
from alertloom.llm.secret_scan import let

MAX_TRAIN = 20_000
#: Learned rules must be this precise on the growing and on the pruning rows.
LEAST_PRECISION = 0.9
LEAST_COVERED = 8
MAX_RULES = 24
MAX_TESTS = 4
CUTS = 48
SYMBOLS = "#*$%&|<>"
REPEAT_WIDTH = 8
FEATURES = ("n_words", "word_chars_per_word", "symbols_per_word", "exclamations_per_word", "upper_share", "digit_share", "dup_line_share", "repeat_word_share", "distinct_word_share", "words_per_line")


@dataclass(frozen=True)
class Test:
    """feature > cut, or feature <= cut."""

    feature: str
    above: bool
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        column = x[:, FEATURES.index(self.feature)]
        return column > self.cut if self.above else column <= self.cut

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.cut if self.above else value <= self.cut


@dataclass(frozen=True)
class LearnedRule:
    """A conjunction of tests for low quality, with its precision and the rows it covered."""

    tests: tuple[Test, ...]
    precision: float
    covered: int

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [t.column() for t in self.tests])

    def __str__(self) -> str:
        return " and ".join(f"{t.feature} {'>' if t.above else '<='} {t.cut:g}" for t in self.tests)


def _repeated(words: Column) -> Column:
    """How many words lie in a window of 8 that occurs twice or more."""

    def covered(hashes: Column) -> Column:
        ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def count(ranked: Column) -> Column:
            twins = F.filter(ranked, lambda x, i: (x["h"] == F.get(ranked, i - 1)["h"]) | (x["h"] == F.get(ranked, i + 1)["h"]))
            places = F.array_sort(F.transform(twins, lambda x: x["i"]))
            zero = F.struct(F.lit(0).alias("n"), F.lit(-REPEAT_WIDTH).alias("last"))
            step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(REPEAT_WIDTH), p - acc["last"])).alias("n"), p.alias("last"))
            return F.aggregate(places, zero, step)["n"]

        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(ranked, count)).otherwise(0)

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (REPEAT_WIDTH - 1)), lambda i: F.xxhash64(F.slice(words, i, REPEAT_WIDTH)))
    return F.when(F.size(words) > REPEAT_WIDTH, let(windows, covered)).otherwise(0)


def surface(docs: DataFrame) -> DataFrame:
    """Adds the counts of a text (text__: the text, empty for null) as columns."""
    text = F.col("text__")
    bare = F.translate(text, BLANKS, "")
    length_without = lambda chars: F.length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    first = docs.withColumn("text__", F.coalesce("text", F.lit(""))).withColumn("words__", words_of(text))
    second = first.withColumns(
        {
            "word_chars": F.length(bare).cast("bigint"),
            "n_symbols": (F.length(text) - length_without(SYMBOLS)).cast("bigint"),
            "exclamations__": F.length(text) - length_without("!"),
            "upper__": F.length(text) - length_without(UPPER),
            "digits__": F.length(text) - length_without("0123456789"),
            "lines__": let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))),
            "counts__": let(
                F.col("words__"),
                lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"), _repeated(w).alias("repeated")),
            ),
        }
    )
    n = F.col("counts__.n")
    per = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    return second.withColumns(
        {
            "n_words": n.cast("bigint"),
            "n_dup_lines": F.col("lines__.dup").cast("bigint"),
            "n_repeat_words": F.col("counts__.repeated").cast("bigint"),
            "word_chars_per_word": per(F.col("word_chars"), n),
            "symbols_per_word": per(F.col("n_symbols"), n),
            "exclamations_per_word": per(F.col("exclamations__"), n),
            "upper_share": per(F.col("upper__"), F.col("word_chars")),
            "digit_share": per(F.col("digits__"), F.col("word_chars")),
            "dup_line_share": per(F.col("lines__.dup"), F.col("lines__.n")),
            "repeat_word_share": per(F.col("counts__.repeated"), n),
            "distinct_word_share": per(F.col("counts__.distinct"), n),
            "words_per_line": per(n, F.col("lines__.n")),
        }
    ).drop("text__", "words__", "exclamations__", "upper__", "digits__", "lines__", "counts__")


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray]:
    """Features and low-quality flags of at most ``limit`` labelled rows."""
    marked = checked_columns(labels, "doc_id", "quality").where("quality is not null and doc_id is not null")
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(limit).withColumnRenamed("doc_id", "of")
    texts = checked_columns(docs, "doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("of"))
    rows = surface(texts).select("doc_id", F.xxhash64("text").alias("tie"), (F.col("quality") == 0).alias("low"), *FEATURES)
    rows = rows.orderBy(F.xxhash64("doc_id"), "tie", "low").limit(limit).collect()
    x = np.array([[float(r[f]) for f in FEATURES] for r in rows], float).reshape(-1, len(FEATURES))
    return x, np.array([bool(r["low"]) for r in rows], bool)


def _gain(p: np.ndarray, n: np.ndarray, before: float) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - before), -np.inf)


def _best_test(x: np.ndarray, low: np.ndarray, cuts: list[np.ndarray]) -> tuple[float, Test] | None:
    """The test of highest information gain over the rows at hand, from cumulated counts by cut."""
    before, best = np.log2(max(low.mean(), 1e-12)), None
    for k, name in enumerate(FEATURES):
        if not len(cuts[k]):
            continue
        bins = np.searchsorted(cuts[k], x[:, k], side="left")
        p = np.cumsum(np.bincount(bins[low], minlength=len(cuts[k]) + 1))
        n = np.cumsum(np.bincount(bins[~low], minlength=len(cuts[k]) + 1))
        for above, (a, b) in ((False, (p[:-1], n[:-1])), (True, (p[-1] - p[:-1], n[-1] - n[:-1]))):
            gains = _gain(a.astype(float), b.astype(float), before)
            i = int(np.argmax(gains))
            if best is None or gains[i] > best[0] + 1e-12:
                best = (float(gains[i]), Test(name, above, float(cuts[k][i])))
    return best


def learn(x: np.ndarray, low: np.ndarray) -> list[LearnedRule]:
    """Ordered rules for low quality, by growing, pruning and covering."""
    rules: list[LearnedRule] = []
    prune = np.arange(len(low)) % 3 == 2
    left = np.ones(len(low), bool)
    cuts = []
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        spread = np.unique(np.concatenate([np.quantile(x[m, k], np.linspace(0, 1, CUTS)) for m in (low, ~low) if m.any()] or [values]))
        middles = (values[1:] + values[:-1]) / 2
        cuts.append(np.unique(middles[np.clip(np.searchsorted(middles, spread), 0, len(middles) - 1)]) if len(middles) else middles)
    while len(rules) < MAX_RULES and (grow := left & ~prune)[low].any():
        inside, tests = grow.copy(), []
        while (~low[inside]).any() and len(tests) < MAX_TESTS:
            found = _best_test(x[inside], low[inside], cuts)
            if found is None or found[0] <= 1e-9:
                break
            tests.append(found[1])
            inside &= found[1].holds(x)
        held = left & prune
        cover = lambda some, where: where & np.logical_and.reduce([t.holds(x) for t in some]) if some else where

        def worth(some: list[Test], held: np.ndarray = held) -> float:
            m = cover(some, held)
            return (low[m].sum() - (~low[m]).sum()) / m.sum() if m.any() else -1.0

        best = max(range(1, len(tests) + 1), key=lambda k: (worth(tests[:k]), -k), default=0)
        tests = tests[:best]
        covered = cover(tests, left)
        parts = [covered & ~prune, covered & prune]
        precise = all(m.any() and low[m].mean() >= LEAST_PRECISION for m in parts)
        if not tests or not precise or covered.sum() < LEAST_COVERED:
            break
        rules.append(LearnedRule(tuple(tests), float(low[covered].mean()), int(covered.sum())))
        left &= ~covered
    return rules


def with_verdicts(docs: DataFrame, rules: list[LearnedRule]) -> DataFrame:
    """Adds the counts, base_failed, rule (number of the first rule that holds, from 1; else null) and kept."""
    chain = F.lit(None).cast("int")
    for k in reversed(range(len(rules))):
        chain = F.when(rules[k].column(), k + 1).otherwise(chain)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = surface(docs).withColumn("base_failed", failed).withColumn("rule", chain)
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and rule for every document."""
    rules = learn(*training_rows(docs, labels))
    return with_verdicts(checked_columns(docs, "doc_id", "text"), rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns."""
    held, restore = sheltered(docs, "text")
    return restore(with_verdicts(held, learn(*training_rows(docs, labels))).where("kept"))
