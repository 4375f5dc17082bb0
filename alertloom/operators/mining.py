"""Patterns over long-form items: itemsets, sequences, supports, filters, contrasts and OR rules.

Items are long: (gid, item), with labels in (gid, group_label). Candidates are
built from frequent single items only, so pairs and triples are bounded by the
frequent alphabet, not by the data's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-9


def long_items(groups: DataFrame, items: str = "items") -> DataFrame:
    return groups.select("gid", "group_label", F.explode(F.array_distinct(items)).alias("item"))


def min_support_count(support: Column | float, n: Column) -> Column:
    """max(1, ceil(s*n)), with slack for floating point."""
    s = F.lit(support) if isinstance(support, float) else support
    return F.greatest(F.lit(1), F.ceil(s.cast("double") * n.cast("double") - EPSILON)).cast("bigint")


def count_floor(support: float, n: Column) -> Column:
    return F.greatest(F.lit(3), F.ceil(F.lit(support) * n))


def class_sizes(groups: DataFrame) -> DataFrame:
    """One row: n_attack and n_benign."""
    return groups.agg(F.count_if(F.col("group_label") == "attack").alias("n_attack"), F.count_if(F.col("group_label") == "benign").alias("n_benign"))


def frequent_items(items: DataFrame, min_count: int) -> DataFrame:
    return items.groupBy("item").agg(F.count("*").alias("support_count")).where(F.col("support_count") >= min_count)


def itemsets(items: DataFrame, min_count: int, max_len: int = 3) -> DataFrame:
    """All itemsets up to a length with at least ``min_count`` groups: (items, k, support_count), level by level."""
    kept = items.join(frequent_items(items, min_count).select(F.col("item").alias("f__")), F.col("item") == F.col("f__"), "left_semi").select("gid", "item")
    level = kept.select("gid", F.array("item").alias("items"))
    found = [level.groupBy("items").agg(F.count("*").alias("support_count"))]
    for _ in range(1, max_len):
        frequent = found[-1].where(F.col("support_count") >= min_count).select(F.col("items").alias("f__"))
        base = level.join(frequent, F.col("items") == F.col("f__"), "left_semi")
        right = kept.select(F.col("gid").alias("g__"), F.col("item").alias("i__"))
        level = base.join(right, (F.col("gid") == F.col("g__")) & (F.element_at("items", -1) < F.col("i__"))).select("gid", F.array_append("items", F.col("i__")).alias("items"))
        found.append(level.groupBy("items").agg(F.count("*").alias("support_count")))
    every = reduce(DataFrame.unionByName, found).where(F.col("support_count") >= min_count)
    return every.select("items", F.size("items").cast("bigint").alias("k"), "support_count")


def combinations(items: Column, max_len: int) -> Column:
    """All combinations of a sorted array's items, of 1 to ``max_len`` items, as arrays."""
    level = F.transform(items, lambda x: F.array(x))
    out = level
    for _ in range(1, max_len):
        level = F.flatten(F.transform(level, lambda c: F.transform(F.filter(items, lambda y: y > F.element_at(c, -1)), lambda y: F.array_append(c, y))))
        out = F.concat(out, level)
    return out


def basket_itemsets(groups: DataFrame, min_count: int, max_len: int = 3, items: str = "items") -> DataFrame:
    """The itemsets of ``itemsets`` with their counts by class, for baskets of moderate size.

    Baskets are cut to the frequent items (at most rows / min_count of them come
    to one row), combinations are formed within each basket and counted with one
    exchange, after counting by task. A basket of n frequent items makes about
    n**max_len / max_len! rows: for large baskets ``itemsets`` prunes by level.
    """
    single = groups.select(F.explode(F.array_distinct(items)).alias("item")).groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    frequent = single.agg(F.array_sort(F.collect_list("item")).alias("frequent__")).withColumn("k__", F.lit(1))
    # Combinations are much work for few bytes: keep adaptive execution from merging the baskets into a few tasks.
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = groups.select("group_label", F.col(items).alias("basket__")).repartition(parts)
    cut = dealt.withColumn("k__", F.lit(1)).join(F.broadcast(frequent), "k__")
    rows = cut.select("group_label", F.explode(combinations(F.array_sort(F.array_intersect("basket__", "frequent__")), max_len)).alias("items"))
    counted = rows.groupBy("items").agg(F.count("*").alias("support_count"), F.count_if(F.col("group_label") == "attack").alias("count_attack"), F.count_if(F.col("group_label") == "benign").alias("count_benign"))
    return counted.where(F.col("support_count") >= min_count).select("items", F.size("items").cast("bigint").alias("k"), "support_count", "count_attack", "count_benign")


def pattern_matches(patterns: DataFrame, groups: DataFrame, items: str = "items") -> DataFrame:
    """(items, gid, group_label) of every pattern and group that holds it.

    Each pattern is posted under its rarest item, met with the groups that have
    that item, and verified against the whole basket: rows grow with the rarest
    items' counts, not with the sum over all items.
    """
    long = groups.select("gid", "group_label", F.col(items).alias("basket__"), F.explode(F.array_distinct(items)).alias("i__"))
    counts = long.groupBy("i__").agg(F.count("*").alias("n__"))
    posted = patterns.select("items", F.explode("items").alias("p__")).join(counts, F.col("p__") == F.col("i__"))
    rarest = posted.groupBy("items").agg(F.min_by("p__", F.struct("n__", "p__")).alias("key__"))
    met = rarest.join(long, F.col("key__") == F.col("i__"))
    return met.where(F.size(F.array_except("items", "basket__")) == 0).select("items", "gid", "group_label")


def cross_support(patterns: DataFrame, groups: DataFrame) -> DataFrame:
    """Adds counts and supports per class, and their difference attack - benign; counts that are there are used."""
    counted = patterns
    if "count_attack" not in patterns.columns:
        hits = pattern_matches(patterns, groups).groupBy("items").agg(F.count_if(F.col("group_label") == "attack").alias("count_attack"), F.count_if(F.col("group_label") == "benign").alias("count_benign"))
        counted = patterns.join(hits.withColumnRenamed("items", "of__"), F.col("items") == F.col("of__"), "left").drop("of__")
        counted = counted.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("count_attack", "count_benign")})
    sizes = class_sizes(groups).withColumn("k__", F.lit(1))
    joined = counted.withColumn("k__", F.lit(1)).join(F.broadcast(sizes), "k__").drop("k__")
    safe = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    out = joined.withColumns({"support_attack": safe("count_attack", "n_attack"), "support_benign": safe("count_benign", "n_benign")})
    return out.withColumn("support_diff", F.col("support_attack") - F.col("support_benign")).drop("n_attack", "n_benign")


def confidence(patterns: DataFrame) -> DataFrame:
    """Adds confidence (share of class-normalised support) and precision (share of counts) per class."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b)), F.lit(0.0))
    return patterns.withColumns(
        {
            "confidence_attack": share("support_attack", "support_benign"),
            "confidence_benign": share("support_benign", "support_attack"),
            "precision_attack": share("count_attack", "count_benign"),
            "precision_benign": share("count_benign", "count_attack"),
        }
    )


def lift(patterns: DataFrame, items: DataFrame, n_groups: int, column: str = "items") -> DataFrame:
    """Adds lift: support over the product of its items' supports; null where an item has none."""
    singles = items.groupBy("item").agg((F.countDistinct("gid") / F.lit(n_groups)).alias("s__"))
    parts = patterns.select(F.col(column).alias("of__"), F.explode(column).alias("p__")).join(singles, F.col("p__") == F.col("item"), "left")
    product = parts.groupBy("of__").agg(F.when(F.count_if(F.col("s__").isNull()) == 0, F.exp(F.sum(F.log("s__")))).alias("product__"))
    return patterns.join(product, F.col(column) == F.col("of__")).withColumn("lift", F.col("support_count") / F.lit(n_groups) / F.col("product__")).drop("of__", "product__")


def quality_filter(
    patterns: DataFrame,
    min_k: int = 1,
    max_k: int | None = None,
    min_count: int = 10,
    min_diff: float = 0.0,
    min_confidence_attack: float = 0.0,
    max_confidence_attack: float | None = None,
    min_confidence_benign: float = 0.0,
    max_overlap: float | None = None,
    direction: str = "both",
) -> DataFrame:
    """Size, then count, then discrimination; ``direction`` keeps the patterns that lean to one class."""
    if direction not in ("both", "attack", "benign"):
        raise ValueError(f"direction {direction!r}")
    ok = (F.col("k") >= min_k) & (F.col("support_count") >= min_count) & (F.abs("support_diff") >= min_diff)
    ok &= (F.col("confidence_attack") >= min_confidence_attack) & (F.col("confidence_benign") >= min_confidence_benign)
    if max_k is not None:
        ok &= F.col("k") <= max_k
    if max_confidence_attack is not None:
        ok &= F.col("confidence_attack") <= max_confidence_attack
    if max_overlap is not None:
        low, high = F.least("support_attack", "support_benign"), F.greatest("support_attack", "support_benign")
        ok &= F.coalesce(F.try_divide(low, high), F.lit(0.0)) <= max_overlap
    if direction != "both":
        ok &= (F.col("support_diff") > 0) if direction == "attack" else (F.col("support_diff") < 0)
    return patterns.where(ok)


def without_subsets(patterns: DataFrame) -> DataFrame:
    """Drops itemsets that are proper subsets of another one: larger sets are met by shared items and counted."""
    small = patterns.select(F.col("items").alias("a__"), F.size("items").alias("n__"), F.explode("items").alias("i__"))
    large = patterns.select(F.col("items").alias("b__"), F.size("items").alias("m__"), F.explode("items").alias("j__"))
    inside = small.join(large, (F.col("i__") == F.col("j__")) & (F.col("n__") < F.col("m__"))).groupBy("a__", "b__", "n__").agg(F.count("*").alias("c__")).where("c__ = n__")
    return patterns.join(inside.select("a__").distinct(), F.col("items") == F.col("a__"), "left_anti")


def without_prefixes(patterns: DataFrame, column: str = "steps") -> DataFrame:
    """Drops sequences that are proper prefixes of another one."""
    n = F.size(column)
    prefixes = patterns.where(n > 1).select(F.explode(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.slice(column, F.lit(1), i))).alias("p__")).distinct()
    return patterns.join(prefixes, F.col(column) == F.col("p__"), "left_anti")


def long_steps(sequences: DataFrame, steps: str = "steps") -> DataFrame:
    """(gid, group_label, pos, item) of sequences of itemsets."""
    return sequences.select("gid", "group_label", F.posexplode(steps).alias("pos", "step")).select("gid", "group_label", "pos", F.explode("step").alias("item"))


def item_sequences(steps: DataFrame, min_count: int, max_len: int = 3) -> DataFrame:
    """Frequent sequences of one item a strictly later step: (steps, k, support_count).

    A group keeps the earliest place where each sequence ends; extending from
    there finds every extension.
    """
    keep = steps.groupBy("item").agg(F.countDistinct("gid").alias("n__")).where(F.col("n__") >= min_count).select(F.col("item").alias("f__"))
    rows = steps.join(keep, F.col("item") == F.col("f__"), "left_semi").select("gid", "item", "pos")
    level = rows.groupBy("gid", F.array("item").alias("steps")).agg(F.min("pos").alias("end"))
    found = [level.groupBy("steps").agg(F.count("*").alias("support_count"))]
    for _ in range(1, max_len):
        frequent = found[-1].where(F.col("support_count") >= min_count).select(F.col("steps").alias("f__"))
        base = level.join(frequent, F.col("steps") == F.col("f__"), "left_semi")
        right = rows.select(F.col("gid").alias("g__"), F.col("item").alias("i__"), F.col("pos").alias("p__"))
        grown = base.join(right, (F.col("gid") == F.col("g__")) & (F.col("end") < F.col("p__")))
        level = grown.groupBy("gid", F.array_append("steps", F.col("i__")).alias("steps")).agg(F.min("p__").alias("end"))
        found.append(level.groupBy("steps").agg(F.count("*").alias("support_count")))
    every = reduce(DataFrame.unionByName, found).where(F.col("support_count") >= min_count)
    return every.select("steps", F.size("steps").cast("bigint").alias("k"), "support_count")


def itemset_sequences(steps: DataFrame, min_count: int, max_items: int = 3, max_steps: int | None = None) -> DataFrame:
    """Frequent sequences of itemsets: (steps, n_items, n_steps, support_count); (gid, pos, item) in.

    A pattern grows by an item in a strictly later step, or by a larger item in
    its last step. A group keeps every place where a pattern's last step fits, as
    an earlier end may lack the item that a later one has.
    """
    keep = steps.groupBy("item").agg(F.countDistinct("gid").alias("n__")).where(F.col("n__") >= min_count).select(F.col("item").alias("f__"))
    rows = steps.join(keep, F.col("item") == F.col("f__"), "left_semi").select("gid", "item", "pos").distinct()
    level = rows.select("gid", F.array(F.array("item")).alias("steps"), F.col("pos").alias("end"))
    right = rows.select(F.col("gid").alias("g__"), F.col("item").alias("i__"), F.col("pos").alias("p__"))
    count = lambda found: found.groupBy("steps").agg(F.countDistinct("gid").alias("support_count")).where(F.col("support_count") >= min_count)
    out = [count(level)]
    for _ in range(1, max_items):
        base = level.join(out[-1].select(F.col("steps").alias("f__")), F.col("steps") == F.col("f__"), "left_semi")
        firsts = base.where(F.size("steps") < (max_steps or max_items)).groupBy("gid", "steps").agg(F.min("end").alias("end"))
        later = firsts.join(right, (F.col("gid") == F.col("g__")) & (F.col("end") < F.col("p__")))
        later = later.select("gid", F.array_append("steps", F.array("i__")).alias("steps"), F.col("p__").alias("end"))
        last = F.element_at("steps", -1)
        wider = base.join(right, (F.col("gid") == F.col("g__")) & (F.col("end") == F.col("p__")) & (F.element_at(last, -1) < F.col("i__")))
        wider = wider.select("gid", F.array_append(F.slice("steps", F.lit(1), F.size("steps") - 1), F.array_append(last, F.col("i__"))).alias("steps"), "end")
        level = later.unionByName(wider)
        out.append(count(level))
    every = reduce(DataFrame.unionByName, out)
    n_items = F.aggregate("steps", F.lit(0), lambda n, s: n + F.size(s))
    return every.select("steps", n_items.cast("bigint").alias("n_items"), F.size("steps").cast("bigint").alias("n_steps"), "support_count")


def sequence_support(patterns: DataFrame, sequences: DataFrame, column: str = "steps") -> DataFrame:
    """Adds counts and supports per class of sequences of itemsets (array of arrays), by containment.

    ``sequences``: (gid, group_label, context_steps). A pattern meets only the
    groups that hold its rarest item.
    """
    items = F.array_distinct(F.flatten("context_steps"))
    long = sequences.select("gid", "group_label", "context_steps", F.explode(items).alias("i__"))
    counts = long.groupBy("i__").agg(F.count("*").alias("n__"))
    posted = patterns.select(F.col(column).alias("of__"), F.explode(F.array_distinct(F.flatten(column))).alias("p__")).join(counts, F.col("p__") == F.col("i__"))
    rarest = posted.groupBy("of__").agg(F.min_by("p__", F.struct("n__", "p__")).alias("key__"))
    met = rarest.join(long, F.col("key__") == F.col("i__")).where(contains_steps_in_order(F.col("context_steps"), F.col("of__")))
    hits = met.groupBy("of__").agg(*[F.count_if(F.col("group_label") == c).alias(f"count_{c}") for c in ("attack", "benign")])
    joined = patterns.join(hits, F.col(column) == F.col("of__"), "left").drop("of__").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("count_attack", "count_benign")})
    return cross_support(joined, sequences)


def contains_items_in_order(steps: Column, pattern: Column) -> Column:
    """Whether the pattern's items occur in strictly later steps each; an empty pattern does."""
    zero = F.lit(0)
    step = lambda j, s: F.when((j < F.size(pattern)) & F.array_contains(s, F.get(pattern, j)), j + 1).otherwise(j)
    return F.aggregate(steps, zero, step) == F.size(pattern)


def contains_steps_in_order(steps: Column, pattern: Column) -> Column:
    """Whether each pattern step is a subset of a strictly later step."""
    step = lambda j, s: F.when((j < F.size(pattern)) & (F.size(F.array_except(F.get(pattern, j), s)) == 0), j + 1).otherwise(j)
    return F.aggregate(steps, F.lit(0), step) == F.size(pattern)


def contrast_stats(items: DataFrame, groups: DataFrame, exclusive: tuple[str, ...] = ()) -> DataFrame:
    """Singles and pairs of items with class supports, growth, precision, lift and chi-square.

    Items that all groups or none have are left out, pairs never seen together
    too, and pairs of two values of a field in ``exclusive``.
    """
    sizes = class_sizes(groups).withColumn("k__", F.lit(1))
    n_total = F.col("n_attack") + F.col("n_benign")
    count = lambda label: F.count_if(F.col("group_label") == label)
    single = items.groupBy("item").agg(count("attack").alias("a"), count("benign").alias("b")).withColumn("k__", F.lit(1)).join(F.broadcast(sizes), "k__")
    single = single.where((F.col("a") + F.col("b")) < n_total)
    live = items.join(single.select(F.col("item").alias("f__")), F.col("item") == F.col("f__"), "left_semi")
    right = live.select(F.col("gid").alias("g__"), F.col("item").alias("i__"))
    field = lambda c: F.substring_index(c, ":", 1)
    barred = (field(F.col("item")) == field(F.col("i__"))) & field(F.col("item")).isin(*exclusive, "")
    pairs = live.join(right, (F.col("gid") == F.col("g__")) & (F.col("item") < F.col("i__")) & ~barred)
    pairs = pairs.groupBy("item", "i__").agg(count("attack").alias("a"), count("benign").alias("b")).withColumn("k__", F.lit(1)).join(F.broadcast(sizes), "k__")
    columns = ["a", "b", "n_attack", "n_benign"]
    every = single.select(F.col("item").alias("pattern"), *columns).unionByName(pairs.select(F.concat_ws(" AND ", "item", "i__").alias("pattern"), *columns))
    ratio = lambda x, y: F.coalesce(F.try_divide(F.col(x).cast("double"), F.col(y)), F.lit(0.0))
    out = every.withColumns({"support_attack": ratio("a", "n_attack"), "support_benign": ratio("b", "n_benign")})
    return out.select(
        "pattern", F.col("a").alias("count_attack"), F.col("b").alias("count_benign"), "support_attack", "support_benign",
        (F.col("support_attack") / (F.col("support_benign") + EPSILON)).alias("growth_rate"),
        (F.col("a") / (F.col("a") + F.col("b"))).alias("precision_attack"),
        F.coalesce(F.col("support_attack") / (F.nullif(F.col("n_attack") / n_total, F.lit(0.0)) + EPSILON), F.lit(0.0)).alias("lift"),
        chi_square(F.col("a"), F.col("n_attack"), F.col("b"), F.col("n_benign")).alias("chi_square"),
    )


def chi_square(a: Column, n: Column, b: Column, m: Column) -> Column:
    """Chi-square of a 2x2 table with Yates' correction; null where a margin is empty."""
    a, n, b, m = (x.cast("double") for x in (a, n, b, m))
    fired, quiet, total = a + b, n + m - a - b, n + m
    apart = F.abs(a * (m - b) - b * (n - a))
    shrunk = F.greatest(apart - F.least(F.lit(0.5) * total, apart), F.lit(0.0))
    return F.try_divide(total * shrunk * shrunk, F.nullif(fired * quiet * n * m, F.lit(0.0)))


def contrast_survivors(stats: DataFrame, min_attack: float = 0.05, min_benign: float = 0.05, growth: float = 3.0, growth_attack: float | None = None) -> DataFrame:
    """Patterns that discriminate and cover enough of the class they lean to."""
    attack = F.col("growth_rate") >= (growth if growth_attack is None else growth_attack)
    benign = (F.col("support_benign") > 0) & (F.col("growth_rate") <= (1.0 / growth if growth > 0 else float("inf")))
    fails = (attack & (F.col("support_attack") < min_attack)) | (benign & (F.col("support_benign") < min_benign))
    return stats.where((attack | benign) & ~fails)


def or_disjunctions(firing: DataFrame, groups: DataFrame, max_clauses: int = 2, min_gain: float = 0.02, min_diff: float = 0.05, min_confidence: float = 0.6, leading: str = "attack") -> DataFrame:
    """Disjunctions of 2 to ``max_clauses`` clauses by the union of the groups they fire for: (clause, gid, group_label) in.

    One is kept if its coverage of the leading class gains enough on its best
    part (itself without one clause), its supports differ enough and its
    confidence is high enough. As a clause adds at most its own coverage, only
    clauses that cover ``min_gain`` of the class can take part: at most the mean
    number of clauses a group over ``min_gain``. Sizes of unions follow from
    those of intersections, counted once a group and combination.
    """
    own, other = ("attack", "benign") if leading == "attack" else ("benign", "attack")
    count = lambda label: F.count_if(F.col("group_label") == label)
    sizes = class_sizes(groups).select(F.col(f"n_{own}").alias("n_own"), F.col(f"n_{other}").alias("n_other"), F.lit(1).alias("k__"))
    one = firing.groupBy("clause").agg(count(own).alias("a")).withColumn("k__", F.lit(1)).join(F.broadcast(sizes), "k__").where(F.col("a") >= F.lit(min_gain) * F.col("n_own") - EPSILON)
    strong = firing.join(one.select(F.col("clause").alias("s__")), F.col("clause") == F.col("s__"), "left_semi")
    held = strong.groupBy("gid", "group_label").agg(F.array_sort(F.collect_set("clause")).alias("held__"))
    # How often exactly these clauses fire together: all that unions depend on.
    cells = held.groupBy("held__").agg(count(own).alias("a"), count(other).alias("b"))
    names = one.agg(F.array_sort(F.collect_set("clause")).alias("names__")).withColumn("k__", F.lit(1))
    # Each combination once; as many as clauses over max_clauses, from the few strong ones.
    tuples = names.select(F.explode(combinations(F.col("names__"), max_clauses)).alias("items"))
    meet = cells.select("a", "b", F.explode(combinations(F.col("held__"), max_clauses)).alias("part__"))
    inside = meet.groupBy("part__").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    parts = tuples.select("items", F.explode(combinations(F.col("items"), max_clauses)).alias("p__")).join(inside, F.col("p__") == F.col("part__"), "left")
    sign = F.when(F.size("p__") % 2 == 1, 1).otherwise(-1)
    unions = parts.groupBy("items").agg(F.sum(sign * F.coalesce("a", F.lit(0))).alias("ua"), F.sum(sign * F.coalesce("b", F.lit(0))).alias("ub"))
    smaller = unions.select(F.col("items").alias("sub__"), F.col("ua").alias("part_a"))
    without = F.transform("items", lambda x: F.array_remove("items", x))
    grown = unions.where(F.size("items") > 1).select("items", "ua", "ub", F.explode(without).alias("less__")).join(smaller, F.col("less__") == F.col("sub__"))
    best = grown.groupBy("items", "ua", "ub").agg(F.max("part_a").alias("best__")).withColumn("k__", F.lit(1)).join(F.broadcast(sizes), "k__")
    out = best.select(
        F.array_join("items", " OR ").alias("pattern"), F.size("items").cast("bigint").alias("n_clauses"), F.col("ua").alias(f"count_{own}"), F.col("ub").alias(f"count_{other}"),
        (F.col("ua") / F.col("n_own")).alias(f"support_{own}"), (F.col("ub") / F.col("n_other")).alias(f"support_{other}"), ((F.col("ua") - F.col("best__")) / F.col("n_own")).alias("gain"),
    )
    mine, theirs = F.col(f"support_{own}"), F.col(f"support_{other}")
    conf = F.coalesce(F.try_divide(mine, mine + theirs), F.lit(0.0))
    kept = (F.col("gain") >= min_gain - EPSILON) & (F.abs(mine - theirs) >= min_diff) & (conf >= min_confidence)
    return out.withColumn(f"confidence_{own}", conf).where(kept)


def or_pairs(firing: DataFrame, groups: DataFrame, min_gain: float = 0.02, min_diff: float = 0.05, min_confidence: float = 0.6) -> DataFrame:
    """Disjunctions of two clauses, see ``or_disjunctions``."""
    return or_disjunctions(firing, groups, 2, min_gain, min_diff, min_confidence).drop("n_clauses")


def budget(patterns: DataFrame, k: int, score: str, name: str, cls: str | None = None) -> DataFrame:
    """The best k by score, then length, then name; with a class column, half for each and what one leaves goes to the other."""
    order = [F.desc(score), F.length(name), F.col(name)]
    if cls is None:
        return patterns.orderBy(*order).limit(k)
    ranked = patterns.withColumn("rank__", F.row_number().over(Window.partitionBy(cls).orderBy(*order)))
    half = -(-k // 2)
    chosen = ranked.where(F.col("rank__") <= k)
    first = chosen.withColumn("spill__", (F.col("rank__") > half).cast("int"))
    return first.orderBy("spill__", *order).limit(k).drop("rank__", "spill__")


def gate(rules: DataFrame, base_rate: float, attack_factor: float = 2.0, benign_factor: float = 2.0) -> DataFrame:
    """Rules whose attack rate is well above (attack) or below (benign) the base rate; mixed ones stay, silent ones go."""
    rate = F.col("attack_rate")
    ok = F.when(F.col("n_fires") == 0, False).when(F.col("source_label") == "attack", rate >= attack_factor * base_rate)
    return rules.where(ok.when(F.col("source_label") == "benign", rate <= base_rate / benign_factor).otherwise(True))


def firing_jaccard(firing: DataFrame) -> DataFrame:
    """Jaccard of every two features that fire together: (feature, gid) in."""
    sizes = firing.groupBy("feature").agg(F.count("*").alias("n"))
    other = firing.select(F.col("feature").alias("other"), F.col("gid").alias("g__"))
    both = firing.join(other, (F.col("gid") == F.col("g__")) & (F.col("feature") < F.col("other"))).groupBy("feature", "other").agg(F.count("*").alias("shared"))
    a, b = sizes.select(F.col("feature").alias("a__"), F.col("n").alias("na")), sizes.select(F.col("feature").alias("b__"), F.col("n").alias("nb"))
    joined = both.join(a, F.col("feature") == F.col("a__")).join(b, F.col("other") == F.col("b__"))
    return joined.select("feature", "other", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


def identical_firing(firing: DataFrame) -> DataFrame:
    """One feature of those that fire for the same groups: the first by name. Digests only propose; the groups decide."""
    fires = firing.select("feature", "gid").distinct()
    ids = fires.groupBy("feature").agg(F.count("*").alias("n"), F.sum(F.xxhash64("gid").cast("decimal(38,0)")).alias("h1"), F.bit_xor(F.xxhash64(F.col("gid"), F.lit(1))).alias("h2"))
    proposed = ids.select("feature", "n", F.min("feature").over(Window.partitionBy("n", "h1", "h2")).alias("first"))
    twins = proposed.where("feature <> first").select(F.col("feature").alias("f__"), "first", "n")
    one = fires.join(twins, F.col("feature") == F.col("f__")).select("f__", "first", "n", "gid")
    other = fires.select(F.col("feature").alias("o__"), F.col("gid").alias("g__"))
    same = one.join(other, (F.col("first") == F.col("o__")) & (F.col("gid") == F.col("g__"))).groupBy("f__", "first", "n").agg(F.count("*").alias("c")).where("c = n").select("f__", F.col("first").alias("as__"))
    named = proposed.join(same, F.col("feature") == F.col("f__"), "left").select(F.coalesce("as__", "feature").alias("feature"), "n")
    return named.groupBy("feature").agg(F.count("*").alias("n_same"), F.max("n").alias("n_fires"))


