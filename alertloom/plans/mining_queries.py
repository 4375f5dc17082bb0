"""Queries of pattern mining, rules, encoding and monitoring over order baskets and alert groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.operators import groups as B
from alertloom.operators import metrics as M
from alertloom.operators import mining as P
from alertloom.operators import rules as R
from alertloom.operators import windows as W
from alertloom.plans.registry import ALERTS, BASKETS, query, rounded
from alertloom.sources.events import alerts, baskets
from alertloom.streaming import monitor as D


def items(spark, sf_dir):
    return P.long_items(baskets(spark, sf_dir))


def joined(df, column="items", name="pattern"):
    return df.withColumn(name, F.array_join(column, " & ")).drop(column)


@query("items_long", f"WITH {BASKETS} SELECT item, group_label, count(*) AS n FROM items GROUP BY 1, 2")
def items_long(spark, sf_dir):
    return items(spark, sf_dir).groupBy("item", "group_label").agg(F.count("*").alias("n"))


@query("basket_classes", f"WITH {BASKETS} SELECT group_label, count(*) AS n, sum(n_lines)::BIGINT AS n_lines FROM baskets GROUP BY 1")
def basket_classes(spark, sf_dir):
    return baskets(spark, sf_dir).groupBy("group_label").agg(F.count("*").alias("n"), F.sum("n_lines").alias("n_lines"))


SETS = f"""WITH {BASKETS}, f AS (SELECT item FROM items GROUP BY 1 HAVING count(*) >= (SELECT greatest(1, ceil(0.02 * count(*) - 1e-9)) FROM baskets)), k AS (SELECT gid, group_label, item FROM items WHERE item IN (SELECT item FROM f)),
 sets AS (
  SELECT item AS pattern, 1 AS k, count(*) AS support_count, count(*) FILTER (group_label = 'attack') AS a, count(*) FILTER (group_label = 'benign') AS b, [item] AS its FROM k GROUP BY item
  UNION ALL SELECT x.item || ' & ' || y.item, 2, count(*), count(*) FILTER (x.group_label = 'attack'), count(*) FILTER (x.group_label = 'benign'), [x.item, y.item] FROM k x JOIN k y ON x.gid = y.gid AND x.item < y.item GROUP BY x.item, y.item HAVING count(*) >= (SELECT greatest(1, ceil(0.02 * count(*) - 1e-9)) FROM baskets)
  UNION ALL SELECT x.item || ' & ' || y.item || ' & ' || z.item, 3, count(*), count(*) FILTER (x.group_label = 'attack'), count(*) FILTER (x.group_label = 'benign'), [x.item, y.item, z.item]
   FROM k x JOIN k y ON x.gid = y.gid AND x.item < y.item JOIN k z ON x.gid = z.gid AND y.item < z.item GROUP BY x.item, y.item, z.item HAVING count(*) >= (SELECT greatest(1, ceil(0.02 * count(*) - 1e-9)) FROM baskets)
 ), sizes AS (SELECT count(*) FILTER (group_label = 'attack') AS na, count(*) FILTER (group_label = 'benign') AS nb FROM baskets),
 scored AS (SELECT pattern, k, support_count, a, b, its, a / na AS sa, b / nb AS sb FROM sets, sizes)"""


def sets(spark, sf_dir):
    b = baskets(spark, sf_dir)
    least = b.agg(P.min_support_count(0.02, F.count("*"))).first()[0]
    return P.basket_itemsets(b, least, 3)


def scored_sets(spark, sf_dir):
    return P.cross_support(sets(spark, sf_dir), baskets(spark, sf_dir))


@query("itemsets_k3", SETS + " SELECT pattern, k::BIGINT AS k, support_count FROM sets")
def itemsets_k3(spark, sf_dir):
    return joined(sets(spark, sf_dir)).select("pattern", "k", "support_count")


@query("itemset_cross_support", SETS + " SELECT pattern, a AS count_attack, b AS count_benign, round(sa, 6) AS support_attack, round(sb, 6) AS support_benign, round(sa - sb, 6) AS support_diff FROM scored")
def itemset_cross_support(spark, sf_dir):
    return rounded(joined(scored_sets(spark, sf_dir)).drop("k", "support_count"))


@query("itemset_confidence", SETS + " SELECT pattern, round(sa / (sa + sb), 6) AS confidence_attack, round(sb / (sa + sb), 6) AS confidence_benign, round(a / (a + b), 6) AS precision_attack, round(b / (a + b), 6) AS precision_benign FROM scored")
def itemset_confidence(spark, sf_dir):
    return rounded(joined(P.confidence(scored_sets(spark, sf_dir))).select("pattern", "confidence_attack", "confidence_benign", "precision_attack", "precision_benign"))


@query("itemset_filter_subsumed", SETS + """, q AS (SELECT * FROM scored WHERE k >= 1 AND support_count >= 200 AND abs(sa - sb) >= 0.01 AND sa / (sa + sb) >= 0.5)
SELECT pattern, k::BIGINT AS k, support_count FROM q x WHERE NOT EXISTS (SELECT 1 FROM q y WHERE y.k > x.k AND list_has_all(y.its, x.its))""")
def itemset_filter_subsumed(spark, sf_dir):
    kept = P.quality_filter(P.confidence(scored_sets(spark, sf_dir)), min_count=200, min_diff=0.01, min_confidence_attack=0.5)
    return joined(P.without_subsets(kept)).select("pattern", "k", "support_count")


@query("itemset_lift", SETS + """, n AS (SELECT count(*) AS n FROM baskets), s AS (SELECT item, count(*) AS c FROM items GROUP BY 1),
 u AS (SELECT pattern, support_count, unnest(its) AS item FROM sets), p AS (SELECT pattern, any_value(support_count) AS sc, sum(ln(c / n)) AS l FROM u JOIN s USING (item), n GROUP BY 1)
SELECT pattern, round(sc / n / exp(l), 6) AS lift FROM p, n""")
def itemset_lift(spark, sf_dir):
    n = baskets(spark, sf_dir).count()
    return rounded(joined(P.lift(sets(spark, sf_dir), items(spark, sf_dir), n)).select("pattern", "lift"))


@query("pattern_budget", SETS + """, r AS (SELECT pattern, sa - sb AS d, CASE WHEN sa > sb THEN 'attack' ELSE 'benign' END AS cls, abs(sa - sb) AS score FROM scored),
 q AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY round(score, 12) DESC, length(pattern), pattern) AS k FROM r), t AS (SELECT *, (k > 10)::INT AS spill FROM q WHERE k <= 20)
SELECT pattern, cls FROM t ORDER BY spill, round(score, 12) DESC, length(pattern), pattern LIMIT 20""")
def pattern_budget(spark, sf_dir):
    s = joined(scored_sets(spark, sf_dir))
    s = s.withColumn("score", F.round(F.abs("support_diff"), 12)).withColumn("cls", F.when(F.col("support_attack") > F.col("support_benign"), "attack").otherwise("benign"))
    return P.budget(s, 20, "score", "pattern", "cls").select("pattern", "cls")


@query("or_pairs", f"""WITH {BASKETS}, c AS (SELECT * FROM items), z AS (SELECT count(*) FILTER (group_label = 'attack') AS na, count(*) FILTER (group_label = 'benign') AS nb FROM baskets),
 o AS (SELECT item, count(*) FILTER (group_label = 'attack') AS a, count(*) FILTER (group_label = 'benign') AS b FROM c GROUP BY 1),
 i AS (SELECT x.item AS l, y.item AS r, count(*) FILTER (x.group_label = 'attack') AS ia, count(*) FILTER (x.group_label = 'benign') AS ib FROM c x JOIN c y ON x.gid = y.gid AND x.item < y.item GROUP BY 1, 2),
 u AS (SELECT l.item || ' OR ' || r.item AS pattern, l.a + r.a - coalesce(ia, 0) AS ua, l.b + r.b - coalesce(ib, 0) AS ub, greatest(l.a, r.a) AS best FROM o l JOIN o r ON l.item < r.item LEFT JOIN i ON i.l = l.item AND i.r = r.item)
SELECT pattern, ua AS count_attack, ub AS count_benign, round(ua / na, 6) AS support_attack, round(ub / nb, 6) AS support_benign, round((ua - best) / na, 6) AS gain, round(ua / na / (ua / na + ub / nb), 6) AS confidence_attack
FROM u, z WHERE (ua - best) / na >= 0.02 AND abs(ua / na - ub / nb) >= 0.01 AND ua / na / (ua / na + ub / nb) >= 0.5""")
def or_pairs(spark, sf_dir):
    clauses = items(spark, sf_dir).withColumnRenamed("item", "clause")
    return rounded(P.or_pairs(clauses, baskets(spark, sf_dir), 0.02, 0.01, 0.5))


@query("or_disjunctions", f"""WITH {BASKETS}, z AS (SELECT count(*) FILTER (group_label = 'attack') AS na, count(*) FILTER (group_label = 'benign') AS nb FROM baskets),
 c AS (SELECT * FROM items WHERE item LIKE 'size:%' OR item LIKE 'type:%'), o AS (SELECT item, count(*) FILTER (group_label = 'benign') AS n FROM c GROUP BY 1 HAVING n >= (SELECT 0.2 * nb FROM z)),
 p AS (SELECT x.item AS a, y.item AS b, NULL AS c FROM o x JOIN o y ON x.item < y.item UNION ALL SELECT x.item, y.item, w.item FROM o x JOIN o y ON x.item < y.item JOIN o w ON y.item < w.item),
 u AS (SELECT p.a, p.b, p.c, count(DISTINCT gid) FILTER (group_label = 'benign') AS ub, count(DISTINCT gid) FILTER (group_label = 'attack') AS ua,
   greatest(count(DISTINCT CASE WHEN p.c IS NULL THEN CASE WHEN item = p.a THEN gid END WHEN item IN (p.a, p.b) THEN gid END) FILTER (group_label = 'benign'),
    count(DISTINCT CASE WHEN p.c IS NULL THEN CASE WHEN item = p.b THEN gid END WHEN item IN (p.a, p.c) THEN gid END) FILTER (group_label = 'benign'),
    count(DISTINCT CASE WHEN p.c IS NOT NULL AND item IN (p.b, p.c) THEN gid END) FILTER (group_label = 'benign')) AS best
  FROM p JOIN c i ON i.item = p.a OR i.item = p.b OR i.item = p.c GROUP BY 1, 2, 3)
SELECT a || ' OR ' || b || coalesce(' OR ' || c, '') AS pattern, CASE WHEN c IS NULL THEN 2 ELSE 3 END::BIGINT AS n_clauses, ub AS count_benign, ua AS count_attack, round(ub / nb, 6) AS support_benign, round(ua / na, 6) AS support_attack,
 round((ub - best) / nb, 6) AS gain, round(ub / nb / (ua / na + ub / nb), 6) AS confidence_benign FROM u, z WHERE (ub - best) / nb >= 0.2 - 1e-9 AND abs(ua / na - ub / nb) >= 0.01 AND ub / nb / (ua / na + ub / nb) >= 0.4""")
def or_disjunctions(spark, sf_dir):
    clauses = items(spark, sf_dir).where("item like 'size:%' or item like 'type:%'").withColumnRenamed("item", "clause")
    return rounded(P.or_disjunctions(clauses, baskets(spark, sf_dir), 3, 0.2, 0.01, 0.4, leading="benign"))


CONTRAST = f"""WITH {BASKETS}, sz AS (SELECT count(*) FILTER (group_label = 'attack') AS na, count(*) FILTER (group_label = 'benign') AS nb FROM baskets),
 s1 AS (SELECT item, count(*) FILTER (group_label = 'attack') AS a, count(*) FILTER (group_label = 'benign') AS b FROM items GROUP BY 1), live AS (SELECT s1.* FROM s1, sz WHERE a + b < na + nb),
 li AS (SELECT * FROM items WHERE item IN (SELECT item FROM live)),
 p AS (SELECT item AS pattern, a, b FROM live UNION ALL
  SELECT x.item || ' AND ' || y.item, count(*) FILTER (x.group_label = 'attack'), count(*) FILTER (x.group_label = 'benign') FROM li x JOIN li y ON x.gid = y.gid AND x.item < y.item GROUP BY x.item, y.item),
 q AS (SELECT pattern, a, b, na, nb, a / na AS sa, b / nb AS sb, abs(a * (nb - b) - b * (na - a))::DOUBLE AS apart FROM p, sz)"""


@query("contrast_stats", CONTRAST + """ SELECT pattern, a AS count_attack, b AS count_benign, round(sa, 6) AS support_attack, round(sb, 6) AS support_benign, round(sa / (sb + 1e-9), 4) AS growth_rate, round(a / (a + b), 6) AS precision_attack,
 round(sa / (na / (na + nb) + 1e-9), 6) AS lift, round((na + nb) * power(greatest(apart - least(0.5 * (na + nb), apart), 0), 2) / ((a + b)::DOUBLE * (na + nb - a - b) * na * nb), 6) AS chi_square FROM q""")
def contrast_stats(spark, sf_dir):
    return rounded(P.contrast_stats(items(spark, sf_dir), baskets(spark, sf_dir)).withColumn("growth_rate", F.round("growth_rate", 4)))


@query("contrast_survivors", CONTRAST + " SELECT pattern, a AS count_attack, b AS count_benign FROM q WHERE (sa / (sb + 1e-9) >= 1.2 OR (sb > 0 AND sa / (sb + 1e-9) <= 1 / 1.2)) AND NOT (sa / (sb + 1e-9) >= 1.2 AND sa < 0.05) AND NOT (sb > 0 AND sa / (sb + 1e-9) <= 1 / 1.2 AND sb < 0.05)")
def contrast_survivors(spark, sf_dir):
    return P.contrast_survivors(P.contrast_stats(items(spark, sf_dir), baskets(spark, sf_dir)), growth=1.2).select("pattern", "count_attack", "count_benign")


SEQ = f"""WITH {ALERTS}, st AS (SELECT DISTINCT host AS gid, time // 86400 AS pos, signature AS item FROM alerts)"""


def steps(spark, sf_dir):
    return alerts(spark, sf_dir).select(F.col("host").alias("gid"), F.lit("attack").alias("group_label"), F.floor(F.col("time") / 86_400).alias("pos"), F.col("signature").alias("item")).distinct()


@query("sequences_k3", SEQ + """, l1 AS (SELECT item AS pattern, count(DISTINCT gid) AS support_count FROM st GROUP BY 1), l2 AS (SELECT x.item || ' > ' || y.item AS pattern, count(DISTINCT x.gid) AS support_count FROM st x JOIN st y ON x.gid = y.gid AND x.pos < y.pos GROUP BY 1),
 l3 AS (SELECT x.item || ' > ' || y.item || ' > ' || z.item AS pattern, count(DISTINCT x.gid) AS support_count FROM st x JOIN st y ON x.gid = y.gid AND x.pos < y.pos JOIN st z ON x.gid = z.gid AND y.pos < z.pos GROUP BY 1)
SELECT pattern, support_count FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) WHERE support_count >= 40""")
def sequences_k3(spark, sf_dir):
    return P.item_sequences(steps(spark, sf_dir), 40, 3).select(F.array_join("steps", " > ").alias("pattern"), "support_count")


@query("sequence_prefix_subsumed", SEQ + """, l1 AS (SELECT item AS pattern, count(DISTINCT gid) AS n FROM st GROUP BY 1), l2 AS (SELECT x.item || ' > ' || y.item AS pattern, count(DISTINCT x.gid) AS n FROM st x JOIN st y ON x.gid = y.gid AND x.pos < y.pos GROUP BY 1),
 e AS (SELECT pattern FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) WHERE n >= 110) SELECT pattern FROM e x WHERE NOT EXISTS (SELECT 1 FROM e y WHERE y.pattern LIKE x.pattern || ' > %')""")
def sequence_prefix_subsumed(spark, sf_dir):
    return P.without_prefixes(P.item_sequences(steps(spark, sf_dir), 110, 2)).select(F.array_join("steps", " > ").alias("pattern"))


@query("itemset_sequences_k3", SEQ + """, j AS (SELECT x.gid, x.pos, x.item AS a, y.item AS b FROM st x JOIN st y ON x.gid = y.gid AND x.pos = y.pos AND x.item < y.item),
 f AS (SELECT gid, item, min(pos) AS p FROM st GROUP BY 1, 2), f2 AS (SELECT gid, a, b, min(pos) AS p FROM j GROUP BY 1, 2, 3), s2 AS (SELECT f.gid, f.item AS a, st.item AS b, min(st.pos) AS p FROM f JOIN st ON st.gid = f.gid AND st.pos > f.p GROUP BY 1, 2, 3),
 every AS (
  SELECT item AS pattern, 1 AS n_items, 1 AS n_steps, gid FROM st
  UNION ALL SELECT a || '+' || b, 2, 1, gid FROM j
  UNION ALL SELECT f.item || ' > ' || st.item, 2, 2, st.gid FROM f JOIN st ON st.gid = f.gid AND st.pos > f.p
  UNION ALL SELECT j.a || '+' || j.b || '+' || st.item, 3, 1, st.gid FROM j JOIN st ON st.gid = j.gid AND st.pos = j.pos AND st.item > j.b
  UNION ALL SELECT f2.a || '+' || f2.b || ' > ' || st.item, 3, 2, st.gid FROM f2 JOIN st ON st.gid = f2.gid AND st.pos > f2.p
  UNION ALL SELECT f.item || ' > ' || j.a || '+' || j.b, 3, 2, j.gid FROM f JOIN j ON j.gid = f.gid AND j.pos > f.p
  UNION ALL SELECT s2.a || ' > ' || s2.b || ' > ' || st.item, 3, 3, st.gid FROM s2 JOIN st ON st.gid = s2.gid AND st.pos > s2.p)
SELECT pattern, n_items::BIGINT AS n_items, n_steps::BIGINT AS n_steps, count(DISTINCT gid) AS support_count FROM every GROUP BY 1, 2, 3 HAVING count(DISTINCT gid) >= 40""")
def itemset_sequences_k3(spark, sf_dir):
    found = P.itemset_sequences(steps(spark, sf_dir), 40, 3)
    name = F.array_join(F.transform("steps", lambda s: F.array_join(s, "+")), " > ")
    return found.select(name.alias("pattern"), "n_items", "n_steps", "support_count")


def host_sequences(spark, sf_dir):
    per = steps(spark, sf_dir).groupBy("gid", "pos").agg(F.array_sort(F.collect_set("item")).alias("s"))
    return per.groupBy("gid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("context_steps"))


@query("sequence_cross_support", SEQ + """, l AS (SELECT host AS gid, CASE WHEN count(*) FILTER (label = 'attack') * 5 > count(*) THEN 'attack' ELSE 'benign' END AS y FROM alerts GROUP BY 1), z AS (SELECT count(*) FILTER (y = 'attack') AS na, count(*) FILTER (y = 'benign') AS nb FROM l),
 j AS (SELECT DISTINCT x.gid, x.item || ' > ' || y.item AS pattern FROM st x JOIN st y ON x.gid = y.gid AND x.pos < y.pos), k AS (SELECT pattern, count(*) AS support_count, count(*) FILTER (y = 'attack') AS a, count(*) FILTER (y = 'benign') AS b FROM j JOIN l USING (gid) GROUP BY 1)
SELECT pattern, a AS count_attack, b AS count_benign, round(a / na, 6) AS support_attack, round(b / nb, 6) AS support_benign, round(a / na - b / nb, 6) AS support_diff FROM k, z WHERE support_count >= 40""")
def sequence_cross_support(spark, sf_dir):
    per = alerts(spark, sf_dir).groupBy(F.col("host").alias("h__")).agg((F.count_if(F.col("label") == "attack") * 5 > F.count("*")).alias("much"))
    s = host_sequences(spark, sf_dir).join(per, F.col("gid") == F.col("h__")).select("gid", F.when(F.col("much"), "attack").otherwise("benign").alias("group_label"), "context_steps")
    pairs = P.itemset_sequences(steps(spark, sf_dir), 40, 2).where("n_steps = 2")
    out = P.sequence_support(pairs, s)
    name = F.array_join(F.transform("steps", lambda x: x[0]), " > ")
    return rounded(out.select(name.alias("pattern"), "count_attack", "count_benign", "support_attack", "support_benign", "support_diff"))


@query("sequence_containment", SEQ + """ SELECT gid, EXISTS (SELECT 1 FROM st x JOIN st y ON x.gid = y.gid AND x.pos < y.pos WHERE x.gid = g.gid AND x.item = 'click' AND y.item = 'error') AS in_order,
 EXISTS (SELECT 1 FROM st x JOIN st x2 ON x.gid = x2.gid AND x.pos = x2.pos JOIN st y ON x.gid = y.gid AND x.pos < y.pos WHERE x.gid = g.gid AND x.item = 'click' AND x2.item = 'view' AND y.item = 'error') AS steps_in_order FROM (SELECT DISTINCT gid FROM st) g""")
def sequence_containment(spark, sf_dir):
    lit = lambda *xs: F.array(*[F.lit(x) for x in xs])
    s = F.col("context_steps")
    return host_sequences(spark, sf_dir).select("gid", P.contains_items_in_order(s, lit("click", "error")).alias("in_order"), P.contains_steps_in_order(s, F.array(lit("click", "view"), lit("error"))).alias("steps_in_order"))


RULES = R.RuleSet(
    [
        R.Rule("brand1_small", (("brand:Brand#1", "size:small"),)),
        R.Rule("promo_or_large2", (("type:PROMO",), ("brand:Brand#2", "size:large")), source_label="benign"),
        R.Rule("economy_medium", (("size:medium", "type:ECONOMY"),)),
        R.Rule("many_lines", predicates=(R.Predicate("n_lines", ">", 5),)),
        R.Rule("has_brand3", predicates=(R.Predicate("items", "==", "brand:Brand#3", is_set=True), R.Predicate("n_lines", "<=", 4))),
    ]
)
FIRES = f"""WITH {BASKETS}, g AS (SELECT b.gid, b.group_label, b.n_lines, list(item) AS its FROM baskets b JOIN items i ON b.gid = i.gid GROUP BY 1, 2, 3),
 e AS (SELECT gid, group_label, list_has_all(its, ['brand:Brand#1', 'size:small'])::INT AS brand1_small, (list_contains(its, 'type:PROMO') OR list_has_all(its, ['brand:Brand#2', 'size:large']))::INT AS promo_or_large2,
  list_has_all(its, ['size:medium', 'type:ECONOMY'])::INT AS economy_medium, (n_lines > 5)::INT AS many_lines, (list_contains(its, 'brand:Brand#3') AND n_lines <= 4)::INT AS has_brand3 FROM g),
 f AS (UNPIVOT (SELECT * FROM e) ON brand1_small, promo_or_large2, economy_medium, many_lines, has_brand3 INTO NAME feature VALUE v),
 fired AS (SELECT gid, group_label, feature FROM f WHERE v = 1)"""


@query("rule_encode", FIRES + " SELECT gid, brand1_small, promo_or_large2, economy_medium, many_lines, has_brand3, 0 AS never_made FROM e")
def rule_encode(spark, sf_dir):
    names = [r.name for r in RULES.rules]
    return R.encode(baskets(spark, sf_dir), RULES, ["gid"], [*names, "never_made"])


@query("rule_rates", FIRES + " SELECT feature, count(*) AS n_fires, round(avg((group_label = 'attack')::INT), 6) AS attack_rate FROM fired GROUP BY 1")
def rule_rates(spark, sf_dir):
    return rounded(R.rule_rates(R.firing(baskets(spark, sf_dir), RULES, ["gid", "group_label"])))


@query("precision_gate", FIRES + """, r AS (SELECT feature, count(*) AS n_fires, avg((group_label = 'attack')::INT) AS rate FROM fired GROUP BY 1), p AS (SELECT avg((group_label = 'attack')::INT) AS pi FROM baskets)
SELECT feature, n_fires, CASE WHEN feature = 'promo_or_large2' THEN 'benign' ELSE 'attack' END AS source_label FROM r, p WHERE CASE WHEN feature = 'promo_or_large2' THEN rate <= pi / 0.8 ELSE rate >= 1.02 * pi END""")
def precision_gate(spark, sf_dir):
    b = baskets(spark, sf_dir)
    base = b.agg(F.avg((F.col("group_label") == "attack").cast("double"))).first()[0]
    label = F.when(F.col("feature") == "promo_or_large2", "benign").otherwise("attack")
    rates = R.rule_rates(R.firing(b, RULES, ["gid", "group_label"])).withColumn("source_label", label)
    return P.gate(rates, base, 1.02, 0.8).select("feature", "n_fires", "source_label")


@query("firing_jaccard", FIRES + """, n AS (SELECT feature, count(*) AS n FROM fired GROUP BY 1), b AS (SELECT x.feature, y.feature AS other, count(*) AS s FROM fired x JOIN fired y ON x.gid = y.gid AND x.feature < y.feature GROUP BY 1, 2)
SELECT b.feature, b.other, round(s / (x.n + y.n - s), 6) AS jaccard FROM b JOIN n x ON x.feature = b.feature JOIN n y ON y.feature = b.other""")
def firing_jaccard(spark, sf_dir):
    return rounded(P.firing_jaccard(R.firing(baskets(spark, sf_dir), RULES, ["gid"])))


@query("identical_firing", FIRES + " SELECT feature, 1::BIGINT AS n_same, count(*) AS n_fires FROM fired GROUP BY 1")
def identical_firing(spark, sf_dir):
    return P.identical_firing(R.firing(baskets(spark, sf_dir), RULES, ["gid"]))


@query("tree_stump", f"""WITH {ALERTS}, pts AS (SELECT round(value, 0) AS v, sum((label = 'attack')::INT) AS p, sum((label <> 'attack')::INT) AS n FROM alerts GROUP BY 1),
 c AS (SELECT v, lead(v) OVER (ORDER BY v) AS nx, sum(p) OVER (ORDER BY v) / sum(p) OVER () AS lp, sum(n) OVER (ORDER BY v) / sum(n) OVER () AS ln FROM pts),
 g AS (SELECT (v + nx) / 2 AS threshold, ((lp + ln) * (1 - (lp / (lp + ln)) ** 2 - (ln / (lp + ln)) ** 2) + (2 - lp - ln) * (1 - ((1 - lp) / (2 - lp - ln)) ** 2 - ((1 - ln) / (2 - lp - ln)) ** 2)) / 2 AS impurity FROM c WHERE nx IS NOT NULL)
SELECT threshold, round(impurity, 6) AS impurity FROM g ORDER BY round(impurity, 12), threshold LIMIT 1""")
def tree_stump(spark, sf_dir):
    rows = alerts(spark, sf_dir).select(F.round("value", 0).alias("value"), (F.col("label") == "attack").cast("int").alias("y"))
    return rounded(R.stump(rows, "value"))


WINDOWED = f"""WITH {ALERTS}, r AS (SELECT *, row_number() OVER (ORDER BY time, row_id) AS rn, count(*) OVER () AS n_rows FROM alerts),
 w AS (SELECT *, least((rn - 1) // greatest(1, CAST(floor(0.1 * n_rows) AS BIGINT)), greatest(1, n_rows // greatest(1, CAST(floor(0.1 * n_rows) AS BIGINT))) - 1) AS win_idx FROM r)"""


def windowed(spark, sf_dir):
    return W.with_windows(B.numbered_rows(alerts(spark, sf_dir), "time", "row_id"), 0.1)


def _expected(windows):
    return windows.where("win_idx = 0").groupBy(F.col("signature").alias("predicate_id")).agg((F.count("*") / F.first("total")).alias("p_expected"))


@query("psi_signal", WINDOWED + """, t AS (SELECT win_idx, count(*) AS n_observed FROM w GROUP BY 1), e AS (SELECT signature AS predicate_id, count(*) / (SELECT n_observed FROM t WHERE win_idx = 0) AS e FROM w WHERE win_idx = 0 GROUP BY 1),
 o AS (SELECT win_idx, signature, count(*) AS n FROM w GROUP BY 1, 2), x AS (SELECT t.win_idx, e.predicate_id, e, coalesce(n, 0) / n_observed AS o, n_observed FROM t CROSS JOIN e LEFT JOIN o ON o.win_idx = t.win_idx AND o.signature = e.predicate_id),
 y AS (SELECT *, (o - e) * ln(o / e) + ((1 - o) - (1 - e)) * ln((1 - o) / (1 - e)) AS psi FROM x)
SELECT win_idx, predicate_id, round(e, 6) AS p_expected, round(o, 6) AS p_observed, n_observed, round(psi, 6) AS psi, psi > 0.1 AS elevated, psi > 0.2 AS significant FROM y""")
def psi_signal(spark, sf_dir):
    w = windowed(spark, sf_dir)
    totals = w.groupBy("win_idx").agg(F.count("*").alias("n_observed"))
    first = totals.where("win_idx = 0").select(F.col("n_observed").alias("total"), F.lit(0).cast("bigint").alias("z__"))
    expected = _expected(w.join(F.broadcast(first), F.col("win_idx") == F.col("z__")))
    return rounded(D.rate_signal(w.select("win_idx", F.col("signature").alias("predicate_id")), totals, expected))


@query("calibration_signal", WINDOWED + """, m AS (SELECT win_idx, signature AS rule_id, (value > 30) AS correct FROM w)
SELECT win_idx, rule_id, round(0.6, 6)::DOUBLE AS mined_confidence, count(*) AS n_matching, CASE WHEN count(*) >= 200 THEN round(avg(correct::INT), 6) END AS observed_confidence, CASE WHEN count(*) >= 200 THEN round(abs(avg(correct::INT) - 0.6), 6) END AS drift,
 coalesce(CASE WHEN count(*) >= 200 THEN abs(avg(correct::INT) - 0.6) > 0.1 END, false) AS elevated FROM m GROUP BY 1, 2""")
def calibration_signal(spark, sf_dir):
    m = windowed(spark, sf_dir).select("win_idx", F.col("signature").alias("rule_id"), (F.col("value") > 30).alias("correct"))
    mined = m.select("rule_id").distinct().withColumn("confidence", F.lit(0.6))
    return rounded(D.calibration_signal(m, mined, min_samples=200))


FLAGS = f"""WITH {ALERTS}, d AS (SELECT host AS scenario, time // 86400 AS win_idx, bool_or(label = 'attack') AS signal_1, count(*) > 3 AS signal_2 FROM alerts GROUP BY 1, 2),
 s AS (SELECT *, row_number() OVER w AS seq FROM d WINDOW w AS (PARTITION BY scenario ORDER BY win_idx)),
 k AS (SELECT *, CASE WHEN signal_1 THEN seq - coalesce(max(CASE WHEN NOT signal_1 THEN seq END) OVER w, 0) ELSE 0 END AS streak_1, CASE WHEN signal_2 THEN seq - coalesce(max(CASE WHEN NOT signal_2 THEN seq END) OVER w, 0) ELSE 0 END AS streak_2
  FROM s WINDOW w AS (PARTITION BY scenario ORDER BY win_idx ROWS UNBOUNDED PRECEDING)),
 a AS (SELECT *, CASE WHEN NOT signal_1 AND NOT signal_2 THEN 'NO_ACTION' WHEN signal_1 AND signal_2 THEN 'REMINE_AND_RETRAIN' WHEN streak_1 < 3 AND streak_2 < 3 THEN 'SOFT_ALERT' WHEN signal_1 THEN 'RETRAIN_ONLY' ELSE 'REMINE_AND_RETRAIN' END AS action FROM k)"""


def flags(spark, sf_dir):
    days = alerts(spark, sf_dir).groupBy(F.col("host").alias("scenario"), F.floor(F.col("time") / 86_400).alias("win_idx"))
    return days.agg(F.bool_or(F.col("label") == "attack").alias("signal_1"), (F.count("*") > 3).alias("signal_2"))


@query("monitor_triggers", FLAGS + " SELECT scenario, win_idx, signal_1, signal_2, streak_1::BIGINT AS streak_1, streak_2::BIGINT AS streak_2, action, action NOT IN ('NO_ACTION', 'SOFT_ALERT') AS trigger_remine FROM a")
def monitor_triggers(spark, sf_dir):
    t = D.triggers(flags(spark, sf_dir))
    return t.withColumn("streak_1", F.col("streak_1").cast("bigint")).withColumn("streak_2", F.col("streak_2").cast("bigint"))


@query("trigger_first_horizon", FLAGS + " SELECT scenario, min(win_idx) AS first_trigger FROM a WHERE action NOT IN ('NO_ACTION', 'SOFT_ALERT') GROUP BY 1")
def trigger_first_horizon(spark, sf_dir):
    return D.triggers(flags(spark, sf_dir)).where("trigger_remine").groupBy("scenario").agg(F.min("win_idx").alias("first_trigger"))


TOPS = WINDOWED + ", c AS (SELECT win_idx, host AS feature, count(*) AS n FROM w GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY win_idx ORDER BY n DESC, feature) AS k FROM c), top AS (SELECT win_idx, feature FROM t WHERE k <= 20)"


def tops(spark, sf_dir):
    from pyspark.sql import Window

    c = windowed(spark, sf_dir).groupBy("win_idx", F.col("host").alias("feature")).agg(F.count("*").alias("n"))
    return c.withColumn("k", F.row_number().over(Window.partitionBy("win_idx").orderBy(F.desc("n"), "feature"))).where("k <= 20").select("win_idx", "feature")


@query("feature_stability", TOPS + """, sz AS (SELECT win_idx, count(*) AS n FROM top GROUP BY 1), p AS (SELECT x.win_idx, count(y.feature) AS u FROM top x LEFT JOIN top y ON y.win_idx = x.win_idx - 1 AND y.feature = x.feature WHERE x.win_idx > 0 GROUP BY 1)
SELECT 'all' AS scope, p.win_idx, a.n - u AS added, b.n - u AS removed, u AS unchanged, round(u / (a.n + b.n - u), 6) AS jaccard FROM p JOIN sz a ON a.win_idx = p.win_idx JOIN sz b ON b.win_idx = p.win_idx - 1""")
def feature_stability(spark, sf_dir):
    sets = tops(spark, sf_dir).groupBy("win_idx").agg(F.collect_set("feature").alias("features")).withColumn("scope", F.lit("all"))
    out = D.stability(sets, ["scope"], "win_idx")
    return rounded(out.select("scope", "win_idx", *[F.col(c).cast("bigint").alias(c) for c in ("added", "removed", "unchanged")], "jaccard"))


@query("feature_persistence", TOPS + ", p AS (SELECT feature, count(*) AS n_windows FROM top GROUP BY 1) SELECT n_windows, count(*) AS n_features FROM p GROUP BY 1")
def feature_persistence(spark, sf_dir):
    return D.persistence(tops(spark, sf_dir))


@query("schema_diff", TOPS + """, b AS (SELECT feature, 'attack' AS p FROM top WHERE win_idx = 0), a AS (SELECT feature, CASE WHEN length(feature) % 2 = 0 THEN 'attack' ELSE 'benign' END AS p FROM top WHERE win_idx = 1)
SELECT count(*) FILTER (b.feature IS NULL) AS added, count(*) FILTER (a.feature IS NULL) AS removed, count(*) FILTER (a.p <> b.p) AS changed, count(b.feature) AS before,
 round((count(*) FILTER (b.feature IS NULL) + count(*) FILTER (a.feature IS NULL) + count(*) FILTER (a.p <> b.p)) / count(b.feature), 6) AS churn FROM b FULL JOIN a ON a.feature = b.feature""")
def schema_diff(spark, sf_dir):
    t = tops(spark, sf_dir)
    before = t.where("win_idx = 0").select(F.col("feature").alias("rule_id"), F.lit("attack").alias("prediction"))
    after = t.where("win_idx = 1").select(F.col("feature").alias("rule_id"), F.when(F.length("feature") % 2 == 0, "attack").otherwise("benign").alias("prediction"))
    return rounded(R.schema_diff(before, after))


@query("best_lag_corr", f"""WITH {ALERTS}, s AS (SELECT time // 86400 AS d, count(*)::DOUBLE AS x, sum((label = 'attack')::INT)::DOUBLE AS y FROM alerts GROUP BY 1), l AS (SELECT unnest([0, 1, 2, 3]) AS lag),
 p AS (SELECT lag, count(*) AS n, corr(s.x, t.y) AS r FROM s, l, s t WHERE t.d = s.d + lag GROUP BY 1 HAVING count(*) >= 3) SELECT lag, n, round(r, 6) AS r FROM p ORDER BY r DESC, lag LIMIT 1""")
def best_lag_corr(spark, sf_dir):
    s = alerts(spark, sf_dir).groupBy(F.floor(F.col("time") / 86_400).alias("d")).agg(F.count("*").cast("double").alias("x"), F.count_if(F.col("label") == "attack").cast("double").alias("y"))
    return rounded(D.best_lag(s, "d", "x", "y", [0, 1, 2, 3]))


@query("bernoulli_oneclass", FIRES + """, n AS (SELECT count(*) AS n FROM baskets WHERE group_label = 'benign'), q AS (SELECT feature, (sum(v) FILTER (group_label = 'benign') + 1) / (n + 2) AS p FROM f, n GROUP BY feature, n),
 sc AS (SELECT gid, group_label, sum(v * ln(p) + (1 - v) * ln(1 - p)) AS score FROM f JOIN q USING (feature) GROUP BY 1, 2), t AS (SELECT quantile_cont(score, 0.05) AS cut FROM sc WHERE group_label = 'benign')
SELECT gid, round(score, 6) AS score, score < cut - 1e-9 AS is_outlier FROM sc, t""")
def bernoulli_oneclass(spark, sf_dir):
    names = [r.name for r in RULES.rules]
    x = R.encode(baskets(spark, sf_dir), RULES, ["gid", "group_label"])
    return rounded(bernoulli(x, names, F.col("group_label") == "benign").select("gid", "score", "is_outlier"))


def bernoulli(rows, names, train, percent=0.05):
    """Smoothed Bernoulli likelihood from the training rows; outliers score below their fifth percentile."""
    n = F.count_if(train)
    model = rows.agg(*[((F.sum(F.when(train, F.col(c)).otherwise(0)) + 1) / (n + 2)).alias(f"p_{c}") for c in names]).withColumn("k__", F.lit(1))
    with_model = rows.withColumn("k__", F.lit(1)).join(F.broadcast(model), "k__")
    score = sum(F.col(c) * F.log(F.col(f"p_{c}")) + (1 - F.col(c)) * F.log(1 - F.col(f"p_{c}")) for c in names)
    scored = with_model.select(*rows.columns, "k__", score.alias("score"))
    cut = scored.where(train).agg(F.percentile("score", percent).alias("cut")).withColumn("k__", F.lit(1))
    return scored.join(F.broadcast(cut), "k__").withColumn("is_outlier", F.col("score") < F.col("cut") - 1e-9).drop("k__", "cut")


@query("effect_and_psi_scalars", "SELECT round((0.4 - 0.2) * ln(0.4 / 0.2) + (0.6 - 0.8) * ln(0.6 / 0.8), 6) AS psi, 'medium' AS effect")
def effect_and_psi_scalars(spark, sf_dir):
    return rounded(spark.range(1).select(M.psi(F.lit(0.2), F.lit(0.4)).alias("psi"), M.effect_size(F.lit(0.1)).alias("effect")))
