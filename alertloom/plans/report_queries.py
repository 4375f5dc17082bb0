"""Queries of reports, token abstraction and pattern clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.functions import tokens as T
from alertloom.operators import mining as P
from alertloom.operators import reports as O
from alertloom.operators import rules as R
from alertloom.plans.grouping_queries import GROUPED, SESSIONS, grouped, sessions
from alertloom.plans.mining_queries import CONTRAST, FIRES, RULES, SETS, TOPS, items, joined, scored_sets, tops
from alertloom.plans.registry import ALERTS, query, rounded
from alertloom.plans.window_queries import SCORED, scored
from alertloom.sources.events import alerts, baskets, table


@query("signature_lookup", f"WITH {ALERTS}, d AS (SELECT signature, min(row_id) AS signature_id FROM alerts GROUP BY 1) SELECT row_id, signature_id FROM alerts JOIN d USING (signature)")
def signature_lookup(spark, sf_dir):
    a = alerts(spark, sf_dir)
    return O.lookup(a.select("row_id", "signature"), a.select("signature", F.col("row_id").alias("signature_id")), "signature", "signature_id").select("row_id", "signature_id")


@query("context_sequences", f"""WITH {ALERTS} SELECT row_id, coalesce((SELECT string_agg(b.signature, '>' ORDER BY b.time, b.row_id) FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY time, row_id) AS k FROM alerts) b WHERE b.host = a.host AND b.k BETWEEN a.k - 5 AND a.k - 1 AND b.time >= a.time - 86400), '') AS context
FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY time, row_id) AS k FROM alerts) a""")
def context_sequences(spark, sf_dir):
    return O.context_sequences(alerts(spark, sf_dir), 5, 86_400).select("row_id", F.array_join("context", ">").alias("context"))


@query("delta_grid", "SELECT round(b * power(2.0, i), 6) AS delta FROM (SELECT unnest([1.0, 1.5]) AS b), (SELECT unnest(range(-7, 14)) AS i)")
def delta_grid(spark, sf_dir):
    return rounded(spark.range(1).select(F.explode(O.delta_grid()).alias("delta")))


@query("signature_parse", """SELECT p_partkey, 'ET' AS ruleset, upper(p_type) AS category, p_name AS description FROM part""")
def signature_parse(spark, sf_dir):
    line = F.concat(F.lit("ET "), F.upper("p_type"), F.lit(" "), "p_name", F.lit(" [tag]"))
    return table(spark, sf_dir, "part").withColumn("p_name", F.trim("p_name")).select("p_partkey", *[c.alias(k) for k, c in T.parse_signature(line).items()])


@query("description_bigrams", """WITH w AS (SELECT p_partkey, list_filter(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> 'red' AND length(x) > 1) AS t FROM part)
SELECT p_partkey, array_to_string(t, ' ') AS words, CASE WHEN len(t) > 1 THEN t[1] || '_' || t[2] ELSE '' END AS bigrams FROM w""")
def description_bigrams(spark, sf_dir):
    w = T.content_tokens(F.col("p_name"), ["red"], [])
    return table(spark, sf_dir, "part").select("p_partkey", w.alias("w")).select("p_partkey", F.array_join("w", " ").alias("words"), F.array_join(T.bigrams(F.col("w")), " ").alias("bigrams"))


@query("abstracted_patterns", SETS + """, ab AS (SELECT list_sort(list_distinct([CASE WHEN i LIKE 'brand:%' THEN 'brand' ELSE i END for i in its])) AS up, sa - sb AS d, pattern FROM scored), r AS (SELECT *, row_number() OVER (PARTITION BY up ORDER BY round(abs(d), 12) DESC, pattern) AS k FROM ab)
SELECT array_to_string(up, ' & ') AS pattern, round(d, 6) AS support_diff FROM r WHERE k = 1""")
def abstracted_patterns(spark, sf_dir):
    s = scored_sets(spark, sf_dir)
    up = F.array_sort(F.array_distinct(F.transform("items", lambda t: F.when(t.startswith("brand:"), "brand").otherwise(t))))
    rows = joined(s.withColumn("up", F.array_join(up, " & ")))
    return rounded(O.best_per_key(rows, "up", F.round(F.abs("support_diff"), 12), "pattern").select(F.col("up").alias("pattern"), "support_diff"))


@query("redundant_sequences", f"""WITH {SESSIONS}, turns AS (SELECT group_id, signature, time, row_id, CASE WHEN signature = lag(signature) OVER w THEN 0 ELSE 1 END AS fr FROM sessions WINDOW w AS (PARTITION BY group_id ORDER BY time, row_id)),
 runs AS (SELECT group_id, run, any_value(signature) AS s, count(*) AS n FROM (SELECT *, sum(fr) OVER (PARTITION BY group_id ORDER BY time, row_id) AS run FROM turns) GROUP BY 1, 2),
 e AS (SELECT group_id, string_agg(s, ' ' ORDER BY run) AS plain, string_agg(s || CASE WHEN n = 1 THEN '' WHEN n = 2 THEN '__repeat_2' WHEN n <= 4 THEN '__repeat_3_4' ELSE '__repeat_5_plus' END, ' ' ORDER BY run) AS encoded FROM runs GROUP BY 1),
 c AS (SELECT plain, encoded, count(*) AS n FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY plain ORDER BY n DESC, encoded) AS k FROM c) SELECT encoded, n FROM r WHERE k = 1""")
def redundant_sequences(spark, sf_dir):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("time", "row_id", "signature"))), lambda x: x["signature"])
    e = sessions(spark, sf_dir).groupBy("group_id").agg(ordered.alias("s")).select(F.array_join(T.run_lengths(F.col("s")), " ").alias("encoded"))
    c = e.groupBy("encoded").agg(F.count("*").alias("n")).withColumn("plain", T.decode_runs(F.col("encoded")))
    return O.best_per_key(c, "plain", F.col("n"), "encoded").select("encoded", "n")


@query("top_itemsets_per_class", SETS + """, l AS (SELECT pattern, CASE WHEN sa > sb THEN 'attack' ELSE 'benign' END AS cls, greatest(sa, sb) / (sa + sb) AS conf, greatest(sa, sb) AS sup, k FROM scored), r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY round(conf, 12) DESC, round(sup, 12) DESC, k DESC, pattern) AS n FROM l)
SELECT pattern, cls FROM r WHERE n <= 15""")
def top_itemsets_per_class(spark, sf_dir):
    s = joined(P.confidence(scored_sets(spark, sf_dir))).withColumn("cls", F.when(F.col("support_attack") > F.col("support_benign"), "attack").otherwise("benign"))
    conf, sup = F.greatest("confidence_attack", "confidence_benign"), F.greatest("support_attack", "support_benign")
    return O.top_per_class(s, "cls", [F.desc(F.round(conf, 12)), F.desc(F.round(sup, 12)), F.desc("k"), F.col("pattern")], 15).select("pattern", "cls")


@query("pattern_lean", SETS + " SELECT CASE WHEN sa - sb >= 0.01 THEN 'attack' WHEN sa - sb <= -0.01 THEN 'benign' ELSE 'neutral' END AS lean, k::BIGINT AS k, count(*) AS n FROM scored GROUP BY 1, 2")
def pattern_lean(spark, sf_dir):
    return scored_sets(spark, sf_dir).groupBy(O.lean(F.col("support_diff"), 0.01).alias("lean"), "k").agg(F.count("*").alias("n"))


@query("feature_funnel", SETS + " SELECT count(*) AS mined, count(*) FILTER (k >= 2) AS longer, count(*) FILTER (k >= 2 AND abs(sa - sb) >= 0.005) AS discriminative, count(*) FILTER (k >= 2 AND abs(sa - sb) >= 0.005 AND sa > sb) AS attack_leaning FROM scored")
def feature_funnel(spark, sf_dir):
    d = F.col("support_diff")
    return O.funnel(scored_sets(spark, sf_dir), {"longer": F.col("k") >= 2, "discriminative": F.abs(d) >= 0.005, "attack_leaning": d > 0})


@query("token_frequency", SETS + " SELECT item, count(*) AS n FROM (SELECT unnest(its) AS item FROM sets) GROUP BY 1")
def token_frequency(spark, sf_dir):
    return scored_sets(spark, sf_dir).select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))


@query("smart_filter", SETS + " SELECT pattern FROM scored WHERE sa / (sa + sb) >= 0.52 OR sa <= sb * 0.9")
def smart_filter(spark, sf_dir):
    s = joined(P.confidence(scored_sets(spark, sf_dir)))
    return s.where((F.col("confidence_attack") >= 0.52) | (F.col("support_attack") <= F.col("support_benign") * 0.9)).select("pattern")


@query("survivor_curve", CONTRAST + ", t AS (SELECT unnest([1.0, 1.1, 1.2, 1.5]) AS threshold) SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (sa / (sb + 1e-9) >= threshold) AS n_survivors FROM q, t GROUP BY 1")
def survivor_curve(spark, sf_dir):
    return O.survivor_curve(P.contrast_stats(items(spark, sf_dir), baskets(spark, sf_dir)), "growth_rate", [1.0, 1.1, 1.2, 1.5])


@query("dropped_reasons", CONTRAST + """, g AS (SELECT *, sa / (sb + 1e-9) AS gr FROM q), keep AS (SELECT pattern FROM g WHERE (gr >= 1.2 OR (sb > 0 AND gr <= 1 / 1.2)) AND NOT (gr >= 1.2 AND sa < 0.05) AND NOT (sb > 0 AND gr <= 1 / 1.2 AND sb < 0.05))
SELECT pattern, CASE WHEN gr < 1.2 AND (sb = 0 OR gr > 1 / 1.2) THEN 'not_discriminative' WHEN greatest(sa, sb) < 0.05 THEN 'low_coverage' ELSE 'side_coverage' END AS reason FROM g WHERE pattern NOT IN (SELECT pattern FROM keep)""")
def dropped_reasons(spark, sf_dir):
    stats = P.contrast_stats(items(spark, sf_dir), baskets(spark, sf_dir))
    return O.dropped_reasons(stats, P.contrast_survivors(stats, growth=1.2), 1.2, 0.05)


@query("dynamic_predicates", CONTRAST + """ SELECT 'cat:' || pattern AS predicate_id FROM q WHERE pattern NOT LIKE '% AND %' UNION ALL SELECT 'num:n_lines_gt#1' UNION ALL SELECT 'num:n_lines_gt#2' UNION ALL SELECT 'num:n_lines_le'""")
def dynamic_predicates(spark, sf_dir):
    singles = P.contrast_stats(items(spark, sf_dir), baskets(spark, sf_dir)).where(~F.col("pattern").contains(" AND "))
    numeric = spark.createDataFrame([("n_lines", "gt", 5.0), ("n_lines", "gt", 2.0), ("n_lines", "le", 4.0)], "field string, op string, value double")
    return O.dynamic_predicates(singles, numeric)


@query("equivalence_flags", FIRES + """, c AS (SELECT gid, item FROM items), nf AS (SELECT feature, count(*) AS nf FROM fired GROUP BY 1), nc AS (SELECT item, count(*) AS nc FROM c GROUP BY 1), s AS (SELECT feature, item, count(*) AS n FROM fired JOIN c USING (gid) GROUP BY 1, 2),
 j AS (SELECT feature, item, n / (nf + nc - n) AS jac FROM s JOIN nf USING (feature) JOIN nc USING (item)), r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round(jac, 12) DESC, item) AS k FROM j)
SELECT feature, item AS signature, round(jac, 6) AS jaccard, jac >= 0.9 AS equivalent FROM r WHERE k = 1""")
def equivalence_flags(spark, sf_dir):
    b = baskets(spark, sf_dir)
    return rounded(O.equivalence(R.firing(b, RULES, ["gid"]), P.long_items(b).select("gid", F.col("item").alias("signature"))))


@query("seen_unseen_recall", SCORED + """, s AS (SELECT DISTINCT host FROM scored WHERE row_id % 97 = 0), p AS (SELECT score >= 40 AS hit, host IN (SELECT host FROM s) AS seen FROM scored WHERE y = 1)
SELECT round(avg(hit::INT) FILTER (seen), 6) AS recall_seen, round(avg(hit::INT) FILTER (NOT seen), 6) AS recall_unseen, count(*) FILTER (seen) AS n_seen, count(*) FILTER (NOT seen) AS n_unseen FROM p""")
def seen_unseen_recall(spark, sf_dir):
    s = scored(spark, sf_dir)
    return rounded(O.seen_recall(s, s.where("row_id % 97 = 0"), "host", 40.0))


@query("coverage_by_direction", FIRES + """, d AS (SELECT i.item, CASE WHEN i.item LIKE 'brand:%1' THEN 'attack' ELSE 'benign' END AS direction FROM (SELECT DISTINCT item FROM items WHERE item LIKE 'brand:%1' OR item LIKE 'type:S%') i),
 m AS (SELECT DISTINCT gid, (group_label = 'attack')::INT AS y, direction FROM items JOIN d USING (item)), t AS (SELECT count(*) AS n, sum((group_label = 'attack')::INT) AS a FROM baskets)
SELECT direction, round(count(*) / any_value(n), 6) AS share, round(sum(y) / any_value(a), 6) AS attack_share FROM m, t GROUP BY 1""")
def coverage_by_direction(spark, sf_dir):
    rows = items(spark, sf_dir).select("gid", "item", (F.col("group_label") == "attack").cast("int").alias("y"))
    flagged = rows.select("item").distinct().where("item like 'brand:%1' or item like 'type:S%'")
    return rounded(O.coverage_by_direction(flagged.withColumn("direction", F.when(F.col("item").like("brand:%1"), "attack").otherwise("benign")), rows))


@query("pooled_seeds", f"""WITH {ALERTS}, s AS (SELECT signature AS arm, row_id % 5 AS seed, time // 86400 AS step, avg(value) AS v, sum((value >= 60)::INT) AS hits, count(*) AS pos FROM alerts GROUP BY 1, 2, 3),
 p AS (SELECT arm, seed, avg(v) AS v, sum(hits) / sum(pos) AS r FROM s GROUP BY 1, 2) SELECT arm, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std, round(avg(r), 6) AS pooled_recall, count(*) AS n_seeds FROM p GROUP BY 1""")
def pooled_seeds(spark, sf_dir):
    s = alerts(spark, sf_dir).groupBy(F.col("signature").alias("arm"), (F.col("row_id") % 5).alias("seed"), F.floor(F.col("time") / 86_400).alias("step"))
    return rounded(O.pooled(s.agg(F.avg("value").alias("v0"), F.count_if(F.col("value") >= 60).alias("hits"), F.count("*").alias("pos")), "arm", "seed", "v0", "hits", "pos"))


@query("window_set_delta", TOPS + """, x AS (SELECT feature FROM top WHERE win_idx < 5), y AS (SELECT feature FROM top WHERE win_idx >= 5), a AS (SELECT DISTINCT feature FROM x), b AS (SELECT DISTINCT feature FROM y)
SELECT 'all' AS scope, count(*) FILTER (b.feature IS NULL) AS only_a, count(*) FILTER (a.feature IS NULL) AS only_b, count(*) FILTER (a.feature IS NOT NULL AND b.feature IS NOT NULL) AS both FROM a FULL JOIN b ON a.feature = b.feature""".replace(", x AS", ", x0 AS").replace("FROM x)", "FROM x0)"))
def window_set_delta(spark, sf_dir):
    t = tops(spark, sf_dir).withColumn("scope", F.lit("all"))
    return O.set_delta(t.where("win_idx < 5"), t.where("win_idx >= 5"), "feature", ["scope"])


@query("false_positives_per_day", f"WITH {ALERTS} SELECT count(*) FILTER (value >= 60 AND label <> 'attack') AS n_flagged, round(count(*) FILTER (value >= 60 AND label <> 'attack') / ((max(time) - min(time)) / 86400.0), 6) AS per_day FROM alerts")
def false_positives_per_day(spark, sf_dir):
    return rounded(O.per_day(alerts(spark, sf_dir), (F.col("value") >= 60) & (F.col("label") != "attack")))


@query("routing_funnel", f"WITH {GROUPED} SELECT count(*) FILTER (n_alerts >= 4) AS escalated, count(*) FILTER (n_alerts < 4) AS suppressed, coalesce(sum(n_alerts) FILTER (n_alerts >= 4), 0)::BIGINT AS alerts_escalated, coalesce(sum(n_alerts) FILTER (n_alerts < 4), 0)::BIGINT AS alerts_suppressed FROM grouped")
def routing_funnel(spark, sf_dir):
    return O.routing(grouped(spark, sf_dir), "n_alerts", 4)


@query("scenario_ids", f"WITH {ALERTS} SELECT time // 86400 AS day, string_agg(DISTINCT signature, '+' ORDER BY signature) AS scenario FROM alerts GROUP BY 1")
def scenario_ids(spark, sf_dir):
    return alerts(spark, sf_dir).groupBy(F.floor(F.col("time") / 86_400).alias("day")).agg(T.scenario_id(F.collect_set(F.concat(F.lit(" "), F.initcap("signature")))).alias("scenario"))
