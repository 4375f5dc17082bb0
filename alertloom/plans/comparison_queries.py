"""Queries of comparisons over steps and of mining jobs end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.operators import comparison as C
from alertloom.operators import jobs as J
from alertloom.operators import mining as P
from alertloom.operators import trees as T
from alertloom.plans.mining_queries import SEQ, SETS, joined, scored_sets, steps
from alertloom.plans.registry import ALERTS, query, rounded
from alertloom.plans.window_queries import CONFIGS, configs
from alertloom.sources.events import alerts, baskets, table

MEANS = f"{CONFIGS}, m AS (SELECT block AS step, config AS arm, metric AS value FROM r)"


def means(spark, sf_dir):
    return C.step_means(configs(spark, sf_dir), "block", "config", "metric")


@query("friedman_ranks", f"""WITH {MEANS}, f AS (SELECT step FROM m GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT arm) FROM m)),
 k AS (SELECT arm, rank() OVER (PARTITION BY step ORDER BY value DESC) + (count(*) OVER (PARTITION BY step, value) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY step, value) AS t FROM m WHERE step IN (SELECT step FROM f)),
 a AS (SELECT arm, avg(rk) AS average_rank, count(*) AS n, sum(t * t - 1.0) AS tied FROM k GROUP BY 1), z AS (SELECT count(*) AS arms, any_value(n) AS n, sum(tied) AS tied, sum((average_rank - ((SELECT count(*) FROM a) + 1) / 2.0) ** 2) AS ss FROM a)
SELECT arm, round(average_rank, 6) AS average_rank, a.n AS n_steps, arms AS n_arms, round(12.0 * z.n / (arms * (arms + 1)) * ss / (1 - z.tied / (z.n * arms * (arms * arms - 1))), 6) AS chi_square FROM a, z""")
def friedman_ranks(spark, sf_dir):
    return rounded(C.friedman(means(spark, sf_dir)))


@query("helps_hurts", f"""WITH {MEANS}, d AS (SELECT a.arm, a.value - b.value AS d FROM m a JOIN m b ON a.step = b.step WHERE a.arm <> 'STANDARD' AND b.arm = 'STANDARD')
SELECT arm, count(*) AS n_steps, round(avg(d), 6) AS mean_delta, round(quantile_cont(d, 0.5), 6) AS median_delta, count(*) FILTER (d > 0) AS helps, count(*) FILTER (d < 0) AS hurts, count(*) FILTER (d = 0) AS ties FROM d GROUP BY 1""")
def helps_hurts(spark, sf_dir):
    return rounded(C.helps_hurts(means(spark, sf_dir), "STANDARD"))


VARIANTS = "v AS (SELECT p_brand AS step, CASE WHEN p_size <= 25 THEN 'small' ELSE 'large' END AS method, p_type AS variant, avg(p_retailprice) / 1000 AS value FROM part GROUP BY 1, 2, 3)"


def variants(spark, sf_dir):
    method = F.when(F.col("p_size") <= 25, "small").otherwise("large")
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("step"), method.alias("method"), F.col("p_type").alias("variant")).agg((F.avg("p_retailprice") / 1000).alias("value"))


@query("stress_contrasts", f"""WITH {VARIANTS}, a AS (SELECT method, variant, avg(value) AS m FROM v GROUP BY 1, 2),
 e AS (SELECT method, first(variant ORDER BY m DESC, variant DESC) AS best, first(variant ORDER BY m, variant) AS worst FROM a GROUP BY 1),
 c AS (SELECT 'large' AS x, 'small' AS y UNION ALL SELECT 'small', 'large'),
 p AS (SELECT c.x || ' worst vs ' || c.y || ' best' AS "case", vx.value AS vx, vy.value AS vy FROM c JOIN e ex ON ex.method = c.x JOIN e ey ON ey.method = c.y JOIN v vx ON vx.method = c.x AND vx.variant = ex.worst JOIN v vy ON vy.method = c.y AND vy.variant = ey.best AND vy.step = vx.step)
SELECT "case", round(avg(vx), 6) AS mean_x, round(avg(vy), 6) AS mean_y, round(avg(vx - vy), 6) AS mean_delta, count(*) FILTER (vx > vy) AS wins, count(*) AS n FROM p GROUP BY 1""")
def stress_contrasts(spark, sf_dir):
    return rounded(C.worst_against_best(variants(spark, sf_dir), "small", "large"))


@query("signed_ranks", f"""WITH {MEANS}, d AS (SELECT a.value - b.value AS d FROM m a JOIN m b ON a.step = b.step WHERE a.arm = 'PROMO' AND b.arm = 'ECONOMY' AND a.value <> b.value),
 k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY abs(d)) AS t FROM d),
 s AS (SELECT count(*) AS n, coalesce(sum(rk) FILTER (d > 0), 0) AS up, sum(t * t - 1.0) AS tied FROM k), w AS (SELECT n, least(up, n * (n + 1) / 2.0 - up) AS statistic, tied FROM s)
SELECT n, round(statistic, 6)::DOUBLE AS statistic, round((statistic - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - tied / 48), 6) AS z FROM w""")
def signed_ranks(spark, sf_dir):
    m = means(spark, sf_dir)
    b = m.where("arm = 'ECONOMY'").select(F.col("step").alias("s__"), F.col("value").alias("b__"))
    return rounded(C.signed_ranks(m.where("arm = 'PROMO'").join(b, F.col("step") == F.col("s__")).select((F.col("value") - F.col("b__")).alias("d"))))


@query("budget_sweep", f"""WITH {VARIANTS}, q AS (SELECT method AS variant, variant AS arm, round(avg(value), 9) AS value FROM v GROUP BY 1, 2), p AS (SELECT a.variant, a.arm, b.arm AS other, sign(a.value - b.value) AS s FROM q a JOIN q b ON a.variant = b.variant AND a.arm < b.arm),
 t AS (SELECT p.variant, avg(p.s * z.s) AS tau FROM p JOIN p z ON z.variant = 'small' AND z.arm = p.arm AND z.other = p.other GROUP BY 1), w AS (SELECT variant, first(arm ORDER BY value DESC, arm) AS winner FROM q GROUP BY 1)
SELECT t.variant, round(tau, 6) AS tau, winner, winner = (SELECT winner FROM w WHERE variant = 'small') AS same_winner FROM t JOIN w ON w.variant = t.variant""")
def budget_sweep(spark, sf_dir):
    q = variants(spark, sf_dir).groupBy(F.col("method").alias("variant"), F.col("variant").alias("arm")).agg(F.round(F.avg("value"), 9).alias("value"))
    return rounded(C.budget_sweep(q, "small"))


@query("floor_check", f"WITH {CONFIGS} SELECT config, round(min(metric), 6) AS min, coalesce(min(metric) >= 1.2, false) AS passes_floor FROM r GROUP BY 1")
def floor_check(spark, sf_dir):
    return rounded(C.floor_check(configs(spark, sf_dir).groupBy("config").agg(F.min("metric").alias("min")), 1.2))


@query("named_settings", f"""WITH {CONFIGS}, s AS (SELECT n_name AS config, n_nationkey AS level FROM nation UNION ALL SELECT 'PROMO', 1 UNION ALL SELECT 'SMALL', NULL)
SELECT r.config, level, count(*) AS n FROM r LEFT JOIN s ON r.config = s.config WHERE level IS NULL OR level = 1 GROUP BY 1, 2""")
def named_settings(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("config"), F.col("n_nationkey").alias("level"))
    named = nations.unionByName(spark.range(1).select(F.inline(F.expr("array(struct('PROMO' AS config, 1 AS level), struct('SMALL' AS config, CAST(NULL AS INT) AS level))"))))
    return C.at_levels(C.with_settings(configs(spark, sf_dir), named, "config"), {"level": 1}).groupBy("config", "level").agg(F.count("*").alias("n"))


@query("side_by_side", f"""WITH {ALERTS}, i AS (SELECT signature, host, count(*) AS n FROM alerts GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY n DESC, host) AS rank FROM i)
SELECT rank::INT AS rank, any_value(host) FILTER (signature = 'click') AS click, any_value(host) FILTER (signature = 'error') AS error FROM k WHERE signature IN ('click', 'error') AND rank <= 10 GROUP BY 1""")
def side_by_side(spark, sf_dir):
    i = alerts(spark, sf_dir).where("signature in ('click', 'error')").groupBy(F.col("signature").alias("model"), F.col("host").alias("feature")).agg(F.count("*").alias("importance"))
    return C.side_by_side(i, 10)


@query("feature_reuse", SETS + ", u AS (SELECT DISTINCT pattern, split_part(unnest(its), ':', 1) AS attribute FROM sets) SELECT attribute, count(*) AS n_patterns FROM u GROUP BY 1")
def feature_reuse(spark, sf_dir):
    from alertloom.plans.mining_queries import sets

    return C.feature_reuse(sets(spark, sf_dir).select(F.array_join("items", " AND ").alias("pattern")))


@query("windows_per_feature", f"WITH {ALERTS} SELECT host AS feature, count(DISTINCT (signature, time // 86400)) AS n_windows, count(DISTINCT signature) AS n_scenarios FROM alerts GROUP BY 1")
def windows_per_feature(spark, sf_dir):
    return C.windows_per_feature(alerts(spark, sf_dir).select(F.col("signature").alias("scenario"), F.floor(F.col("time") / 86_400).alias("win_idx"), F.col("host").alias("feature")))


JOB = SETS + """, r AS (SELECT *, CASE WHEN sa > sb THEN 'attack' ELSE 'benign' END AS cls, round(abs(sa - sb), 12) AS score FROM scored WHERE support_count >= 10 AND abs(sa - sb) >= 0.01),
 q AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY score DESC, length(pattern), pattern) AS rk FROM r), t AS (SELECT *, (rk > 10)::INT AS spill FROM q WHERE rk <= 20), chosen AS (SELECT * FROM t ORDER BY spill, score DESC, length(pattern), pattern LIMIT 20)"""


@query("mining_job", JOB + " SELECT pattern, cls, a AS count_attack, b AS count_benign, round(sa - sb, 6) AS support_diff FROM chosen")
def mining_job(spark, sf_dir):
    return rounded(J.mine_itemsets(baskets(spark, sf_dir), J.MiningSettings()).select("pattern", "cls", "count_attack", "count_benign", "support_diff"))


@query("mined_schema", JOB + """, p AS (SELECT avg((group_label = 'attack')::INT) AS base FROM baskets) SELECT 'sym__' || regexp_replace(replace(replace(lower(pattern), ' & ', '__'), ':', '_'), '[^0-9a-z_]+', '_', 'g') AS name, cls AS source_label FROM chosen, p WHERE CASE WHEN cls = 'attack' THEN a / (a + b) >= base ELSE a / (a + b) <= base END""")
def mined_schema(spark, sf_dir):
    rules = J.mine_schema(baskets(spark, sf_dir)).rules
    return spark.createDataFrame([(r.name, r.source_label) for r in rules], "name string, source_label string")


@query("combined_results", SETS + ", " + SEQ.split("WITH ", 1)[1] + """, sq AS (SELECT x.item || ' > ' || y.item AS pattern, count(DISTINCT x.gid) AS support_count FROM st x JOIN st y ON x.gid = y.gid AND x.pos < y.pos GROUP BY 1 HAVING count(DISTINCT x.gid) >= 40)
SELECT 'itemset' AS kind, pattern, k::BIGINT AS k, support_count, round(sa - sb, 6) AS support_diff FROM scored UNION ALL SELECT 'sequence', pattern, 2, support_count, NULL FROM sq""")
def combined_results(spark, sf_dir):
    sets_ = joined(scored_sets(spark, sf_dir)).select("pattern", "k", "support_count", "support_diff")
    found = P.item_sequences(steps(spark, sf_dir), 40, 2).where("k = 2").select(F.array_join("steps", " > ").alias("pattern"), "k", "support_count")
    return rounded(J.combined(sets_, found).select("kind", "pattern", "k", "support_count", "support_diff"))


@query("best_per_condition", SETS + ", c AS (SELECT pattern, its[1] AS condition, support_count FROM sets) SELECT pattern, condition, support_count FROM (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY support_count DESC, pattern) AS r FROM c) WHERE r = 1")
def best_per_condition(spark, sf_dir):
    from alertloom.plans.mining_queries import sets

    rows = sets(spark, sf_dir).select(F.array_join("items", " & ").alias("pattern"), F.element_at("items", 1).alias("condition"), "support_count")
    return J.best_per_condition(rows, "condition", "support_count")


@query("benign_patterns", SETS + " SELECT pattern, round(sa - sb, 6) AS support_diff FROM scored WHERE sa - sb <= 0")
def benign_patterns(spark, sf_dir):
    return rounded(J.without_attack_leaning(joined(scored_sets(spark, sf_dir))).select("pattern", "support_diff"))


@query("cluster_records", f"""WITH {ALERTS}, c AS (SELECT *, CASE WHEN row_id % 11 = 0 THEN NULL WHEN row_id % 13 = 0 THEN -1 ELSE row_id % 50 END AS cluster FROM alerts),
 f AS (SELECT cluster, arg_min(row_id, (time, row_id)) AS anchor FROM c WHERE cluster >= 0 GROUP BY 1)
SELECT row_id, time, coalesce(anchor, row_id) AS group_row_id, cluster IS NULL OR cluster < 0 AS is_outlier, CASE WHEN cluster IS NULL THEN 'low_confidence' WHEN cluster < 0 THEN 'noise' END AS reason FROM c LEFT JOIN f USING (cluster)""")
def cluster_records(spark, sf_dir):
    a = alerts(spark, sf_dir).select("row_id", "time")
    cluster = F.when(F.col("row_id") % 11 != 0, F.when(F.col("row_id") % 13 == 0, F.lit(-1).cast("bigint")).otherwise(F.col("row_id") % 50))
    return J.cluster_records(a, a.select("row_id", cluster.alias("cluster")))


def _split_sql(node: str, rows: str) -> str:
    """CTEs that find the best split of the rows of a node: best_<node> (feature, threshold)."""
    return f""", long_{node} AS (SELECT y, wt, unnest(['hour', 'value']) AS feature, unnest([hour, value]) AS v FROM {rows}),
 points_{node} AS (SELECT feature, v, sum(CASE WHEN y = 1 THEN wt ELSE 0 END) AS p, sum(CASE WHEN y = 0 THEN wt ELSE 0 END) AS n, count(*) AS c FROM long_{node} GROUP BY 1, 2),
 sums_{node} AS (SELECT feature, v, lead(v) OVER w AS nx, sum(p) OVER w AS lp, sum(n) OVER w AS ln, sum(c) OVER w AS lc, sum(p) OVER f AS tp, sum(n) OVER f AS tn, sum(c) OVER f AS tc FROM points_{node} WINDOW w AS (PARTITION BY feature ORDER BY v), f AS (PARTITION BY feature)),
 cuts_{node} AS (SELECT feature, (v + nx) / 2 AS threshold, round((tp + tn - (tp * tp + tn * tn) / (tp + tn)) - (lp + ln - (lp * lp + ln * ln) / (lp + ln)) - (tp - lp + tn - ln - ((tp - lp) ** 2 + (tn - ln) ** 2) / (tp - lp + tn - ln)), 12) AS dec
  FROM sums_{node} WHERE nx IS NOT NULL AND lc >= 50 AND tc - lc >= 50),
 best_{node} AS (SELECT feature, threshold FROM cuts_{node} WHERE dec > 1e-9 ORDER BY dec DESC, feature, threshold LIMIT 1)"""


def _side_sql(rows: str, node: str, left: bool) -> str:
    return f"SELECT {rows}.* FROM {rows}, best_{node} WHERE (CASE WHEN feature = 'hour' THEN hour ELSE value END <= threshold) = {str(left).lower()}"


_LEAF = "SELECT count(*) FILTER (y = 1) AS n_attack, count(*) FILTER (y = 0) AS n_benign FROM "
TREE = f"""WITH {ALERTS}, z AS (SELECT count(*) FILTER (label = 'attack') AS na, count(*) FILTER (label <> 'attack') AS nb FROM alerts),
 rows_0 AS (SELECT (label = 'attack')::INT AS y, CASE WHEN label = 'attack' THEN 0.5 / na ELSE 0.5 / nb END AS wt, ((time // 3600) % 24)::DOUBLE AS hour, round(value, 2) AS value FROM alerts, z)""" + _split_sql("0", "rows_0") + "".join(
    f", rows_{side} AS ({_side_sql('rows_0', '0', side == 'l')}){_split_sql(side, f'rows_{side}')}" for side in "lr"
) + ", leaves AS (" + " UNION ALL ".join(
    [f"{_LEAF} ({_side_sql(f'rows_{side}', side, left)}) HAVING count(*) > 0" for side in "lr" for left in (True, False)] + [f"{_LEAF} rows_{side} WHERE NOT EXISTS (SELECT 1 FROM best_{side})  HAVING count(*) > 0" for side in "lr"]
) + ") SELECT n_attack, n_benign, CASE WHEN n_attack >= n_benign THEN 'attack' ELSE 'benign' END AS prediction FROM leaves"


@query("tree_leaves", TREE)
def tree_leaves(spark, sf_dir):
    a = alerts(spark, sf_dir).select((F.col("label") == "attack").cast("int").alias("y"), ((F.floor(F.col("time") / 3600)) % 24).cast("double").alias("hour"), F.round("value", 2).alias("value"))
    leaves = T.fit_tree(a, ["hour", "value"], 2, 50)
    return spark.createDataFrame([(x.n_attack, x.n_benign, x.prediction) for x in leaves], "n_attack bigint, n_benign bigint, prediction string")
