"""Queries of windows, splits, look-back, exploration tables and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.operators import eda as E
from alertloom.operators import groups as B
from alertloom.operators import lookback as L
from alertloom.operators import metrics as M
from alertloom.operators import sampling as S
from alertloom.operators import windows as W
from alertloom.plans.grouping_queries import GROUPED, grouped
from alertloom.plans.registry import ALERTS, query, rounded
from alertloom.sources.events import alerts, table

NUMBERED = f"""{GROUPED}, numbered AS (
  SELECT *, row_number() OVER (ORDER BY start_ts, group_id) AS rn, count(*) OVER () AS n_rows FROM grouped
), windowed AS (
  SELECT *, least((rn - 1) // greatest(1, CAST(floor(0.15 * n_rows) AS BIGINT)), greatest(1, n_rows // greatest(1, CAST(floor(0.15 * n_rows) AS BIGINT))) - 1) AS win_idx FROM numbered
)"""


def numbered(spark, sf_dir):
    return B.numbered_rows(grouped(spark, sf_dir))


def windowed(spark, sf_dir):
    return W.with_windows(numbered(spark, sf_dir), 0.15)


@query("row_windows", f"WITH {NUMBERED}, b AS (SELECT win_idx, min(rn) - 1 AS start, max(rn) AS e, min(start_ts) AS first_ts, max(start_ts) AS last_ts FROM windowed GROUP BY 1) "
       "SELECT win_idx, start, e AS \"end\", first_ts, last_ts, CAST(least(greatest(start + round_even((e - start) * 0.7, 0), start + 1), e - 1) AS BIGINT) AS train_end FROM b")
def row_windows(spark, sf_dir):
    return W.window_bounds(windowed(spark, sf_dir))


@query("holdout_split", f"WITH {NUMBERED} SELECT CASE WHEN rn <= floor(0.7 * n_rows) THEN 'train' ELSE 'test' END AS part, group_label, count(*) AS n, min(rn) AS first_rn FROM numbered GROUP BY 1, 2")
def holdout_split(spark, sf_dir):
    return W.holdout(numbered(spark, sf_dir), 0.3).groupBy("part", "group_label").agg(F.count("*").alias("n"), F.min("rn").alias("first_rn"))


@query("walk_forward_pairs", f"""WITH {NUMBERED}, p AS (SELECT win_idx, count(*) AS n, sum((group_label = 'attack')::INT)::BIGINT AS a FROM windowed GROUP BY 1)
SELECT x.win_idx AS train_idx, y.win_idx AS test_idx, x.n AS n_train, x.a AS attacks_train, y.n AS n_test, y.a AS attacks_test FROM p x JOIN p y ON y.win_idx = x.win_idx + 1""")
def walk_forward_pairs(spark, sf_dir):
    return W.walk_forward(windowed(spark, sf_dir))


@query("valid_time_split", f"""WITH {NUMBERED}, m AS (SELECT rn, n_rows, group_label FROM numbered WHERE group_label IN ('attack', 'benign')),
 s AS (SELECT rn AS split, max(n_rows) OVER () AS n_rows FROM numbered),
 e AS (SELECT min(rn) FILTER (group_label = 'attack') AS a0, max(rn) FILTER (group_label = 'attack') AS a1, min(rn) FILTER (group_label = 'benign') AS b0, max(rn) FILTER (group_label = 'benign') AS b1 FROM m)
SELECT split, CAST(floor(n_rows * 0.7) AS BIGINT) AS target, n_rows FROM s, e WHERE split > 1 AND split < n_rows - 1 AND a0 <= split AND b0 <= split AND a1 > split AND b1 > split
ORDER BY abs(split - floor(n_rows * 0.7)), split LIMIT 1""")
def valid_time_split(spark, sf_dir):
    return W.valid_split(numbered(spark, sf_dir), 0.7)


@query("single_class_split", f"WITH {NUMBERED} SELECT count(DISTINCT group_label) FILTER (rn <= floor(n_rows * 0.7)) < 2 AS head_single, count(DISTINCT group_label) FILTER (rn > floor(n_rows * 0.7)) < 2 AS tail_single FROM numbered")
def single_class_split(spark, sf_dir):
    return W.single_class(numbered(spark, sf_dir), 0.7)


@query("split_stats", f"WITH {NUMBERED} SELECT CASE WHEN rn <= floor(n_rows * 0.7) THEN 'head' ELSE 'tail' END AS part, count(*) AS n, sum((group_label <> 'benign')::INT)::BIGINT AS n_positive, min(start_ts) AS first_ts, max(end_ts) AS last_ts FROM numbered GROUP BY 1")
def split_stats(spark, sf_dir):
    return B.split_stats(grouped(spark, sf_dir))


PHASES = f"""WITH {ALERTS}, attacks AS (SELECT * FROM alerts WHERE label = 'attack'),
 m AS (SELECT *, CASE WHEN time - lag(time) OVER w <= 259200 THEN 0 ELSE 1 END AS fresh FROM attacks WINDOW w AS (PARTITION BY host ORDER BY time, row_id)),
 n AS (SELECT *, sum(fresh) OVER (PARTITION BY host ORDER BY time, row_id)::BIGINT AS island FROM m),
 phases AS (SELECT host, island, min(time) AS start, max(time) AS "end", count(*) AS n FROM n GROUP BY 1, 2)"""


def phases(spark, sf_dir):
    return W.islands(alerts(spark, sf_dir).where(E.is_attack()), ["host"], "time", 259_200)


@query("attack_phases", PHASES + " SELECT * FROM phases")
def attack_phases(spark, sf_dir):
    return phases(spark, sf_dir)


@query("phase_cuts", PHASES + """, c AS (SELECT host, island, (lag("end") OVER (PARTITION BY host ORDER BY start) + start) / 2.0 AS cut FROM phases) SELECT * FROM c WHERE cut IS NOT NULL""")
def phase_cuts(spark, sf_dir):
    return W.phase_cuts(phases(spark, sf_dir), ["host"])


@query("phase_folds", PHASES + """, c AS (SELECT host, (lag("end") OVER (PARTITION BY host ORDER BY start) + start) / 2.0 AS cut FROM phases),
 d AS (SELECT host, cut, lead(cut) OVER (PARTITION BY host ORDER BY cut) AS next_cut FROM c WHERE cut IS NOT NULL)
SELECT a.host, cut, sum((time < cut)::INT)::BIGINT AS n_train, sum((time >= cut AND (next_cut IS NULL OR time < next_cut))::INT)::BIGINT AS n_test FROM alerts a JOIN d ON a.host = d.host GROUP BY 1, 2""")
def phase_folds(spark, sf_dir):
    return W.phase_folds(alerts(spark, sf_dir), phases(spark, sf_dir), ["host"])


@query("streams_by_gap", f"""WITH {ALERTS}, m AS (SELECT *, CASE WHEN time - lag(time) OVER w < 43200 THEN 0 ELSE 1 END AS fresh FROM alerts WINDOW w AS (PARTITION BY host ORDER BY time, row_id)),
 n AS (SELECT *, sum(fresh) OVER (PARTITION BY host ORDER BY time, row_id)::BIGINT AS island FROM m)
SELECT host, island, min(time) AS start, max(time) AS "end", count(*) AS n, round(count(*) / greatest(max(time) - min(time), 1), 6) AS rate FROM n GROUP BY 1, 2""")
def streams_by_gap(spark, sf_dir):
    return rounded(W.streams(alerts(spark, sf_dir), ["host"], 43_200))


@query("inter_arrival", f"WITH {ALERTS}, g AS (SELECT host, time - lag(time) OVER (PARTITION BY host ORDER BY time, row_id) AS gap FROM alerts) SELECT host, count(gap) AS n, min(gap) AS least, max(gap) AS most, round(quantile_cont(gap, 0.95), 6) AS p95 FROM g WHERE gap IS NOT NULL GROUP BY 1")
def inter_arrival(spark, sf_dir):
    g = W.inter_arrival(alerts(spark, sf_dir), ["host"])
    return rounded(g.groupBy("host").agg(F.count("*").alias("n"), F.min("gap").alias("least"), F.max("gap").alias("most"), F.percentile("gap", 0.95).alias("p95")))


@query("loso_folds", f"WITH {ALERTS} SELECT signature AS held_out, (SELECT count(*) FROM alerts) - count(*) AS n_train, count(*) AS n_test FROM alerts GROUP BY 1")
def loso_folds(spark, sf_dir):
    return W.leave_one_out(alerts(spark, sf_dir), "signature")


@query("sliding_windows", f"""WITH {ALERTS}, k AS (SELECT *, unnest(generate_series(CAST(ceil((time - 86400 + 1) / 43200.0) AS BIGINT), time // 43200)) * 43200 AS window_start FROM alerts)
SELECT window_start, count(*) AS n, sum((label = 'attack')::INT)::BIGINT AS n_attack FROM k GROUP BY 1""")
def sliding_windows(spark, sf_dir):
    s = W.sliding(alerts(spark, sf_dir), 86_400, 43_200)
    return s.groupBy("window_start").agg(F.count("*").alias("n"), F.count_if(E.is_attack()).alias("n_attack"))


@query("lookback_steps", f"""WITH {GROUPED}, steps AS (
  SELECT g.group_id AS gid, a.time // 3600 AS step, string_agg(DISTINCT a.short, '+' ORDER BY a.short) AS codes
  FROM grouped g JOIN alerts a ON a.host = g.host AND a.time BETWEEN g.start_ts - 86400 AND g.end_ts GROUP BY 1, 2)
SELECT g.group_id AS gid, coalesce(string_agg(codes, '>' ORDER BY step), '') AS steps FROM grouped g LEFT JOIN steps s ON s.gid = g.group_id GROUP BY 1""")
def lookback_steps(spark, sf_dir):
    g = grouped(spark, sf_dir).withColumnRenamed("group_id", "gid").select("gid", "host", "start_ts", "end_ts")
    s = L.lookback_steps(g, alerts(spark, sf_dir), 86_400, 3_600)
    return s.select("gid", F.array_join(F.transform("context_steps", lambda x: F.array_join(x, "+")), ">").alias("steps"))


@query("novelty_anti_join", f"""WITH {ALERTS}, t AS (SELECT max(time) * 0.8 + min(time) * 0.2 AS cut FROM alerts), seen AS (SELECT DISTINCT host, signature FROM alerts, t WHERE time <= cut)
SELECT count(*) AS n_unseen, count(DISTINCT (host, signature)) AS n_unseen_keys FROM alerts a, t WHERE time > cut AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.host = a.host AND s.signature = a.signature)""")
def novelty_anti_join(spark, sf_dir):
    a = alerts(spark, sf_dir)
    cut = a.agg((F.max("time") * 0.8 + F.min("time") * 0.2).alias("cut")).withColumn("k", F.lit(1))
    both = a.withColumn("k", F.lit(1)).join(F.broadcast(cut), "k")
    return L.novelty(both.where("time > cut"), both.where("time <= cut"), "host", "signature")


@query("signature_overview", f"""WITH {ALERTS} SELECT signature, count(*) AS n, sum((label = 'attack')::INT)::BIGINT AS n_attack, sum((label <> 'attack')::INT)::BIGINT AS n_benign, round(100.0 * avg((label = 'attack')::INT), 6) AS attack_pct,
 CASE WHEN bool_and(label <> 'attack') THEN 'benign' WHEN bool_and(label = 'attack') THEN 'attack' ELSE 'mixed' END AS cls, count(DISTINCT time // 86400) AS active_days, count(DISTINCT time // 3600) AS active_hours, min(time) AS first_ts, max(time) AS last_ts FROM alerts GROUP BY 1""")
def signature_overview(spark, sf_dir):
    return rounded(E.signature_classes(alerts(spark, sf_dir)))


@query("signature_activity_pivot", f"""WITH {ALERTS}, c AS (SELECT signature, CASE WHEN bool_and(label <> 'attack') THEN 'benign' WHEN bool_and(label = 'attack') THEN 'attack' ELSE 'mixed' END AS cls FROM alerts GROUP BY 1),
 d AS (SELECT DISTINCT time // 86400 AS day, a.signature, cls FROM alerts a JOIN c ON a.signature = c.signature)
SELECT strftime(to_timestamp(day * 86400) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS bin, sum((cls = 'benign')::INT)::BIGINT AS benign, sum((cls = 'attack')::INT)::BIGINT AS attack, sum((cls = 'mixed')::INT)::BIGINT AS mixed, count(*) AS total FROM d GROUP BY 1""")
def signature_activity_pivot(spark, sf_dir):
    return E.activity_by_bin(alerts(spark, sf_dir), "day")


@query("label_distribution", f"""WITH {ALERTS}, p AS (SELECT label, count(*) AS n FROM alerts GROUP BY 1)
SELECT label, n, round(100.0 * n / sum(n) OVER (), 6) AS pct, CASE WHEN label = 'attack' THEN 100.0::DOUBLE END AS attack_pct FROM p""")
def label_distribution(spark, sf_dir):
    return rounded(E.label_distribution(alerts(spark, sf_dir)))


@query("attacks_per_period", f"""WITH {ALERTS} SELECT strftime(to_timestamp((time // 86400) * 86400) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS period, count(*) AS n, sum((label = 'attack')::INT)::BIGINT AS n_attack, round(avg((label = 'attack')::INT), 6) AS attack_rate,
 bool_or(label = 'attack') AND bool_or(label <> 'attack') AS both_classes FROM alerts GROUP BY 1""")
def attacks_per_period(spark, sf_dir):
    return rounded(E.attacks_per_period(alerts(spark, sf_dir), "day"))


@query("attacks_per_week_ending_monday", f"""WITH {ALERTS}, d AS (SELECT CAST(to_timestamp(time) AT TIME ZONE 'UTC' AS DATE) AS day, label FROM alerts)
SELECT CAST(day + CAST((8 - isodow(day)) % 7 AS INT) AS VARCHAR) AS week_end, count(*) AS n, sum((label = 'attack')::INT)::BIGINT AS n_attack FROM d GROUP BY 1""")
def attacks_per_week_ending_monday(spark, sf_dir):
    day = F.to_date(F.timestamp_seconds("time"))
    end = F.date_add(day, F.pmod(7 - F.weekday(day), F.lit(7)).cast("int"))
    return alerts(spark, sf_dir).groupBy(end.cast("string").alias("week_end")).agg(F.count("*").alias("n"), F.count_if(E.is_attack()).alias("n_attack"))


@query("dataset_overview", f"WITH {ALERTS} SELECT count(*) AS n, sum((label = 'attack')::INT)::BIGINT AS n_attack, round(100.0 * avg((label = 'attack')::INT), 6) AS attack_pct, count(DISTINCT host) AS hosts, count(DISTINCT signature) AS signatures, max(time) - min(time) AS duration FROM alerts")
def dataset_overview(spark, sf_dir):
    return rounded(E.overview(alerts(spark, sf_dir)))


@query("signature_concentration", f"""WITH {ALERTS}, p AS (SELECT host, count(*) AS n FROM alerts GROUP BY 1), r AS (SELECT n, row_number() OVER w AS r, sum(n) OVER w AS c, sum(n) OVER () AS t FROM p WINDOW w AS (ORDER BY n DESC, host ROWS UNBOUNDED PRECEDING))
SELECT round(sum(n) FILTER (r <= 3) / max(t), 6) AS top_share, min(r) FILTER (c >= 0.9 * t) AS n_for_share, count(*) AS n_values FROM r""")
def signature_concentration(spark, sf_dir):
    return rounded(E.concentration(alerts(spark, sf_dir), "host"))


@query("temporal_concentration", f"""WITH {ALERTS}, e AS (SELECT min(time) AS lo, max(time) AS hi FROM alerts), b AS (SELECT least((time - lo) * 1000 // greatest(hi - lo, 1), 999) AS bin, count(*) AS n FROM alerts, e WHERE label = 'attack' GROUP BY 1),
 r AS (SELECT bin, n, row_number() OVER (ORDER BY n DESC, bin) AS r, sum(n) OVER () AS t, sum(n) OVER (ORDER BY bin) AS c FROM b)
SELECT round(max(abs(c / t - (bin + 1) / 1000.0)), 6) AS max_deviation, round(sum(n) FILTER (r <= 10) / max(t), 6) AS busiest_1pct, round(sum(n) FILTER (r <= 50) / max(t), 6) AS busiest_5pct, round(sum(n) FILTER (r <= 100) / max(t), 6) AS busiest_10pct FROM r""")
def temporal_concentration(spark, sf_dir):
    return rounded(E.temporal_concentration(alerts(spark, sf_dir)))


@query("host_summary", f"""WITH {ALERTS}, g AS (SELECT *, time - lag(time) OVER (PARTITION BY host ORDER BY time, row_id) AS gap FROM alerts), c AS (SELECT host, short, count(*) AS n FROM alerts GROUP BY 1, 2),
 t AS (SELECT host, string_agg(short, ',' ORDER BY n DESC, short) AS top_codes FROM c GROUP BY 1), p AS (SELECT host, count(*) AS n, sum((label = 'attack')::INT)::BIGINT AS n_attack, round(quantile_cont(gap, 0.5), 6) AS median_gap FROM g GROUP BY 1)
SELECT p.host, n, n_attack, median_gap, top_codes FROM p JOIN t ON p.host = t.host""")
def host_summary(spark, sf_dir):
    return rounded(E.host_summary(alerts(spark, sf_dir)))


SCORED = f"""WITH {ALERTS}, scored AS (SELECT row_id, (label = 'attack')::INT AS y, round(value, 1) AS score, signature, host FROM alerts)"""


def scored(spark, sf_dir):
    return alerts(spark, sf_dir).select("row_id", E.is_attack().cast("int").alias("y"), F.round("value", 1).alias("score"), "signature", "host")


@query("roc_auc_exact", SCORED + """, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scored)
SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg FROM r""")
def roc_auc_exact(spark, sf_dir):
    return rounded(M.roc_auc(scored(spark, sf_dir)))


@query("average_precision", SCORED + """, p AS (SELECT score, sum(y) AS p, count(*) AS n FROM scored GROUP BY 1), c AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS seen, sum(p) OVER () AS pos FROM p)
SELECT round(sum(p * tp / seen) / max(pos), 6) AS average_precision FROM c""")
def average_precision(spark, sf_dir):
    return rounded(M.average_precision(scored(spark, sf_dir)))


@query("confusion_at_threshold", SCORED + """, t AS (SELECT count(*) FILTER (score >= 60 AND y = 1) AS tp, count(*) FILTER (score >= 60 AND y = 0) AS fp, count(*) FILTER (score < 60 AND y = 1) AS fn, count(*) FILTER (score < 60 AND y = 0) AS tn FROM scored)
SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(fp / (fp + tn), 6) AS fpr FROM t""")
def confusion_at_threshold(spark, sf_dir):
    return rounded(M.confusion(scored(spark, sf_dir), 60.0))


@query("workload_at_recall", SCORED + """, p AS (SELECT score, sum(y) AS p, count(*) AS n FROM scored GROUP BY 1), c AS (SELECT score, sum(p) OVER w AS tp, sum(n - p) OVER w AS fp, sum(p) OVER () AS pos, sum(n - p) OVER () AS neg FROM p WINDOW w AS (ORDER BY score DESC)),
 x AS (SELECT unnest([0.5, 0.8, 0.9]) AS target), b AS (SELECT target, max(score) AS threshold FROM c, x WHERE tp >= (target - 1e-9) * pos GROUP BY 1)
SELECT CAST(target AS DOUBLE) AS target, threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, (pos - tp)::BIGINT AS fn, (neg - fp)::BIGINT AS tn, round((pos + neg - tp - fp) / (pos + neg), 6) AS workload_reduction FROM b JOIN c ON b.threshold = c.score""")
def workload_at_recall(spark, sf_dir):
    return rounded(M.workload_at_recall(scored(spark, sf_dir), [0.5, 0.8, 0.9]))


@query("anova_eta2", SCORED + """, l AS (SELECT signature, count(*) AS n, avg(score) AS m, var_pop(score) AS v FROM scored GROUP BY 1), g AS (SELECT sum(n * m) / sum(n) AS grand FROM l),
 s AS (SELECT sum(n * (m - grand) ** 2) AS b, sum(n * v) AS w, count(*) AS k, sum(n) AS n, max(m) - min(m) AS r FROM l, g)
SELECT k AS levels, round(b / (b + w), 6) AS eta2, round((b / (k - 1)) / (w / (n - k)), 6) AS f, round(r, 6) AS effect_range,
 CASE WHEN b / (b + w) >= 0.14 THEN 'large' WHEN b / (b + w) >= 0.06 THEN 'medium' WHEN b / (b + w) >= 0.01 THEN 'small' ELSE 'negligible' END AS effect FROM s""")
def anova_eta2(spark, sf_dir):
    return rounded(M.anova(scored(spark, sf_dir), "signature", "score"))


@query("main_effects", SCORED + " SELECT signature, round(avg(score), 6) AS mean, round(coalesce(stddev_samp(score), 0), 6) AS std, count(score) AS n FROM scored GROUP BY 1")
def main_effects(spark, sf_dir):
    return rounded(M.main_effects(scored(spark, sf_dir), "signature", "score"))


PARTS = "p AS (SELECT p_type, p_brand, (p_size > 25)::INT AS y, p_size, p_retailprice FROM part)"


def parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_type", "p_brand", (F.col("p_size") > 25).cast("int").alias("y"), "p_size", "p_retailprice")


CELLS = f"WITH {PARTS}, c AS (SELECT p_type, p_brand, count(*) AS n FROM p GROUP BY 1, 2), m AS (SELECT n, sum(n) OVER (PARTITION BY p_type) AS nx, sum(n) OVER (PARTITION BY p_brand) AS ny, sum(n) OVER () AS t, p_type, p_brand FROM c)"


@query("cramers_v", CELLS + " SELECT round(sqrt(greatest(sum(n * n / (nx * ny)) - 1, 0) / (least(count(DISTINCT p_type), count(DISTINCT p_brand)) - 1)), 6) AS cramers_v FROM m")
def cramers_v(spark, sf_dir):
    return rounded(M.cramers_v(parts(spark, sf_dir), "p_type", "p_brand"))


@query("mutual_information", CELLS + " SELECT round(sum(n / t * ln(n * t / (nx * ny))), 6) AS mutual_information FROM m")
def mutual_information(spark, sf_dir):
    return rounded(M.mutual_information(parts(spark, sf_dir), "p_type", "p_brand"))


@query("point_biserial", f"WITH {PARTS} SELECT round(corr(p_size, y), 6) AS r FROM p")
def point_biserial(spark, sf_dir):
    return rounded(parts(spark, sf_dir).agg(F.corr("p_size", "y").alias("r")))


@query("purity_table", f"""WITH {PARTS}, l AS (SELECT y, 'p_type' AS field, p_type AS value FROM p UNION ALL SELECT y, 'p_brand', p_brand FROM p), g AS (SELECT field, value, count(*) AS n, sum(y)::BIGINT AS attacks FROM l GROUP BY 1, 2)
SELECT field, value, n, attacks, round(attacks / n, 6) AS rate, round(greatest(attacks / n, 1 - attacks / n), 6) AS purity, CASE WHEN attacks / n >= 0.5 THEN 'attack' ELSE 'benign' END AS direction,
 round((attacks / n) / (sum(attacks) OVER w / sum(n) OVER w), 6) AS lift FROM g WINDOW w AS (PARTITION BY field)""")
def purity_table(spark, sf_dir):
    return rounded(E.purity(parts(spark, sf_dir), ["p_type", "p_brand"]))


@query("local_attack_rates", f"WITH {PARTS}, g AS (SELECT p_brand AS value, count(*) AS support, sum(y) AS a FROM p GROUP BY 1) SELECT value, support, round(a / support, 6) AS rate, round(a / support - sum(a) OVER () / sum(support) OVER (), 6) AS deviation FROM g")
def local_attack_rates(spark, sf_dir):
    return rounded(E.local_rates(parts(spark, sf_dir), "p_brand"))


CONFIGS = "r AS (SELECT p_type AS config, p_brand AS block, avg(p_retailprice) / 1000 AS metric FROM part GROUP BY 1, 2)"


def configs(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("config"), F.col("p_brand").alias("block")).agg((F.avg("p_retailprice") / 1000).alias("metric"))


@query("config_summary", f"""WITH {CONFIGS} SELECT config, round(avg(metric), 6) AS mean, round(coalesce(stddev_samp(metric), 0), 6) AS std, round(min(metric), 6) AS min, round(max(metric), 6) AS max, count(metric) AS n,
 round(coalesce(stddev_samp(metric), 0) / avg(metric), 6) AS cv, round(quantile_cont(metric, 0.1), 6) AS p10 FROM r GROUP BY 1""")
def config_summary(spark, sf_dir):
    return rounded(M.summarize(configs(spark, sf_dir), ["config"], "metric"))


@query("config_rank", f"WITH {CONFIGS} SELECT config, round(avg(metric) - coalesce(stddev_samp(metric), 0), 6) AS score FROM r GROUP BY 1")
def config_rank(spark, sf_dir):
    return rounded(M.rank_configs(M.summarize(configs(spark, sf_dir), ["config"], "metric")).select("config", "score"))


@query("avg_ranks", f"""WITH {CONFIGS}, k AS (SELECT config, rank() OVER (PARTITION BY block ORDER BY metric DESC) + (count(*) OVER (PARTITION BY block, metric) - 1) / 2.0 AS r FROM r) SELECT config, round(avg(r), 6) AS average_rank, count(*) AS n_blocks FROM k GROUP BY 1""")
def avg_ranks(spark, sf_dir):
    return rounded(M.average_ranks(configs(spark, sf_dir), "block", "config", "metric"))


@query("baseline_pairs", f"""WITH {CONFIGS} SELECT a.block, round(a.metric - b.metric, 6) AS delta, round((a.metric - b.metric) / nullif(b.metric, 0), 6) AS pct FROM r a JOIN r b ON a.block = b.block WHERE a.config = 'PROMO' AND b.config = 'STANDARD'""")
def baseline_pairs(spark, sf_dir):
    r = configs(spark, sf_dir)
    base = r.where("config = 'STANDARD'").select(F.col("block").alias("b__"), F.col("metric").alias("base"))
    delta = F.col("metric") - F.col("base")
    return rounded(r.where("config = 'PROMO'").join(base, F.col("block") == F.col("b__")).select("block", delta.alias("delta"), F.try_divide(delta, F.col("base")).alias("pct")))


@query("undersample_pool", f"""WITH {ALERTS}, r AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY sha1(row_id || '|7'), row_id) AS k FROM alerts), m AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM alerts GROUP BY label)) SELECT row_id, label FROM r, m WHERE k <= least""")
def undersample_pool(spark, sf_dir):
    return S.undersample(alerts(spark, sf_dir).select("row_id", "label"), "label", "row_id", 7)


@query("guided_pool", f"""WITH {ALERTS}, s AS (SELECT row_id, (label = 'attack')::INT AS y, value < 50 AS inlier FROM alerts), n AS (SELECT sum(y) AS n FROM s),
 r AS (SELECT *, row_number() OVER (PARTITION BY inlier ORDER BY sha1(row_id || '|7'), row_id) AS k FROM s WHERE y = 0)
SELECT row_id, y FROM s WHERE y = 1 UNION ALL SELECT row_id, y FROM r, n WHERE k <= CASE WHEN inlier THEN ceil(n / 2) ELSE floor(n / 2) END""")
def guided_pool(spark, sf_dir):
    rows = alerts(spark, sf_dir).select("row_id", E.is_attack().cast("int").alias("y"), (F.col("value") < 50).alias("inlier"))
    return S.guided(rows, "y", "inlier", "row_id", 7).select("row_id", "y")


@query("sample_rows", f"WITH {ALERTS} SELECT row_id FROM alerts ORDER BY sha1(row_id || '|3'), row_id LIMIT 500")
def sample_rows(spark, sf_dir):
    return S.sample_rows(alerts(spark, sf_dir).select("row_id"), 500, "row_id", 3)


@query("class_weight", f"WITH {ALERTS} SELECT round(count(*) FILTER (label <> 'attack') / count(*) FILTER (label = 'attack'), 6) AS scale_pos_weight FROM alerts")
def class_weight(spark, sf_dir):
    return rounded(S.class_weight(alerts(spark, sf_dir).select(E.is_attack().cast("int").alias("y")), "y"))


@query("quantile_bins", "SELECT DISTINCT round(q, 6) AS edge FROM (SELECT unnest(quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS q FROM lineitem)")
def quantile_bins(spark, sf_dir):
    return rounded(S.quantile_edges(table(spark, sf_dir, "lineitem"), "l_extendedprice", 10))


@query("error_instances", SCORED + """, e AS (SELECT row_id, score, CASE WHEN y = 0 AND score >= 60 THEN 'fp' WHEN y = 1 AND score < 60 THEN 'fn' END AS kind FROM scored), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN kind = 'fp' THEN -score ELSE score END, row_id) AS k FROM e WHERE kind IS NOT NULL) SELECT row_id, score, kind FROM r WHERE k <= 20""")
def error_instances(spark, sf_dir):
    from pyspark.sql import Window

    hit = F.col("score") >= 60
    kind = F.when((F.col("y") == 0) & hit, "fp").when((F.col("y") == 1) & ~hit, "fn")
    e = scored(spark, sf_dir).select("row_id", "score", kind.alias("kind")).where("kind is not null")
    order = Window.partitionBy("kind").orderBy(F.when(F.col("kind") == "fp", -F.col("score")).otherwise(F.col("score")), "row_id")
    return e.withColumn("k", F.row_number().over(order)).where("k <= 20").select("row_id", "score", "kind")
