"""Queries of attribute features, comparisons, streaming twins and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.functions import attributes as A
from alertloom.operators import evaluation as V
from alertloom.operators import groups as B
from alertloom.operators import metrics as M
from alertloom.operators import mining as P
from alertloom.operators import rules as R
from alertloom.operators import sampling as S
from alertloom.operators import trees as T
from alertloom.operators import windows as W
from alertloom.plans.grouping_queries import GROUPED, SESSIONS, grouped, sessions
from alertloom.plans.mining_queries import FIRES, RULES, TOPS, WINDOWED, tops, windowed
from alertloom.plans.registry import ALERTS, BASKETS, query, rounded
from alertloom.plans.window_queries import CONFIGS, SCORED, configs, scored
from alertloom.sources.events import alerts, baskets, table
from alertloom.sources.store import GroupQuery, scratch_path
from alertloom.streaming import monitor as D


@query("attribute_sets", f"""WITH {SESSIONS} SELECT group_id, string_agg(DISTINCT short, '+' ORDER BY short) AS short, string_agg(DISTINCT upper(substr(signature, 1, 1)), '+' ORDER BY upper(substr(signature, 1, 1))) AS short_top,
 string_agg(DISTINCT signature, '+' ORDER BY signature) AS sig, any_value(host) AS host FROM sessions GROUP BY 1""")
def attribute_sets(spark, sf_dir):
    g = A.candidate_features(B.build_groups(B.with_tokens(sessions(spark, sf_dir))))
    return g.select("group_id", *[F.array_join(F.array_sort(c), "+").alias(c) for c in ("short", "short_top", "sig", "host")])


@query("sentinel_impute", """WITH p AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN -1.0 ELSE p_size::DOUBLE END AS v FROM part), m AS (SELECT coalesce(quantile_cont(v, 0.5) FILTER (v <> -1), 0) AS m FROM p WHERE p_partkey % 10 < 7)
SELECT p_partkey, CASE WHEN v = -1 THEN m ELSE v END AS v FROM p, m""")
def sentinel_impute(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 7 == 0, -1.0).otherwise(F.col("p_size").cast("double")).alias("v"))
    return A.impute(rows, rows.where("p_partkey % 10 < 7"), ["v"])


@query("similarity_map", """SELECT p_partkey, (CASE WHEN p_size % 7 <> 0 THEN 1 ELSE 0 END + 1)::BIGINT AS n_known, CASE WHEN p_size % 7 <> 0 THEN p_size::DOUBLE ELSE -1 END AS size_similarity FROM part""")
def similarity_map(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("size"), F.col("p_retailprice").alias("price"))
    m = rows.select("p_partkey", A.similarities(["size", "price"]).alias("m"))
    return m.select("p_partkey", F.size("m").cast("bigint").alias("n_known"), F.coalesce(F.try_element_at("m", F.lit("size")), F.lit(A.NOT_APPLICABLE)).alias("size_similarity"))


@query("cve_and_protocol", """SELECT doc_id, 'CVE-' || (2000 + doc_id % 20) || '-' || doc_id AS ref, (2024 - 2000 - doc_id % 20)::BIGINT AS age, (doc_id % 3 = 0 AND doc_id % 2 = 0) AS mismatch FROM documents""")
def cve_and_protocol(spark, sf_dir):
    from alertloom.functions.tokens import cve_refs

    text = F.concat(F.lit("seen cve-"), (2000 + F.col("doc_id") % 20).cast("string"), F.lit("-"), F.col("doc_id").cast("string"), F.lit(" today"))
    rows = table(spark, sf_dir, "documents").select("doc_id", cve_refs(text).alias("refs"), F.lit(1_704_067_200).cast("bigint").alias("start"))
    category, proto = F.when(F.col("doc_id") % 3 == 0, "DNS").otherwise("OTHER"), F.when(F.col("doc_id") % 2 == 0, 6).otherwise(17)
    return rows.select("doc_id", F.element_at("refs", 1).alias("ref"), A.cve_age(F.col("start"), F.col("refs")).cast("bigint").alias("age"), A.proto_mismatch(category, proto).alias("mismatch"))


@query("quantile_items", """WITH e AS (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q FROM orders)
SELECT CASE WHEN o_totalprice <= q[1] THEN 1 WHEN o_totalprice <= q[2] THEN 2 WHEN o_totalprice <= q[3] THEN 3 ELSE 4 END::BIGINT AS bin, count(*) AS n FROM orders, e GROUP BY 1""")
def quantile_items(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("gid"), F.lit("attack").alias("group_label"), F.col("o_totalprice").alias("price"))
    binned = A.bin_items(o, S.quantile_edges(o, "price", 4), "price")
    per = binned.groupBy("item").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    low = F.regexp_extract("item", r"\((-?[0-9.E]+|-inf),", 1)
    order = Window.orderBy(F.when(low == "-inf", float("-inf")).otherwise(low.try_cast("double")))
    return per.select(F.row_number().over(order).cast("bigint").alias("bin"), "n")


@query("store_query", f"WITH {GROUPED} SELECT group_id, start_ts, end_ts FROM grouped WHERE group_label IN ('attack', 'mixed') AND start_ts >= 1705000000")
def store_query(spark, sf_dir):
    g = grouped(spark, sf_dir).withColumn("status", F.lit("closed")).withColumn("method", F.lit("time_delta_host"))
    return g.where(GroupQuery(labels=("attack", "mixed"), start_after=1_705_000_000, methods=("time_delta_host",)).condition()).select("group_id", "start_ts", "end_ts")


@query("label_mask", f"WITH {GROUPED} SELECT group_id, CASE group_label WHEN 'benign' THEN 0 WHEN 'attack' THEN 1 END AS y FROM grouped")
def label_mask(spark, sf_dir):
    return grouped(spark, sf_dir).select("group_id", B.label_number(F.col("group_label")).alias("y"))


@query("relabel_mixed", f"WITH {GROUPED} SELECT CASE WHEN group_label = 'mixed' THEN 'attack' ELSE group_label END AS group_label, count(*) AS n FROM grouped GROUP BY 1")
def relabel_mixed(spark, sf_dir):
    return B.mixed_as_attack(grouped(spark, sf_dir)).groupBy("group_label").agg(F.count("*").alias("n"))


@query("compare_arms", f"""WITH {CONFIGS} SELECT a.config, round(avg(a.metric - b.metric), 6) AS mean_delta, count(*) FILTER (a.metric > b.metric) AS wins, count(*) FILTER (a.metric < b.metric) AS losses, count(*) FILTER (a.metric = b.metric) AS ties
 FROM r a JOIN r b ON a.block = b.block WHERE a.config <> 'STANDARD' AND b.config = 'STANDARD' GROUP BY 1""")
def compare_arms(spark, sf_dir):
    return rounded(V.compare_arms(configs(spark, sf_dir), "block", "config", "metric", "STANDARD"))


@query("paired_bootstrap")
def paired_bootstrap(spark, sf_dir):
    r = configs(spark, sf_dir)
    pairs = r.where("config = 'PROMO'").select("block", F.col("metric").alias("a")).join(r.where("config = 'SMALL'").select(F.col("block").alias("b__"), F.col("metric").alias("b")), F.col("block") == F.col("b__"))
    return rounded(V.paired_bootstrap(pairs.select("block", "a", "b")))


@query("feasible_region", f"""WITH {CONFIGS}, s AS (SELECT config, avg(metric) AS mean, stddev_samp(metric) AS std FROM r GROUP BY 1) SELECT config, coalesce(mean > 1.3, false) AS ok_mean, coalesce(std < 0.07, false) AS ok_std, (coalesce(mean > 1.3, false)::INT + coalesce(std < 0.07, false)::INT) AS n_passed, coalesce(mean > 1.3, false) AND coalesce(std < 0.07, false) AS feasible FROM s""")
def feasible_region(spark, sf_dir):
    s = configs(spark, sf_dir).groupBy("config").agg(F.avg("metric").alias("mean"), F.stddev_samp("metric").alias("std"))
    return V.feasible(s, {"mean": F.col("mean") > 1.3, "std": F.col("std") < 0.07}).drop("mean", "std")


@query("select_by_metric", f"""WITH {CONFIGS}, s AS (SELECT config, avg(metric) AS mean, stddev_samp(metric) AS std, length(config) AS n_features FROM r GROUP BY 1), b AS (SELECT arg_max(mean, mean) AS m, arg_max(std, mean) AS sd, quantile_cont(std, 0.5) AS med FROM s)
SELECT config FROM s, b WHERE mean >= m - greatest(sd, med) ORDER BY n_features, mean DESC LIMIT 1""")
def select_by_metric(spark, sf_dir):
    s = configs(spark, sf_dir).groupBy("config").agg(F.avg("metric").alias("mean"), F.stddev_samp("metric").alias("std")).withColumn("n_features", F.length("config"))
    return V.select_by_metric(s).select("config")


@query("temporal_decay", WINDOWED + ", d AS (SELECT win_idx, host, avg(value) AS v FROM w GROUP BY 1, 2) SELECT host, round(arg_min(v, win_idx), 6) AS first, round(arg_max(v, win_idx), 6) AS last, count(*) AS n_horizons, round(arg_min(v, win_idx) - arg_max(v, win_idx), 6) AS \"drop\" FROM d GROUP BY 1")
def temporal_decay(spark, sf_dir):
    d = windowed(spark, sf_dir).groupBy("win_idx", "host").agg(F.avg("value").alias("v"))
    return rounded(V.decay(d, "host", "win_idx", "v"))


@query("spearman", f"""WITH {CONFIGS}, s AS (SELECT config, avg(metric) AS x, min(metric) AS y FROM r GROUP BY 1), k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM s) SELECT round(corr(rx, ry), 6) AS spearman FROM k""")
def spearman(spark, sf_dir):
    s = configs(spark, sf_dir).groupBy("config").agg(F.avg("metric").alias("x"), F.min("metric").alias("y"))
    return rounded(V.spearman(s, "x", "y"))


@query("kendall_tau", f"WITH {CONFIGS}, s AS (SELECT config, avg(metric) AS x, min(metric) AS y FROM r GROUP BY 1) SELECT round(avg(sign(a.x - b.x) * sign(a.y - b.y)), 6) AS tau FROM s a JOIN s b ON a.config < b.config")
def kendall_tau(spark, sf_dir):
    s = configs(spark, sf_dir).groupBy("config").agg(F.avg("metric").alias("x"), F.min("metric").alias("y"))
    return rounded(V.kendall(s, "config", "x", "y"))


@query("model_overlap", f"""WITH {ALERTS}, i AS (SELECT signature AS model, host AS feature, count(*) AS importance FROM alerts GROUP BY 1, 2), t AS (SELECT model, feature FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature) AS k FROM i) WHERE k <= 15)
SELECT a.model, b.model AS other, count(*) AS shared, round(count(*) / (30 - count(*)), 6) AS jaccard FROM t a JOIN t b ON a.feature = b.feature AND a.model < b.model GROUP BY 1, 2""")
def model_overlap(spark, sf_dir):
    i = alerts(spark, sf_dir).groupBy(F.col("signature").alias("model"), F.col("host").alias("feature")).agg(F.count("*").alias("importance"))
    return rounded(V.model_overlap(i, 15))


@query("cross_granularity", TOPS + """, f AS (SELECT win_idx AS start, win_idx + 1 AS e, feature FROM top), co AS (SELECT DISTINCT win_idx // 5 * 5 AS start, win_idx // 5 * 5 + 5 AS e, feature FROM top)
SELECT c.start, c.e AS "end", c.feature, 5::BIGINT AS n_fine, count(f.feature) AS n_present, count(f.feature) > 0 AS in_any, count(f.feature) = 5 AS in_all FROM co c LEFT JOIN f ON f.start >= c.start AND f.e <= c.e AND f.feature = c.feature GROUP BY 1, 2, 3""")
def cross_granularity(spark, sf_dir):
    t = tops(spark, sf_dir)
    fine = t.select(F.col("win_idx").alias("start"), (F.col("win_idx") + 1).alias("end"), "feature")
    start = F.floor(F.col("win_idx") / 5) * 5
    return V.cross_granularity(t.select(start.alias("start"), (start + 5).alias("end"), "feature").distinct(), fine)


@query("restatement_flags", FIRES + """, s AS (SELECT DISTINCT feature, gid FROM fired), n AS (SELECT feature, count(*) AS n FROM s GROUP BY 1), m AS (SELECT feature, item, count(*) AS c FROM s JOIN items USING (gid) GROUP BY 1, 2)
SELECT n.feature, coalesce(bool_or(c = n), false) AS restates FROM n LEFT JOIN m USING (feature) GROUP BY 1""")
def restatement_flags(spark, sf_dir):
    b = baskets(spark, sf_dir)
    return V.restatements(R.firing(b, RULES, ["gid"]), P.long_items(b).select("gid", F.col("item").alias("signature")))


@query("metrics_by_window", WINDOWED + """, s AS (SELECT win_idx, (label = 'attack')::INT AS y, value >= 60 AS hit FROM w) SELECT win_idx, count(*) FILTER (hit AND y = 1) AS tp, count(*) FILTER (hit AND y = 0) AS fp, round(count(*) FILTER (hit AND y = 1) / count(*) FILTER (hit), 6) AS precision, round(count(*) FILTER (hit AND y = 1) / sum(y), 6) AS recall FROM s GROUP BY 1""")
def metrics_by_window(spark, sf_dir):
    hit, y = F.col("value") >= 60, F.col("label") == "attack"
    tp = F.count_if(hit & y)
    return rounded(windowed(spark, sf_dir).groupBy("win_idx").agg(tp.alias("tp"), F.count_if(hit & ~y).alias("fp"), F.try_divide(tp, F.count_if(hit)).alias("precision"), F.try_divide(tp, F.count_if(y)).alias("recall")))


@query("f1_sweep", SCORED + """, t AS (SELECT unnest([20.0, 40.0, 60.0, 80.0]) AS cut) SELECT CAST(cut AS DOUBLE) AS cut, round(2 * count(*) FILTER (score >= cut AND y = 1) / (count(*) FILTER (score >= cut) + sum(y)), 6) AS f1 FROM scored, t GROUP BY 1""")
def f1_sweep(spark, sf_dir):
    rows = scored(spark, sf_dir).select("y", "score", F.explode(F.array(*[F.lit(x) for x in (20.0, 40.0, 60.0, 80.0)])).alias("cut"))
    hit = F.col("score") >= F.col("cut")
    return rounded(rows.groupBy("cut").agg(F.coalesce(F.try_divide(2.0 * F.count_if(hit & (F.col("y") == 1)), F.count_if(hit) + F.sum("y")), F.lit(0.0)).alias("f1")))


@query("unpivot_results", f"""WITH {CONFIGS}, s AS (SELECT config, avg(metric) AS mean, min(metric) AS low FROM r GROUP BY 1) SELECT config, 'mean' AS name, round(mean, 6) AS value FROM s UNION ALL SELECT config, 'low', round(low, 6) FROM s""")
def unpivot_results(spark, sf_dir):
    s = configs(spark, sf_dir).groupBy("config").agg(F.avg("metric").alias("mean"), F.min("metric").alias("low"))
    return rounded(s.unpivot("config", ["mean", "low"], "name", "value"))


@query("settings_spread", f"WITH {CONFIGS} SELECT block, round(max(metric), 6) AS best, round(min(metric), 6) AS worst, round(max(metric) - min(metric), 6) AS spread, arg_max(config, metric) AS best_config FROM r GROUP BY 1")
def settings_spread(spark, sf_dir):
    m = "metric"
    return rounded(configs(spark, sf_dir).groupBy("block").agg(F.max(m).alias("best"), F.min(m).alias("worst"), (F.max(m) - F.min(m)).alias("spread"), F.max_by("config", m).alias("best_config")))


@query("simulate_triggers", WINDOWED + """, sv AS (SELECT signature AS scenario, win_idx, round(avg(value), 3) AS v FROM w GROUP BY 1, 2), t AS (SELECT unnest([48.0, 50.0, 52.0]) AS threshold)
SELECT scenario, CAST(threshold AS DOUBLE) AS threshold, min(win_idx) FILTER (v > threshold) AS first_horizon FROM sv, t GROUP BY 1, 2""")
def simulate_triggers(spark, sf_dir):
    r = windowed(spark, sf_dir).groupBy(F.col("signature").alias("scenario"), "win_idx").agg(F.round(F.avg("value"), 3).alias("v"))
    swept = r.select("*", F.explode(F.array(*[F.lit(x) for x in (48.0, 50.0, 52.0)])).alias("threshold"))
    return swept.groupBy("scenario", "threshold").agg(F.min(F.when(F.col("v") > F.col("threshold"), F.col("win_idx"))).alias("first_horizon"))


@query("walk_forward_auc")
def walk_forward_auc(spark, sf_dir):
    """A logistic model on the first windows, scored on the rest."""
    b = W.with_windows(B.numbered_rows(baskets(spark, sf_dir).withColumnRenamed("gid", "start_ts"), "start_ts", "n_lines", width=100_000), 0.5)
    x = R.encode(b, RULES, ["win_idx", "group_label", "n_lines"]).withColumn("y", (F.col("group_label") == "attack").cast("int"))
    names = [r.name for r in RULES.rules]
    return rounded(M.roc_auc(V.fit_and_score(x.where("win_idx = 0"), x.where("win_idx = 1"), names).select("y", "score")), 3)


@query("embedding_clusters")
def embedding_clusters(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("key"), F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector"))
    return V.dbscan(e, 0.9, 4).groupBy("key", "cluster").agg(F.count("*").alias("n"))


def _stream(spark, sf_dir, plan, name):
    """Run a streaming plan over the events to its end; each batch's whole result replaces the last one's in the shared folder."""
    # As a pattern, the path may be a file or a folder of files.
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/[e]vents.parquet")
    # Whole seconds, as in sources.events: fractions would join rows whose times are a gap apart.
    ts = F.timestamp_seconds(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))
    rows = source.select(ts.alias("ts"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("host"), F.when(F.col("event_type") == "error", "attack").otherwise("false_positive").alias("label"))
    target = scratch_path(spark, name)
    q = plan(rows).writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(target)).option("checkpointLocation", scratch_path(spark, f"{name}-state")).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(target)


@query("stream_fixed_windows", f"WITH {ALERTS} SELECT host, (time // 21600) * 21600 AS start_ts, count(*) AS n_alerts, max((label = 'attack')::INT) AS any_attack FROM alerts GROUP BY 1, 2")
def stream_fixed_windows(spark, sf_dir):
    got = _stream(spark, sf_dir, lambda r: D.stream_fixed_windows(r, 21_600), "stream_fixed_windows")
    return got.select("host", F.unix_timestamp("window.start").alias("start_ts"), "n_alerts", "any_attack")


@query("stream_sessions", f"""WITH {ALERTS}, marked AS (SELECT *, CASE WHEN time - lag(time) OVER w < 43200 THEN 0 ELSE 1 END AS fresh FROM alerts WINDOW w AS (PARTITION BY host ORDER BY time, row_id)),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY host ORDER BY time, row_id) AS k FROM marked) SELECT host, min(time) AS start_ts, count(*) AS n_alerts, max((label = 'attack')::INT) AS any_attack FROM s GROUP BY host, k""")
def stream_sessions(spark, sf_dir):
    got = _stream(spark, sf_dir, lambda r: D.stream_sessions(r, 43_200), "stream_sessions")
    return got.select("host", F.unix_timestamp("session_window.start").alias("start_ts"), "n_alerts", "any_attack")


@query("tree_level_split", f"""WITH {ALERTS}, z AS (SELECT count(*) FILTER (label = 'attack') AS na, count(*) FILTER (label <> 'attack') AS nb FROM alerts),
 l AS (SELECT label, unnest(['hour', 'value']) AS feature, unnest([((time // 3600) % 24)::DOUBLE, round(value, 0)]) AS v FROM alerts),
 p AS (SELECT feature, v, count(*) FILTER (label = 'attack') * 0.5 / any_value(na) AS p, count(*) FILTER (label <> 'attack') * 0.5 / any_value(nb) AS n, count(*) AS c FROM l, z GROUP BY 1, 2),
 s AS (SELECT feature, v, lead(v) OVER w AS nx, sum(p) OVER w AS lp, sum(n) OVER w AS ln, sum(c) OVER w AS lc, sum(p) OVER (PARTITION BY feature) AS tp, sum(n) OVER (PARTITION BY feature) AS tn, sum(c) OVER (PARTITION BY feature) AS tc FROM p WINDOW w AS (PARTITION BY feature ORDER BY v)),
 d AS (SELECT feature, (v + nx) / 2 AS threshold, (tp + tn - (tp * tp + tn * tn) / (tp + tn)) - (lp + ln - (lp * lp + ln * ln) / (lp + ln)) - (tp - lp + tn - ln - ((tp - lp) ** 2 + (tn - ln) ** 2) / (tp - lp + tn - ln)) AS dec FROM s WHERE nx IS NOT NULL AND lc >= 20 AND tc - lc >= 20)
SELECT feature, threshold, round(dec, 6) AS decrease FROM d ORDER BY round(dec, 12) DESC, feature, threshold LIMIT 1""")
def tree_level_split(spark, sf_dir):
    a = alerts(spark, sf_dir).select((F.col("label") == "attack").cast("int").alias("y"), ((F.floor(F.col("time") / 3600)) % 24).cast("double").alias("hour"), F.round("value", 0).alias("value"))
    n = a.groupBy("y").agg(F.count("*").alias("n__")).withColumnRenamed("y", "y__")
    weighted = a.join(F.broadcast(n), F.col("y") == F.col("y__")).select("y", "hour", "value", (0.5 / F.col("n__")).alias("weight"), F.lit(0).alias("node"))
    return rounded(T.best_splits(weighted, ["hour", "value"], 20).drop("node"))


COVER_STEP = """, p{i} AS (SELECT item, count(*) FILTER (group_label = 'attack') AS a, count(*) FILTER (group_label = 'benign') AS b FROM items WHERE gid NOT IN (SELECT gid FROM d{j}) GROUP BY 1 HAVING a >= 1 AND a / (a + b) >= 0.5),
 c{i} AS (SELECT item, a, b FROM p{i} ORDER BY a * log2(2 * a / (a + b)) DESC, item LIMIT 1), d{i} AS (SELECT gid FROM d{j} UNION ALL SELECT DISTINCT gid FROM items WHERE item IN (SELECT item FROM c{i}) AND gid NOT IN (SELECT gid FROM d{j}))"""


@query("greedy_cover", f"WITH {BASKETS}, d0 AS (SELECT gid FROM baskets WHERE false)" + "".join(COVER_STEP.format(i=i, j=i - 1) for i in (1, 2, 3)) + " SELECT item, a AS n_attack, b AS n_benign FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3")
def greedy_cover(spark, sf_dir):
    chosen = T.cover_rules(P.long_items(baskets(spark, sf_dir)), baskets(spark, sf_dir), 3, 0.5)
    return spark.createDataFrame(chosen, "item string, n_attack bigint, n_benign bigint")


@query("schema_history", "SELECT version, deployed_at, lead(deployed_at) OVER (ORDER BY deployed_at, version) AS superseded_at FROM (SELECT p_partkey AS version, date '2024-01-01' + CAST(p_partkey AS INT) AS deployed_at FROM part)")
def schema_history(spark, sf_dir):
    h = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("version"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_partkey").cast("int")).alias("deployed_at"))
    return T.versions(h)
