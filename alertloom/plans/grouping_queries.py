"""Queries of parsing, tokens, grouping and group statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.functions import tokens as T
from alertloom.operators import grouping as G
from alertloom.operators import groups as B
from alertloom.plans.registry import ALERTS, query, rounded
from alertloom.sources.events import alerts, table

WINDOW, GAP, TIMEOUT, LENGTH = 21_600, 43_200, 43_200, 172_800

SESSIONS = f"""{ALERTS}, marked AS (
  SELECT *, CASE WHEN time - lag(time) OVER w <= {GAP} THEN 0 ELSE 1 END AS fresh FROM alerts WINDOW w AS (PARTITION BY host ORDER BY time, row_id)
), sessions AS (
  SELECT *, 'time_delta_host:' || host || ':' || CAST(sum(fresh) OVER (PARTITION BY host ORDER BY time, row_id) AS BIGINT) AS group_id FROM marked
)"""
GROUPED = f"""{SESSIONS}, grouped AS (
  SELECT group_id, min(time) AS start_ts, max(time) AS end_ts, count(*) AS n_alerts, any_value(host) AS host,
    CASE WHEN bool_or(label <> 'false_positive') AND bool_or(label = 'false_positive') THEN 'mixed'
      WHEN bool_or(label <> 'false_positive') THEN 'attack' ELSE 'benign' END AS group_label
  FROM sessions GROUP BY group_id
)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.time_delta_host(alerts(spark, sf_dir), GAP)


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).groupBy("group_id").agg(
        F.min("time").alias("start_ts"), F.max("time").alias("end_ts"), F.count("*").alias("n_alerts"), F.max("host").alias("host"), B.label_aggregate(F.col("label")).alias("group_label")
    )


@query("alerts_parse", f"WITH {ALERTS} SELECT row_id, time, signature, host, short, label FROM alerts")
def alerts_parse(spark, sf_dir):
    return alerts(spark, sf_dir).select("row_id", "time", "signature", "host", "short", "label")


@query("alert_id_sha1", f"WITH {ALERTS} SELECT row_id, sha1('demo|' || time || '|' || signature || '||' || host || '|' || short) AS alert_id FROM alerts")
def alert_id_sha1(spark, sf_dir):
    c = F.col
    return alerts(spark, sf_dir).select("row_id", T.alert_id("demo", c("time"), c("signature"), c("ip"), c("host"), c("short")).alias("alert_id"))


@query("pregrouped_id_sha1", f"WITH {ALERTS} SELECT row_id, sha1(row_id || '|' || host || '|-1|' || time) AS group_key FROM alerts")
def pregrouped_id_sha1(spark, sf_dir):
    return alerts(spark, sf_dir).select("row_id", T.pregrouped_id(F.col("row_id"), F.col("host"), F.col("ip"), F.col("time")).alias("group_key"))


@query("tokens_feature", f"WITH {ALERTS} SELECT row_id, 'host:' || host || ' ' || 'short:' || short || ' ' || 'sig:' || signature AS tokens FROM alerts")
def tokens_feature(spark, sf_dir):
    return B.with_tokens(alerts(spark, sf_dir)).select("row_id", F.array_join("tokens", " ").alias("tokens"))


@query("tokens_short", f"WITH {ALERTS} SELECT DISTINCT short, upper(substr(signature, 1, 1)) || '+' || signature AS parts FROM alerts")
def tokens_short(spark, sf_dir):
    return alerts(spark, sf_dir).select("short", F.array_join(T.short_tokens(F.col("short")), "+").alias("parts")).distinct()


@query("tokens_signature", f"WITH {ALERTS} SELECT row_id, CASE WHEN signature IN ('error', 'click') THEN signature ELSE '' END AS tokens FROM alerts")
def tokens_signature(spark, sf_dir):
    found = T.signature_tokens(F.col("signature"), ["error", "click", "view"], ["view"])
    return alerts(spark, sf_dir).select("row_id", F.array_join(found, " ").alias("tokens"))


@query("text_normalize", "SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS digest FROM documents")
def text_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("digest"))


@query("time_of_day", f"""WITH {ALERTS} SELECT CASE WHEN h BETWEEN 5 AND 9 THEN 'morning' WHEN h BETWEEN 10 AND 13 THEN 'midday' WHEN h BETWEEN 14 AND 17 THEN 'afternoon'
 WHEN h BETWEEN 18 AND 21 THEN 'evening' ELSE 'night' END AS part, count(*) AS n FROM (SELECT (time // 3600) % 24 AS h FROM alerts) GROUP BY 1""")
def time_of_day(spark, sf_dir):
    return alerts(spark, sf_dir).groupBy(T.time_of_day(F.hour(F.timestamp_seconds("time"))).alias("part")).agg(F.count("*").alias("n"))


@query("run_length_encode", f"""WITH {ALERTS}, marked AS (
  SELECT host, signature, time, row_id, CASE WHEN signature = lag(signature) OVER w THEN 0 ELSE 1 END AS fresh FROM alerts WINDOW w AS (PARTITION BY host ORDER BY time, row_id)
), numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY host ORDER BY time, row_id) AS run FROM marked),
runs AS (SELECT host, run, any_value(signature) AS s, count(*) AS n FROM numbered GROUP BY host, run)
SELECT host, string_agg(s || CASE WHEN n = 1 THEN '' WHEN n = 2 THEN '__repeat_2' WHEN n <= 4 THEN '__repeat_3_4' ELSE '__repeat_5_plus' END, ' ' ORDER BY run) AS encoded FROM runs GROUP BY host""")
def run_length_encode(spark, sf_dir):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("time", "row_id", "signature"))), lambda x: x["signature"])
    return alerts(spark, sf_dir).groupBy("host").agg(ordered.alias("s")).select("host", F.array_join(T.run_lengths(F.col("s")), " ").alias("encoded"))


@query("feature_names", f"WITH {ALERTS} SELECT DISTINCT 'sym__host_' || host || '__short_' || lower(replace(short, '-', '_')) AS name FROM alerts")
def feature_names(spark, sf_dir):
    pair = F.array(F.concat(F.lit("host:"), "host"), F.concat(F.lit("short:"), "short"))
    return alerts(spark, sf_dir).select(T.feature_name(pair).alias("name")).distinct()


@query("text_serialize", f"WITH {ALERTS} SELECT row_id, 'Host: ' || host || ' | Code: ' || short AS line FROM alerts")
def text_serialize(spark, sf_dir):
    return alerts(spark, sf_dir).select("row_id", T.text_column({"Host": F.col("host"), "Address": F.col("ip"), "Code": F.col("short")}).alias("line"))


@query("group_fixed_window", f"WITH {ALERTS} SELECT 'fixed_window:' || (time // {WINDOW}) AS group_id, count(*) AS n, min(time) AS start_ts, max(time) AS end_ts FROM alerts GROUP BY 1")
def group_fixed_window(spark, sf_dir):
    g = G.group_alerts(alerts(spark, sf_dir), "fixed_window", seconds=WINDOW)
    return g.groupBy("group_id").agg(F.count("*").alias("n"), F.min("time").alias("start_ts"), F.max("time").alias("end_ts"))


@query("group_fixed_window_host", f"WITH {ALERTS} SELECT 'fixed_window_host:' || host || ':' || (time // {WINDOW}) AS group_id, count(*) AS n FROM alerts GROUP BY 1")
def group_fixed_window_host(spark, sf_dir):
    return G.group_alerts(alerts(spark, sf_dir), "fixed_window_host", seconds=WINDOW).groupBy("group_id").agg(F.count("*").alias("n"))


@query("group_time_delta", f"""WITH {ALERTS}, marked AS (SELECT *, CASE WHEN time - lag(time) OVER (ORDER BY time, row_id) <= 900 THEN 0 ELSE 1 END AS fresh FROM alerts),
 s AS (SELECT *, 'time_delta:' || CAST(sum(fresh) OVER (ORDER BY time, row_id) AS BIGINT) AS group_id FROM marked) SELECT group_id, count(*) AS n, min(time) AS start_ts FROM s GROUP BY 1""")
def group_time_delta(spark, sf_dir):
    return G.group_alerts(alerts(spark, sf_dir), "time_delta", gap=900).groupBy("group_id").agg(F.count("*").alias("n"), F.min("time").alias("start_ts"))


@query("group_time_delta_host", f"WITH {SESSIONS} SELECT group_id, count(*) AS n, min(time) AS start_ts FROM sessions GROUP BY 1")
def group_time_delta_host(spark, sf_dir):
    return sessions(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("n"), F.min("time").alias("start_ts"))


CAPPED = """WITH RECURSIVE {alerts}, numbered AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY time, row_id) AS k FROM alerts),
 fold AS (
  SELECT {key}, k, row_id, time, time AS anchor FROM numbered WHERE k = 1
  UNION ALL
  SELECT {named}, n.k, n.row_id, n.time, CASE WHEN n.time - f.time > {timeout} OR n.time - f.anchor > {length} THEN n.time ELSE f.anchor END
  FROM fold f JOIN numbered n ON {on} AND n.k = f.k + 1
 )"""


@query("group_capped_session", CAPPED.format(alerts=ALERTS, key="host, signature", named="n.host, n.signature", on="n.host = f.host AND n.signature = f.signature", timeout=TIMEOUT * 6, length=LENGTH * 2)
       + " SELECT host, signature, anchor AS start_ts, count(*) AS n, max(time) AS end_ts FROM fold GROUP BY 1, 2, 3")
def group_capped_session(spark, sf_dir):
    g = G.group_alerts(alerts(spark, sf_dir), "capped_session", timeout=TIMEOUT * 6, length=LENGTH * 2)
    return g.groupBy("group_id", "host", "signature").agg(F.min("time").alias("start_ts"), F.count("*").alias("n"), F.max("time").alias("end_ts")).drop("group_id")


@query("group_temporal", f"""WITH RECURSIVE {ALERTS}, ticks AS (SELECT DISTINCT time FROM alerts), marked AS (SELECT time, time - lag(time) OVER (ORDER BY time) AS gap FROM ticks),
 anchors AS (SELECT min(time) AS anchor FROM ticks UNION ALL SELECT (SELECT min(time) FROM marked WHERE time > anchor AND (gap > 900 OR time - anchor > 3600)) FROM anchors WHERE anchor IS NOT NULL),
 spans AS (SELECT anchor, lead(anchor) OVER (ORDER BY anchor) AS following FROM anchors WHERE anchor IS NOT NULL)
SELECT anchor AS start_ts, count(*) AS n FROM alerts ASOF JOIN spans ON time >= anchor GROUP BY 1""")
def group_temporal(spark, sf_dir):
    g = G.group_alerts(alerts(spark, sf_dir), "temporal", timeout=900, length=3600)
    return g.groupBy("group_id").agg(F.min("time").alias("start_ts"), F.count("*").alias("n")).drop("group_id")


@query("group_members", f"WITH {SESSIONS} SELECT group_id, string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY time, row_id) AS row_ids FROM sessions GROUP BY 1")
def group_members(spark, sf_dir):
    return G.members(sessions(spark, sf_dir)).select("group_id", F.array_join(F.transform("row_ids", lambda x: x.cast("string")), ",").alias("row_ids"))


@query("groups_build", f"""WITH {SESSIONS} SELECT group_id, min(time) AS start_ts, max(time) AS end_ts, count(*) AS n_alerts,
 CASE WHEN bool_or(label <> 'false_positive') AND bool_or(label = 'false_positive') THEN 'mixed' WHEN bool_or(label <> 'false_positive') THEN 'attack' ELSE 'benign' END AS group_label,
 'host:' || any_value(host) || ' ' || string_agg(DISTINCT 'short:' || short, ' ' ORDER BY 'short:' || short) || ' ' || string_agg(DISTINCT 'sig:' || signature, ' ' ORDER BY 'sig:' || signature) AS items,
 count(DISTINCT label) AS n_labels FROM sessions GROUP BY 1""")
def groups_build(spark, sf_dir):
    g = B.build_groups(B.with_tokens(sessions(spark, sf_dir)))
    return g.select("group_id", "start_ts", "end_ts", "n_alerts", "group_label", F.array_join("raw_items", " ").alias("items"), F.size("alert_labels").cast("bigint").alias("n_labels"))


@query("group_label", f"WITH {GROUPED} SELECT group_label, count(*) AS n, sum(n_alerts)::BIGINT AS n_alerts FROM grouped GROUP BY 1")
def group_label(spark, sf_dir):
    return grouped(spark, sf_dir).groupBy("group_label").agg(F.count("*").alias("n"), F.sum("n_alerts").alias("n_alerts"))


@query("group_select_last_n", f"WITH {GROUPED} SELECT group_id, start_ts, end_ts FROM grouped ORDER BY end_ts DESC, start_ts DESC, group_id DESC LIMIT 50")
def group_select_last_n(spark, sf_dir):
    return grouped(spark, sf_dir).orderBy(F.desc("end_ts"), F.desc("start_ts"), F.desc("group_id")).limit(50).select("group_id", "start_ts", "end_ts")


@query("grouping_metrics", f"""WITH {SESSIONS}, g AS (
 SELECT group_id, count(*) AS n, sum(CASE WHEN label <> 'false_positive' THEN 1 ELSE 0 END) AS a, count(DISTINCT host) AS hosts, greatest(count(DISTINCT signature), 1) AS sigs, max(time) - min(time) AS span
 FROM sessions GROUP BY 1)
SELECT count(*) AS n_groups, sum(n)::BIGINT AS n_alerts, round(1 - count(*) / sum(n), 6) AS volume_reduction, round(avg(n), 6) AS size_mean, round(quantile_cont(n, 0.5), 6) AS size_median, max(n) AS size_max,
 round(avg((a = 0)::INT), 6) AS pure_benign, round(avg((a = n)::INT), 6) AS pure_attack, round(avg((a > 0 AND a < n)::INT), 6) AS mixed, round(avg((hosts <= 1)::INT), 6) AS host_purity,
 round(avg(sigs), 6) AS signatures_mean, max(sigs) AS signatures_max, round(avg(span), 6) AS span_mean, round(quantile_cont(span, 0.5), 6) AS span_median, max(span) AS span_max,
 round(sum(CASE WHEN a > 0 AND a < n THEN least(a, n - a) END) / sum(CASE WHEN a > 0 AND a < n THEN n END), 6) AS minority_exposure FROM g""")
def grouping_metrics(spark, sf_dir):
    return rounded(B.grouping_metrics(sessions(spark, sf_dir)))


@query("group_properties", f"""WITH {SESSIONS}, k AS (SELECT group_id, CASE WHEN bool_or(label <> 'false_positive') AND bool_or(label = 'false_positive') THEN 'mixed' WHEN bool_or(label <> 'false_positive') THEN 'attack' ELSE 'benign' END AS kind FROM sessions GROUP BY 1),
 c AS (SELECT DISTINCT s.group_id, short, kind FROM sessions s JOIN k ON s.group_id = k.group_id), seen AS (SELECT DISTINCT short FROM c WHERE kind = 'benign'),
 am AS (SELECT group_id, bool_and(short IN (SELECT short FROM seen)) AS x FROM c WHERE kind = 'attack' GROUP BY 1)
SELECT (SELECT count(*) FROM k) AS n_groups, (SELECT round(avg((kind = 'mixed')::INT), 6) FROM k) AS mixed_share, (SELECT round(avg((kind = 'attack')::INT), 6) FROM k) AS attack_share, (SELECT round(avg(x::INT), 6) FROM am) AS ambiguous_attack_share""")
def group_properties(spark, sf_dir):
    return rounded(B.code_properties(sessions(spark, sf_dir)))


@query("review_queue", f"WITH {ALERTS} SELECT row_id, time, host, signature FROM alerts WHERE row_id % 500 = 0")
def review_queue(spark, sf_dir):
    a = alerts(spark, sf_dir).withColumn("alert_id", F.col("row_id").cast("string"))
    flagged = a.where("row_id % 500 = 0").select("alert_id")
    return G.manual_review(a, flagged).select("row_id", "time", "host", "signature")


@query("coverage", f"WITH {ALERTS} SELECT round(avg((value >= 1)::INT), 6) AS coverage, round(1 - avg((value >= 1)::INT), 6) AS ungroupable FROM alerts")
def coverage(spark, sf_dir):
    return rounded(B.coverage(alerts(spark, sf_dir).withColumn("is_outlier", F.col("value") < 1)))


@query("baseline_features", f"""WITH {SESSIONS} SELECT group_id, (min(time) // 3600) % 24 AS hour_of_day, count(*) AS n_alerts, count(DISTINCT host) AS n_host, count(DISTINCT short) AS n_short, count(DISTINCT signature) AS n_sig FROM sessions GROUP BY 1""")
def baseline_features(spark, sf_dir):
    g = B.build_groups(B.with_tokens(sessions(spark, sf_dir)))
    n = lambda p: F.size(F.filter("raw_items", lambda t: t.startswith(p))).cast("bigint")
    return g.select("group_id", F.hour(F.timestamp_seconds("start_ts")).cast("bigint").alias("hour_of_day"), "n_alerts", n("host:").alias("n_host"), n("short:").alias("n_short"), n("sig:").alias("n_sig"))
