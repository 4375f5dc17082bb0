"""Grouping, sequences and small expressions against brute force."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from alertloom.functions import tokens as T
from alertloom.operators import grouping, groups, lookback, metrics, mining, rules, windows
from alertloom.streaming import monitor

SCHEMA = "row_id bigint, time bigint, host string, signature string, short string, label string"


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


def capped(rows, gap, span):
    anchor = last = None
    out = []
    for t in rows:
        if anchor is None or t - last > gap or t - anchor > span:
            anchor = t
        last = t
        out.append(anchor)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_sessions_follow_the_fold(spark, seed):
    rnd = random.Random(seed)
    times = sorted(rnd.randint(-2000, 5000) for _ in range(200))
    rows = frame(spark, [(t, "h", "s", "S-x", "attack") for t in times])
    for method, gap, span in (("capped_session", 60, 300), ("temporal", 60, 300), ("time_delta_host", 60, 10**9), ("time_delta", 60, 10**9)):
        options = {"timeout": gap, "length": span} if span < 10**9 else {"gap": gap}
        got = grouping.group_alerts(rows, method, **options).groupBy("group_id").agg(F.min("time").alias("a"), F.count("*").alias("n"))
        want = {}
        for a in capped(times, gap, span):
            want[a] = want.get(a, 0) + 1
        assert sorted((r.a, r.n) for r in got.collect()) == sorted(want.items()), method


def test_time_delta_across_buckets(spark):
    rows = frame(spark, [(t, None, "s", "S-x", None) for t in (0, 60, 120, 181, 500, 560)])
    got = grouping.time_delta(rows, 60, bucket=100).groupBy("group_id").agg(F.min("time").alias("a"), F.count("*").alias("n")).collect()
    assert sorted((r.a, r.n) for r in got) == [(0, 3), (181, 1), (500, 2)]


def test_fixed_window_floors_and_unknown_host(spark):
    rows = frame(spark, [(-3, "", "s", "S", None), (5, None, "s", "S", None)])
    got = {r.time: r.group_id for r in grouping.fixed_window_host(rows, 2).collect()}
    assert got == {-3: "fixed_window_host:_unknown:-2", 5: "fixed_window_host:_unknown:2"}
    with pytest.raises(ValueError, match="unknown"):
        grouping.group_alerts(rows, "nope")


def test_group_labels(spark):
    rows = spark.createDataFrame([(["false_positive"],), (["x"],), (["x", "false_positive"],), ([],)], "l array<string>")
    assert [r.x for r in rows.select(groups.label_of(F.col("l")).alias("x")).collect()] == ["benign", "attack", "mixed", None]


def test_numbered_rows_and_windows(spark):
    rows = spark.createDataFrame([(t, f"g{t}") for t in (5, 90_000, 3, 200_000, 90_001, 7, 1)], "start_ts bigint, group_id string")
    numbered = groups.numbered_rows(rows)
    assert [r.start_ts for r in numbered.orderBy("rn").collect()] == [1, 3, 5, 7, 90_000, 90_001, 200_000]
    assert [r.win_idx for r in windows.with_windows(numbered, 0.3).orderBy("rn").collect()] == [0, 0, 1, 1, 2, 2, 2]


def test_lookback_steps(spark):
    noon = 1_700_006_400
    seen = [(-4000, "too-early"), (-3600, "first"), (-3599, "ping"), (-3541, "pong"), (-60, "login"), (-60, "login"), (0, "drop"), (45, "inside"), (46, "too-late")]
    alerts = frame(spark, [(noon + d, "db", "s", code, None) for d, code in seen] + [(noon, "web", "s", "elsewhere", None)])
    asked = spark.createDataFrame([("g", "db", noon, noon + 45), ("quiet", "mail", noon, noon + 45)], "gid string, host string, start_ts bigint, end_ts bigint")
    got = {r.gid: r.context_steps for r in lookback.lookback_steps(asked, alerts, 3600, 60).collect()}
    assert got == {"g": [["first", "ping", "pong"], ["login"], ["drop", "inside"]], "quiet": []}


@pytest.mark.parametrize("seed", range(3))
def test_itemsets_equal_enumeration(spark, seed):
    rnd = random.Random(seed)
    data = [(i, "attack", sorted(rnd.sample("abcd", rnd.randint(1, 4)))) for i in range(rnd.randint(1, 15))]
    items = mining.long_items(spark.createDataFrame(data, "gid int, group_label string, items array<string>"))
    want = {}
    for _, _, b in data:
        for k in (1, 2, 3):
            for c in combinations(b, k):
                want[c] = want.get(c, 0) + 1
    got = {tuple(r["items"]): r.support_count for r in mining.itemsets(items, 2, 3).collect()}
    assert got == {k: v for k, v in want.items() if v >= 2}
    inside = mining.basket_itemsets(spark.createDataFrame(data, "gid int, group_label string, items array<string>"), 2, 3)
    assert {tuple(r["items"]): r.count_attack for r in inside.collect()} == got


def test_supports_and_subsets(spark):
    data = [(0, "attack", ["a", "b"]), (1, "attack", ["a"]), (2, "benign", ["a", "b"]), (3, "benign", ["c"])]
    b = spark.createDataFrame(data, "gid int, group_label string, items array<string>")
    sets = mining.itemsets(mining.long_items(b), 1, 2)
    got = {tuple(r["items"]): (r.count_attack, r.count_benign, r.support_diff) for r in mining.confidence(mining.cross_support(sets, b)).collect()}
    assert got == {("a",): (2, 1, 0.5), ("b",): (1, 1, 0.0), ("a", "b"): (1, 1, 0.0), ("c",): (0, 1, -0.5)}
    assert {tuple(r["items"]) for r in mining.without_subsets(sets).collect()} == {("a", "b"), ("c",)}


def test_min_support_rounds_up(spark):
    for share, n, want in ((0.07, 43, 4), (0.03, 200, 6), (0.3, 10, 3), (0.0, 77, 1), (0.001, 9, 1), (0.5, 7, 4)):
        assert spark.range(1).select(mining.min_support_count(share, F.lit(n)).alias("x")).first().x == want


def test_containment(spark):
    steps = F.array(F.array(F.lit("a")), F.array(F.lit("b"), F.lit("c")))
    strings = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    cols = [mining.contains_items_in_order(steps, strings(*p)).alias("x") for p in (("a", "b"), ("b", "c"), ("b", "a"), ())]
    assert list(spark.range(1).select(*[c.alias(f"x{i}") for i, c in enumerate(cols)]).first()) == [True, False, False, True]


def test_rules_round_trip_and_encoding(spark):
    rule_set = rules.RuleSet([rules.Rule("r1", (("a", "b"), ("c",))), rules.Rule("r2", predicates=(rules.Predicate("n", ">", 2),)), rules.Rule("r1", (("z",),))])
    assert rules.RuleSet.loads(rule_set.dumps()) == rule_set and len(rule_set.rules) == 2
    df = spark.createDataFrame([(0, ["a", "b"], 1), (1, ["c"], None), (2, ["a"], 5)], "gid int, items array<string>, n int")
    assert [tuple(r)[1:] for r in rules.encode(df, rule_set, ["gid"], ["r1", "r2", "x"]).orderBy("gid").collect()] == [(1, 0, 0), (1, 0, 0), (0, 1, 0)]


def test_runs_and_tokens(spark):
    row = spark.range(1).select(
        T.run_lengths(F.split(F.lit("a a b c c c"), " ")).alias("runs"), T.cve_refs(F.lit("x CVE-2021-1 cve-2021-1 CVE-2020-22")).alias("cve"), T.short_tokens(F.lit("A- b -A")).alias("short"),
        T.abstract_mail_hosts(F.array(F.lit("host:a_mail"), F.lit("host:b_mail"), F.lit("x"))).alias("mail"), T.parse_reply(F.lit("attack!")).alias("reply"),
        T.abstract_by_map(F.array(F.lit("A-1"), F.lit("A-2"), F.lit("q")), {"A-1": ["A", "top"], "A-2": ["A", "top"]}, 0).alias("up"),
    ).first()
    assert row.runs == ["a__repeat_2", "b", "c__repeat_3_4"] and row.cve == ["CVE-2020-22", "CVE-2021-1"] and row.short == ["A", "b"]
    assert row.mail == ["host:mail_host", "host:multiple_mail_hosts", "x"] and row.reply == 1 and row.up == ["A", "q"]


def test_auc_and_precision_brute(spark):
    rnd = random.Random(2)
    data = [(rnd.randint(0, 1), rnd.randint(0, 9) / 10) for _ in range(80)]
    df = spark.createDataFrame(data, "y int, score double")
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert metrics.roc_auc(df).first().auc == pytest.approx(auc)
    assert metrics.roc_auc(df.where("y = 1")).first().auc is None


def test_stream_triggers_equal_batch(spark, tmp_path):
    rnd = random.Random(1)
    data = [("s", i, rnd.random() < 0.6, rnd.random() < 0.3) for i in range(12)]
    schema = "scenario string, win_idx bigint, signal_1 boolean, signal_2 boolean"
    df = spark.createDataFrame(data, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = monitor.stream_triggers(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("acts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r.win_idx: (r.streak_1, r.streak_2, r.action) for r in spark.sql("select * from acts").collect()}
    assert got == {r.win_idx: (r.streak_1, r.streak_2, r.action) for r in monitor.triggers(df).collect()}
