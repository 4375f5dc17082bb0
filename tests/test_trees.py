"""Trees, covering, stores, file scans and evaluation helpers against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from alertloom.operators import evaluation, groups, mining, sampling, trees
from alertloom.sources import events
from alertloom.sources.store import GroupQuery, GroupStore


def brute_split(rows, features):
    na, nb = sum(r["y"] for r in rows), sum(1 - r["y"] for r in rows)
    gini = lambda p, n: (p + n) - (p * p + n * n) / (p + n) if p + n else 0
    best = None
    for f in features:
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            left = [r for r in rows if r[f] <= a]
            p, n = sum(r["y"] for r in left) * 0.5 / na, sum(1 - r["y"] for r in left) * 0.5 / nb
            gain = gini(0.5, 0.5) - gini(p, n) - gini(0.5 - p, 0.5 - n)
            key = (-round(gain, 12), f, (a + b) / 2)
            if best is None or key < best:
                best = key
    return best


def test_first_split_equals_brute_force(spark):
    rnd = random.Random(3)
    rows = [{"x": float(rnd.randint(0, 9)), "z": rnd.randint(0, 5) / 2} for _ in range(60)]
    for r in rows:
        r["y"] = int(r["x"] + r["z"] + rnd.random() * 4 > 7)
    df = spark.createDataFrame(rows)
    gain, feature, threshold = brute_split(rows, ["x", "z"])
    leaves = trees.fit_tree(df, ["x", "z"], 1, 1)
    assert {(leaf.path[0].attribute, leaf.path[0].value) for leaf in leaves} == {(feature, threshold)}
    assert sum(leaf.n_attack for leaf in leaves) == sum(r["y"] for r in rows) and gain < 0
    assert len(trees.fit_tree(df, ["x", "z"], 2, 1)) <= 4
    assert trees.fit_tree(df.where("y = 1"), ["x", "z"], 2, 1)[0].n_benign == 0


def test_cover_and_undersample(spark):
    data = [(i, "attack" if i < 6 else "benign", ["a"] if i < 4 else ["b"] if i in (4, 5, 9) else ["c"]) for i in range(10)]
    b = spark.createDataFrame(data, "gid int, group_label string, items array<string>")
    assert trees.cover_rules(mining.long_items(b), b) == [("a", 4, 0), ("b", 2, 1)]
    counts = sampling.undersample(b, "group_label", "gid").groupBy("group_label").count().collect()
    assert {r.group_label: r["count"] for r in counts} == {"attack": 4, "benign": 4}


def test_store_round_trip(spark, tmp_path):
    rows = [(f"g{i}", i, i + 1, "attack" if i % 2 else "benign", "closed" if i < 4 else "open", "m") for i in range(5)]
    df = spark.createDataFrame(rows, "group_id string, start_ts bigint, end_ts bigint, group_label string, status string, method string")
    store = GroupStore(spark, str(tmp_path / "store"))
    assert store.is_empty()
    assert store.load_or_build(lambda: df).count() == 5 and not store.is_empty()
    assert [r.group_id for r in store.query(GroupQuery(labels=("attack",))).collect()] == ["g1", "g3"]
    assert [r.group_id for r in store.last(2).collect()] == ["g2", "g3"] and store.get("g4").count() == 1
    assert [r.group_id for r in store.ids().collect()] == [f"g{i}" for i in range(5)]
    assert GroupStore(spark, str(tmp_path / "store")).load_or_build(lambda: 1 / 0).count() == 5


def test_file_scans(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,name,ip,host,short,time_label,event_label\n5,x,,h,S,false_positive,-\n")
    row = events.read_alert_csv(spark, str(tmp_path / "a.csv")).first()
    assert (row.time, row.signature, row.ip, row.label, row["_bad"]) == ("5", "x", None, "false_positive", False)
    (tmp_path / "a.json").write_text('[{"time": 5, "name": "x", "time_label": "l"}, {"time": "6", "signature": "y", "label": "m"}]')
    assert [(r.time, r.signature, r.label) for r in events.read_alert_json(spark, str(tmp_path / "a.json")).collect()] == [("5", "x", "l"), ("6", "y", "m")]
    events.write_encoded(spark.createDataFrame([(1, 2)], "`a+b` int, `c/d` int"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/parquet")).columns == ["a_b", "c_d"]


def test_dbscan_and_models(spark):
    points = [("k", i, [float(i), 0.0]) for i in range(4)] + [("k", 9, [50.0, 0.0])]
    got = {r.point_id: r.cluster for r in evaluation.dbscan(spark.createDataFrame(points, "key string, point_id bigint, vector array<double>"), 1.0, 2).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 9: -1}
    rows = spark.createDataFrame([(i, float(i), int(i > 20)) for i in range(40)], "id int, x double, y int")
    scored = evaluation.fit_and_score(rows, rows, ["x"])
    assert scored.where("(score > 0.5) <> (y = 1)").count() <= 2
    assert evaluation.fit_and_score(rows.where("y = 1"), rows, ["x"]).where("score <> 1").count() == 0
    with pytest.raises(ValueError, match="unknown model"):
        evaluation.fit_and_score(rows, rows, ["x"], "nope")


def test_bootstrap_weights_average_one(spark):
    rows = spark.createDataFrame([(i, 1.0 + i % 3, 1.0) for i in range(60)], "block int, a double, b double")
    r = evaluation.paired_bootstrap(rows, 300).first()
    assert r.mean == pytest.approx(1.0, abs=0.05) and r.low < 1 < r.high and r.p_not_better == 0


def test_group_metrics_of_one_group(spark):
    df = spark.createDataFrame([("g", 1, 5, "h", "s", None), ("g", 2, 9, "h", "s", "false_positive")], "group_id string, row_id int, time int, host string, signature string, label string")
    r = groups.grouping_metrics(df).first()
    assert (r.n_groups, r.mixed, r.minority_exposure, r.span_max) == (1, 1.0, 0.5, 4)
    assert F is not None
