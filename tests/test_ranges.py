"""Running sums by ranges, runs in time, samples and ranks against plain loops."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from alertloom.operators import eda, evaluation, grouping, mining, ranges, rules, sampling, trees, windows


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(spark, descending):
    rnd = random.Random(1)
    points = {(k, round(rnd.gauss(0, 1) ** 3, 4)): rnd.randint(0, 9) for k in "ab" for _ in range(3_000)}
    df = spark.createDataFrame([(k, v, c) for (k, v), c in points.items()], "k string, v double, c bigint")
    got = {(r.k, r.v): (r.next__, r.before_c, r.total_c) for r in ranges.running(df, "v", ["c"], ["k"], descending).collect()}
    for k in "ab":
        values, before = sorted((v for q, v in points if q == k), reverse=descending), 0
        for v, following in zip(values, [*values[1:], None], strict=True):
            assert got[k, v] == (following, before, sum(c for (q, _), c in points.items() if q == k))
            before += points[k, v]
    assert ranges.running(df.limit(0), "v", ["c"]).count() == 0
    assert max(r["count"] for r in ranges.with_ranges(df.where("k = 'a'"), "v").groupBy("range__").count().collect()) < 30


@pytest.mark.parametrize("strict", [True, False])
def test_runs_in_time(spark, strict):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["x", "y", None]), rnd.randint(-5_000, 5_000)) for i in range(900)]
    df = spark.createDataFrame(rows, "row_id bigint, host string, time bigint")
    got = {r.row_id: r.run__ for r in ranges.with_runs(df, ["host"], 12, strict=strict, width=100).collect()}
    before = {r.row_id: r.previous__ for r in ranges.with_previous(df, ["host"], width=100).collect()}
    for host in ("x", "y", None):
        last = run = None
        for i, _, t in sorted((r for r in rows if r[1] == host), key=lambda r: (r[2], r[0])):
            run = 1 if last is None else run + (t - last > 12 if strict else t - last >= 12)
            assert (got[i], before[i]) == (run, last)
            last = t


def test_capped_sessions_of_many_keys(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["h", "i"]), rnd.choice(["s", None]), rnd.randint(0, 9_000)) for i in range(1_500)] + [(5_000, "h", "s", None)]
    df = spark.createDataFrame(rows, "row_id bigint, host string, signature string, time bigint")
    got = {r.row_id: r.group_id for r in grouping.capped_session(df, 30, 200).collect()}
    want = {}
    for key in {(r[1], r[2]) for r in rows}:
        anchor = last = None
        for i, _, _, t in sorted((r for r in rows if r[1:3] == key and r[3] is not None), key=lambda r: (r[3], r[0])):
            if anchor is None or t - last > 30 or t - anchor > 200:
                anchor = t
            last = t
            want[i] = (*key, anchor)
    assert len(got) == len(rows) and len({(got[i], want[i]) for i in want}) == len(set(want.values())) == len({got[i] for i in want})


def test_samples_per_class(spark):
    df = spark.range(5_000).select("id", (F.col("id") % 7 == 0).cast("int").alias("y"), (F.col("id") % 3 == 0).alias("inlier"))
    few = sampling.undersample(df, "y", "id", 4)
    assert {r.y: r["count"] for r in few.groupBy("y").count().collect()} == {0: 715, 1: 715}
    ranked = df.where("y = 0").orderBy(sampling.hash_order("id", 4), "id").limit(715)
    assert few.where("y = 0").select("id").exceptAll(ranked.select("id")).count() == 0
    chosen = sampling.guided(df, "y", "inlier", "id", 4)
    assert {(r.y, r.inlier): r["count"] for r in chosen.groupBy("y", "inlier").count().collect() if r.y == 0} == {(0, True): 358, (0, False): 357}
    assert sampling.undersample(df.limit(0), "y", "id").count() == 0


def test_ranks_and_concentration(spark):
    rnd = random.Random(4)
    rows = [(rnd.randint(0, 20), rnd.randint(0, 20)) for _ in range(400)]
    rank = lambda vs: [sum(w < v for w in vs) + (sum(w == v for w in vs) + 1) / 2 for v in vs]
    x, y = rank([r[0] for r in rows]), rank([r[1] for r in rows])
    mean = lambda v: sum(v) / len(v)
    dot = lambda a, b: sum((p - mean(a)) * (q - mean(b)) for p, q in zip(a, b, strict=True))
    df = spark.createDataFrame([*rows, (None, 3)], "x int, y int")
    assert evaluation.spearman(df, "x", "y").first().spearman == pytest.approx(dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5)
    counts = sorted(([r[0] for r in rows].count(v) for v in {r[0] for r in rows}), reverse=True)
    got = eda.concentration(df.where("x is not null"), "x", 0.5, 3).first()
    assert got.top_share == pytest.approx(sum(counts[:3]) / 400) and got.n_values == len(counts)
    assert got.n_for_share == next(k for k in range(1, 30) if sum(counts[:k]) >= 200)


def test_best_split_over_many_values(spark):
    rnd = random.Random(5)
    rows = [(int((v := round(rnd.random(), 3)) > 0.4) if rnd.random() < 0.9 else rnd.randint(0, 1), v) for _ in range(3_000)]
    df = spark.createDataFrame(rows, "y int, value double")
    n = [sum(y == k for y, _ in rows) for k in (0, 1)]

    def impurity(cut):
        p, q = sum(y == 1 and v <= cut for y, v in rows) / n[1], sum(y == 0 and v <= cut for y, v in rows) / n[0]
        gini = lambda a, b: (a + b) * (1 - (a / (a + b)) ** 2 - (b / (a + b)) ** 2)
        return (gini(p, q) + gini(1 - p, 1 - q)) / 2

    values = sorted({v for _, v in rows})
    best = min(((impurity((a + b) / 2), (a + b) / 2) for a, b in zip(values[250:550], values[251:551], strict=True)))
    got = rules.stump(df, "value").first()
    assert (got.impurity, got.threshold) == (pytest.approx(best[0]), pytest.approx(best[1]))
    split = trees.best_splits(df.select(F.lit(0).alias("node"), "y", F.when(F.col("y") == 1, 0.5 / n[1]).otherwise(0.5 / n[0]).alias("weight"), "value"), ["value"], 1).first()
    assert split.threshold == pytest.approx(best[1])


def test_phase_folds(spark):
    rows = [(i, "a", t) for i, t in enumerate(range(0, 1_000, 7))]
    df = spark.createDataFrame(rows, "row_id bigint, host string, time bigint")
    phases = spark.createDataFrame([("a", 1, 0, 90), ("a", 2, 200, 300), ("a", 3, 700, 900)], "host string, island int, start bigint, end bigint")
    got = sorted((r.cut, r.n_train, r.n_test) for r in windows.phase_folds(df, phases, ["host"]).collect())
    inside = lambda lo, hi: sum(lo <= t < hi for _, _, t in rows)
    assert got == [(145.0, inside(0, 145), inside(145, 500)), (500.0, inside(0, 500), inside(500, 2_000))]


# --- patterns


def embeds(pattern, sequence):
    at = 0
    for step in sequence:
        if at < len(pattern) and set(pattern[at]) <= set(step):
            at += 1
    return at == len(pattern)


@pytest.mark.parametrize("seed", range(4))
def test_itemset_sequences_equal_enumeration(spark, seed):
    rnd = random.Random(seed)
    data = [[sorted(rnd.sample("pqr", rnd.randint(1, 3))) for _ in range(rnd.randint(1, 4))] for _ in range(rnd.randint(2, 8))]
    if seed == 0:
        data = [[["p"], ["p"], ["p", "r"]]]
    sets = [c for k in (1, 2, 3) for c in combinations("pqr", k)]
    patterns = [(a,) for a in sets] + [(a, b) for a in sets for b in sets if len(a + b) <= 3] + [((a,), (b,), (c,)) for a in "pqr" for b in "pqr" for c in "pqr"]
    want = {p: n for p in patterns if (n := sum(embeds(p, s) for s in data)) >= min(2, len(data))}
    steps = spark.createDataFrame([(g, pos, item) for g, s in enumerate(data) for pos, step in enumerate(s) for item in step], "gid int, pos int, item string")
    got = {tuple(map(tuple, r.steps)): r.support_count for r in mining.itemset_sequences(steps, min(2, len(data)), 3).collect()}
    assert got == want
    sequences = spark.createDataFrame([(g, "attack" if g % 2 else "benign", s) for g, s in enumerate(data)], "gid int, group_label string, context_steps array<array<string>>")
    chosen = spark.createDataFrame([([list(x) for x in p],) for p in want], "steps array<array<string>>")
    for r in mining.sequence_support(chosen, sequences).collect():
        p = tuple(map(tuple, r.steps))
        assert r.count_attack + r.count_benign == want[p] and r.count_attack == sum(embeds(p, s) for g, s in enumerate(data) if g % 2)


@pytest.mark.parametrize("seed", range(2))
def test_disjunctions_equal_unions(spark, seed):
    rnd = random.Random(seed)
    data = [(g, c) for g in range(60) for c in "uvwxy" if rnd.random() < 0.25]
    label = {g: rnd.choice(["attack", "attack", "benign"]) for g in range(60)}
    groups = spark.createDataFrame(list(label.items()), "gid int, group_label string")
    firing = spark.createDataFrame([(c, g, label[g]) for g, c in data], "clause string, gid int, group_label string")
    fires = {c: {g for g, x in data if x == c} for c in "uvwxy"}
    n = {y: sum(v == y for v in label.values()) for y in ("attack", "benign")}
    cover = lambda cs, y: sum(label[g] == y for g in set().union(*(fires[c] for c in cs)))
    want = {}
    for k in (2, 3):
        for cs in combinations("uvwxy", k):
            a, b = cover(cs, "attack"), cover(cs, "benign")
            best = max(cover([c for c in cs if c != d], "attack") for d in cs)
            sa, sb = a / n["attack"], b / n["benign"]
            if min(cover([c], "attack") for c in cs) / n["attack"] >= 0.02 and (a - best) / n["attack"] >= 0.02 - 1e-9 and abs(sa - sb) >= 0.01 and sa / (sa + sb) >= 0.4:
                want[" OR ".join(cs)] = (a, b)
    got = {r.pattern: (r.count_attack, r.count_benign) for r in mining.or_disjunctions(firing, groups, 3, 0.02, 0.01, 0.4).collect()}
    assert got == want and want


def test_identical_firing_is_verified(spark):
    firing = spark.createDataFrame([(f, g) for f, gs in {"a": [1, 2], "b": [2, 1], "c": [1], "d": [2], "e": [1, 2, 2]}.items() for g in gs], "feature string, gid int")
    assert sorted(tuple(r) for r in mining.identical_firing(firing).collect()) == [("a", 3, 2), ("c", 1, 1), ("d", 1, 1)]
