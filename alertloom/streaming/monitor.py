"""Drift monitoring: rates, calibration, streaks and actions, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.operators.metrics import psi

PSI_ELEVATED, PSI_SIGNIFICANT, DRIFT_ELEVATED = 0.1, 0.2, 0.10
MIN_SAMPLES, STREAK = 30, 3


def rate_signal(fired: DataFrame, totals: DataFrame, expected: DataFrame, threshold: float = PSI_ELEVATED) -> DataFrame:
    """Signal 1 per window and predicate: PSI of its firing rate against the expected one.

    ``fired``: (win_idx, predicate_id) a row for each firing group; ``totals``:
    (win_idx, n_observed); ``expected``: (predicate_id, p_expected).
    """
    hits = fired.groupBy(F.col("win_idx").alias("w__"), F.col("predicate_id").alias("p__")).agg(F.count("*").alias("n_fired"))
    # Windows are few (a run has one over its granularity): they go to each predicate as one array.
    windows = totals.agg(F.collect_list(F.struct("win_idx", "n_observed")).alias("w__")).withColumn("k__", F.lit(1))
    grid = expected.withColumn("k__", F.lit(1)).join(F.broadcast(windows), "k__").select(*expected.columns, F.inline("w__"))
    joined = grid.join(hits, (F.col("win_idx") == F.col("w__")) & (F.col("predicate_id") == F.col("p__")), "left")
    observed = F.coalesce(F.try_divide(F.coalesce("n_fired", F.lit(0)).cast("double"), F.col("n_observed")), F.lit(0.0))
    out = joined.select("win_idx", "predicate_id", "p_expected", observed.alias("p_observed"), "n_observed").withColumn("psi", psi(F.col("p_expected"), F.col("p_observed")))
    return out.withColumn("elevated", F.col("psi") > threshold).withColumn("significant", F.col("psi") > PSI_SIGNIFICANT)


def calibration_signal(matches: DataFrame, mined: DataFrame, min_samples: int = MIN_SAMPLES, threshold: float = DRIFT_ELEVATED) -> DataFrame:
    """Signal 2 per window and rule: observed precision against the mined confidence; null below ``min_samples``.

    ``matches``: (win_idx, rule_id, correct); ``mined``: (rule_id, confidence).
    """
    seen = matches.groupBy("win_idx", "rule_id").agg(F.count("*").alias("n_matching"), F.avg(F.col("correct").cast("double")).alias("rate"))
    joined = seen.join(mined.select(F.col("rule_id").alias("r__"), F.col("confidence").alias("mined_confidence")), F.col("rule_id") == F.col("r__"))
    enough = F.when(F.col("n_matching") >= min_samples, F.col("rate"))
    out = joined.select("win_idx", "rule_id", "mined_confidence", "n_matching", enough.alias("observed_confidence"))
    return out.withColumn("drift", F.abs(F.col("observed_confidence") - F.col("mined_confidence"))).withColumn("elevated", F.coalesce(F.col("drift") > threshold, F.lit(False)))


def action_of(one: Column, two: Column, streak_one: Column, streak_two: Column, length: int = STREAK) -> Column:
    """What to do about a window, from its flags and the streaks that include it."""
    hit = (streak_one >= length) | (streak_two >= length)
    return F.when(~one & ~two, "NO_ACTION").when(one & two, "REMINE_AND_RETRAIN").when(~hit, "SOFT_ALERT").when(one, "RETRAIN_ONLY").otherwise("REMINE_AND_RETRAIN")


def streak(flag: str, key: str, order: str) -> Column:
    """How many rows up to this one are flagged without a break."""
    w = Window.partitionBy(key).orderBy(order)
    last_clear = F.max(F.when(~F.col(flag), F.col("seq__"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.when(F.col(flag), F.col("seq__") - F.coalesce(last_clear, F.lit(0))).otherwise(0)


def triggers(windows: DataFrame, key: str = "scenario", order: str = "win_idx", length: int = STREAK) -> DataFrame:
    """Adds streaks, action and trigger_remine per window (signal_1, signal_2)."""
    numbered = windows.withColumn("seq__", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    counted = numbered.withColumn("streak_1", streak("signal_1", key, order)).withColumn("streak_2", streak("signal_2", key, order))
    acted = counted.withColumn("action", action_of(F.col("signal_1"), F.col("signal_2"), F.col("streak_1"), F.col("streak_2"), length))
    return acted.withColumn("trigger_remine", ~F.col("action").isin("NO_ACTION", "SOFT_ALERT")).drop("seq__")


def stream_triggers(windows: DataFrame, length: int = STREAK) -> DataFrame:
    """The same over a stream of windows (scenario, win_idx, signal_1, signal_2): counters are kept state.

    Windows of a scenario must arrive in order across batches; within a batch they are sorted.
    """

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: object) -> Iterator[pd.DataFrame]:
        one, two = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values("win_idx")
        out = []
        for win, s1, s2 in zip(rows.win_idx, rows.signal_1, rows.signal_2, strict=True):
            one, two = (one + 1) * bool(s1), (two + 1) * bool(s2)
            hit = one >= length or two >= length
            if not s1 and not s2:
                action = "NO_ACTION"
            elif s1 and s2:
                action = "REMINE_AND_RETRAIN"
            else:
                action = ("RETRAIN_ONLY" if s1 else "REMINE_AND_RETRAIN") if hit else "SOFT_ALERT"
            out.append((key[0], win, one, two, action))
        state.update((one, two))
        yield pd.DataFrame(out, columns=["scenario", "win_idx", "streak_1", "streak_2", "action"])

    return windows.groupBy("scenario").applyInPandasWithState(
        advance, "scenario string, win_idx bigint, streak_1 int, streak_2 int, action string", "one int, two int", "append", "NoTimeout"
    )


def stream_fixed_windows(alerts: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """Tumbling groups per host over a stream with column ts; rows later than the watermark are dropped."""
    attack = (F.col("label") != "false_positive").cast("int")
    return alerts.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds"), "host").agg(F.count("*").alias("n_alerts"), F.max(attack).alias("any_attack"), F.min(attack).alias("all_attack"))


def stream_sessions(alerts: DataFrame, gap: int, late: str = "10 minutes") -> DataFrame:
    """Sessions per host over a stream with column ts; one ends where the next row is ``gap`` seconds later or more."""
    # Spark joins rows that are exactly a gap apart, so its gap is a microsecond less.
    session = F.session_window("ts", f"{gap * 1_000_000 - 1} microseconds")
    attack = (F.col("label") != "false_positive").cast("int")
    return alerts.withWatermark("ts", late).groupBy(session, "host").agg(F.count("*").alias("n_alerts"), F.max(attack).alias("any_attack"), F.min(attack).alias("all_attack"))


def stability(features: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per window of a feature set (array ``features``): added, removed, kept and Jaccard against the one before; two empty sets are alike."""
    before = F.lag("features").over(Window.partitionBy(*keys).orderBy(order))
    rows = features.withColumn("before__", before).where("before__ is not null")
    kept, union = F.size(F.array_intersect("features", "before__")), F.size(F.array_union("features", "before__"))
    return rows.select(
        *keys, order, F.size(F.array_except("features", "before__")).alias("added"), F.size(F.array_except("before__", "features")).alias("removed"), kept.alias("unchanged"),
        F.when(union == 0, 1.0).otherwise(F.try_divide(kept.cast("double"), union)).alias("jaccard"),
    )


def persistence(present: DataFrame) -> DataFrame:
    """How many features are present in 1, 2, ... windows: (win_idx, feature) in."""
    per = present.groupBy("feature").agg(F.countDistinct("win_idx").alias("n_windows"))
    return per.groupBy("n_windows").agg(F.count("*").alias("n_features"))


def best_lag(series: DataFrame, order: str, x: str, y: str, lags: list[int], least: int = 3) -> DataFrame:
    """The lag with the highest correlation of x now with y later, from at least ``least`` pairs."""
    later = series.select(F.col(order).alias("o__"), F.col(y).alias("later__"))
    shifted = series.select(order, x, F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag"))
    pairs = shifted.join(later, F.col(order) + F.col("lag") == F.col("o__"))
    scored = pairs.groupBy("lag").agg(F.count("*").alias("n"), F.corr(x, "later__").alias("r")).where((F.col("n") >= least) & F.col("r").isNotNull() & ~F.isnan("r"))
    return scored.orderBy(F.desc("r"), "lag").limit(1)
