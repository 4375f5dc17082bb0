"""Grouping of alerts: tumbling windows, sessions and capped sessions, over all or by key.

Input rows have row_id, time (seconds), host and signature; results add
group_id and method. Gaps split where they are larger than the limit, not equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.functions.tokens import safe_id
from alertloom.operators.ranges import with_runs

if TYPE_CHECKING:
    import pyarrow as pa

UNKNOWN_HOST = "_unknown"


def host_key() -> Column:
    return F.coalesce(F.nullif(F.col("host"), F.lit("")), F.lit(UNKNOWN_HOST))


def fixed_window(alerts: DataFrame, seconds: int = 2) -> DataFrame:
    """Tumbling windows; the number of a window is a floor, also before 1970."""
    return alerts.withColumn("group_id", F.concat(F.lit("fixed_window:"), F.floor(F.col("time") / seconds).cast("string"))).withColumn("method", F.lit("fixed_window"))


def fixed_window_host(alerts: DataFrame, seconds: int = 2) -> DataFrame:
    number = F.floor(F.col("time") / seconds).cast("string")
    return alerts.withColumn("group_id", F.concat_ws(":", F.lit("fixed_window_host"), safe_id(host_key()), number)).withColumn("method", F.lit("fixed_window_host"))


def _keyed(alerts: DataFrame, keys: list[Column]) -> tuple[DataFrame, list[str]]:
    names = [f"key{i}__" for i in range(len(keys))]
    return alerts.withColumns(dict(zip(names, keys, strict=True))) if keys else alerts, names


def _sessions(alerts: DataFrame, keys: list[Column], gap: int, method: str, width: int = 86_400) -> DataFrame:
    """Sessions, numbered in time per key; a busy key is dealt over buckets of time."""
    keyed, names = _keyed(alerts, keys)
    numbered = with_runs(keyed, names, gap, width=max(width, gap))
    name = F.concat_ws(":", F.lit(method), *[safe_id(F.col(k)) for k in names], F.col("run__").cast("string"))
    return numbered.withColumn("group_id", name).withColumn("method", F.lit(method)).select(*alerts.columns, "group_id", "method")


def time_delta_host(alerts: DataFrame, gap: int = 2) -> DataFrame:
    """Sessions of each host."""
    return _sessions(alerts, [host_key()], gap, "time_delta_host")


def time_delta(alerts: DataFrame, gap: int = 2, bucket: int | None = None) -> DataFrame:
    """Sessions over the whole stream, in buckets of time (by default 1000 gaps), without one task for all of it."""
    return _sessions(alerts, [], gap, "time_delta", bucket or 1000 * max(gap, 1))


def _capped(alerts: DataFrame, keys: list[Column], gap: int, span: int, method: str) -> DataFrame:
    """Sessions that also end where an alert is more than ``span`` after the session's first.

    The cap makes each split depend on the one before, so a key is folded in
    order; but only over its distinct seconds, however many alerts they hold, and
    one row at a time: nothing is collected.
    """
    keyed, names = _keyed(alerts, keys)
    ticks = keyed.select(*names, "time").distinct().repartition(*names).sortWithinPartitions(*names, "time")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        last_key = anchor = last = None
        number = 0
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out = []
            for *key, time in zip(*columns, strict=True):
                if key != last_key:
                    last_key, anchor, last, number = key, None, None, 0
                if time is not None:
                    if anchor is None or time - last > gap or time - anchor > span:
                        anchor, number = time, number + 1
                    last = time
                out.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*(f"at_{n}" for n in names), "at__", "n__"])

    schema = "".join(f"at_{n} {keyed.schema[n].dataType.simpleString()}, " for n in names) + f"at__ {alerts.schema['time'].dataType.simpleString()}, n__ bigint"
    folded = ticks.mapInArrow(fold, schema)
    joined = keyed.join(folded, [F.col("time").eqNullSafe(F.col("at__")), *[F.col(n).eqNullSafe(F.col(f"at_{n}")) for n in names]])
    name = F.concat_ws(":", F.lit(method), *[safe_id(F.col(n)) for n in names], F.col("n__").cast("string"))
    return joined.select(*alerts.columns, name.alias("group_id"), F.lit(method).alias("method"))


def capped_session(alerts: DataFrame, timeout: int = 60, length: int = 300) -> DataFrame:
    """Per host and signature: idle timeout and greatest length."""
    return _capped(alerts, [host_key(), F.coalesce("signature", F.lit(""))], timeout, length, "capped_session")


def capped_stream(alerts: DataFrame, timeout: int = 60, length: int = 300) -> DataFrame:
    """Capped sessions over the whole stream: no cap reaches beyond a pause, so each stretch between pauses is folded by itself."""
    stretches = time_delta(alerts, timeout).withColumnRenamed("group_id", "stretch__").drop("method")
    return _capped(stretches, [F.substring_index("stretch__", ":", -1)], timeout, length, "temporal").drop("stretch__")


METHODS: dict[str, Callable[..., DataFrame]] = {
    "fixed_window": fixed_window,
    "fixed_window_host": fixed_window_host,
    "time_delta": time_delta,
    "time_delta_host": time_delta_host,
    "capped_session": capped_session,
    "temporal": capped_stream,
}


def group_alerts(alerts: DataFrame, method: str, **options: int) -> DataFrame:
    """Group by a method's name; ValueError for an unknown one."""
    if method not in METHODS:
        raise ValueError(f"unknown grouping method {method!r}")
    return METHODS[method](alerts, **options)


def members(grouped: DataFrame) -> DataFrame:
    """One row a group with its alerts in order of time."""
    return grouped.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("time", "row_id"))), lambda x: x["row_id"]).alias("row_ids"))


def manual_review(grouped: DataFrame, outliers: DataFrame) -> DataFrame:
    """Outlier records (alert_id) with their alert, the last of those that share an id; unmatched ones are dropped."""
    newest = grouped.groupBy("alert_id").agg(F.max_by(F.struct("row_id", "time", "host", "signature"), "row_id").alias("a")).select(F.col("alert_id").alias("of__"), "a.*")
    return outliers.join(newest, F.col("alert_id") == F.col("of__")).drop("of__")
