"""The group store: one partitioned table of groups instead of a file for each."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder (spark.checkpoint.dir); in a temporary one only in local mode without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="alertloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class GroupQuery:
    """A conjunctive filter; by default closed groups only."""

    group_id: str | None = None
    methods: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    start_after: int | None = None
    end_before: int | None = None
    statuses: tuple[str, ...] = ("closed",)

    def condition(self) -> Column:
        out = F.lit(True)
        if self.statuses:
            out &= F.col("status").isin(*self.statuses)
        if self.group_id is not None:
            out &= F.col("group_id") == self.group_id
        if self.methods:
            out &= F.col("method").isin(*self.methods)
        if self.labels:
            out &= F.col("group_label").isin(*self.labels)
        if self.start_after is not None:
            out &= F.col("start_ts") >= self.start_after
        if self.end_before is not None:
            out &= F.col("end_ts") <= self.end_before
        return out


class GroupStore:
    """Groups under a path, partitioned by method; filters reach the scan."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def is_empty(self) -> bool:
        try:
            return self.spark.read.parquet(self.path).isEmpty()
        except AnalysisException:
            return True

    def write(self, groups: DataFrame, mode: str = "append") -> None:
        groups.write.mode(mode).partitionBy("method").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def get(self, group_id: str) -> DataFrame:
        return self.read().where(F.col("group_id") == group_id)

    def ids(self) -> DataFrame:
        return self.read().select("group_id").distinct().orderBy("group_id")

    def query(self, query: GroupQuery = GroupQuery()) -> DataFrame:
        """Matching groups by end, start and id."""
        return self.read().where(query.condition()).orderBy("end_ts", "start_ts", "group_id")

    def last(self, n: int, query: GroupQuery = GroupQuery()) -> DataFrame:
        """The last n of the matching groups, in order."""
        newest = self.read().where(query.condition()).orderBy(F.desc("end_ts"), F.desc("start_ts"), F.desc("group_id")).limit(n)
        return newest.orderBy("end_ts", "start_ts", "group_id")

    def load_or_build(self, build: Callable[[], DataFrame]) -> DataFrame:
        """What is stored, or else what ``build`` makes, stored first."""
        if self.is_empty():
            self.write(build(), "overwrite")
        return self.read()
