"""Rule schemas on shared storage: versions with fingerprints of what they were mined from, and their reuse."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.operators.rules import RuleSet

ROW = "name string, version string, fingerprint string, created timestamp, body string"


def fingerprint(identity: dict, settings: dict, excluded: tuple[str, ...] = ()) -> str:
    """The same for the same inputs, settings and left-out fields, in any order; 16 hexadecimal digits."""
    whole = {"identity": identity, "settings": settings, "excluded": sorted(excluded), "format": 1}
    return hashlib.sha256(json.dumps(whole, sort_keys=True, default=str).encode()).hexdigest()[:16]


class SchemaStore:
    """An append-only table of schema versions under a path; one row a version."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def versions(self, name: str | None = None) -> DataFrame:
        """All versions, or those of a name; empty where nothing is stored yet."""
        try:
            rows = self.spark.read.schema(ROW).parquet(self.path)
        except AnalysisException:
            rows = self.spark.createDataFrame([], ROW)
        return rows if name is None else rows.where(F.col("name") == name)

    def save(self, name: str, rules: RuleSet, mark: str = "") -> RuleSet:
        """Store rules as the next version of a name; returns them under that version."""
        last = self._newest(self.versions(name))
        if last is not None:
            rules = RuleSet(rules.rules, RuleSet([], last.version).next_version())
        row = (name, rules.version, mark, datetime.now(timezone.utc), rules.dumps())
        self.spark.createDataFrame([row], ROW).coalesce(1).write.mode("append").parquet(self.path)
        return rules

    def load(self, name: str, version: str | None = None) -> RuleSet:
        """A version, by default the newest; KeyError where there is none."""
        rows = self.versions(name)
        found = self._newest(rows if version is None else rows.where(F.col("version") == version))
        if found is None:
            raise KeyError(f"no schema {name!r}" + (f" of version {version}" if version else ""))
        return RuleSet.loads(found.body)

    def get_or_mine(self, name: str, mark: str, mine: Callable[[], RuleSet], force: bool = False) -> RuleSet:
        """The newest schema of a fingerprint, or else what ``mine`` makes, stored first."""
        found = None if force else self._newest(self.versions(name).where(F.col("fingerprint") == mark))
        return RuleSet.loads(found.body) if found is not None else self.save(name, mine(), mark)

    @staticmethod
    def _newest(rows: DataFrame):
        number = F.transform(F.split("version", r"\."), lambda x: x.cast("int"))
        return rows.orderBy(number.desc(), F.desc("created")).first()
