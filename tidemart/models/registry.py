"""Named, versioned models in one folder, with an atomic current version.

A model is written into a folder of its own; then one file appended to ``manifest`` names it. So a name means its old
version until the new one is complete, and a failed save changes nothing.
"""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart.models import anomaly, churn, forecast, segments

MANIFEST = "name string, version bigint, run string, kind string"

#: How models of a kind are written and read: ``save(model, path)``, ``load(spark, path)``.
KINDS = {
    "churn": (churn.save, lambda spark, path: churn.load(path)),
    "segments": (segments.save, lambda spark, path: segments.load(path)),
    "forest": (anomaly.save_forest, anomaly.load_forest),
    "forecast": (forecast.save, forecast.load),
}


class ModelRegistry:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _manifest(self) -> DataFrame:
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")
        except AnalysisException as e:  # nothing is saved yet
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def current(self) -> DataFrame:
        """Newest version of every name: name, version, run, kind."""
        newest = F.max(F.struct("version", "run", "kind")).alias("m")
        return self._manifest().groupBy("name").agg(newest).select("name", "m.*")

    def versions(self, name: str) -> list[int]:
        rows = self._manifest().where(F.col("name") == name).select("version").distinct().collect()
        return sorted(r.version for r in rows)

    def save(self, name: str, kind: str, model: Any) -> int:
        """Create or replace the model of a name; returns its version. Older versions stay."""
        if kind not in KINDS:
            raise KeyError(kind)
        run = uuid.uuid4().hex
        KINDS[kind][0](model, f"{self.root}/models/{run}")
        version = max(self.versions(name), default=0) + 1
        row = self.spark.createDataFrame([(name, version, run, kind)], MANIFEST)
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        return version

    def load(self, name: str, version: int | None = None) -> Any:
        """The model of a name, the newest version unless one is stated; KeyError when there is none."""
        rows = self._manifest().where(F.col("name") == name)
        if version is not None:
            rows = rows.where(F.col("version") == version)
        found = rows.orderBy(F.desc("version"), F.desc("run")).first()
        if found is None:
            raise KeyError(name if version is None else f"{name} version {version}")
        return KINDS[found.kind][1](self.spark, f"{self.root}/models/{found.run}")
