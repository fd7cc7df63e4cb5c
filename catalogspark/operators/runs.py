"""Import runs and their health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Hours after which a source is due again.
CADENCE_HOURS = {"daily": 22, "weekly": 156, "monthly": 648}


def streaks(runs: DataFrame) -> DataFrame:
    """Each run with its count of failures in a row so far; a success sets it to 0."""
    w = Window.partitionBy("source_key").orderBy("started_at", "id")
    ok = (F.col("status") == "succeeded").cast("int")
    rows = runs.withColumn("island", F.sum(ok).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    in_island = Window.partitionBy("source_key", "island").orderBy("started_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("streak", F.sum(1 - ok).over(in_island)).drop("island")


def transitions(runs: DataFrame, limit: int = 3) -> DataFrame:
    """Runs at which a source turns unhealthy (``limit`` failures in a row) or healthy again."""
    w = Window.partitionBy("source_key").orderBy("started_at", "id")
    rows = streaks(runs).withColumn("unhealthy", F.col("streak") >= limit)
    before = F.coalesce(F.lag("unhealthy").over(w), F.lit(False))
    rows = rows.withColumn("before", before).where("unhealthy <> before")
    return rows.select("source_key", "id", F.when(F.col("unhealthy"), "unhealthy").otherwise("healthy").alias("turned"), "streak")


def due(sources: DataFrame, now) -> DataFrame:
    """Enabled sources to be run: never run, or last run not running and as long ago as their cadence says."""
    hours = F.try_element_at(F.create_map(*[F.lit(x) for kv in CADENCE_HOURS.items() for x in kv]), F.col("cadence"))
    waited = (F.unix_seconds(now) - F.unix_seconds("last_started")) / 3600
    ready = F.col("last_started").isNull() | ((F.col("last_status") != "running") & F.coalesce(waited >= hours, F.lit(False)))
    return sources.where("enabled").where(ready & hours.isNotNull())
