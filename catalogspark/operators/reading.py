"""Reading passes: their actions, what completing one counts, and what a user reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.operators import tracking

_PASS = ["user_id", "release_id"]


def pass_actions(passes: DataFrame, actions: DataFrame, releases: DataFrame) -> DataFrame:
    """(user_id, release_id, action, outcome, has_pass, percent): each action's outcome and the pass after it.

    ``passes (user_id, release_id, percent)``; ``actions (user_id, release_id, action, value)``, one at most for each
    pass and batch. Starting twice leaves the pass as it is; a percentage outside 0 to 100 or null is refused;
    refused actions change nothing.
    """
    active = releases.where("status = 'active'").select(F.col("id").alias("release_id"), F.lit(True).alias("active"))
    rows = actions.join(passes.select(*_PASS, "percent", F.lit(True).alias("had")), _PASS, "left").join(active, "release_id", "left")
    had, action = F.col("had").isNotNull(), F.col("action")
    outcome = (
        F.when(F.col("active").isNull(), "notActive")
        .when((action == "percent") & ~F.coalesce(F.col("value").between(0, 100), F.lit(False)), "badPercent")
        .when(action.isin("percent", "complete") & ~had, "noPass")
        .otherwise("ok")
    )
    rows = rows.withColumn("outcome", outcome)
    ok = F.col("outcome") == "ok"
    has = F.when(ok, action.isin("start", "percent")).otherwise(had)
    percent = F.when(ok & (action == "percent"), F.col("value")).when(has, F.col("percent"))
    return rows.select(*_PASS, "action", "outcome", has.alias("has_pass"), percent.alias("percent"))


def passes_after(passes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The table of passes after the actions of ``outcomes``, as of ``pass_actions``."""
    rest = passes.join(outcomes.select(*_PASS), _PASS, "left_anti").select(*_PASS, "percent")
    return rest.unionByName(outcomes.where("has_pass").select(*_PASS, "percent"))


def completed(outcomes: DataFrame, coverage: DataFrame) -> DataFrame:
    """(user_id, release_id, series_id, volume_id): volumes that the completed passes' releases cover completely."""
    done = outcomes.where("action = 'complete' AND outcome = 'ok'").select(*_PASS)
    return done.join(coverage.where("extent = 'complete'").select("release_id", "series_id", "volume_id").distinct(), "release_id").select(*_PASS, "series_id", "volume_id")


def count_reads(progress: DataFrame, done: DataFrame, stamp: int) -> DataFrame:
    """``progress (user_id, series_id, volume_id, reads, stamp)`` with one read more for each completed pass, under its stamp."""
    keys = ["user_id", "series_id", "volume_id"]
    more = done.groupBy(*keys).agg(F.count(F.lit(1)).alias("more"))
    rows = progress.join(more, keys, "full")
    reads = F.coalesce("reads", F.lit(0)) + F.coalesce("more", F.lit(0))
    return rows.select(*keys, reads.cast("bigint").alias("reads"), F.when(F.col("more").isNotNull(), F.lit(stamp).cast("bigint")).otherwise(F.col("stamp")).alias("stamp"))


def suggest_completed(done: DataFrame, progress: DataFrame, volumes: DataFrame, states: DataFrame) -> DataFrame:
    """(user_id, series_id) of the completed passes' series whose ``volumes`` (the active ones) all have a read, unless marked completed."""
    touched = done.select("user_id", "series_id").distinct()
    marked = states.where("reading_status = 'completed'").select("user_id", "series_id")
    own = progress.join(touched, ["user_id", "series_id"], "left_semi").join(volumes.select(F.col("id").alias("volume_id")), "volume_id", "left_semi")
    return tracking.reading_progress(own, volumes).where("all_read").select("user_id", "series_id").join(marked, ["user_id", "series_id"], "left_anti")


def restored_passes(done: DataFrame, progress: DataFrame, passes: DataFrame, stamp: int) -> DataFrame:
    """(user_id, release_id, percent): passes that come back at 100 when the completions of ``stamp`` are undone: something
    was counted under it, and no new pass has begun."""
    still = progress.where(F.col("stamp") == stamp).select("user_id", "volume_id")
    back = done.join(still, ["user_id", "volume_id"], "left_semi").select(*_PASS).distinct()
    return back.join(passes.select(*_PASS), _PASS, "left_anti").withColumn("percent", F.lit(100.0))


def my_reading(states: DataFrame, pointers: DataFrame, series: DataFrame, volumes: DataFrame, progress: DataFrame) -> DataFrame:
    """(user_id, series_id, title, reading_status, volumes_read, total_volumes): a row for each series with a status, under its survivor."""
    rows = states.where("reading_status IS NOT NULL").join(pointers.select(F.col("id").alias("series_id"), "survivor_id"), "series_id")
    rows = rows.select("user_id", F.col("survivor_id").alias("series_id"), "reading_status")
    total = volumes.groupBy("series_id").agg(F.count(F.lit(1)).alias("total_volumes"))
    read = progress.where("reads >= 1").join(volumes.select(F.col("id").alias("volume_id"), F.col("series_id").alias("of")), "volume_id")
    read = read.groupBy("user_id", F.col("of").alias("series_id")).agg(F.count(F.lit(1)).alias("volumes_read"))
    out = rows.join(series.select(F.col("id").alias("series_id"), "title"), "series_id").join(total, "series_id", "left").join(read, ["user_id", "series_id"], "left")
    n = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return out.select("user_id", "series_id", "title", "reading_status", n("volumes_read"), n("total_volumes"))
