"""Users' rows: what they own and how, read counts, and removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.operators.tracking import through_bundles


def set_read_counts(progress: DataFrame, changes: DataFrame, now: int) -> DataFrame:
    """``progress (user_id, volume_id, reads, stamp)`` after ``changes (user_id, volume_id, reads)``, one at most for each: zero removes, only an increase is stamped, a count below zero changes nothing."""
    keys = ["user_id", "volume_id"]
    rows = progress.join(changes.where("reads >= 0").select(*keys, F.col("reads").alias("to")), keys, "full_outer")
    more = F.col("to") > F.coalesce("reads", F.lit(0))
    rows = rows.select(*keys, F.coalesce("to", "reads").alias("reads"), F.when(more, F.lit(now)).otherwise(F.col("stamp")).alias("stamp"))
    return rows.where("reads > 0")


def volume_ownership(entries: DataFrame, bundle_entries: DataFrame, members: DataFrame, coverage: DataFrame) -> DataFrame:
    """(user_id, volume_id, release_id, extent, bundle_id): a row for each way in which a user owns a release that covers a volume; bundle_id is null for the release itself."""
    covered = coverage.select("release_id", "volume_id", "extent")
    direct = entries.where("state = 'owned'").select("user_id", "release_id", F.lit(None).cast("bigint").alias("bundle_id")).join(covered, "release_id")
    # what a bundle covers is joined before its owners, so that no owner's row is shuffled again
    brings = members.select("bundle_id", "release_id").distinct().join(covered, "release_id")
    through = through_bundles(bundle_entries.where("state = 'owned'"), brings).withColumn("bundle_id", F.col("bundle_id").cast("bigint"))
    cols = ["user_id", "volume_id", "release_id", "extent", "bundle_id"]
    return direct.select(*cols).unionByName(through.select(*cols))


def collection(entries: DataFrame, bundle_entries: DataFrame, releases: DataFrame, bundles: DataFrame, members: DataFrame) -> DataFrame:
    """(user_id, kind, id, state, title, members): all entries of users, releases and bundles; an owned bundle names how many members it brings."""
    size = members.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("members"))
    r = entries.join(releases.where("status = 'active'").select(F.col("id").alias("release_id"), "title"), "release_id")
    r = r.select("user_id", F.lit("release").alias("kind"), F.col("release_id").cast("bigint").alias("id"), "state", "title")
    b = bundle_entries.join(bundles.where("status = 'active'").select(F.col("id").alias("bundle_id"), F.col("name").alias("title")), "bundle_id").join(size, "bundle_id", "left")
    b = b.select("user_id", F.lit("bundle").alias("kind"), F.col("bundle_id").cast("bigint").alias("id"), "state", "title", F.when(F.col("state") == "owned", F.col("members")).alias("members"))
    return r.unionByName(b, allowMissingColumns=True)


def without_users(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of users that aren't removed."""
    return rows.join(gone.select("user_id").distinct(), "user_id", "left_anti")


def close_runs(runs: DataFrame, finished: DataFrame, most: int = 50) -> DataFrame:
    """``runs (id, status)`` after ``finished (id, status, errors)``: only what is still running is closed, with its first errors."""
    rows = runs.join(finished.select("id", F.col("status").alias("to"), "errors"), "id", "left")
    closes = (F.col("status") == "running") & F.col("to").isNotNull()
    return rows.select("id", F.when(closes, F.col("to")).otherwise(F.col("status")).alias("status"), F.when(closes, F.slice("errors", 1, most)).alias("errors"))


def covers(records: DataFrame, offered: DataFrame, replaces: bool) -> DataFrame:
    """``records (id, cover_url)`` after ``offered (id, url)``: a missing cover is set; another one is replaced only where ``replaces``."""
    rows = records.join(offered, "id", "left")
    new = F.coalesce("url", "cover_url") if replaces else F.coalesce("cover_url", "url")
    return rows.select("id", new.alias("cover_url"), (~new.eqNullSafe(F.col("cover_url"))).alias("changed"))


def unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with one row for each key; the job fails where a key has more."""
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.first(F.struct(*[c for c in rows.columns])).alias("row"))
    told = F.when(F.col("n") > 1, F.raise_error(F.lit("not unique"))).otherwise(F.col("row"))
    return n.select(told.alias("row")).select("row.*")


def latest_open_manifest(manifests: DataFrame) -> DataFrame:
    """(record_id, id): the latest manifest of ``manifests (id, record_id, reversed_by)`` that wasn't reversed."""
    return manifests.where("reversed_by IS NULL").groupBy("record_id").agg(F.max("id").alias("id"))
