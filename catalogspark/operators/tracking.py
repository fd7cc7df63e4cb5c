"""Per-user views: what is owned, read, coming and visible."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.functions import dates


#: A bundle's owners meet its members in this many parts.
PARTS = 64


def through_bundles(owned_bundles: DataFrame, members: DataFrame) -> DataFrame:
    """``members (bundle_id, ...)`` for each user of ``owned_bundles (user_id, bundle_id)``; a pair that is there twice counts once.

    The result has a row for each owner and member of a bundle and is never shuffled. Few bundles may have all owners, so a bundle's owners are dealt to parts, each with its members.
    """
    spark = owned_bundles.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    owners = owned_bundles.select("user_id", "bundle_id").distinct().withColumn("_part", F.pmod(F.xxhash64("user_id"), F.lit(PARTS)).cast("int"))
    rows = members.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return owners.repartition(n, "bundle_id", "_part").join(rows.repartition(n, "bundle_id", "_part"), ["bundle_id", "_part"]).drop("_part")


def derived_ownership(owned_bundles: DataFrame, members: DataFrame) -> DataFrame:
    """(user_id, release_id, bundle_id): releases owned through an owned bundle, once for each bundle."""
    return through_bundles(owned_bundles, members.select("bundle_id", "release_id").distinct()).select("user_id", "release_id", "bundle_id")


def upcoming_for(follows: DataFrame, entries: DataFrame, releases: DataFrame, release_series: DataFrame, users: DataFrame, today: int) -> DataFrame:
    """(user_id, release_id, sort): what a user follows in the preferred format, or wants or has ordered, and
    that is still to come, without what is owned.

    Releases are filtered by date before any join, so users meet only the few that are still to come.
    """
    coming = releases.where((F.col("status") == "active") & dates.upcoming(F.col("sort"), F.col("day"), today)).select(F.col("id").alias("release_id"), "format", "sort")
    by_series = coming.join(release_series, "release_id")
    pref = users.select(F.col("id").alias("user_id"), "preference")
    followed = follows.join(by_series, "series_id").join(pref, "user_id").where("preference = 'both' OR preference = format").select("user_id", "release_id", "sort")
    wanted = entries.where("state IN ('wanted', 'ordered')").join(coming, "release_id").select("user_id", "release_id", "sort")
    owned = entries.where("state = 'owned'").select("user_id", "release_id")
    return followed.unionByName(wanted).distinct().join(owned, ["user_id", "release_id"], "left_anti")


def completed_volumes(entries: DataFrame, coverage: DataFrame) -> DataFrame:
    """(user_id, series_id, volume_id, reads): volumes that a user's owned releases cover completely."""
    owned = entries.where("state = 'owned'").select("user_id", "release_id")
    return owned.join(coverage.where("extent = 'complete'"), "release_id").groupBy("user_id", "series_id", "volume_id").agg(F.count(F.lit(1)).alias("reads"))


def reading_progress(reads: DataFrame, volumes: DataFrame) -> DataFrame:
    """(user_id, series_id, n_read, n_volumes, all_read) for each series that a user has read of."""
    total = volumes.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_volumes"))
    some = reads.groupBy("user_id", "series_id").agg(F.count_if(F.col("reads") >= 1).alias("n_read"))
    return some.join(total, "series_id").select("user_id", "series_id", "n_read", "n_volumes", (F.col("n_read") >= F.col("n_volumes")).alias("all_read"))


def undo_reads(reads: DataFrame, stamp) -> DataFrame:
    """``reads (..., reads, stamp)`` after one completion with this stamp is taken back; none left: no row."""
    hit = F.col("stamp").eqNullSafe(stamp)
    out = reads.withColumn("reads", F.when(hit, F.col("reads") - 1).otherwise(F.col("reads")))
    return out.withColumn("stamp", F.when(hit, None).otherwise(F.col("stamp"))).where("reads > 0")


def keyed_upsert(state: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``state`` with the rows of ``changes``; a change whose other columns are all null deletes its key."""
    rest = [c for c in state.columns if c not in keys]
    live = changes.where(F.coalesce(*[F.col(c).isNotNull().cast("int").alias(c) for c in rest]).isNotNull() & F.greatest(*[F.col(c).isNotNull() for c in rest], F.lit(False)))
    return state.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(live.select(*state.columns))


def visible_entries(entries: DataFrame, users: DataFrame, overrides: DataFrame, release_series: DataFrame) -> DataFrame:
    """(user_id, release_id): owned entries that others may see. A series' own setting comes before the user's; one
    private series hides a release, and what is only wanted or ordered is never shown."""
    owned = entries.where("state = 'owned'").select("user_id", "release_id")
    default = users.select(F.col("id").alias("user_id"), (F.col("visibility") == "public").alias("shown"))
    seen = owned.join(release_series, "release_id", "left").join(overrides, ["user_id", "series_id"], "left").join(default, "user_id")
    shown = F.coalesce(F.col("visibility") == "public", F.col("shown"))
    return seen.groupBy("user_id", "release_id").agg(F.bool_and(shown).alias("ok")).where("ok").select("user_id", "release_id")


def follow_suggestions(entries: DataFrame, release_series: DataFrame, follows: DataFrame) -> DataFrame:
    """(user_id, series_id): series of which a user owns something and that the user doesn't follow."""
    owned = entries.where("state = 'owned'").select("user_id", "release_id")
    return owned.join(release_series, "release_id").select("user_id", "series_id").distinct().join(follows, ["user_id", "series_id"], "left_anti")


def followed(states: DataFrame, pointers: DataFrame) -> DataFrame:
    """(user_id, series_id): the active series that users follow, each once, merged ones by their survivors. ``states (user_id, series_id, following)``, ``pointers`` of ``lookup.survivors``."""
    on = states.where("following").join(pointers.select(F.col("id").alias("series_id"), "survivor_id"), "series_id")
    return on.select("user_id", F.col("survivor_id").alias("series_id")).distinct()


def set_preferences(users: DataFrame, commands: DataFrame) -> DataFrame:
    """``users (id, preference)`` after ``commands (user_id, seq, preference)``: the last one of a user that names physical, digital or both."""
    last = commands.where("preference IN ('physical', 'digital', 'both')").groupBy(F.col("user_id").alias("id")).agg(F.max_by("preference", "seq").alias("to"))
    return users.join(last, "id", "left").select("id", F.coalesce("to", "preference").alias("preference"))
