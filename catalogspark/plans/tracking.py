"""Users' collections, reading, upcoming releases and visibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogspark.operators import tracking
from catalogspark.registry import register
from catalogspark.sources.fixture import Catalog, sql

TODAY = 20010615
_COMING = f"status = 'active' AND sort >= {TODAY // 100 * 100} AND (sort >= {TODAY} OR day IS NULL)"
_OVERRIDES = "overrides AS (SELECT user_id, series_id, CASE WHEN (user_id + series_id) % 2 = 0 THEN 'public' ELSE 'private' END AS visibility FROM follows WHERE (user_id + series_id) % 5 = 0)"


@register(
    "my_upcoming",
    sql("users", "follows", "entries", "releases", "release_series") + f""", coming AS (SELECT id AS release_id, format, sort FROM releases WHERE {_COMING}),
    every AS (SELECT f.user_id, c.release_id, c.sort FROM follows f JOIN release_series s USING (series_id) JOIN coming c USING (release_id) JOIN users u ON u.id = f.user_id WHERE u.preference IN ('both', c.format)
      UNION SELECT user_id, release_id, sort FROM entries JOIN coming USING (release_id) WHERE state IN ('wanted', 'ordered'))
    SELECT * FROM every e WHERE NOT EXISTS (SELECT 1 FROM entries o WHERE o.user_id = e.user_id AND o.release_id = e.release_id AND o.state = 'owned')""",
)
def my_upcoming(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    return tracking.upcoming_for(c.follows, c.entries, c.releases, c.release_series, c.users, TODAY)


_BUNDLES = "owned_bundles AS (SELECT id AS user_id, c_nationkey AS bundle_id FROM (SELECT c_custkey AS id, c_nationkey, c_acctbal FROM customer) WHERE c_acctbal > 5000)"


@register(
    "derived_ownership",
    sql("bundle_members") + f", {_BUNDLES} SELECT DISTINCT user_id, release_id, bundle_id FROM owned_bundles JOIN bundle_members USING (bundle_id)",
)
def derived_ownership(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    owned = c.raw("customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("bundle_id"))
    return tracking.derived_ownership(owned, c.bundle_members)


_READS = "reads AS (SELECT user_id, series_id, volume_id, count(*) AS reads FROM entries JOIN coverage USING (release_id) WHERE state = 'owned' AND extent = 'complete' GROUP BY ALL)"


@register("completed_volumes", sql("entries", "coverage") + f", {_READS} SELECT * FROM reads")
def completed_volumes(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    return tracking.completed_volumes(c.entries, c.coverage)


@register(
    "reading_progress",
    sql("entries", "coverage", "volumes") + f""", {_READS} SELECT user_id, series_id, count(*) AS n_read, any_value(n) AS n_volumes, count(*) >= any_value(n) AS all_read
    FROM reads JOIN (SELECT series_id, count(*) AS n FROM volumes GROUP BY series_id) USING (series_id) GROUP BY user_id, series_id""",
)
def reading_progress(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    return tracking.reading_progress(tracking.completed_volumes(c.entries, c.coverage), c.volumes)


@register(
    "undo_completion",
    sql("entries", "coverage") + f""", {_READS}, stamped AS (SELECT *, volume_id % 7 AS stamp FROM reads)
    SELECT user_id, series_id, volume_id, CASE WHEN stamp = 3 THEN reads - 1 ELSE reads END AS reads, CASE WHEN stamp <> 3 THEN stamp END AS stamp FROM stamped WHERE stamp <> 3 OR reads > 1""",
)
def undo_completion(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    reads = tracking.completed_volumes(c.entries, c.coverage).withColumn("stamp", F.col("volume_id") % 7)
    return tracking.undo_reads(reads, F.lit(3))


@register(
    "collection_entry_upsert",
    sql("entries") + """, changes AS (SELECT user_id, release_id, CASE release_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'owned' ELSE 'wanted' END AS state FROM entries WHERE release_id % 5 = 0)
    SELECT * FROM entries e WHERE NOT EXISTS (SELECT 1 FROM changes c WHERE c.user_id = e.user_id AND c.release_id = e.release_id) UNION ALL SELECT * FROM changes WHERE state IS NOT NULL""",
)
def collection_entry_upsert(spark, sf_dir):
    e = Catalog(spark, sf_dir).entries
    n = F.col("release_id") % 4
    changes = e.where("release_id % 5 = 0").withColumn("state", F.when(n == 1, "owned").when(n != 0, "wanted"))
    return tracking.keyed_upsert(e, changes, ["user_id", "release_id"])


@register(
    "public_profile_entries",
    sql("entries", "users", "follows", "release_series") + f""", {_OVERRIDES} SELECT e.user_id, e.release_id FROM entries e LEFT JOIN release_series s USING (release_id) LEFT JOIN overrides o ON o.user_id = e.user_id AND o.series_id = s.series_id
    JOIN users u ON u.id = e.user_id WHERE e.state = 'owned' GROUP BY ALL HAVING bool_and(coalesce(o.visibility, u.visibility) = 'public')""",
)
def public_profile_entries(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    key = F.col("user_id") + F.col("series_id")
    overrides = c.follows.where(key % 5 == 0).withColumn("visibility", F.when(key % 2 == 0, "public").otherwise("private"))
    return tracking.visible_entries(c.entries, c.users, overrides, c.release_series)


@register(
    "follow_suggestions",
    sql("entries", "follows", "release_series") + """SELECT DISTINCT e.user_id, s.series_id FROM entries e JOIN release_series s USING (release_id) WHERE state = 'owned'
    AND NOT EXISTS (SELECT 1 FROM follows f WHERE f.user_id = e.user_id AND f.series_id = s.series_id)""",
)
def follow_suggestions(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    return tracking.follow_suggestions(c.entries, c.release_series, c.follows)


@register(
    "followed_series",
    sql("series", "survivors", "follows") + "SELECT DISTINCT user_id, survivor_id AS series_id FROM follows JOIN survivors ON id = series_id WHERE user_id % 5 <> 0",
)
def followed_series(spark, sf_dir):
    from catalogspark.operators import lookup

    c = Catalog(spark, sf_dir)
    return tracking.followed(c.follows.withColumn("following", F.col("user_id") % 5 != 0), lookup.survivors(c.series))


@register(
    "preferences_set",
    sql("users") + """, last AS (SELECT user_id, arg_max(kind, event_id) AS kind FROM (SELECT user_id, event_id, ['physical', 'digital', 'both', 'paper'][CAST(event_id % 4 AS INTEGER) + 1] AS kind FROM events) WHERE kind <> 'paper' GROUP BY user_id)
    SELECT id, coalesce(kind, preference) AS preference FROM users LEFT JOIN last ON user_id = id""",
)
def preferences_set(spark, sf_dir):
    c, k = Catalog(spark, sf_dir), F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ["physical", "digital", "both", "paper"])), (k % 4 + 1).cast("int"))
    return tracking.set_preferences(c.users.select("id", "preference"), c.raw("events").select("user_id", k.alias("seq"), kind.alias("preference")))
