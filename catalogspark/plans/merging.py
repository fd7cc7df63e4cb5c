"""Merges, their undo and their reach."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogspark.operators import merging
from catalogspark.registry import register
from catalogspark.sources.fixture import Catalog, sql

#: A row's id is its release times this, plus its series: unique below ten billion series.
_STEP = 10_000_000_000
#: The manifest's ids are told by its SQL, and unique below 100,000 series only.
_MANIFEST_STEP = 100_000


def _marked(step: int) -> str:
    return f""", merges AS (SELECT id AS loser, min(survivor_id) AS survivor FROM survivors WHERE depth > 0 GROUP BY id),
rows AS (SELECT release_id * {step} + series_id AS id, release_id, series_id FROM release_series),
moved AS (SELECT r.id, r.release_id, coalesce(m.survivor, r.series_id) AS series_id, r.series_id AS before, m.survivor AS after FROM rows r LEFT JOIN merges m ON m.loser = r.series_id),
marked AS (SELECT *, after IS NOT NULL AND row_number() OVER (PARTITION BY release_id, series_id ORDER BY after IS NOT NULL, id) > 1 AS removed FROM moved)
"""


def _parts(spark, sf_dir, step=_STEP):
    from catalogspark.operators import lookup

    c = Catalog(spark, sf_dir)
    merges = lookup.survivors(c.series).where("depth > 0").groupBy(F.col("id").alias("loser")).agg(F.min("survivor_id").alias("survivor"))
    rows = c.release_series.withColumn("id", F.col("release_id") * step + F.col("series_id")).select("id", "release_id", "series_id")
    return c, merges, rows


@register("merge_repoint", sql("series", "survivors", "release_series") + _marked(_STEP) + "SELECT id, release_id, series_id FROM marked WHERE NOT removed")
def merge_repoint(spark, sf_dir):
    _, merges, rows = _parts(spark, sf_dir)
    return merging.repoint(rows, merges, "series_id", ["release_id", "series_id"])["rows"]


@register("merge_manifest", sql("series", "survivors", "release_series") + _marked(_MANIFEST_STEP) + "SELECT id, 'series_id' AS \"column\", before, after, removed FROM marked WHERE after IS NOT NULL")
def merge_manifest(spark, sf_dir):
    _, merges, rows = _parts(spark, sf_dir, _MANIFEST_STEP)
    return merging.repoint(rows, merges, "series_id", ["release_id", "series_id"])["manifest"]


@register("split_undo", sql("release_series") + f"SELECT release_id * {_STEP} + series_id AS id, release_id, series_id FROM release_series")
def split_undo(spark, sf_dir):
    """Merge, then undo: the table as it was."""
    _, merges, rows = _parts(spark, sf_dir)
    done = merging.repoint(rows, merges, "series_id", ["release_id", "series_id"])
    removed = rows.join(done["manifest"].where("removed").select("id"), "id", "left_semi")
    return merging.undo(done["rows"], removed, done["manifest"], "series_id")


@register(
    "merge_impact",
    sql("series", "survivors", "release_series", "volumes", "follows") + """, merges AS (SELECT DISTINCT id AS loser FROM survivors WHERE depth > 0)
    SELECT loser AS id, 'releases' AS label, count(*) AS n FROM merges JOIN release_series ON series_id = loser GROUP BY loser
    UNION ALL SELECT loser, 'volumes', count(*) FROM merges JOIN volumes ON series_id = loser GROUP BY loser
    UNION ALL SELECT loser, 'follows', count(*) FROM merges JOIN follows ON series_id = loser GROUP BY loser""",
)
def merge_impact(spark, sf_dir):
    c, merges, _ = _parts(spark, sf_dir)
    return merging.impact(merges, {"releases": (c.release_series, "series_id"), "volumes": (c.volumes, "series_id"), "follows": (c.follows, "series_id")})


@register(
    "series_merge_volumes",
    sql("series", "survivors", "volumes") + """, merges AS (SELECT id AS loser, min(survivor_id) AS survivor FROM survivors WHERE depth > 0 GROUP BY id),
    tops AS (SELECT series_id, max(position) AS top FROM volumes GROUP BY series_id),
    offsets AS (SELECT loser, survivor, coalesce(b.top, 0) + coalesce(sum(t.top) OVER (PARTITION BY survivor ORDER BY loser ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o
      FROM merges JOIN tops t ON t.series_id = loser LEFT JOIN tops b ON b.series_id = survivor)
    SELECT v.id, coalesce(survivor, v.series_id) AS series_id, CAST(v.position + coalesce(o, 0) AS BIGINT) AS position, label FROM volumes v LEFT JOIN offsets ON loser = v.series_id""",
)
def series_merge_volumes(spark, sf_dir):
    c, merges, _ = _parts(spark, sf_dir)
    return merging.append_volumes(c.volumes, merges).withColumn("position", F.col("position").cast("bigint"))


_PUBLISHER_MERGES = "merges AS (SELECT id AS loser, id - 1 AS survivor FROM publishers WHERE id % 10 = 9)"


def _publisher_merges(c):
    return c.publishers.where("id % 10 = 9").select(F.col("id").alias("loser"), (F.col("id") - 1).alias("survivor"))


@register(
    "publisher_merge_releases",
    sql("publishers", "releases") + f", {_PUBLISHER_MERGES} SELECT r.id, coalesce(survivor, publisher_id) AS publisher_id FROM releases r LEFT JOIN merges ON loser = publisher_id",
)
def publisher_merge_releases(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    return merging.repoint(c.releases.select("id", "publisher_id"), _publisher_merges(c), "publisher_id", ["id"])["rows"]


@register(
    "publisher_merge_redirects",
    sql("publishers") + f""", {_PUBLISHER_MERGES}, redirects AS (SELECT 'old-' || slug AS from_slug, id AS target_id FROM publishers WHERE id % 3 = 0)
    SELECT from_slug, coalesce(survivor, target_id) AS target_id FROM redirects LEFT JOIN merges ON loser = target_id UNION ALL SELECT slug, survivor FROM merges JOIN publishers ON id = loser""",
)
def publisher_merge_redirects(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    old = c.publishers.where("id % 3 = 0").select(F.concat(F.lit("old-"), "slug").alias("from_slug"), F.col("id").alias("target_id"))
    return merging.slug_redirects(old, _publisher_merges(c), c.publishers)
