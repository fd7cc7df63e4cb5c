"""Read models of releases: month browser, lanes, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalogspark.functions import codes, dates, titles


def release_rows(releases: DataFrame, series: DataFrame, release_series: DataFrame, coverage: DataFrame, volumes: DataFrame, publishers: DataFrame) -> DataFrame:
    """One row for each release that has an active series: its series, volume label and active publisher.

    ``releases`` should be filtered already; the joins then start from few rows.
    """
    active = series.where("status = 'active'").select(F.col("id").alias("series_id"), "title")
    keys = releases.select(F.col("id").alias("release_id"))
    named = (
        release_series.join(keys, "release_id", "left_semi")
        .join(active, "series_id")
        .groupBy("release_id")
        .agg(F.array_sort(F.collect_list(F.struct("series_id", "title"))).alias("series"))
    )
    labels = (
        coverage.join(keys, "release_id", "left_semi")
        .join(volumes.select(F.col("id").alias("volume_id"), "label"), "volume_id")
        .groupBy("release_id")
        .agg(F.array_sort(F.collect_list(F.struct("series_id", "position", "label"))).alias("rows"), F.bool_or(F.col("extent") == "partial").alias("partial"))
        .select("release_id", titles.volume_label(F.transform("rows", lambda r: r["label"]), F.col("partial")).alias("label"))
    )
    house = publishers.where("status = 'active'").select(F.col("id").alias("publisher_id"), F.col("name").alias("publisher"))
    return (
        releases.withColumnRenamed("id", "release_id")
        .join(named, "release_id")
        .join(labels, "release_id", "left")
        .join(house, "publisher_id", "left")
        .select(
            "release_id",
            "format",
            "sort",
            "day",
            dates.display("year", "month", "day").alias("date_text"),
            codes.price("price_cents").alias("price_text"),
            "publisher",
            F.col("series")[0]["series_id"].alias("first_series_id"),
            F.array_join(F.transform("series", lambda s: s["title"]), "; ").alias("series_titles"),
            F.coalesce("label", F.lit("")).alias("label"),
        )
    )


def month_window(releases: DataFrame, year: int, month: int, format: str | None = None) -> DataFrame:
    out = releases.where(F.col("status") == "active").where(dates.in_month("sort", year, month))
    return out.where(F.col("format") == format) if format else out


def by_day(rows: DataFrame, cell: int) -> DataFrame:
    """Day cells of a month: the first ``cell`` releases and how many more; day 0 holds those without a day."""
    day = F.coalesce("day", F.lit(0))
    w = Window.partitionBy(day).orderBy(titles.title_order("series_titles"), "label", "release_id")
    ranked = rows.select(day.alias("day"), "release_id", F.row_number().over(w).alias("rank"))
    return ranked.groupBy("day").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= cell, F.struct("rank", "release_id")))), lambda x: x["release_id"].cast("string")), ",").alias("shown"),
        F.greatest(F.count(F.lit(1)) - cell, F.lit(0)).cast("bigint").alias("more"),
    )


def upcoming_lane(releases: DataFrame, today: int, lane: int) -> DataFrame:
    """The next releases of each publisher."""
    w = Window.partitionBy("publisher_id").orderBy("sort", "id")
    rows = releases.where("status = 'active' AND publisher_id IS NOT NULL").where(dates.upcoming("sort", "day", today))
    return rows.select("publisher_id", F.col("id").alias("release_id"), "sort", F.row_number().over(w).alias("rank")).where(F.col("rank") <= lane)


def isbn_hits(wanted: DataFrame, releases: DataFrame, bundles: DataFrame) -> DataFrame:
    """(code, kind, id): the least release with a code, else the least bundle."""
    found = wanted.join(releases.select("code", F.lit("release").alias("kind"), F.lit(1).alias("priority"), "id"), "code")
    found = found.unionByName(wanted.join(bundles.select("code", F.lit("bundle").alias("kind"), F.lit(2).alias("priority"), "id"), "code"))
    return found.groupBy("code").agg(F.min(F.struct("priority", "id", "kind")).alias("best")).select("code", "best.kind", "best.id")


def search(entities: DataFrame, text_columns: list[str], query: str, limit: int) -> DataFrame:
    """Entities ranked by how many distinct query words their texts hold, then id; a blank query finds nothing."""
    words = sorted(set(query.lower().split()))
    if not words:
        return entities.select("id", F.lit(0).alias("score")).where(F.lit(False))
    have = F.split(titles.normalize_title(F.concat_ws(" ", *text_columns)), " ")
    score = F.size(F.array_intersect(have, F.array(*map(F.lit, words))))
    return entities.select("id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(limit)
