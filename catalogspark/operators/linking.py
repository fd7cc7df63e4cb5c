"""Linking a source's entries: stored links first, then one series of an equal title, then one release of a volume within that series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.functions import titles
from catalogspark.operators import matching, tables
from catalogspark.operators.nested import Shelf


def series_of(entries: DataFrame, series: DataFrame) -> DataFrame:
    """(entry_id, how, series_id) of ``entries (entry_id, title, linked_id)`` against ``series (id, title, alt_title, status)``.

    A stored link decides alone: stored, or gone where its series isn't active. Else the active series of an equal title or alternative decide:
    title for exactly one, ambiguous for more, none for none or a blank title. Titles are counted by key before entries meet them.
    """
    c = F.col
    live = series.where("status = 'active'")
    keys = matching.title_keys(live).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("found_id"))
    linked = live.select(c("id").cast("string").alias("at"), F.lit(True).alias("open"))
    rows = entries.select("entry_id", "linked_id", titles.normalize_title("title").alias("key")).withColumn("at", tables.or_alone("linked_id", "entry_id"))
    rows = rows.withColumn("key", tables.or_alone(F.nullif("key", F.lit("")), "entry_id")).join(linked, "at", "left").join(keys, "key", "left")
    free, n = c("linked_id").isNull(), F.coalesce("n", F.lit(0))
    how = F.when(c("open"), "stored").when(~free, "gone").when(n == 1, "title").when(n > 1, "ambiguous").otherwise("none")
    return rows.select("entry_id", how.alias("how"), F.when(how == "stored", c("linked_id")).when(how == "title", c("found_id")).alias("series_id"))


def in_series(facts: DataFrame, shelf: Shelf, locked: DataFrame) -> DataFrame:
    """(fact_id, kind, release_id) of ``facts (fact_id, series_id, label, format)`` within their series: one, many or none.

    Candidates are active, unlocked releases of the format, of active editions that cover one volume alone, an active one of an equal label;
    no label is equal to none. ``locked (id)`` names releases. Candidates are counted by series, label and format before facts meet them.
    """
    c = F.col
    live = lambda df: df.where("status = 'active'")
    single = shelf.coverage.groupBy("edition_id").agg(F.count(F.lit(1)).alias("n"), F.min("volume_id").alias("volume_id")).where("n = 1").select("edition_id", "volume_id")
    label = lambda df: df.withColumn("none", c("label").isNull()).withColumn("label_key", F.coalesce(titles.label_key("label"), F.lit("")))
    volumes = label(live(shelf.volumes).select(c("id").alias("volume_id"), "series_id", "label"))
    rows = live(shelf.releases).join(locked.select("id"), "id", "left_anti").select(c("id").alias("release_id"), "edition_id", "format")
    rows = rows.join(live(shelf.editions).select(c("id").alias("edition_id")), "edition_id").join(single, "edition_id").join(volumes, "volume_id")
    at = ["series_id", "none", "label_key", "format"]
    known = rows.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.min("release_id").alias("release_id"))
    told = label(facts.select("fact_id", "series_id", "label", "format")).join(known, at, "left")
    n = F.coalesce("n", F.lit(0))
    return told.select("fact_id", F.when(n == 0, "none").when(n == 1, "one").otherwise("many").alias("kind"), F.when(n == 1, c("release_id")).alias("release_id"))


def releases_of(facts: DataFrame, entries: DataFrame, shelf: Shelf, locked: DataFrame) -> DataFrame:
    """(fact_id, how, kind, release_id) of ``facts (fact_id, entry_id, label, format, multi, linked_id)`` of ``entries``.

    ``how`` is the entry's series, as ``series_of`` says. A fact's own stored link decides alone: stored, or held where its release isn't active or is locked; this and the search need the entry's series. Facts of several volumes or
    a packaging (``multi``) are skipped; the rest is looked for within the series. A fact of an entry without a series is unlinked.
    """
    c = F.col
    of = series_of(entries, shelf.series)
    rows = facts.join(of, "entry_id")
    live = shelf.releases.where("status = 'active'").join(locked.select("id"), "id", "left_anti").select(c("id").cast("string").alias("at"), F.lit(True).alias("open"))
    found = in_series(rows.where("series_id IS NOT NULL AND linked_id IS NULL AND NOT multi"), shelf, locked).select("fact_id", c("kind").alias("search"), c("release_id").alias("found_id"))
    rows = rows.withColumn("at", tables.or_alone("linked_id", "fact_id")).join(live, "at", "left").join(found, "fact_id", "left")
    kind = F.when(c("series_id").isNull(), "unlinked").when(c("open"), "stored").when(c("linked_id").isNotNull(), "held").when(c("multi"), "skipped").otherwise(c("search"))
    return rows.select("fact_id", "how", kind.alias("kind"), F.when(kind == "stored", c("linked_id")).when(kind == "one", c("found_id")).alias("release_id"))
