"""Whole pages as one row each: series with volumes, editions and releases; volumes; editions; bundles.

Children are grouped level by level, releases into editions, editions into volumes, volumes into series, so each level is one
shuffle on its parent's key and no row is looked up alone. A page is one row of nested arrays, as large as what it shows. Hidden
records are absent from every level; ``requested`` follows merged ids to the page of their survivor.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.functions import titles
from catalogspark.operators import lookup

#: Behind every date.
_LAST = 99_999_999


@dataclass
class Shelf:
    """Tables of a catalog; every record has ``id`` and ``status``, those that can be merged ``merged_into``.

    ``series`` (title, family_id), ``volumes`` (series_id, position, label), ``editions`` (publisher_id, line_id, line_position), ``lines`` (name),
    ``releases`` (edition_id, format, isbn13, isbn10, sort, price_cents, cover), ``variants`` (release_id, name), ``publishers`` (name, slug), ``bundles`` (name);
    ``coverage`` (edition_id, volume_id, place, extent), ``members`` (bundle_id, release_id, position, variant_id), ``families`` (name),
    ``relations`` (id, kind, note, from_id, to_id).
    """

    series: DataFrame
    volumes: DataFrame
    editions: DataFrame
    lines: DataFrame
    releases: DataFrame
    variants: DataFrame
    publishers: DataFrame
    bundles: DataFrame
    coverage: DataFrame
    members: DataFrame
    families: DataFrame
    relations: DataFrame


def _live(df: DataFrame) -> DataFrame:
    return df.where("status = 'active'")


def _listed(rows: DataFrame, key: str, out: str, order: list, item: Column, *more: Column) -> DataFrame:
    """(key, out, more): each key's items in a total order."""
    entries = F.sort_array(F.collect_list(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], item.alias("item"))))
    return rows.groupBy(key).agg(F.transform(entries, lambda x: x["item"]).alias(out), *more)


def _or_none(df: DataFrame, column: str) -> Column:
    """An empty array where a left join found no children."""
    return F.coalesce(column, F.array().cast(df.schema[column].dataType)).alias(column)


def _variants_and_bundles(shelf: Shelf) -> DataFrame:
    """Active releases with their active variants and the active bundles that contain them, by id."""
    variants = _listed(_live(shelf.variants), "release_id", "variants", [F.col("id")], F.struct("name"))
    bundles = shelf.members.join(_live(shelf.bundles).select(F.col("id").alias("bundle_id"), "name"), "bundle_id")
    bundles = _listed(bundles, "release_id", "bundles", [F.col("bundle_id"), F.col("position")], F.struct(F.col("bundle_id").alias("id"), "name"))
    rows = _live(shelf.releases).join(variants.withColumnRenamed("release_id", "id"), "id", "left").join(bundles.withColumnRenamed("release_id", "id"), "id", "left")
    keep = [c for c in rows.columns if c not in ("variants", "bundles")]
    return rows.select(*keep, _or_none(rows, "variants"), _or_none(rows, "bundles"))


def _edition_releases(shelf: Shelf) -> DataFrame:
    """(edition_id, releases, covers): active releases by date and id, undated ones last; ``covers`` are (date key, release, cover) of those with a cover. Pages give them anchors (``_anchored``)."""
    rows = _variants_and_bundles(shelf)
    item = F.struct("id", "format", "isbn13", "isbn10", "sort", "price_cents", "variants", "bundles")
    day = F.coalesce(F.col("sort").cast("bigint"), F.lit(_LAST).cast("bigint"))
    cover = F.collect_list(F.when(F.col("cover").isNotNull(), F.struct(day.alias("day"), F.col("id").alias("release"), "cover")))
    return _listed(rows, "edition_id", "releases", [day, F.col("id")], item, F.sort_array(cover).alias("covers"))


def _anchored(releases: Column) -> Column:
    """``releases`` of an edition as a page shows them: an anchor is told from the codes and the id, so none is shuffled."""
    anchor = lambda x: F.coalesce(x["isbn13"], x["isbn10"], x["id"].cast("string")).alias("anchor")
    rest = ["format", "isbn13", "isbn10", "sort", "price_cents", "variants", "bundles"]
    return F.transform(releases, lambda x: F.struct(x["id"].alias("id"), anchor(x), *[x[n].alias(n) for n in rest])).alias("releases")


def _covers(shelf: Shelf, shown: bool = True) -> DataFrame:
    """(id, every) of every edition: the active volumes that it covers in their order, with ``live`` where their series is active and, with ``shown``, that series' title."""
    volumes = _live(shelf.volumes).select(F.col("id").alias("volume_id"), "series_id", "position", "label")
    live = F.col("status") == "active"
    series = shelf.series.select(F.col("id").alias("series_id"), live.alias("live"), *([F.when(live, F.col("title")).alias("series_title")] if shown else []))
    rows = shelf.coverage.join(volumes, "volume_id").join(series, "series_id", "left").withColumn("live", F.coalesce("live", F.lit(False)))
    # one struct of what is known; lists that pages show are made of it where they are needed
    item = F.struct("volume_id", "position", "label", "extent", "series_id", "live", *(["series_title"] if shown else []))
    return _listed(rows, "edition_id", "every", [F.col("place"), F.col("volume_id")], item).withColumnRenamed("edition_id", "id")


def _titled(editions: DataFrame, shelf: Shelf) -> DataFrame:
    """``editions`` with ``line_name``, ``every``, ``coverage`` (active volumes of active series) and ``title``."""
    rows = _with_lines(editions, shelf).join(_covers(shelf), "id", "left")
    rows = rows.select(*editions.columns, "line_name", _or_none(rows, "every"))
    rows = rows.withColumn("coverage", _shown(F.col("every")))
    return rows.withColumn("title", _title(F.col("line_name"), F.col("line_position"), F.col("coverage")))


def _shown(every: Column) -> Column:
    """Coverage as pages of editions and volumes list it: active volumes of active series with their titles."""
    entry = lambda x: F.struct(
        x["volume_id"].alias("volume_id"), x["position"].alias("position"), x["label"].alias("label"), titles.volume_title(x["series_title"], x["label"]).alias("title"), x["extent"].alias("extent"),
        F.struct(x["series_id"].alias("id"), x["series_title"].alias("title")).alias("series"),
    )
    return F.transform(F.filter(every, lambda x: x["series_title"].isNotNull()), entry)


def _title(line_name: Column, line_position: Column, coverage: Column) -> Column:
    return titles.edition_title(F.get(coverage, F.lit(0))["series"]["title"], line_name, line_position, coverage)


def _with_lines(editions: DataFrame, shelf: Shelf) -> DataFrame:
    lines = _live(shelf.lines).select(F.col("id").alias("line_id"), F.col("name").alias("line_name"))
    return editions.join(lines, "line_id", "left").select(*editions.columns, "line_name")


def edition_titles(shelf: Shelf) -> DataFrame:
    """(id, status, title) of every edition, whatever its status."""
    return _titled(shelf.editions.select("id", "status", "line_id", "line_position"), shelf).select("id", "status", "title")


def editions_whole(shelf: Shelf, shown: bool = True) -> DataFrame:
    """Active editions (id, title, publisher, any_publisher, line_name, line_position, coverage, every, releases, covers).

    ``coverage`` holds active volumes of active series in their order, ``every`` active volumes of any series; ``publisher`` is null unless active, ``any_publisher`` isn't. Without ``shown`` there is no ``title`` and ``coverage``, and
    no series' title is read. Publishers and lines are joined to the narrow editions; lists then meet them under the edition's id alone.
    """
    who = F.struct("name", "slug")
    publishers = shelf.publishers.select(F.col("id").alias("publisher_id"), who.alias("any_publisher"), F.when(F.col("status") == "active", who).alias("publisher"))
    editions = _live(shelf.editions).select("id", "publisher_id", "line_id", "line_position").join(publishers, "publisher_id", "left").drop("publisher_id")
    rows = _titled(editions, shelf) if shown else _with_lines(editions, shelf).join(_covers(shelf, False), "id", "left")
    rows = rows.join(_edition_releases(shelf).withColumnRenamed("edition_id", "id"), "id", "left")
    return rows.select("id", "publisher", "any_publisher", "line_name", "line_position", *(["title", "coverage"] if shown else []), *[_or_none(rows, x) for x in ("every", "releases", "covers")])


def edition_pages(shelf: Shelf) -> DataFrame:
    """(id, title, publisher, line_name, line_position, series, coverage, releases, cover): a row an active edition; its series as they are first met."""
    series = F.array_distinct(F.transform("coverage", lambda x: x["series"]))
    cover = F.get("covers", F.lit(0))["cover"]
    return editions_whole(shelf).select("id", "title", "publisher", "line_name", "line_position", series.alias("series"), "coverage", _anchored(F.col("releases")), cover.alias("cover"))


def _widened(shelf: Shelf, shown: bool = True) -> DataFrame:
    """Active editions, as ``editions_whole`` has them, with each active volume of an active series that they cover (volume_id, series_id, position, label, extent).

    A whole edition travels once for each such volume, and its volumes come from its own list. Callers deal the rows by
    the page's key, in one shuffle, and group by it or within it where they are then.
    """
    rows = editions_whole(shelf, shown).withColumnRenamed("id", "edition_id").withColumn("at", F.explode(F.filter("every", lambda x: x["live"])))
    return rows.select("*", *[F.col("at")[x].alias(x) for x in ("volume_id", "series_id", "position", "label", "extent")]).drop("at")


def _by_edition(entries: Column, titled: bool) -> Column:
    """(edition_id, item) entries as pages list them, with what was not shuffled: anchors of releases and, if ``titled``, titles of the edition and its volumes."""
    def shown(x: Column) -> Column:
        item = x["item"]
        line, place = item["line_name"], item["line_position"]
        if not titled:
            return F.struct(x["edition_id"].alias("id"), item["publisher"].alias("publisher"), line.alias("line_name"), place.alias("line_position"), item["extent"].alias("extent"), item["coverage"].alias("coverage"), _anchored(item["releases"]))
        coverage = _shown(item["coverage"])
        return F.struct(x["edition_id"].alias("id"), _title(line, place, coverage).alias("title"), item["publisher"].alias("publisher"), line.alias("line_name"), place.alias("line_position"), item["extent"].alias("extent"), coverage.alias("coverage"), _anchored(item["releases"]))

    return F.transform(entries, shown)


#: What a volume's or series' page shows of an edition, as it is shuffled.
_ITEM = ["publisher", "line_name", "line_position", "extent", "coverage", "releases"]


def volume_pages(shelf: Shelf) -> DataFrame:
    """(id, position, label, title, series, editions, cover): a row an active volume of an active series, with each covering edition by id and its extent there."""
    series = _live(shelf.series).select(F.col("id").alias("series_id"), F.col("title").alias("series_title"))
    volumes = _live(shelf.volumes).select("id", "series_id", "position", "label").join(series, "series_id")
    best = F.min(F.when(F.col("front").isNotNull(), F.struct("edition_id", "front"))).alias("best")
    open_ = F.filter("every", lambda x: x["live"]).alias("coverage")
    rows = _widened(shelf).drop("coverage").select("volume_id", "edition_id", *[open_ if x == "coverage" else x for x in _ITEM], F.get("covers", F.lit(0))["cover"].alias("front")).repartition("volume_id")
    entries = F.sort_array(F.collect_list(F.struct("edition_id", F.struct(*_ITEM).alias("item"))))
    editions = rows.groupBy("volume_id").agg(_by_edition(entries, True).alias("editions"), best)
    rows = _beside(volumes, editions.withColumnRenamed("volume_id", "id"))
    about = F.struct(F.col("series_id").alias("id"), F.col("series_title").alias("title")).alias("series")
    return rows.select("id", "position", "label", titles.volume_title("series_title", "label").alias("title"), about, _or_none(rows, "editions"), F.col("best.front").alias("cover"))


def _beside(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """``rows`` with their wide ``lists``, null where there are none: the narrow rows are hashed, so that wide ones are neither sorted nor held."""
    return lists.join(rows.hint("shuffle_hash"), "id", "right")


def families(shelf: Shelf) -> DataFrame:
    """(id, family) of active series in an active family of two or more active ones: its name, its members by id and the series' own relations to members, outgoing first."""
    members = _live(shelf.series).where("family_id IS NOT NULL").select("id", "title", "family_id")
    named = _live(shelf.families).select(F.col("id").alias("family_id"), F.col("name").alias("family_name"))
    groups = _listed(members, "family_id", "members", [F.col("id")], F.struct("id", "title")).where(F.size("members") > 1).join(named, "family_id")
    end = lambda side: members.select(F.col("id").alias(f"{side}_id"), F.col("family_id").alias(f"{side}_family"), F.struct("id", "title").alias(side))
    edges = shelf.relations.join(end("from"), "from_id").join(end("to"), "to_id").where("from_family = to_family")
    item = F.struct("kind", "note", "from", "to")
    out = edges.select(F.col("from_id").alias("of"), F.lit(0).alias("way"), "id", item.alias("item"))
    back = edges.select(F.col("to_id").alias("of"), F.lit(1).alias("way"), "id", item.alias("item"))
    related = _listed(out.unionByName(back), "of", "relations", [F.col("way"), F.col("id")], F.col("item")).withColumnRenamed("of", "id")
    rows = members.join(groups, "family_id").join(related, "id", "left")
    return rows.select("id", F.struct(F.col("family_name").alias("name"), "members", _or_none(rows, "relations")).alias("family"))


def series_pages(shelf: Shelf) -> DataFrame:
    """(id, title, family, volumes, cover): a row an active series, its active volumes by position, their editions by id, releases by date.

    The cover is that of the first release with one, in reading order: volume, edition, release id.
    """
    series = _live(shelf.series).select("id", "title")
    volumes = _live(shelf.volumes).select(F.col("id").alias("volume_id"), "series_id", "position", "label").join(series.select(F.col("id").alias("series_id")), "series_id", "left_semi")
    plain = F.transform("every", lambda x: F.struct(*[x[n].alias(n) for n in ("volume_id", "position", "label", "extent")]))
    early = F.array_min(F.transform("covers", lambda x: F.struct(x["release"].alias("release"), x["cover"].alias("cover"))))
    key = ["series_id", "volume_id", "position", "label"]
    covering = _widened(shelf, False).select(*key, "edition_id", F.col("any_publisher").alias("publisher"), "line_name", "line_position", "extent", plain.alias("coverage"), "releases", early.alias("early"))
    # each volume once without an edition, so that those that none covers are there
    alone = volumes.select(*key, *[F.lit(None).cast(covering.schema[c].dataType).alias(c) for c in covering.columns if c not in key])
    there = F.col("edition_id").isNotNull()
    rows = covering.unionByName(alone).repartition("series_id").groupBy(*key).agg(
        _by_edition(F.sort_array(F.collect_list(F.when(there, F.struct("edition_id", F.struct(*_ITEM).alias("item"))))), False).alias("editions"), F.min(F.when(F.col("early").isNotNull(), F.struct("edition_id", F.col("early").alias("of")))).alias("best"),
    )
    front = F.min(F.when(F.col("best").isNotNull(), F.struct("position", F.col("volume_id").alias("id"), "best"))).alias("front")
    shown = F.struct(F.col("volume_id").alias("id"), "position", "label", "editions")
    lists = _listed(rows, "series_id", "volumes", [F.col("position"), F.col("volume_id")], shown, front).withColumnRenamed("series_id", "id")
    rows = _beside(series, lists).join(families(shelf).hint("shuffle_hash"), "id", "left")
    return rows.select("id", "title", "family", _or_none(rows, "volumes"), F.col("front.best.of.cover").alias("cover"))


def bundle_pages(shelf: Shelf) -> DataFrame:
    """(id, name, members): a row an active bundle; members follow merged releases and editions to their survivors, name a pinned active variant, and drop out where hidden."""
    title = editions_whole(shelf).select(F.col("id").alias("edition_id"), "title")
    to_edition = lookup.survivors(shelf.editions)
    releases = lookup.resolve(_live(shelf.releases).select(F.col("id").alias("now"), "edition_id", "format", "isbn13", "isbn10", "sort"), "edition_id", to_edition, "book").drop("edition_id").withColumnRenamed("book", "edition_id")
    pinned = _live(shelf.variants).select(F.col("id").alias("variant_id"), F.struct("name").alias("variant"))
    rows = lookup.resolve(shelf.members, "release_id", lookup.survivors(shelf.releases), "now").join(releases, "now").join(title, "edition_id").join(pinned, "variant_id", "left")
    anchor = F.coalesce("isbn13", "isbn10", F.col("now").cast("string")).alias("anchor")
    item = F.struct("position", F.struct(F.col("edition_id").alias("id"), "title").alias("edition"), anchor, "format", "isbn13", "sort", "variant")
    members = _listed(rows, "bundle_id", "members", [F.col("position"), F.col("release_id")], item).withColumnRenamed("bundle_id", "id")
    rows = _live(shelf.bundles).select("id", "name").join(members, "id", "left")
    return rows.select("id", "name", _or_none(rows, "members"))


def requested(pages: DataFrame, records: DataFrame) -> DataFrame:
    """``pages`` under every id that leads to them: (requested_id, id, ...); hidden, missing and circular ids have none."""
    pointers = lookup.survivors(records).select(F.col("id").alias("requested_id"), F.col("survivor_id").alias("id"))
    return pointers.hint("shuffle_hash").join(pages, "id").select("requested_id", *pages.columns)
