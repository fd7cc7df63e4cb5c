"""What people read about records: titles and links of any record, public histories, edit forms, and ops put into words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogspark.functions import titles
from catalogspark.operators import moderation, nested

_NO_LINK = "struct<entity:string,id:bigint,title:string>"


def display(shelf: nested.Shelf) -> DataFrame:
    """(type, id, status, title, link) of every record of a shelf, hidden and merged ones too; ``link`` (entity, id, title) is the page it belongs to, null for those without one.

    A volume of a missing series is of an "Unknown series"; releases go by their edition and format, or as "Release" where it is missing.
    """
    c = F.col
    row = lambda df, kind, title, link=None: df.select(
        F.lit(kind).alias("type"), c("id").cast("bigint").alias("id"), "status", title.alias("title"), (F.lit(None) if link is None else link).cast(_NO_LINK).alias("link")
    )
    link = lambda kind, key, title: F.struct(F.lit(kind).alias("entity"), key.alias("id"), title.alias("title"))
    own = lambda df, kind, name, entity=None: row(df, kind, c(name), link(entity, c("id"), c(name)) if entity else None)
    series = shelf.series.select(c("id").alias("series_id"), c("title").alias("series_title"))
    of_volume = titles.volume_title(F.coalesce("series_title", F.lit("Unknown series")), "label")
    volumes = shelf.volumes.select("id", "status", "series_id", "label").join(series, "series_id", "left")
    editions = nested.edition_titles(shelf)
    of_edition = editions.select(c("id").alias("edition_id"), c("title").alias("edition_title"))
    releases = shelf.releases.select("id", "status", "edition_id", "format", *[c(x) for x in ("binding",) if x in shelf.releases.columns])
    if "binding" not in releases.columns:
        releases = releases.withColumn("binding", F.lit(None).cast("string"))
    releases = releases.join(of_edition, "edition_id", "left")
    bound = F.when(c("binding") != "", F.concat(F.lit(" ("), "binding", F.lit(")")))
    of_release = F.coalesce(F.concat("edition_title", F.lit(" — "), "format", F.coalesce(bound, F.lit("")), F.lit(" release")), F.lit("Release"))
    out = own(shelf.series, "series", "title", "series")
    for more in (
        row(volumes, "volume", of_volume, link("volume", c("id"), of_volume)),
        own(editions, "edition", "title", "edition"),
        row(releases, "release", of_release, F.when(c("edition_title").isNotNull(), link("edition", c("edition_id"), c("edition_title")))),
        own(shelf.bundles, "releaseBundle", "name", "bundle"),
        own(shelf.publishers, "publisher", "name"), own(shelf.families, "seriesFamily", "name"), own(shelf.lines, "editionLine", "name"), own(shelf.variants, "releaseVariant", "name"),
    ):
        out = out.unionByName(more)
    return out


def histories(records: DataFrame, revisions: DataFrame, changes: DataFrame, users: DataFrame) -> DataFrame:
    """(id, revisions): the public history of each active record, newest first; give it to ``nested.requested`` to reach it by merged ids.

    ``revisions (record_id, seq, at, comment, author_id, author_role, source_key, approver_id, citation)``, a source's where ``source_key`` is set; ``changes (record_id, seq, place, field, before, after)``;
    ``users (id, username)``: users that are gone have no name. A record without revisions has an empty history.
    """
    c = F.col
    name = lambda key, out: users.select(c("id").alias(key), c("username").alias(out))
    parts = F.sort_array(F.collect_list(F.struct("place", F.struct("field", "before", "after").alias("item"))))
    made = changes.groupBy("record_id", "seq").agg(F.transform(parts, lambda x: x["item"]).alias("changes"))
    rows = revisions.join(made, ["record_id", "seq"], "left").join(name("author_id", "author"), "author_id", "left").join(name("approver_id", "approver"), "approver_id", "left")
    user = c("source_key").isNull()
    author = F.struct(F.when(user, "user").otherwise("source").alias("kind"), F.when(user, c("author")).alias("username"), F.when(user, c("author_role")).alias("role"), "source_key").alias("author")
    none = F.array().cast(made.schema["changes"].dataType)
    entry = F.struct("seq", "at", "comment", F.coalesce("changes", none).alias("changes"), author, "approver", "citation")
    whole = rows.groupBy(c("record_id").alias("id")).agg(F.sort_array(F.collect_list(entry), asc=False).alias("revisions"))
    out = records.where("status = 'active'").select("id").join(whole, "id", "left")
    return out.select("id", F.coalesce("revisions", F.array().cast(whole.schema["revisions"].dataType)).alias("revisions"))


def edit_forms(records: DataFrame, shown: DataFrame, values: DataFrame, revisions: DataFrame) -> DataFrame:
    """(type, id, title, status, locked, overridden, base, fields, link): what a form needs of each record, whatever its status.

    ``records (type, id, status, locked, overridden array<string>)``, ``shown`` as ``display`` gives it, ``values (type, id, field, value)``, ``revisions (type, id, seq)``. ``fields`` are the registry's
    of the type in its order with current values; ``base`` is the newest revision, null without one.
    """
    c = F.col
    spark = records.sparkSession
    # a fixed table of two dozen rows
    registry = spark.createDataFrame([(i, *f) for i, f in enumerate(moderation.FIELDS)], "place int, type string, field string, kind string, required boolean, editorial boolean")
    now = values.groupBy("type", "id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("now"))
    fields = registry.groupBy("type").agg(F.sort_array(F.collect_list(F.struct("place", "field", "kind", "required", "editorial"))).alias("all"))
    last = revisions.groupBy("type", "id").agg(F.max("seq").alias("base"))
    rows = records.join(F.broadcast(fields), "type").join(now, ["type", "id"], "left").join(last, ["type", "id"], "left").join(shown.select("type", "id", "title", "link"), ["type", "id"])
    item = lambda f: F.struct(f["field"].alias("field"), f["kind"].alias("kind"), f["required"].alias("required"), f["editorial"].alias("editorial"), F.try_element_at("now", f["field"]).alias("value"))
    empty = F.array().cast("array<string>")
    return rows.select("type", "id", "title", "status", F.coalesce("locked", F.lit(False)).alias("locked"), F.coalesce("overridden", empty).alias("overridden"), "base", F.transform("all", item).alias("fields"), "link")


#: What is said of an op on one record.
VERBS = {"hide": "Hide", "restore": "Restore", "split": "Split out", "lock": "Lock", "unlock": "Unlock", "clearOverride": "Clear an override on"}


def _creation(ref: Column) -> Column:
    c = F.col
    volume = F.when(F.coalesce("label", F.lit("")) != "", F.concat(F.lit('volume "'), "label", F.lit('"'))).otherwise("an unnumbered volume")
    n = F.coalesce("n_coverage", F.lit(0))
    where = F.when(c("slug").isNotNull(), F.concat(F.lit('publisher "'), "slug", F.lit('"'))).otherwise(ref)
    code = F.when(F.coalesce("isbn13", F.lit("")) != "", F.concat(F.lit("ISBN "), "isbn13"))
    bits = F.concat_ws(", ", F.coalesce("format", F.lit("?")), F.nullif("binding", F.lit("")), code)
    return (
        F.when(c("table") == "series", F.concat(F.lit('Create new series "'), F.coalesce("title", F.lit("?")), F.lit('"')))
        .when(c("table") == "volumes", F.concat(F.lit("Create "), volume, F.lit(" in "), ref))
        .when(c("table") == "editions", F.concat(F.lit("Create an edition at "), where, F.lit(" covering "), n.cast("string"), F.lit(" volume"), F.when(n == 1, "").otherwise("s")))
        .when(c("table") == "releases", F.concat(F.lit("Create a "), bits, F.lit(" release of "), ref))
        .otherwise(F.concat(F.lit("Create a "), "table", F.lit(" record")))
    )


def rendered(ops: DataFrame, shown: DataFrame, revisions: DataFrame, locked: DataFrame) -> DataFrame:
    """(proposal_id, place, kind, summary, record_title, base, base_comment, stale) of proposals' ops.

    ``ops (proposal_id, place, kind, table, temp_id, ref, type, record_id, into_id, base, title, label, slug, n_coverage, format, binding, isbn13)``: ``ref`` of a creation is a text, a
    temporary id that an earlier creation of the proposal makes (the latest, where several do) or a record's number; updates and the rest name ``type`` and ``record_id``, merges ``into_id`` too.
    ``shown`` as ``display`` gives it, ``revisions (type, id, seq, comment)``, ``locked (type, id)``. An update is stale if its record is missing, not active or locked or its newest revision isn't ``base``.
    """
    c = F.col
    of_type = F.when(c("table") == "volumes", "series").when(c("table") == "editions", "publisher").when(c("table") == "releases", "edition")
    rows = ops.withColumn("ref_type", F.when(c("kind") == "create", of_type)).withColumn("ref_id", F.when(c("kind") == "create", c("ref").try_cast("bigint")))
    # what a temporary id is called, taken from the latest creation before the op
    volume = F.when(F.coalesce("label", F.lit("")) != "", F.concat(F.lit('the new volume "'), "label", F.lit('"'))).otherwise("the new an unnumbered volume")
    called = F.when(c("table") == "series", F.concat(F.lit('new series "'), F.coalesce("title", F.lit("?")), F.lit('"'))).when(c("table") == "volumes", volume).when(c("table") == "editions", "the new edition").when(c("table") == "releases", "the new release")
    made = ops.where("kind = 'create' AND temp_id IS NOT NULL").select("proposal_id", c("temp_id").alias("ref"), "place", called.alias("called")).where("called IS NOT NULL")
    both = made.unionByName(rows.where("ref_type IS NOT NULL AND ref IS NOT NULL").select("proposal_id", "ref", "place", F.lit(None).cast("string").alias("called"), F.lit(True).alias("asks")), allowMissingColumns=True)
    before = F.last("called", ignorenulls=True).over(Window.partitionBy("proposal_id", "ref").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    temps = both.withColumn("temp", before).where("asks").select("proposal_id", "place", "temp")
    named = lambda kind, key, out: shown.select(c("type").alias(kind), c("id").alias(key), c("title").alias(out), c("status").alias(f"{out}_status"))
    rows = rows.join(temps, ["proposal_id", "place"], "left").join(named("ref_type", "ref_id", "ref_title"), ["ref_type", "ref_id"], "left")
    rows = rows.join(named("type", "record_id", "record_title"), ["type", "record_id"], "left").join(named("type", "into_id", "into_title"), ["type", "into_id"], "left")
    latest = revisions.groupBy(c("type"), c("id").alias("record_id")).agg(F.max("seq").alias("latest"))
    based = revisions.select("type", c("id").alias("record_id"), c("seq").alias("base"), c("comment").alias("base_comment"), F.lit(True).alias("met"))
    rows = rows.join(latest, ["type", "record_id"], "left").join(based, ["type", "record_id", "base"], "left").join(locked.select("type", c("id").alias("record_id"), F.lit(True).alias("held")).distinct(), ["type", "record_id"], "left")
    found = F.when(c("ref_type") == "edition", F.concat(F.lit("edition #"), c("ref_id").cast("string"))).otherwise(F.concat("ref_type", F.lit(' "'), "ref_title", F.lit('"')))
    quoted = F.concat(F.lit('"'), "ref", F.lit('"'))
    ref = F.when(c("ref").isNull(), "(unknown)").when(c("temp").isNotNull(), c("temp")).when(c("ref_id").isNull(), quoted).when(c("ref_title_status").isNull(), "(missing)").otherwise(found)
    name = lambda title: F.concat("type", F.lit(' "'), F.coalesce(title, F.lit("(missing record)")), F.lit('"'))
    verb = F.coalesce(*[F.when(c("kind") == k, v) for k, v in VERBS.items()])
    summary = F.when(c("kind") == "create", _creation(ref)).when(c("kind") == "merge", F.concat(F.lit("Merge "), name("record_title"), F.lit(" into "), name("into_title"))).when(c("kind") != "update", F.concat(verb, F.lit(" "), name("record_title")))
    update = c("kind") == "update"
    stale = ~c("record_title_status").eqNullSafe(F.lit("active")) | c("held").isNotNull() | ~c("latest").eqNullSafe(c("base"))
    return rows.select(
        "proposal_id", "place", "kind", summary.alias("summary"), F.when(update, F.coalesce("record_title", F.lit("(missing record)"))).alias("record_title"),
        F.when(update, F.when(c("met"), c("base")).otherwise(0)).alias("base"), F.when(update, c("base_comment")).alias("base_comment"), F.when(update, stale).alias("stale"),
    )
