"""Approval of reviewed proposals: every op of a proposal is carried out, or none.

Ops make records by temporary ids that later ops of the same proposal refer to. The tables form levels (series, volumes, editions,
releases), so references are resolved a level at a time by joins on (proposal, temporary id), whatever the number of ops. One bad op
refuses its whole proposal before any id is given. Of proposals that change one record from the same base, the first in order is approved and
the others are stale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.operators import creation, moderation, tables

#: Tables that ops may create, in the order of their levels, with the type whose fields they have and the table they refer to.
LEVELS = [("series", "series", None), ("volumes", "volume", "series"), ("editions", "edition", "volumes"), ("releases", "release", "editions")]
_TYPES = {table: kind for table, kind, _ in LEVELS}
_PARENTS = {table: parent for table, _, parent in LEVELS}


def _map(of: dict, key):
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), key)


def _met(df: DataFrame) -> DataFrame:
    """The other side of a join, as a table that grows with the proposals: stored files are far smaller than their rows, so their size would make Spark send them to every task through the driver."""
    return df.hint("merge")


def references(ops: DataFrame, records: DataFrame) -> DataFrame:
    """(proposal_id, place, at, ref, temp, stored, good) of each reference: a temporary id of an earlier op of the table it must be, or the id of a stored active record.

    A temporary id wins over a stored one of the same name; one of another table or of a later op is no reference.
    """
    c = F.col
    refs = ops.where("kind = 'create'").select("proposal_id", "place", _map({k: v for k, v in _PARENTS.items() if v}, c("table")).alias("parent"), F.posexplode("refs").alias("at", "ref"))
    made = ops.where("kind = 'create'").select("proposal_id", c("temp_id").alias("ref"), c("table").alias("made_table"), c("place").alias("made_at"))
    made = made.groupBy("proposal_id", "ref").agg(F.min(F.struct("made_at", "made_table")).alias("made"))
    live = records.where("status = 'active'").select(c("table").alias("parent"), c("id").cast("string").alias("ref"), c("id").alias("stored"))
    rows = refs.join(_met(made), ["proposal_id", "ref"], "left").join(_met(live), ["parent", "ref"], "left")
    temp = c("made").isNotNull() & (c("made.made_at") < c("place"))
    good = F.when(temp, c("made.made_table") == c("parent")).otherwise(c("stored").isNotNull())
    return rows.select("proposal_id", "place", "at", "ref", F.when(temp, c("ref")).alias("temp"), F.when(~temp, c("stored")).alias("stored"), F.coalesce(good, F.lit(False)).alias("good"))


def problems(ops: DataFrame, records: DataFrame, publishers: DataFrame, refs: DataFrame) -> DataFrame:
    """(proposal_id, place, problem) of each op that can't be carried out; several problems of an op are several rows."""
    c = F.col
    creates = ops.where("kind = 'create'")
    found = lambda df, text: df.select("proposal_id", "place", F.lit(text).alias("problem"))
    out = [found(ops.where("kind NOT IN ('create', 'update')"), "unsupportedOp"), found(creates.where(~F.coalesce(c("table").isin(*_TYPES), F.lit(False))), "unknownTable"), found(refs.where("NOT good"), "badReference")]
    first = creates.groupBy("proposal_id", "temp_id").agg(F.min("place").alias("first"))
    twice = creates.join(_met(first), ["proposal_id", "temp_id"]).where("place > first")
    out.append(found(twice.select("proposal_id", "place").unionByName(creates.where("coalesce(temp_id, '') = ''").select("proposal_id", "place")), "badTempId"))
    size = F.coalesce(F.size("refs"), F.lit(0))
    out.append(found(creates.where(c("table").isin("volumes", "releases") & (size != 1) | (c("table") == "editions") & ((size < 1) | ~F.coalesce(F.forall("extents", lambda x: x.isin("complete", "partial")) & (F.size("extents") == size), F.lit(False)))), "badReference"))
    live = publishers.where("status = 'active'").select(c("slug").alias("publisher"), F.lit(True).alias("known"))
    out.append(found(creates.where("table = 'editions'").join(live, "publisher", "left").where("known IS NULL"), "unknownPublisher"))
    digital = c("fields")["format"] == "digital"
    out.append(found(creates.where((c("table") == "releases") & ~(F.coalesce(c("fields")["format"].isin("physical", "digital"), F.lit(False)) & ~F.coalesce(digital & (c("fields")["binding"].isNotNull()), F.lit(False)))), "badFormat"))
    given = ops.select("proposal_id", "place", "kind", _map(_TYPES, c("table")).alias("type"), F.explode("fields").alias("field", "value")).where("field <> 'format' OR kind = 'update'")
    out.append(found(_normal(given).where("NOT known OR NOT coalesce(normal.ok, false)"), "invalidField"))
    needs = {"series": "title", "releases": "language"}
    for table, field in needs.items():
        out.append(found(creates.where((c("table") == table) & (F.trim(F.coalesce(c("fields")[field], F.lit(""))) == "")), "missingField"))
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    return rows.distinct()


def _normal(given: DataFrame) -> DataFrame:
    """``given (.., type, field, value)`` with ``known`` and its ``normal`` form."""
    fields = moderation.registry(given.sparkSession).select("type", "field", F.col("kind").alias("field_kind"), "required")
    rows = given.join(F.broadcast(fields), ["type", "field"], "left")  # a fixed table of two dozen rows
    return rows.withColumn("known", F.col("field_kind").isNotNull()).withColumn("normal", moderation.normal_value(F.col("field_kind"), F.col("required"), F.col("value")))


def first_wins(updates: DataFrame) -> DataFrame:
    """(proposal_id, won) of proposals that change records: in order of ``rank``, one is approved if none approved before it changes a record of its.

    ``updates (proposal_id, rank, table, record_id)``. A round approves what comes first on all of its records and drops what these rule out, so that a
    record that many proposals change takes one round.
    """
    keys = ["table", "record_id"]
    todo, out = tables.stored(updates.select("proposal_id", "rank", *keys).distinct(), "approve-open"), None
    while True:
        first = todo.groupBy(*keys).agg(F.min("rank").alias("first"))
        told = tables.stored(todo.join(_met(first), keys).groupBy("proposal_id").agg(F.bool_and(F.col("rank") == F.col("first")).alias("won")), "approve-round")
        won = told.where("won")
        held = todo.join(_met(won.select("proposal_id")), "proposal_id", "left_semi").select(*keys).distinct()
        lost = todo.join(_met(held), keys, "left_semi").select("proposal_id").distinct().join(_met(won.select("proposal_id")), "proposal_id", "left_anti").withColumn("won", F.lit(False))
        now = tables.stored(won.unionByName(lost), "approve-round")
        out = now if out is None else out.unionByName(now)
        todo = tables.stored(todo.join(_met(now.select("proposal_id")), "proposal_id", "left_anti"), "approve-open")
        if todo.isEmpty():
            return out


def approve(proposals: DataFrame, ops: DataFrame, records: DataFrame, revisions: DataFrame, publishers: DataFrame, volumes: DataFrame, edition_series: DataFrame, last: dict[str, int]) -> dict[str, DataFrame]:
    """What approving ``proposals (proposal_id, rank, state)`` in order of ``rank`` does: outcomes, and the rows it adds or changes.

    ``ops (proposal_id, place, kind, table, temp_id, refs, extents, publisher, fields, record_id, base)``: of a creation ``refs`` are the series of a volume, the covered volumes of an edition in order (with their ``extents``), the edition of a
    release, and ``publisher`` the slug of an edition's; of an update ``fields`` are the new values and ``base`` the revision they started from. ``records (table, id, status, locked)``, ``revisions (table, record_id, seq)``,
    ``volumes (id, series_id, position)``, ``edition_series (edition_id, series_id, publisher_id)`` of stored editions, ``publishers (id, slug, status)``.
    Outcomes: approved, stale (a record isn't editable or has another revision than the base: nothing is done), invalid (some op can't be carried out) and badState (not in review).
    """
    c = F.col
    open_ = proposals.where("state = 'inReview'").select("proposal_id", "rank")
    ops = tables.stored(ops.join(_met(open_), "proposal_id"), "approve-ops")
    refs = tables.stored(references(ops, records), "approve-refs")
    bad = problems(ops, records, publishers, refs).groupBy("proposal_id").agg(F.array_join(F.array_sort(F.collect_set("problem")), ",").alias("problem"))
    latest = revisions.groupBy("table", "record_id").agg(F.max("seq").alias("latest"))
    updates = ops.where("kind = 'update'").join(_met(records.select("table", c("id").alias("record_id"), "status", "locked")), ["table", "record_id"], "left").join(_met(latest), ["table", "record_id"], "left")
    gone = c("status").isNull() | (c("status") != "active") | F.coalesce("locked", F.lit(False))
    updates = tables.stored(updates.withColumn("stale", gone | ~c("base").eqNullSafe(c("latest"))), "approve-updates")
    stale = updates.groupBy("proposal_id").agg(F.bool_or("stale").alias("stale"))
    told = tables.stored(open_.join(_met(stale), "proposal_id", "left").join(_met(bad), "proposal_id", "left"), "approve-checked")
    fine = told.where("NOT coalesce(stale, false) AND problem IS NULL").select("proposal_id")
    raced = first_wins(updates.join(_met(fine), "proposal_id", "left_semi"))
    told = told.join(_met(raced), "proposal_id", "left")
    outcome = F.when(F.coalesce("stale", F.lit(False)), "stale").when(c("problem").isNotNull(), "invalid").when(~F.coalesce("won", F.lit(True)), "stale").otherwise("approved")
    told = tables.stored(told.select("proposal_id", outcome.alias("outcome"), F.when(outcome == "invalid", c("problem")).alias("problem")), "approve-told")
    outcomes = told.unionByName(proposals.where("state <> 'inReview'").select("proposal_id", F.lit("badState").alias("outcome"), F.lit(None).cast("string").alias("problem")))
    approved = told.where("outcome = 'approved'").select("proposal_id")
    creates = tables.stored(ops.where("kind = 'create'").join(_met(approved), "proposal_id", "left_semi").withColumn("order", F.struct("rank", "place")), "approve-creates")
    links = tables.stored(refs.join(_met(approved), "proposal_id", "left_semi"), "approve-links")

    def number(table: str) -> DataFrame:
        rows = creates.where(c("table") == table).select("proposal_id", "place", "temp_id", "publisher", "fields", "extents", "order")
        return tables.stored(creation.allocate(rows, "order", last[table]).withColumnRenamed("new_id", "id").withColumn("id", c("id").cast("bigint")), f"approve-{table}")

    def parents(rows: DataFrame, above: DataFrame) -> DataFrame:
        """(id, at, parent, own): references of one level's rows, resolved by the level above; ``own``: to a record that this batch makes, which is no stored one of the same id."""
        got = rows.select("id", "proposal_id", "place").join(_met(links), ["proposal_id", "place"])
        return got.join(_met(above.select("proposal_id", c("temp_id").alias("temp"), c("id").alias("made"))), ["proposal_id", "temp"], "left").select("id", "at", F.coalesce("made", c("stored").cast("bigint")).alias("parent"), c("made").isNotNull().alias("own"))

    series, new_volumes, editions, releases = (number(t) for t, _, _ in LEVELS)
    new_volumes = new_volumes.join(_met(parents(new_volumes, series).select("id", c("parent").alias("series_id"), "own")), "id")
    new_volumes = tables.stored(creation.append_positions(new_volumes, volumes.select(c("series_id").cast("bigint").alias("series_id"), "position"), "series_id", "order", c("own")).drop("own"), "approve-volumes")
    coverage = parents(editions, new_volumes).withColumnRenamed("id", "edition_id").withColumnRenamed("parent", "volume_id").join(_met(editions.select(c("id").alias("edition_id"), "extents")), "edition_id")
    coverage = tables.stored(coverage.select("edition_id", "volume_id", (c("at") + 1).alias("position"), F.get("extents", c("at")).alias("extent"), "own"), "approve-coverage")
    editions = editions.join(F.broadcast(publishers.where("status = 'active'").select(c("slug").alias("publisher"), c("id").cast("bigint").alias("publisher_id"))), "publisher")  # publishers are few, and many editions have one
    stored, made = F.lit(False).alias("own"), F.lit(True).alias("own")
    every = volumes.select(c("id").cast("bigint").alias("volume_id"), c("series_id").cast("bigint").alias("series_id"), stored).unionByName(new_volumes.select(c("id").alias("volume_id"), "series_id", made))
    denorm = coverage.join(_met(every), ["volume_id", "own"]).select("edition_id", "series_id").distinct().join(_met(editions.select(c("id").alias("edition_id"), "publisher_id")), "edition_id")
    denorm = denorm.withColumn("own", made).unionByName(edition_series.select(c("edition_id").cast("bigint").alias("edition_id"), c("series_id").cast("bigint").alias("series_id"), c("publisher_id").cast("bigint").alias("publisher_id"), stored))
    of = parents(releases, editions).select("id", c("parent").alias("edition_id"), "own").join(_met(denorm), ["edition_id", "own"], "left").groupBy("id", "edition_id").agg(F.array_sort(F.collect_set("series_id")).alias("series_ids"), F.min("publisher_id").alias("publisher_id"))
    releases = tables.stored(releases.join(_met(of), "id"), "approve-made")
    done = updates.join(_met(approved), "proposal_id", "left_semi")
    values = tables.stored(_normal(done.select("proposal_id", "place", "table", "record_id", "latest", _map(_TYPES, c("table")).alias("type"), F.explode("fields").alias("field", "value"))), "approve-values")
    patches = values.select("proposal_id", "table", "record_id", "field", c("normal.value").alias("value"))
    revised = values.groupBy("proposal_id", "table", "record_id").agg(F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"), (F.coalesce(F.min("latest"), F.lit(0)) + 1).cast("int").alias("seq"))
    new = None
    for table, rows in zip(_TYPES, (series, new_volumes, editions, releases)):
        one = rows.select("proposal_id", F.lit(table).alias("table"), c("id").alias("record_id"), F.array_join(F.array_sort(F.map_keys(F.map_filter("fields", lambda _, v: v.isNotNull()))), ",").alias("fields"), F.lit(1).alias("seq"))
        new = one if new is None else new.unionByName(one)
    return {
        "outcomes": outcomes, "series": series, "volumes": new_volumes, "editions": editions, "coverage": coverage.drop("own"), "releases": releases, "patches": patches,
        "revisions": new.unionByName(revised.select("proposal_id", "table", c("record_id").cast("bigint").alias("record_id"), "fields", "seq")),
    }
