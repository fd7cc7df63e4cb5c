"""Merges of records of nine types: every reference to a loser goes to its survivor, one manifest logs it over all tables, and a split replays it backward.

``RULES`` says which columns of which tables refer to a type. A table is touched by the rows of losers alone: those and the survivors' rows
are joined, never the whole table with itself. Tables are DataFrames with a unique ``id``. Values in the manifest are JSON, so that one log holds the fields of all tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalogspark.operators import tables as shared


@dataclass(frozen=True)
class Rule:
    """``column`` of ``table`` refers to the type. With ``keys`` a row that the survivor has already under the same values goes; ``order`` follows the survivor's last; ``other`` is the
    far end of an edge, which can't be the survivor; ``where`` limits the rows; ``parent`` (column, type's column) is taken over from the survivor."""

    table: str
    column: str
    keys: tuple[str, ...] = ()
    order: str | None = None
    other: str | None = None
    where: str | None = None
    parent: tuple[str, str] | None = None


#: Types, the table of their records, and what refers to them.
TABLES = {
    "publisher": "publishers", "seriesFamily": "series_families", "series": "series", "volume": "volumes", "editionLine": "edition_lines", "edition": "editions", "release": "releases", "releaseVariant": "release_variants", "releaseBundle": "release_bundles",
}
RULES = {
    "publisher": [Rule("edition_lines", "publisher_id"), Rule("editions", "publisher_id"), Rule("releases", "publisher_id"), Rule("release_bundles", "publisher_id"), Rule("publisher_redirects", "publisher_id")],
    "seriesFamily": [Rule("series", "family_id")],
    "series": [
        Rule("volumes", "series_id", order="position"), Rule("edition_lines", "series_id"), Rule("series_relationships", "from_id", ("from_id", "to_id", "type"), other="to_id"), Rule("series_relationships", "to_id", ("from_id", "to_id", "type"), other="from_id"),
        Rule("series_states", "series_id", ("user_id", "series_id")), Rule("release_progress", "series_id"), Rule("volume_progress", "series_id"),
    ],
    "volume": [Rule("coverage", "volume_id", ("edition_id", "volume_id")), Rule("volume_progress", "volume_id", ("user_id", "volume_id"), parent=("series_id", "series_id"))],
    "editionLine": [Rule("editions", "line_id")],
    "edition": [Rule("coverage", "edition_id", ("edition_id", "volume_id"), order="position"), Rule("releases", "edition_id")],
    "release": [
        Rule("release_variants", "release_id"), Rule("bundle_members", "release_id", ("bundle_id", "release_id")), Rule("entries", "release_id", ("user_id", "release_id")), Rule("release_progress", "release_id", ("user_id", "release_id")),
    ],
    "releaseVariant": [Rule("entries", "variant_id"), Rule("bundle_members", "variant_id")],
    "releaseBundle": [Rule("bundle_members", "bundle_id", ("bundle_id", "release_id"), order="position"), Rule("entries", "bundle_id", ("user_id", "bundle_id"))],
}
for _kind, _rules in RULES.items():
    _rules += [Rule(t, "record_id", where=f"record_type = '{_kind}'") for t in ("observations", "suppressions")]

_LOG = "loser bigint, survivor bigint, action string, table string, row_id bigint, field string, before string, after string"


def _text(column):
    return F.to_json(F.struct(F.col(column).alias("v")))


def check(records: DataFrame, merges: DataFrame) -> DataFrame:
    """``merges (loser, survivor)`` with a problem: badMerge (itself, two survivors, or a survivor that the batch merges away), notFound, badState (not active), locked, or null."""
    c = F.col
    state = records.select("id", F.struct("status", F.coalesce("locked", F.lit(False)).alias("locked")).alias("s"))
    rows = merges.join(state.select(c("id").alias("loser"), c("s").alias("a")), "loser", "left").join(state.select(c("id").alias("survivor"), c("s").alias("b")), "survivor", "left")
    times = merges.groupBy("loser").agg(F.count(F.lit(1)).alias("times"))
    rows = rows.join(times, "loser").join(times.select(c("loser").alias("survivor"), F.lit(True).alias("gone")), "survivor", "left")
    problem = (
        F.when((c("loser") == c("survivor")) | (c("times") > 1) | c("gone"), "badMerge").when(c("a").isNull() | c("b").isNull(), "notFound")
        .when((c("a.status") != "active") | (c("b.status") != "active"), "badState").when(c("a.locked") | c("b.locked"), "locked")
    )
    return rows.select("loser", "survivor", problem.alias("problem"))


def _move(rows: DataFrame, merges: DataFrame, rule: Rule, survivors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows after, log) of one rule."""
    c, col = F.col, rule.column
    some = rows.where(rule.where) if rule.where else rows
    hit = some.join(merges.select(c("loser").alias(col), "survivor"), col).withColumn("loser", c(col))
    gone = F.lit(False)
    if rule.other:
        gone = c(rule.other) == c("survivor")
    if rule.keys:
        rest = [k for k in rule.keys if k != col]
        held = some.join(merges.select(c("survivor").alias(col)).distinct(), col, "left_semi").select(*rest, c(col).alias("survivor")).distinct().withColumn("held", F.lit(True))
        hit = hit.withColumn("self", gone).join(held, [*rest, "survivor"], "left")
        first = hit.where("NOT self").groupBy(*rest, "survivor").agg(F.min(F.struct("loser", "id")).alias("first"))
        hit = hit.join(first, [*rest, "survivor"], "left")
        gone = c("self") | F.coalesce("held", F.lit(False)) | (c("first.id") != c("id"))
    hit = hit.withColumn("gone", F.coalesce(gone, F.lit(False)))
    new = {col: c("survivor")}
    if rule.order:
        base = some.join(merges.select(c("survivor").alias(col)).distinct(), col, "left_semi").groupBy(c(col).alias("survivor")).agg(F.max(rule.order).alias("base"))
        top = hit.where("NOT gone").groupBy("survivor", "loser").agg(F.max(rule.order).alias("top")).join(base, "survivor", "left")
        before = F.sum("top").over(Window.partitionBy("survivor").orderBy("loser").rowsBetween(Window.unboundedPreceding, -1))
        hit = hit.join(top.select("loser", (F.coalesce("base", F.lit(0)) + F.coalesce(before, F.lit(0))).alias("offset")), "loser", "left")
        new[rule.order] = (c(rule.order) + c("offset")).cast(dict(rows.dtypes)[rule.order])
    if rule.parent:
        hit = hit.join(survivors.select(c("id").alias("survivor"), c(rule.parent[1]).alias("_parent")), "survivor", "left")
        new[rule.parent[0]] = c("_parent")
    kinds = dict(rows.dtypes)
    told = hit.select("id", "loser", "survivor", "gone", F.to_json(F.struct(*rows.columns)).alias("doc"), *[_text(f).alias(f"before_{f}") for f in new], *[v.cast(kinds[f]).alias(f"after_{f}") for f, v in new.items()])
    told = shared.stored(told, "merge-moves")
    entries = F.array(*[F.struct(F.lit(f).alias("field"), c(f"before_{f}").alias("before"), _text(f"after_{f}").alias("after")) for f in new])
    moved = told.where("NOT gone").select("loser", "survivor", F.lit("repoint").alias("action"), F.lit(rule.table).alias("table"), c("id").alias("row_id"), F.inline(F.filter(entries, lambda e: ~e["before"].eqNullSafe(e["after"]))))
    none = F.lit(None).cast("string")
    removed = told.where("gone").select("loser", "survivor", F.lit("remove").alias("action"), F.lit(rule.table).alias("table"), c("id").alias("row_id"), none.alias("field"), c("doc").alias("before"), none.alias("after"))
    put = told.select("id", "gone", *[c(f"after_{f}") for f in new])
    out = rows.join(put, "id", "left").where("NOT coalesce(gone, false)")
    out = out.select(*[(F.when(c("gone").isNotNull(), c(f"after_{f}")).otherwise(c(f)).alias(f) if f in new else c(f)) for f in rows.columns])
    return out, moved.unionByName(removed)


def _denorms(tables: dict, editions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(releases, log) with the series and publisher of releases of ``editions (edition_id, loser, survivor)`` as their coverage and edition now say."""
    c = F.col
    series = tables["volumes"].select(c("id").alias("volume_id"), "series_id")
    listed = tables["coverage"].join(editions.select("edition_id").distinct(), "edition_id").join(series, "volume_id").groupBy("edition_id").agg(F.array_sort(F.collect_list(F.struct("position", "id", "series_id"))).alias("x"))
    fresh = editions.join(listed, "edition_id", "left").join(tables["editions"].select(c("id").alias("edition_id"), c("publisher_id").alias("new_publisher")), "edition_id")
    fresh = fresh.select("edition_id", "loser", "survivor", "new_publisher", F.coalesce(F.array_distinct(F.transform("x", lambda v: v["series_id"])), F.array().cast("array<bigint>")).alias("new_series"))
    releases = tables["releases"]
    told = releases.join(fresh, "edition_id").where(~(c("series_ids").eqNullSafe(c("new_series")) & c("publisher_id").eqNullSafe(c("new_publisher"))))
    told = shared.stored(told.select("id", "loser", "survivor", "series_ids", "publisher_id", "new_series", "new_publisher"), "merge-denorms")
    entries = F.array(F.struct(F.lit("series_ids").alias("field"), _text("series_ids").alias("before"), _text("new_series").alias("after")), F.struct(F.lit("publisher_id").alias("field"), _text("publisher_id").alias("before"), _text("new_publisher").alias("after")))
    log = told.select("loser", "survivor", F.lit("repoint").alias("action"), F.lit("releases").alias("table"), c("id").alias("row_id"), F.inline(F.filter(entries, lambda e: ~e["before"].eqNullSafe(e["after"]))))
    put = told.select("id", "new_series", "new_publisher", F.lit(True).alias("hit"))
    out = releases.join(put, "id", "left")
    return out.select(*[(F.when(c("hit"), c({"series_ids": "new_series", "publisher_id": "new_publisher"}[f])).otherwise(c(f)).alias(f) if f in ("series_ids", "publisher_id") else c(f)) for f in releases.columns]), log


def merge(tables: dict[str, DataFrame], kind: str, merges: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables after, manifest) of ``merges (loser, survivor)`` of one type that ``check`` has nothing against, one loser after the other in order of their ids.

    Where several merges of a batch make two edges equal by moving both of their ends, one of the two stays; one after another it could be the other one.

    Tables that aren't given are not moved. The manifest is (loser, survivor, action, table, row_id, field, before, after): merge (a row for each merge), repoint, remove (``before`` is the row) and insert.
    """
    c, out, logs = F.col, dict(tables), []
    merges = shared.stored(merges.select(c("loser").cast("bigint").alias("loser"), c("survivor").cast("bigint").alias("survivor")), "merges")
    records = tables[TABLES[kind]]
    touched = None
    if {"coverage", "volumes", "releases", "editions"} <= out.keys():
        of = {"volume": lambda: out["coverage"].select("edition_id", c("volume_id").alias("loser")), "series": lambda: out["coverage"].join(out["volumes"].select(c("id").alias("volume_id"), c("series_id").alias("loser")), "volume_id").select("edition_id", "loser")}
        if kind in of:
            touched = of[kind]().join(merges, "loser").groupBy("edition_id").agg(F.min(F.struct("loser", "survivor")).alias("m")).select("edition_id", "m.*")
        elif kind == "edition":
            touched = merges.groupBy(c("survivor").alias("edition_id")).agg(F.min("loser").alias("loser")).select("edition_id", "loser", c("edition_id").alias("survivor"))
        if touched is not None:
            touched = shared.stored(touched, "merge-editions")
    for rule in RULES[kind]:
        if rule.table in out:
            out[rule.table], log = _move(out[rule.table], merges, rule, records)
            logs.append(log)
    if touched is not None:
        out["releases"], log = _denorms(out, touched)
        logs.append(log)
    if kind == "publisher" and "publisher_redirects" in out:
        last = out["publisher_redirects"].agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        from catalogspark.operators import creation

        own = merges.join(records.select(c("id").alias("loser"), "slug"), "loser")
        new = shared.stored(creation.allocate(own, "loser", last).select(c("new_id").cast("bigint").alias("id"), "slug", "loser", "survivor"), "merge-redirects")
        out["publisher_redirects"] = out["publisher_redirects"].unionByName(new.select("id", c("slug").alias("from_slug"), c("survivor").alias("publisher_id")))
        none = F.lit(None).cast("string")
        logs.append(new.select("loser", "survivor", F.lit("insert").alias("action"), F.lit("publisher_redirects").alias("table"), c("id").alias("row_id"), none.alias("field"), none.alias("before"), none.alias("after")))
    own = out[TABLES[kind]]
    to = merges.select(c("loser").alias("id"), c("survivor").alias("_to"))
    marked = own.join(to, "id", "left")
    new = {"status": F.when(c("_to").isNotNull(), "merged").otherwise(c("status")), "merged_into": F.coalesce("_to", "merged_into")}
    out[TABLES[kind]] = marked.select(*[new[f].alias(f) if f in new else c(f) for f in own.columns])
    none = F.lit(None).cast("string")
    log = merges.select("loser", "survivor", F.lit("merge").alias("action"), F.lit(TABLES[kind]).alias("table"), c("loser").alias("row_id"), none.alias("field"), none.alias("before"), none.alias("after"))
    for x in logs:
        log = log.unionByName(x)
    return out, log


def split(tables: dict[str, DataFrame], kind: str, manifest: DataFrame, losers: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables after the merges of ``manifest`` (of ``losers (id)``, or all) are taken back: what they inserted goes, what they removed comes, and each field that still has the
    value that the merge left gets the one before. Of several merges the last comes first: call it with the later one's manifest before."""
    c, out = F.col, dict(tables)
    if losers is not None:
        manifest = manifest.join(losers.select(c("id").alias("loser")), "loser", "left_semi")
    manifest = shared.stored(manifest, "split")
    for name, rows in tables.items():
        if name not in {r.table for r in RULES[kind]} | {"releases"}:
            continue
        own, kinds = manifest.where(c("table") == name), dict(rows.dtypes)
        rows = rows.join(own.where("action = 'insert'").select(c("row_id").alias("id")), "id", "left_anti")
        again = own.where("action = 'remove'").select(F.from_json("before", ", ".join(f"`{f}` {t}" for f, t in kinds.items())).alias("r")).select("r.*")
        rows = rows.unionByName(again)  # first, as one end of an edge may have moved before the edge went
        fields = [f for f in rows.columns if f in {r.column for r in RULES[kind]} | {r.order for r in RULES[kind]} | {r.parent[0] for r in RULES[kind] if r.parent} | {"series_ids", "publisher_id"}]
        if fields:
            back = own.where("action = 'repoint'").groupBy(c("row_id").alias("id")).agg(*[F.max(F.when(c("field") == f, F.struct("before", "after"))).alias(f"_{f}") for f in fields])
            joined = rows.join(back, "id", "left")
            value = lambda f: F.when(c(f"_{f}").isNotNull() & (_text(f) == c(f"_{f}.after")), F.from_json(c(f"_{f}.before"), f"v {kinds[f]}")["v"]).otherwise(c(f)).alias(f)
            rows = joined.select(*[value(f) if f in fields else c(f) for f in rows.columns])
        out[name] = rows
    own = out[TABLES[kind]]
    gone = manifest.select(c("loser").alias("id")).distinct() if losers is None else losers.select("id").distinct()
    marked = own.join(gone.withColumn("_back", F.lit(True)), "id", "left")
    new = {"status": F.when(c("_back"), "active").otherwise(c("status")), "merged_into": F.when(~F.coalesce("_back", F.lit(False)), c("merged_into"))}
    out[TABLES[kind]] = marked.select(*[new[f].alias(f) if f in new else c(f) for f in own.columns])
    return out
