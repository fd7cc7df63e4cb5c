"""Titles of records, public histories, edit forms and ops in words."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogspark.operators import histories, nested
from catalogspark.plans.nested import _SHELF, _ends, _json, _shelf
from catalogspark.registry import register
from catalogspark.sources.fixture import Catalog, sql

_REVISIONS = """revs AS (SELECT l_partkey AS record_id, l_orderkey * 10 + l_linenumber AS seq, l_linenumber AS n, min(l_suppkey) AS who FROM lineitem GROUP BY ALL)"""


def _revisions(c: Catalog):
    """Lines as revisions of series: every second one by a source."""
    n = F.col("l_linenumber")
    rows = c.raw("lineitem").groupBy(F.col("l_partkey").alias("record_id"), (F.col("l_orderkey") * 10 + n).alias("seq"), n.alias("n")).agg(F.min("l_suppkey").alias("who"))
    n, source = F.col("n"), F.col("n") % 2 == 0
    return rows.select(
        "record_id", "seq", F.col("seq").alias("at"), F.concat(F.lit("r"), F.col("seq").cast("string")).alias("comment"), F.when(~source, F.col("who")).alias("author_id"), F.when(~source, "editor").alias("author_role"),
        F.when(source, F.concat(F.lit("src"), n.cast("string"))).alias("source_key"), F.when(n % 3 == 0, F.col("who") + 1).alias("approver_id"), F.when(source, F.concat(F.lit("u"), n.cast("string"))).alias("citation"), "n",
    )


@register(
    "record_titles",
    _SHELF + """SELECT 'series' AS type, id, status, title, 'series' AS entity, id AS link_id, title AS link_title FROM n_series
    UNION ALL SELECT 'volume', v.id, v.status, coalesce(s.title, 'Unknown series') || coalesce(' Vol ' || v.label, ''), 'volume', v.id, coalesce(s.title, 'Unknown series') || coalesce(' Vol ' || v.label, '') FROM n_volumes v LEFT JOIN n_series s ON s.id = v.series_id
    UNION ALL SELECT 'edition', id, status, title, 'edition', id, title FROM eds_all
    UNION ALL SELECT 'release', r.id, r.status, coalesce(e.title || ' — ' || r.format || ' release', 'Release'), CASE WHEN e.id IS NOT NULL THEN 'edition' END, e.id, e.title FROM n_releases r LEFT JOIN eds_all e ON e.id = r.edition_id
    UNION ALL SELECT 'releaseBundle', id, status, name, 'bundle', id, name FROM bundles UNION ALL SELECT 'publisher', id, status, name, NULL, NULL, NULL FROM publishers
    UNION ALL SELECT 'seriesFamily', id, status, name, NULL, NULL, NULL FROM n_families UNION ALL SELECT 'editionLine', id, status, name, NULL, NULL, NULL FROM n_lines UNION ALL SELECT 'releaseVariant', id, status, name, NULL, NULL, NULL FROM n_variants""",
)
def record_titles(spark, sf_dir):
    rows = histories.display(_shelf(Catalog(spark, sf_dir)))
    return rows.select("type", "id", "status", "title", F.col("link.entity").alias("entity"), F.col("link.id").alias("link_id"), F.col("link.title").alias("link_title"))


@register(
    "series_history",
    "WITH " + sql("series", "users").removeprefix("WITH ") + f""", {_REVISIONS},
    entries AS (SELECT record_id, seq, struct_pack(seq := seq, at := seq, comment := 'r' || seq,
      changes := (CASE WHEN n % 3 = 0 THEN [struct_pack(field := 'altTitles', before := 'b', after := CAST(NULL AS VARCHAR))] ELSE [] END) || (CASE WHEN n % 2 = 1 THEN [struct_pack(field := 'title', before := CAST(NULL AS VARCHAR), after := 'a' || n)] ELSE [] END),
      author := struct_pack(kind := CASE WHEN n % 2 = 0 THEN 'source' ELSE 'user' END, username := CASE WHEN n % 2 = 1 THEN a.username END, role := CASE WHEN n % 2 = 1 THEN 'editor' END, source_key := CASE WHEN n % 2 = 0 THEN 'src' || n END),
      approver := CASE WHEN n % 3 = 0 THEN b.username END, citation := CASE WHEN n % 2 = 0 THEN 'u' || n END) AS entry
      FROM revs r LEFT JOIN users a ON a.id = r.who LEFT JOIN users b ON b.id = r.who + 1)
    SELECT requested_id, s.id, CAST(to_json(struct_pack(revisions := coalesce(h.revisions, []))) AS VARCHAR) AS page FROM series s JOIN {_ends("series")} t ON t.id = s.id
    LEFT JOIN (SELECT record_id, list(entry ORDER BY seq DESC) AS revisions FROM entries GROUP BY record_id) h ON h.record_id = s.id WHERE s.status = 'active'""",
)
def series_history(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    revisions = _revisions(c)
    none = F.lit(None).cast("string")
    change = lambda where, place, field, before, after: revisions.where(where).select("record_id", "seq", F.lit(place).alias("place"), F.lit(field).alias("field"), before.alias("before"), after.alias("after"))
    changes = change("n % 3 = 0", 0, "altTitles", F.lit("b"), none).unionByName(change("n % 2 = 1", 1, "title", none, F.concat(F.lit("a"), F.col("n").cast("string"))))
    return nested.requested(_json(histories.histories(c.series, revisions.drop("n"), changes, c.users)), c.series)


def _field(field: str, kind: str, required: bool, editorial: bool, value: str) -> str:
    return f"struct_pack(field := '{field}', kind := '{kind}', required := {str(required).lower()}, editorial := {str(editorial).lower()}, value := {value})"


@register(
    "edit_forms",
    _SHELF + f""", {_REVISIONS}
    SELECT 'series' AS type, s.id, s.title, s.status, s.id % 5 = 0 AS locked, CASE WHEN s.id % 4 = 0 THEN 'title' ELSE '' END AS overridden, (SELECT max(seq) FROM revs WHERE record_id = s.id) AS base,
      CAST(to_json([{_field("title", "text", True, False, "s.title")}, {_field("altTitles", "stringList", False, False, "s.alt_title")}, {_field("sourceStatus", "select", False, False, "CAST(NULL AS VARCHAR)")}]) AS VARCHAR) AS fields, s.id AS link_id FROM n_series s
    UNION ALL SELECT 'publisher', p.id, p.name, p.status, p.id % 5 = 0, CASE WHEN p.id % 4 = 0 THEN 'title' ELSE '' END, NULL,
      CAST(to_json([{_field("name", "text", True, False, "p.name")}, {_field("description", "textarea", False, True, "CAST(NULL AS VARCHAR)")}]) AS VARCHAR), NULL FROM publishers p""",
)
def edit_forms(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    shelf = _shelf(c)
    k = F.col("id")
    of = lambda df, kind: df.select(F.lit(kind).alias("type"), k, "status", (k % 5 == 0).alias("locked"), F.when(k % 4 == 0, F.array(F.lit("title"))).alias("overridden"))
    value = lambda df, kind, field, column: df.select(F.lit(kind).alias("type"), k, F.lit(field).alias("field"), F.col(column).alias("value"))
    values = value(c.series, "series", "title", "title").unionByName(value(c.series, "series", "altTitles", "alt_title")).unionByName(value(c.publishers, "publisher", "name", "name"))
    revisions = _revisions(c).select(F.lit("series").alias("type"), F.col("record_id").alias("id"), "seq")
    got = histories.edit_forms(of(c.series, "series").unionByName(of(c.publishers, "publisher")), histories.display(shelf), values, revisions)
    return got.select("type", "id", "title", "status", "locked", F.array_join("overridden", ",").alias("overridden"), "base", F.to_json("fields", {"ignoreNullFields": "false"}).alias("fields"), F.col("link.id").alias("link_id"))


@register(
    "ops_rendered",
    sql("series") + f""", {_REVISIONS}, last AS (SELECT record_id, max(seq) AS latest FROM revs GROUP BY record_id),
    o AS (SELECT o_orderkey // 4 AS p, CAST(o_orderkey % 4 AS INTEGER) AS place FROM orders)
    SELECT p AS proposal_id, place, 'create' AS kind, 'Create new series "T' || p || '"' AS summary, NULL AS record_title, NULL AS base, NULL AS base_comment, NULL AS stale FROM o WHERE place = 0
    UNION ALL SELECT p, place, 'create', 'Create ' || CASE WHEN p % 2 = 0 THEN 'volume "L' || p || '"' ELSE 'an unnumbered volume' END || ' in ' ||
      CASE WHEN p % 4 = 0 THEN CASE WHEN EXISTS (SELECT 1 FROM o q WHERE q.p = o.p AND q.place = 0) THEN 'new series "T' || p || '"' ELSE '"t1"' END WHEN p % 4 = 1 THEN coalesce('series "' || s.title || '"', '(missing)') WHEN p % 4 = 2 THEN '"zz"' ELSE '(unknown)' END, NULL, NULL, NULL, NULL
      FROM o LEFT JOIN series s ON s.id = p % 300 WHERE place = 1
    UNION ALL SELECT p, place, 'update', NULL, coalesce(s.title, '(missing record)'), coalesce(r.seq, 0), CASE WHEN r.seq IS NOT NULL THEN 'r' || r.seq END, s.id IS NULL OR s.status <> 'active' OR s.id % 5 = 0 OR CASE WHEN p % 2 = 0 THEN l.latest ELSE l.latest - 1 END IS DISTINCT FROM l.latest
      FROM o LEFT JOIN series s ON s.id = p % 250 LEFT JOIN last l ON l.record_id = p % 250 LEFT JOIN revs r ON r.record_id = p % 250 AND r.seq = CASE WHEN p % 2 = 0 THEN l.latest ELSE l.latest - 1 END WHERE place = 2
    UNION ALL SELECT p, place, CASE WHEN p % 2 = 0 THEN 'merge' ELSE 'hide' END, CASE WHEN p % 2 = 0 THEN 'Merge series "' || coalesce(a.title, '(missing record)') || '" into series "' || coalesce(b.title, '(missing record)') || '"' ELSE 'Hide series "' || coalesce(a.title, '(missing record)') || '"' END, NULL, NULL, NULL, NULL
      FROM o LEFT JOIN series a ON a.id = p % 230 LEFT JOIN series b ON b.id = p % 270 WHERE place = 3""",
)
def ops_rendered(spark, sf_dir):
    """Four orders are a proposal: a new series, a volume in it or elsewhere, an update, and a merge or a record to hide."""
    c, none = Catalog(spark, sf_dir), F.lit(None)
    revisions = _revisions(c).select(F.lit("series").alias("type"), F.col("record_id").alias("id"), "seq", "comment")
    latest = revisions.groupBy(F.col("id").alias("record_id")).agg(F.max("seq").alias("latest"))
    p, place = F.col("proposal_id"), F.col("place")
    text = p.cast("string")
    rows = c.raw("orders").select(F.expr("o_orderkey div 4").alias("proposal_id"), (F.col("o_orderkey") % 4).cast("int").alias("place"))
    rows = rows.withColumn("record_id", F.when(place == 2, p % 250).when(place == 3, p % 230)).join(latest, "record_id", "left")
    ref = F.when(p % 4 == 0, "t1").when(p % 4 == 1, (p % 300).cast("string")).when(p % 4 == 2, "zz")
    ops = rows.select(
        "proposal_id", "place", F.when(place < 2, "create").when(place == 2, "update").when(p % 2 == 0, "merge").otherwise("hide").alias("kind"), F.when(place == 0, "series").when(place == 1, "volumes").alias("table"),
        F.when(place == 0, "t1").alias("temp_id"), F.when(place == 1, ref).alias("ref"), F.when(place > 1, "series").alias("type"), "record_id", F.when((place == 3) & (p % 2 == 0), p % 270).alias("into_id"),
        F.when(place == 2, F.col("latest") - p % 2).alias("base"), F.when(place == 0, F.concat(F.lit("T"), text)).alias("title"), F.when((place == 1) & (p % 2 == 0), F.concat(F.lit("L"), text)).alias("label"),
        *[none.cast("string").alias(x) for x in ("slug", "format", "binding", "isbn13")], none.cast("int").alias("n_coverage"),
    )
    shown = c.series.select(F.lit("series").alias("type"), "id", "status", "title")
    return histories.rendered(ops, shown, revisions, c.series.where("id % 5 = 0").select(F.lit("series").alias("type"), "id"))
