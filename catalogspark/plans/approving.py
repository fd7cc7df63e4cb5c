"""Approval of a plan for each order: a series of its own or a known one, a volume, an edition, a release, and for some an edit."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogspark.operators import approving
from catalogspark.registry import register
from catalogspark.sources.fixture import Catalog

_LAST = {"series": 10**6, "volumes": 10**7, "editions": 10**8, "releases": 10**9}
_OUTCOMES = """WITH o AS (SELECT o_orderkey AS p, o_custkey AS part, o_custkey % 4 <> 0 AS open, o_orderkey % 5 = 0 AS edits,
      array_to_string(list_filter([CASE WHEN o_orderkey % 7 = 0 THEN 'badFormat' END, CASE WHEN o_orderkey % 2 = 1 AND o_custkey % 11 = 0 THEN 'badReference' END, CASE WHEN o_orderkey % 3 = 2 THEN 'unknownPublisher' END], lambda x: x IS NOT NULL), ',') AS bad FROM orders),
    s AS (SELECT *, edits AND (part % 11 = 0 OR part % 13 = 0 OR p % 25 = 0) AS stale FROM o),
    w AS (SELECT *, edits AND open AND NOT stale AND bad = '' AS races FROM s),
    r AS (SELECT *, min(p) FILTER (races) OVER (PARTITION BY part) AS first FROM w),
    told AS (SELECT *, CASE WHEN NOT open THEN 'badState' WHEN stale THEN 'stale' WHEN bad <> '' THEN 'invalid' WHEN races AND p <> first THEN 'stale' ELSE 'approved' END AS outcome FROM r)
"""


def _approved(spark, sf_dir):
    c, cat = F.col, Catalog(spark, sf_dir)
    o = cat.raw("orders").select(c("o_orderkey").alias("p"), c("o_custkey").alias("part"))
    p, part, text = c("p"), c("part"), "string"
    none, nothing = F.lit(None), F.create_map().cast("map<string,string>")
    refs = lambda *x: F.array(*x).cast("array<string>")

    def op(place, kind, table, temp, of, publisher, fields, record=none, base=none):
        return F.struct(
            F.lit(place).alias("place"), F.lit(kind).alias("kind"), F.lit(table).alias("table"), F.lit(temp).cast(text).alias("temp_id"), of.alias("refs"), F.transform(of, lambda _: F.lit("complete")).alias("extents"), publisher.cast(text).alias("publisher"),
            fields.cast("map<string,string>").alias("fields"), record.cast("bigint").alias("record_id"), base.cast("int").alias("base"),
        )

    own = p % 2 == 0
    format_ = F.when(p % 7 == 0, "paper").when(own, "digital").otherwise("physical")
    title = F.create_map(F.lit("title"), F.concat(F.lit("T"), p))
    latest = F.when(part % 3 != 0, part % 3)
    ops = F.array(
        F.when(own, op(0, "create", "series", "s", refs(), none, title)), op(1, "create", "volumes", "v", F.when(own, refs(F.lit("s"))).otherwise(refs(part)), none, nothing),
        op(2, "create", "editions", "e", refs(F.lit("v")), F.concat(F.lit("p"), p % 3), nothing), op(3, "create", "releases", "r", refs(F.lit("e")), none, F.create_map(F.lit("format"), format_, F.lit("language"), F.lit("en"))),
        F.when(p % 5 == 0, op(4, "update", "series", None, refs(), none, title, part, F.when(p % 25 == 0, 9).otherwise(latest))),
    )
    ops = o.select(p.alias("proposal_id"), F.inline(F.array_compact(ops)))
    proposals = o.select(p.alias("proposal_id"), p.alias("rank"), F.when(part % 4 == 0, "draft").otherwise("inReview").alias("state"))
    parts = cat.raw("part").select(c("p_partkey").alias("id"))
    records = parts.select(F.lit("series").alias("table"), "id", F.when(c("id") % 11 == 0, "hidden").otherwise("active").alias("status"), (c("id") % 13 == 0).alias("locked"))
    revisions = parts.where("id % 3 <> 0").select(F.lit("series").alias("table"), c("id").alias("record_id"), (c("id") % 3).cast("int").alias("seq"))
    publishers = spark.createDataFrame([(1, "p0", "active"), (2, "p1", "active"), (3, "p2", "hidden")], "id bigint, slug string, status string")
    volumes = parts.where("id % 4 > 0").select((c("id") + 5_000_000).alias("id"), c("id").alias("series_id"), (c("id") % 4).cast("int").alias("position"))
    of = parts.limit(0).select(c("id").alias("edition_id"), c("id").alias("series_id"), c("id").alias("publisher_id"))
    return approving.approve(proposals, ops, records, revisions, publishers, volumes, of, _LAST)


@register("plans_approved", _OUTCOMES + "SELECT p AS proposal_id, outcome, CASE WHEN outcome = 'invalid' THEN bad END AS problem FROM told")
def plans_approved(spark, sf_dir):
    return _approved(spark, sf_dir)["outcomes"]


@register(
    "plans_applied",
    _OUTCOMES + f""", a AS (SELECT *, row_number() OVER (ORDER BY p) AS n FROM told WHERE outcome = 'approved'),
    own AS (SELECT p, {_LAST["series"]} + row_number() OVER (ORDER BY p) AS id FROM a WHERE p % 2 = 0),
    v AS (SELECT a.*, coalesce(own.id, part) AS series_id FROM a LEFT JOIN own USING (p)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY p) + CASE WHEN p % 2 = 1 THEN part % 4 ELSE 0 END AS position FROM v)
    SELECT 'series' AS kind, id, p AS proposal_id, CAST(NULL AS BIGINT) AS parent, 'T' || p AS name FROM own
    UNION ALL SELECT 'volumes', {_LAST["volumes"]} + n, p, series_id, CAST(position AS VARCHAR) FROM placed
    UNION ALL SELECT 'editions', {_LAST["editions"]} + n, p, p % 3 + 1, 'complete' FROM a
    UNION ALL SELECT 'releases', {_LAST["releases"]} + n, p, {_LAST["editions"]} + n, CAST(series_id AS VARCHAR) FROM v
    UNION ALL SELECT 'patch', part, p, NULL, 'T' || p FROM a WHERE edits
    UNION ALL SELECT 'revision', part, p, CAST(CASE WHEN part % 3 = 0 THEN 1 ELSE part % 3 + 1 END AS BIGINT), 'title' FROM a WHERE edits
    UNION ALL SELECT 'revision', {_LAST["series"]} + row_number() OVER (ORDER BY p), p, 1, 'title' FROM a WHERE p % 2 = 0
    UNION ALL SELECT 'revision', {_LAST["volumes"]} + n, p, 1, '' FROM a UNION ALL SELECT 'revision', {_LAST["editions"]} + n, p, 1, '' FROM a
    UNION ALL SELECT 'revision', {_LAST["releases"]} + n, p, 1, 'format,language' FROM a""",
)
def plans_applied(spark, sf_dir):
    c, got = F.col, _approved(spark, sf_dir)
    row = lambda kind, df, id_, parent, name: df.select(F.lit(kind).alias("kind"), id_.cast("bigint").alias("id"), "proposal_id", parent.cast("bigint").alias("parent"), name.cast("string").alias("name"))
    none = F.lit(None)
    covered = got["editions"].hint("merge").join(got["coverage"].groupBy(c("edition_id").alias("id")).agg(F.min("extent").alias("extent")), "id")
    parts = [
        row("series", got["series"], c("id"), none, c("fields")["title"]), row("volumes", got["volumes"], c("id"), c("series_id"), c("position")), row("editions", covered, c("id"), c("publisher_id"), c("extent")),
        row("releases", got["releases"], c("id"), c("edition_id"), F.array_join(F.transform("series_ids", lambda x: x.cast("string")), ",")), row("patch", got["patches"], c("record_id"), none, c("value")),
        row("revision", got["revisions"], c("record_id"), c("seq"), c("fields")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
