"""Batches of facts: line items on their way into a catalog that knows half of the parts as series."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogspark.functions import titles
from catalogspark.operators import importing, matching
from catalogspark.registry import register
from catalogspark.sources.fixture import Catalog

_LAST = {"publishers": 2, "series": 10**7, "volumes": 10**10, "editions": 10**10, "releases": 10**10}
#: Stored: links of parts that leave 0 or 1 over four; of those that leave 0 two volumes with a printed release each. Label 7 is a packaging of the first two volumes.
_FACTS = """WITH facts AS (SELECT DISTINCT ((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber AS fact_id, l_partkey AS part, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber % 4 + 1 END AS label,
      'p' || l_suppkey % 3 AS pub, CASE WHEN l_orderkey % 2 = 0 THEN 'digital' ELSE 'physical' END AS format, l_partkey % 4 = 0 AND l_orderkey % 10 = 0 AS coded, l_suppkey % 7 = 0 AS hint, l_partkey % 4 > 1 AS unlinked, l_orderkey % 13 = 0 AS handled FROM lineitem),
    told AS (SELECT *, part % 4 = 0 AND label <= 2 AS known, 'p' || part % 3 AS had FROM facts),
    ladder AS (SELECT *, CASE WHEN coded THEN 'match' WHEN known AND pub <> had THEN 'review' WHEN known AND format = 'physical' THEN 'match' ELSE 'create' END AS stored FROM told),
    base AS (SELECT *, stored = 'create' AND ({can}) AS can FROM ladder),
    owner AS (SELECT part, label, min(fact_id) FILTER (NOT multi) AS s1, arg_min(pub, fact_id) FILTER (NOT multi) AS p1, min(fact_id) FILTER (multi) AS several
      FROM (SELECT fact_id, part, label, pub, false AS multi FROM base WHERE can AND label IS NOT NULL UNION ALL SELECT fact_id, part, u, pub, true FROM base, (SELECT unnest([1, 2]) AS u) WHERE can AND label IS NULL) GROUP BY part, label),
    maker AS (SELECT b.part, b.label, pub, format, min(fact_id) AS maker FROM base b JOIN owner o ON o.part = b.part AND o.label = b.label WHERE can AND pub = p1 AND (several IS NULL OR fact_id < several) AND (several IS NULL OR s1 < several) GROUP BY ALL),
    seen AS (SELECT b.*, coalesce(maker < fact_id, false) AS strict, maker, coalesce(s1 < fact_id AND b.pub <> p1 AND (several IS NULL OR s1 < several), false) OR coalesce(several < fact_id, false) AS loose
      FROM base b LEFT JOIN owner o ON o.part = b.part AND o.label = b.label LEFT JOIN maker m ON m.part = b.part AND m.label = b.label AND m.pub = b.pub AND m.format = b.format),
    planned AS (SELECT *, CASE WHEN stored = 'match' THEN 'link' WHEN stored = 'review' THEN 'review' WHEN strict THEN 'link' WHEN loose THEN 'review' WHEN can THEN 'create' ELSE 'queue' END AS final FROM seen)
"""
_GATES = """array_to_string(list_filter([CASE WHEN unlinked THEN 'a brand-new Series' END, CASE WHEN label IS NULL THEN 'multi-Volume Coverage' END,
      CASE WHEN hint THEN 'an Edition Line (deluxe/omnibus/box-set packaging)' END], lambda x: x IS NOT NULL), '; ')"""


def _planned(spark, sf_dir, bootstrap, keep):
    c, cat = F.col, Catalog(spark, sf_dir)
    part = cat.raw("part").select(c("p_partkey").alias("id"), F.concat(F.lit("Title "), "p_partkey").alias("title"))
    code = lambda x: F.concat(F.lit("c"), x * 10 + 1)
    line = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    record = F.concat_ws("-", *line).alias("record_id")

    def facts(rows, *more):
        """Facts of line items: texts are made where they are needed, and four numbers travel in their place."""
        return rows.select(
            (((c("l_orderkey") * 100000 + c("l_partkey")) * 10000 + c("l_suppkey")) * 10 + c("l_linenumber")).alias("fact_id"), F.lit("s").alias("source_key"),
            record, c("l_partkey").cast("string").alias("series_key"), F.concat(F.lit("Title "), "l_partkey").alias("title"),
            F.when(c("l_linenumber") == 7, F.array(F.lit("1"), F.lit("2"))).otherwise(F.array((c("l_linenumber") % 4 + 1).cast("string"))).alias("labels"), F.when(c("l_suppkey") % 7 == 0, "x (Deluxe)").alias("full_title"),
            F.concat(F.lit("p"), c("l_suppkey") % 3).alias("publisher"), F.when(c("l_orderkey") % 2 == 0, "digital").otherwise("physical").alias("format"),
            F.when((c("l_partkey") % 4 == 0) & (c("l_orderkey") % 10 == 0), code(c("l_partkey"))).alias("code"), *more,
        )

    stored = part.where("id % 4 = 0").select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("position"))
    releases = stored.select((c("id") * 10 + c("position")).alias("release_id"), c("id").alias("series_id"), "title", "position", F.concat(F.lit("p"), c("id") % 3).alias("publisher_id"))
    by_code = matching.first_of_code(releases.where("position = 1").select("release_id", code(c("series_id")).alias("code"), F.lit("active").alias("status")), releases.select("release_id", F.array("title").alias("titles")))
    known = releases.select("release_id", titles.normalize_title("title").alias("key"), titles.label_key(c("position").cast("string")).alias("label_key"), "publisher_id", F.lit("physical").alias("format"), F.lit(True).alias("single"), F.lit(False).alias("blocked"))
    multi = F.size("labels") > 1
    offered = facts(cat.raw("lineitem").select(*line).distinct(), *line)
    offered = offered.select("fact_id", "code", "title", titles.normalize_title("title").alias("key"), titles.label_key(F.when(~multi, F.get("labels", F.lit(0)))).alias("label_key"), c("publisher").alias("publisher_id"), "format", multi.alias("multi"), *line)
    told = facts(matching.match_ladder(offered, by_code, known, tuple(line)), "rung", "outcome", "release_id").withColumn("known_code", c("code").isNotNull())
    links = part.where("id % 4 < 2").select(F.lit("s").alias("source_key"), c("id").cast("string").alias("series_key"), c("id").alias("series_id"))
    keys = part.where("id % 4 < 2").select("id", titles.normalize_title("title").alias("key"))
    handled = cat.raw("lineitem").where("l_orderkey % 13 = 0").select(F.lit("s").alias("source_key"), record)
    return importing.plan_told(told, links, keys, releases.select("release_id", "series_id"), handled, bootstrap, keep), releases


@register(
    "import_planned",
    _FACTS.replace("{can}", "NOT unlinked AND label IS NOT NULL AND NOT hint") + f"""SELECT fact_id, CASE WHEN final IN ('review', 'queue') AND handled THEN 'alreadyQueued' ELSE final END AS outcome,
      CAST(CASE WHEN coded THEN 2 WHEN stored = 'match' THEN 3 WHEN stored = 'review' THEN 4 WHEN strict THEN 3 WHEN loose THEN 4 ELSE 5 END AS INTEGER) AS rung,
      CASE WHEN stored = 'match' THEN part * 10 + CASE WHEN coded THEN 1 ELSE label END END AS release_id, CASE WHEN stored = 'create' AND strict THEN maker END AS maker,
      CASE WHEN final IN ('create', 'queue') THEN {_GATES} ELSE '' END AS gates FROM planned""",
)
def import_planned(spark, sf_dir):
    """What becomes of every line item with the gates up: linked series alone get new releases."""
    return _planned(spark, sf_dir, False, ["fact_id"])[0].select("fact_id", "outcome", "rung", "release_id", "maker", "gates")


@register(
    "import_created",
    _FACTS.replace("{can}", "true") + f""", made AS (SELECT *, CASE WHEN label IS NULL THEN '1,2' ELSE CAST(label AS VARCHAR) END AS labels FROM planned WHERE final = 'create'),
    publishers AS (SELECT pub, min(fact_id) AS maker, {_LAST["publishers"] + 1} AS id FROM made WHERE pub = 'p2' GROUP BY pub),
    series AS (SELECT part, min(fact_id) AS maker, {_LAST["series"]} + row_number() OVER (ORDER BY min(fact_id)) AS id FROM made WHERE unlinked GROUP BY part),
    named AS (SELECT part, v, min(fact_id) AS maker FROM (SELECT part, fact_id, CAST(unnest(string_split(labels, ',')) AS INTEGER) AS v FROM made) WHERE NOT (part % 4 = 0 AND v <= 2) GROUP BY part, v),
    volumes AS (SELECT n.part, v, n.maker, {_LAST["volumes"]} + row_number() OVER (ORDER BY n.maker, v) AS id FROM named n),
    editions AS (SELECT part, pub, labels, min(fact_id) AS maker, {_LAST["editions"]} + row_number() OVER (ORDER BY min(fact_id)) AS id FROM made WHERE NOT (part % 4 = 0 AND labels IN ('1', '2') AND pub = had) GROUP BY ALL)
    SELECT 'publisher' AS kind, id, maker, CAST(NULL AS BIGINT) AS parent, 'p2' AS name FROM publishers
    UNION ALL SELECT 'series', id, maker, NULL, 'Title ' || part FROM series
    UNION ALL SELECT 'volume', v.id, v.maker, coalesce(s.id, v.part), CAST(v.v AS VARCHAR) FROM volumes v LEFT JOIN series s USING (part)
    UNION ALL SELECT 'edition', id, maker, CAST(pub[2] AS BIGINT) + 1, NULL FROM editions
    UNION ALL SELECT 'release', {_LAST["releases"]} + row_number() OVER (ORDER BY fact_id), fact_id, coalesce(e.id, m.part * 10 + label), m.format
      FROM made m LEFT JOIN editions e ON e.part = m.part AND e.pub = m.pub AND e.labels = m.labels""",
)
def import_created(spark, sf_dir):
    """The rows that all line items make with the gates lifted."""
    c = F.col
    planned, stored = _planned(spark, sf_dir, True, ["fact_id", "source_key", "series_key", "title", "labels", "publisher", "format"])
    volumes = stored.select((c("series_id") * 100 + c("position")).alias("id"), "series_id", c("position").cast("string").alias("label"), "position", F.lit("active").alias("status"))
    editions = stored.select(c("release_id").alias("id"), (F.substring("publisher_id", 2, 1).cast("bigint") + 1).alias("publisher_id"), F.lit("active").alias("status"), F.lit(False).alias("locked"), F.lit(None).cast("int").alias("line_id"))
    coverage = stored.select(c("release_id").alias("edition_id"), (c("series_id") * 100 + c("position")).alias("volume_id"), F.lit(1).alias("position"), F.lit("complete").alias("extent"))
    publishers = spark.createDataFrame([(1, "p0"), (2, "p1")], "id bigint, slug string")
    new = importing.create(planned, volumes, editions, coverage, publishers, _LAST)
    none = F.lit(None)
    row = lambda kind, table, parent, name: new[table].select(F.lit(kind).alias("kind"), c("id").cast("bigint"), "maker", parent.cast("bigint").alias("parent"), name.cast("string").alias("name"))
    out = row("publisher", "publishers", none, c("slug")).unionByName(row("series", "series", none, c("title"))).unionByName(row("volume", "volumes", c("series_id"), c("label")))
    return out.unionByName(row("edition", "editions", c("publisher_id"), none)).unionByName(row("release", "releases", c("edition_id"), c("format")))


@register(
    "import_queue",
    _FACTS.replace("{can}", "NOT unlinked AND label IS NOT NULL AND NOT hint") + """, q AS (SELECT fact_id, part, unlinked, label IS NULL AS multi FROM planned WHERE final IN ('review', 'queue') AND NOT handled),
    ops AS (SELECT fact_id, 0 AS o, 'series' AS "table", 'series' AS temp_id, '' AS refs FROM q WHERE unlinked UNION ALL SELECT fact_id, 1, 'volumes', 'volume-1', CASE WHEN unlinked THEN 'series' ELSE CAST(part AS VARCHAR) END FROM q
      UNION ALL SELECT fact_id, 2, 'volumes', 'volume-2', CASE WHEN unlinked THEN 'series' ELSE CAST(part AS VARCHAR) END FROM q WHERE multi
      UNION ALL SELECT fact_id, 3, 'editions', 'edition', CASE WHEN multi THEN 'volume-1,volume-2' ELSE 'volume-1' END FROM q UNION ALL SELECT fact_id, 4, 'releases', 'release', 'edition' FROM q)
    SELECT fact_id, CAST(row_number() OVER (PARTITION BY fact_id ORDER BY o) - 1 AS INTEGER) AS place, "table", temp_id, refs FROM ops""",
)
def import_queue(spark, sf_dir):
    """The plans that line items put before a moderator."""
    return importing.queued_ops(_planned(spark, sf_dir, False, ["fact_id", "labels"])[0]).withColumn("refs", F.array_join("refs", ","))
