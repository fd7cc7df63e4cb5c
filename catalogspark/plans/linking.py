"""Lines as a source's facts, linked to series and releases."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogspark.operators import linking
from catalogspark.plans.matching import NORM
from catalogspark.plans.nested import _SHELF, _shelf
from catalogspark.registry import register
from catalogspark.sources.fixture import Catalog


@register(
    "releases_linked",
    _SHELF + f""", live_keys AS (SELECT DISTINCT id, key FROM (SELECT id, {NORM.format("title")} AS key FROM series WHERE status = 'active' UNION ALL SELECT id, {NORM.format("alt_title")} FROM series WHERE status = 'active') WHERE key <> ''),
    counted AS (SELECT key, count(*) AS n, min(id) AS id FROM live_keys GROUP BY key),
    entries AS (SELECT p_partkey AS entry_id, CASE p_partkey % 5 WHEN 0 THEN '?!' WHEN 1 THEN upper(p_name) || ' ' || p_brand ELSE p_name || '  ' || p_brand || ' (x) ' || p_type END AS title, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS linked_id FROM part),
    owned AS (SELECT e.entry_id, CASE WHEN s.id IS NOT NULL THEN 'stored' WHEN e.linked_id IS NOT NULL THEN 'gone' WHEN c.n = 1 THEN 'title' WHEN c.n > 1 THEN 'ambiguous' ELSE 'none' END AS how,
      CASE WHEN s.id IS NOT NULL THEN s.id WHEN e.linked_id IS NULL AND c.n = 1 THEN c.id END AS series_id
      FROM entries e LEFT JOIN series s ON s.id = e.linked_id AND s.status = 'active' LEFT JOIN counted c ON c.key = {NORM.format("e.title")}),
    facts AS (SELECT DISTINCT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS fact_id, l_partkey AS entry_id, CASE WHEN (l_partkey + l_linenumber) % 7 <> 0 THEN ' ' || l_linenumber || '.0' END AS label,
      CASE WHEN l_orderkey % 3 = 0 THEN 'digital' ELSE 'physical' END AS format, l_linenumber = 6 AS multi, CASE WHEN l_orderkey % 7 = 0 THEN l_orderkey END AS linked_id FROM lineitem),
    single AS (SELECT edition_id, min(volume_id) AS volume_id FROM n_coverage GROUP BY edition_id HAVING count(*) = 1),
    cand AS (SELECT v.series_id, v.label, r.format, count(*) AS n, min(r.id) AS id FROM n_releases r JOIN n_editions e ON e.id = r.edition_id AND e.status = 'active' JOIN single s ON s.edition_id = e.id
      JOIN n_volumes v ON v.id = s.volume_id AND v.status = 'active' WHERE r.status = 'active' AND r.id % 8 <> 3 GROUP BY ALL),
    told AS (SELECT f.fact_id, o.how, r.id AS stored_id, c.id AS found_id, CASE WHEN o.series_id IS NULL THEN 'unlinked' WHEN r.id IS NOT NULL THEN 'stored' WHEN f.linked_id IS NOT NULL THEN 'held' WHEN f.multi THEN 'skipped'
        WHEN c.n = 1 THEN 'one' WHEN c.n > 1 THEN 'many' ELSE 'none' END AS kind
      FROM facts f JOIN owned o ON o.entry_id = f.entry_id LEFT JOIN n_releases r ON r.id = f.linked_id AND r.status = 'active' AND r.id % 8 <> 3
      LEFT JOIN cand c ON c.series_id = o.series_id AND c.format = f.format AND CAST(c.label AS DOUBLE) IS NOT DISTINCT FROM CAST(trim(f.label) AS DOUBLE))
    SELECT fact_id, how, kind, CASE kind WHEN 'stored' THEN stored_id WHEN 'one' THEN found_id END AS release_id FROM told""",
)
def releases_linked(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    key, line, order, part = F.col("p_partkey"), F.col("l_linenumber"), F.col("l_orderkey"), F.col("l_partkey")
    title = F.when(key % 5 == 0, "?!").when(key % 5 == 1, F.concat_ws(" ", F.upper("p_name"), "p_brand")).otherwise(F.concat("p_name", F.lit("  "), "p_brand", F.lit(" (x) "), "p_type"))
    entries = c.raw("part").select(key.alias("entry_id"), title.alias("title"), F.when(key % 2 == 0, key).alias("linked_id"))
    label = F.when((part + line) % 7 != 0, F.concat(F.lit(" "), line.cast("string"), F.lit(".0")))
    facts = c.raw("lineitem").select(
        ((order * 10 + line) * 1000000 + part).alias("fact_id"), part.alias("entry_id"), label.alias("label"), F.when(order % 3 == 0, "digital").otherwise("physical").alias("format"), (line == 6).alias("multi"),
        F.when(order % 7 == 0, order).alias("linked_id"),
    ).distinct()
    shelf = _shelf(c)
    return linking.releases_of(facts, entries, shelf, shelf.releases.where("id % 8 = 3"))
