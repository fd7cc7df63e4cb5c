"""Whole pages of nested rows, as JSON texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.operators import nested
from catalogspark.registry import register
from catalogspark.sources.fixture import Catalog, sql

#: The tables as a shelf: two orders are an edition, regions are lines, lines of one day are variants, four parts a family.
_SHELF = sql("publishers", "series", "releases", "volumes", "bundles", "bundle_members") + """,
n_volumes AS (SELECT id, series_id, position, CASE WHEN (series_id + position) % 7 <> 0 THEN label END AS label,
  CASE WHEN (series_id + position) % 23 = 0 THEN 'merged' WHEN (series_id + position) % 19 = 0 THEN 'hidden' ELSE 'active' END AS status,
  CASE WHEN (series_id + position) % 23 = 0 THEN id + 1 END AS merged_into FROM volumes),
n_editions AS (SELECT l_orderkey // 2 AS id, min(l_suppkey) AS publisher_id, nullif(l_orderkey // 2 % 7, 0) AS line_id, CAST(nullif(l_orderkey // 2 % 5, 0) AS VARCHAR) AS line_position,
  CASE WHEN l_orderkey // 2 % 11 = 0 THEN 'merged' WHEN l_orderkey // 2 % 13 = 0 THEN 'hidden' ELSE 'active' END AS status,
  CASE WHEN l_orderkey // 2 % 11 = 0 THEN l_orderkey // 2 + 1 END AS merged_into FROM lineitem GROUP BY l_orderkey // 2),
n_lines AS (SELECT r_regionkey + 1 AS id, r_name AS name, CASE WHEN r_regionkey = 3 THEN 'hidden' ELSE 'active' END AS status FROM region),
n_releases AS (SELECT id, id // 2 AS edition_id, format, CASE WHEN id % 4 <> 0 THEN '978' || lpad(CAST(id AS VARCHAR), 10, '0') END AS isbn13, CASE WHEN id % 6 = 0 THEN lpad(CAST(id AS VARCHAR), 10, '0') END AS isbn10,
  CASE WHEN id % 9 <> 0 THEN sort END AS sort, price_cents, CASE WHEN id % 5 = 0 THEN 'c' || id END AS cover,
  CASE WHEN id % 19 = 0 THEN 'merged' ELSE status END AS status, CASE WHEN id % 19 = 0 THEN id + 1 END AS merged_into FROM releases),
n_variants AS (SELECT l_orderkey * 10 + l_linenumber AS id, min(l_orderkey) AS release_id, 'V' || l_linenumber AS name,
  CASE WHEN max(l_quantity) > 45 THEN 'hidden' ELSE 'active' END AS status FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_orderkey, l_linenumber),
n_coverage AS (SELECT l_orderkey // 2 AS edition_id, l_partkey * 100 + l_linenumber AS volume_id, min(l_orderkey * 10 + l_linenumber) AS place,
  CASE WHEN bool_and(l_returnflag = 'N') THEN 'complete' ELSE 'partial' END AS extent FROM lineitem GROUP BY ALL),
n_members AS (SELECT bundle_id, release_id, position, CASE WHEN position % 2 = 0 THEN release_id * 10 + 1 END AS variant_id FROM bundle_members),
n_series AS (SELECT *, CASE WHEN id % 3 <> 0 THEN id // 4 END AS family_id FROM series),
n_families AS (SELECT DISTINCT p_partkey // 4 AS id, 'F' || (p_partkey // 4) AS name, CASE WHEN p_partkey // 4 % 5 = 0 THEN 'hidden' ELSE 'active' END AS status FROM part),
n_relations AS (SELECT p_partkey AS id, 'sequel' AS kind, CASE WHEN p_partkey % 4 = 1 THEN p_brand END AS note, p_partkey AS from_id, p_partkey + 1 AS to_id FROM part),
rel AS (SELECT r.id, r.edition_id, r.sort, r.cover, struct_pack(id := r.id, anchor := coalesce(isbn13, isbn10, CAST(r.id AS VARCHAR)), format := format, isbn13 := isbn13, isbn10 := isbn10, sort := r.sort, price_cents := price_cents,
    variants := coalesce((SELECT list(struct_pack(name := v.name) ORDER BY v.id) FROM n_variants v WHERE v.release_id = r.id AND v.status = 'active'), []),
    bundles := coalesce((SELECT list(struct_pack(id := b.id, name := b.name) ORDER BY b.id, m.position) FROM n_members m JOIN bundles b ON b.id = m.bundle_id AND b.status = 'active' WHERE m.release_id = r.id), [])) AS item
  FROM n_releases r WHERE r.status = 'active'),
rels AS (SELECT edition_id, list(item ORDER BY sort NULLS LAST, id) AS releases, arg_min(cover, coalesce(sort, 99999999) * 10000000000 + id) FILTER (cover IS NOT NULL) AS cover, arg_min(cover, id) FILTER (cover IS NOT NULL) AS early FROM rel GROUP BY edition_id),
cov AS (SELECT c.edition_id, c.place, c.extent, v.id AS volume_id, v.position, v.label, s.id AS series_id, CASE WHEN s.status = 'active' THEN s.title END AS series_title
  FROM n_coverage c JOIN n_volumes v ON v.id = c.volume_id AND v.status = 'active' LEFT JOIN n_series s ON s.id = v.series_id),
covs AS (SELECT edition_id, list(struct_pack(volume_id := volume_id, position := position, label := label, extent := extent) ORDER BY place, volume_id) AS on_series,
  list(struct_pack(volume_id := volume_id, position := position, label := label, title := series_title || coalesce(' Vol ' || label, ''), extent := extent, series := struct_pack(id := series_id, title := series_title)) ORDER BY place, volume_id)
    FILTER (series_title IS NOT NULL) AS coverage FROM cov GROUP BY edition_id),
eds_all AS (SELECT e.id, e.status, e.line_position, l.name AS line_name, c.coverage, coalesce(c.coverage, []) AS shown, coalesce(c.on_series, []) AS on_series, coalesce(r.releases, []) AS releases, r.cover, r.early,
    CASE WHEN p.id IS NOT NULL THEN struct_pack(name := p.name, slug := p.slug) END AS any_publisher, CASE WHEN p.status = 'active' THEN struct_pack(name := p.name, slug := p.slug) END AS publisher,
    coalesce(c.coverage[1].series.title, 'Edition') || CASE WHEN l.name IS NOT NULL THEN ' ' || l.name || coalesce(' ' || e.line_position, '')
      WHEN c.coverage IS NULL THEN '' WHEN len(c.coverage) = 1 THEN coalesce(' Vol ' || c.coverage[1].label, '')
      ELSE ' Vol ' || coalesce(c.coverage[1].label, CAST(c.coverage[1].position AS VARCHAR)) || '–' || coalesce(c.coverage[-1].label, CAST(c.coverage[-1].position AS VARCHAR)) END AS title
  FROM n_editions e LEFT JOIN n_lines l ON l.id = e.line_id AND l.status = 'active' LEFT JOIN publishers p ON p.id = e.publisher_id LEFT JOIN rels r ON r.edition_id = e.id LEFT JOIN covs c ON c.edition_id = e.id),
eds AS (SELECT * EXCLUDE (status) FROM eds_all WHERE status = 'active')
"""


def _ends(table: str) -> str:
    """Survivors of a table whose merged ids point at the next one, which never is merged itself, or chains of them."""
    return f"""(WITH RECURSIVE chase(id, here) AS (SELECT id, id FROM {table} UNION ALL SELECT c.id, t.merged_into FROM chase c JOIN {table} t ON t.id = c.here WHERE t.status = 'merged')
      SELECT c.id AS requested_id, c.here AS id FROM chase c JOIN {table} t ON t.id = c.here WHERE t.status = 'active')"""


def _shelf(c: Catalog) -> nested.Shelf:
    line, order = c.raw("lineitem"), F.col("l_orderkey")
    book = F.expr("l_orderkey div 2")
    place = F.col("series_id") + F.col("position")
    volumes = c.volumes.select(
        "id", "series_id", "position", F.when(place % 7 != 0, F.col("label")).alias("label"),
        F.when(place % 23 == 0, "merged").when(place % 19 == 0, "hidden").otherwise("active").alias("status"), F.when(place % 23 == 0, F.col("id") + 1).alias("merged_into"),
    )
    k = F.col("id")
    editions = line.groupBy(book.alias("id")).agg(F.min("l_suppkey").alias("publisher_id")).select(
        "id", "publisher_id", F.nullif(k % 7, F.lit(0)).alias("line_id"), F.nullif(k % 5, F.lit(0)).cast("string").alias("line_position"),
        F.when(k % 11 == 0, "merged").when(k % 13 == 0, "hidden").otherwise("active").alias("status"), F.when(k % 11 == 0, k + 1).alias("merged_into"),
    )
    lines = c.raw("region").select((F.col("r_regionkey") + 1).alias("id"), F.col("r_name").alias("name"), F.when(F.col("r_regionkey") == 3, "hidden").otherwise("active").alias("status"))
    ten = F.lpad(k.cast("string"), 10, "0")
    releases = c.releases.select(
        "id", F.expr("id div 2").alias("edition_id"), "format", F.when(k % 4 != 0, F.concat(F.lit("978"), ten)).alias("isbn13"), F.when(k % 6 == 0, ten).alias("isbn10"),
        F.when(k % 9 != 0, F.col("sort")).alias("sort"), "price_cents", F.when(k % 5 == 0, F.concat(F.lit("c"), k.cast("string"))).alias("cover"),
        F.when(k % 19 == 0, "merged").otherwise(F.col("status")).alias("status"), F.when(k % 19 == 0, k + 1).alias("merged_into"),
    )
    variants = line.where("l_returnflag = 'A'").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("most")).select(
        (order * 10 + F.col("l_linenumber")).alias("id"), order.alias("release_id"), F.concat(F.lit("V"), F.col("l_linenumber").cast("string")).alias("name"), F.when(F.col("most") > 45, "hidden").otherwise("active").alias("status"),
    )
    volume = (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("volume_id")
    extent = F.when(F.bool_and(F.col("l_returnflag") == "N"), "complete").otherwise("partial")
    coverage = line.groupBy(book.alias("edition_id"), volume).agg(F.min(order * 10 + F.col("l_linenumber")).alias("place"), extent.alias("extent"))
    members = c.bundle_members.select("bundle_id", "release_id", "position", F.when(F.col("position") % 2 == 0, F.col("release_id") * 10 + 1).alias("variant_id"))
    part, key = c.raw("part"), F.col("p_partkey")
    family = F.expr("p_partkey div 4")
    families = part.select(family.alias("id")).distinct().select("id", F.concat(F.lit("F"), k.cast("string")).alias("name"), F.when(k % 5 == 0, "hidden").otherwise("active").alias("status"))
    relations = part.select(key.alias("id"), F.lit("sequel").alias("kind"), F.when(key % 4 == 1, F.col("p_brand")).alias("note"), key.alias("from_id"), (key + 1).alias("to_id"))
    series = c.series.withColumn("family_id", F.when(k % 3 != 0, F.expr("id div 4")))
    return nested.Shelf(series, volumes, editions, lines, releases, variants, c.publishers, c.bundles, coverage, members, families, relations)


def _json(pages: DataFrame) -> DataFrame:
    page = F.struct(*[c for c in pages.columns if c != "id"])
    return pages.select("id", F.to_json(page, {"ignoreNullFields": "false"}).alias("page"))


@register(
    "edition_pages",
    _SHELF + f"""SELECT requested_id, e.id, CAST(to_json(struct_pack(title := title, publisher := publisher, line_name := line_name, line_position := line_position,
      series := (SELECT coalesce(list(s ORDER BY n), []) FROM (SELECT s, min(n) AS n FROM (SELECT unnest(shown).series AS s, generate_subscripts(shown, 1) AS n) GROUP BY s)),
      coverage := shown, releases := releases, cover := cover)) AS VARCHAR) AS page FROM eds e JOIN {_ends("n_editions")} t ON t.id = e.id""",
)
def edition_pages(spark, sf_dir):
    s = _shelf(Catalog(spark, sf_dir))
    return nested.requested(_json(nested.edition_pages(s)), s.editions)


_COVERING = """covering AS (SELECT c.volume_id, c.extent, e.*, row_number() OVER (PARTITION BY c.volume_id ORDER BY CASE WHEN e.cover IS NULL THEN 1 ELSE 0 END, e.id) AS r FROM n_coverage c JOIN eds e ON e.id = c.edition_id)"""


@register(
    "volume_pages",
    _SHELF + f""", {_COVERING},
    grouped AS (SELECT volume_id, list(struct_pack(id := id, title := title, publisher := publisher, line_name := line_name, line_position := line_position, extent := extent, coverage := shown, releases := releases) ORDER BY id) AS editions,
      max(CASE WHEN r = 1 THEN cover END) AS cover FROM covering GROUP BY volume_id)
    SELECT requested_id, v.id, CAST(to_json(struct_pack(position := v.position, label := v.label, title := s.title || coalesce(' Vol ' || v.label, ''), series := struct_pack(id := s.id, title := s.title),
      editions := coalesce(g.editions, []), cover := g.cover)) AS VARCHAR) AS page
    FROM n_volumes v JOIN n_series s ON s.id = v.series_id AND s.status = 'active' LEFT JOIN grouped g ON g.volume_id = v.id JOIN {_ends("n_volumes")} t ON t.id = v.id WHERE v.status = 'active'""",
)
def volume_pages(spark, sf_dir):
    s = _shelf(Catalog(spark, sf_dir))
    return nested.requested(_json(nested.volume_pages(s)), s.volumes)


@register(
    "series_pages",
    _SHELF + f""", {_COVERING},
    grouped AS (SELECT volume_id, list(struct_pack(id := id, publisher := any_publisher, line_name := line_name, line_position := line_position, extent := extent, coverage := on_series, releases := releases) ORDER BY id) AS editions,
      max(CASE WHEN r = 1 THEN early END) AS early FROM covering GROUP BY volume_id),
    shown_volumes AS (SELECT v.series_id, list(struct_pack(id := v.id, position := v.position, label := v.label, editions := coalesce(g.editions, [])) ORDER BY v.position, v.id) AS volumes, arg_min(g.early, v.position) FILTER (g.early IS NOT NULL) AS cover
      FROM n_volumes v LEFT JOIN grouped g ON g.volume_id = v.id WHERE v.status = 'active' GROUP BY v.series_id),
    kin AS (SELECT s.id, f.id AS family_id, f.name, s.title FROM n_series s JOIN n_families f ON f.id = s.family_id AND f.status = 'active' WHERE s.status = 'active'),
    groups AS (SELECT family_id, name, list(struct_pack(id := id, title := title) ORDER BY id) AS members FROM kin GROUP BY ALL HAVING count(*) > 1),
    edges AS (SELECT r.id, r.from_id, r.to_id, struct_pack(kind := kind, note := note, "from" := struct_pack(id := a.id, title := a.title), "to" := struct_pack(id := b.id, title := b.title)) AS item
      FROM n_relations r JOIN kin a ON a.id = r.from_id JOIN kin b ON b.id = r.to_id AND b.family_id = a.family_id),
    related AS (SELECT of, list(item ORDER BY way, id) AS relations FROM (SELECT from_id AS of, 0 AS way, id, item FROM edges UNION ALL SELECT to_id, 1, id, item FROM edges) GROUP BY of)
    SELECT requested_id, s.id, CAST(to_json(struct_pack(title := s.title, family := CASE WHEN g.family_id IS NOT NULL THEN struct_pack(name := g.name, members := g.members, relations := coalesce(r.relations, [])) END,
      volumes := coalesce(v.volumes, []), cover := v.cover)) AS VARCHAR) AS page
    FROM n_series s LEFT JOIN kin k ON k.id = s.id LEFT JOIN groups g ON g.family_id = k.family_id LEFT JOIN related r ON r.of = s.id LEFT JOIN shown_volumes v ON v.series_id = s.id
    JOIN {_ends("n_series")} t ON t.id = s.id WHERE s.status = 'active'""",
)
def series_pages(spark, sf_dir):
    s = _shelf(Catalog(spark, sf_dir))
    return nested.requested(_json(nested.series_pages(s)), s.series)


@register(
    "bundle_pages",
    _SHELF + f""", ends_r AS {_ends("n_releases")}, ends_e AS {_ends("n_editions")},
    held AS (SELECT m.bundle_id, list(struct_pack(position := m.position, edition := struct_pack(id := e.id, title := e.title), anchor := coalesce(r.isbn13, r.isbn10, CAST(r.id AS VARCHAR)), format := r.format, isbn13 := r.isbn13, sort := r.sort,
        variant := CASE WHEN v.id IS NOT NULL THEN struct_pack(name := v.name) END) ORDER BY m.position, m.release_id) AS members
      FROM n_members m JOIN ends_r tr ON tr.requested_id = m.release_id JOIN n_releases r ON r.id = tr.id JOIN ends_e te ON te.requested_id = r.edition_id JOIN eds e ON e.id = te.id
      LEFT JOIN n_variants v ON v.id = m.variant_id AND v.status = 'active' GROUP BY m.bundle_id)
    SELECT b.id AS requested_id, b.id, CAST(to_json(struct_pack(name := b.name, members := coalesce(h.members, []))) AS VARCHAR) AS page FROM bundles b LEFT JOIN held h ON h.bundle_id = b.id WHERE b.status = 'active'""",
)
def bundle_pages(spark, sf_dir):
    s = _shelf(Catalog(spark, sf_dir))
    return nested.requested(_json(nested.bundle_pages(s)), s.bundles.withColumn("merged_into", F.lit(None).cast("int")))
