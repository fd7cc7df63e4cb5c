"""Calendar, pages, counts and paths."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.functions import codes, dates, titles
from catalogspark.operators import browse, indexes, lookup, tables
from catalogspark.registry import register
from catalogspark.sources.fixture import Catalog, sql

YEAR, MONTH, TODAY = 1998, 6, 19980615

_DATE_SQL = """CASE WHEN month IS NULL THEN CAST(year AS VARCHAR)
  WHEN day IS NULL THEN (['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'])[month] || ' ' || year
  ELSE (['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'])[month] || ' ' || day || ', ' || year END"""
_PRICE_SQL = "'$' || (price_cents // 100) || '.' || lpad(CAST(price_cents % 100 AS VARCHAR), 2, '0')"
_ROWS_SQL = sql("publishers", "series", "releases", "release_series", "volumes", "coverage") + f""",
named AS (SELECT release_id, min(series_id) AS first_series_id, string_agg(title, '; ' ORDER BY series_id) AS series_titles
  FROM release_series JOIN series ON series.id = series_id AND status = 'active' GROUP BY release_id),
label_lists AS (SELECT c.release_id, list(v.label ORDER BY c.series_id, c.position) AS labels, bool_or(extent = 'partial') AS part
  FROM coverage c JOIN volumes v ON v.id = c.volume_id GROUP BY c.release_id),
label_texts AS (SELECT release_id, (CASE WHEN len(labels) = 1 THEN 'Vol. ' || labels[1] ELSE 'Vol. ' || labels[1] || '–' || labels[len(labels)] END)
  || CASE WHEN part THEN ' (partial)' ELSE '' END AS label FROM label_lists),
release_rows AS (SELECT r.id AS release_id, r.format, r.sort, r.day, {_DATE_SQL} AS date_text, {_PRICE_SQL} AS price_text, p.name AS publisher,
    first_series_id, series_titles, coalesce(label, '') AS label, r.status
  FROM releases r JOIN named n ON n.release_id = r.id LEFT JOIN label_texts l ON l.release_id = r.id
  LEFT JOIN publishers p ON p.id = r.publisher_id AND p.status = 'active')
"""
_IN_MONTH = f"status = 'active' AND sort BETWEEN {YEAR * 10000 + MONTH * 100} AND {YEAR * 10000 + MONTH * 100 + 99}"


def _month_rows(c: Catalog, format: str | None = None) -> DataFrame:
    return browse.release_rows(browse.month_window(c.releases_of_month(YEAR, MONTH), YEAR, MONTH, format), c.series, c.release_series, c.coverage, c.volumes, c.publishers)


@register("month_calendar", _ROWS_SQL + f"SELECT * EXCLUDE (status) FROM release_rows WHERE {_IN_MONTH} ORDER BY sort, series_titles COLLATE en, label, release_id")
def month_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _month_rows(Catalog(spark, sf_dir)).orderBy("sort", titles.title_order("series_titles"), "label", "release_id")


@register("month_calendar_physical", _ROWS_SQL + f"SELECT * EXCLUDE (status) FROM release_rows WHERE {_IN_MONTH} AND format = 'physical'")
def month_calendar_physical(spark, sf_dir):
    return _month_rows(Catalog(spark, sf_dir), "physical")


@register(
    "agenda_by_day",
    _ROWS_SQL + f"""SELECT day, string_agg(CASE WHEN rank <= 3 THEN CAST(release_id AS VARCHAR) END, ',' ORDER BY rank) AS shown, greatest(count(*) - 3, 0) AS more
    FROM (SELECT coalesce(day, 0) AS day, release_id, row_number() OVER (PARTITION BY coalesce(day, 0) ORDER BY series_titles COLLATE en, label, release_id) AS rank
          FROM release_rows WHERE {_IN_MONTH}) GROUP BY day""",
)
def agenda_by_day(spark, sf_dir):
    return browse.by_day(_month_rows(Catalog(spark, sf_dir)), 3)


_UPCOMING = f"(sort >= {TODAY // 100 * 100} AND (sort >= {TODAY} OR day IS NULL))"


@register(
    "publisher_lane",
    sql("releases") + f"""SELECT publisher_id, id AS release_id, sort, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY publisher_id ORDER BY sort, id) AS rank FROM releases
    WHERE status = 'active' AND publisher_id IS NOT NULL AND {_UPCOMING}) WHERE rank <= 12""",
)
def publisher_lane(spark, sf_dir):
    return browse.upcoming_lane(Catalog(spark, sf_dir).releases, TODAY, 12)


@register(
    "publisher_facts",
    sql("publishers", "releases", "release_series") + """SELECT p.id, p.slug, count(DISTINCT r.id) AS releases, count(DISTINCT s.series_id) AS series, min(r.sort) AS first_sort, max(r.sort) AS last_sort
    FROM publishers p LEFT JOIN releases r ON r.publisher_id = p.id AND r.status = 'active' LEFT JOIN release_series s ON s.release_id = r.id
    WHERE p.status = 'active' GROUP BY p.id, p.slug""",
)
def publisher_facts(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    active = c.releases.where("status = 'active'").select(F.col("id").alias("release_id"), "publisher_id", "sort")
    own = active.groupBy("publisher_id").agg(F.count(F.lit(1)).alias("releases"), F.min("sort").alias("first_sort"), F.max("sort").alias("last_sort"))
    wide = active.join(c.release_series, "release_id").select("publisher_id", "series_id").distinct().groupBy("publisher_id").agg(F.count(F.lit(1)).alias("series"))
    house = c.publishers.where("status = 'active'").select(F.col("id").alias("publisher_id"), "slug")
    zero = F.lit(0).cast("bigint")
    out = house.join(own, "publisher_id", "left").join(wide, "publisher_id", "left")
    return out.select(F.col("publisher_id").alias("id"), "slug", F.coalesce("releases", zero).alias("releases"), F.coalesce("series", zero).alias("series"), "first_sort", "last_sort")


@register(
    "catalog_stats",
    sql("publishers", "series", "releases") + """SELECT 'publishers' AS entity, count(*) AS n, count(*) FILTER (status = 'active') AS active FROM publishers
    UNION ALL SELECT 'series', count(*), count(*) FILTER (status = 'active') FROM series
    UNION ALL SELECT 'releases', count(*), count(*) FILTER (status = 'active') FROM releases""",
)
def catalog_stats(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    rows = [df.agg(F.lit(n).alias("entity"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "active").alias("active")) for n, df in (("publishers", c.publishers), ("series", c.series), ("releases", c.releases))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@register(
    "catalog_stats_capped",
    sql("series", "releases") + """SELECT 'series' AS entity, count(*) FILTER (status = 'active') AS active, count(*) > 1000 AS capped FROM (SELECT * FROM series ORDER BY id LIMIT 1001)
    UNION ALL SELECT 'releases', count(*) FILTER (status = 'active'), count(*) > 1000 FROM (SELECT * FROM releases ORDER BY id LIMIT 1001)""",
)
def catalog_stats_capped(spark, sf_dir):
    """Counts over the first 1,001 records in key order, as a paged reader would report them: the cap is the feature."""
    c = Catalog(spark, sf_dir)
    one = lambda n, df: df.orderBy("id").limit(1001).agg(F.lit(n).alias("entity"), F.count_if(F.col("status") == "active").alias("active"), (F.count(F.lit(1)) > 1000).alias("capped"))
    return one("series", c.series).unionByName(one("releases", c.releases.select("id", "status")))


_NORM = "trim(regexp_replace(regexp_replace(lower({}), '\\(.*?\\)', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@register(
    "series_search",
    sql("series") + f"""SELECT id, CAST(score AS INTEGER) AS score FROM (
    SELECT id, len(list_intersect(string_split({_NORM.format("title || ' ' || alt_title")}, ' '), ['brand', 'lemon', 'promo', 'steel'])) AS score FROM series WHERE status = 'active')
    WHERE score > 0 ORDER BY score DESC, id LIMIT 40""",
)
def series_search(spark, sf_dir):
    return browse.search(Catalog(spark, sf_dir).series.where("status = 'active'"), ["title", "alt_title"], "Promo steel brand lemon", 40)


_PREFIX_SCORE = "CAST(list_contains(words, 'lemon') AS INTEGER) + CAST(list_contains(words, 'brand') AS INTEGER) + CAST(len(list_filter(words, lambda w: starts_with(w, 'st'))) > 0 AS INTEGER)"


@register(
    "series_search_indexed",
    sql("series") + f"""SELECT id, score FROM (SELECT id, {_PREFIX_SCORE} AS score FROM (SELECT id, string_split({_NORM.format("title || ' ' || alt_title")}, ' ') AS words FROM series WHERE status = 'active'))
    WHERE score > 0 ORDER BY score DESC, id LIMIT 40""",
)
def series_search_indexed(spark, sf_dir):
    """The first 40 hits (a page is the feature) of two words and the beginning of a third, from an index made of all series."""
    folder = f"{tables.shared_folder(spark)}/tables/postings-{uuid.uuid4().hex}"
    indexes.write_postings(Catalog(spark, sf_dir).series.where("status = 'active'"), ["title", "alt_title"], folder)
    return indexes.search(spark, folder, "Lemon brand st", 40)


@register("month_window_pruned", sql("releases") + f"SELECT id, sort, format, publisher_id FROM releases WHERE {_IN_MONTH}")
def month_window_pruned(spark, sf_dir):
    """A month of releases that are stored by date: the scan skips the files and row groups of other months."""
    folder = f"{tables.shared_folder(spark)}/tables/by-date-{uuid.uuid4().hex}"
    indexes.write_by_date(Catalog(spark, sf_dir).releases, folder)
    return indexes.month(spark, folder, YEAR, MONTH).select("id", "sort", "format", "publisher_id")


@register("publisher_search", sql("publishers") + "SELECT id, name FROM publishers WHERE status = 'active' AND contains(lower(name), '00000001')")
def publisher_search(spark, sf_dir):
    return Catalog(spark, sf_dir).publishers.where("status = 'active'").where(F.lower("name").contains("00000001")).select("id", "name")


@register(
    "series_reading_path",
    sql("series", "volumes", "coverage", "releases") + """SELECT v.series_id, v.position, v.label, count(DISTINCT r.id) AS editions,
    count(DISTINCT CASE WHEN c.extent = 'complete' THEN r.id END) AS complete_editions, min(r.sort) AS first_sort
    FROM series s JOIN volumes v ON v.series_id = s.id LEFT JOIN coverage c ON c.volume_id = v.id
    LEFT JOIN releases r ON r.id = c.release_id AND r.status = 'active' WHERE s.status = 'active' GROUP BY ALL""",
)
def series_reading_path(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    live = c.releases.where("status = 'active'").select(F.col("id").alias("release_id"), "sort")
    facts = c.coverage.join(live, "release_id").groupBy("volume_id").agg(F.count(F.lit(1)).alias("editions"), F.count_if(F.col("extent") == "complete").alias("complete_editions"), F.min("sort").alias("first_sort"))
    rows = c.volumes.join(c.series.where("status = 'active'").select(F.col("id").alias("series_id")), "series_id")
    zero = F.lit(0).cast("bigint")
    out = rows.join(facts.withColumnRenamed("volume_id", "id"), "id", "left")
    return out.select("series_id", "position", "label", F.coalesce("editions", zero).alias("editions"), F.coalesce("complete_editions", zero).alias("complete_editions"), "first_sort")


@register(
    "edition_titles",
    sql("series", "volumes", "coverage") + """SELECT release_id, t[1] || CASE WHEN n = 1 THEN ' Vol ' || l[1] ELSE ' Vol ' || l[1] || '–' || l[n] END AS edition_title
    FROM (SELECT c.release_id, list(s.title ORDER BY c.series_id, c.position) AS t, list(v.label ORDER BY c.series_id, c.position) AS l, count(*) AS n
      FROM coverage c JOIN volumes v ON v.id = c.volume_id JOIN series s ON s.id = v.series_id AND s.status = 'active' GROUP BY c.release_id)""",
)
def edition_titles(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    rows = c.coverage.join(c.volumes.select(F.col("id").alias("volume_id"), "label"), "volume_id").join(c.series.where("status = 'active'").select(F.col("id").alias("series_id"), "title"), "series_id")
    covered = rows.groupBy("release_id").agg(F.sort_array(F.collect_list(F.struct("series_id", "position", "label", "title"))).alias("covered"))
    none = F.lit(None).cast("string")
    return covered.select("release_id", titles.edition_title(F.col("covered")[0]["title"], none, none, "covered").alias("edition_title"))


@register(
    "volume_page_rows",
    sql("series", "volumes", "coverage", "releases", "publishers") + f"""SELECT v.id AS volume_id, r.id AS release_id, c.extent, r.sort, p.name AS publisher, r.format,
    CAST(row_number() OVER (PARTITION BY v.id ORDER BY r.sort NULLS LAST, r.id) AS INTEGER) AS place
    FROM volumes v JOIN series s ON s.id = v.series_id AND s.status = 'active' JOIN coverage c ON c.volume_id = v.id
    JOIN releases r ON r.id = c.release_id AND r.status = 'active' LEFT JOIN publishers p ON p.id = r.publisher_id AND p.status = 'active'""",
)
def volume_page_rows(spark, sf_dir):
    from pyspark.sql import Window

    c = Catalog(spark, sf_dir)
    live = c.releases.where("status = 'active'").select(F.col("id").alias("release_id"), "sort", "format", "publisher_id")
    rows = c.coverage.join(c.series.where("status = 'active'").select(F.col("id").alias("series_id")), "series_id").join(live, "release_id")
    rows = rows.join(c.publishers.where("status = 'active'").select(F.col("id").alias("publisher_id"), F.col("name").alias("publisher")), "publisher_id", "left")
    place = F.row_number().over(Window.partitionBy("volume_id").orderBy(F.asc_nulls_last("sort"), "release_id"))
    return rows.select("volume_id", "release_id", "extent", "sort", "publisher", "format", place.alias("place"))


@register(
    "edition_series",
    sql("coverage") + "SELECT release_id, string_agg(CAST(series_id AS VARCHAR), ',' ORDER BY series_id) AS series_ids, count(*) AS n FROM (SELECT DISTINCT release_id, series_id FROM coverage) GROUP BY release_id",
)
def edition_series(spark, sf_dir):
    rows = Catalog(spark, sf_dir).coverage.groupBy("release_id").agg(F.sort_array(F.collect_set("series_id")).alias("ids"))
    return rows.select("release_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("series_ids"), F.size("ids").cast("bigint").alias("n"))


@register(
    "bundle_members",
    sql("bundles", "bundle_members", "releases") + """SELECT b.id AS bundle_id, b.name, m.position, r.id AS release_id, r.format, r.sort
    FROM bundles b JOIN bundle_members m ON m.bundle_id = b.id JOIN releases r ON r.id = m.release_id AND r.status = 'active' WHERE b.status = 'active'""",
)
def bundle_members(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    live = c.releases.where("status = 'active'").select(F.col("id").alias("release_id"), "format", "sort")
    rows = c.bundle_members.join(c.bundles.where("status = 'active'").select(F.col("id").alias("bundle_id"), "name"), "bundle_id").join(live, "release_id")
    return rows.select("bundle_id", "name", "position", "release_id", "format", "sort")


_CODE12 = "'978' || lpad(CAST(p_partkey AS VARCHAR), 9, '0')"
_SUM = " + ".join(f"CAST(substr(t, {i + 1}, 1) AS INTEGER) * {3 if i % 2 else 1}" for i in range(12))


@register(
    "isbn_check_digits",
    f"""SELECT p_partkey AS id, t || CAST((10 - s % 10) % 10 AS VARCHAR) AS isbn13, true AS valid, false AS off_by_one_valid, true AS dashed_valid
    FROM (SELECT p_partkey, t, {_SUM} AS s FROM (SELECT p_partkey, {_CODE12} AS t FROM part))""",
)
def isbn_check_digits(spark, sf_dir):
    part = Catalog(spark, sf_dir).raw("part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("978"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("t"))
    total = sum((F.substring("t", i + 1, 1).cast("int") * (3 if i % 2 else 1) for i in range(12)), F.lit(0))
    rows = part.select("id", "t", F.pmod(10 - total % 10, F.lit(10)).alias("check"))
    code = F.concat("t", F.col("check").cast("string"))
    wrong = F.concat("t", ((F.col("check") + 1) % 10).cast("string"))
    dashed = F.concat(F.substring(code, 1, 3), F.lit("-"), F.substring(code, 4, 10))
    return rows.select("id", code.alias("isbn13"), codes.valid_isbn13(code).alias("valid"), codes.valid_isbn13(wrong).alias("off_by_one_valid"), codes.normalize_isbn(dashed).isNotNull().alias("dashed_valid"))


_CODE = "'978' || lpad(CAST(id % 900 AS VARCHAR), 10, '0')"


@register(
    "isbn_lookup",
    sql("releases", "bundles") + f""", wanted AS (SELECT '978' || lpad(CAST(i * 7 AS VARCHAR), 10, '0') AS code FROM range(300) t(i)),
    hits AS (SELECT w.code, 'release' AS kind, 1 AS priority, r.id FROM wanted w JOIN releases r ON {_CODE.replace('id', 'r.id')} = w.code AND r.status = 'active'
    UNION ALL SELECT w.code, 'bundle', 2, b.id FROM wanted w JOIN bundles b ON '978' || lpad(CAST(b.id * 70 AS VARCHAR), 10, '0') = w.code AND b.status = 'active')
    SELECT code, kind, id FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY priority, id) AS r FROM hits) WHERE r = 1""",
)
def isbn_lookup(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    code = lambda x: F.concat(F.lit("978"), F.lpad(x.cast("string"), 10, "0"))
    wanted = spark.range(300).select(code(F.col("id") * 7).alias("code"))
    releases = c.releases.where("status = 'active'").select(code(F.col("id") % 900).alias("code"), F.col("id").cast("bigint").alias("id"))
    bundles = c.bundles.where("status = 'active'").select(code(F.col("id") * 70).alias("code"), F.col("id").cast("bigint").alias("id"))
    return browse.isbn_hits(wanted, releases, bundles)


@register("merge_chain_resolve", sql("survivors") + "SELECT id, survivor_id, CAST(depth AS INTEGER) AS depth FROM survivors")
def merge_chain_resolve(spark, sf_dir):
    return lookup.survivors(Catalog(spark, sf_dir).series)


@register(
    "slug_paths",
    sql("series") + r"""SELECT id, '/series/' || id || '/' || CASE WHEN slug = '' THEN 'untitled' ELSE slug END AS path
    FROM (SELECT id, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM series)""",
)
def slug_paths(spark, sf_dir):
    return Catalog(spark, sf_dir).series.select("id", codes.path("series", "id", codes.slug_ascii("title")).alias("path"))


@register(
    "slug_resolution",
    sql("publishers") + """SELECT w.slug, coalesce(p.id, q.id) AS id, p.id IS NULL AS redirected
    FROM (SELECT slug FROM publishers UNION ALL SELECT 'old-' || slug FROM publishers WHERE id % 5 = 0) w
    LEFT JOIN publishers p ON p.slug = w.slug LEFT JOIN publishers q ON 'old-' || q.slug = w.slug AND q.id % 5 = 0""",
)
def slug_resolution(spark, sf_dir):
    p = Catalog(spark, sf_dir).publishers
    redirects = p.where("id % 5 = 0").select(F.concat(F.lit("old-"), "slug").alias("slug"), F.col("id").alias("to"))
    wanted = p.select("slug").union(redirects.select("slug"))
    return wanted.join(p.select("slug", "id"), "slug", "left").join(redirects, "slug", "left").select("slug", F.coalesce("id", "to").alias("id"), F.col("id").isNull().alias("redirected"))


@register(
    "sitemap_lastmod",
    sql("series") + """SELECT s.id, strftime(coalesce(max(l.l_shipdate), TIMESTAMP '1990-01-01'), '%Y-%m-%d') AS lastmod
    FROM series s LEFT JOIN lineitem l ON l.l_partkey = s.id WHERE s.status = 'active' GROUP BY s.id""",
)
def sitemap_lastmod(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    edits = c.raw("lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.max("l_shipdate").alias("at"))
    rows = c.series.where("status = 'active'").join(edits, "id", "left")
    return rows.select("id", F.coalesce(F.date_format("at", "yyyy-MM-dd"), F.lit("1990-01-01")).alias("lastmod"))


@register(
    "sitemap_urlset",
    sql("series") + r"""SELECT id // 200 AS page, '<urlset>' || string_agg('<url><loc>/series/' || id || '/' || replace(replace(title, '&', '&amp;'), '<', '&lt;') || '</loc></url>', '' ORDER BY id) || '</urlset>' AS xml
    FROM series WHERE status = 'active' GROUP BY 1""",
)
def sitemap_urlset(spark, sf_dir):
    from catalogspark.functions import markup

    rows = Catalog(spark, sf_dir).series.where("status = 'active'")
    url = F.concat(F.lit("<url><loc>/series/"), F.col("id").cast("string"), F.lit("/"), markup.xml_escape(F.col("title")), F.lit("</loc></url>"))
    # a page holds 200 ids at most
    page = rows.groupBy(F.expr("id div 200").alias("page")).agg(F.array_sort(F.collect_list(F.struct("id", url.alias("u")))).alias("urls"))
    return page.select("page", F.concat(F.lit("<urlset>"), F.array_join(F.transform("urls", lambda x: x["u"]), ""), F.lit("</urlset>")).alias("xml"))


@register(
    "sitemap_month_range",
    sql("releases") + """SELECT min(sort) // 10000 AS first_year, greatest(min(sort) // 100 % 100, 1) AS first_month, max(sort) // 10000 AS last_year,
    CASE WHEN max(sort) // 100 % 100 = 0 THEN 12 ELSE max(sort) // 100 % 100 END AS last_month FROM releases WHERE status = 'active' AND sort > 0""",
)
def sitemap_month_range(spark, sf_dir):
    r = Catalog(spark, sf_dir).releases.where("status = 'active' AND sort > 0").agg(F.min("sort").alias("lo"), F.max("sort").alias("hi"))
    month = lambda c: F.expr(f"{c} div 100 % 100").cast("int")
    return r.select(F.expr("lo div 10000").cast("int").alias("first_year"), F.greatest(month("lo"), F.lit(1)).alias("first_month"), F.expr("hi div 10000").cast("int").alias("last_year"), F.when(month("hi") == 0, 12).otherwise(month("hi")).alias("last_month"))


@register(
    "month_sequence",
    sql("releases") + """, bounds AS (SELECT min(sort) // 10000 * 12 + greatest(min(sort) // 100 % 100, 1) - 1 AS lo, max(sort) // 10000 * 12 + CASE WHEN max(sort) // 100 % 100 = 0 THEN 12 ELSE max(sort) // 100 % 100 END - 1 AS hi
    FROM releases WHERE status = 'active')
    SELECT CAST(i // 12 AS INTEGER) AS year, CAST(i % 12 + 1 AS INTEGER) AS month FROM (SELECT unnest(range(lo, hi + 1)) AS i FROM bounds)""",
)
def month_sequence(spark, sf_dir):
    r = Catalog(spark, sf_dir).releases.where("status = 'active'").agg(F.min("sort").alias("lo"), F.max("sort").alias("hi"))
    lo = F.expr("lo div 10000 * 12") + F.greatest(F.expr("lo div 100 % 100"), F.lit(1)) - 1
    m = F.expr("hi div 100 % 100")
    hi = F.expr("hi div 10000 * 12") + F.when(m == 0, 12).otherwise(m) - 1
    return r.select(F.explode(F.sequence(lo, hi)).alias("i")).select(dates.add_months("i", 0).alias("x")).select("x.year", "x.month")


@register("partial_date_format", sql("releases") + f"""SELECT id, {_DATE_SQL} AS text, CASE WHEN month IS NULL THEN lpad(CAST(year AS VARCHAR), 4, '0') WHEN day IS NULL THEN year || '-' || lpad(CAST(month AS VARCHAR), 2, '0')
    ELSE year || '-' || lpad(CAST(month AS VARCHAR), 2, '0') || '-' || lpad(CAST(day AS VARCHAR), 2, '0') END AS iso FROM releases""")
def partial_date_format(spark, sf_dir):
    return Catalog(spark, sf_dir).releases.select("id", dates.display("year", "month", "day").alias("text"), dates.iso("year", "month", "day").alias("iso"))


@register("price_format", sql("releases") + f"SELECT id, CASE WHEN id % 4 = 0 THEN substr({_PRICE_SQL}, 2) || ' EUR' ELSE {_PRICE_SQL} END AS price FROM releases")
def price_format(spark, sf_dir):
    return Catalog(spark, sf_dir).releases.select("id", codes.price("price_cents", F.when(F.col("id") % 4 == 0, "EUR").otherwise("USD")).alias("price"))


@register("possibly_future", sql("releases") + "SELECT id, year * 10000 + coalesce(month, 12) * 100 + coalesce(day, 31) > 19980615 AS future FROM releases")
def possibly_future(spark, sf_dir):
    return Catalog(spark, sf_dir).releases.select("id", dates.possibly_future("year", "month", "day", TODAY).alias("future"))


@register(
    "duplicate_isbns",
    sql("releases") + "SELECT id % 900 AS code, count(*) AS n, min(id) AS first_id FROM releases WHERE status = 'active' GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, code LIMIT 10",
)
def duplicate_isbns(spark, sf_dir):
    rows = Catalog(spark, sf_dir).releases.where("status = 'active'").groupBy((F.col("id") % 900).alias("code")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    return rows.where("n > 1").orderBy(F.desc("n"), "code").limit(10)


@register("prominent_series", sql("releases", "release_series", "series") + """SELECT s.id, s.title, count(*) AS releases FROM release_series x JOIN releases r ON r.id = x.release_id AND r.status = 'active'
    JOIN series s ON s.id = x.series_id AND s.status = 'active' GROUP BY ALL ORDER BY releases DESC, s.id LIMIT 50""")
def prominent_series(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    counts = c.release_series.join(c.releases.where("status = 'active'").select(F.col("id").alias("release_id")), "release_id", "left_semi").groupBy("series_id").agg(F.count(F.lit(1)).alias("releases"))
    live = c.series.where("status = 'active'").select("id", "title")
    return live.join(counts, F.col("id") == F.col("series_id")).select("id", "title", "releases").orderBy(F.desc("releases"), "id").limit(50)
