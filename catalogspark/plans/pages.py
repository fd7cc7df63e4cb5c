"""What pages show: titles, month parameters, slugs, ids, names, structured data."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalogspark.functions import codes, dates, markup, titles
from catalogspark.operators import reconcile
from catalogspark.registry import register
from catalogspark.sources.fixture import Catalog, sql

SITE = "Catalog"


@register(
    "page_titles",
    sql("publishers", "series") + f"""SELECT 'series' AS kind, id, title || ' – English Manga Volumes & Release Dates | {SITE}' AS tag FROM series
    UNION ALL SELECT 'volume', p_partkey, CASE WHEN p_size % 5 = 0 THEN p_name ELSE p_name || ' Vol ' || p_size END || ' – English Editions & Release Dates | {SITE}' FROM part
    UNION ALL SELECT 'edition', p_partkey, p_name || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' (' || p_brand || ')' END || ' – ISBN & Release Date | {SITE}' FROM part
    UNION ALL SELECT 'bundle', p_partkey, p_name || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' (' || p_brand || ')' END || ' – Box Set ISBN & Release Date | {SITE}' FROM part
    UNION ALL SELECT 'publisher', id, name || ' – Manga Releases & Upcoming Books | {SITE}' FROM publishers
    UNION ALL SELECT 'month', CAST(y * 100 + m AS BIGINT), 'English Manga Releases – ' || strftime(make_date(y, m, 1), '%B %Y') || ' | {SITE}' FROM (SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m FROM orders)""",
)
def page_titles(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    part = c.raw("part").select(F.col("p_partkey").alias("id"), "p_name", titles.volume_title("p_name", F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("string"))).alias("volume"), F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("by"))
    month = c.raw("orders").select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).distinct()
    row = lambda df, kind, id_, tag: df.select(F.lit(kind).alias("kind"), id_.cast("bigint").alias("id"), tag.alias("tag"))
    out = row(c.series, "series", F.col("id"), titles.page_title("series", "title", SITE))
    for more in (
        row(part, "volume", F.col("id"), titles.page_title("volume", "volume", SITE)),
        row(part, "edition", F.col("id"), titles.page_title("edition", "p_name", SITE, "by")),
        row(part, "bundle", F.col("id"), titles.page_title("bundle", "p_name", SITE, "by")),
        row(c.publishers, "publisher", F.col("id"), titles.page_title("publisher", "name", SITE)),
        row(month, "month", F.col("y") * 100 + F.col("m"), titles.page_title("month", dates.month_title("y", "m"), SITE)),
    ):
        out = out.unionByName(more)
    return out


@register(
    "month_parameters",
    """WITH raw AS (SELECT DISTINCT CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') WHEN 1 THEN strftime(o_orderdate, '%Y-%-m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '0%y-%m') END AS text FROM orders
      UNION ALL VALUES ('0999-01'), ('2031-13'), ('2031-00'), ('2031-02'), ('2032-02'), (''), ('x')),
    parsed AS (SELECT DISTINCT text, CAST(left(text, 4) AS INTEGER) AS y, CAST(right(text, 2) AS INTEGER) AS m FROM raw WHERE regexp_full_match(text, '[1-9][0-9]{3}-(0[1-9]|1[0-2])'))
    SELECT r.text, y AS year, m AS month, p.text AS param, CAST((y * 12 + m + 15 - 1 - (y * 12 + m + 15 - 1) % 12) / 12 AS INTEGER) AS later_year, CAST((y * 12 + m - 1 + 15) % 12 + 1 AS INTEGER) AS later_month,
      CAST(day(last_day(make_date(y, m, 1))) AS INTEGER) AS days, CAST(dayofweek(make_date(y, m, 1)) AS INTEGER) AS first_weekday, y * 10000 + m * 100 + 99 AS month_end, strftime(make_date(y, m, 1), '%B %Y') AS title
    FROM raw r LEFT JOIN parsed p ON p.text = r.text""",
)
def month_parameters(spark, sf_dir):
    o, k = Catalog(spark, sf_dir).raw("orders"), F.col("o_orderkey") % 4
    day = F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(day, "yyyy-MM")).when(k == 1, F.date_format(day, "yyyy-M")).when(k == 2, F.date_format(day, "yyyy-MM-dd")).otherwise(F.concat(F.lit("0"), F.date_format(day, "yy-MM")))
    odd = spark.createDataFrame([(x,) for x in ("0999-01", "2031-13", "2031-00", "2031-02", "2032-02", "", "x")], "text string")
    rows = o.select(text.alias("text")).distinct().unionByName(odd).withColumn("m", dates.parse_month("text"))
    y, m = F.col("m.year"), F.col("m.month")
    later = dates.add_months(y * 12 + m - 1, 15)
    some = lambda c: F.when(F.col("m").isNotNull(), c)
    return rows.select(
        "text", y.alias("year"), m.alias("month"), some(dates.month_param(y, m)).alias("param"), some(later["year"]).alias("later_year"), some(later["month"]).alias("later_month"),
        dates.days_in_month(y, m).alias("days"), dates.first_weekday(y, m).alias("first_weekday"), (y * 10000 + m * 100 + 99).alias("month_end"), dates.month_title(y, m).alias("title"),
    )


@register("day_keys", "SELECT event_id, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS day_key, CAST(year(ts) * 12 + month(ts) - 1 AS INTEGER) AS month_index FROM events")
def day_keys(spark, sf_dir):
    return Catalog(spark, sf_dir).raw("events").select("event_id", dates.day_key("ts").alias("day_key"), (F.year("ts") * 12 + F.month("ts") - 1).alias("month_index"))


@register(
    "descriptions_cut",
    """WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents), h AS (SELECT *, left(t, 159) AS head, 159 - strpos(reverse(left(t, 159)), ' ') AS blank FROM t)
    SELECT doc_id, CASE WHEN length(t) <= 160 THEN t ELSE rtrim(CASE WHEN contains(head, ' ') AND blank > 80 THEN left(head, blank) ELSE head END) || '…' END AS cut FROM h""",
)
def descriptions_cut(spark, sf_dir):
    return Catalog(spark, sf_dir).raw("documents").select("doc_id", markup.truncate("text", 160).alias("cut"))


@register("slugs_without_accents", "SELECT doc_id, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug FROM (SELECT doc_id, trim(regexp_replace(lower(strip_accents(source || ' é ' || text)), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM documents)")
def slugs_without_accents(spark, sf_dir):
    """Of all texts; SQL folds accents but no compatibility forms, which these tables don't hold and a test does."""
    return Catalog(spark, sf_dir).raw("documents").select("doc_id", codes.slugify(F.concat("source", F.lit(" é "), "text")).alias("slug"))


_IDS = "CASE o_orderkey % 6 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN '0' WHEN 2 THEN '-' || o_orderkey WHEN 3 THEN o_orderkey || 'x' WHEN 4 THEN '1' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') ELSE '00' || o_orderkey END"


@register("public_ids_parsed", f"SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN nullif(o_orderkey, 0) WHEN 5 THEN o_orderkey END AS public_id FROM (SELECT o_orderkey, {_IDS} AS text FROM orders)")
def public_ids_parsed(spark, sf_dir):
    k = F.col("o_orderkey")
    s = k.cast("string")
    text = F.when(k % 6 == 0, s).when(k % 6 == 1, "0").when(k % 6 == 2, F.concat(F.lit("-"), s)).when(k % 6 == 3, F.concat(s, F.lit("x"))).when(k % 6 == 4, F.concat(F.lit("1"), F.lpad(s, 12, "0"))).otherwise(F.concat(F.lit("00"), s))
    return Catalog(spark, sf_dir).raw("orders").select(k.alias("id"), codes.public_id(text).alias("public_id"))


_RESERVED = "', '".join([*codes.RESERVED, SITE.lower()])
_NAMES = f"""names AS (SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN ' Reader_' || c_custkey || ' ' WHEN 1 THEN 'ADMIN' WHEN 2 THEN '_x' || c_custkey WHEN 3 THEN 'ab' WHEN 4 THEN repeat('x', 21) WHEN 5 THEN 'Name' || c_custkey % 50 ELSE 'catalog' END AS name FROM customer),
  checked AS (SELECT id, name, lower(trim(name)) AS normalized, CASE WHEN length(trim(name)) NOT BETWEEN 3 AND 20 OR NOT regexp_full_match(trim(name), '[A-Za-z0-9][A-Za-z0-9_]*') THEN 'invalid' WHEN lower(trim(name)) IN ('{_RESERVED}') THEN 'reserved' END AS problem FROM names)"""


def _checked_names(spark, sf_dir):
    k = F.col("c_custkey")
    name = (
        F.when(k % 7 == 0, F.concat(F.lit(" Reader_"), k, F.lit(" "))).when(k % 7 == 1, "ADMIN").when(k % 7 == 2, F.concat(F.lit("_x"), k)).when(k % 7 == 3, "ab")
        .when(k % 7 == 4, "x" * 21).when(k % 7 == 5, F.concat(F.lit("Name"), k % 50)).otherwise("catalog")
    )
    rows = Catalog(spark, sf_dir).raw("customer").select(k.alias("id"), name.alias("name")).withColumn("normalized", codes.normalize_username("name"))
    return rows.withColumn("problem", codes.username_problem("name", "normalized", SITE.lower()))


@register("usernames_checked", f"WITH {_NAMES} SELECT id, normalized, problem FROM checked")
def usernames_checked(spark, sf_dir):
    return _checked_names(spark, sf_dir).select("id", "normalized", "problem")


@register("usernames_claimed", f"WITH {_NAMES} SELECT id, name, CASE WHEN problem IS NOT NULL THEN problem WHEN min(id) OVER (PARTITION BY normalized) < id THEN 'taken' END AS problem FROM checked")
def usernames_claimed(spark, sf_dir):
    """The first claim of a normalised name has it; a wrong name claims nothing. The least id is pre-aggregated, so a wanted name is no hot group."""
    rows = _checked_names(spark, sf_dir)
    first = rows.where("problem IS NULL").groupBy("normalized").agg(F.min("id").alias("first_id"))
    return rows.join(first, "normalized", "left").select("id", "name", F.coalesce("problem", F.when(F.col("first_id") < F.col("id"), "taken")).alias("problem"))


@register(
    "isbn10_checks",
    """WITH d AS (SELECT p_partkey AS id, lpad(CAST(p_partkey * 7919 AS VARCHAR), 9, '0') AS nine FROM part), s AS (SELECT *, list_sum(list_transform(range(1, 10), lambda i: CAST(substr(nine, CAST(i AS BIGINT), 1) AS INTEGER) * (11 - i))) AS total FROM d),
    c AS (SELECT id, nine, CAST((11 - total % 11) % 11 AS INTEGER) AS digit FROM s)
    SELECT id, nine || CASE WHEN id % 3 = 0 THEN '0' WHEN digit = 10 THEN 'X' ELSE CAST(digit AS VARCHAR) END AS code, id % 3 <> 0 OR digit = 0 AS valid FROM c""",
)
def isbn10_checks(spark, sf_dir):
    p = Catalog(spark, sf_dir).raw("part").select(F.col("p_partkey").alias("id"), F.lpad((F.col("p_partkey") * 7919).cast("string"), 9, "0").alias("nine"))
    total = sum((F.substring("nine", i, 1).cast("int") * (11 - i) for i in range(1, 10)), F.lit(0))
    digit = (11 - total % 11) % 11
    code = F.concat("nine", F.when(F.col("id") % 3 == 0, "0").when(digit == 10, "X").otherwise(digit.cast("string")))
    return p.select("id", code.alias("code")).withColumn("valid", codes.valid_isbn10("code"))


@register(
    "partial_dates_degraded",
    """WITH t AS (SELECT o_orderkey AS id, year(o_orderdate) AS y, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE month(o_orderdate) END AS m, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE day(o_orderdate) END AS d FROM orders)
    SELECT id, CAST(y * 10000 + m * 100 + CASE WHEN m = 0 THEN 0 ELSE d END AS INTEGER) AS sort FROM t""",
)
def partial_dates_degraded(spark, sf_dir):
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.concat(F.date_format(day, "yyyy-"), F.when(k % 4 == 0, "00").otherwise(F.date_format(day, "MM")), F.lit("-"), F.when(k % 3 == 0, "00").otherwise(F.date_format(day, "dd")))
    return Catalog(spark, sf_dir).raw("orders").select(k.alias("id"), dates.degrade(text)["sort"].alias("sort"))


@register("edition_line_hints", "SELECT p_partkey AS id, p_size % 5 IN (0, 1, 3) AS hint FROM part")
def edition_line_hints(spark, sf_dir):
    size = F.col("p_size") % 5
    note = F.when(size == 0, "The Omnibus").when(size == 1, "boxed set 1").when(size == 2, "omnibuses").when(size == 3, "Collectors edition")
    return Catalog(spark, sf_dir).raw("part").select(F.col("p_partkey").alias("id"), titles.needs_edition_line("p_name", note).alias("hint"))


@register("value_hashes", """SELECT p_partkey AS id, CASE WHEN p_size % 9 = 0 THEN 'absent' ELSE md5('{"brand":"' || p_brand || '"' || CASE WHEN p_size % 4 = 0 THEN '' ELSE ',"size":' || p_size END || '}') END AS hash FROM part""")
def value_hashes(spark, sf_dir):
    size = F.col("p_size")
    some = size % 9 != 0
    row = Catalog(spark, sf_dir).raw("part").select(F.col("p_partkey").alias("id"), F.when(some & (size % 4 != 0), size).alias("size"), F.when(some, F.col("p_brand")).alias("brand"))
    return row.select("id", reconcile.value_hash("size", "brand").alias("hash"))


_URL = "https://catalog.example"


@register(
    "structured_data",
    f"""SELECT p_partkey AS id, '{{"@context":"https://schema.org","@type":"BookSeries","name":"' || p_name || '"' || CASE WHEN p_size % 2 = 0 THEN ',"alternateName":["' || p_brand || '"]' ELSE '' END || ',"url":"{_URL}/series/' || p_partkey || '"}}' AS series,
      '{{"@context":"https://schema.org","@type":"BreadcrumbList","itemListElement":[{{"@type":"ListItem","position":1,"name":"Home","item":"{_URL}/"}},{{"@type":"ListItem","position":2,"name":"' || p_name || '"}}]}}' AS crumbs,
      'https://schema.org/' || CASE WHEN p_size % 3 = 0 THEN 'EBook' WHEN p_size % 3 = 1 THEN 'Hardcover' ELSE 'Paperback' END AS book_format FROM part""",
)
def structured_data(spark, sf_dir):
    size, url = F.col("p_size"), lambda p: F.concat(F.lit(_URL), p)
    series = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("BookSeries").alias("@type"), F.col("p_name").alias("name"), F.when(size % 2 == 0, F.array("p_brand")).alias("alternateName"), url(F.concat(F.lit("/series/"), "p_partkey")).alias("url"))
    crumb = lambda i, name, item: F.struct(F.lit("ListItem").alias("@type"), F.lit(i).alias("position"), name.alias("name"), item.alias("item"))
    crumbs = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("BreadcrumbList").alias("@type"), F.array(crumb(1, F.lit("Home"), url(F.lit("/"))), crumb(2, F.col("p_name"), F.lit(None).cast("string"))).alias("itemListElement"))
    kind = codes.book_format(F.when(size % 3 == 0, "digital").otherwise("physical"), F.when(size % 3 == 1, "Hard cover").when(size % 3 == 2, "paperback"))
    return Catalog(spark, sf_dir).raw("part").select(F.col("p_partkey").alias("id"), F.to_json(series).alias("series"), F.to_json(crumbs).alias("crumbs"), kind.alias("book_format"))


@register("canonical_hosts", "SELECT page_id, CASE WHEN regexp_matches(url, '^https?://(www\\.)?example\\.org([/?#:]|$)') THEN regexp_replace(url, '^https?://(www\\.)?', 'https://') ELSE url END AS url FROM pages")
def canonical_hosts(spark, sf_dir):
    return Catalog(spark, sf_dir).raw("pages").select("page_id", codes.canonical_url("url", "example.org").alias("url"))


@register("filter_switches", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS on FROM events".replace(" AS on ", ' AS "on" '))
def filter_switches(spark, sf_dir):
    k = F.col("event_id") % 5
    text = F.when(k == 0, "true").when(k == 1, "1").when(k == 2, "on").when(k == 3, "yes")
    return Catalog(spark, sf_dir).raw("events").select("event_id", codes.truthy(text).alias("on"))


@register("numbered_events", "SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) + coalesce(m.top, 0) AS INTEGER) AS seq FROM events LEFT JOIN (SELECT c_custkey, max(c_custkey % 10) AS top FROM customer GROUP BY 1) m ON m.c_custkey = user_id")
def numbered_events(spark, sf_dir):
    """Next sequence numbers of a record: behind the largest it has."""
    c = Catalog(spark, sf_dir)
    top = c.raw("customer").groupBy(F.col("c_custkey").alias("user_id")).agg(F.max(F.col("c_custkey") % 10).alias("top"))
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return c.raw("events").join(top, "user_id", "left").select("event_id", "user_id", (n + F.coalesce("top", F.lit(0))).cast("int").alias("seq"))
