"""Feed readers over payloads made of the driver's tables; the SQL says what each payload stands for and reads none."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogspark.functions import markup
from catalogspark.registry import register
from catalogspark.sources import wire
from catalogspark.sources.fixture import Catalog

_TITLE = "p_name || ' ' || p_partkey"


def _parts(spark, sf_dir):
    return Catalog(spark, sf_dir).raw("part").withColumn("id", F.col("p_partkey")).withColumn("name", F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")))


def _pages(items, struct, per=40, wrap=None):
    """Payload rows of about ``per`` items each."""
    rows = items.groupBy((F.col("id") / per).cast("bigint")).agg(F.collect_list(struct).alias("items"))
    return rows.select(F.to_json(wrap(F.col("items")) if wrap else "items").alias("value"))


def _joined(items, text, per=40, head="<x>", tail="</x>"):
    rows = items.groupBy((F.col("id") / per).cast("bigint")).agg(F.array_join(F.collect_list(text), "").alias("t"))
    return rows.select(F.concat(F.lit(head), "t", F.lit(tail)).alias("value"))


@register(
    "feed_listings",
    f"""SELECT CAST(p_partkey AS VARCHAR) AS record_id, 'p-' || p_partkey AS slug, 'https://x.example/' || p_partkey AS url, {_TITLE} || ' & co Vol. ' || p_size AS title,
      '2031-0' || (p_size % 9 + 1) AS modified, CASE WHEN p_size % 4 <> 0 THEN p_brand || ' ’ ' || p_type END AS description FROM part WHERE p_size % 7 <> 0""",
)
def feed_listings(spark, sf_dir):
    size = F.col("p_size")
    body = F.when(size % 4 != 0, F.concat(F.lit("<p>"), "p_brand", F.lit("</p>\n&#8217;  <b>"), "p_type", F.lit("</b>"))).otherwise(" ")
    item = F.struct(
        "id", F.when(size % 7 == 0, "draft").otherwise("publish").alias("status"), F.concat(F.lit("p-"), "id").alias("slug"), F.concat(F.lit("https://x.example/"), "id").alias("link"),
        F.concat(F.lit("2031-0"), size % 9 + 1).alias("modified_gmt"), F.struct(F.concat(F.lit(" "), "name", F.lit(" &amp; co Vol. "), size).alias("rendered")).alias("title"), F.struct(body.alias("rendered")).alias("content"),
    )
    return wire.listings(_pages(_parts(spark, sf_dir), item))


@register(
    "feed_book_pages",
    f"""SELECT p_partkey AS id, 'https://x.example/series/s-' || p_partkey || '/' AS series_url, 's-' || p_partkey AS series_slug, {_TITLE} || ' & co' AS series_title,
      20310000 + (p_size % 12 + 1) * 100 + p_size % 28 + 1 AS release_sort, CAST(round(p_retailprice * 100) AS BIGINT) AS price_cents, p_type AS category,
      lpad(CAST(9780000000000 + p_partkey AS VARCHAR), 13, '0') AS isbn13, 'Ann' || p_size || ',Bo & Cy' AS creators, 'https://x.example/wp-content/uploads/' || p_partkey || '.jpg' AS cover_url FROM part""",
)
def feed_book_pages(spark, sf_dir):
    size, s = F.col("p_size"), lambda c: F.col(c).cast("string")
    month = F.element_at(F.array(*map(F.lit, ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"])), size % 12 + 1)
    html = F.concat(
        F.lit('<img src="https://x.example/wp-content/uploads/logo.png"><img alt="" src="https://x.example/wp-content/uploads/'), s("id"), F.lit('.jpg"><div id="volume-meta"><b>Series:</b> <a href="https://x.example/series/s-'), s("id"),
        F.lit('/">'), "name", F.lit(" &amp; co</a><br><b>Release Date:</b> "), month, F.lit(" "), (size % 28 + 1).cast("string"), F.lit(", 2031<br><b>Price:</b> $"), F.col("p_retailprice").cast("decimal(12,2)").cast("string"),
        F.lit("<br><b>Format:</b> "), "p_type", F.lit("<br><b>ISBN:</b> "), (F.lit(9780000000000) + F.col("id")).cast("string"), F.lit('<span class="creator"><a href="/c">Ann'), size.cast("string"),
        F.lit('</a></span><span class="creator">Bo &#38; Cy</span><img src="/wp-content/uploads/late.png"></div>'),
    )
    out = wire.book_pages(_parts(spark, sf_dir).select("id", html.alias("html")))
    return out.select("id", "series_url", "series_slug", "series_title", F.col("release_date.sort").alias("release_sort"), "price_cents", "category", "isbn13", F.array_join("creators", ",").alias("creators"), "cover_url")


_VOLUMES = f"""SELECT 's-' || p_partkey || '/v-' || p_size || '#' || f.format AS record_id, {_TITLE} AS series_title, CAST(p_size AS VARCHAR) AS volume_label, 20310000 + (p_size % 12 + 1) * 100 + 5 + f.late AS release_sort
    FROM part, (VALUES ('physical', 0), ('digital', CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END)) f(format, late) WHERE f.format = 'physical' AND p_size % 2 = 0 OR f.format = 'digital' AND (p_size % 5 <> 0 OR p_size % 3 = 0)"""


def _volume_feeds(spark, sf_dir):
    p, size = _parts(spark, sf_dir), F.col("p_size")
    day = lambda d: F.concat(F.lit("2031-"), F.lpad((size % 12 + 1).cast("string"), 2, "0"), F.lit(f"-0{d}"))
    url, title = F.concat(F.lit("https://x.example/series/s-"), "id", F.lit("/v-"), size, F.lit("/")), F.concat("name", F.lit(" Volume "), size)
    formats = F.array_compact(F.array(F.when(size % 2 == 0, "print"), F.when(size % 5 != 0, "digital")))
    item = F.struct(title.alias("title"), F.col("name").alias("series_name"), F.lit("By Ann, Bo").alias("creators"), url.alias("volume_url"), formats.alias("formats"))
    days = _pages(p, F.struct(day(5).alias("tue_key"), F.array(item).alias("items")), wrap=lambda x: F.struct(x.alias("data")))
    new = F.struct(F.when(size % 4 == 3, F.lit(None)).otherwise("comic").alias("series_type"), F.col("name").alias("series_name"), title.alias("volume_title"), url.alias("volume_url"), day(6).alias("release_date"), F.lit(False).alias("has_print"), F.lit(True).alias("is_purchasable"))
    late = _pages(p.where("p_size % 3 = 0"), new, wrap=lambda x: F.struct(x.alias("data")))
    return wire.calendar(days), wire.new_releases(late)


@register("feed_volumes_latest", _VOLUMES)
def feed_volumes_latest(spark, sf_dir):
    """Calendar and new releases overlap; the later feed's row stands."""
    out = wire.latest_wins(*_volume_feeds(spark, sf_dir))
    return out.select("record_id", "series_title", "volume_label", F.col("release_date.sort").alias("release_sort"))


@register("feed_report_items", f"SELECT p_partkey AS id, {_TITLE} || ' & co' AS title FROM part WHERE p_size % 3 <> 0")
def feed_report_items(spark, sf_dir):
    kind = F.when(F.col("p_size") % 3 == 0, "<type>novel</type>").when(F.col("p_size") % 3 == 1, "<type>manga</type>").otherwise("")
    text = F.concat(F.lit("<item><id>"), "id", F.lit("</id>"), kind, F.lit("<name>"), "name", F.lit(" &amp; co</name></item>"))
    return wire.report_items(_joined(_parts(spark, sf_dir), text)).select("id", "title")


def _records(spark, sf_dir):
    size, num = F.col("p_size"), F.col("p_size").cast("string")
    info = lambda lang, text: F.concat(F.lit(f'<info type="Alternative title" lang="{lang}">'), text, F.lit("</info>"))
    lines = F.concat(
        F.lit('<release date="2031-'), F.lpad((size % 15).cast("string"), 2, "0"), F.lit('-00" href="https://x.example/r.php?id='), "id", F.lit('">'), "name",
        F.when(size % 4 == 0, F.concat(F.lit(" (GN "), num, F.lit("-"), (size + 2).cast("string"), F.lit(")"))).when(size % 4 == 1, F.concat(F.lit(" (eBook "), num, F.lit(")"))).when(size % 4 == 2, " (GN omnibus)").otherwise(" (DVD 1)"),
        F.lit('</release><release date="2031">'), "name", F.lit(" (GN)</release>"),
    )
    text = F.concat(
        F.lit('<manga id="'), "id", F.lit('" name="unused"><info type="Main title" lang="EN">'), "name", F.lit(" &amp;amp; co</info>"), info("EN", F.col("p_brand")), info("JA", F.col("p_type")), info("FR", F.lit("nom")), info("en", F.col("p_brand")),
        F.lit("<staff><person>Ann</person></staff><staff><person> Bo </person></staff><staff><person>Ann</person></staff>"), lines, F.lit("</manga>"),
    )
    return wire.records(_joined(_parts(spark, sf_dir), text, head="<ann><warning>no result</warning>", tail="</ann>"))


@register("feed_records", f"SELECT CAST(p_partkey AS VARCHAR) AS id, {_TITLE} || ' &amp; co' AS title, p_brand || '|' || p_type AS alt_titles, 'Ann|Bo' AS staff FROM part")
def feed_records(spark, sf_dir):
    return _records(spark, sf_dir).select("id", "title", F.array_join("alt_titles", "|").alias("alt_titles"), F.array_join("staff", "|").alias("staff"))


@register(
    "feed_record_releases",
    f"""SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(p_partkey AS VARCHAR) AS release_id, CAST(20310000 + CASE WHEN p_size % 15 BETWEEN 1 AND 12 THEN p_size % 15 * 100 ELSE 0 END AS INTEGER) AS release_sort, {_TITLE} AS title,
      CASE WHEN p_size % 4 = 1 THEN CAST(p_size AS VARCHAR) END AS label, p_size % 4 = 0 AS multi, CASE WHEN p_size % 4 = 1 THEN 'digital' ELSE 'physical' END AS format, p_size % 4 = 2 AS line_hint FROM part WHERE p_size % 4 <> 3
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'physical:oneshot:2031', 20310000, {_TITLE}, NULL, false, 'physical', false FROM part""",
)
def feed_record_releases(spark, sf_dir):
    return wire.record_releases(_records(spark, sf_dir)).withColumn("release_sort", F.col("release_date.sort")).drop("release_date")


@register(
    "feed_title_lists",
    f"""SELECT lpad(CAST(9780000000000 + p_partkey AS VARCHAR), 13, '0') AS isbn13, lpad(CAST(p_partkey AS VARCHAR), 9, '0') || 'X' AS isbn10, p_name || ' x' AS series_title,
      CASE p_size % 4 WHEN 0 THEN NULL WHEN 3 THEN CAST(p_partkey AS VARCHAR) ELSE CAST(p_size AS VARCHAR) END AS volume_label, p_size % 4 = 0 AS multi_volume,
      20310000 + (p_size % 12 + 1) * 100 + 9 AS onsale_sort, CASE WHEN p_size % 5 = 1 THEN 'digital' ELSE 'physical' END AS format, CASE WHEN p_size % 5 = 2 THEN 'hardcover' WHEN p_size % 5 > 2 THEN 'paperback' END AS binding,
      p_brand AS imprint, lower(replace(p_brand, '#', '-')) AS slug, CAST(round(p_retailprice * 100) AS BIGINT) AS price_cents,
      CASE WHEN p_size % 2 = 0 THEN 'https://books.example/b/' || p_partkey ELSE 'https://books.example/search?q=' || lpad(CAST(9780000000000 + p_partkey AS VARCHAR), 13, '0') END AS url
    FROM part WHERE p_size % 5 <> 0""",
)
def feed_title_lists(spark, sf_dir):
    size, num = F.col("p_size"), F.col("p_size").cast("string")
    title = F.concat("p_name", F.lit(" x"), F.when(size % 4 == 0, F.concat(F.lit(", Vol. "), num, F.lit("-"), (size + 1).cast("string"), F.lit(" (Omnibus)"))).when(size % 4 == 1, F.concat(F.lit(" Volume "), num)).when(size % 4 == 2, F.concat(F.lit(" "), num)).otherwise(""))
    kind = F.when(size % 5 == 0, "Audiobook Download").when(size % 5 == 1, '{"code":"EL","description":"eBook"}').when(size % 5 == 2, '{"code":"HC","description":" Hardcover "}').otherwise("Trade Paperback")
    item = F.struct(
        F.concat(F.lit("978-"), F.lpad(F.col("id").cast("string"), 10, "0")).alias("isbnHyphenated"), F.concat(F.lpad(F.col("id").cast("string"), 9, "0"), F.lit("-x")).alias("isbn10"), title.alias("title"),
        F.when(size % 4 == 3, F.col("id").cast("string")).alias("seriesNumber"), F.concat(F.lit("2031-"), F.lpad((size % 12 + 1).cast("string"), 2, "0"), F.lit("-09T00:00:00-05:00")).alias("onSaleDate"), kind.alias("format"),
        F.to_json(F.struct(F.lit("X").alias("code"), F.col("p_brand").alias("description"))).alias("imprint"), F.when(size % 3 == 0, F.col("p_retailprice")).alias("priceUsd"),
        F.array(F.struct(F.lit("CAD").alias("currencyCode"), F.lit(1.0).alias("amount")), F.struct(F.lit("USD").alias("currencyCode"), F.col("p_retailprice").alias("amount"))).alias("price"),
        F.when(size % 2 == 0, F.concat(F.lit("/b/"), "id")).otherwise(F.concat(F.lit("b/"), "id")).alias("seoFriendlyUrl"),
    )
    out = wire.title_lists(_pages(_parts(spark, sf_dir), item, wrap=lambda x: F.struct(F.struct(x.alias("titles")).alias("data"))))
    out = out.withColumn("slug", wire.imprint_publisher(F.col("imprint"))["slug"]).withColumn("onsale_sort", F.col("onsale.sort"))
    return out.select("isbn13", "isbn10", "series_title", "volume_label", "multi_volume", "onsale_sort", "format", "binding", "imprint", "slug", "price_cents", "url")


def _dump(spark, sf_dir):
    size = F.col("p_size")
    month = F.element_at(F.array(*map(F.lit, ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"])), size % 12 + 1)
    e = F.struct(
        F.concat(F.lit("/books/"), "id").alias("key"), F.concat("name", F.lit(", Vol. "), size).alias("title"), F.array("p_brand").alias("publishers"), F.concat(month, F.lit(" 2031")).alias("publish_date"),
        F.array(F.lit("none"), F.concat(F.lit("978-"), F.lpad(F.col("id").cast("string"), 10, "0"))).alias("isbn_13"), F.when(size % 3 == 0, "eBook").otherwise("Hardcover").alias("physical_format"),
        F.array(F.struct(F.when(size % 4 == 0, "/languages/fre").otherwise("/languages/eng").alias("key"))).alias("languages"),
    )
    kind = F.when(size % 5 == 0, "/type/work").otherwise("/type/edition")
    # lines cost more to make and to read than their parts' bytes let Spark deal out
    return _parts(spark, sf_dir).repartition("id").select(F.concat_ws("\t", kind, F.concat(F.lit("/books/"), "id"), F.lit("1"), F.lit("2031"), F.to_json(e)).alias("value"))


@register(
    "feed_dump_editions",
    f"""SELECT '/books/' || p_partkey AS key, {_TITLE} AS series_title, CAST(p_size AS VARCHAR) AS volume_label, p_brand AS publishers, 20310000 + (p_size % 12 + 1) * 100 AS publish_sort,
      lpad(CAST(9780000000000 + p_partkey AS VARCHAR), 13, '0') AS isbn13, CASE WHEN p_size % 3 = 0 THEN 'digital' ELSE 'physical' END AS format, CASE WHEN p_size % 3 <> 0 THEN 'hardcover' END AS binding
    FROM part WHERE p_size % 5 <> 0 AND p_size % 4 <> 0""",
)
def feed_dump_editions(spark, sf_dir):
    return dump_columns(wire.dump_editions(_dump(spark, sf_dir)))


def dump_columns(out):
    return out.select("key", "series_title", "volume_label", F.array_join("publishers", ",").alias("publishers"), F.col("publish_date.sort").alias("publish_sort"), "isbn13", "format", "binding")


@register("feed_dump_of_publishers", "SELECT '/books/' || p_partkey AS key FROM part WHERE p_size % 5 <> 0 AND (p_brand ILIKE '%#1%' OR p_brand ILIKE '%#2%')")
def feed_dump_of_publishers(spark, sf_dir):
    return wire.dump_of_publishers(_dump(spark, sf_dir), "#[12]").select(F.split("value", "\t")[1].alias("key"))


@register(
    "listing_needs_detail",
    """WITH stored AS (SELECT DISTINCT ON (user_id) user_id AS id, event_type AS modified FROM events ORDER BY user_id, event_id DESC)
    SELECT c_custkey AS record_id, c_custkey % 50 = 0 OR s.modified IS DISTINCT FROM 'click' AS needs_detail FROM customer LEFT JOIN stored s ON s.id = c_custkey""",
)
def listing_needs_detail(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    stored = c.raw("events").groupBy(F.col("user_id").alias("record_id")).agg(F.max_by("event_type", "event_id").alias("modified"))
    return wire.needs_detail(c.raw("customer").select(F.col("c_custkey").alias("record_id"), F.lit("click").alias("modified"), (F.col("c_custkey") % 50 == 0).alias("forced")), stored)


_BARE = "regexp_replace(html || ' &#233;&#x4e2d; &#X41;&#38;lt; &#66', '<[^>]*>', ' ', 'g')"
_NUMERIC = f"""array_to_string(list_transform(regexp_extract_all({_BARE}, '&#[0-9]+;|&#[xX][0-9a-fA-F]+;|&|[^&]+'),
  lambda x: CASE WHEN regexp_full_match(x, '&#[0-9]+;') THEN chr(CAST(x[3:-2] AS INTEGER)) WHEN x LIKE '&#%;' THEN chr(CAST('0x' || x[4:-2] AS INTEGER)) ELSE x END), '')"""
_STRIP = f"trim(regexp_replace(replace(replace(replace(replace(replace(replace({_NUMERIC}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'), E' \\t\\n\\r')"


@register("page_plain_text", f"SELECT page_id, md5({_STRIP}) AS plain FROM pages")
def page_plain_text(spark, sf_dir):
    """Text of all pages, each with numeric references behind it."""
    html = F.concat("html", F.lit(" &#233;&#x4e2d; &#X41;&#38;lt; &#66"))
    return Catalog(spark, sf_dir).raw("pages").select("page_id", F.md5(markup.strip_html(html)).alias("plain"))
