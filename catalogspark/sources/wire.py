"""Landed feed payloads as snapshot rows, by built-in column functions.

Each reader takes a DataFrame with one payload a row (a page of a listing, a report, a dump line) and
explodes it, so payloads are spread over the tasks that read them. A malformed item is dropped, never fatal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogspark.functions import codes, dates, markup

#: Patterns of the feeds.
NOT_COMIC = r"(?i)light novel|audiobook|audio book|^novel$|prose"
EBOOK = r"(?i)e-?book|electronic|kindle|digital"
MARKED_RANGE = r"(?i)^(.*?)[,:]?\s+(?:Vols?\.?|Volumes?)\s+(\d+(?:\.\d+)?)\s*[-–]\s*(\d+(?:\.\d+)?)\s*$"
MARKED = r"(?i)^(.*?)[,:]?\s+(?:Vols?\.?|Volumes?|#)\s*(\d+(?:\.\d+)?)\s*$"
MARKED_SUBTITLE = r"(?i)^(?:Vols?\.?|Volumes?)\s*(\d+(?:\.\d+)?)$"
BOOK_TITLE = r"(?i)^(.*?)\s+Vols?\.?\s+([0-9]+(?:\.[0-9]+)?(?:\s*[-–]\s*[0-9]+(?:\.[0-9]+)?)?)\s*$"
CREATOR = r'(?is)<span[^>]*class="creator"[^>]*>(.*?)</span>'
SERIES_LINK = r'(?is)<b>\s*Series:\s*</b>.*?<a\s+href="([^"]*/series/([^/"]+)/?)"[^>]*>(.*?)</a>'

_LISTING = "array<struct<id:bigint,status:string,slug:string,link:string,modified_gmt:string,title:struct<rendered:string>,content:struct<rendered:string>>>"
_CALENDAR = "struct<data:array<struct<tue_key:string,items:array<struct<title:string,series_name:string,creators:string,image:string,volume_url:string,formats:array<string>>>>>>"
_NEW = "struct<data:array<struct<series_type:string,series_name:string,volume_title:string,volume_url:string,creators:string,image:string,release_date:string,has_print:boolean,is_purchasable:boolean>>>"
_EDITION = "struct<key:string,title:string,subtitle:string,publishers:array<string>,publish_date:string,isbn_13:array<string>,isbn_10:array<string>,physical_format:string,languages:array<struct<key:string>>>"


def _bare(c) -> Column:
    """Without white space at the ends; ``trim`` takes blanks alone."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    """The trimmed group, null where nothing but blanks was found."""
    return F.nullif(_bare(F.regexp_extract(c, pattern, group)), F.lit(""))


def listings(pages: DataFrame, column: str = "value") -> DataFrame:
    """(record_id, slug, url, title, modified, description) of published items of JSON listing pages."""
    item = pages.select(F.explode(F.from_json(F.col(column), _LISTING)).alias("i")).select("i.*")
    item = item.where("id IS NOT NULL AND coalesce(status, 'publish') = 'publish' AND link IS NOT NULL AND slug IS NOT NULL AND title.rendered RLIKE '[^ \\t\\r\\n]'")
    body = F.when(_bare("content.rendered") != "", markup.strip_html("content.rendered"))
    return item.select(
        F.col("id").cast("string").alias("record_id"), "slug", F.col("link").alias("url"), _bare(markup.decode_entities("title.rendered")).alias("title"),
        F.coalesce("modified_gmt", F.lit("")).alias("modified"), body.alias("description"),
    )


def meta_line(html: Column, label: str) -> Column:
    """Text behind a bold label of a book page."""
    return F.nullif(_bare(markup.decode_entities(_found(html, rf"(?i)<b>\s*{label}\s*:\s*</b>\s*([^<]+)"))), F.lit(""))


def _texts(c: Column, pattern: str) -> Column:
    """Texts of all matches of a pattern's group, without tags, blanks collapsed, empty ones left out.

    They are decoded as one string, since an array can't go through a column function; \x01 divides them.
    """
    found = F.array_join(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), "\x01")
    return F.filter(F.transform(F.split(markup.strip_html(found), "\x01"), _bare), lambda x: x != "")


def _people(html: Column) -> Column:
    return _texts(html, CREATOR)


def book_pages(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with the fields of a book page: series link, date, price, format, ISBN by shape, creators and cover.

    The cover is the last uploaded image before the volume's data.
    """
    html = F.col(column)
    before = F.when(F.instr(html, 'id="volume-meta"') > 0, F.substring_index(html, 'id="volume-meta"', 1)).otherwise(html)
    covers = F.regexp_extract_all(before, F.lit(r'(?i)<img[^>]+src="([^"]*/wp-content/uploads/[^"]*)"'), F.lit(1))
    dollars = _found(F.coalesce(meta_line(html, "Price"), F.lit("")), r"\$\s*(\d+(?:\.\d{1,2})?)").try_cast("decimal(12,2)")
    return pages.select(
        "*", _found(html, SERIES_LINK).alias("series_url"), _found(html, SERIES_LINK, 2).alias("series_slug"), F.nullif(markup.strip_html(_found(html, SERIES_LINK, 3)), F.lit("")).alias("series_title"),
        dates.from_us(meta_line(html, "Release Date")).alias("release_date"), (dollars * 100).cast("bigint").alias("price_cents"), F.when(dollars.isNotNull(), "USD").alias("currency"),
        meta_line(html, "Format").alias("category"), codes.isbn_shape(meta_line(html, "ISBN"), 13).alias("isbn13"),
        _people(html).alias("creators"), F.try_element_at(covers, F.lit(-1)).alias("cover_url"),
    )


def split_book_title(title: Column) -> Column:
    """Struct (series_title, volume_label); a range's dash becomes an en dash."""
    label = F.regexp_replace(_found(title, BOOK_TITLE, 2), r"\s*[-–]\s*", "–")
    return F.struct(F.coalesce(_found(title, BOOK_TITLE), _bare(title)).alias("series_title"), label.alias("volume_label"))


def is_comic(category: Column, title: Column) -> Column:
    """By the category; without one, by a parenthesised word before the volume or the end."""
    said = F.coalesce(category, _found(title, r"(?i)\(([^)]+)\)\s*(?:Vols?\.?\s|$)"))
    return ~F.coalesce(said.rlike(NOT_COMIC), F.lit(False))


def _volumes(items: DataFrame) -> DataFrame:
    """A row for each format of items (series_name, volume_title, url, creators, image, day, formats)."""
    at = lambda i: _found(F.col("url"), r"/series/([^/]+)/([^/]+)/?$", i)
    label = _found(F.translate("volume_title", " ", " "), r"(?i)volume\s+(\d+(?:\.\d+)?)\s*$")
    people = F.filter(F.transform(F.split(F.regexp_replace("creators", r"(?i)^\s*by\s+", ""), r",\s*"), _bare), lambda x: x != "")
    rows = items.select(
        _bare("series_name").alias("series_title"), at(1).alias("series_slug"), at(2).alias("volume_slug"), "url", label.alias("volume_label"),
        F.coalesce(people, F.array().cast("array<string>")).alias("creators"), dates.from_iso("day").alias("release_date"), F.col("image").alias("cover_url"), F.explode("formats").alias("format"),
    )
    rows = rows.where("series_title <> '' AND series_slug IS NOT NULL AND volume_slug IS NOT NULL")
    return rows.select(F.concat("series_slug", F.lit("/"), "volume_slug", F.lit("#"), "format").alias("record_id"), "*")


def _formats(printed: Column, digital: Column) -> Column:
    return F.array_compact(F.array(F.when(printed, "physical"), F.when(digital, "digital")))


def calendar(pages: DataFrame, column: str = "value") -> DataFrame:
    """Volumes by format of calendar payloads; the bucket's key is the date."""
    bucket = pages.select(F.explode(F.from_json(F.col(column), _CALENDAR)["data"]).alias("b"))
    item = bucket.select(F.col("b.tue_key").alias("day"), F.explode("b.items").alias("i"))
    has = lambda kind: F.array_contains("i.formats", kind)
    return _volumes(item.select("i.series_name", F.col("i.title").alias("volume_title"), F.col("i.volume_url").alias("url"), "i.creators", "i.image", "day", _formats(has("print"), has("digital")).alias("formats")))


def new_releases(pages: DataFrame, column: str = "value") -> DataFrame:
    """Volumes by format of new-release payloads, comics only."""
    item = pages.select(F.explode(F.from_json(F.col(column), _NEW)["data"]).alias("i")).select("i.*").where("coalesce(series_type, 'comic') = 'comic'")
    return _volumes(item.select("series_name", "volume_title", F.col("volume_url").alias("url"), "creators", "image", F.col("release_date").alias("day"), _formats(F.col("has_print"), F.col("is_purchasable")).alias("formats")))


def latest_wins(*feeds: DataFrame) -> DataFrame:
    """Union of feeds with one row for each record; a later feed's row stands."""
    rows = [f.withColumn("feed", F.lit(i)) for i, f in enumerate(feeds)]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    first = Window.partitionBy("record_id").orderBy(F.desc("feed"), "url", "series_title")
    return every.withColumn("rank", F.row_number().over(first)).where("rank = 1").drop("rank", "feed")


def report_items(pages: DataFrame, column: str = "value") -> DataFrame:
    """(id, title) of the comics of XML reports, and how many items the payload had, complete or not."""
    items = F.regexp_extract_all(F.col(column), F.lit(r"(?is)<item>(.*?)</item>"), F.lit(1))
    rows = pages.select(F.size(items).alias("listed"), F.explode(items).alias("x"))
    part = lambda name: _bare(markup.decode_entities(_found(F.col("x"), rf"(?is)<{name}>(.*?)</{name}>")))
    rows = rows.select(part("id").try_cast("bigint").alias("id"), part("name").alias("title"), part("type").alias("type"), "listed")
    return rows.where("id IS NOT NULL AND title <> '' AND coalesce(type, 'manga') = 'manga'").drop("type")


#: A release line's "(GN 3)", its kinds of books, and what names a packaging or a range of volumes.
DESIGNATED = r"^(.*?)\s*\(([^()]*)\)\s*$"
PRINTED_LINE, EBOOK_LINE = r"\bO?GN\b|(?i:graphic novel)", r"(?i)\be-?book\b"
PACKAGED = r"(?i)\b(omnibus|box(?:ed)? set|deluxe|collector'?s|hardcover)\b"
LINE_RANGE, LINE_NUMBER = r"(\d+(?:\.\d+)?)\s*[-–]\s*(\d+(?:\.\d+)?)", r"(\d+(?:\.\d+)?)"
#: Most alternative titles of a record, and their languages.
MOST_TITLES, TITLE_LANGUAGES = 12, r"(?i)^(EN|JA)"


def release_line(text: Column) -> Column:
    """Struct (title, label, multi, format, line_hint) of a line as "Name (GN 3)"; null where it is no book."""
    t = _bare(text)
    title, kind = _found(t, DESIGNATED), _bare(F.regexp_extract(t, DESIGNATED, 2))
    ebook, many = kind.rlike(EBOOK_LINE), kind.rlike(LINE_RANGE)
    row = F.struct(
        title.alias("title"), F.when(~many, F.nullif(F.regexp_extract(kind, LINE_NUMBER, 1), F.lit(""))).alias("label"), many.alias("multi"),
        F.when(ebook, "digital").otherwise("physical").alias("format"), kind.rlike(PACKAGED).alias("line_hint"),
    )
    return F.when(title.isNotNull() & (ebook | kind.rlike(PRINTED_LINE)), row)


def records(pages: DataFrame, column: str = "value") -> DataFrame:
    """(id, title, alt_titles, staff, body) of the records of XML detail payloads; those without id or title are left out."""
    blocks = pages.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(r"(?s)(<manga\s+[^>]*>.*?</manga>)"), F.lit(1))).alias("block"))
    head = F.regexp_extract("block", r"<manga\s+([^>]*)>", 1)
    main = F.nullif(F.regexp_extract("block", r'(?s)<info[^>]*type="Main title"[^>]*>(.*?)</info>', 1), F.lit(""))
    title = _bare(markup.decode_entities(F.coalesce(main, F.regexp_extract(head, r'\bname="([^"]*)"', 1))))
    other = r'(?s)<info[^>]*type="Alternative title"[^>]*lang="([^"]*)"[^>]*>(.*?)</info>'
    rows = blocks.select(
        F.nullif(F.regexp_extract(head, r'\bid="(\d+)"', 1), F.lit("")).alias("id"), title.alias("title"), F.col("block").alias("body"),
        F.regexp_extract_all("block", F.lit(other), F.lit(1)).alias("langs"),
        F.split(markup.decode_entities(F.array_join(F.regexp_extract_all("block", F.lit(other), F.lit(2)), "\x01")), "\x01").alias("names"),
        F.split(markup.decode_entities(F.array_join(F.regexp_extract_all("block", F.lit(r"(?s)<person[^>]*>(.*?)</person>"), F.lit(1)), "\x01")), "\x01").alias("people"),
    )
    kept = F.filter(F.arrays_zip("langs", "names"), lambda x: x["langs"].rlike(TITLE_LANGUAGES))
    names = F.filter(F.transform(kept, lambda x: _bare(x["names"])), lambda x: (x != "") & (x != F.col("title")))
    people = F.filter(F.transform("people", _bare), lambda x: x != "")
    out = rows.where("id IS NOT NULL AND title <> ''")
    return out.select("id", "title", F.slice(F.array_distinct(names), 1, MOST_TITLES).alias("alt_titles"), F.array_distinct(people).alias("staff"), "body")


def record_releases(found: DataFrame) -> DataFrame:
    """(id, release_id, release_date, title, label, multi, format, line_hint) of the book lines of ``records``.

    A line without a link is named by its format, label and date.
    """
    line = found.select("id", F.explode(F.regexp_extract_all("body", F.lit(r"(?s)(<release\s+[^>]*>.*?</release>)"), F.lit(1))).alias("l"))
    attrs = F.regexp_extract("l", r"<release\s+([^>]*)>", 1)
    line = line.select("id", attrs.alias("attrs"), release_line(markup.decode_entities(F.regexp_extract("l", r"(?s)<release\s+[^>]*>(.*?)</release>", 1))).alias("r")).where("r IS NOT NULL")
    day = F.when(F.col("attrs").rlike('date="[^"]*"'), F.regexp_extract("attrs", r'date="([^"]*)"', 1))
    linked = F.nullif(F.regexp_extract(F.regexp_extract("attrs", r'href="([^"]*)"', 1), r"[?&]id=(\d+)", 1), F.lit(""))
    own = F.concat_ws(":", F.col("r.format"), F.coalesce("r.label", F.when(F.col("r.multi"), "multi").otherwise("oneshot")), F.coalesce(day, F.lit("")))
    return line.select("id", F.coalesce(linked, own).alias("release_id"), dates.degrade(day).alias("release_date"), "r.*")


#: Titles of a title list.
LIST_RANGE = r"(?i)^(.*?)(?:[,:]?\s+(?:Vols?\.?|Volumes?)\s+)(\d+(?:\.\d+)?)\s*[-–]\s*(\d+(?:\.\d+)?)\s*(?:\(.*\))?$"
LIST_MARKED = r"(?i)^(.*?)(?:[,:]?\s+(?:Vols?\.?|Volumes?)\s+)(\d+(?:\.\d+)?)\s*(?:\(.*\))?$"
LIST_BARE = r"^(.*[^\d\s])\s+(\d{1,3}(?:\.\d+)?)$"
LIST_DIGITAL, LIST_AUDIO = r"(?i)\be-?book\b|\bdigital\b|\bDN\b", r"(?i)audio"
_DESCRIBED = "struct<code:string,description:string>"
_TITLES = (
    "struct<data:struct<titles:array<struct<isbn:string,isbnHyphenated:string,isbn10:string,title:string,seriesNumber:string,author:string,onsale:string,onSaleDate:string,"
    "format:string,formatFamily:string,imprint:string,publisher:string,priceUsd:double,price:array<struct<currencyCode:string,amount:double>>,seoFriendlyUrl:string>>>>"
)


def split_list_title(title: Column, number: Column) -> Column:
    """Struct (series_title, volume_label, multi_volume): a marked range, a marked volume, a bare number at the end, or the title with the number given beside it."""
    t = _bare(title)
    many, marked, bare = t.rlike(LIST_RANGE), t.rlike(LIST_MARKED), t.rlike(LIST_BARE)
    pick = lambda i: F.when(many, F.regexp_extract(t, LIST_RANGE, i)).when(marked, F.regexp_extract(t, LIST_MARKED, i)).when(bare, F.regexp_extract(t, LIST_BARE, i))
    label = F.when(~many, F.coalesce(pick(2), F.nullif(number, F.lit(""))))
    return F.struct(F.coalesce(_bare(pick(1)), t).alias("series_title"), label.alias("volume_label"), many.alias("multi_volume"))


def described(c: Column) -> Column:
    """The text, or the description of a (code, description) object; blank is null."""
    inner = F.from_json(c, _DESCRIBED)["description"]
    return F.nullif(_bare(F.when(F.startswith(F.ltrim(c), F.lit("{")), inner).otherwise(c)), F.lit(""))


def title_lists(pages: DataFrame, column: str = "value", site: str = "https://books.example") -> DataFrame:
    """Titles of JSON title lists, audio left out; a price is the flat one (under either spelling of its name) or the first positive in US dollars."""
    # names that differ in case alone can't be fields of one struct
    other = F.from_json(F.col(column), "data struct<titles array<struct<priceUSD double>>>")["data"]["titles"]
    both = F.arrays_zip(F.from_json(F.col(column), _TITLES)["data"]["titles"].alias("t"), F.transform(other, lambda x: x["priceUSD"]).alias("flat"))
    e = pages.select(F.explode(both).alias("x")).select("x.t.*", F.col("x.flat").alias("flatPrice"))
    kind = F.coalesce(described(F.col("format")), described(F.col("formatFamily")), F.lit(""))
    isbn = codes.isbn_shape(F.coalesce("isbn", "isbnHyphenated"), 13)
    e = e.withColumn("kind", kind).withColumn("isbn13", isbn).withColumn("title", _bare("title"))
    e = e.where(F.col("isbn13").isNotNull() & (F.col("title") != "") & ~F.col("kind").rlike(LIST_AUDIO))
    digital = F.col("kind").rlike(LIST_DIGITAL)
    dollars = F.filter("price", lambda p: (p["currencyCode"] == "USD") & (p["amount"] > 0))
    flat = F.coalesce("priceUsd", "flatPrice")
    flat = F.when(flat > 0, flat)
    split = split_list_title(F.col("title"), F.col("seriesNumber"))
    here = F.when(F.startswith("seoFriendlyUrl", F.lit("/")), F.concat(F.lit(site), "seoFriendlyUrl")).otherwise(F.concat(F.lit(site + "/search?q="), "isbn13"))
    return e.select(
        "isbn13", codes.isbn_shape(F.upper("isbn10"), 10).alias("isbn10"), here.alias("url"), "title", split["series_title"].alias("series_title"), split["volume_label"].alias("volume_label"),
        split["multi_volume"].alias("multi_volume"), _bare("author").alias("author"), dates.from_iso(F.coalesce("onsale", "onSaleDate")).alias("onsale"), F.when(digital, "digital").otherwise("physical").alias("format"),
        F.when(digital, None).when(F.col("kind").rlike("(?i)hardcover"), "hardcover").when(F.col("kind").rlike("(?i)paperback|trade"), "paperback").alias("binding"),
        F.coalesce(described(F.col("imprint")), described(F.col("publisher"))).alias("imprint"),
        F.round(F.coalesce(flat, F.try_element_at(dollars, F.lit(1))["amount"]) * 100).cast("bigint").alias("price_cents"),
    )


def imprint_publisher(imprint: Column) -> Column:
    """Struct (name, slug) of an imprint's publisher."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(_bare(imprint)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.struct(_bare(imprint).alias("name"), F.when(slug == "", "imprint").otherwise(slug).alias("slug"))


def dump_of_publishers(lines: DataFrame, pattern: str, column: str = "value") -> DataFrame:
    """Edition lines of a dump whose 400 characters from the word "publishers" on match ``pattern``, without parsing any JSON."""
    at = F.instr(F.col(column), '"publishers"')
    near = F.substr(F.col(column), at, F.lit(400))
    return lines.where(F.col(column).startswith("/type/edition\t") & (at > 0) & near.rlike(f"(?i){pattern}"))


def needs_detail(listing: DataFrame, stored: DataFrame) -> DataFrame:
    """(record_id, needs_detail): listed records whose stored change time is another, or that aren't stored, or that are forced."""
    s = stored.select("record_id", F.col("modified").alias("known"))
    return listing.join(s, "record_id", "left").select("record_id", (F.col("forced") | ~F.col("modified").eqNullSafe(F.col("known"))).alias("needs_detail"))


def split_edition_title(title: Column, subtitle: Column) -> Column:
    """Struct (series_title, volume_label, multi_volume): a marked range, a marked volume, a marked subtitle, or the title alone."""
    return _split_edition(title, title.rlike(MARKED_RANGE), _found(title, MARKED, 2), subtitle)


def _split_edition(title: Column, many: Column, own: Column, subtitle: Column) -> Column:
    below = _found(_bare(F.coalesce(subtitle, F.lit(""))), MARKED_SUBTITLE)
    series = F.coalesce(F.when(many, _found(title, MARKED_RANGE)), F.when(own.isNotNull(), _found(title, MARKED)), title)
    return F.struct(series.alias("series_title"), F.when(~many, F.coalesce(own, below)).alias("volume_label"), many.alias("multi_volume"))


def dump_editions(lines: DataFrame, column: str = "value") -> DataFrame:
    """English editions of a tab-separated dump: type, key, revision, date, JSON. The type is looked at before any JSON is parsed.

    A line's JSON is parsed once, by a generator, since a filter on the fields would parse it again; what several columns need is a column first.
    """
    cols = F.split(F.col(column), "\t", 5)
    rows = lines.where(F.col(column).startswith("/type/edition\t") & (F.size(cols) == 5))
    e = rows.select(F.inline(F.array(F.from_json(cols[4], _EDITION)))).where("key LIKE '/books/%' AND title RLIKE '[^ \\t\\r\\n]'")
    e = e.where(F.coalesce(F.size("languages"), F.lit(0)).isin(-1, 0) | F.exists("languages", lambda x: x["key"] == "/languages/eng"))
    e = e.withColumns({"title": _bare("title"), "kind": F.coalesce(_bare("physical_format"), F.lit(""))})
    e = e.withColumns({"many": F.col("title").rlike(MARKED_RANGE), "own": _found(F.col("title"), MARKED, 2), "digital": F.col("kind").rlike(EBOOK)})
    kind, digital = F.col("kind"), F.col("digital")
    first = lambda c, n: F.try_element_at(F.filter(F.transform(c, lambda x: codes.isbn_shape(F.upper(x), n)), lambda x: x.isNotNull()), F.lit(1))
    split = _split_edition(F.col("title"), F.col("many"), F.col("own"), F.col("subtitle"))
    return e.select(
        "key", "title", split["series_title"].alias("series_title"), split["volume_label"].alias("volume_label"), split["multi_volume"].alias("multi_volume"),
        F.coalesce(F.filter("publishers", lambda x: x.isNotNull()), F.array().cast("array<string>")).alias("publishers"), dates.from_prose("publish_date").alias("publish_date"),
        first("isbn_13", 13).alias("isbn13"), first("isbn_10", 10).alias("isbn10"), F.when(digital, "digital").otherwise("physical").alias("format"),
        F.when(digital, None).when(kind.rlike("(?i)hardcover"), "hardcover").when(kind.rlike("(?i)paperback"), "paperback").alias("binding"),
    )
