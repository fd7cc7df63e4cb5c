"""Feed payloads, small and odd ones, against the rows they stand for."""

import json

from pyspark.sql import functions as F

from catalogspark.functions import dates
from catalogspark.sources import wire


def _frame(spark, *values, column="value"):
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_listings(spark):
    ok = {"id": 7, "status": "publish", "slug": "a-1", "link": "u", "title": {"rendered": " Tom &amp; I Vol. 1 "}, "content": {"rendered": "<p>x&#8217;s</p>"}}
    bad = [{**ok, "status": "draft"}, {**ok, "title": {"rendered": " "}}, {k: v for k, v in ok.items() if k != "link"}, {**ok, "id": None}]
    got = _rows(wire.listings(_frame(spark, json.dumps([ok, *bad]), "no json", None, "[]")))
    assert got == [("7", "a-1", "u", "Tom & I Vol. 1", "", "x’s")]


def test_book_page(spark):
    html = """<img src="/wp-content/uploads/logo.png"><img class="c" src="https://x/wp-content/uploads/b.jpg"><div id="volume-meta">
      <b>Series:</b> <a href="https://x/series/tom/">Tom &amp; I</a> <b>Release Date:</b> August 4, 2026 <br><b>Price:</b> $13.99<br><b>Format:</b> Manga
      <br><b>ISBN:</b> 978-1-23456-789-0<br><span class="creator"><a href="/c/1">Ren&#233;e &amp; Bo</a></span><span class="creator">Ann</span><span class="creator"> </span><img src="/wp-content/uploads/late.png"></div>"""
    r = wire.book_pages(_frame(spark, html, "", None, column="html")).collect()
    a = r[0]
    assert (a.series_url, a.series_slug, a.series_title) == ("https://x/series/tom/", "tom", "Tom & I")
    assert (a.release_date.sort, a.price_cents, a.currency, a.category, a.isbn13) == (20260804, 1399, "USD", "Manga", "9781234567890")
    assert (a.creators, a.cover_url) == (["Renée & Bo", "Ann"], "https://x/wp-content/uploads/b.jpg")
    assert all(x.series_url is None and x.price_cents is None and x.cover_url is None for x in r[1:])


def test_titles(spark):
    t = _frame(spark, "Tom Vol. 3", "Tom Vols. 1 - 2", "Tom (Light Novel) Vol. 2", "Tom")
    s = wire.split_book_title(F.col("value"))
    got = t.select(s["series_title"], s["volume_label"], wire.is_comic(F.lit(None).cast("string"), F.col("value"))).collect()
    assert [tuple(r) for r in got] == [("Tom", "3", True), ("Tom", "1–2", True), ("Tom (Light Novel)", "2", False), ("Tom", None, True)]


def test_volumes(spark):
    item = {"title": "Tom Volume 4", "series_name": "Tom", "creators": "By Ann, Bo, ", "image": "i", "volume_url": "https://x/series/tom/volume-4/", "formats": ["digital", "print"]}
    days = {"data": [{"tue_key": "2026-08-04", "items": [item, {**item, "formats": []}, {**item, "volume_url": "https://x/other"}]}]}
    cal = wire.calendar(_frame(spark, json.dumps(days), "{}", None))
    assert _rows(cal.select("record_id", "volume_label", "release_date.sort", "format")) == [("tom/volume-4#digital", "4", 20260804, "digital"), ("tom/volume-4#physical", "4", 20260804, "physical")]
    assert cal.first().creators == ["Ann", "Bo"]
    new = {"series_type": "comic", "series_name": "Tom", "volume_title": "Tom Volume 4", "volume_url": item["volume_url"], "release_date": "2026-08-11", "has_print": True, "is_purchasable": False}
    fresh = wire.new_releases(_frame(spark, json.dumps({"data": [new, {**new, "series_type": "novel"}]})))
    assert _rows(wire.latest_wins(cal, fresh).select("record_id", "release_date.sort")) == [("tom/volume-4#digital", 20260804), ("tom/volume-4#physical", 20260811)]


def test_report(spark):
    xml = "<report><item><id>5</id><type>manga</type><name>Tom &amp; I</name></item><item><id>6</id><type>novel</type><name>x</name></item><item><id>7</id></item></report>"
    assert _rows(wire.report_items(_frame(spark, xml, "", None))) == [(5, "Tom & I", 3)]


def test_dump(spark):
    e = {"key": "/books/1", "title": "Tom, Vol. 2", "publishers": ["P"], "publish_date": "October 13th, 2026", "isbn_13": ["x", "978-1-23456-789-0"], "isbn_10": ["0-306-40615-x"], "physical_format": "Paperback", "languages": [{"key": "/languages/eng"}]}
    line = lambda x, kind="/type/edition": f"{kind}\t/books/1\t1\t2026\t{json.dumps(x)}"
    out = ["", "/type/edition\tshort", line(e, "/type/work"), line({**e, "languages": [{"key": "/languages/fre"}]}), line({**e, "title": " "}), "/type/edition\ta\tb\tc\tno json", None]
    got = wire.dump_editions(_frame(spark, line(e), line({**e, "key": "/books/2", "title": "Tom Vols. 1-3", "languages": [], "physical_format": "eBook"}), *out)).orderBy("key").collect()
    assert [(r.key, r.series_title, r.volume_label, r.multi_volume, r.publish_date.sort, r.isbn13, r.isbn10, r.format, r.binding) for r in got] == [
        ("/books/1", "Tom", "2", False, 20261013, "9781234567890", "030640615X", "physical", "paperback"),
        ("/books/2", "Tom", None, True, 20261013, "9781234567890", "030640615X", "digital", None),
    ]


def test_prose_dates(spark):
    t = _frame(spark, "Feb 9, 2031", "February 2031", "2031-02-09", "2031-13-01", "2031-02-40", "2031", "Foo 3, 2031", "soon", None)
    assert [r[0] for r in t.select(dates.from_prose("value")["sort"]).collect()] == [20310209, 20310200, 20310209, 20310000, 20310200, 20310000, 20310000, None, None]
