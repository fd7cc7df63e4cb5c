"""Layouts that reads can skip by, shown by their plans; titles in reading order."""

import re

from pyspark.sql import functions as F

from catalogspark import registry
from catalogspark.functions import titles
from catalogspark.operators import browse, indexes
from catalogspark.plans import calendar
from catalogspark.sources.fixture import Catalog


def _plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return df._jdf.queryExecution().toString()


def test_a_search_reads_its_words_buckets(spark, sf_dir, tmp_path):
    folder = str(tmp_path / "postings")
    series = Catalog(spark, sf_dir).series.where("status = 'active'")
    indexes.write_postings(series, ["title", "alt_title"], folder)
    hits = indexes.matches(spark, folder, "Lemon st")
    plan = _plan(hits)
    wanted = re.search(r"PartitionFilters: \[bucket#\d+ IN \(([\d,]+)\)\]", plan)[1].split(",")
    assert len(wanted) == 2 and re.search(r"PushedFilters: \[.*StringStartsWith\(word,st\)", plan)
    # whole words alone: the same as a scan of all texts
    got = indexes.search(spark, folder, "steel lemon promo brand", 10**6)
    want = browse.search(series, ["title", "alt_title"], "steel lemon promo brand", 10**6)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert indexes.search(spark, folder, " ... ", 5).collect() == []
    one = indexes.search(spark, folder, "s", 10**6)  # a single letter may be anywhere
    assert one.count() == series.where(F.exists(F.split(titles.normalize_title(F.concat_ws(" ", "title", "alt_title")), " "), lambda w: w.startswith("s"))).count()


def test_a_month_reaches_the_scan(spark, sf_dir, tmp_path):
    plan = _plan(registry.queries()["month_calendar"](spark, sf_dir))
    assert re.search(r"PushedFilters: \[[^]]*GreaterThanOrEqual\(o_orderdate,1998-06-01T00:00\), LessThan\(o_orderdate", plan)
    folder = str(tmp_path / "dates")
    indexes.write_by_date(Catalog(spark, sf_dir).releases, folder)
    out = indexes.month(spark, folder, calendar.YEAR, calendar.MONTH)
    assert "GreaterThanOrEqual(sort,19980600), LessThanOrEqual(sort,19980699)" in _plan(out)


def test_titles_in_reading_order(spark):
    t = spark.createDataFrame([(x,) for x in ["Zoe", "étoile", "Eta", "eta", "Étoile", "Zebra", "apple", "Äpfel"]], "t string")
    assert [r["t"] for r in t.orderBy(titles.title_order("t")).collect()] == ["Äpfel", "apple", "eta", "Eta", "étoile", "Étoile", "Zebra", "Zoe"]
