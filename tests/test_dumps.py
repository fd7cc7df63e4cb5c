"""Dumps whose lines are read without doing a step twice."""

from catalogspark import registry
from catalogspark.functions import dates
from catalogspark.sources import wire


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_line_of_a_dump_is_parsed_once(spark, sf_dir):
    lines = spark.createDataFrame([('/type/edition\t/books/1\t1\t2031\t{"key":"/books/1","title":"Tom Vol. 2","publish_date":"soon"}',), ("/type/edition\t/books/2\t1\t2031\tno json",)], "value string")
    out = wire.dump_editions(lines)
    assert [(r["key"], r["series_title"], r["volume_label"], r["publish_date"]) for r in out.collect()] == [("/books/1", "Tom", "2", None)]
    assert _plan(out).count("from_json") == 1
    # one file of parts is dealt to tasks before its lines are made
    assert "RepartitionByExpression" in _plan(registry.queries()["feed_dump_editions"](spark, sf_dir))


def test_parts_of_dates_that_are_missing_are_not_cast(spark):
    t = spark.createDataFrame([("Oct 2031",), ("2031-10",), ("2031",), ("soon",), (None,)], "t string").select(dates.from_prose("t").alias("d"))
    assert [r["d"] and r["d"]["sort"] for r in t.collect()] == [20311000, 20311000, 20310000, None, None]
    plan = t._jdf.queryExecution().analyzed().toString()
    assert "try_cast(regexp_extract" not in plan and "try_cast(nullif" in plan
