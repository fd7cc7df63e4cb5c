"""Links of a source's entries and their releases on small cases."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from catalogspark.operators import linking


def test_series_of_entries(spark):
    series = spark.createDataFrame([(1, "Cat", "The Cat", "active"), (2, "cat!", "x", "active"), (3, "Dog", "Dog", "active"), (4, "Fox", "f", "hidden")], "id int, title string, alt_title string, status string")
    entries = spark.createDataFrame([(1, "Cat", None), (2, "DOG", None), (3, "Fox", None), (4, "?", None), (5, "Dog", 1), (6, "Dog", 4), (7, "Dog", 99), (8, "the cat", None), (9, None, None)], "entry_id int, title string, linked_id int")
    got = {r["entry_id"]: (r["how"], r["series_id"]) for r in linking.series_of(entries, series).collect()}
    assert got == {1: ("ambiguous", None), 2: ("title", 3), 3: ("none", None), 4: ("none", None), 5: ("stored", 1), 6: ("gone", None), 7: ("gone", None), 8: ("title", 1), 9: ("none", None)}


def test_releases_within_a_series(spark):
    make = spark.createDataFrame
    shelf = SimpleNamespace(
        series=make([(1, "Cat", "Cat", "active")], "id int, title string, alt_title string, status string"),
        volumes=make([(10, 1, "1", "active"), (11, 1, None, "active"), (12, 1, "3", "hidden"), (13, 1, "4", "active")], "id int, series_id int, label string, status string"),
        editions=make([(20, "active"), (21, "active"), (22, "active"), (23, "hidden"), (24, "active"), (25, "active")], "id int, status string"),
        coverage=make([(20, 10), (21, 11), (22, 12), (23, 10), (24, 13), (24, 10), (25, 10)], "edition_id int, volume_id int"),
        releases=make([(30, 20, "p", "active"), (31, 20, "d", "active"), (32, 25, "d", "active"), (33, 21, "p", "active"), (34, 22, "p", "active"), (35, 23, "p", "active"), (36, 24, "p", "active"), (37, 20, "p", "active")], "id int, edition_id int, format string, status string"),
    )
    locked = make([(37,)], "id int")
    entries = make([(1, "x", 1), (2, "nothing", None)], "entry_id int, title string, linked_id int")
    facts = [(1, 1, " 1.0", "p", False, None), (2, 1, "1", "d", False, None), (3, 1, None, "p", False, None), (4, 1, "3", "p", False, None), (5, 1, "4", "p", False, None), (6, 1, "1", "p", True, None), (7, 1, "1", "p", True, 36), (8, 1, "1", "p", False, 37), (9, 2, "1", "p", False, 30), (10, 1, "", "p", False, None)]
    got = linking.releases_of(make(facts, "fact_id int, entry_id int, label string, format string, multi boolean, linked_id int"), entries, shelf, locked)
    assert {r["fact_id"]: (r["kind"], r["release_id"]) for r in got.collect()} == {
        1: ("one", 30), 2: ("many", None), 3: ("one", 33), 4: ("none", None), 5: ("none", None), 6: ("skipped", None), 7: ("stored", 36), 8: ("held", None), 9: ("unlinked", None), 10: ("none", None),
    }


def test_rows_without_a_key_are_dealt(spark):
    """Entries without a link and facts without one met no row, but all in one task."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        series = spark.createDataFrame([(1, "Tom", "Tim", "active")], "id int, title string, alt_title string, status string")
        entries = spark.range(400).select(F.col("id").alias("entry_id"), F.when(F.col("id") == 7, "tim").otherwise("?!").alias("title"), F.when(F.col("id") == 9, 1).alias("linked_id"))
        got = linking.series_of(entries, series).withColumn("p", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted((r["entry_id"], r["how"], r["series_id"]) for r in got if r["how"] != "none") == [(7, "title", 1), (9, "stored", 1)]
    parts = [sum(r["p"] == p for r in got) for p in range(4)]
    assert len(got) == 400 and max(parts) < 200


def test_or_alone_deals_rows_and_keeps_keys(spark):
    from catalogspark.operators import tables

    rows = spark.range(400).select("id", F.when(F.col("id") < 3, F.col("id")).alias("key")).withColumn("at", tables.or_alone("key", "id"))
    found = spark.createDataFrame([("0", "a"), ("2", "b"), ("7", "c")], "at string, name string")
    assert sorted((r["id"], r["name"]) for r in rows.join(found, "at", "left").collect() if r["name"]) == [(0, "a"), (2, "b")]
    parts = rows.repartition(4, "at").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < 200
