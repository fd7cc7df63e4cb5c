"""Steps whose work for each row or key once outgrew the input."""

from pyspark.sql import functions as F

from catalogspark import registry
from catalogspark.functions import titles
from catalogspark.operators import matching
from catalogspark.streaming import observations


def test_keys_of_a_stream_share_groups(spark, tmp_path):
    results = []
    for parts in (3, 4096):
        folder = f"{tmp_path}/{parts}"
        for k in range(2):
            i = F.col("id")
            rows = spark.range(500 * k, 500 * k + 500).select("id", (i % 2).cast("string").alias("source_key"), F.when(i % 7 != 3, (i % 50).cast("string")).alias("record_id"), (F.floor(i / 200)).cast("string").alias("snapshot"), F.when(i % 11 != 0, F.timestamp_seconds(i)).alias("seen_at"))
            rows.write.parquet(f"{folder}/landed/part={k}")
            feed = spark.readStream.schema(rows.schema).parquet(f"{folder}/landed/part=*").select(*rows.columns)
            observations.run(observations.upserts(feed, parts), folder)
        changes = observations.written(spark, folder, observations._OUT)
        results.append(sorted(map(str, [*observations.state(changes).collect(), *observations.history(changes).collect()])))
        groups = spark.read.format("statestore").load(f"{folder}/state").count()
        assert groups == 3 if parts == 3 else 3 < groups <= 52
    assert results[0] == results[1] and len(results[0]) > 100


def test_titles_come_to_the_ladder_as_words(spark, sf_dir):
    facts = spark.createDataFrame([(1, "A", "The Tom"), (2, "A", "Ann"), (3, None, "Ann")], "fact_id int, code string, title string").withColumns({"key": F.lower("title"), "label_key": F.lit("1"), "publisher_id": F.lit(1), "format": F.lit("physical"), "multi": F.lit(False)})
    by_code = spark.createDataFrame([("A", 3, ["Tom's (Ann)", "tom"])], "code string, release_id int, titles array<string>")
    none = spark.createDataFrame([], "release_id int, key string, label_key string, publisher_id int, format string, single boolean, blocked boolean")
    want = [(1, 2, "match", 3), (2, 2, "review", 3), (3, 5, "create", None)]
    assert sorted(map(tuple, matching.match_ladder(facts, by_code, none).collect())) == want
    words = facts.withColumn("words", titles.similarity_tokens("title")).drop("title"), by_code.select("code", "release_id", F.transform("titles", titles.similarity_tokens).alias("words"))
    assert sorted(map(tuple, matching.match_ladder(*words, none).collect())) == want
    plan = registry.queries()["match_ladder"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert all("regexp_replace" not in line for line in plan.split("\n") if "exists(" in line)


def _shuffled(spark, run):
    """Rows that ``run`` writes to shuffles."""
    jvm = spark.sparkContext._jvm
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    before = max((stages().apply(i).stageId() for i in range(stages().size())), default=-1)
    run().write.format("noop").mode("overwrite").save()
    now = stages()
    return sum(now.apply(i).shuffleWriteRecords() for i in range(now.size()) if now.apply(i).stageId() > before)


def test_facts_are_shuffled_a_few_times(spark, sf_dir):
    """Facts without a code, a release or a queued proposal went through the shuffles of those with one: 5.4 rows shuffled for each line item, where side tables are small enough to be sent to all tasks."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    for name, most in (("import_planned", 5), ("import_queue", 5), ("import_created", 7.8)):
        assert _shuffled(spark, lambda: registry.queries()[name](spark, sf_dir)) < most * lines, name


def test_pages_shuffle_what_can_not_be_told_there(spark, sf_dir):
    """Wide rows were shuffled by publisher, and with titles that no series page shows and anchors that the codes tell."""
    from catalogspark.operators import nested
    from catalogspark.plans.nested import _shelf
    from catalogspark.sources.fixture import Catalog

    shelf = _shelf(Catalog(spark, sf_dir))
    assert "anchor" not in nested._edition_releases(shelf).schema.simpleString()
    assert "title" not in nested._widened(shelf, False).schema.simpleString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole = nested.editions_whole(shelf)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [line for line in whole if "publisher_id" in line and "Join" in line] and not [line for line in whole if "publisher_id" in line and "Join" in line and "releases" in line]


def test_a_release_counts_once_under_a_key(spark):
    """Rows of a release that covers two series of one title need no shuffle of their own to become one; nulls meet nothing but a null label."""
    facts = spark.createDataFrame([(1, None, "tom", None, 1, "physical", False), (2, None, "tom", "1", None, "physical", False), (3, None, None, None, 1, "physical", False), (4, None, "tom", "1", 1, None, False), (5, "A", "tom", None, 1, "digital", True)], "fact_id int, code string, key string, label_key string, publisher_id int, format string, multi boolean").withColumn("title", F.lit("a b"))
    catalog = spark.createDataFrame([(7, "tom", None, 1, "physical", True, False)] * 2 + [(8, "tom", "1", 1, "physical", True, False), (9, None, None, 1, "physical", True, False)], "release_id int, key string, label_key string, publisher_id int, format string, single boolean, blocked boolean")
    by_code = spark.createDataFrame([("A", 3, [""])], "code string, release_id int, titles array<string>")
    got = matching.match_ladder(facts, by_code, catalog, ("title",))
    assert sorted(map(tuple, got.drop("title").collect()), key=str) == [(1, 3, "match", 7), (2, 4, "review", None), (3, 5, "create", None), (4, 5, "create", None), (5, 2, "match", 3)]
    assert got.columns == ["fact_id", "rung", "outcome", "release_id", "title"]
