"""Entity resolution: equi-joins on normalised keys, a ladder of rungs, duplicate blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalogspark.functions import titles


def title_keys(series: DataFrame) -> DataFrame:
    """(id, key) for each distinct title key of a series' title and alternatives; blank keys don't count."""
    texts = F.explode(F.array_distinct(F.array(titles.normalize_title("title"), titles.normalize_title("alt_title"))))
    return series.select("id", texts.alias("key")).where("key <> ''")


def first_of_code(releases: DataFrame, titles_of: DataFrame) -> DataFrame:
    """(code, release_id, titles): for each code its first release by id, where that one is active.

    ``releases (release_id, code, status)``, ``titles_of (release_id, titles)``, or ``words`` for the titles. A first release that isn't active gives its code to none.
    """
    first = releases.where("code IS NOT NULL").groupBy("code").agg(F.min(F.struct("release_id", "status")).alias("first"))
    return first.where("first.status = 'active'").select("code", "first.release_id").join(titles_of, "release_id")


def match_ladder(facts: DataFrame, by_code: DataFrame, catalog: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(fact_id, rung, outcome, release_id) of every fact, and its columns ``keep``.

    ``facts (fact_id, code, title, key, label_key, publisher_id, format, multi)``; ``by_code`` of ``first_of_code``, a row a code; ``catalog (release_id, key, label_key,
    publisher_id, format, single, blocked)``, where a release counts once under a key and label. The first rung
    that decides wins: equal code (2: match, or review where no title of the release is similar); several volumes
    (create); one release of the same publisher, single volume and format (3: match, or review where blocked);
    several (3: review); any other but such that differ in format alone (4: review); none (5: create).

    Titles are compared by their words; ``words`` beside ``facts``' title and ``words`` (a list a title) beside ``by_code``'s titles spare taking them apart again.
    Only facts with a code meet the codes. Facts and releases meet under their key in one shuffle and are counted there in one pass, so a popular title costs a fact no more than a rare one.
    """
    c = F.col
    given = lambda df, of: c("words") if "words" in df.columns else of
    # words have no blanks, and as one text they are half as wide on their way
    packed = lambda words: F.array_join(words, " ")
    unpacked = lambda text: F.filter(F.split(text, " "), lambda x: x != "")
    coded = facts.where("code IS NOT NULL").withColumn("told", packed(given(facts, titles.similarity_tokens("title"))))
    named = by_code.select("code", c("release_id").alias("hit"), F.transform(given(by_code, F.transform("titles", titles.similarity_tokens)), packed).alias("of"))
    columns = list(dict.fromkeys(["fact_id", "key", "label_key", "publisher_id", "format", "multi", *keep]))
    coded = coded.join(named, "code", "left").select(*columns, "hit", F.exists("of", lambda w: titles.words_similar(unpacked(w), unpacked(c("told")))).alias("same"))
    rows = coded.unionByName(facts.where("code IS NULL").select(*columns, F.lit(None).cast(coded.schema["hit"].dataType).alias("hit"), F.lit(None).cast("boolean").alias("same")))
    # a null label meets a null label, a null key none; facts that are decided without their key are dealt to all tasks
    at = ["at_key", "at_label", "none", "alone"]
    looks = c("hit").isNull() & ~F.coalesce("multi", F.lit(False)) & c("key").isNotNull()
    side = lambda df, looks, alone: df.withColumns({"at_key": F.when(looks, c("key")), "at_label": F.when(looks, F.coalesce("label_key", F.lit(""))), "none": looks & c("label_key").isNull(), "alone": F.when(~looks, alone)})
    every = F.lit(True)
    there = side(catalog.where("key IS NOT NULL"), every, F.lit(None).cast(facts.schema["fact_id"].dataType)).select(*at, "publisher_id", "format", "release_id", "single", "blocked", F.lit(False).alias("fact"))
    rows = side(rows, looks, c("fact_id")).withColumn("fact", F.lit(True)).drop(*{"key", "label_key"} - set(keep)).unionByName(there, allowMissingColumns=True)
    finest = [*at, "publisher_id", "format"]
    rows = rows.repartition(*at).sortWithinPartitions(*finest, "release_id")
    here = Window.partitionBy(*finest, "release_id").orderBy("release_id")
    rows = rows.withColumn("n", F.when(~c("fact") & (F.row_number().over(here) == 1), 1)).withColumn("single", c("single") & c("n").isNotNull())
    counted = lambda x, *of: F.sum(x).over(Window.partitionBy(*of))
    one = F.min(F.when(c("single"), F.struct("release_id", "blocked"))).over(Window.partitionBy(*finest))
    alone = c("single").cast("int")
    rows = rows.withColumns({"strict_n": counted(alone, *finest), "one": one}).withColumn("n_same", counted(alone, *at, "publisher_id")).withColumn("n_all", counted("n", *at)).where("fact")
    zero = F.lit(0)
    count = lambda x, where: F.coalesce(F.when(where, c(x)), zero)
    by = c("publisher_id").isNotNull()
    strict_n, loose_n = count("strict_n", by & c("format").isNotNull()), count("n_all", every) - count("n_same", by)
    code = c("hit").isNotNull()
    rung = F.when(code, 2).when(c("multi"), 5).when(strict_n > 0, 3).when(loose_n > 0, 4).otherwise(5)
    outcome = (
        F.when(code & c("same"), "match")
        .when(code, "review")
        .when(c("multi"), "create")
        .when((strict_n == 1) & ~c("one.blocked"), "match")
        .when((strict_n > 0) | (loose_n > 0), "review")
        .otherwise("create")
    )
    target = F.when(code, c("hit")).when(~c("multi") & (strict_n == 1), c("one.release_id"))
    return rows.select("fact_id", rung.alias("rung"), outcome.alias("outcome"), target.alias("release_id"), *[x for x in keep if x != "fact_id"])


def duplicate_keys(records: DataFrame) -> DataFrame:
    """(id, rank, key): of the title and every alternative, the normalised title (rank 0) and the sorted words (rank 1)."""
    text = records.select("id", F.explode(F.array("title", "alt_title")).alias("t"))
    keys = text.select("id", F.posexplode(F.array(titles.normalize_title("t"), titles.token_key("t"))).alias("rank", "key"))
    return keys.where("key <> ''").distinct()


def _reason():
    return F.when(F.col("rank") == 0, "title").otherwise("tokens").alias("reason")


def marked_keys(keys: DataFrame) -> DataFrame:
    """``keys`` of ``duplicate_keys`` with ``before``: the record's own keys that come before each, titles first; a record with all its keys is one group."""
    entry = F.struct("rank", "key")
    rows = keys.groupBy("id").agg(F.array_sort(F.collect_set(entry)).alias("all")).select("id", "all", F.posexplode("all").alias("at", "k"))
    text = F.transform(F.slice("all", 1, F.col("at")), lambda x: F.concat_ws(" ", x["rank"].cast("string"), x["key"]))
    return rows.select("id", "k.rank", "k.key", text.alias("before"))


def pairs_of(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, reason, ..) of rows of two ``marked_keys`` with a before b by id, once each: under the first key that both have, so that no pair is shuffled to meet itself under another.

    Columns but ``id``, ``rank``, ``key`` and ``before`` come along. The result grows with the square of a key's records and leaves the join as it is; the tasks are as many as the pairs need, whatever the keys' bytes are.
    """
    spark = a.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    x = a.withColumnsRenamed({"id": "a", "before": "before_a"}).repartition(n, "rank", "key")
    y = b.withColumnsRenamed({"id": "b", "before": "before_b"}).repartition(n, "rank", "key")
    # most that share another key share the first one
    met = (F.get("before_a", F.lit(0)) == F.get("before_b", F.lit(0))) | F.arrays_overlap("before_a", "before_b")
    pairs = x.join(y, ["rank", "key"]).where(F.col("a") < F.col("b")).where((F.size("before_a") == 0) | (F.size("before_b") == 0) | ~met)
    return pairs.withColumn("reason", _reason()).drop("rank", "key", "before_a", "before_b")


def duplicate_pairs(records: DataFrame) -> DataFrame:
    """(a, b, reason) of records that share a key of ``duplicate_keys``; equal titles outrank equal words. All pairs of a block: for review lists."""
    keys = marked_keys(duplicate_keys(records))
    return pairs_of(keys, keys).select("a", "b", "reason")


def duplicate_groups(records: DataFrame) -> DataFrame:
    """(id, first_id, reason): each record of a block but its first, with that first one; rows grow with the records and not with the pairs."""
    keys = duplicate_keys(records)
    least = keys.groupBy("rank", "key").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = keys.join(least, ["rank", "key"]).where("id <> first_id").groupBy("id", "first_id").agg(F.min("rank").alias("rank"))
    return rows.select("id", "first_id", _reason())


def sibling_editions(wanted: DataFrame, editions: DataFrame, coverage: DataFrame) -> DataFrame:
    """(want_id, edition_id): the first active, unlocked edition without a line, by the wanted publisher, that covers exactly the wanted volumes, all whole, in order.

    ``wanted (want_id, publisher_id, volumes)``, ``editions (id, publisher_id, status, locked, line_id)``,
    ``coverage (edition_id, volume_id, position, extent)``. Nothing wanted has no sibling.
    """
    whole = coverage.groupBy("edition_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "volume_id"))), lambda x: x["volume_id"]).alias("volumes"), F.bool_and(F.col("extent") == "complete").alias("complete"))
    open_ = editions.where("status = 'active' AND NOT locked AND line_id IS NULL").select(F.col("id").alias("edition_id"), "publisher_id")
    known = whole.where("complete").join(open_, "edition_id").groupBy("publisher_id", "volumes").agg(F.min("edition_id").alias("edition_id"))
    return wanted.where(F.size("volumes") > 0).join(known, ["publisher_id", "volumes"]).select("want_id", "edition_id")


def prefix_matches(names: DataFrame, publishers: DataFrame) -> DataFrame:
    """(name, publisher_id): the active publisher whose normalised name equals the given one or starts with it at a word's end, or the reverse, if only one does.

    Both sides are cut to word prefixes, so that this is an equi-join and no pair is compared in vain.
    """
    key = titles.normalize_title("name")
    words = F.split("k", " ")
    prefixes = F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " "))).alias("k")
    a = names.select("name", key.alias("k")).where("k <> ''").distinct()
    b = publishers.where("status = 'active'").select(F.col("id").alias("publisher_id"), key.alias("k")).where("k <> ''")
    down = a.select("name", prefixes).join(b, "k").select("name", "publisher_id")
    up = b.select("publisher_id", prefixes).join(a, "k").select("name", "publisher_id")
    return down.union(up).distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("publisher_id").alias("publisher_id")).where("n = 1").select("name", "publisher_id")
