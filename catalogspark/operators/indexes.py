"""Tables laid out for the reads they serve: an inverted index of words, and releases by date.

Both are plain Parquet folders. The index is partitioned by a bucket of a word's first letters and sorted by word, so that a search reads the buckets
of its own words. Releases are cut into ranges of their sort key and sorted, so that a window skips the files and row groups of other dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.functions import dates, titles

#: Buckets of an index, and how many first letters of a word choose one. Words that share these are neighbours, so that a prefix of that length is one bucket.
BUCKETS, HEAD = 64, 2


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(F.left(word, F.lit(HEAD))), F.lit(BUCKETS)).cast("int")


def write_postings(entities: DataFrame, text_columns: list[str], folder: str) -> None:
    """The postings (word, id) of the distinct words of ``entities (id, ...)``, each bucket in files of word ranges, so that a frequent word is many files and not one task."""
    words = F.explode(F.array_distinct(F.split(titles.normalize_title(F.concat_ws(" ", *text_columns)), " ")))
    rows = entities.select("id", words.alias("word")).where("word <> ''").withColumn("bucket", _bucket(F.col("word")))
    rows.repartitionByRange("bucket", "word", "id").sortWithinPartitions("bucket", "word", "id").write.partitionBy("bucket").parquet(folder)


def matches(spark: SparkSession, folder: str, query: str) -> DataFrame:
    """(id, part) of the postings that the words of a query meet: whole words, and what begins with the last one. ``part`` numbers the words."""
    words = [w for w in spark.range(1).select(F.split(titles.normalize_title(F.lit(query)), " ").alias("w")).first()["w"] if w]
    whole, last = sorted(set(words[:-1])), words[-1:]
    postings = spark.read.schema("word string, id bigint, bucket int").parquet(folder)
    if not words:
        return postings.select("id", F.lit(0).alias("part")).where(F.lit(False))
    w = F.col("word")
    # the buckets are literals once folded, so that the partitions of other words are never listed as input
    buckets = [_bucket(F.lit(x)) for x in whole + last if len(x) >= HEAD or x in whole]
    hit = w.startswith(last[0])
    for x in whole:
        hit = hit | (w == x)
    if len(last[0]) >= HEAD:
        postings = postings.where(F.col("bucket").isin(_folded(spark, buckets)))
    parts = F.array(F.when(w.startswith(last[0]), 0), *[F.when(w == x, i) for i, x in enumerate(whole, 1)])
    return postings.where(hit).select("id", F.explode(F.array_compact(parts)).alias("part")).distinct()


def _folded(spark: SparkSession, buckets: list[Column]) -> list[int]:
    return sorted(set(spark.range(1).select(F.array(*buckets).alias("b")).first()["b"]))


def search(spark: SparkSession, folder: str, query: str, limit: int) -> DataFrame:
    """(id, score): entities by how many words of the query they hold, the last one as a beginning, then by id; a blank query finds nothing."""
    rows = matches(spark, folder, query).groupBy("id").agg(F.count(F.lit(1)).alias("score"))
    return rows.orderBy(F.desc("score"), "id").limit(limit)


def write_by_date(releases: DataFrame, folder: str) -> None:
    """Releases in ranges of (sort, id)."""
    releases.repartitionByRange("sort", "id").sortWithinPartitions("sort", "id").write.parquet(folder)


def month(spark: SparkSession, folder: str, year: int, month: int, format: str | None = None) -> DataFrame:
    """Active releases of a month; its bounds reach the scan."""
    rows = spark.read.parquet(folder).where("status = 'active'").where(dates.in_month("sort", year, month))
    return rows.where(F.col("format") == format) if format else rows
