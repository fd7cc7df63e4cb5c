"""The driver's tables as catalog entities, in Spark and as SQL common table expressions.

Both say the same; every query's SQL starts with the expressions it needs.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SQL = {
    "publishers": """publishers AS (
  SELECT s_suppkey AS id, s_name AS name, lower(replace(s_name, '#', '-')) AS slug,
         CASE WHEN s_suppkey % 13 = 0 THEN 'hidden' ELSE 'active' END AS status FROM supplier)""",
    "series": """series AS (
  SELECT p_partkey AS id, p_name || ' ' || p_brand || ' ' || lower(p_type) AS title, p_name || ' ' || p_brand AS alt_title,
         CASE WHEN p_partkey % 10 IN (7, 8, 9) THEN 'merged' WHEN p_partkey % 11 = 0 THEN 'hidden' ELSE 'active' END AS status,
         CASE WHEN p_partkey % 10 IN (7, 8, 9) THEN p_partkey - 1 END AS merged_into FROM part)""",
    "releases": """releases AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'digital' ELSE 'physical' END AS format,
         CAST(round(o_totalprice * 100) AS BIGINT) AS price_cents, CAST(year(o_orderdate) AS INTEGER) AS year,
         CAST(CASE WHEN o_orderkey % 10 <> 0 THEN month(o_orderdate) END AS INTEGER) AS month,
         CAST(CASE WHEN o_orderkey % 10 > 1 THEN day(o_orderdate) END AS INTEGER) AS day,
         CAST(year(o_orderdate) * 10000 + CASE WHEN o_orderkey % 10 <> 0 THEN month(o_orderdate) ELSE 0 END * 100
           + CASE WHEN o_orderkey % 10 > 1 THEN day(o_orderdate) ELSE 0 END AS INTEGER) AS sort,
         CASE WHEN o_orderkey % 17 = 0 THEN 'hidden' ELSE 'active' END AS status, p.publisher_id
  FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS publisher_id FROM lineitem GROUP BY l_orderkey) p ON p.l_orderkey = o_orderkey)""",
    "release_series": "release_series AS (SELECT DISTINCT l_orderkey AS release_id, l_partkey AS series_id FROM lineitem)",
    "volumes": """volumes AS (
  SELECT DISTINCT l_partkey AS series_id, l_linenumber AS position, CAST(l_linenumber AS VARCHAR) AS label,
         l_partkey * 100 + l_linenumber AS id FROM lineitem)""",
    "coverage": """coverage AS (
  SELECT l_orderkey AS release_id, l_partkey AS series_id, l_linenumber AS position, l_partkey * 100 + l_linenumber AS volume_id,
         CASE WHEN bool_and(l_returnflag = 'N') THEN 'complete' ELSE 'partial' END AS extent
  FROM lineitem GROUP BY l_orderkey, l_partkey, l_linenumber)""",
    "users": """users AS (
  SELECT c_custkey AS id, c_name AS username, CASE c_custkey % 3 WHEN 0 THEN 'physical' WHEN 1 THEN 'digital' ELSE 'both' END AS preference,
         CASE WHEN c_custkey % 2 = 0 THEN 'public' ELSE 'private' END AS visibility FROM customer)""",
    "entries": """entries AS (
  SELECT o_custkey AS user_id, o_orderkey AS release_id,
         CASE o_orderstatus WHEN 'P' THEN 'wanted' WHEN 'O' THEN 'ordered' ELSE 'owned' END AS state FROM orders)""",
    "follows": "follows AS (SELECT DISTINCT o_custkey AS user_id, l_partkey AS series_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')",
    "bundles": """bundles AS (
  SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 9 = 4 THEN 'hidden' ELSE 'active' END AS status FROM nation)""",
    "bundle_members": """bundle_members AS (
  SELECT s_nationkey AS bundle_id, release_id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY release_id) AS INTEGER) AS position
  FROM (SELECT DISTINCT s_nationkey, release_id FROM supplier JOIN (SELECT l_suppkey, min(l_orderkey) AS release_id FROM lineitem GROUP BY l_suppkey) f ON l_suppkey = s_suppkey))""",
    "observations": """observations AS (
  SELECT event_id AS id, event_type AS source_key, CAST(user_id AS VARCHAR) AS record_id, props AS snapshot, ts AS seen_at FROM events)""",
    "runs": """runs AS (
  SELECT event_id AS id, user_id AS source_key, ts AS started_at, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status FROM events)""",
}
#: Resolves merge pointers: survivor of each series, null where the chain does not end in an active one.
_SQL["survivors"] = """survivors AS (
  WITH RECURSIVE chase(id, here, depth) AS (
    SELECT id, id, 0 FROM series
    UNION ALL
    SELECT c.id, s.merged_into, c.depth + 1 FROM chase c JOIN series s ON s.id = c.here WHERE s.status = 'merged' AND s.merged_into IS NOT NULL AND c.depth < 50)
  SELECT c.id, c.here AS survivor_id, c.depth FROM chase c JOIN series s ON s.id = c.here WHERE s.status = 'active')"""
_NEEDS = {"survivors": ["series"]}


def sql(*names: str) -> str:
    """``WITH`` clause of the named entities, in order, with what they need."""
    out: list[str] = []
    for n in names:
        for x in [*_NEEDS.get(n, []), n]:
            if x not in out:
                out.append(x)
    return "WITH " + ",\n".join(_SQL[n] for n in out) + "\n"


class Catalog:
    """Lazy entity tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def publishers(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("id"),
            F.col("s_name").alias("name"),
            F.lower(F.replace(F.col("s_name"), F.lit("#"), F.lit("-"))).alias("slug"),
            F.when(F.col("s_suppkey") % 13 == 0, "hidden").otherwise("active").alias("status"),
        )

    @property
    def series(self) -> DataFrame:
        merged = (F.col("p_partkey") % 10).isin(7, 8, 9)
        return self.raw("part").select(
            F.col("p_partkey").alias("id"),
            F.concat_ws(" ", "p_name", "p_brand", F.lower("p_type")).alias("title"),
            F.concat_ws(" ", "p_name", "p_brand").alias("alt_title"),
            F.when(merged, "merged").when(F.col("p_partkey") % 11 == 0, "hidden").otherwise("active").alias("status"),
            F.when(merged, F.col("p_partkey") - 1).alias("merged_into"),
        )

    @property
    def releases(self) -> DataFrame:
        return self._releases(self.raw("orders"), self.raw("lineitem"))

    def releases_of_month(self, year: int, month: int) -> DataFrame:
        """Releases with a date in a month: the range reaches the scan of orders, and only their lines are grouped."""
        start = datetime.datetime(year, month, 1)
        end = datetime.datetime(year + month // 12, month % 12 + 1, 1)
        orders = self.raw("orders").where((F.col("o_orderdate") >= F.lit(start).cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit(end).cast("timestamp_ntz")))
        return self._releases(orders, self.raw("lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi"))

    @staticmethod
    def _releases(orders: DataFrame, lines: DataFrame) -> DataFrame:
        first = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_suppkey").alias("publisher_id"))
        key = F.col("o_orderkey")
        month = F.when(key % 10 != 0, F.month("o_orderdate"))
        day = F.when(key % 10 > 1, F.dayofmonth("o_orderdate"))
        rows = orders.select(
            key.alias("id"),
            F.when(key % 3 == 0, "digital").otherwise("physical").alias("format"),
            F.round(F.col("o_totalprice") * 100).cast("bigint").alias("price_cents"),
            F.year("o_orderdate").alias("year"),
            month.alias("month"),
            day.alias("day"),
            (F.year("o_orderdate") * 10000 + F.coalesce(month, F.lit(0)) * 100 + F.coalesce(day, F.lit(0))).alias("sort"),
            F.when(key % 17 == 0, "hidden").otherwise("active").alias("status"),
        )
        return rows.join(first, "id", "left")

    @property
    def release_series(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_orderkey").alias("release_id"), F.col("l_partkey").alias("series_id")).distinct()

    @property
    def volumes(self) -> DataFrame:
        rows = self.raw("lineitem").select(F.col("l_partkey").alias("series_id"), F.col("l_linenumber").alias("position")).distinct()
        return rows.select("*", F.col("position").cast("string").alias("label"), (F.col("series_id") * 100 + F.col("position")).alias("id"))

    @property
    def coverage(self) -> DataFrame:
        rows = self.raw("lineitem").groupBy(F.col("l_orderkey").alias("release_id"), F.col("l_partkey").alias("series_id"), F.col("l_linenumber").alias("position"))
        rows = rows.agg(F.when(F.bool_and(F.col("l_returnflag") == "N"), "complete").otherwise("partial").alias("extent"))
        return rows.select("release_id", "series_id", "position", (F.col("series_id") * 100 + F.col("position")).alias("volume_id"), "extent")

    @property
    def users(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").select(
            key.alias("id"),
            F.col("c_name").alias("username"),
            F.when(key % 3 == 0, "physical").when(key % 3 == 1, "digital").otherwise("both").alias("preference"),
            F.when(key % 2 == 0, "public").otherwise("private").alias("visibility"),
        )

    @property
    def entries(self) -> DataFrame:
        state = F.col("o_orderstatus")
        return self.raw("orders").select(
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderkey").alias("release_id"),
            F.when(state == "P", "wanted").when(state == "O", "ordered").otherwise("owned").alias("state"),
        )

    @property
    def follows(self) -> DataFrame:
        lines = self.raw("lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_partkey")
        rows = self.raw("orders").select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        return rows.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("series_id")).distinct()

    @property
    def bundles(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 9 == 4, "hidden").otherwise("active").alias("status")
        )

    @property
    def bundle_members(self) -> DataFrame:
        from pyspark.sql import Window

        first = self.raw("lineitem").groupBy("l_suppkey").agg(F.min("l_orderkey").alias("release_id"))
        rows = self.raw("supplier").join(first, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("bundle_id"), "release_id").distinct()
        return rows.withColumn("position", F.row_number().over(Window.partitionBy("bundle_id").orderBy("release_id")))

    @property
    def observations(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            F.col("event_type").alias("source_key"),
            F.col("user_id").cast("string").alias("record_id"),
            F.col("props").alias("snapshot"),
            F.col("ts").alias("seen_at"),
        )

    @property
    def runs(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("source_key"),
            F.col("ts").alias("started_at"),
            F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("status"),
        )
