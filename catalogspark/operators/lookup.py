"""Keyed lookups: latest rows, merge pointers, redirects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalogspark.operators import tables


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row for each key: the first in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def top_by(df: DataFrame, keys: list[str], k: int, *order) -> DataFrame:
    """The first ``k`` rows of each key, with their rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def survivors(records: DataFrame) -> DataFrame:
    """(id, survivor_id, depth) of ``records (id, status, merged_into)`` whose merge chain ends in an active record.

    Pointers are doubled: each round joins the table of pointers with itself, so a chain of n
    records takes log2(n) joins. Chains that end in a hidden or missing record, and cycles,
    have no survivor. Only merged records take part in the joins.
    """
    moved = records.where("status = 'merged' AND merged_into IS NOT NULL").select("id", F.col("merged_into").alias("at"), F.lit(1).alias("depth"))
    rounds = max(1, moved.count().bit_length())
    before = -1
    for _ in range(rounds):
        step = moved.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"))
        moved = moved.join(step, "at", "left").select("id", F.coalesce("next", "at").alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        moved = tables.stored(moved, "pointers")
        left = moved.agg(F.sum("depth")).first()[0]
        if left == before:
            break
        before = left
    active = records.where("status = 'active'").select(F.col("id").alias("at"))
    ended = moved.join(active, "at").select("id", F.col("at").alias("survivor_id"), F.col("depth").cast("int").alias("depth"))
    return ended.union(active.select("at", "at", F.lit(0)))


def resolve(rows: DataFrame, column: str, pointers: DataFrame, out: str) -> DataFrame:
    """``rows`` with the survivor of ``column``; rows without one are dropped."""
    return rows.join(pointers.select(F.col("id").alias(column), F.col("survivor_id").alias(out)), column)
