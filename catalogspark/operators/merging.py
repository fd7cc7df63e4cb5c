"""Merge of entities with a manifest, and its exact undo."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def repoint(rows: DataFrame, merges: DataFrame, column: str, keys: list[str]) -> dict[str, DataFrame]:
    """References of ``rows (id, ...)`` after the ``merges (loser, survivor)``.

    ``rows``: the table with ``column`` pointing at survivors; where a survivor's own row has the same ``keys`` already,
    the loser's row goes, and of several losers' rows the least id stays. ``manifest``: (id, column, before,
    after, removed) for what changed, from which ``undo`` restores the table.
    """
    c = F.col
    rest = [k for k in keys if k != column]
    hit = rows.join(merges.select(c("loser").alias(column), c("survivor").alias("after")), column)
    removed = F.lit(False)
    if column in keys:
        # only rows of losers and of survivors can be equal after the merge
        own = rows.join(merges.select(c("survivor").alias(column)).distinct(), column, "left_semi").select(*rest, c(column).alias("after")).distinct().withColumn("held", F.lit(True))
        first = hit.groupBy(*rest, "after").agg(F.min("id").alias("first"))
        hit = hit.join(first, [*rest, "after"]).join(own, [*rest, "after"], "left")
        removed = F.coalesce("held", F.lit(False)) | (c("id") != c("first"))
    changes = hit.select("id", c(column).alias("before"), "after", removed.alias("removed"))
    put = changes.select("id", c("after").alias("_after"), c("removed").alias("_removed"))
    moved = rows.join(put, "id", "left").where("NOT coalesce(_removed, false)").withColumn(column, F.coalesce("_after", column))
    return {"rows": moved.select(*rows.columns), "manifest": changes.select("id", F.lit(column).alias("column"), "before", "after", "removed")}


def undo(rows: DataFrame, removed: DataFrame, manifest: DataFrame, column: str) -> DataFrame:
    """The table before the merge: moved rows go back only where they still point at what the merge wrote."""
    m = manifest.where("NOT removed").select("id", "before", "after")
    back = rows.join(m, "id", "left").withColumn(column, F.when(F.col("after").isNotNull() & F.col(column).eqNullSafe(F.col("after")), F.col("before")).otherwise(F.col(column)))
    return back.select(*rows.columns).unionByName(removed.select(*rows.columns))


def impact(merges: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(id, label, n): rows of each table that refer to a loser, in long form."""
    loser = merges.select(F.col("loser").alias("id"))
    parts = [df.groupBy(F.col(c).alias("id")).agg(F.count(F.lit(1)).alias("n")).join(loser, "id").select("id", F.lit(k).alias("label"), "n") for k, (df, c) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def append_volumes(volumes: DataFrame, merges: DataFrame) -> DataFrame:
    """``volumes (id, series_id, position, ...)`` after the ``merges (loser, survivor)``: the losers' volumes follow the survivor's
    last position, one loser after the other in order of their ids."""
    top = volumes.groupBy("series_id").agg(F.max("position").alias("top"))
    none = F.lit(0).cast("bigint")
    rows = merges.join(top.select(F.col("series_id").alias("loser"), "top"), "loser").join(top.select(F.col("series_id").alias("survivor"), F.col("top").alias("base")), "survivor", "left")
    before = F.sum("top").over(Window.partitionBy("survivor").orderBy("loser").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.select(F.col("loser").alias("series_id"), "survivor", (F.coalesce("base", none) + F.coalesce(before, none)).alias("offset"))
    moved = volumes.join(rows, "series_id", "left").withColumn("series_id", F.coalesce("survivor", "series_id"))
    return moved.withColumn("position", F.col("position") + F.coalesce("offset", none)).select(*volumes.columns)


def slug_redirects(redirects: DataFrame, merges: DataFrame, records: DataFrame) -> DataFrame:
    """(from_slug, target_id): redirects to losers point at their survivors, and each loser's own slug becomes one."""
    m = merges.select(F.col("loser").alias("target_id"), "survivor")
    kept = redirects.join(m, "target_id", "left").select("from_slug", F.coalesce("survivor", "target_id").alias("target_id"))
    own = records.join(m, records["id"] == m["target_id"]).select(F.col("slug").alias("from_slug"), F.col("survivor").alias("target_id"))
    return kept.unionByName(own)
