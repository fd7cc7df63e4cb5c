"""Conflict resolution between sources: authority ranks, field decisions, observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks of authority levels.
LEVELS = {"authoritative": 3, "standard": 2, "weak": 1}


def authority_rank(level) -> Column:
    """Rank of a level; 0 where there is none."""
    ranks = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    return F.coalesce(F.try_element_at(ranks, level), F.lit(0))


def decide_field() -> Column:
    """What to do with an offered value: skip, queue, recordOnly or auto; the first rule that holds.

    Reads columns ``current, offered`` (comparable values), ``overridden, rank``,
    ``incumbent`` (none, source, human, unattributed), ``incumbent_source, incumbent_rank, source``,
    and, for dates, ``dates_agree, finer`` (how many more parts the offer gives; null for other fields).
    """
    c = F.col
    same_source = c("incumbent_source").eqNullSafe(c("source"))
    by_source = (
        F.when(same_source, "auto").when(c("rank") > c("incumbent_rank"), "auto").when(c("rank") == c("incumbent_rank"), "queue").otherwise("recordOnly")
    )
    refine = (
        F.when(c("finer") <= 0, "skip")
        .when((c("incumbent") == "source") & (same_source | (c("rank") >= c("incumbent_rank"))), "auto")
        .when(c("incumbent") == "source", "recordOnly")
        .otherwise("queue")
    )
    return (
        F.when(c("current").eqNullSafe(c("offered")), "skip")
        .when(c("overridden"), "queue")
        .when(c("rank") <= 0, "recordOnly")
        .when(c("current").isNull() & (c("incumbent") == "none"), "auto")
        .when(F.coalesce(c("dates_agree"), F.lit(False)), refine)
        .when(c("incumbent").isin("human", "unattributed", "none"), "queue")
        .otherwise(by_source)
    )


def upsert_observations(state: DataFrame, batch: DataFrame) -> dict[str, DataFrame]:
    """New state and history of observations keyed by (source_key, record_id).

    ``state (source_key, record_id, snapshot, last_seen, withdrawn)`` meets ``batch (source_key,
    record_id, snapshot, seen_at)`` with one row for each key: unknown keys are added, equal snapshots
    only seen again and un-withdrawn, others replaced, the old one going to history.
    """
    keys = ["source_key", "record_id"]
    s = state.select(*keys, F.col("snapshot").alias("old"), "last_seen", "withdrawn", F.lit(True).alias("known"))
    both = s.join(batch, keys, "full_outer")
    seen = F.col("seen_at").isNotNull()
    change = F.when(~seen, "absent").when(F.col("known").isNull(), "new").when(F.col("old").eqNullSafe(F.col("snapshot")), "same").otherwise("changed")
    both = both.withColumn("change", change)
    now = both.select(
        *keys,
        F.when(seen, F.col("snapshot")).otherwise(F.col("old")).alias("snapshot"),
        F.coalesce("seen_at", "last_seen").alias("last_seen"),
        F.when(seen, F.lit(False)).otherwise(F.col("withdrawn")).alias("withdrawn"),
        "change",
    )
    history = both.where("change = 'changed'").select(*keys, F.col("old").alias("snapshot"), F.col("seen_at").alias("superseded_at"))
    return {"state": now, "history": history}


def versions(feed: DataFrame) -> DataFrame:
    """Runs of equal snapshots of a feed in order of time: (source_key, record_id, version, snapshot, first_seen, last_seen)."""
    w = Window.partitionBy("source_key", "record_id").orderBy("seen_at", "id")
    begun = ~F.col("snapshot").eqNullSafe(F.lag("snapshot").over(w)) | F.lag("id").over(w).isNull()
    rows = feed.withColumn("version", F.sum(begun.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("source_key", "record_id", "version").agg(F.min("snapshot").alias("snapshot"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))


def suppress(queue: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Queued conflicts without those that a reviewer rejected before with the same value."""
    return queue.join(suppressions, ["record_id", "field", "source_key", "value_hash"], "left_anti")


def value_hash(*columns) -> Column:
    """Digest of values under their names in order, missing ones left out; "absent" where all are missing."""
    every = F.coalesce(*[F.col(c).cast("string") for c in columns])
    return F.when(every.isNull(), "absent").otherwise(F.md5(F.to_json(F.struct(*sorted(columns)))))
