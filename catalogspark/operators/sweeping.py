"""Duplicate sweeps that compare what has changed: keys and flagged pairs are kept from one sweep to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.operators import matching, tables


def changed_keys(records: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keys now, records whose keys changed): the keys of ``matching.duplicate_keys`` of all active ``records (id, title, alt_title)`` against those that the last sweep left, ``known (id, rank, key)``.

    A record is new to the sweep if it has a key that it hadn't then; a key less alone needs no comparison.
    """
    now = matching.duplicate_keys(records)
    return now, now.join(known, ["id", "rank", "key"], "left_anti").select("id").distinct()


def new_pairs(now: DataFrame, changed: DataFrame, registry: DataFrame) -> DataFrame:
    """(a, b, reason) of the pairs that a changed record is in and that no sweep has flagged before, whatever was decided on them.

    Only keys of changed records are joined with all keys, so that a sweep without changes compares nothing. ``registry (a, b, state, ..)`` has every pair ever flagged.
    A pair can be in it only if all its changed records are; only the pairs of such are held against it, the others leave the join as they are.
    """
    c = F.col
    ids = lambda side: registry.select(c(side).alias("id")).join(changed, "id", "left_semi")
    again = ids("a").union(ids("b")).distinct().withColumn("again", F.lit(True))
    marks = changed.withColumn("new", F.lit(True)).join(again, "id", "left").withColumn("again", F.coalesce("again", F.lit(False)))
    keys = tables.stored(matching.marked_keys(now).join(marks, "id", "left"), "sweep-keys")
    mine, rest = keys.where("new"), keys.where("new IS NULL").drop("new", "again")
    side = lambda df, x: df.withColumnsRenamed({"new": f"new_{x}", "again": f"again_{x}"})
    both, one = matching.pairs_of(side(mine, "a"), side(keys, "b")), matching.pairs_of(rest, side(mine, "b"))
    told = F.coalesce("again_b", F.lit(True))
    fresh = both.where(~c("again_a") | ~told).select("a", "b", "reason").unionByName(one.where("NOT again_b").select("a", "b", "reason"))
    seen = both.where(c("again_a") & told).select("a", "b", "reason").unionByName(one.where("again_b").select("a", "b", "reason"))
    held = keys.where("again").select("id").distinct()
    of = lambda side: registry.select("a", "b").join(held.withColumnRenamed("id", side), side, "left_semi").select("a", "b")
    return fresh.unionByName(seen.join(of("a").unionByName(of("b")), ["a", "b"], "left_anti"))


def sweep(records: DataFrame, known: DataFrame, registry: DataFrame) -> dict[str, DataFrame]:
    """keys: for the next sweep; pairs: the registry ``(a, b, reason, state)`` with the new ones open; found: the new ones. Decisions on pairs stay as they are."""
    now, changed = changed_keys(records, known)
    now, changed = tables.stored(now, "sweep-now"), tables.stored(changed, "sweep-changed")
    found = new_pairs(now, changed, registry)
    return {"keys": now, "found": found, "pairs": registry.select("a", "b", "reason", "state").unionByName(found.withColumn("state", F.lit("open")))}
