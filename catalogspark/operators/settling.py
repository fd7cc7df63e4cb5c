"""What becomes of offered fields to the end: patches and revisions, conflicts put in review, outdated ones withdrawn, and what is only noted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.operators import reconcile, tables


def _entries(changes):
    """A map's entries in one order, so that equal maps are equal."""
    return F.array_sort(F.map_entries(changes))


def settle(offers: DataFrame, proposals: DataFrame, suppressions: DataFrame, revisions: DataFrame, conflicts: DataFrame) -> dict[str, DataFrame]:
    """Change sets of a batch of offers; a batch that comes again unchanged, with what it left, adds nothing.

    ``offers`` has what ``reconcile.decide_field`` reads, and ``observation_id, record_id, field, source_key, value_hash``, a field once for each record. ``proposals (proposal_id, observation_id, state, record_id, base, ops, changes)`` are
    those that observations have queued (``changes`` a map of fields to values, ``ops`` how many operations they hold), ``suppressions (record_id, field, source_key, value_hash)``, ``revisions (record_id, seq)``, ``conflicts (observation_id, field, offered)``.

    patches (record_id, field, value); revisions (record_id, observation_id, seq, changes), one of each record with applied fields; queued (observation_id, record_id, base, changes, replaces), a new proposal where the observation has no open one with
    the same changes from the same base; withdrawn (proposal_id), the open ones that these replace; conflicts, all that are noted now; results (observation_id, record_id, applied, queued, suppressed, recorded, changed).
    """
    c, keys = F.col, ["record_id", "field", "source_key", "value_hash"]
    told = offers.withColumn("action", reconcile.decide_field()).join(suppressions.select(*keys).distinct().withColumn("before", F.lit(True)), keys, "left")
    told = tables.stored(told.withColumn("action", F.when((c("action") == "queue") & c("before"), "suppressed").otherwise(c("action"))).select("observation_id", "record_id", "field", "offered", "action"), "settle-offers")
    of = lambda a: F.map_from_entries(F.array_sort(F.collect_list(F.when(c("action") == a, F.struct("field", "offered")))))
    names = lambda a: F.array_join(F.array_sort(F.collect_list(F.when(c("action") == a, c("field")))), ",")
    sets = told.groupBy("observation_id", "record_id").agg(of("auto").alias("auto"), of("queue").alias("queue"), names("auto").alias("applied"), names("queue").alias("queued"), names("suppressed").alias("suppressed"), names("recordOnly").alias("recorded"))
    last = revisions.groupBy("record_id").agg(F.max("seq").alias("last"))
    open_ = proposals.where("state = 'inReview'").groupBy("observation_id").agg(F.max(F.struct("proposal_id", "record_id", "base", "ops", _entries("changes").alias("entries"))).alias("open"))
    rows = sets.join(last, "record_id", "left").join(open_, "observation_id", "left")
    applies, queues = F.size("auto") > 0, F.size("queue") > 0
    rows = rows.withColumn("base", F.when(applies, F.coalesce("last", F.lit(0)) + 1).otherwise(c("last")))
    same = (c("open.record_id") == c("record_id")) & c("open.base").eqNullSafe(c("base")) & (c("open.ops") == 1) & (c("open.entries") == _entries(c("queue")))
    rows = tables.stored(rows.withColumn("adds", queues & ~F.coalesce(same, F.lit(False))).withColumn("replaces", F.when(c("adds"), c("open.proposal_id"))).drop("open"), "settle-sets")
    noted = told.where("action = 'recordOnly'").select("observation_id", "field", "offered")
    return {
        "patches": rows.select("record_id", F.explode("auto").alias("field", "value")),
        "revisions": rows.where(applies).select("record_id", "observation_id", c("base").alias("seq"), c("auto").alias("changes")),
        "queued": rows.where("adds").select("observation_id", "record_id", "base", c("queue").alias("changes"), "replaces"),
        "withdrawn": rows.where("replaces IS NOT NULL").select(c("replaces").alias("proposal_id")),
        "conflicts": conflicts.join(noted.select("observation_id", "field"), ["observation_id", "field"], "left_anti").select("observation_id", "field", "offered").unionByName(noted),
        "results": rows.select("observation_id", "record_id", "applied", "queued", "suppressed", "recorded", (applies | c("adds")).alias("changed")),
    }
