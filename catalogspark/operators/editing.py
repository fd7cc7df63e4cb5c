"""Edits with revisions: stale checks, overrides, rebasing and guarded states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values: (state, action, next state). A claim is a mark on a proposal in review and no state.
EDGES = [
    ("draft", "submit", "inReview"), ("draft", "withdraw", "withdrawn"), ("draft", "rebase", "draft"),
    ("inReview", "claim", "inReview"), ("inReview", "unclaim", "inReview"), ("inReview", "withdraw", "withdrawn"), ("inReview", "rebase", "draft"),
    ("inReview", "requestChanges", "draft"), ("inReview", "approve", "approved"), ("inReview", "reject", "rejected"),
]


def latest_revision(revisions: DataFrame) -> DataFrame:
    """(record_id, latest) of ``revisions (record_id, seq)``."""
    return revisions.groupBy("record_id").agg(F.max("seq").alias("latest"))


def stale(ops: DataFrame, records: DataFrame, revisions: DataFrame) -> DataFrame:
    """``ops (record_id, base)`` with a reason: unavailable, baseChanged or null."""
    rows = ops.join(records.select(F.col("id").alias("record_id"), "status", "locked"), "record_id", "left").join(latest_revision(revisions), "record_id", "left")
    gone = F.col("status").isNull() | (F.col("status") != "active") | F.coalesce("locked", F.lit(False))
    return rows.select(*ops.columns, F.when(gone, "unavailable").when(~F.col("base").eqNullSafe(F.col("latest")), "baseChanged").alias("reason"))


def rebase(changes: DataFrame, current: DataFrame) -> DataFrame:
    """``changes (record_id, field, after)`` against ``current (record_id, field, value)``: what is true already goes, the rest gets a new before."""
    rows = changes.join(current, ["record_id", "field"], "left")
    return rows.where(~F.col("value").eqNullSafe(F.col("after"))).select("record_id", "field", F.col("value").alias("before"), "after")


def overrides(edits: DataFrame) -> DataFrame:
    """(record_id, fields): the sorted import-authored fields that people have edited, from ``edits (record_id, field, author, seq)``."""
    from pyspark.sql import Window

    last = F.lag("author").over(Window.partitionBy("record_id", "field").orderBy("seq"))
    hit = edits.withColumn("last", last).where("author = 'user' AND last = 'import'")
    return hit.groupBy("record_id").agg(F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))


def advance(items: DataFrame, commands: DataFrame) -> DataFrame:
    """``items (id, state, claimed_by)`` after ``commands (id, action, user_id)``, one at most for each; what no edge allows is refused.

    A claim puts its user's mark in place of any other, and every other action that is allowed takes the mark away.
    """
    edges = items.sparkSession.createDataFrame(EDGES, "state string, action string, next string")
    rows = items.join(commands, "id", "left").join(F.broadcast(edges), ["state", "action"], "left")  # a fixed table of ten rows
    done = F.col("next").isNotNull()
    claimed = F.when(done & (F.col("action") == "claim"), F.col("user_id")).when(~done, F.col("claimed_by"))
    return rows.select("id", F.coalesce("next", "state").alias("state"), claimed.alias("claimed_by"), (F.col("action").isNotNull() & ~done).alias("refused"))


def bad_references(ops: DataFrame) -> DataFrame:
    """Ops of ``ops (plan_id, position, temp_id, ref)`` that refer to an id that no earlier op of the plan makes."""
    made = ops.where("temp_id IS NOT NULL").groupBy("plan_id", F.col("temp_id").alias("ref")).agg(F.min("position").alias("made_at"))
    rows = ops.where("ref IS NOT NULL").join(made, ["plan_id", "ref"], "left")
    return rows.where("made_at IS NULL OR made_at >= position").select("plan_id", "position", "ref")


def sensitive(records: DataFrame, commands: DataFrame) -> dict[str, DataFrame]:
    """Hiding, restoring, locking and unlocking: ``records (id, status, locked)`` after ``commands (record_id, seq, action)`` in order of ``seq``, and what each command did.

    Only active, unlocked records are hidden and only hidden ones restored (a merge is never reversed by it); active unlocked records are locked, locked ones unlocked. ``told`` is (record_id, seq, field, before, after, problem):
    a revision's change, or badState, locked or notFound. A record's commands are one array, as their number is that of its moderators' clicks.
    """
    c = F.col
    entry = "array<struct<seq:bigint,field:string,before:string,after:string,problem:string>>"
    mine = commands.groupBy(c("record_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(c("seq").cast("bigint").alias("seq"), "action"))).alias("cs"))
    rows = mine.join(records.select("id", "status", F.coalesce("locked", F.lit(False)).alias("locked")), "id", "left")
    start = F.struct(c("status").alias("status"), c("locked").alias("locked"), F.array().cast(entry).alias("told"))

    def step(s, x):
        active, hidden, a = s["status"] == "active", s["status"] == "hidden", x["action"]
        problem = (
            F.when(s["status"].isNull(), "notFound").when((a == "hide") & active & s["locked"], "locked")
            .when(F.coalesce((a == "hide") & active | (a == "restore") & hidden | (a == "lock") & active & ~s["locked"] | (a == "unlock") & s["locked"], F.lit(False)), F.lit(None)).otherwise("badState")
        )
        done, status = problem.isNull(), a.isin("hide", "restore")
        field = F.when(done, F.when(status, "status").otherwise("locked"))
        after_status = F.when(done & (a == "hide"), "hidden").when(done & (a == "restore"), "active").otherwise(s["status"])
        after_locked = F.when(done & ~status, a == "lock").otherwise(s["locked"])
        told = F.struct(
            x["seq"].alias("seq"), field.alias("field"), F.when(done, F.when(status, s["status"]).otherwise(s["locked"].cast("string"))).alias("before"),
            F.when(done, F.when(status, after_status).otherwise(after_locked.cast("string"))).alias("after"), problem.alias("problem"),
        )
        return F.struct(after_status.alias("status"), after_locked.alias("locked"), F.array_append(s["told"], told).cast(entry).alias("told"))

    rows = rows.withColumn("end", F.aggregate("cs", start, step))
    end = rows.where("status IS NOT NULL").select("id", F.struct("end.status", "end.locked").alias("end"))
    now = records.join(end, "id", "left").select("id", F.coalesce("end.status", "status").alias("status"), F.coalesce("end.locked", "locked", F.lit(False)).alias("locked"))
    return {"records": now, "told": rows.select(c("id").alias("record_id"), F.inline("end.told"))}
