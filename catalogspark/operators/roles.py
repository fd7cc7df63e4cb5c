"""Roles of the data team: who may appoint, revoke, suspend and reinstate whom, the last administrator, and the audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values: (who, whom they govern).
GOVERNS = {"administrator": ["administrator", "moderator", "editor"], "moderator": ["editor"]}


def can_govern(actor, target) -> Column:
    out = F.lit(False)
    for who, whom in GOVERNS.items():
        out = out | ((F.col(actor) == who) & F.col(target).isin(*whom))
    return F.coalesce(out, F.lit(False))


def govern(commands: DataFrame, users: DataFrame) -> DataFrame:
    """(seq, user_id, role, suspended, problem, audit) of each command: the user afterwards, why it was refused, and its audit rows in order.

    ``commands (seq, actor_id, action, user_id, role, reason)`` with the actions appoint, revoke, suspend and reinstate, at most one for each user,
    carried out in the order of ``seq``; ``users (user_id, role, suspended)``. Actors have the role they had before the batch, and none while suspended.
    Problems: unknownUser, forbidden, noChange, lastAdministrator. The last one is told from a running count of active administrators:
    their number never falls below one, so a removal is refused exactly where the sum of all changes so far reaches a new low under one. Only commands
    that make or unmake an administrator are counted, and those are few.
    """
    c = F.col
    target = users.select("user_id", c("role").alias("now"), F.coalesce("suspended", F.lit(False)).alias("was_suspended"), F.lit(True).alias("known"))
    actor = users.where("NOT coalesce(suspended, false)").select(c("user_id").alias("actor_id"), c("role").alias("actor_role"))
    rows = commands.join(target, "user_id", "left").join(actor, "actor_id", "left")
    rows = rows.withColumn("governed", F.when(c("action") == "appoint", c("role")).when(c("action") == "revoke", c("now")).otherwise(F.coalesce("now", F.lit("editor"))))
    own = can_govern("actor_role", "governed")
    appoint, revoke, suspend, reinstate = (c("action") == a for a in ("appoint", "revoke", "suspend", "reinstate"))
    problem = (
        F.when(c("known").isNull(), "unknownUser")
        .when(revoke & c("now").isNull(), "noChange")
        .when(~own, "forbidden")
        .when(appoint & c("now").eqNullSafe(c("role")), "noChange")
        .when(appoint & c("now").isNotNull() & ~can_govern("actor_role", "now"), "forbidden")
        .when(suspend & (c("user_id") == c("actor_id")), "forbidden")
        .when(suspend & c("was_suspended") | reinstate & ~c("was_suspended"), "noChange")
    )
    was = F.coalesce(c("now") == "administrator", F.lit(False)) & ~c("was_suspended")
    loses, gains = was & (appoint | revoke | suspend), ~c("was_suspended") & appoint & (c("role") == "administrator") | reinstate & (c("now") == "administrator")
    rows = rows.withColumn("problem", problem).withColumn("change", F.when(c("problem").isNotNull(), 0).when(loses, -1).when(gains, 1).otherwise(0))
    start = users.where("role = 'administrator' AND NOT coalesce(suspended, false)").count()
    order = Window.orderBy("seq")
    sums = rows.where("change <> 0").select("seq", "change", (1 - start - F.sum("change").over(order)).alias("short"))
    before = F.greatest(F.lit(0), F.coalesce(F.max("short").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = sums.select("seq", ((c("change") == -1) & (c("short") > before)).alias("last")).where("last")
    rows = rows.join(last, "seq", "left").withColumn("problem", F.when(c("last"), "lastAdministrator").otherwise(c("problem")))
    done = c("problem").isNull()
    entry = lambda what, role, reason: F.struct(F.lit(what).alias("action"), role.alias("role"), reason.alias("reason"))
    changed = F.when(appoint & c("now").isNotNull(), entry("revoked", c("now"), F.coalesce("reason", F.concat(F.lit("Role changed to "), "role", F.lit(".")))))
    told = F.when(appoint, entry("appointed", c("role"), c("reason"))).when(revoke, entry("revoked", c("now"), c("reason"))).when(suspend, entry("suspended", c("governed"), c("reason"))).otherwise(entry("reinstated", c("governed"), c("reason")))
    audit = F.when(done, F.array_compact(F.array(changed, told))).otherwise(F.array().cast("array<struct<action:string,role:string,reason:string>>"))
    role = F.when(done & appoint, c("role")).when(done & revoke, F.lit(None)).otherwise(c("now"))
    suspended = F.when(done & suspend, True).when(done & reinstate, False).otherwise(c("was_suspended"))
    return rows.select("seq", "user_id", "actor_id", role.alias("role"), suspended.alias("suspended"), "problem", audit.alias("audit"))


def users_after(users: DataFrame, governed: DataFrame) -> DataFrame:
    """``users (user_id, role, suspended)`` after the commands that ``governed`` tells of."""
    new = governed.where("problem IS NULL").select("user_id", F.struct("role", "suspended").alias("new"))
    old = F.struct("role", F.coalesce("suspended", F.lit(False)).alias("suspended"))
    return users.join(new, "user_id", "left").select("user_id", F.coalesce("new", old).alias("u")).select("user_id", "u.*")


def audit_rows(governed: DataFrame) -> DataFrame:
    """(seq, place, user_id, actor_id, action, role, reason): a row for each entry of the audit, which is only ever added to."""
    return governed.select("seq", "user_id", "actor_id", F.posexplode("audit").alias("place", "x")).select("seq", "place", "user_id", "actor_id", "x.*")
