"""The registry of import sources: rows that are added once, edited in batches, and told about when their health turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.operators import lookup

#: How far a source is believed on a kind of field.
LEVELS = ["authoritative", "standard", "weak"]
_OWN = ["name", "enabled", "scope", "authority", "cadence", "attribution"]


def _fresh(rows: DataFrame) -> DataFrame:
    return rows.select("key", *_OWN, F.lit("healthy").alias("health"), F.lit(0).alias("failures"))


def seed(registry: DataFrame, defaults: DataFrame) -> DataFrame:
    """``registry (key, name, enabled, scope, authority, cadence, attribution, health, failures)`` with the defaults whose key it lacks; edited rows stay as they are."""
    return registry.select("key", *_OWN, "health", "failures").unionByName(_fresh(defaults.dropDuplicates(["key"]).join(registry.select("key"), "key", "left_anti")))


def upsert(registry: DataFrame, edits: DataFrame) -> dict[str, DataFrame]:
    """``registry`` after ``edits (seq, role, key, name, enabled, scope, authority map<string,string>, cadence, attribution)`` in order of ``seq``.

    Keys and cadences are trimmed and lower-cased, other texts trimmed; a blank attribution is none. The last edit of a key that is
    allowed says all of its row but its health, which a new row begins as healthy. ``told`` is (seq, key, problem): invalidAuthority for a level that isn't one, forbidden, invalidKey or null.
    """
    c, trim = F.col, lambda x: F.regexp_replace(x, r"^[\s\h]+|[\s\h]+\z", "")
    rows = edits.withColumn("key", F.lower(trim(c("key")))).withColumn("name", trim(c("name"))).withColumn("scope", trim(c("scope")))
    rows = rows.withColumn("cadence", F.lower(trim(c("cadence")))).withColumn("attribution", F.nullif(trim(c("attribution")), F.lit("")))
    levels = F.forall(F.map_values("authority"), lambda x: x.isin(*LEVELS))
    problem = (
        F.when(~F.coalesce(levels, F.lit(False)), "invalidAuthority").when(~c("role").eqNullSafe(F.lit("administrator")), "forbidden")
        .when(~F.coalesce(c("key").rlike(r"^[a-z][a-z0-9-]*\z"), F.lit(False)), "invalidKey")
    )
    rows = rows.withColumn("problem", problem)
    last = lookup.first_by(rows.where("problem IS NULL"), ["key"], F.desc("seq"))
    new = _fresh(last.join(registry.select("key"), "key", "left_anti"))
    edited = registry.select("key", "health", "failures").join(last.select("key", *_OWN), "key")
    kept = registry.select("key", *_OWN, "health", "failures").join(last.select("key"), "key", "left_anti")
    return {"registry": kept.unionByName(edited.select(*kept.columns)).unionByName(new), "told": rows.select("seq", "key", "problem")}


def alerts(turns: DataFrame, registry: DataFrame, site: str, page: str, lines: int = 5) -> DataFrame:
    """(key, subject, text) of letters for ``turns (key, turn, failures, errors array<string>)``, turn being unhealthy or recovered; a source that isn't registered goes by its key, and the first ``lines`` errors are told."""
    rows = turns.join(registry.select("key", F.col("name")), "key", "left").withColumn("name", F.coalesce("name", "key"))
    ill = F.col("turn") == "unhealthy"
    about = F.concat(F.lit('The import source "'), "name", F.lit('" ('), "key", F.lit(")"))
    first = F.slice(F.coalesce("errors", F.array().cast("array<string>")), 1, lines)
    told = F.when(F.size(first) > 0, F.concat(F.array(F.lit("Errors from the latest run:")), F.transform(first, lambda e: F.concat(F.lit("  - "), e)), F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
    where = F.lit(f"Run history: {page}")
    bad = F.concat(
        F.array(F.concat(about, F.lit(" is unhealthy after "), F.col("failures").cast("string"), F.lit(" consecutive failed runs.")), F.lit("")), told,
        F.array(F.lit("It will keep retrying on its registry cadence; you will get one more email when it recovers."), where),
    )
    good = F.array(F.concat(about, F.lit(" recovered — its latest run succeeded and it is healthy again.")), where)
    subject = F.concat(F.lit(f"[{site}] Import source "), "turn", F.lit(": "), "name")
    return rows.select("key", subject.alias("subject"), F.array_join(F.when(ill, bad).otherwise(good), "\n").alias("text"))
