"""Reports that readers file on a series: a review item without ops for each that is accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.operators import quota

#: Longest report in UTF-16 units; reports an hour and at once.
MOST, AN_HOUR, AT_ONCE = 2000, 10, 3


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\h\x{FEFF}\x{2028}\x{2029}]+|[\s\h\x{FEFF}\x{2028}\x{2029}]+\z", "")


def submit(reports: DataFrame, series: DataFrame, users: DataFrame, period: int, rate: int = AN_HOUR, capacity: int = AT_ONCE) -> dict[str, DataFrame]:
    """What becomes of ``reports (id, user_id, series_id, message, at)``, as if they came one after another by (at, id); ``period`` is an hour in ``at``'s units.

    ``told`` is (id, problem): unknownUser, rateLimited, emptyReport, reportTooLong, notFound or null. A report that is refused for another reason takes no
    token, but a user without a token is told so first. ``proposals`` (id, author_id, role, state, version_no, submitted_at) and ``versions`` (id, version_no,
    comment, url, note) hold the accepted ones. ``series (id, title, status)``; ``users (id, role)``. A null message is an empty one.
    """
    c = F.col
    text = _trimmed(F.coalesce("message", F.lit("")))
    known = users.select(c("id").alias("user_id"), "role", F.lit(True).alias("known"))
    about = series.where("status = 'active'").select(c("id").alias("series_id"), "title")
    rows = reports.select("id", "user_id", "series_id", "at", text.alias("text")).join(known, "user_id", "left").join(about, "series_id", "left")
    units = F.octet_length(F.encode("text", "UTF-16BE")) / 2
    own = F.when(c("text") == "", "emptyReport").when(units > MOST, "reportTooLong").when(c("title").isNull(), "notFound")
    rows = rows.withColumn("own", own).withColumn("takes", own.isNull())
    free = quota.token_bucket(rows.where("known"), rate, period, capacity, takes="takes").select("id", "allowed")
    rows = rows.join(free, "id", "left").withColumn("problem", F.when(c("known").isNull(), "unknownUser").when(~c("allowed"), "rateLimited").otherwise(c("own")))
    good = rows.where("problem IS NULL")
    return {
        "told": rows.select("id", "problem"),
        "proposals": good.select("id", c("user_id").alias("author_id"), "role", F.lit("inReview").alias("state"), F.lit(1).alias("version_no"), c("at").alias("submitted_at")),
        "versions": good.select(
            "id", F.lit(1).alias("version_no"), F.concat(F.lit("[Report] "), "title", F.lit(": "), "text").alias("comment"),
            F.concat(F.lit("/series/"), c("series_id").cast("string")).alias("url"), F.concat(F.lit("Reported from the Series page: "), "title").alias("note"),
        ),
    }
