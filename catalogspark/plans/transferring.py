"""Merges of volumes, releases and bundles with all that refers to them, their log, and their undoing."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogspark.operators import transfers
from catalogspark.registry import register
from catalogspark.sources.fixture import Catalog

#: A member's id is its bundle times this, plus ten times its release and a line: unique below 10^11 releases.
_STEP = 1_000_000_000_000
#: The log's ids are told by its SQL, and unique below a million releases only.
_LOG_STEP = 10_000_000


#: Orders stand for releases (those that leave 1 over four merge into the one before), suppliers for bundles (3 over five into the one before), line items for what refers to them.
def _tables(step: int) -> str:
    return f"""WITH members AS (SELECT min(l_linenumber) + l_suppkey * {step} + l_orderkey * 10 AS id, l_suppkey AS bundle_id, l_orderkey AS release_id, CAST(min(l_linenumber) AS BIGINT) AS position FROM lineitem GROUP BY l_suppkey, l_orderkey),
    entries AS (SELECT o_orderkey AS id, o_custkey % 40 AS user_id, o_orderkey AS release_id FROM orders),
    merges AS (SELECT b.o_orderkey AS loser, a.o_orderkey AS survivor FROM orders b JOIN orders a ON a.o_orderkey = b.o_orderkey - 1 WHERE b.o_orderkey % 4 = 1),
    moved AS (SELECT m.*, survivor, bool_or(survivor IS NULL) OVER w AS held, row_number() OVER (PARTITION BY bundle_id, coalesce(survivor, release_id), survivor IS NULL ORDER BY release_id, id) AS n
      FROM members m LEFT JOIN merges ON loser = release_id WINDOW w AS (PARTITION BY bundle_id, coalesce(survivor, release_id)))
"""


def _release_merge(spark, sf_dir, step=_STEP):
    c, cat = F.col, Catalog(spark, sf_dir)
    members = cat.raw("lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.min("l_linenumber").cast("bigint").alias("position"))
    members = members.select((c("position") + c("l_suppkey") * step + c("l_orderkey") * 10).alias("id"), c("l_suppkey").alias("bundle_id"), c("l_orderkey").alias("release_id"), F.lit(None).cast("bigint").alias("variant_id"), "position")
    orders = cat.raw("orders").select(c("o_orderkey").alias("id"), (c("o_custkey") % 40).alias("user_id"))
    entries = orders.select("id", "user_id", c("id").alias("release_id"))
    releases = orders.select("id", F.lit("active").alias("status"), F.lit(False).alias("locked"), F.lit(None).cast("bigint").alias("merged_into"))
    merges = orders.where("id % 4 = 1").select(c("id").alias("loser"), (c("id") - 1).alias("survivor")).join(orders.select(c("id").alias("survivor")), "survivor")
    tables = {"releases": releases, "bundle_members": members, "entries": entries}
    return tables, transfers.merge(tables, "release", merges)


@register(
    "merge_log",
    _tables(_LOG_STEP) + """SELECT survivor, release_id AS loser, 'bundle_members' AS "table", id AS row_id, CASE WHEN held OR n > 1 THEN 'remove' ELSE 'repoint' END AS action FROM moved WHERE survivor IS NOT NULL
    UNION ALL SELECT survivor, e.release_id, 'entries', e.id, CASE WHEN h.user_id IS NOT NULL THEN 'remove' ELSE 'repoint' END FROM entries e JOIN merges m ON m.loser = e.release_id LEFT JOIN (SELECT user_id, release_id FROM entries) h ON h.user_id = e.user_id AND h.release_id = m.survivor""",
)
def merge_log(spark, sf_dir):
    """What merging releases did to bundles and collections."""
    return _release_merge(spark, sf_dir, _LOG_STEP)[1][1].where("action <> 'merge'").select("survivor", "loser", "table", "row_id", "action")


@register("merge_members", _tables(_STEP) + "SELECT id, bundle_id, coalesce(survivor, release_id) AS release_id, position FROM moved WHERE survivor IS NULL OR NOT held AND n = 1")
def merge_members(spark, sf_dir):
    return _release_merge(spark, sf_dir)[1][0]["bundle_members"].drop("variant_id")


@register("merge_split_back", _tables(_STEP) + "SELECT id, bundle_id AS one, release_id AS two, 'member' AS kind FROM members UNION ALL SELECT id, user_id, release_id, 'entry' FROM entries UNION ALL SELECT o_orderkey, NULL, NULL, 'active' FROM orders")
def merge_split_back(spark, sf_dir):
    """Merged releases merge again with what their survivors' bundles hold, then both merges are split: the tables are as they were."""
    c = F.col
    tables, (once, log) = _release_merge(spark, sf_dir)
    live = once["releases"].where("status = 'active'")
    again = live.where("id % 8 = 4").select(c("id").alias("loser"), (c("id") - 4).alias("survivor")).join(live.select(c("id").alias("survivor")), "survivor")
    twice, later = transfers.merge(once, "release", again)
    back = transfers.split(transfers.split(twice, "release", later), "release", log)
    members = back["bundle_members"].select("id", c("bundle_id").alias("one"), c("release_id").alias("two"), F.lit("member").alias("kind"))
    entries = back["entries"].select("id", c("user_id").alias("one"), c("release_id").alias("two"), F.lit("entry").alias("kind"))
    none = F.lit(None).cast("bigint")
    return members.unionByName(entries).unionByName(back["releases"].select("id", none.alias("one"), none.alias("two"), c("status").alias("kind")))


@register(
    "merge_bundle_order",
    f"""WITH members AS (SELECT l_suppkey AS bundle_id, l_orderkey AS release_id, min(l_linenumber) + l_suppkey * {_STEP} + l_orderkey * 10 AS id, CAST(min(l_linenumber) AS BIGINT) AS position FROM lineitem GROUP BY 1, 2),
    merges AS (SELECT s_suppkey AS loser, s_suppkey - s_suppkey % 5 AS survivor FROM supplier WHERE s_suppkey % 5 IN (3, 4) AND s_suppkey >= 5),
    moved AS (SELECT m.*, survivor, bool_or(survivor IS NULL) OVER w AS held, row_number() OVER (PARTITION BY coalesce(survivor, bundle_id), release_id, survivor IS NULL ORDER BY bundle_id, id) AS n
      FROM members m LEFT JOIN merges ON loser = bundle_id WINDOW w AS (PARTITION BY coalesce(survivor, bundle_id), release_id)),
    kept AS (SELECT *, survivor IS NULL OR NOT held AND n = 1 AS stays FROM moved),
    tops AS (SELECT bundle_id, survivor, max(position) AS top FROM kept WHERE survivor IS NOT NULL AND stays GROUP BY ALL),
    offsets AS (SELECT t.bundle_id, coalesce(b.base, 0) + coalesce(sum(top) OVER (PARTITION BY survivor ORDER BY t.bundle_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o
      FROM tops t LEFT JOIN (SELECT bundle_id, max(position) AS base FROM members GROUP BY 1) b ON b.bundle_id = t.survivor)
    SELECT id, coalesce(survivor, k.bundle_id) AS bundle_id, release_id, CAST(position + coalesce(o, 0) AS BIGINT) AS position FROM kept k LEFT JOIN offsets f ON f.bundle_id = k.bundle_id AND survivor IS NOT NULL WHERE stays""",
)
def merge_bundle_order(spark, sf_dir):
    """Two bundles of five go into the first of the five, their members behind its last, one bundle after the other."""
    c, cat = F.col, Catalog(spark, sf_dir)
    members = cat.raw("lineitem").groupBy(c("l_suppkey").alias("bundle_id"), c("l_orderkey").alias("release_id")).agg(F.min("l_linenumber").cast("bigint").alias("position"))
    members = members.select((c("position") + c("bundle_id") * _STEP + c("release_id") * 10).alias("id"), "bundle_id", "release_id", F.lit(None).cast("bigint").alias("variant_id"), "position")
    s = cat.raw("supplier").select(c("s_suppkey").alias("id"))
    bundles = s.select("id", F.lit("active").alias("status"), F.lit(False).alias("locked"), F.lit(None).cast("bigint").alias("merged_into"))
    merges = s.where("id % 5 IN (3, 4) AND id >= 5").select(c("id").alias("loser"), (c("id") - c("id") % 5).alias("survivor"))
    return transfers.merge({"release_bundles": bundles, "bundle_members": members}, "releaseBundle", merges)[0]["bundle_members"].drop("variant_id")
