"""Edits, proposals and their states over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogspark.operators import editing
from catalogspark.registry import register
from catalogspark.sources.fixture import Catalog

_STALE = """WITH revisions AS (SELECT l_partkey AS record_id, l_orderkey AS seq FROM lineitem),
records AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN 'hidden' ELSE 'active' END AS status, p_partkey % 7 = 0 AS locked FROM part),
ops AS (SELECT l_partkey AS record_id, max(l_orderkey) AS base FROM lineitem WHERE l_linenumber < 5 GROUP BY 1)
"""


def _edit_tables(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    lines = c.raw("lineitem")
    revisions = lines.select(F.col("l_partkey").alias("record_id"), F.col("l_orderkey").alias("seq"))
    key = F.col("p_partkey")
    records = c.raw("part").select(key.alias("id"), F.when(key % 11 == 0, "hidden").otherwise("active").alias("status"), (key % 7 == 0).alias("locked"))
    ops = lines.where("l_linenumber < 5").groupBy(F.col("l_partkey").alias("record_id")).agg(F.max("l_orderkey").alias("base"))
    return ops, records, revisions


@register(
    "stale_records",
    _STALE + """SELECT o.record_id, o.base, CASE WHEN r.status IS NULL OR r.status <> 'active' OR r.locked THEN 'unavailable' WHEN o.base IS DISTINCT FROM v.latest THEN 'baseChanged' END AS reason
    FROM ops o LEFT JOIN records r ON r.id = o.record_id LEFT JOIN (SELECT record_id, max(seq) AS latest FROM revisions GROUP BY 1) v ON v.record_id = o.record_id""",
)
def stale_records(spark, sf_dir):
    return editing.stale(*_edit_tables(spark, sf_dir))


@register(
    "rebase_changes",
    """SELECT p_partkey AS record_id, f.field, f.value AS before, f.after FROM part,
    LATERAL (SELECT 'brand' AS field, p_brand AS value, 'Brand#11' AS after UNION ALL SELECT 'size', CAST(p_size AS VARCHAR), '7') f WHERE f.value IS DISTINCT FROM f.after""",
)
def rebase_changes(spark, sf_dir):
    part = Catalog(spark, sf_dir).raw("part")
    current = part.select(F.col("p_partkey").alias("record_id"), F.explode(F.array(F.struct(F.lit("brand").alias("field"), F.col("p_brand").alias("value")), F.struct(F.lit("size").alias("field"), F.col("p_size").cast("string").alias("value")))).alias("x")).select("record_id", "x.*")
    changes = current.select("record_id", "field", F.when(F.col("field") == "brand", "Brand#11").otherwise("7").alias("after"))
    return editing.rebase(changes, current)


@register(
    "human_overrides",
    """WITH edits AS (SELECT user_id AS record_id, event_type AS field, CASE WHEN event_id % 3 = 0 THEN 'user' ELSE 'import' END AS author, event_id AS seq FROM events),
    marked AS (SELECT *, lag(author) OVER (PARTITION BY record_id, field ORDER BY seq) AS last FROM edits)
    SELECT record_id, string_agg(DISTINCT field, ',' ORDER BY field) AS fields FROM marked WHERE author = 'user' AND last = 'import' GROUP BY record_id""",
)
def human_overrides(spark, sf_dir):
    e = Catalog(spark, sf_dir).raw("events")
    return editing.overrides(e.select(F.col("user_id").alias("record_id"), F.col("event_type").alias("field"), F.when(F.col("event_id") % 3 == 0, "user").otherwise("import").alias("author"), F.col("event_id").alias("seq")))


_STATES, _ACTIONS = ["draft", "inReview", "withdrawn", "rejected", "approved"], ["submit", "claim", "withdraw", "approve", "reject", "unclaim", "requestChanges", "rebase"]


@register(
    "proposal_transitions",
    f"""WITH items AS (SELECT o_orderkey AS id, ({_STATES})[CAST(o_orderkey % 5 AS INTEGER) + 1] AS state, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS claimed_by,
      CASE WHEN o_orderkey % 11 <> 0 THEN ({_ACTIONS})[CAST(o_orderkey % 8 AS INTEGER) + 1] END AS action FROM orders),
    told AS (SELECT *, CASE WHEN state = 'draft' AND action = 'submit' THEN 'inReview' WHEN state IN ('draft', 'inReview') AND action = 'withdraw' THEN 'withdrawn' WHEN state IN ('draft', 'inReview') AND action = 'rebase' THEN 'draft'
      WHEN state <> 'inReview' THEN NULL WHEN action IN ('claim', 'unclaim') THEN 'inReview' WHEN action = 'requestChanges' THEN 'draft' WHEN action = 'approve' THEN 'approved' WHEN action = 'reject' THEN 'rejected' END AS next FROM items)
    SELECT id, coalesce(next, state) AS state, CASE WHEN next IS NULL THEN claimed_by WHEN action = 'claim' THEN id % 9 END AS claimed_by, action IS NOT NULL AND next IS NULL AS refused FROM told""",
)
def proposal_transitions(spark, sf_dir):
    k = F.col("id")
    o = Catalog(spark, sf_dir).raw("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("claimed_by"))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    return editing.advance(o.withColumn("state", pick(_STATES)), o.where("id % 11 <> 0").select("id", pick(_ACTIONS).alias("action"), (k % 9).alias("user_id")))


@register(
    "plan_bad_references",
    """WITH ops AS (SELECT l_orderkey AS plan_id, l_linenumber AS position, l_partkey % 8 AS temp_id, CASE WHEN l_linenumber > 1 THEN l_suppkey % 8 END AS ref FROM lineitem),
    made AS (SELECT plan_id, temp_id, min(position) AS made_at FROM ops GROUP BY ALL)
    SELECT o.plan_id, o.position, o.ref FROM ops o LEFT JOIN made m ON m.plan_id = o.plan_id AND m.temp_id = o.ref WHERE o.ref IS NOT NULL AND (m.made_at IS NULL OR m.made_at >= o.position)""",
)
def plan_bad_references(spark, sf_dir):
    ops = Catalog(spark, sf_dir).raw("lineitem").select(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("position"), (F.col("l_partkey") % 8).alias("temp_id"), F.when(F.col("l_linenumber") > 1, F.col("l_suppkey") % 8).alias("ref"))
    return editing.bad_references(ops)


_SENSITIVE = """WITH RECURSIVE c AS (SELECT l_partkey AS id, l_orderkey * 100000 + l_suppkey * 10 + l_linenumber AS seq, ['hide', 'restore', 'lock', 'unlock'][CAST((l_orderkey + l_linenumber) % 4 AS INTEGER) + 1] AS action FROM lineitem WHERE l_quantity < 12),
    n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq, action) AS k FROM c),
    walk(id, k, seq, status, locked, action, was, held, problem) AS (
      SELECT p_partkey, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CASE WHEN p_partkey % 10 = 7 THEN 'merged' WHEN p_partkey % 11 = 0 THEN 'hidden' ELSE 'active' END, p_partkey % 13 = 0, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), false, CAST(NULL AS VARCHAR) FROM part
      UNION ALL SELECT w.id, n.k, n.seq,
        CASE WHEN n.action = 'hide' AND w.status = 'active' AND NOT w.locked THEN 'hidden' WHEN n.action = 'restore' AND w.status = 'hidden' THEN 'active' ELSE w.status END,
        CASE WHEN n.action = 'lock' AND w.status = 'active' THEN true WHEN n.action = 'unlock' THEN false ELSE w.locked END, n.action, w.status, w.locked,
        CASE WHEN n.action = 'hide' AND w.status = 'active' THEN CASE WHEN w.locked THEN 'locked' END WHEN n.action = 'restore' AND w.status = 'hidden' THEN NULL WHEN n.action = 'lock' AND w.status = 'active' AND NOT w.locked THEN NULL
          WHEN n.action = 'unlock' AND w.locked THEN NULL ELSE 'badState' END
      FROM walk w JOIN n ON n.id = w.id AND n.k = w.k + 1)
"""


def _sensitive(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    k = F.col("id")
    records = c.raw("part").select(F.col("p_partkey").alias("id")).select("id", F.when(k % 10 == 7, "merged").when(k % 11 == 0, "hidden").otherwise("active").alias("status"), (k % 13 == 0).alias("locked"))
    n = (F.col("l_orderkey") + F.col("l_linenumber")) % 4 + 1
    commands = c.raw("lineitem").where("l_quantity < 12").select(
        F.col("l_partkey").alias("record_id"), (F.col("l_orderkey") * 100000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("seq"), F.element_at(F.array(*map(F.lit, ["hide", "restore", "lock", "unlock"])), n.cast("int")).alias("action")
    )
    return editing.sensitive(records, commands)


@register("records_moderated", _SENSITIVE + "SELECT id, arg_max(status, k) AS status, arg_max(locked, k) AS locked FROM walk GROUP BY id")
def records_moderated(spark, sf_dir):
    return _sensitive(spark, sf_dir)["records"]


@register(
    "moderation_told",
    _SENSITIVE + """SELECT id AS record_id, seq, CASE WHEN problem IS NULL THEN CASE WHEN action IN ('hide', 'restore') THEN 'status' ELSE 'locked' END END AS field,
      CASE WHEN problem IS NULL THEN CASE WHEN action IN ('hide', 'restore') THEN was ELSE CAST(held AS VARCHAR) END END AS before,
      CASE WHEN problem IS NULL THEN CASE WHEN action IN ('hide', 'restore') THEN status ELSE CAST(locked AS VARCHAR) END END AS after, problem FROM walk WHERE k > 0""",
)
def moderation_told(spark, sf_dir):
    return _sensitive(spark, sf_dir)["told"]
