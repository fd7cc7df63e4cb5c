"""Runs, health, dashboards, launch gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalogspark.operators import lookup, runs
from catalogspark.registry import register
from catalogspark.sources.fixture import Catalog, sql

_STREAK = sql("runs") + """, islands AS (SELECT *, sum(CASE WHEN status = 'succeeded' THEN 1 ELSE 0 END) OVER (PARTITION BY source_key ORDER BY started_at, id ROWS UNBOUNDED PRECEDING) AS island FROM runs),
  streaks AS (SELECT *, sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY source_key, island ORDER BY started_at, id ROWS UNBOUNDED PRECEDING) AS streak FROM islands)
"""


@register("failure_streaks", _STREAK + "SELECT id, source_key, status, CAST(streak AS BIGINT) AS streak FROM streaks")
def failure_streaks(spark, sf_dir):
    return runs.streaks(Catalog(spark, sf_dir).runs).select("id", "source_key", "status", F.col("streak").cast("bigint").alias("streak"))


@register(
    "health_transitions",
    _STREAK + """SELECT source_key, id, CASE WHEN streak >= 3 THEN 'unhealthy' ELSE 'healthy' END AS turned, CAST(streak AS BIGINT) AS streak
    FROM (SELECT *, coalesce(lag(streak) OVER (PARTITION BY source_key ORDER BY started_at, id), 0) >= 3 AS before FROM streaks) WHERE (streak >= 3) <> before""",
)
def health_transitions(spark, sf_dir):
    return runs.transitions(Catalog(spark, sf_dir).runs).withColumn("streak", F.col("streak").cast("bigint"))


_LAST = "last AS (SELECT source_key, max(started_at) AS latest, arg_max(status, (started_at, id)) AS status, arg_max(id, (started_at, id)) AS id, count(*) AS runs, count(*) FILTER (status = 'failed') AS failures FROM runs GROUP BY source_key)"


@register("source_dashboard", sql("runs") + f", {_LAST} SELECT source_key, id AS last_run, status AS last_status, runs, failures FROM last")
def source_dashboard(spark, sf_dir):
    r = Catalog(spark, sf_dir).runs
    last = lookup.first_by(r, ["source_key"], F.desc("started_at"), F.desc("id")).select("source_key", F.col("id").alias("last_run"), F.col("status").alias("last_status"))
    return last.join(r.groupBy("source_key").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "failed").alias("failures")), "source_key")


@register(
    "source_due",
    sql("runs") + f""", {_LAST} SELECT source_key FROM last WHERE source_key % 6 <> 5 AND status <> 'running' AND
    epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(latest) >= 3600 * CASE source_key % 4 WHEN 0 THEN 22 WHEN 1 THEN 156 WHEN 2 THEN 648 END""",
)
def source_due(spark, sf_dir):
    last = lookup.first_by(Catalog(spark, sf_dir).runs, ["source_key"], F.desc("started_at"), F.desc("id"))
    n = F.col("source_key") % 4
    sources = last.select("source_key", F.col("status").alias("last_status"), F.col("started_at").cast("timestamp").alias("last_started"), (F.col("source_key") % 6 != 5).alias("enabled"), F.when(n == 0, "daily").when(n == 1, "weekly").when(n == 2, "monthly").otherwise("never").alias("cadence"))
    return runs.due(sources, F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00")).cast("timestamp")).select("source_key")


@register("recent_runs", sql("runs") + "SELECT id, source_key, status FROM runs ORDER BY started_at DESC, id DESC LIMIT 20")
def recent_runs(spark, sf_dir):
    return Catalog(spark, sf_dir).runs.orderBy(F.desc("started_at"), F.desc("id")).limit(20).select("id", "source_key", "status")


@register(
    "seed_stage_order",
    sql("runs") + """, firsts AS (SELECT source_key, min(id) FILTER (status = 'succeeded') AS first_success FROM runs GROUP BY source_key),
    stages AS (SELECT source_key % 5 AS stage, bool_and(first_success IS NOT NULL) AS complete, max(first_success) AS completed_at FROM firsts GROUP BY 1)
    SELECT stage, complete, completed_at, coalesce(lag(completed_at) OVER (ORDER BY stage) <= completed_at, true) AS ordered FROM stages""",
)
def seed_stage_order(spark, sf_dir):
    r = Catalog(spark, sf_dir).runs
    firsts = r.groupBy("source_key").agg(F.min(F.when(F.col("status") == "succeeded", F.col("id"))).alias("first"))
    stages = firsts.groupBy((F.col("source_key") % 5).alias("stage")).agg(F.bool_and(F.col("first").isNotNull()).alias("complete"), F.max("first").alias("completed_at"))
    # one row for each stage: a handful, whatever the number of runs
    before = F.lag("completed_at").over(Window.orderBy("stage"))
    return stages.select("*", F.coalesce(before <= F.col("completed_at"), F.lit(True)).alias("ordered"))


@register("qa_sample_status", "SELECT CASE WHEN quality = 1 THEN 'verified' ELSE 'failed' END AS status, count(*) AS n, min(doc_id) AS first_id FROM labels GROUP BY 1")
def qa_sample_status(spark, sf_dir):
    rows = Catalog(spark, sf_dir).raw("labels")
    return rows.groupBy(F.when(F.col("quality") == 1, "verified").otherwise("failed").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@register("qa_sample_draw", sql("series") + "SELECT id FROM series WHERE status = 'active' ORDER BY md5(id || '-7'), id LIMIT 50")
def qa_sample_draw(spark, sf_dir):
    """A seeded uniform sample of 50: the size is the feature."""
    return Catalog(spark, sf_dir).series.where("status = 'active'").select("id").orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit("-7"))), "id").limit(50)


_SOURCES = ["click", "error", "purchase", "signup", "view"]


@register(
    "launch_checklist",
    sql("series", "releases", "runs") + f""", config AS (SELECT false AS bootstrap, true AS swept, 'attested' AS attested),
    firsts AS (SELECT source_key % 5 AS stage, min(id) FILTER (status = 'succeeded') AS first_id FROM runs GROUP BY source_key, stage),
    stages AS (SELECT stage, bool_and(first_id IS NOT NULL) AS complete, max(first_id) AS done_at FROM firsts GROUP BY stage),
    ordered AS (SELECT complete, coalesce(lag(done_at) OVER (ORDER BY stage) <= done_at, true) AS ok FROM stages),
    checks AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'random' ELSE 'prominent' END AS kind, doc_id % 3 + 1 AS round, CASE WHEN quality = 1 THEN 'verified' WHEN toxic = 1 THEN 'failed' ELSE 'pending' END AS status FROM labels),
    samples AS (SELECT kind, bool_and(status = 'verified') AS ok FROM checks c WHERE round = (SELECT max(round) FROM checks d WHERE d.kind = c.kind) GROUP BY kind),
    sources AS (SELECT k AS key, count(event_id) > 0 AS registered, coalesce(bool_or(user_id % 20 <> 0), false) AS ever, coalesce(arg_max(user_id % 20 <> 0, event_id), false) AS healthy
      FROM (SELECT unnest({_SOURCES}) AS k) LEFT JOIN events ON event_type = k GROUP BY k),
    gates AS (SELECT 'seed_stages_complete' AS gate, (SELECT coalesce(bool_and(complete AND ok), false) FROM ordered) AS pass
      UNION ALL SELECT 'quality_gates_pass', (SELECT count(*) = 2 AND coalesce(bool_and(ok), false) FROM samples) AND (SELECT swept FROM config)
        AND NOT EXISTS (SELECT 1 FROM series WHERE status = 'active' GROUP BY title HAVING count(*) > 1)
      UNION ALL SELECT 'bootstrap_off', (SELECT NOT bootstrap FROM config)
      UNION ALL SELECT 'calendar_populated', EXISTS (SELECT 1 FROM releases WHERE status = 'active' AND sort >= 20010615)
      UNION ALL SELECT 'sources_healthy', (SELECT bool_and(registered AND ever AND healthy) FROM sources)
      UNION ALL SELECT 'correction_loop_exercised', (SELECT attested IS NOT NULL FROM config)
      UNION ALL SELECT 'about_data_page', true)
    SELECT * FROM gates UNION ALL SELECT 'ready', bool_and(pass) FROM gates""",
)
def launch_checklist(spark, sf_dir):
    """Every launch gate and whether all pass. Settings are a row of their own; a source is healthy if its latest run succeeded."""
    c = Catalog(spark, sf_dir)
    config = spark.range(1).select(F.lit(False).alias("bootstrap"), F.lit(True).alias("swept"), F.lit("attested").alias("loop"))
    stages = seed_stage_order(spark, sf_dir)
    d, doc = c.raw("labels"), F.col("doc_id")
    status = F.when(F.col("quality") == 1, "verified").when(F.col("toxic") == 1, "failed").otherwise("pending")
    checks = d.select(F.when(doc % 2 == 0, "random").otherwise("prominent").alias("kind"), (doc % 3 + 1).alias("round"), status.alias("status"))
    rounds = checks.groupBy("kind", "round").agg(F.bool_and(F.col("status") == "verified").alias("ok"))
    samples = rounds.groupBy("kind").agg(F.max_by("ok", "round").alias("ok")).agg(((F.count(F.lit(1)) == 2) & F.coalesce(F.bool_and("ok"), F.lit(False))).alias("ok"))
    twins = c.series.where("status = 'active'").groupBy("title").count().agg(F.coalesce(~F.bool_or(F.col("count") > 1), F.lit(True)).alias("ok"))
    good = F.col("user_id") % 20 != 0
    own = c.raw("events").groupBy(F.col("event_type").alias("key")).agg(F.bool_or(good).alias("ever"), F.max_by(good, "event_id").alias("healthy"))
    known = spark.createDataFrame([(k,) for k in _SOURCES], "key string").join(own, "key", "left")
    parts = [
        stages.agg(F.coalesce(F.bool_and(F.col("complete") & F.col("ordered")), F.lit(False)).alias("pass")).select(F.lit("seed_stages_complete").alias("gate"), "pass"),
        *[x.select(F.lit("quality_gates_pass").alias("gate"), F.col("ok").alias("pass")) for x in (samples, twins, config.select(F.col("swept").alias("ok")))],
        config.select(F.lit("bootstrap_off").alias("gate"), (~F.col("bootstrap")).alias("pass")),
        config.select(F.lit("about_data_page").alias("gate"), F.lit(True).alias("pass")),
        c.releases.agg(F.coalesce(F.bool_or((F.col("status") == "active") & (F.col("sort") >= 20010615)), F.lit(False)).alias("pass")).select(F.lit("calendar_populated").alias("gate"), "pass"),
        known.agg(F.bool_and(F.coalesce(F.col("ever") & F.col("healthy"), F.lit(False))).alias("pass")).select(F.lit("sources_healthy").alias("gate"), "pass"),
        config.select(F.lit("correction_loop_exercised").alias("gate"), F.col("loop").isNotNull().alias("pass")),
    ]
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    gates = rows.groupBy("gate").agg(F.bool_and("pass").alias("pass"))
    # eight rows: the gates and their sum
    both = F.array(F.struct("gate", "pass"), F.struct(F.lit("ready").alias("gate"), "pass"))
    return gates.select(F.inline(both)).groupBy("gate").agg(F.bool_and("pass").alias("pass"))


@register("backlog_counts", sql("series") + """SELECT status, least(count(*), 100) AS n, count(*) > 100 AS has_more, min(id) AS first_id FROM series GROUP BY status""")
def backlog_counts(spark, sf_dir):
    """Counts shown up to 100, with a flag for more: the cap is the report's, not the scan's."""
    rows = Catalog(spark, sf_dir).series.groupBy("status").agg(F.count(F.lit(1)).alias("all"), F.min("id").alias("first_id"))
    return rows.select("status", F.least("all", F.lit(100).cast("bigint")).alias("n"), (F.col("all") > 100).alias("has_more"), "first_id")
