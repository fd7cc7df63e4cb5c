"""Observations, authority and field decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogspark.operators import lookup, reconcile
from catalogspark.registry import register
from catalogspark.sources.fixture import Catalog, sql

_LEVEL = "CASE event_type WHEN 'purchase' THEN 'authoritative' WHEN 'signup' THEN 'standard' WHEN 'view' THEN 'weak' END"
_RANK = "CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'view' THEN 1 ELSE 0 END"


@register("authority_rank", f"SELECT event_id, {_RANK} AS rank FROM events")
def authority_rank(spark, sf_dir):
    level = F.expr(_LEVEL)
    return Catalog(spark, sf_dir).raw("events").select("event_id", reconcile.authority_rank(level).alias("rank"))


_SPLIT = "(SELECT quantile_disc(event_id, 0.7) FROM events)"


@register(
    "observation_upsert",
    sql("observations") + """, old AS (SELECT source_key, record_id, arg_max(snapshot, id) AS snapshot, max(seen_at) AS last_seen FROM observations WHERE id % 10 < 7 GROUP BY ALL),
    batch AS (SELECT source_key, record_id, arg_max(snapshot, id) AS snapshot, arg_max(seen_at, id) AS seen_at FROM observations WHERE id % 10 >= 7 GROUP BY ALL)
    SELECT source_key, record_id, CASE WHEN b.seen_at IS NOT NULL THEN b.snapshot ELSE o.snapshot END AS snapshot, CAST(floor(epoch(coalesce(b.seen_at, o.last_seen))) AS BIGINT) AS last_seen,
      CASE WHEN b.seen_at IS NOT NULL THEN false ELSE CAST(record_id AS INTEGER) % 4 = 0 END AS withdrawn,
      CASE WHEN b.seen_at IS NULL THEN 'absent' WHEN o.last_seen IS NULL THEN 'new' WHEN o.snapshot IS NOT DISTINCT FROM b.snapshot THEN 'same' ELSE 'changed' END AS change
    FROM old o FULL JOIN batch b USING (source_key, record_id)""",
)
def observation_upsert(spark, sf_dir):
    return _upsert(spark, sf_dir)["state"].withColumn("last_seen", F.unix_seconds(F.col("last_seen").cast("timestamp")))


def _upsert(spark, sf_dir):
    spark.conf.get("spark.sql.session.timeZone")
    o = Catalog(spark, sf_dir).observations.withColumn("seen_at", F.col("seen_at").cast("timestamp_ntz"))
    last = lambda df: df.groupBy("source_key", "record_id").agg(F.max_by("snapshot", "id").alias("snapshot"), F.max_by("seen_at", "id").alias("seen_at"), F.max("seen_at").alias("last_seen"))
    old = last(o.where("id % 10 < 7")).select("source_key", "record_id", "snapshot", "last_seen", (F.col("record_id").cast("int") % 4 == 0).alias("withdrawn"))
    return reconcile.upsert_observations(old, last(o.where("id % 10 >= 7")).drop("last_seen"))


@register(
    "observation_superseded",
    sql("observations") + """, old AS (SELECT source_key, record_id, arg_max(snapshot, id) AS snapshot FROM observations WHERE id % 10 < 7 GROUP BY ALL),
    batch AS (SELECT source_key, record_id, arg_max(snapshot, id) AS snapshot FROM observations WHERE id % 10 >= 7 GROUP BY ALL)
    SELECT source_key, record_id, o.snapshot FROM old o JOIN batch b USING (source_key, record_id) WHERE o.snapshot IS DISTINCT FROM b.snapshot""",
)
def observation_superseded(spark, sf_dir):
    return _upsert(spark, sf_dir)["history"].drop("superseded_at")


@register(
    "observation_history",
    sql("observations") + """, marked AS (SELECT *, CASE WHEN lag(id) OVER w IS NULL OR snapshot IS DISTINCT FROM lag(snapshot) OVER w THEN 1 ELSE 0 END AS begun FROM observations WINDOW w AS (PARTITION BY source_key, record_id ORDER BY seen_at, id)),
    numbered AS (SELECT *, sum(begun) OVER (PARTITION BY source_key, record_id ORDER BY seen_at, id ROWS UNBOUNDED PRECEDING) AS version FROM marked)
    SELECT source_key, record_id, CAST(version AS BIGINT) AS version, min(snapshot) AS snapshot, strftime(min(seen_at), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(seen_at), '%Y-%m-%d %H:%M:%S') AS last_seen FROM numbered GROUP BY ALL""",
)
def observation_history(spark, sf_dir):
    v = reconcile.versions(Catalog(spark, sf_dir).observations)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return v.select("source_key", "record_id", "version", "snapshot", text("first_seen"), text("last_seen"))


@register(
    "withdrawn_records",
    sql("observations") + """, seen AS (SELECT source_key, record_id, max(seen_at) AS last_seen FROM observations GROUP BY ALL)
    SELECT source_key, record_id FROM seen WHERE last_seen < (SELECT max(seen_at) - INTERVAL 10 DAY FROM observations)""",
)
def withdrawn_records(spark, sf_dir):
    """Records that a sweep which began ten days before the end of the feed did not see."""
    o = Catalog(spark, sf_dir).observations
    began = o.agg((F.max("seen_at") - F.expr("INTERVAL '10' DAY")).alias("began"))
    seen = o.groupBy("source_key", "record_id").agg(F.max("seen_at").alias("last_seen"))
    return seen.join(F.broadcast(began), F.col("last_seen") < F.col("began")).select("source_key", "record_id")


_OFFERS = f"""offers AS (SELECT event_id, user_id AS record_id, event_type AS source, CAST(json_extract_string(props, '$.k') AS INTEGER) AS offered, {_RANK} AS rank, event_id % 29 = 0 AS overridden, ts FROM events),
  ranked AS (SELECT *, lag(offered) OVER w AS current, lag(source) OVER w AS prev_source, lag(rank) OVER w AS prev_rank, row_number() OVER w AS seq FROM offers WINDOW w AS (PARTITION BY record_id ORDER BY ts, event_id)),
  told AS (SELECT *, CASE WHEN seq = 1 THEN 'none' WHEN event_id % 7 = 0 THEN 'human' WHEN event_id % 11 = 0 THEN 'unattributed' ELSE 'source' END AS incumbent FROM ranked)"""


@register(
    "field_decisions",
    f"""WITH {_OFFERS} SELECT event_id, CASE WHEN current IS NOT DISTINCT FROM offered THEN 'skip' WHEN overridden THEN 'queue' WHEN rank <= 0 THEN 'recordOnly'
      WHEN current IS NULL AND incumbent = 'none' THEN 'auto' WHEN incumbent <> 'source' THEN 'queue' WHEN prev_source = source THEN 'auto'
      WHEN rank > prev_rank THEN 'auto' WHEN rank = prev_rank THEN 'queue' ELSE 'recordOnly' END AS action FROM told""",
)
def field_decisions(spark, sf_dir):
    from pyspark.sql import Window

    e = Catalog(spark, sf_dir).raw("events")
    w = Window.partitionBy("record_id").orderBy("ts", "event_id")
    rows = e.select("event_id", F.col("user_id").alias("record_id"), F.col("event_type").alias("source"), F.get_json_object("props", "$.k").try_cast("int").alias("offered"), reconcile.authority_rank(F.expr(_LEVEL)).alias("rank"), (F.col("event_id") % 29 == 0).alias("overridden"), "ts")
    rows = rows.select("*", F.lag("offered").over(w).alias("current"), F.lag("source").over(w).alias("incumbent_source"), F.lag("rank").over(w).alias("incumbent_rank"), F.row_number().over(w).alias("seq"))
    incumbent = F.when(F.col("seq") == 1, "none").when(F.col("event_id") % 7 == 0, "human").when(F.col("event_id") % 11 == 0, "unattributed").otherwise("source")
    rows = rows.select("*", incumbent.alias("incumbent"), F.lit(None).cast("boolean").alias("dates_agree"), F.lit(None).cast("int").alias("finer"))
    return rows.select("event_id", reconcile.decide_field().alias("action"))


@register(
    "date_refinement",
    sql("releases") + """, pairs AS (SELECT a.id, a.year = b.year AND (a.month IS NULL OR b.month IS NULL OR a.month = b.month) AND (a.day IS NULL OR b.day IS NULL OR a.day = b.day) AS agree,
      (CASE WHEN b.month IS NULL THEN 1 WHEN b.day IS NULL THEN 2 ELSE 3 END) - (CASE WHEN a.month IS NULL THEN 1 WHEN a.day IS NULL THEN 2 ELSE 3 END) AS finer
      FROM releases a JOIN releases b ON b.id = a.id + 1)
    SELECT id, agree, CAST(finer AS INTEGER) AS finer, CASE WHEN NOT agree THEN 'conflict' WHEN finer <= 0 THEN 'keep' ELSE 'refine' END AS action FROM pairs""",
)
def date_refinement(spark, sf_dir):
    from catalogspark.functions import dates

    r = Catalog(spark, sf_dir).releases.select("id", "year", "month", "day")
    o = r.select((F.col("id") - 1).alias("id"), F.col("year").alias("y"), F.col("month").alias("m"), F.col("day").alias("d"))
    rows = r.join(o, "id").select("id", dates.consistent("year", "month", "day", "y", "m", "d").alias("agree"), (dates.precision("m", "d") - dates.precision("month", "day")).alias("finer"))
    return rows.select("id", "agree", "finer", F.when(~F.col("agree"), "conflict").when(F.col("finer") <= 0, "keep").otherwise("refine").alias("action"))


@register(
    "suppressed_conflicts",
    """SELECT event_id, user_id AS record_id, event_type AS source_key FROM events e WHERE NOT EXISTS (
      SELECT 1 FROM events s WHERE s.event_type = 'error' AND s.user_id = e.user_id AND s.props = e.props)""",
)
def suppressed_conflicts(spark, sf_dir):
    e = Catalog(spark, sf_dir).raw("events")
    queue = e.select("event_id", F.col("user_id").alias("record_id"), F.lit("props").alias("field"), F.lit("any").alias("source_key"), F.md5("props").alias("value_hash"), F.col("event_type").alias("offered_by"))
    rejected = e.where("event_type = 'error'").select(F.col("user_id").alias("record_id"), F.lit("props").alias("field"), F.lit("any").alias("source_key"), F.md5("props").alias("value_hash"))
    return reconcile.suppress(queue, rejected).select("event_id", "record_id", F.col("offered_by").alias("source_key"))


@register(
    "latest_field_author",
    """SELECT user_id AS record_id, field, arg_max(event_type, ts_key) AS author, max(ts_key) AS seq FROM (
      SELECT user_id, event_type, event_id AS ts_key, unnest(CASE WHEN event_id % 3 = 0 THEN ['title', 'price'] WHEN event_id % 3 = 1 THEN ['date'] ELSE ['price'] END) AS field FROM events) GROUP BY ALL""",
)
def latest_field_author(spark, sf_dir):
    e = Catalog(spark, sf_dir).raw("events")
    n = F.col("event_id") % 3
    fields = F.when(n == 0, F.array(F.lit("title"), F.lit("price"))).when(n == 1, F.array(F.lit("date"))).otherwise(F.array(F.lit("price")))
    rows = e.select(F.col("user_id").alias("record_id"), F.explode(fields).alias("field"), "event_type", "event_id")
    return rows.groupBy("record_id", "field").agg(F.max_by("event_type", "event_id").alias("author"), F.max("event_id").alias("seq"))


@register(
    "override_fields",
    """SELECT user_id AS record_id, string_agg(field, ',' ORDER BY field) AS overridden FROM (
      SELECT DISTINCT user_id, unnest(CASE WHEN event_id % 3 = 0 THEN ['title', 'price'] WHEN event_id % 3 = 1 THEN ['date'] ELSE ['price'] END) AS field FROM events WHERE event_type = 'click') GROUP BY user_id""",
)
def override_fields(spark, sf_dir):
    """Fields that a person has edited, sorted: they are protected from imports."""
    e = Catalog(spark, sf_dir).raw("events").where("event_type = 'click'")
    n = F.col("event_id") % 3
    fields = F.when(n == 0, F.array(F.lit("title"), F.lit("price"))).when(n == 1, F.array(F.lit("date"))).otherwise(F.array(F.lit("price")))
    rows = e.select(F.col("user_id").alias("record_id"), F.explode(fields).alias("field")).groupBy("record_id").agg(F.sort_array(F.collect_set("field")).alias("f"))
    return rows.select("record_id", F.array_join("f", ",").alias("overridden"))


@register("latest_observation", sql("observations") + "SELECT source_key, record_id, max(id) AS id, arg_max(snapshot, id) AS snapshot FROM observations GROUP BY ALL")
def latest_observation(spark, sf_dir):
    return lookup.first_by(Catalog(spark, sf_dir).observations, ["source_key", "record_id"], F.desc("id")).select("source_key", "record_id", "id", "snapshot")
