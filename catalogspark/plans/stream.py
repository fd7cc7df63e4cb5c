"""Streams over the events table, drained."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalogspark import registry
from catalogspark.operators.tables import shared_folder
from catalogspark.plans import feeds as feed_plans
from catalogspark.registry import register
from catalogspark.sources import wire
from catalogspark.sources.fixture import Catalog, sql
from catalogspark.streaming import feeds, observations


@register("stream_daily_counts", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_daily_counts(spark, sf_dir):
    out = feeds.drain(feeds.counts(feeds.read(spark, f"{sf_dir}/events.parquet")), "counts", "complete", bounded=True)
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@register(
    "stream_sessions",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS begun FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(begun) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def stream_sessions(spark, sf_dir):
    out = feeds.drain(feeds.sessions(feeds.read(spark, f"{sf_dir}/events.parquet")), "sessions", "complete")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@register("stream_dedup", "SELECT DISTINCT event_id FROM events")
def stream_dedup(spark, sf_dir):
    return feeds.drain(feeds.first_seen(feeds.read(spark, f"{sf_dir}/events.parquet"), ["event_id"]).select("event_id"), "dedup")


@register(
    "stream_failure_alerts",
    """WITH e AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events)
    SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS INTEGER) AS streak, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) = 3 AS alert FROM e WHERE event_type = 'error'""",
)
def stream_failure_alerts(spark, sf_dir):
    return feeds.drain(feeds.alerts(feeds.read(spark, f"{sf_dir}/events.parquet")), "alerts")


def _land(rows, folder, k):
    """A landing is a folder of files that is complete before a stream is started."""
    rows.write.parquet(f"{folder}/landed/part={k}")


def _observed(spark, sf_dir):
    """Changes of the events as observations, landed in three parts; each part is a run of its own that goes on from the last one's checkpoint."""
    folder = f"{shared_folder(spark)}/streams/observations-{uuid.uuid4().hex}"
    o = Catalog(spark, sf_dir).observations.withColumn("seen_at", F.col("seen_at").cast("timestamp"))
    top = o.agg(F.max("id")).first()[0] or 0
    for k in range(3):
        _land(o.where((F.col("id") > top * k // 3) & (F.col("id") <= top * (k + 1) // 3) if k else F.col("id") <= top // 3), folder, k)
        feed = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1000).parquet(f"{folder}/landed/part=*")
        observations.run(observations.upserts(feed.select(*o.columns)), folder)
    return observations.written(spark, folder, observations._OUT)


_VERSIONS = """, marked AS (SELECT *, lag(id) OVER w IS NULL OR snapshot IS DISTINCT FROM lag(snapshot) OVER w AS begun FROM observations WINDOW w AS (PARTITION BY source_key, record_id ORDER BY id)),
    numbered AS (SELECT *, sum(CASE WHEN begun THEN 1 ELSE 0 END) OVER (PARTITION BY source_key, record_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS version FROM marked)
"""


@register(
    "stream_observations",
    sql("observations") + _VERSIONS + "SELECT source_key, record_id, arg_max(snapshot, id) AS snapshot, CAST(floor(epoch(arg_max(seen_at, id))) AS BIGINT) AS last_seen, CAST(max(version) AS BIGINT) AS version FROM numbered GROUP BY ALL",
)
def stream_observations(spark, sf_dir):
    return observations.state(_observed(spark, sf_dir)).withColumn("last_seen", F.unix_seconds("last_seen"))


@register(
    "stream_observation_history",
    sql("observations") + _VERSIONS + """SELECT source_key, record_id, CAST(version - 1 AS BIGINT) AS version, old AS snapshot, CAST(floor(epoch(seen_at)) AS BIGINT) AS superseded_at
    FROM (SELECT *, lag(snapshot) OVER (PARTITION BY source_key, record_id ORDER BY id) AS old FROM numbered) WHERE begun AND version > 1""",
)
def stream_observation_history(spark, sf_dir):
    return observations.history(_observed(spark, sf_dir)).withColumn("superseded_at", F.unix_seconds("superseded_at"))


@register("stream_dump_resumed", registry.oracle("feed_dump_editions"))
def stream_dump_resumed(spark, sf_dir):
    """A dump's lines read in bounded triggers by two runs, the second from the first one's offsets."""
    folder = f"{shared_folder(spark)}/streams/dump-{uuid.uuid4().hex}"
    lines = feed_plans._dump(spark, sf_dir)
    half = F.pmod(F.xxhash64("value"), F.lit(2))
    for k in range(2):
        lines.where(half == k).write.text(f"{folder}/landed/part={k}")
        stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 2).text(f"{folder}/landed/part=*").select("value")
        editions = feed_plans.dump_columns(wire.dump_editions(stream))
        observations.run(editions, folder)
    return observations.written(spark, folder, editions.schema).drop("batch")
