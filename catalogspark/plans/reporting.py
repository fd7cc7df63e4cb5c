"""Reports on series and edits of the source registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogspark.operators import registering, reports
from catalogspark.registry import register
from catalogspark.sources.fixture import Catalog, sql

_HOUR = 3_600_000_000
#: Events as reports, a month of them in an hour.
_MICROS = "unix_date(CAST(ts AS DATE)) * 86400000000 + hour(ts) * 3600000000L + minute(ts) * 60000000L + CAST(extract(SECOND FROM ts) * 1000000 AS BIGINT)"


@register(
    "reports_submitted",
    "WITH RECURSIVE " + sql("series", "users").removeprefix("WITH ") + f""",
    e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, id) AS n, message = '' OR length(message) > 2000 OR title IS NULL AS bad FROM (
      SELECT event_id AS id, user_id, epoch_us(ts) // 720 AS t, CASE event_id % 11 WHEN 0 THEN '' WHEN 1 THEN repeat('x', 2001) ELSE event_type || ' ' || event_id END AS message, s.title, s.id AS series_id
      FROM events LEFT JOIN series s ON s.id = event_id % 300 AND s.status = 'active' WHERE user_id IN (SELECT id FROM users WHERE id % 7 <> 3))),
    run(id, user_id, n, t, credit, allowed) AS (
      SELECT id, user_id, n, t, CAST(CASE WHEN bad THEN 3 ELSE 2 END AS BIGINT) * {_HOUR}, true FROM e WHERE n = 1
      UNION ALL SELECT id, user_id, n, t, CASE WHEN c >= {_HOUR} AND NOT bad THEN c - {_HOUR} ELSE c END, c >= {_HOUR}
      FROM (SELECT e.*, least(CAST(3 AS BIGINT) * {_HOUR}, r.credit + (e.t - r.t) * 10) AS c FROM run r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)),
    told AS (SELECT e.*, CASE WHEN NOT allowed THEN 'rateLimited' WHEN message = '' THEN 'emptyReport' WHEN length(message) > 2000 THEN 'reportTooLong' WHEN title IS NULL THEN 'notFound' END AS problem FROM e JOIN run r ON r.id = e.id)
    SELECT id, problem, CASE WHEN problem IS NULL THEN '[Report] ' || title || ': ' || message END AS comment, CASE WHEN problem IS NULL THEN '/series/' || series_id END AS url FROM told
    UNION ALL SELECT event_id, 'unknownUser', NULL, NULL FROM events WHERE user_id NOT IN (SELECT id FROM users WHERE id % 7 <> 3)""",
)
def reports_submitted(spark, sf_dir):
    c, k = Catalog(spark, sf_dir), F.col("event_id")
    message = F.when(k % 11 == 0, " \n ").when(k % 11 == 1, F.repeat(F.lit("x"), F.lit(2001))).otherwise(F.concat(F.lit(" "), "event_type", F.lit(" "), k.cast("string"), F.lit("\t")))
    rows = c.raw("events").select(k.alias("id"), "user_id", (k % 300).alias("series_id"), message.alias("message"), F.expr(f"({_MICROS}) div 720").alias("at"))
    got = reports.submit(rows, c.series, c.users.where("id % 7 <> 3").select("id", F.lit(None).cast("string").alias("role")), _HOUR)
    return got["told"].join(got["versions"].select("id", "comment", "url"), "id", "left")


@register(
    "source_registry",
    """WITH edits AS (SELECT o_orderkey AS seq, 'src-' || CASE WHEN o_orderkey % 31 = 0 THEN '_' ELSE CAST(o_custkey AS VARCHAR) END AS key, o_orderkey % 3 = 0 AS enabled, CASE WHEN o_orderkey % 5 = 0 THEN 'strong' ELSE 'weak' END AS level,
      CASE WHEN o_orderkey % 4 = 0 THEN 'moderator' ELSE 'administrator' END AS role, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS attribution FROM orders),
    good AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM edits WHERE level = 'weak' AND role = 'administrator' AND key <> 'src-_'),
    old AS (SELECT 'src-' || c_custkey AS key, c_name AS name, CASE WHEN c_custkey % 6 = 0 THEN 'unhealthy' ELSE 'healthy' END AS health, CASE WHEN c_custkey % 6 = 0 THEN 4 ELSE 0 END AS failures FROM customer WHERE c_custkey % 2 = 0)
    SELECT coalesce(o.key, g.key) AS key, CASE WHEN g.key IS NULL THEN o.name ELSE 'n' || g.seq END AS name, coalesce(g.enabled, true) AS enabled, CASE WHEN g.key IS NULL THEN 'standard' ELSE 'weak' END AS date_level, g.attribution,
      coalesce(o.health, 'healthy') AS health, CAST(coalesce(o.failures, 0) AS INTEGER) AS failures FROM old o FULL JOIN (SELECT * FROM good WHERE r = 1) g ON g.key = o.key""",
)
def source_registry(spark, sf_dir):
    c, k = Catalog(spark, sf_dir), F.col("o_orderkey")
    who = F.col("c_custkey")
    ill, none = who % 6 == 0, F.lit(None).cast("string")
    level = lambda x: F.create_map(F.lit("date"), x).alias("authority")
    old = c.raw("customer").where("c_custkey % 2 = 0").select(
        F.concat(F.lit("src-"), who.cast("string")).alias("key"), F.col("c_name").alias("name"), F.lit(True).alias("enabled"), F.lit("all").alias("scope"), level(F.lit("standard")), F.lit("daily").alias("cadence"),
        none.alias("attribution"), F.when(ill, "unhealthy").otherwise("healthy").alias("health"), F.when(ill, 4).otherwise(0).alias("failures"),
    )
    edits = c.raw("orders").select(
        k.alias("seq"), F.when(k % 4 == 0, "moderator").otherwise("administrator").alias("role"), F.concat(F.lit(" SRC-"), F.when(k % 31 == 0, "_").otherwise(F.col("o_custkey").cast("string"))).alias("key"),
        F.concat(F.lit("n"), k.cast("string"), F.lit(" ")).alias("name"), (k % 3 == 0).alias("enabled"), F.lit("all").alias("scope"), level(F.when(k % 5 == 0, "strong").otherwise("weak")), F.lit("Daily").alias("cadence"),
        F.when(k % 2 == 0, F.col("o_orderstatus")).otherwise(" ").alias("attribution"),
    )
    out = registering.upsert(old, edits)["registry"]
    return out.select("key", "name", "enabled", F.col("authority")["date"].alias("date_level"), "attribution", "health", "failures")
