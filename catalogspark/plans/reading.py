"""Reading passes, what users read, and limits of submissions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogspark.operators import lookup, quota, reading
from catalogspark.registry import register
from catalogspark.sources.fixture import Catalog, sql

_SQL = """, passes AS (SELECT user_id, release_id, CASE WHEN release_id % 3 <> 0 THEN CAST(release_id % 101 AS DOUBLE) END AS percent FROM entries WHERE state = 'ordered' AND release_id % 2 = 0),
actions AS (SELECT user_id, release_id, CASE release_id % 5 WHEN 0 THEN 'start' WHEN 1 THEN 'percent' WHEN 2 THEN 'complete' ELSE 'cancel' END AS action, CAST(release_id % 130 AS DOUBLE) AS value FROM entries WHERE release_id % 5 <> 4),
judged AS (SELECT a.*, p.release_id IS NOT NULL AS had, p.percent,
    CASE WHEN r.id IS NULL THEN 'notActive' WHEN action = 'percent' AND value NOT BETWEEN 0 AND 100 THEN 'badPercent' WHEN action IN ('percent', 'complete') AND p.release_id IS NULL THEN 'noPass' ELSE 'ok' END AS outcome
  FROM actions a LEFT JOIN passes p ON p.user_id = a.user_id AND p.release_id = a.release_id LEFT JOIN (SELECT id FROM releases WHERE status = 'active') r ON r.id = a.release_id),
outcomes AS (SELECT user_id, release_id, action, outcome, CASE WHEN outcome = 'ok' THEN action IN ('start', 'percent') ELSE had END AS has_pass,
    CASE WHEN outcome = 'ok' AND action = 'percent' THEN value WHEN outcome <> 'ok' OR action = 'start' THEN percent END AS percent FROM judged)
"""
_DONE = """, done AS (SELECT DISTINCT o.user_id, o.release_id, c.series_id, c.volume_id FROM outcomes o JOIN coverage c USING (release_id) WHERE action = 'complete' AND outcome = 'ok' AND extent = 'complete'),
progress AS (SELECT DISTINCT user_id, series_id, volume_id, CAST(1 AS BIGINT) AS reads, CAST(1 AS BIGINT) AS stamp FROM entries JOIN coverage USING (release_id) WHERE state = 'owned' AND extent = 'complete' AND volume_id % 3 = 0),
counted AS (SELECT user_id, series_id, volume_id, CAST(sum(reads) AS BIGINT) AS reads, max(stamp) AS stamp FROM (SELECT * FROM progress UNION ALL SELECT user_id, series_id, volume_id, 1, 2 FROM done) GROUP BY ALL)
"""
_STATES = "states AS (SELECT user_id, series_id, CASE (user_id + series_id) % 4 WHEN 0 THEN 'reading' WHEN 1 THEN 'completed' WHEN 2 THEN 'paused' END AS reading_status FROM follows)"
STAMP = 2


def _passes(c):
    percent = F.when(F.col("release_id") % 3 != 0, (F.col("release_id") % 101).cast("double"))
    return c.entries.where("state = 'ordered' AND release_id % 2 = 0").select("user_id", "release_id", percent.alias("percent"))


def _outcomes(c):
    kind = F.col("release_id") % 5
    action = F.when(kind == 0, "start").when(kind == 1, "percent").when(kind == 2, "complete").otherwise("cancel")
    actions = c.entries.where("release_id % 5 <> 4").select("user_id", "release_id", action.alias("action"), (F.col("release_id") % 130).cast("double").alias("value"))
    return reading.pass_actions(_passes(c), actions, c.releases)


def _progress(c):
    owned = c.entries.where("state = 'owned'").select("user_id", "release_id")
    rows = owned.join(c.coverage.where("extent = 'complete' AND volume_id % 3 = 0"), "release_id").select("user_id", "series_id", "volume_id").distinct()
    return rows.select("*", F.lit(1).cast("bigint").alias("reads"), F.lit(1).cast("bigint").alias("stamp"))


def _states(c):
    kind = (F.col("user_id") + F.col("series_id")) % 4
    return c.follows.select("user_id", "series_id", F.when(kind == 0, "reading").when(kind == 1, "completed").when(kind == 2, "paused").alias("reading_status"))


def _counted(c):
    done = reading.completed(_outcomes(c), c.coverage)
    return done, reading.count_reads(_progress(c), done, STAMP)


@register("pass_actions", sql("entries", "releases") + _SQL + "SELECT * FROM outcomes")
def pass_actions(spark, sf_dir):
    return _outcomes(Catalog(spark, sf_dir))


@register(
    "passes_after_actions",
    sql("entries", "releases") + _SQL + """SELECT user_id, release_id, percent FROM outcomes WHERE has_pass
    UNION ALL SELECT * FROM passes p WHERE NOT EXISTS (SELECT 1 FROM actions a WHERE a.user_id = p.user_id AND a.release_id = p.release_id)""",
)
def passes_after_actions(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    return reading.passes_after(_passes(c), _outcomes(c))


@register("passes_counted", sql("entries", "releases", "coverage") + _SQL + _DONE + "SELECT * FROM counted")
def passes_counted(spark, sf_dir):
    return _counted(Catalog(spark, sf_dir))[1]


@register(
    "completion_suggestions",
    sql("entries", "releases", "coverage", "volumes", "follows") + _SQL + _DONE + f""", {_STATES}
    SELECT user_id, series_id FROM counted JOIN (SELECT series_id, count(*) AS n FROM volumes WHERE position = 1 GROUP BY series_id) USING (series_id)
    WHERE volume_id IN (SELECT id FROM volumes WHERE position = 1) AND (user_id, series_id) IN (SELECT (user_id, series_id) FROM done) AND NOT EXISTS (SELECT 1 FROM states s WHERE s.user_id = counted.user_id AND s.series_id = counted.series_id AND reading_status = 'completed')
    GROUP BY user_id, series_id HAVING count(*) >= any_value(n)""",
)
def completion_suggestions(spark, sf_dir):
    """With the first volume of each series as its only active one, so that some are read."""
    c = Catalog(spark, sf_dir)
    done, counted = _counted(c)
    return reading.suggest_completed(done, counted, c.volumes.where("position = 1"), _states(c))


@register(
    "completions_undone",
    sql("entries", "releases", "coverage") + _SQL + _DONE + """SELECT DISTINCT d.user_id, d.release_id, CAST(100 AS DOUBLE) AS percent FROM done d JOIN counted c ON c.user_id = d.user_id AND c.volume_id = d.volume_id AND c.stamp = 2
    WHERE NOT EXISTS (SELECT 1 FROM outcomes o WHERE has_pass AND o.user_id = d.user_id AND o.release_id = d.release_id)""",
)
def completions_undone(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    outcomes = _outcomes(c)
    done, counted = _counted(c)
    return reading.restored_passes(done, counted, reading.passes_after(_passes(c), outcomes), STAMP)


@register(
    "my_reading",
    sql("series", "survivors", "entries", "coverage", "volumes", "follows", "releases") + _SQL + _DONE + f""", {_STATES}, mine AS (SELECT s.user_id, v.survivor_id AS series_id, reading_status FROM states s JOIN survivors v ON v.id = s.series_id WHERE reading_status IS NOT NULL)
    SELECT m.user_id, m.series_id, title, reading_status, coalesce(volumes_read, 0) AS volumes_read, coalesce(total_volumes, 0) AS total_volumes FROM mine m JOIN series s ON s.id = m.series_id
    LEFT JOIN (SELECT series_id, count(*) AS total_volumes FROM volumes GROUP BY series_id) t ON t.series_id = m.series_id
    LEFT JOIN (SELECT user_id, v.series_id, count(*) AS volumes_read FROM counted c JOIN volumes v ON v.id = c.volume_id GROUP BY ALL) r ON r.user_id = m.user_id AND r.series_id = m.series_id""",
)
def my_reading(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    return reading.my_reading(_states(c), lookup.survivors(c.series), c.series, c.volumes, _counted(c)[1])


@register(
    "submission_quota",
    """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, id) AS n FROM (SELECT event_id AS id, user_id, epoch_us(ts) // 720 AS t FROM events)),
    run(id, user_id, n, t, credit, allowed) AS (
      SELECT id, user_id, n, t, CAST(5 - 1 AS BIGINT) * 3600000000, true FROM e WHERE n = 1
      UNION ALL SELECT id, user_id, n, t, CASE WHEN c >= 3600000000 THEN c - 3600000000 ELSE c END, c >= 3600000000
      FROM (SELECT e.*, least(CAST(5 AS BIGINT) * 3600000000, r.credit + (e.t - r.t) * 30) AS c FROM run r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
    SELECT id, user_id, allowed, credit // 3600000000 AS "left" FROM run""",
)
def submission_quota(spark, sf_dir):
    """The events as submissions, a month of them in an hour: 30 an hour, 5 at once."""
    # the clock's reading, whatever the session's time zone
    micros = "unix_date(CAST(ts AS DATE)) * 86400000000 + hour(ts) * 3600000000L + minute(ts) * 60000000L + CAST(extract(SECOND FROM ts) * 1000000 AS BIGINT)"
    events = Catalog(spark, sf_dir).raw("events").select(F.col("event_id").alias("id"), "user_id", F.expr(f"({micros}) div 720").alias("at"))
    return quota.token_bucket(events, rate=30, period=3_600_000_000, capacity=5)
