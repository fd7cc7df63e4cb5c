"""Users' rows over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogspark.operators import people, roles
from catalogspark.registry import register
from catalogspark.sources.fixture import Catalog, sql

_ROLES = ["administrator", "moderator", "editor", None]


def _pick(values, n):
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


_GOVERNED = """WITH RECURSIVE u AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey <= 5 OR c_custkey % 101 = 0 THEN 'administrator' WHEN c_custkey % 4 = 0 THEN 'moderator' WHEN c_custkey % 4 = 1 THEN 'editor' END AS role, c_custkey % 7 = 0 AS suspended FROM customer),
    c AS (SELECT (c_custkey * 7919) % 1000003 AS seq, CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE c_custkey % 9 + 1 END AS actor_id, ['appoint', 'revoke', 'suspend', 'reinstate'][CAST(c_custkey % 4 AS INTEGER) + 1] AS action, c_custkey AS user_id,
      ['administrator', 'editor', 'moderator'][CAST(c_nationkey % 3 AS INTEGER) + 1] AS role, CASE WHEN c_custkey % 2 = 0 THEN 'r' || c_custkey END AS reason FROM customer WHERE c_custkey % 5 <> 0),
    j AS (SELECT c.*, t.role AS now, t.suspended AS was, a.role AS actor_role, CASE c.action WHEN 'appoint' THEN c.role WHEN 'revoke' THEN t.role ELSE coalesce(t.role, 'editor') END AS governed
      FROM c JOIN u t USING (user_id) LEFT JOIN u a ON a.user_id = c.actor_id AND NOT a.suspended),
    p AS (SELECT *, CASE WHEN action = 'revoke' AND now IS NULL THEN 'noChange' WHEN NOT (coalesce(actor_role, '') = 'administrator' OR coalesce(actor_role, '') = 'moderator' AND governed = 'editor') THEN 'forbidden'
        WHEN action = 'appoint' AND now = role THEN 'noChange' WHEN action = 'appoint' AND now IS NOT NULL AND actor_role = 'moderator' AND now <> 'editor' THEN 'forbidden'
        WHEN action = 'suspend' AND user_id = actor_id THEN 'forbidden' WHEN action = 'suspend' AND was OR action = 'reinstate' AND NOT was THEN 'noChange' END AS refused FROM j),
    acts AS (SELECT row_number() OVER (ORDER BY seq) AS k, seq, change FROM (SELECT seq, CASE WHEN refused IS NOT NULL THEN 0 WHEN now = 'administrator' AND NOT was AND action <> 'reinstate' THEN -1
        WHEN action = 'appoint' AND role = 'administrator' AND NOT was OR action = 'reinstate' AND now = 'administrator' THEN 1 ELSE 0 END AS change FROM p) WHERE change <> 0),
    walk(k, n, held) AS (SELECT CAST(0 AS BIGINT), (SELECT count(*) FROM u WHERE role = 'administrator' AND NOT suspended), false
      UNION ALL SELECT a.k, CASE WHEN change < 0 AND n <= 1 THEN n ELSE n + change END, change < 0 AND n <= 1 FROM walk w JOIN acts a ON a.k = w.k + 1),
    g AS (SELECT p.*, coalesce(refused, CASE WHEN w.held THEN 'lastAdministrator' END) AS problem FROM p LEFT JOIN acts USING (seq) LEFT JOIN walk w ON w.k = acts.k)
"""


def _governed(spark, sf_dir):
    """Some dozen administrators by id, whom commands of each other remove; every fifth user gets no command."""
    c, k = Catalog(spark, sf_dir).raw("customer"), F.col("c_custkey")
    role = F.when((k <= 5) | (k % 101 == 0), "administrator").when(k % 4 == 0, "moderator").when(k % 4 == 1, "editor")
    users = c.select(k.alias("user_id"), role.alias("role"), (k % 7 == 0).alias("suspended"))
    commands = c.where(k % 5 != 0).select(
        (k * 7919 % 1000003).alias("seq"), F.when(k % 3 == 0, k).otherwise(k % 9 + 1).alias("actor_id"), _pick(["appoint", "revoke", "suspend", "reinstate"], k).alias("action"), k.alias("user_id"),
        _pick(["administrator", "editor", "moderator"], F.col("c_nationkey")).alias("role"), F.when(k % 2 == 0, F.concat(F.lit("r"), k)).alias("reason"),
    )
    return users, roles.govern(commands, users)


@register(
    "roles_governed",
    _GOVERNED + """SELECT u.user_id, CASE WHEN g.seq IS NULL OR problem IS NOT NULL THEN u.role WHEN action = 'appoint' THEN g.role WHEN action = 'revoke' THEN NULL ELSE u.role END AS role,
      CASE WHEN g.seq IS NULL OR problem IS NOT NULL THEN suspended WHEN action = 'suspend' THEN true WHEN action = 'reinstate' THEN false ELSE suspended END AS suspended, problem FROM u LEFT JOIN g USING (user_id)""",
)
def roles_governed(spark, sf_dir):
    users, governed = _governed(spark, sf_dir)
    return roles.users_after(users, governed).join(governed.select("user_id", "problem"), "user_id", "left")


@register(
    "role_audit",
    _GOVERNED + """SELECT seq, CASE WHEN action = 'appoint' AND now IS NOT NULL THEN 1 ELSE 0 END AS place, user_id, actor_id, CASE action WHEN 'appoint' THEN 'appointed' WHEN 'revoke' THEN 'revoked' WHEN 'suspend' THEN 'suspended' ELSE 'reinstated' END AS action,
      governed AS role, reason FROM g WHERE problem IS NULL
    UNION ALL SELECT seq, 0, user_id, actor_id, 'revoked', now, coalesce(reason, 'Role changed to ' || role || '.') FROM g WHERE problem IS NULL AND action = 'appoint' AND now IS NOT NULL""",
)
def role_audit(spark, sf_dir):
    return roles.audit_rows(_governed(spark, sf_dir)[1])


@register(
    "read_counts_set",
    """WITH p AS (SELECT DISTINCT l_suppkey AS user_id, l_partkey AS volume_id, l_partkey % 4 + 1 AS reads FROM lineitem WHERE l_returnflag <> 'N'),
    c AS (SELECT DISTINCT l_suppkey AS user_id, l_partkey AS volume_id, (l_partkey + l_suppkey) % 7 - 1 AS reads FROM lineitem WHERE l_returnflag <> 'R')
    SELECT user_id, volume_id, CASE WHEN c.reads >= 0 THEN c.reads ELSE p.reads END AS reads, CAST(CASE WHEN c.reads > coalesce(p.reads, 0) THEN 99 WHEN p.reads IS NOT NULL THEN 7 END AS INTEGER) AS stamp
    FROM p FULL JOIN c USING (user_id, volume_id) WHERE CASE WHEN c.reads >= 0 THEN c.reads ELSE p.reads END > 0""",
)
def read_counts_set(spark, sf_dir):
    lines = Catalog(spark, sf_dir).raw("lineitem")
    row = lambda df, reads, *more: df.select(F.col("l_suppkey").alias("user_id"), F.col("l_partkey").alias("volume_id"), reads.alias("reads"), *more).distinct()
    progress = row(lines.where("l_returnflag <> 'N'"), F.col("l_partkey") % 4 + 1, F.lit(7).alias("stamp"))
    return people.set_read_counts(progress, row(lines.where("l_returnflag <> 'R'"), (F.col("l_partkey") + F.col("l_suppkey")) % 7 - 1), 99)


_BUNDLE_ENTRIES = "bundle_entries AS (SELECT c_custkey AS user_id, c_nationkey AS bundle_id, CASE WHEN c_custkey % 3 = 0 THEN 'wanted' ELSE 'owned' END AS state FROM customer)"


def _bundle_entries(c):
    return c.raw("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("bundle_id"), F.when(F.col("c_custkey") % 3 == 0, "wanted").otherwise("owned").alias("state"))


@register(
    "volumes_owned",
    sql("entries", "bundle_members", "coverage") + f""", {_BUNDLE_ENTRIES},
    routes AS (SELECT user_id, release_id, CAST(NULL AS BIGINT) AS bundle_id FROM entries WHERE state = 'owned' UNION ALL SELECT DISTINCT user_id, release_id, CAST(bundle_id AS BIGINT) FROM bundle_entries JOIN bundle_members USING (bundle_id) WHERE state = 'owned')
    SELECT user_id, volume_id, release_id, extent, bundle_id FROM routes JOIN coverage USING (release_id)""",
)
def volumes_owned(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    return people.volume_ownership(c.entries, _bundle_entries(c), c.bundle_members, c.coverage)


@register(
    "collections",
    sql("entries", "releases", "bundles", "bundle_members") + f""", {_BUNDLE_ENTRIES}
    SELECT user_id, 'release' AS kind, release_id AS id, e.state, 'release ' || r.id AS title, CAST(NULL AS BIGINT) AS members FROM entries e JOIN releases r ON r.id = release_id AND r.status = 'active'
    UNION ALL SELECT user_id, 'bundle', CAST(b.id AS BIGINT), e.state, b.name, CASE WHEN e.state = 'owned' THEN n END FROM bundle_entries e JOIN bundles b ON b.id = e.bundle_id AND b.status = 'active'
      LEFT JOIN (SELECT bundle_id, count(*) AS n FROM bundle_members GROUP BY 1) m ON m.bundle_id = b.id""",
)
def collections(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    return people.collection(c.entries, _bundle_entries(c), c.releases.withColumn("title", F.concat(F.lit("release "), "id")), c.bundles, c.bundle_members)


@register("entries_without_removed_users", sql("entries") + "SELECT user_id, release_id, state FROM entries WHERE user_id % 10 <> 3")
def entries_without_removed_users(spark, sf_dir):
    e = Catalog(spark, sf_dir).entries
    return people.without_users(e, e.where("user_id % 10 = 3")).select("user_id", "release_id", "state")


@register(
    "runs_closed",
    """SELECT event_id AS id, CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 'failed' WHEN event_id % 2 = 0 THEN 'running' ELSE 'succeeded' END AS status,
      CASE WHEN event_id % 6 = 0 THEN array_to_string(range(1, least(event_id % 90, 50) + 1), ',') END AS errors FROM events""",
)
def runs_closed(spark, sf_dir):
    k = F.col("event_id")
    e = Catalog(spark, sf_dir).raw("events")
    errors = F.slice(F.transform(F.sequence(F.lit(1), F.lit(90)), lambda x: x.cast("string")), 1, (k % 90).cast("int"))
    out = people.close_runs(e.select(k.alias("id"), F.when(k % 2 == 0, "running").otherwise("succeeded").alias("status")), e.where(k % 3 == 0).select(k.alias("id"), F.lit("failed").alias("status"), errors.alias("errors")))
    return out.select("id", "status", F.array_join("errors", ",").alias("errors"))


@register(
    "covers_attached",
    """WITH r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 <> 0 THEN 'a' || p_partkey END AS cover, CASE WHEN p_partkey % 4 <> 0 THEN CASE WHEN p_partkey % 5 = 0 THEN 'a' ELSE 'b' END || p_partkey END AS url FROM part)
    SELECT id, coalesce(cover, url) AS once, coalesce(url, cover) AS latest, coalesce(url, cover) IS DISTINCT FROM cover AS changed FROM r""",
)
def covers_attached(spark, sf_dir):
    k = F.col("p_partkey")
    p = Catalog(spark, sf_dir).raw("part")
    have = p.select(k.alias("id"), F.when(k % 3 != 0, F.concat(F.lit("a"), k)).alias("cover_url"))
    new = p.where(k % 4 != 0).select(k.alias("id"), F.concat(F.when(k % 5 == 0, "a").otherwise("b"), k).alias("url"))
    once = people.covers(have, new, False).select("id", F.col("cover_url").alias("once"))
    return once.join(people.covers(have, new, True).withColumnRenamed("cover_url", "latest"), "id")


@register("suppliers_unique", "SELECT s_suppkey, s_name FROM supplier")
def suppliers_unique(spark, sf_dir):
    return people.unique(Catalog(spark, sf_dir).raw("supplier").select("s_suppkey", "s_name"), ["s_suppkey"])


@register("manifests_open", "SELECT user_id AS record_id, max(event_id) AS id FROM events WHERE event_id % 3 <> 0 GROUP BY 1")
def manifests_open(spark, sf_dir):
    k = F.col("event_id")
    return people.latest_open_manifest(Catalog(spark, sf_dir).raw("events").select(k.alias("id"), F.col("user_id").alias("record_id"), F.when(k % 3 == 0, k + 1).alias("reversed_by")))


@register(
    "roster",
    """SELECT c_custkey AS user_id, c_name AS username, ['administrator', 'moderator', 'editor'][CAST(c_custkey % 4 AS INTEGER) + 1] AS role, CAST(row_number() OVER (ORDER BY c_name, c_custkey) AS BIGINT) AS place FROM customer WHERE c_custkey % 4 < 3 AND c_custkey % 20 < 3""",
)
def roster(spark, sf_dir):
    """Holders of a role, by name; there are few, and the list is what is shown."""
    from pyspark.sql import Window

    k = F.col("c_custkey")
    rows = Catalog(spark, sf_dir).raw("customer").where((k % 4 < 3) & (k % 20 < 3)).select(k.alias("user_id"), F.col("c_name").alias("username"), _pick(_ROLES, k).alias("role"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy("username", "user_id")).cast("bigint"))
