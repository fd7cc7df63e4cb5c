"""Drafts, evidence, the review queue and creation over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogspark.operators import creation, moderation, settling
from catalogspark.registry import register
from catalogspark.sources.fixture import Catalog, sql

#: (type, field, value, before) by case, and what becomes of it: (after, problem). Case 11 comes twice.
_CASES = [
    ("publisher", "name", " New ", "Old", "New", None), ("publisher", "name", "  ", "Old", None, "invalidField"), ("publisher", "color", "red", None, None, "unknownField"),
    ("series", "sourceStatus", "hiatus", None, "hiatus", None), ("series", "sourceStatus", "paused", None, None, "invalidField"), ("series", "altTitles", '[" a ", "", "b"]', None, "a|b", None),
    ("release", "isbn13", "978-0 00000-001", None, None, "invalidField"), ("release", "isbn10", "0-306-40615-x", None, "030640615X", None), ("release", "pubDate", '{"year": 2031, "month": 5}', "20310500", "20310500", "unchanged"),
    ("release", "pubDate", '{"year": 2031, "day": 5}', None, None, "invalidField"), ("release", "price", '{"amountCents": 1399, "currency": "usd"}', None, "1399 USD", None), ("volume", "label", "7", None, "7", "twice"),
    ("volume", "synopsis", None, "text", None, None), ("release", "price", '{"amountCents": 13.5, "currency": "usd"}', None, None, "invalidField"), ("release", "isbn13", "9780000000002", None, "9780000000002", None),
]
_q = lambda v: "NULL" if v is None else "'" + v + "'"


@register(
    "changes_validated",
    "WITH cases(n, field, after, problem, times) AS (VALUES " + ", ".join(f"({i}, {_q(c[1])}, {_q(c[4])}, {_q(c[5])}, {1 + (c[5] == 'twice')})" for i, c in enumerate(_CASES))
    + f") SELECT o_orderkey AS op_id, field, after, problem FROM orders JOIN cases ON n = o_orderkey % {len(_CASES)}, range(times)",
)
def changes_validated(spark, sf_dir):
    cases = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(_CASES) for _ in range(1 + (c[5] == "twice"))], "n long, type string, field string, value string, before string")
    ops = Catalog(spark, sf_dir).raw("orders").select(F.col("o_orderkey").alias("op_id"), (F.col("o_orderkey") % len(_CASES)).alias("n"))
    return moderation.validate(ops.join(F.broadcast(cases), "n"))


@register(
    "evidence_checked",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 AND event_id % 8 <> 0 OR event_id % 4 = 1 AND event_id % 3 = 0 OR event_id % 4 >= 2 AND c_custkey IS NULL THEN 'invalidEvidence' END AS problem
    FROM events LEFT JOIN (SELECT DISTINCT c_custkey FROM customer WHERE c_custkey % 2 = 0) ON c_custkey = user_id""",
)
def evidence_checked(spark, sf_dir):
    c, k = Catalog(spark, sf_dir), F.col("event_id")
    known = c.raw("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), F.lit(True).alias("known")).distinct()
    rows = c.raw("events").select(
        "event_id", "user_id", F.when(k % 4 == 0, "url").when(k % 4 == 1, "note").otherwise("observation").alias("kind"),
        F.when(k % 8 == 0, "https://x.example/a").otherwise("ftp://x").alias("url"), F.when(k % 3 == 0, "  ").otherwise("seen").alias("note"),
    )
    return rows.join(known, "user_id", "left").select("event_id", moderation.evidence_problem("kind", "url", "note", "known").alias("problem"))


_OPS = "ops AS (SELECT l_suppkey * 40 + l_orderkey % 40 AS draft_id, CASE WHEN l_linenumber % 3 = 0 THEN 'create' ELSE 'update' END AS kind, CASE WHEN l_partkey % 2 = 0 THEN 'series' ELSE 'releases' END AS tab, l_partkey AS ref_id, l_returnflag = 'R' AS part, l_linenumber % 3 = 1 AND l_suppkey % 5 = 0 AS editorial FROM lineitem)"


@register(
    "drafts_checked",
    f"""WITH {_OPS}, again AS (SELECT DISTINCT draft_id FROM (SELECT draft_id FROM ops WHERE kind = 'update' GROUP BY draft_id, ref_id HAVING count(*) > 1))
    SELECT o.draft_id, count(*) AS n_ops, CASE WHEN count(*) > 25 THEN 'tooManyOps' WHEN any_value(a.draft_id) IS NOT NULL THEN 'sameRecord' END AS problem,
      array_to_string(list_filter([CASE WHEN bool_or(kind = 'create' AND tab = 'series') THEN 'newSeries' END, CASE WHEN count(*) > 10 THEN 'bulk' END, CASE WHEN bool_or(kind = 'create' AND part) THEN 'partialCoverage' END], lambda x: x IS NOT NULL), ',') AS warnings,
      bool_or(kind = 'create' OR NOT editorial) AS needs_evidence FROM ops o LEFT JOIN again a ON a.draft_id = o.draft_id GROUP BY o.draft_id""",
)
def drafts_checked(spark, sf_dir):
    c = F.col
    ops = Catalog(spark, sf_dir).raw("lineitem").select(
        (c("l_suppkey") * 40 + c("l_orderkey") % 40).alias("draft_id"), F.when(c("l_linenumber") % 3 == 0, "create").otherwise("update").alias("kind"), F.when(c("l_partkey") % 2 == 0, "series").otherwise("releases").alias("table"),
        c("l_partkey").alias("ref_id"), (c("l_returnflag") == "R").alias("partial"), ((c("l_linenumber") % 3 == 1) & (c("l_suppkey") % 5 == 0)).alias("editorial"),
    )
    return moderation.draft_checks(ops)


@register(
    "review_queue_open",
    """WITH proposals AS (SELECT o_orderkey AS id, CAST(o_orderkey % 3 + 1 AS INTEGER) AS cur, ['inReview', 'inReview', 'approved', 'rejected'][CAST(o_custkey % 4 AS INTEGER) + 1] AS state FROM orders),
    ops AS (SELECT l_orderkey AS id, CAST(l_linenumber % 3 + 1 AS INTEGER) AS version_no, ['series', 'volume', 'release'][CAST(l_partkey % 3 AS INTEGER) + 1] AS type, CASE WHEN l_suppkey % 2 = 0 THEN 'create' ELSE 'update' END AS kind FROM lineitem)
    SELECT p.id AS proposal_id, p.state, p.cur AS current_no, string_agg(DISTINCT o.type, ',' ORDER BY o.type) AS types, string_agg(DISTINCT o.kind, ',' ORDER BY o.kind) AS kinds
    FROM proposals p JOIN ops o ON o.id = p.id AND o.version_no = p.cur WHERE p.state = 'inReview' GROUP BY ALL HAVING bool_or(o.type = 'series')""",
)
def review_queue_open(spark, sf_dir):
    c, k = Catalog(spark, sf_dir), F.col("o_orderkey")
    state = F.element_at(F.array(*map(F.lit, ["inReview", "inReview", "approved", "rejected"])), (F.col("o_custkey") % 4 + 1).cast("int"))
    proposals = c.raw("orders").select(k.alias("proposal_id"), (k % 3 + 1).cast("int").alias("current_no"), state.alias("state"))
    lines = c.raw("lineitem").select(
        F.col("l_orderkey").alias("proposal_id"), (F.col("l_linenumber") % 3 + 1).cast("int").alias("version_no"),
        F.element_at(F.array(*map(F.lit, ["series", "volume", "release"])), (F.col("l_partkey") % 3 + 1).cast("int")).alias("type"), F.when(F.col("l_suppkey") % 2 == 0, "create").otherwise("update").alias("kind"),
    )
    out = moderation.review_queue(proposals, lines.select("proposal_id", "version_no").distinct(), lines, record_type="series")
    return out.select("proposal_id", "state", "current_no", F.array_join("types", ",").alias("types"), F.array_join("kinds", ",").alias("kinds"))


@register(
    "suppressions_added",
    """SELECT DISTINCT user_id AS record_id, event_type AS field, 's' || event_id % 2 AS source_key, md5(props) AS value_hash FROM events e WHERE event_id % 5 = 0 AND event_id % 3 <> 0
    EXCEPT SELECT user_id, event_type, 's' || event_id % 2, md5(props) FROM events WHERE event_id % 7 = 0""",
)
def suppressions_added(spark, sf_dir):
    k = F.col("event_id")
    row = lambda df, source: df.select(F.col("user_id").alias("record_id"), F.col("event_type").alias("field"), source.alias("source_key"), F.md5("props").alias("value_hash"))
    e, source = Catalog(spark, sf_dir).raw("events"), F.concat(F.lit("s"), k % 2)
    return moderation.new_suppressions(row(e.where(k % 5 == 0), F.when(k % 3 != 0, source)), row(e.where(k % 7 == 0), source))


@register(
    "volumes_ensured",
    """WITH RECURSIVE held AS (SELECT l_partkey AS series_id, l_linenumber AS position, min(l_linenumber % 2) AS half FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1, 2),
    taken AS (SELECT series_id, list(CAST(position AS BIGINT)) AS taken FROM held GROUP BY 1),
    wanted AS (SELECT p_partkey AS series_id, [CAST(p_size % 9 + 1 AS VARCHAR), 'side', CAST(p_size % 4 + 1 AS VARCHAR) || '.0', '7.5', '0', NULL, '12'] AS labels FROM part),
    each AS (SELECT series_id, unnest(labels) AS label, CAST(unnest(range(len(labels))) AS INTEGER) AS index FROM wanted),
    told AS (SELECT e.*, h.position AS known FROM each e LEFT JOIN held h ON h.series_id = e.series_id AND h.half = 1 AND TRY_CAST(e.label AS DOUBLE) = h.position),
    new AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY index) AS n FROM told WHERE known IS NULL),
    fold(series_id, n, taken, nxt, put) AS (
      SELECT p_partkey, CAST(0 AS BIGINT), coalesce(taken, []), coalesce(list_max(taken), 0) + 1, CAST(NULL AS BIGINT) FROM part LEFT JOIN taken ON series_id = p_partkey
      UNION ALL
      SELECT series_id, n, list_append(taken, put), CASE WHEN own IS NULL THEN put + 1 ELSE nxt END, put FROM (
        SELECT f.series_id, x.n, f.taken, f.nxt, v.own, coalesce(v.own, list_filter(range(f.nxt, f.nxt + len(f.taken) + 2), lambda p: NOT list_contains(f.taken, p))[1]) AS put
        FROM fold f JOIN new x ON x.series_id = f.series_id AND x.n = f.n + 1,
        LATERAL (SELECT CASE WHEN TRY_CAST(x.label AS DOUBLE) >= 1 AND TRY_CAST(x.label AS DOUBLE) = floor(TRY_CAST(x.label AS DOUBLE)) AND NOT list_contains(f.taken, CAST(TRY_CAST(x.label AS DOUBLE) AS BIGINT)) THEN CAST(TRY_CAST(x.label AS DOUBLE) AS BIGINT) END AS own) v))
    SELECT t.series_id, t.index, t.label, t.series_id * 100 + t.known AS volume_id, CAST(coalesce(t.known, f.put) AS INTEGER) AS position
    FROM told t LEFT JOIN new x ON x.series_id = t.series_id AND x.index = t.index LEFT JOIN fold f ON f.series_id = x.series_id AND f.n = x.n""",
)
def volumes_ensured(spark, sf_dir):
    """Volumes of even position are no longer active: they hold their position and lend no label."""
    c, size = Catalog(spark, sf_dir), F.col("p_size")
    held = c.raw("lineitem").where("l_orderkey % 3 = 0").select(F.col("l_partkey").alias("series_id"), F.col("l_linenumber").alias("position")).distinct()
    volumes = held.select("series_id", (F.col("series_id") * 100 + F.col("position")).alias("id"), "position", F.col("position").cast("string").alias("label"), F.when(F.col("position") % 2 == 1, "active").otherwise("merged").alias("status"))
    text = lambda x: x.cast("string")
    labels = F.array(text(size % 9 + 1), F.lit("side"), F.concat(text(size % 4 + 1), F.lit(".0")), F.lit("7.5"), F.lit("0"), F.lit(None).cast("string"), F.lit("12"))
    return creation.ensure_volumes(c.raw("part").select(F.col("p_partkey").alias("series_id"), labels.alias("labels")), volumes)


@register("publishers_missing", "SELECT DISTINCT 'supplier-' || l_suppkey AS slug FROM lineitem WHERE l_suppkey % 4 = 0 UNION SELECT DISTINCT 'brand-' || replace(p_brand, 'Brand#', '') FROM part")
def publishers_missing(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    lines = c.raw("lineitem").select(F.concat(F.lit("supplier-"), "l_suppkey").alias("slug"))
    brands = c.raw("part").select(F.concat(F.lit("brand-"), F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit(""))).alias("slug"))
    known = c.raw("lineitem").where("l_suppkey % 4 <> 0").select(F.concat(F.lit("supplier-"), "l_suppkey").alias("slug")).distinct()
    return creation.missing(lines.unionByName(brands), known, ["slug"]).select("slug")


@register("ids_allocated", "SELECT o_orderkey AS id, o_custkey, o_orderpriority, CAST(o_orderdate AS DATE) AS o_orderdate, row_number() OVER (ORDER BY o_orderkey) + 1000 AS new_id FROM orders")
def ids_allocated(spark, sf_dir):
    rows = Catalog(spark, sf_dir).raw("orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("o_orderdate"))
    return creation.allocate(rows, "id", 1000)


@register(
    "positions_appended",
    sql("bundle_members") + """SELECT s_nationkey AS bundle_id, s_suppkey AS release_id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) + coalesce(m.top, 0) AS INTEGER) AS position
    FROM supplier LEFT JOIN (SELECT bundle_id, max(position) AS top FROM bundle_members GROUP BY 1) m ON m.bundle_id = s_nationkey""",
)
def positions_appended(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    new = c.raw("supplier").select(F.col("s_nationkey").alias("bundle_id"), F.col("s_suppkey").alias("release_id"))
    return creation.append_positions(new, c.bundle_members.select("bundle_id", "position"), "bundle_id", "release_id")


@register(
    "creation_gates",
    """SELECT p_partkey AS id, array_to_string(list_filter([CASE WHEN p_partkey % 2 = 0 THEN 'a brand-new Series' END, CASE WHEN p_partkey % 3 = 0 THEN 'multi-Volume Coverage' END,
      CASE WHEN p_partkey % 5 = 0 THEN 'an Edition Line (deluxe/omnibus/box-set packaging)' END], lambda x: x IS NOT NULL), '; ') AS gates FROM part""",
)
def creation_gates(spark, sf_dir):
    rows = Catalog(spark, sf_dir).raw("part").select(F.col("p_partkey").alias("id"), *[(F.col("p_partkey") % n == 0).alias(f"by{n}") for n in (2, 3, 5)])
    return rows.select("id", creation.gates("by2", "by3", "by5").alias("gates"))


@register(
    "observations_handled",
    """WITH last AS (SELECT l_orderkey, max(l_linenumber * 10) AS last FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 5 THEN false WHEN o_orderkey % 3 = 0 THEN true WHEN o_orderkey % 3 = 1 THEN coalesce(last, 15) <= o_orderkey % 80 ELSE false END AS handled FROM orders LEFT JOIN last ON l_orderkey = o_orderkey""",
)
def observations_handled(spark, sf_dir):
    c, k = Catalog(spark, sf_dir), F.col("o_orderkey")
    o = c.raw("orders")
    observations = o.select(k.alias("id"), F.lit(15).alias("created_at"), F.when(k % 6 != 5, k).alias("proposal_id"))
    proposals = o.select(k.alias("proposal_id"), F.when(k % 3 == 0, "inReview").when(k % 3 == 1, "rejected").otherwise("approved").alias("state"), (k % 80).alias("decided_at"))
    history = c.raw("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") * 10).alias("superseded_at"))
    return creation.already_handled(observations, proposals, history)


_OFFERS = """WITH e AS (SELECT event_id, user_id AS record_id, CASE WHEN event_id % 2 = 0 THEN 'pubDate' ELSE 'price' END AS field, event_type AS source, props, CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 WHEN 'error' THEN 0 ELSE 1 END AS rank FROM events),
    r AS (SELECT *, lead(source) OVER w AS inc_source, lead(rank) OVER w AS inc_rank, lead(props) OVER w AS cur, row_number() OVER w AS back, max(event_id) OVER (PARTITION BY record_id) AS top FROM e WINDOW w AS (PARTITION BY record_id, field ORDER BY event_id DESC)),
    o AS (SELECT *, CASE WHEN cur IS NULL THEN 'none' WHEN event_id % 7 = 0 THEN 'human' WHEN event_id % 11 = 0 THEN 'unattributed' ELSE 'source' END AS inc,
        field = 'pubDate' AND event_id % 5 <> 0 AS agree, CAST(event_id % 3 AS INTEGER) - 1 AS finer FROM r WHERE back = 1),
    d AS (SELECT *, CASE WHEN cur IS NOT DISTINCT FROM props THEN 'skip' WHEN event_id % 29 = 0 THEN 'queue' WHEN rank <= 0 THEN 'recordOnly' WHEN cur IS NULL AND inc = 'none' THEN 'auto'
        WHEN agree THEN CASE WHEN finer <= 0 THEN 'skip' WHEN inc = 'source' AND (inc_source = source OR rank >= inc_rank) THEN 'auto' WHEN inc = 'source' THEN 'recordOnly' ELSE 'queue' END
        WHEN inc <> 'source' THEN 'queue' WHEN inc_source = source OR rank > inc_rank THEN 'auto' WHEN rank = inc_rank THEN 'queue' ELSE 'recordOnly' END AS act FROM o),
    s AS (SELECT record_id, field, top, props, CASE WHEN act = 'queue' AND event_id % 4 = 0 THEN 'suppressed' ELSE act END AS act FROM d)
"""


@register(
    "fields_reconciled",
    _OFFERS + """SELECT record_id, coalesce(string_agg(field, ',' ORDER BY field) FILTER (act = 'auto'), '') AS applied, coalesce(string_agg(field, ',' ORDER BY field) FILTER (act = 'queue'), '') AS queued,
      coalesce(string_agg(field, ',' ORDER BY field) FILTER (act = 'suppressed'), '') AS suppressed, coalesce(string_agg(field, ',' ORDER BY field) FILTER (act = 'recordOnly'), '') AS recorded,
      CASE WHEN count(*) FILTER (act = 'auto') > 0 THEN any_value(top) + 1 END AS next_seq FROM s GROUP BY record_id""",
)
def fields_reconciled(spark, sf_dir):
    offers, e = _offers(spark, sf_dir)
    k = F.col("event_id")
    return creation.reconcile_fields(offers, offers.where(k % 4 == 0), e.select("record_id", k.alias("seq")))


def _offers(spark, sf_dir):
    """The last event of a user offers a value for a field that the one before it has set; the date branch is reached."""
    from pyspark.sql import Window

    c, k = F.col, F.col("event_id")
    e = Catalog(spark, sf_dir).raw("events").select("event_id", c("user_id").alias("record_id"), F.when(k % 2 == 0, "pubDate").otherwise("price").alias("field"), c("event_type").alias("source"), c("props").alias("offered"))
    e = e.withColumn("rank", F.when(c("source") == "purchase", 3).when(c("source") == "click", 2).when(c("source") == "error", 0).otherwise(1))
    w = Window.partitionBy("record_id", "field").orderBy(F.desc("event_id"))
    rows = e.select("*", F.lead("source").over(w).alias("incumbent_source"), F.lead("rank").over(w).alias("incumbent_rank"), F.lead("offered").over(w).alias("current"), F.row_number().over(w).alias("back")).where("back = 1")
    incumbent = F.when(c("current").isNull(), "none").when(k % 7 == 0, "human").when(k % 11 == 0, "unattributed").otherwise("source")
    offers = rows.select(
        "*", incumbent.alias("incumbent"), (k % 29 == 0).alias("overridden"), ((c("field") == "pubDate") & (k % 5 != 0)).alias("dates_agree"), (k % 3 - 1).cast("int").alias("finer"),
        c("source").alias("source_key"), F.md5(F.concat_ws("#", "offered", "event_id")).alias("value_hash"),
    )
    return offers, e


@register(
    "offers_settled",
    _OFFERS + """, sets AS (SELECT record_id, any_value(top) AS top, coalesce(string_agg(field, ',' ORDER BY field) FILTER (act = 'auto'), '') AS applied, coalesce(string_agg(field, ',' ORDER BY field) FILTER (act = 'queue'), '') AS queued,
      coalesce(string_agg(field || '=' || props, ';' ORDER BY field) FILTER (act = 'queue'), '') AS asks, string_agg(field || '=' || props, ';' ORDER BY field) AS every FROM s GROUP BY record_id),
    based AS (SELECT *, top + CASE WHEN applied <> '' THEN 1 ELSE 0 END AS base, record_id % 3 = 0 AS open, CASE WHEN record_id % 2 = 0 THEN top ELSE top - 1 END AS open_base, CASE WHEN record_id % 5 = 0 THEN 'x=1' ELSE every END AS open_asks FROM sets),
    told AS (SELECT *, queued <> '' AND NOT (open AND open_base = base AND open_asks = asks) AS adds FROM based)
    SELECT record_id, applied, queued, CASE WHEN adds THEN asks END AS asks, CASE WHEN adds THEN base END AS base, CASE WHEN adds AND open THEN record_id + 1000000 END AS replaces, applied <> '' OR adds AS changed FROM told""",
)
def offers_settled(spark, sf_dir):
    """Every third user has a conflict in review, which stays only where it asks for the same from the same base."""
    c = F.col
    offers, e = _offers(spark, sf_dir)
    offers = offers.withColumn("observation_id", c("record_id"))
    seqs = e.select("record_id", c("event_id").alias("seq"))
    every = offers.groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "offered"))).alias("every")).join(seqs.groupBy("record_id").agg(F.max("seq").alias("top")), "record_id")
    r = c("record_id")
    proposals = every.where(r % 3 == 0).select(
        (r + 1000000).alias("proposal_id"), r.alias("observation_id"), F.lit("inReview").alias("state"), "record_id", F.when(r % 2 == 0, c("top")).otherwise(c("top") - 1).alias("base"), F.lit(1).alias("ops"),
        F.when(r % 5 == 0, F.create_map(F.lit("x"), F.lit("1"))).otherwise(c("every")).alias("changes"),
    )
    none = offers.limit(0).select("observation_id", "field", "offered")
    got = settling.settle(offers, proposals, offers.where(c("event_id") % 4 == 0), seqs, none)
    asks = F.array_join(F.transform(F.array_sort(F.map_entries("changes")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")
    new = got["queued"].select("record_id", asks.alias("asks"), "base", "replaces")
    return got["results"].select("record_id", "applied", "queued", "changed").join(new, "record_id", "left")
