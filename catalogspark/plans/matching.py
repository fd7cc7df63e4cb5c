"""Title keys, matching ladder, duplicates, siblings."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogspark.functions import titles
from catalogspark.operators import matching, sweeping
from catalogspark.registry import register
from catalogspark.sources.fixture import Catalog, sql

NORM = "trim(regexp_replace(regexp_replace(lower({}), '\\(.*?\\)', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_STOP = "['the', 'a', 'an', 'manga', 'comic', 'comics']"
_TOKENS = "list_aggregate(list_sort(list_filter(string_split({}, ' '), lambda x: x <> '' AND NOT list_contains(" + _STOP + ", x))), 'string_agg', ' ')"


@register("title_keys", sql("series") + f"SELECT DISTINCT id, key FROM (SELECT id, {NORM.format('title')} AS key FROM series UNION ALL SELECT id, {NORM.format('alt_title')} FROM series) WHERE key <> ''")
def title_keys(spark, sf_dir):
    return matching.title_keys(Catalog(spark, sf_dir).series)


@register("document_title_keys", f"SELECT doc_id, md5({NORM.format('text')}) AS key FROM documents")
def document_title_keys(spark, sf_dir):
    return Catalog(spark, sf_dir).raw("documents").select("doc_id", F.md5(titles.normalize_title("text")).alias("key"))


_TOK = "list_distinct(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower({}), '\\(.*?\\)', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), '\\s+'), lambda x: length(x) > 1))"


@register(
    "titles_similar_pairs",
    f"""WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN left(text, 60) || ' (' || right(text, 60) || ')' ELSE '(' || left(text, 40) || ') ' || substr(text, 20, 60) END AS title FROM documents),
    w AS (SELECT doc_id, {_TOK.format("title")} AS words FROM t),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.words AS x, b.words AS y FROM w a JOIN w b ON b.doc_id = a.doc_id + 1)
    SELECT a, b, least(len(x), len(y)) = 0 OR len(list_intersect(x, y)) >= least(len(x), len(y)) * 0.5 AS similar FROM pairs""",
)
def titles_similar_pairs(spark, sf_dir):
    text, k = F.col("text"), F.col("doc_id") % 3
    short = F.concat(F.left(text, F.lit(60)), F.lit(" ("), F.right(text, F.lit(60)), F.lit(")"))
    title = F.when(k == 0, text).when(k == 1, short).otherwise(F.concat(F.lit("("), F.left(text, F.lit(40)), F.lit(") "), F.substring(text, 20, 60)))
    t = Catalog(spark, sf_dir).raw("documents").select("doc_id", title.alias("title"))
    b = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("title").alias("other"))
    return t.join(b, "doc_id").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"), titles.titles_similar("title", "other").alias("similar"))


_PAIR_KEYS = f"""texts AS (SELECT id, {NORM.format('title')} AS t FROM series WHERE status = 'active' UNION SELECT id, {NORM.format('alt_title')} FROM series WHERE status = 'active'),
  keys AS (SELECT DISTINCT id, rank, key FROM (SELECT id, 0 AS rank, t AS key FROM texts UNION ALL SELECT id, 1, {_TOKENS.format('t')} FROM texts) WHERE key <> '')"""


@register(
    "duplicate_pairs",
    sql("series") + f""", {_PAIR_KEYS} SELECT x.id AS a, y.id AS b, CASE WHEN min(x.rank) = 0 THEN 'title' ELSE 'tokens' END AS reason
    FROM keys x JOIN keys y ON x.key = y.key AND x.rank = y.rank AND x.id < y.id GROUP BY x.id, y.id""",
)
def duplicate_pairs(spark, sf_dir):
    return matching.duplicate_pairs(Catalog(spark, sf_dir).series.where("status = 'active'"))


@register(
    "duplicate_groups",
    sql("series") + f""", {_PAIR_KEYS} SELECT id, first_id, CASE WHEN min(rank) = 0 THEN 'title' ELSE 'tokens' END AS reason
    FROM (SELECT id, rank, min(id) OVER (PARTITION BY rank, key) AS first_id FROM keys) WHERE id <> first_id GROUP BY id, first_id""",
)
def duplicate_groups(spark, sf_dir):
    return matching.duplicate_groups(Catalog(spark, sf_dir).series.where("status = 'active'"))


@register(
    "duplicate_sweep",
    sql("series") + f""", {_PAIR_KEYS}, before AS (SELECT id, rank, key FROM keys WHERE id % 10 <> 0), changed AS (SELECT DISTINCT id FROM keys WHERE id % 10 = 0),
    flagged AS (SELECT x.id AS a, y.id AS b, min(x.rank) AS rank FROM before x JOIN before y ON x.key = y.key AND x.rank = y.rank AND x.id < y.id GROUP BY ALL),
    found AS (SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, min(x.rank) AS rank FROM keys x JOIN changed USING (id) JOIN keys y ON x.key = y.key AND x.rank = y.rank AND x.id <> y.id GROUP BY ALL)
    SELECT a, b, CASE WHEN rank = 0 THEN 'title' ELSE 'tokens' END AS reason, CASE WHEN a % 3 = 0 THEN 'distinct' ELSE 'open' END AS state FROM flagged
    UNION ALL SELECT a, b, CASE WHEN rank = 0 THEN 'title' ELSE 'tokens' END, 'open' FROM found""",
)
def duplicate_sweep(spark, sf_dir):
    """A sweep after a tenth of the series came in, with what an earlier one found and a moderator decided."""
    c = F.col
    series = Catalog(spark, sf_dir).series.where("status = 'active'")
    none = spark.createDataFrame([], "id bigint, rank int, key string"), spark.createDataFrame([], "a bigint, b bigint, reason string, state string")
    first = sweeping.sweep(series.where("id % 10 <> 0"), *none)
    decided = first["pairs"].withColumn("state", F.when(c("a") % 3 == 0, "distinct").otherwise(c("state")))
    return sweeping.sweep(series, first["keys"], decided)["pairs"]


@register(
    "label_equality_join",
    """WITH labels AS (SELECT DISTINCT CAST(p_size AS VARCHAR) AS label FROM part UNION SELECT DISTINCT ' ' || p_size || '.0' FROM part UNION SELECT 'x' || p_size FROM part)
    SELECT a.label AS a, b.label AS b FROM labels a JOIN labels b ON coalesce(CAST(TRY_CAST(trim(a.label) AS DOUBLE) AS VARCHAR), trim(a.label)) = coalesce(CAST(TRY_CAST(trim(b.label) AS DOUBLE) AS VARCHAR), trim(b.label)) AND a.label < b.label""",
)
def label_equality_join(spark, sf_dir):
    size = Catalog(spark, sf_dir).raw("part").select(F.col("p_size").cast("string").alias("s")).distinct()
    labels = size.select(F.explode(F.array("s", F.concat(F.lit(" "), "s", F.lit(".0")), F.concat(F.lit("x"), "s"))).alias("label"))
    a, b = labels.select(F.col("label").alias("a"), titles.label_key("label").alias("k")), labels.select(F.col("label").alias("b"), titles.label_key("label").alias("k"))
    return a.join(b, "k").where("a < b").select("a", "b")


_CODE = "'978' || lpad(CAST({} AS VARCHAR), 10, '0')"
_SIMILAR = f"(least(len({_TOK.format('s.title')}), len({_TOK.format('f.title')})) = 0 OR len(list_intersect({_TOK.format('s.title')}, {_TOK.format('f.title')})) >= least(len({_TOK.format('s.title')}), len({_TOK.format('f.title')})) * 0.5)"


@register(
    "match_ladder",
    sql("releases", "coverage", "series", "volumes", "release_series") + f""", facts AS (
    SELECT *, {NORM.format('title')} AS key FROM (
      SELECT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS fact_id, CASE WHEN l_orderkey % 5 = 0 THEN {_CODE.format('l_orderkey')} WHEN l_orderkey % 5 = 1 THEN {_CODE.format('l_orderkey - 1')} END AS code,
        CASE WHEN l_linenumber % 2 = 0 THEN s.alt_title ELSE s.title END AS title, CAST(l_linenumber AS VARCHAR) AS label, min(l_suppkey) AS publisher_id,
        CASE WHEN l_orderkey % 2 = 0 THEN 'digital' ELSE 'physical' END AS format, l_orderkey % 7 = 0 AS multi
      FROM lineitem JOIN series s ON s.id = l_partkey GROUP BY ALL)),
  coded AS (SELECT id, status, {_CODE.format('CASE WHEN id % 8 = 5 THEN id - 1 ELSE id END')} AS code FROM releases),
  code_hit AS (SELECT f.fact_id, r.id AS release_id, bool_or({_SIMILAR}) AS same
    FROM facts f JOIN (SELECT code, min(id) AS id, arg_min(status, id) AS status FROM coded GROUP BY code) r ON f.code = r.code AND r.status = 'active' JOIN release_series rs ON rs.release_id = r.id JOIN series s ON s.id = rs.series_id GROUP BY ALL),
  titled AS (SELECT id, {NORM.format('title')} AS key FROM series WHERE status = 'active' UNION SELECT id, {NORM.format('alt_title')} FROM series WHERE status = 'active'),
  sizes AS (SELECT release_id, count(*) AS n FROM coverage GROUP BY 1),
  walked AS (SELECT DISTINCT f.fact_id, r.id AS release_id, r.id % 23 = 0 OR r.id % 29 = 0 AS blocked,
      CASE WHEN NOT coalesce(z.n = 1 AND f.publisher_id = r.publisher_id, false) THEN 'loose' WHEN r.format = f.format THEN 'strict' ELSE 'sibling' END AS bucket
    FROM facts f JOIN titled t ON t.key = f.key JOIN volumes v ON v.series_id = t.id AND v.label = f.label JOIN coverage c ON c.volume_id = v.id
    JOIN releases r ON r.id = c.release_id AND r.status = 'active' JOIN sizes z ON z.release_id = r.id),
  counts AS (SELECT fact_id, count(*) FILTER (bucket = 'strict') AS ns, count(*) FILTER (bucket = 'loose') AS nl, min(release_id) FILTER (bucket = 'strict') AS one, bool_or(blocked) FILTER (bucket = 'strict') AS held FROM walked GROUP BY fact_id)
  SELECT f.fact_id, CASE WHEN h.fact_id IS NOT NULL THEN 2 WHEN multi THEN 5 WHEN ns > 0 THEN 3 WHEN nl > 0 THEN 4 ELSE 5 END AS rung,
    CASE WHEN h.same THEN 'match' WHEN h.fact_id IS NOT NULL THEN 'review' WHEN multi THEN 'create' WHEN ns = 1 AND NOT held THEN 'match' WHEN ns > 0 OR nl > 0 THEN 'review' ELSE 'create' END AS outcome,
    CASE WHEN h.fact_id IS NOT NULL THEN h.release_id WHEN NOT multi AND ns = 1 THEN one END AS release_id
  FROM facts f LEFT JOIN code_hit h ON h.fact_id = f.fact_id LEFT JOIN counts n ON n.fact_id = f.fact_id""",
)
def match_ladder(spark, sf_dir):
    """Every line item as a fact; a release is its own edition here, and some releases share their code with the one before."""
    c = Catalog(spark, sf_dir)
    code = lambda x: F.concat(F.lit("978"), F.lpad(x.cast("string"), 10, "0"))
    key = F.col("l_orderkey")
    lines = c.raw("lineitem").groupBy("l_orderkey", "l_partkey", "l_linenumber").agg(F.min("l_suppkey").alias("publisher_id"))
    series = c.series.select("*", titles.normalize_title("title").alias("title_key"), titles.normalize_title("alt_title").alias("alt_key"), titles.similarity_tokens("title").alias("title_words"), titles.similarity_tokens("alt_title").alias("alt_words"))
    alternative = F.col("l_linenumber") % 2 == 0
    facts = lines.join(series, F.col("id") == F.col("l_partkey")).select(
        (key * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("fact_id"),
        F.when(key % 5 == 0, code(key)).when(key % 5 == 1, code(key - 1)).alias("code"),
        F.when(alternative, F.col("alt_title")).otherwise(F.col("title")).alias("title"),
        F.when(alternative, F.col("alt_words")).otherwise(F.col("title_words")).alias("words"),
        F.when(alternative, F.col("alt_key")).otherwise(F.col("title_key")).alias("key"),
        titles.label_key(F.col("l_linenumber").cast("string")).alias("label_key"),
        "publisher_id",
        F.when(key % 2 == 0, "digital").otherwise("physical").alias("format"),
        (key % 7 == 0).alias("multi"),
    )
    releases = c.releases
    live = releases.where("status = 'active'").select(F.col("id").alias("release_id"), "publisher_id", "format")
    worded = c.series.select(F.col("id").alias("series_id"), titles.similarity_tokens("title").alias("words"))
    named = c.release_series.join(worded, "series_id").groupBy("release_id").agg(F.collect_set("words").alias("words"))
    own = F.col("id") - F.when(F.col("id") % 8 == 5, 1).otherwise(0)
    by_code = matching.first_of_code(releases.select(F.col("id").alias("release_id"), code(own).alias("code"), "status"), named)
    keys = matching.title_keys(c.series.where("status = 'active'")).withColumnRenamed("id", "series_id")
    size = c.coverage.groupBy("release_id").agg((F.count(F.lit(1)) == 1).alias("single"))
    catalog = c.coverage.select("release_id", "series_id", titles.label_key(F.col("position").cast("string")).alias("label_key"))
    catalog = catalog.join(live, "release_id").join(size, "release_id").withColumn("blocked", (F.col("release_id") % 23 == 0) | (F.col("release_id") % 29 == 0))
    # titles last: they are wider than all the rest and two for each series
    catalog = catalog.join(keys, "series_id").drop("series_id")
    return matching.match_ladder(facts, by_code, catalog)


@register(
    "sibling_editions",
    """WITH editions AS (SELECT o_orderkey AS id, o_custkey % 3 AS publisher_id, CASE WHEN o_orderkey % 17 = 0 THEN 'hidden' ELSE 'active' END AS status, o_orderkey % 11 = 0 AS locked, CASE WHEN o_orderkey % 13 = 0 THEN 1 END AS line_id FROM orders),
    coverage AS (SELECT DISTINCT l_orderkey AS edition_id, l_linenumber AS position, l_linenumber * 10 + l_orderkey % 2 AS volume_id, CASE WHEN l_orderkey % 5 = 0 THEN 'partial' ELSE 'complete' END AS extent FROM lineitem),
    whole AS (SELECT edition_id, string_agg(volume_id, ',' ORDER BY position) AS volumes, bool_and(extent = 'complete') AS complete FROM coverage GROUP BY 1),
    known AS (SELECT publisher_id, volumes, min(edition_id) AS edition_id FROM whole JOIN editions e ON e.id = edition_id WHERE complete AND status = 'active' AND NOT locked AND line_id IS NULL GROUP BY ALL)
    SELECT w.edition_id AS want_id, k.edition_id FROM whole w JOIN editions e ON e.id = w.edition_id JOIN known k ON k.publisher_id = e.publisher_id AND k.volumes = w.volumes""",
)
def sibling_editions(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    key = F.col("o_orderkey")
    editions = c.raw("orders").select(key.alias("id"), (F.col("o_custkey") % 3).alias("publisher_id"), F.when(key % 17 == 0, "hidden").otherwise("active").alias("status"), (key % 11 == 0).alias("locked"), F.when(key % 13 == 0, 1).alias("line_id"))
    line = F.col("l_orderkey")
    coverage = c.raw("lineitem").select(line.alias("edition_id"), F.col("l_linenumber").alias("position"), (F.col("l_linenumber") * 10 + line % 2).alias("volume_id"), F.when(line % 5 == 0, "partial").otherwise("complete").alias("extent")).distinct()
    wanted = coverage.groupBy("edition_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "volume_id"))), lambda x: x["volume_id"]).alias("volumes"))
    wanted = wanted.join(editions.select(F.col("id").alias("edition_id"), "publisher_id"), "edition_id").withColumnRenamed("edition_id", "want_id")
    return matching.sibling_editions(wanted, editions, coverage)


@register(
    "publisher_prefix_match",
    sql("publishers") + f""", names AS (SELECT unnest([name || ' books', left(name, length(name) - 2), name, left(name, 8), upper(name)]) AS name FROM publishers UNION SELECT 'nobody'),
    pairs AS (SELECT DISTINCT n.name, p.id FROM names n JOIN publishers p ON p.status = 'active'
      AND ({NORM.format('n.name')} = {NORM.format('p.name')} OR starts_with({NORM.format('n.name')}, {NORM.format('p.name')} || ' ') OR starts_with({NORM.format('p.name')}, {NORM.format('n.name')} || ' ')))
    SELECT name, min(id) AS publisher_id FROM pairs GROUP BY name HAVING count(*) = 1""",
)
def publisher_prefix_match(spark, sf_dir):
    """Names with a word more, cut within a word, in full, of the first word alone (which all share), and of hidden publishers too."""
    p, name = Catalog(spark, sf_dir).publishers, F.col("name")
    given = F.array(F.concat(name, F.lit(" books")), F.left(name, F.length(name) - 2), name, F.left(name, F.lit(8)), F.upper(name))
    names = p.select(F.explode(given).alias("name")).union(spark.createDataFrame([("nobody",)], "name string"))
    return matching.prefix_matches(names.distinct(), p)


@register(
    "covered_labels",
    """WITH l AS (SELECT DISTINCT p_size * 3 + p_partkey % 3 AS id, CASE p_partkey % 3 WHEN 1 THEN CAST(p_size AS VARCHAR)
        WHEN 0 THEN p_size || ['-', ' - ', ' –', '–  ', '--'][p_size % 5 + 1] || (p_size + p_size % 25) END AS label FROM part),
    r AS (SELECT *, TRY_CAST(regexp_extract(label, '^([0-9]+)\\s*[-–]\\s*([0-9]+)$', 1) AS BIGINT) AS lo, TRY_CAST(regexp_extract(label, '^([0-9]+)\\s*[-–]\\s*([0-9]+)$', 2) AS BIGINT) AS hi FROM l)
    SELECT id, label, CASE WHEN label IS NULL THEN '' WHEN hi > lo AND hi - lo < 20 THEN array_to_string(range(lo, hi + 1), ',') ELSE label END AS covered FROM r""",
)
def covered_labels(spark, sf_dir):
    n, kind = F.col("p_size"), F.col("p_partkey") % 3
    dash = F.element_at(F.array(*map(F.lit, ["-", " - ", " –", "–  ", "--"])), n % 5 + 1)
    text = F.when(kind == 1, n.cast("string")).when(kind == 0, F.concat(n.cast("string"), dash, (n + n % 25).cast("string")))
    rows = Catalog(spark, sf_dir).raw("part").select((n * 3 + kind).alias("id"), text.alias("label")).distinct()
    return rows.select("id", "label", F.array_join(titles.covered_labels("label"), ",").alias("covered"))
