"""URL filter by association rules, with DataFrame functions only.

A page's tokens are the parts of its host, the words of its path and the keys of its query. Tokens that the labelled pages
hold on the very same pages are one item (a template's query keys, say). FP-growth mines the items together with the label. A
rule has ``MOST_TOKENS`` items at most, so a page of many items is mined in parts: its items are cut into blocks of ``BLOCK``,
and each choice of ``MOST_TOKENS`` blocks is a basket. Any combination that can be a rule is whole in some basket of each page that has it, so none is lost, and
a basket's combinations stay few. What is found so is counted again over whole pages; combinations that come with the label "poor" with enough support and confidence, and that no shorter rule of the
same confidence covers, become rules. A rule's item stands for any of its tokens. A rule is filed under its rarest item's
tokens; a page's tokens look up the rules, which are then compared whole.

A list of host and path rules comes before the mined ones: a rule fits its host and all subdomains if the path
starts with the rule's path; the longest rule wins.

Labels: row ``doc_id`` of the label table marks page ``page_id``. The miner sees ``SAMPLE`` labelled pages at
most, picked by a hash. A null url or one without ``://`` has an empty host and path and no token; nothing
blocks it. Repeated rows are rows of their own. No labels or no rules: everything that no listed rule blocks is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

NAME = "op8_url"
SAMPLE = 50_000
#: Least pages of a rule, least share of them that are poor, and most tokens of a rule.
LEAST, CONFIDENCE, MOST_TOKENS = 20, 0.7, 4
#: Items of a block; a basket holds ``MOST_TOKENS`` blocks.
BLOCK = 3
_POOR = "label=poor"
#: Fixed values: (host, path, verdict).
LISTED = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    start = F.locate("://", url)
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """Distinct tokens of a url: ``h:`` parts of its host, ``p:`` words of its path, ``q:`` keys of its query."""
    host, path = host_and_path(url)
    mark = lambda kind, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    keys = F.regexp_extract_all(F.split_part(F.coalesce(url, F.lit("")), F.lit("#"), F.lit(1)), F.lit(r"[?&]([^=&#]+)"), 1)
    every = F.concat(mark("h:", F.split(host, r"[.:-]")), mark("p:", F.split(F.lower(path), r"[^\p{L}\p{N}]+")), mark("q:", keys))
    return F.array_distinct(every)


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(size, name, verdict) of the longest rule that fits, or null; the rules are a parameter of a fixed size."""
    if not rules:
        return F.lit(None).cast("struct<size:int,name:string,verdict:string,host:string,path:string>")
    every = F.array(*[F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("name"), F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for h, p, v in rules])
    fits = lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"])
    return F.array_max(F.filter(every, fits))


def baskets(sets: DataFrame, length: int = MOST_TOKENS, block: int = BLOCK) -> DataFrame:
    """``sets (items, poor)`` with each row's items cut into blocks: a row for each choice of ``length`` blocks, one row where there are no more.

    Any ``length`` items of a set are in one of its rows together. A set of b blocks gives b!/(length! (b - length)!) rows, exploded one block at a time.
    """
    blocks = F.ceil(F.size("items") / block).cast("int")
    few = sets.where(blocks <= length).select("items", "poor")
    rows = sets.where(blocks > length).withColumn("part", F.array().cast("array<string>")).withColumn("next", F.lit(0))
    for left in range(length - 1, -1, -1):
        rows = rows.select("items", "poor", "part", F.explode(F.sequence("next", blocks - 1 - left)).alias("at"))
        rows = rows.select("items", "poor", F.concat("part", F.slice("items", F.col("at") * block + 1, block)).alias("part"), (F.col("at") + 1).alias("next"))
    return few.unionByName(rows.select(F.col("part").alias("items"), "poor"))


def mine(pages: DataFrame, labels: DataFrame, page_column: str = "page_id", sample: int = SAMPLE, least: int = LEAST, confidence: float = CONFIDENCE) -> DataFrame:
    """(items, index, confidence): rules from ``pages (page_column, url)`` and ``labels (doc_id, quality)``.

    ``items`` holds for each item its tokens, ``index`` the tokens of the rarest one. All that is gathered here is bounded by the sample.
    """
    from pyspark.ml.fpm import FPGrowth

    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 0).alias("poor"))
    n = known.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < int(min(1.0, sample / max(n, 1)) * (1 << 30))
    rows = pages.select(F.col(page_column).alias("doc_id"), tokens(F.col("url")).alias("tokens")).where(F.size("tokens") > 0)
    seen = stored(rows.join(known.where(draw), "doc_id").select(F.expr("uuid()").alias("row"), "tokens", "poor"), "labelled")
    n, bad = seen.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("poor").cast("int")), F.lit(0))).first()
    if not bad:
        return pages.sparkSession.createDataFrame([], "items array<array<string>>, index array<string>, confidence double")
    by_token = seen.select("row", "poor", F.explode("tokens").alias("token"))
    exact = lambda k: F.sum(F.xxhash64("row", F.lit(k)).cast("decimal(38,0)")).alias(f"h{k}")
    of = by_token.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("poor").cast("int")).alias("p"), exact(1), exact(2))
    # items that few poor pages have can't be part of a rule
    items = of.where(F.col("p") >= int(least * confidence)).groupBy("n", "p", "h1", "h2").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    items = stored(items.select(F.col("tokens")[0].alias("item"), "tokens", "n"), "items")
    has = seen.select("row", "poor", F.explode("tokens").alias("item")).join(items.select("item"), "item")
    held = stored(has.groupBy("row", "poor").agg(F.sort_array(F.collect_set("item")).alias("items")), "held")
    # a rule's support is that of its items on poor pages, so only those are mined
    sets = stored(baskets(held.where("poor")).select(F.array_append("items", F.lit(_POOR)).alias("items")), "sets")
    # counted in baskets a combination has no less than its pages; half a page less keeps the share's rounding from losing one
    share = (least * confidence - 0.5) / max(sets.count(), 1)
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, max(0.0, share))).fit(sets).freqItemsets
    names = F.sort_array(F.array_remove("items", _POOR))
    rules = found.where(F.array_contains("items", _POOR)).select(names.alias("names")).where((F.size("names") > 0) & (F.size("names") <= MOST_TOKENS))
    rules = stored(rules, "names")
    # support and confidence over all labelled pages and all their items
    first = rules.select("names", F.explode("names").alias("item")).join(items.select("item", "n"), "item").groupBy("names").agg(F.min_by("item", F.struct("n", "item")).alias("item"))
    hits = held.select(F.col("items").alias("own"), "poor", F.explode("items").alias("item")).join(first, "item").where(F.size(F.array_except("names", "own")) == 0)
    counts = hits.groupBy("names").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("poor").cast("int")).alias("p"))
    sure = F.col("p") / F.col("n")
    rules = stored(counts.where((F.col("p") >= least * confidence) & (sure >= confidence) & (sure > bad / n)).join(first, "names").select("names", "item", sure.alias("confidence")), "rules")
    short = rules.select(F.col("names").alias("few"), "item", F.col("confidence").alias("sure"))
    covered = rules.select("names", "confidence", F.explode("names").alias("item")).join(short, "item")
    covered = covered.where((F.size("few") < F.size("names")) & (F.size(F.array_except("few", "names")) == 0) & (F.col("sure") >= F.col("confidence")))
    rules = rules.join(covered.select("names").distinct(), "names", "left_anti").withColumnRenamed("item", "rare")
    whole = rules.select("*", F.explode("names").alias("item")).join(items.select("item", "tokens"), "item")
    whole = whole.groupBy("names", "rare", "confidence").agg(F.sort_array(F.collect_list("tokens")).alias("items"), F.max(F.when(F.col("item") == F.col("rare"), F.col("tokens"))).alias("index"))
    return stored(whole.select("items", "index", "confidence"), "rules")


def blocked(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct urls that some rule covers: a token of each of the rule's items."""
    own = urls.where("url IS NOT NULL").select("url").distinct().select("url", tokens(F.col("url")).alias("own"))
    filed = rules.select("items", F.explode("index").alias("token"))
    hits = own.select("*", F.explode("own").alias("token")).join(filed, "token")
    return hits.where(F.forall("items", lambda item: F.arrays_overlap(item, F.col("own")))).select("url").distinct()


def judge(pages: DataFrame, rules: DataFrame, listed: list[tuple[str, str, str]]) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``, which take the place of columns of these names; other columns stay as they are."""
    host, path = host_and_path(F.col("url"))
    own = "__op8_mined", "__op8_listed"
    bad = blocked(pages, rules).withColumn(own[0], F.lit(True))
    out = pages.join(bad, "url", "left").withColumn("host", host).withColumn("path", path).withColumn(own[1], listed_rule(F.col("host"), F.col("path"), listed))
    mined = F.when(F.coalesce(own[0], F.lit(False)), "block").otherwise("allow")
    return out.withColumn("rule", F.col(f"{own[1]}.name")).withColumn("verdict", F.coalesce(f"{own[1]}.verdict", mined)).drop(*own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = mine(pages, table(spark, sf_dir, "labels"))
    return judge(pages, rules, LISTED).select("page_id", "host", "path", "rule", "verdict")
