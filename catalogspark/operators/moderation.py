"""Submitted changes: the field registry, normal forms, checks of drafts and evidence, warnings, the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.functions import codes, dates

#: Fixed values: (record type, field, kind, required, editorial).
FIELDS = [
    ("publisher", "name", "text", True, False), ("publisher", "description", "textarea", False, True),
    ("seriesFamily", "name", "text", True, False),
    ("series", "title", "text", True, False), ("series", "altTitles", "stringList", False, False), ("series", "sourceStatus", "select", False, False),
    ("volume", "label", "text", False, False), ("volume", "synopsis", "textarea", False, True),
    ("editionLine", "name", "text", True, False),
    ("edition", "linePosition", "text", False, False),
    ("release", "binding", "text", False, False), ("release", "language", "text", True, False), ("release", "isbn13", "isbn13", False, False), ("release", "isbn10", "isbn10", False, False),
    ("release", "pubDate", "partialDate", False, False), ("release", "price", "price", False, False), ("release", "description", "textarea", False, True),
    ("releaseVariant", "name", "text", True, False),
    ("releaseBundle", "name", "text", True, False), ("releaseBundle", "isbn13", "isbn13", False, False), ("releaseBundle", "isbn10", "isbn10", False, False),
    ("releaseBundle", "pubDate", "partialDate", False, False), ("releaseBundle", "price", "price", False, False), ("releaseBundle", "description", "textarea", False, True),
]
#: States of a source work; most ops of a draft, and how many make a bulk change.
SOURCE_STATUS = ["ongoing", "completed", "hiatus", "cancelled"]
MOST_OPS, BULK = 25, 10


def registry(spark: SparkSession) -> DataFrame:
    """(type, field, kind, required, editorial): a fixed table of two dozen rows."""
    return spark.createDataFrame(FIELDS, "type string, field string, kind string, required boolean, editorial boolean")


def normal_value(kind: Column, required: Column, value: Column) -> Column:
    """struct(ok, value): the normal form of a submitted text, null where it clears the field; not ok where it is none.

    Dates and prices are JSON objects, lists JSON arrays; normal dates are yyyymmdd keys, normal prices "cents CUR".
    """
    bare = F.nullif(F.regexp_replace(value, r"^\s+|\s+$", ""), F.lit(""))
    answer = lambda ok, v: F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), F.when(ok, v).alias("value"))
    text = answer(bare.isNotNull() | ~required, bare)
    status = answer(bare.isNull() | bare.isin(*SOURCE_STATUS), bare)
    code = F.nullif(codes.compact(F.coalesce(value, F.lit(""))), F.lit(""))
    isbn13, isbn10 = answer(code.isNull() | code.rlike(r"^[0-9]{13}$"), code), answer(code.isNull() | code.rlike(r"^[0-9]{9}[0-9X]$"), code)
    whole = lambda x: (x == F.floor(x)) & x.isNotNull()
    d = F.from_json(value, "struct<year:double,month:double,day:double>")
    y, m, n = d["year"], d["month"], d["day"]
    day_ok = whole(y) & y.between(1900, 2200) & (m.isNull() | whole(m) & m.between(1, 12)) & (n.isNull() | m.isNotNull() & whole(n) & n.between(1, 31))
    day = answer(value.isNull() | day_ok, dates.sort_key(y, m, n).cast("string"))
    p = F.from_json(value, "struct<amountCents:double,currency:string>")
    price_ok = whole(p["amountCents"]) & (p["amountCents"] >= 0) & p["currency"].rlike(r"^[A-Za-z]{3}$")
    price = answer(value.isNull() | price_ok, F.concat(p["amountCents"].cast("bigint").cast("string"), F.lit(" "), F.upper(p["currency"])))
    items = F.from_json(value, "array<string>")
    rows = F.array_join(F.filter(F.transform(items, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""), "|")
    many = answer(value.isNull() | items.isNotNull(), F.coalesce(rows, F.lit("")))
    return (
        F.when(kind.isin("text", "textarea"), text).when(kind == "select", status).when(kind == "isbn13", isbn13).when(kind == "isbn10", isbn10)
        .when(kind == "partialDate", day).when(kind == "price", price).when(kind == "stringList", many)
    )


def validate(changes: DataFrame) -> DataFrame:
    """``changes (op_id, type, field, value, before)`` with normal form and problem: twice, unknownField, invalidField, unchanged or null."""
    twice = changes.groupBy("op_id", "field").agg(F.count(F.lit(1)).alias("times"))
    rows = changes.join(twice, ["op_id", "field"]).join(F.broadcast(registry(changes.sparkSession)), ["type", "field"], "left")
    rows = rows.withColumn("normal", normal_value(F.col("kind"), F.col("required"), F.col("value")))
    problem = (
        F.when(F.col("times") > 1, "twice").when(F.col("kind").isNull(), "unknownField").when(~F.col("normal.ok"), "invalidField")
        .when(F.col("normal.value").eqNullSafe(F.col("before")), "unchanged")
    )
    return rows.select("op_id", "field", F.col("normal.value").alias("after"), problem.alias("problem"))


def evidence_problem(kind, url, note, known) -> Column:
    """invalidEvidence for a url that is no http link, a blank note or an unknown observation; else null."""
    c = F.col
    bad = F.when(c(kind) == "url", ~F.coalesce(c(url).rlike(r"^https?://\S+$"), F.lit(False))).when(c(kind) == "note", F.coalesce(F.trim(c(note)), F.lit("")) == "").otherwise(~F.coalesce(c(known), F.lit(False)))
    return F.when(bad, "invalidEvidence")


def draft_checks(ops: DataFrame) -> DataFrame:
    """(draft_id, n_ops, problem, warnings, needs_evidence) of drafts of ``ops (draft_id, kind, table, ref_id, partial, editorial)``.

    Too few or many ops, or two updates of a record, are problems; a new series, a bulk change and partial coverage are
    warnings, in this order; a creation or a change that isn't editorial needs evidence.
    """
    same = ops.where("kind = 'update'").groupBy("draft_id", "ref_id").agg((F.count(F.lit(1)) > 1).alias("again")).groupBy("draft_id").agg(F.bool_or("again").alias("again"))
    c = F.col
    create = c("kind") == "create"
    told = ops.groupBy("draft_id").agg(
        F.count(F.lit(1)).alias("n_ops"), F.bool_or(create & (c("table") == "series")).alias("new"), F.bool_or(create & c("partial")).alias("part"),
        F.bool_or(create | (c("kind") == "update") & ~c("editorial")).alias("needs_evidence"),
    ).join(same, "draft_id", "left")
    warnings = F.array_compact(F.array(F.when(c("new"), "newSeries"), F.when(c("n_ops") > BULK, "bulk"), F.when(c("part"), "partialCoverage")))
    problem = F.when(c("n_ops") > MOST_OPS, "tooManyOps").when(F.coalesce("again", F.lit(False)), "sameRecord")
    return told.select("draft_id", "n_ops", problem.alias("problem"), F.array_join(warnings, ",").alias("warnings"), "needs_evidence")


def review_queue(proposals: DataFrame, versions: DataFrame, ops: DataFrame, record_type: str | None = None, kind: str | None = None) -> DataFrame:
    """Proposals in review with their current version and its facets, sorted and distinct; the filters keep proposals that hold the type or kind."""
    current = proposals.where("state = 'inReview'").join(versions.withColumnRenamed("version_no", "current_no"), ["proposal_id", "current_no"])
    facets = ops.groupBy("proposal_id", "version_no").agg(F.array_sort(F.collect_set("type")).alias("types"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    rows = current.join(facets.withColumnRenamed("version_no", "current_no"), ["proposal_id", "current_no"], "left")
    for name, want in (("types", record_type), ("kinds", kind)):
        if want is not None:
            rows = rows.where(F.array_contains(name, want))
    return rows


def new_suppressions(rejected: DataFrame, known: DataFrame) -> DataFrame:
    """(record_id, field, source_key, value_hash) that rejecting source-authored changes adds; what is there already isn't added again."""
    keys = ["record_id", "field", "source_key", "value_hash"]
    return rejected.where("source_key IS NOT NULL").select(*keys).distinct().join(known.select(*keys), keys, "left_anti")
