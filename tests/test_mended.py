"""Cases in which a catalog operator once gave a wrong result."""

import json

from pyspark.sql import functions as F

from catalogspark.functions import codes, markup, titles
from catalogspark.operators import creation, editing, matching, roles
from catalogspark.sources import wire


def test_wide_rows_are_all_numbered(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        rows = spark.range(400_000).select((F.col("id") * 7919 % 400_009).alias("id"), F.sha2(F.col("id").cast("string"), 512).alias("a"), F.sha2((F.col("id") + 1).cast("string"), 512).alias("b"), F.lit("x" * 100).alias("part"))
        creation.allocate(rows, "id", 10).write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.columns == ["id", "a", "b", "part", "new_id"]
    assert out.agg(F.count("*"), F.count_distinct("new_id"), F.min("new_id"), F.max("new_id")).first() == (400_000, 400_000, 11, 400_010)
    w = out.select("id", "new_id").orderBy("new_id").toPandas()
    assert w["id"].is_monotonic_increasing


def test_parentheses_tell_no_titles_alike(spark):
    pairs = [("Cat (Dog Bird)", "Dog Bird"), ("Cat (Dog) Bird", "cat bird"), ("(all of it)", "x y"), ("Tom's Day", "toms day"), ("One Two", "Two Three Four")]
    t = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in t.select(titles.titles_similar("a", "b")).collect()] == [False, True, True, True, True]


def test_labels_with_blanks(spark):
    cases = {"1–3": "1,2,3", "1 - 3": "1,2,3", "1 –  3": "1,2,3", "3-1": "3-1", "1-21": "1-21", "1-20": ",".join(map(str, range(1, 21))), "1-3\n": "1-3\n", "1--3": "1--3", "x": "x", "9999999990-9999999991": "9999999990,9999999991"}
    t = spark.createDataFrame([(c,) for c in cases], "l string")
    assert {r[0]: r[1] for r in t.select("l", F.array_join(titles.covered_labels("l"), ",")).collect()} == cases


def test_prefixes_end_with_words(spark):
    p = spark.createDataFrame([(1, "Viz", "active"), (2, "Dark Horse", "active"), (3, "Viz Media", "hidden"), (4, "Seven Seas", "active"), (5, "Seven", "active")], "id int, name string, status string")
    names = ["vizard books", "dark h", "dark", "VIZ Media LLC", "viz", "Dark Horse Comics (US)", "seven seas inc", "seven", "", "..."]
    got = matching.prefix_matches(spark.createDataFrame([(n,) for n in names], "name string"), p)
    assert {r["name"]: r["publisher_id"] for r in got.collect()} == {"dark": 2, "VIZ Media LLC": 1, "viz": 1, "Dark Horse Comics (US)": 2}


def test_the_first_release_of_a_code_decides(spark):
    releases = spark.createDataFrame([(5, "A", "active"), (3, "A", "active"), (1, "B", "hidden"), (2, "B", "active"), (9, None, "active")], "release_id int, code string, status string")
    named = releases.select("release_id", F.array(F.lit("Tom")).alias("titles"))
    first = matching.first_of_code(releases, named)
    assert [(r["code"], r["release_id"]) for r in first.collect()] == [("A", 3)]
    facts = spark.createDataFrame([(1, "A", "Tom", "tom", "1", 1, "physical", False), (2, "B", "Tom", "tom", None, 1, "physical", False)], "fact_id int, code string, title string, key string, label_key string, publisher_id int, format string, multi boolean")
    catalog = spark.createDataFrame([(7, "tom", None, 1, "physical", True, False), (8, "tom", None, 1, "digital", True, False)], "release_id int, key string, label_key string, publisher_id int, format string, single boolean, blocked boolean")
    got = sorted(tuple(r) for r in matching.match_ladder(facts, first, catalog).collect())
    assert got == [(1, 2, "match", 3), (2, 3, "match", 7)]


def test_one_administrator_stays(spark):
    users = spark.createDataFrame([(1, "administrator", False), (2, "administrator", False), (3, "administrator", True), (4, "editor", None), (5, None, None)], "user_id int, role string, suspended boolean")
    commands = [(1, 2, "revoke", 1, None), (2, 1, "suspend", 2, None), (3, 1, "reinstate", 3, None), (4, 2, "appoint", 5, "moderator"), (5, 3, "revoke", 4, None), (6, 1, "revoke", 9, None)]
    run = lambda cs: roles.govern(spark.createDataFrame([(*c, None) for c in cs], "seq int, actor_id int, action string, user_id int, role string, reason string"), users)
    got = run(commands)
    assert {r["seq"]: r["problem"] for r in got.collect()} == {1: None, 2: "lastAdministrator", 3: None, 4: None, 5: "forbidden", 6: "unknownUser"}
    after = {r["user_id"]: (r["role"], r["suspended"]) for r in roles.users_after(users, got).collect()}
    assert after == {1: (None, False), 2: ("administrator", False), 3: ("administrator", False), 4: ("editor", False), 5: ("moderator", False)}
    # the same two removals, but after another has come back
    later = [(3, 2, "revoke", 1, None), (4, 1, "appoint", 2, "editor"), (1, 1, "reinstate", 3, None)]
    assert {r["seq"]: r["problem"] for r in run(later).collect()} == {1: None, 3: None, 4: None}
    assert sorted((r["seq"], r["place"], r["action"], r["role"], r["reason"]) for r in roles.audit_rows(run(later)).collect()) == [
        (1, 0, "reinstated", "administrator", None), (3, 0, "revoked", "administrator", None), (4, 0, "revoked", "administrator", "Role changed to editor."), (4, 1, "appointed", "editor", None),
    ]


def test_claims_are_marks(spark):
    items = spark.createDataFrame([(1, "inReview", 7), (2, "draft", None), (3, "inReview", 7), (4, "approved", None), (5, "inReview", 7)], "id int, state string, claimed_by int")
    commands = spark.createDataFrame([(1, "claim", 8), (2, "claim", 8), (3, "requestChanges", 8), (4, "withdraw", 8)], "id int, action string, user_id int")
    assert sorted(tuple(r) for r in editing.advance(items, commands).collect()) == [(1, "inReview", 8, False), (2, "draft", None, True), (3, "draft", None, False), (4, "approved", None, True), (5, "inReview", 7, False)]


def test_prices_under_either_name(spark):
    t = {"isbn": "978-1-23456-789-0", "title": "Tom, Vol. 1", "price": [{"currencyCode": "USD", "amount": 3}]}
    rows = [{**t, "priceUSD": 9.99}, {**t, "priceUsd": 8.5, "priceUSD": 9.99}, {**t, "priceUSD": 0}, t, {**t, "title": " ", "priceUSD": 1}]
    page = json.dumps({"data": {"titles": rows}})
    got = wire.title_lists(spark.createDataFrame([(page,), ("{}",), (None,), ("no json",)], "value string"))
    assert [r["price_cents"] for r in got.collect()] == [999, 850, 300, 300]


def test_compatibility_forms_and_references(spark):
    t = spark.createDataFrame([("ﬁne ① Straße Ελ é",), ("",), (None,)], "t string")
    assert [r[0] for r in t.select(codes.slugify("t")).collect()] == ["fine-1-stra-e-e", "untitled", None]
    h = spark.createDataFrame([("<b>&#233;</b>&#x4E2D;&#0;&#xD800;&amp;#65;&lt;",)], "h string")
    assert h.select(markup.strip_html("h")).first()[0] == "é 中&#0;&#xD800;&#65;<"
