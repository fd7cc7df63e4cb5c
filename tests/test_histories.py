"""Ops in words, histories and forms on small cases."""

from catalogspark.operators import histories

_OPS = "proposal_id int, place int, kind string, table string, temp_id string, ref string, type string, record_id bigint, into_id bigint, base bigint, title string, label string, slug string, n_coverage int, format string, binding string, isbn13 string"
_NAMES = [f.split()[0] for f in _OPS.split(", ")]


def _ops(spark, *rows):
    return spark.createDataFrame([tuple(r.get(c) for c in _NAMES) for r in rows], _OPS)


def test_ops_in_words(spark):
    shown = spark.createDataFrame([("series", 1, "active", "Cat"), ("series", 2, "hidden", "Dog"), ("publisher", 1, "active", "P"), ("edition", 4, "active", "Cat Vol 1")], "type string, id bigint, status string, title string")
    revisions = spark.createDataFrame([("series", 1, 5, "five"), ("series", 1, 6, None), ("series", 2, 1, "one")], "type string, id bigint, seq bigint, comment string")
    locked = spark.createDataFrame([("series", 3)], "type string, id bigint")
    new = lambda p, place, table, **more: {"proposal_id": p, "place": place, "kind": "create", "table": table, **more}
    on = lambda p, place, kind, record, **more: {"proposal_id": p, "place": place, "kind": kind, "type": "series", "record_id": record, **more}
    ops = _ops(
        spark,
        new(1, 0, "volumes", temp_id="v", ref="s", label="1"), new(1, 1, "series", temp_id="s", title="Fox"), new(1, 2, "volumes", temp_id="v", ref="s"), new(1, 3, "series", temp_id="s", title="Owl"),
        new(1, 4, "volumes", ref="s", label=""), new(1, 5, "editions", temp_id="e", ref="1", n_coverage=1), new(1, 6, "editions", slug="q", ref="9"), new(1, 7, "releases", ref="e", format="print", binding="", isbn13="978"),
        new(1, 8, "releases", ref="4", binding="soft"), new(1, 9, "releases", ref="77", format="digital"), new(1, 10, "publishers"),
        on(2, 0, "update", 1, base=6), on(2, 1, "update", 1, base=5), on(2, 2, "update", 2, base=1), on(2, 3, "update", 9), on(2, 4, "merge", 1, into_id=9), on(2, 5, "split", 2), on(2, 6, "clearOverride", 9), on(2, 7, "update", 1, base=99), on(2, 8, "lock", 1),
        # another proposal's temporary ids don't count
        new(3, 0, "volumes", ref="s"),
    )
    got = {(r["proposal_id"], r["place"]): r for r in histories.rendered(ops, shown, revisions, locked).collect()}
    assert [got[1, i]["summary"] for i in range(11)] == [
        'Create volume "1" in "s"', 'Create new series "Fox"', 'Create an unnumbered volume in new series "Fox"', 'Create new series "Owl"', 'Create an unnumbered volume in new series "Owl"',
        'Create an edition at publisher "P" covering 1 volume', 'Create an edition at publisher "q" covering 0 volumes', "Create a print, ISBN 978 release of the new edition",
        "Create a ?, soft release of edition #4", "Create a digital release of (missing)", "Create a publishers record",
    ]
    assert [(got[2, i]["record_title"], got[2, i]["base"], got[2, i]["base_comment"], got[2, i]["stale"]) for i in (0, 1, 2, 3, 7)] == [
        ("Cat", 6, None, False), ("Cat", 5, "five", True), ("Dog", 1, "one", True), ("(missing record)", 0, None, True), ("Cat", 0, None, True),
    ]
    assert [got[2, i]["summary"] for i in (4, 5, 6, 8)] == ['Merge series "Cat" into series "(missing record)"', 'Split out series "Dog"', 'Clear an override on series "(missing record)"', 'Lock series "Cat"']
    assert got[3, 0]["summary"] == 'Create an unnumbered volume in "s"' and len(got) == 21


def test_history(spark):
    records = spark.createDataFrame([(1, "active"), (2, "hidden"), (3, "active")], "id int, status string")
    revisions = spark.createDataFrame([(1, 1, 10, "new", None, None, "src", None, "u"), (1, 2, 20, "fix", 7, "editor", None, 8, None), (2, 1, 5, "x", 7, None, None, None, None)], "record_id int, seq int, at int, comment string, author_id int, author_role string, source_key string, approver_id int, citation string")
    changes = spark.createDataFrame([(1, 2, 1, "b", "1", "2"), (1, 2, 0, "c", None, "3")], "record_id int, seq int, place int, field string, before string, after string")
    users = spark.createDataFrame([(8, "ann")], "id int, username string")
    got = {r["id"]: r["revisions"] for r in histories.histories(records, revisions, changes, users).collect()}
    assert sorted(got) == [1, 3] and got[3] == []
    fix, new = got[1]
    assert (fix["seq"], [c["field"] for c in fix["changes"]], fix["author"]["kind"], fix["author"]["username"], fix["author"]["role"], fix["approver"]) == (2, ["c", "b"], "user", None, "editor", "ann")
    assert (new["changes"], new["author"]["kind"], new["author"]["source_key"], new["citation"]) == ([], "source", "src", "u")


def test_form(spark):
    records = spark.createDataFrame([("series", 1, "hidden", None, None), ("publisher", 1, "active", True, ["name"])], "type string, id bigint, status string, locked boolean, overridden array<string>")
    shown = spark.createDataFrame([("series", 1, "active", "Cat", ("series", 1, "Cat")), ("publisher", 1, "active", "P", None)], "type string, id bigint, status string, title string, link struct<entity:string,id:bigint,title:string>")
    values = spark.createDataFrame([("series", 1, "title", "Cat")], "type string, id bigint, field string, value string")
    revisions = spark.createDataFrame([("series", 1, 3), ("series", 1, 4)], "type string, id bigint, seq int")
    got = {r["type"]: r for r in histories.edit_forms(records, shown, values, revisions).collect()}
    form = got["series"]
    assert (form["base"], form["locked"], form["overridden"], form["status"]) == (4, False, [], "hidden")
    assert [(f["field"], f["value"]) for f in form["fields"]] == [("title", "Cat"), ("altTitles", None), ("sourceStatus", None)]
    assert got["publisher"]["base"] is None and got["publisher"]["link"] is None and got["publisher"]["overridden"] == ["name"]
