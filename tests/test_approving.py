"""Approval: all ops of a proposal or none, first of several on a record, references by level."""

from catalogspark.operators import approving

OP = "proposal_id bigint, place int, kind string, table string, temp_id string, refs array<string>, extents array<string>, publisher string, fields map<string,string>, record_id bigint, base int"


def _create(p, place, table, temp, refs=(), publisher=None, extents=None, **fields):
    return (p, place, "create", table, temp, list(refs), extents if extents is not None else ["complete"] * len(refs), publisher, fields, None, None)


def _update(p, place, table, record, base, **fields):
    return (p, place, "update", table, None, None, None, None, fields, record, base)


def _run(spark, ops, states=None):
    ids = sorted({o[0] for o in ops})
    proposals = spark.createDataFrame([(i, i, (states or {}).get(i, "inReview")) for i in ids], "proposal_id bigint, rank bigint, state string")
    records = spark.createDataFrame([("series", 1, "active", False), ("series", 2, "hidden", False), ("series", 3, "active", True), ("volumes", 10, "active", False), ("editions", 20, "active", None), ("releases", 30, "active", None)], "table string, id bigint, status string, locked boolean")
    revisions = spark.createDataFrame([("series", 1, 4), ("series", 1, 5), ("series", 3, 1)], "table string, record_id bigint, seq int")
    publishers = spark.createDataFrame([(7, "viz", "active"), (8, "old", "hidden")], "id bigint, slug string, status string")
    volumes = spark.createDataFrame([(10, 1, 3)], "id bigint, series_id bigint, position int")
    of = spark.createDataFrame([(20, 1, 7)], "edition_id bigint, series_id bigint, publisher_id bigint")
    out = approving.approve(proposals, spark.createDataFrame(ops, OP), records, revisions, publishers, volumes, of, {"series": 100, "volumes": 200, "editions": 300, "releases": 400})
    return {k: v.collect() for k, v in out.items()}


def test_levels_and_positions(spark):
    got = _run(spark, [
        _create(1, 0, "series", "s", title="New"), _create(1, 1, "volumes", "a", ["s"], label="1"), _create(1, 2, "volumes", "b", ["s"], label="2"), _create(1, 3, "volumes", "c", ["1"], label="4"),
        _create(1, 4, "editions", "e", ["b", "a", "10"], "viz", ["complete", "partial", "complete"]), _create(1, 5, "releases", "r", ["e"], format="physical", language="en", isbn13="978-1-23456-789-0"),
        _create(2, 0, "volumes", "a", ["1"]), _create(2, 1, "releases", "r", ["20"], format="digital", language="en"), _update(2, 2, "series", 1, 5, title=" Renamed "),
    ])
    assert {r["proposal_id"]: r["outcome"] for r in got["outcomes"]} == {1: "approved", 2: "approved"}
    assert [(r["id"], r["fields"]["title"]) for r in got["series"]] == [(101, "New")]
    assert sorted((r["id"], r["series_id"], r["position"]) for r in got["volumes"]) == [(201, 101, 1), (202, 101, 2), (203, 1, 4), (204, 1, 5)]
    assert sorted((r["edition_id"], r["position"], r["volume_id"], r["extent"]) for r in got["coverage"]) == [(301, 1, 202, "complete"), (301, 2, 201, "partial"), (301, 3, 10, "complete")]
    assert sorted((r["id"], r["edition_id"], r["series_ids"], r["publisher_id"]) for r in got["releases"]) == [(401, 301, [1, 101], 7), (402, 20, [1], 7)]
    assert [(r["table"], r["record_id"], r["field"], r["value"]) for r in got["patches"]] == [("series", 1, "title", "Renamed")]
    assert sorted((r["proposal_id"], r["table"], r["record_id"], r["fields"], r["seq"]) for r in got["revisions"]) == [
        (1, "editions", 301, "", 1), (1, "releases", 401, "format,isbn13,language", 1), (1, "series", 101, "title", 1), (1, "volumes", 201, "label", 1), (1, "volumes", 202, "label", 1), (1, "volumes", 203, "label", 1),
        (2, "releases", 402, "format,language", 1), (2, "series", 1, "title", 6), (2, "volumes", 204, "", 1),
    ]


def test_one_bad_op_leaves_no_row(spark):
    good = lambda p: _create(p, 0, "series", "s", title="New")
    bad = {
        1: _create(1, 1, "volumes", "v", ["later"]), 2: _create(2, 1, "volumes", "v", ["2"]), 3: _create(3, 1, "editions", "e", ["s"], "viz"), 4: _create(4, 1, "editions", "e", ["10"], "old"), 5: _create(5, 1, "series", "s", title="Twice"),
        6: _create(6, 1, "releases", "r", ["20"], format="paper", language="en"), 7: _create(7, 1, "releases", "r", ["20"], format="digital", language="en", binding="paperback"), 8: _create(8, 1, "series", "t", title=" "),
        9: _create(9, 1, "releases", "r", ["20"], format="digital", language="en", isbn13="12"), 10: _create(10, 1, "users", "u"), 11: _create(11, 1, "editions", "e", [], "viz"), 12: _create(12, 1, "editions", "e", ["10"], "viz", ["most"]),
        13: (13, 1, "clearOverride", "series", None, None, None, None, None, 1, None), 14: _update(14, 1, "series", 1, 5, colour="red"),
    }
    got = _run(spark, [good(p) for p in bad] + list(bad.values()) + [_create(1, 2, "series", "later", title="Late"), good(15)])
    assert {r["proposal_id"]: r["outcome"] for r in got["outcomes"]} == {**dict.fromkeys(bad, "invalid"), 15: "approved"}
    assert [(r["proposal_id"], r["id"]) for r in got["series"]] == [(15, 101)]
    assert not got["volumes"] and not got["editions"] and not got["releases"] and not got["patches"] and len(got["revisions"]) == 1


def test_stale_and_first_of_several(spark):
    got = _run(spark, [
        _update(1, 0, "series", 1, 4, title="Old base"), _update(2, 0, "series", 3, 1, title="Locked"), _update(3, 0, "series", 1, 5, title="First"), _update(4, 0, "series", 1, 5, title="Second"), _create(4, 1, "series", "s", title="Lost"),
        _update(5, 0, "releases", 30, None, language="de"), _update(6, 0, "releases", 99, None, language="de"), _update(7, 0, "series", 1, 5, title="Third"), _update(7, 1, "editions", 20, None, linePosition="1"), _update(8, 0, "editions", 20, None, linePosition="2"),
    ], {5: "draft"})
    assert {r["proposal_id"]: r["outcome"] for r in got["outcomes"]} == {1: "stale", 2: "stale", 3: "approved", 4: "stale", 5: "badState", 6: "stale", 7: "stale", 8: "approved"}
    assert sorted((r["table"], r["record_id"], r["value"]) for r in got["patches"]) == [("editions", 20, "2"), ("series", 1, "First")] and not got["series"]


def test_references_are_not_sent_to_every_task(spark):
    from catalogspark.operators import tables

    ops = spark.createDataFrame([(1, 0, "create", "series", "s", []), (1, 1, "create", "volumes", "v", ["s"])], "proposal_id long, place int, kind string, table string, temp_id string, refs array<string>")
    records = spark.createDataFrame([("series", 7, "active")], "table string, id long, status string")
    # stored tables have a known, small size
    rows = approving.references(tables.stored(ops, "ops"), tables.stored(records, "records"))
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [(r["place"], r["temp"], r["good"]) for r in rows.collect()] == [(1, "s", True)]


def test_made_records_are_no_stored_ones_of_their_ids(spark):
    """Of series 101, volume 201 and edition 301 there is a stored record and one that the batch makes."""
    ops = [_create(1, 0, "series", "s", title="New"), _create(1, 1, "volumes", "v", ["s"]), _create(1, 2, "editions", "e", ["v"], "viz"), _create(1, 3, "releases", "r", ["e"], format="physical", language="en"), _create(2, 0, "volumes", "w", ["1"])]
    proposals = spark.createDataFrame([(1, 1, "inReview"), (2, 2, "inReview")], "proposal_id bigint, rank bigint, state string")
    records = spark.createDataFrame([("series", 1, "active", False)], "table string, id bigint, status string, locked boolean")
    volumes = spark.createDataFrame([(10, 1, 3), (11, 101, 6), (201, 1, 2)], "id bigint, series_id bigint, position int")
    of = spark.createDataFrame([(301, 1, 7)], "edition_id bigint, series_id bigint, publisher_id bigint")
    publishers = spark.createDataFrame([(7, "viz", "active")], "id bigint, slug string, status string")
    none = spark.createDataFrame([], "table string, record_id bigint, seq int")
    got = approving.approve(proposals, spark.createDataFrame(ops, OP), records, none, publishers, volumes, of, {"series": 100, "volumes": 200, "editions": 300, "releases": 400})
    assert sorted((r["id"], r["series_id"], r["position"]) for r in got["volumes"].collect()) == [(201, 101, 1), (202, 1, 4)]
    assert [(r["id"], r["edition_id"], r["series_ids"]) for r in got["releases"].collect()] == [(401, 301, [101])]
    assert got["coverage"].columns == ["edition_id", "volume_id", "position", "extent"]
