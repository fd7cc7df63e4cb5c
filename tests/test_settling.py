"""Offers to the end and sweeps: what comes again adds nothing, decisions stay."""

from pyspark.sql import functions as F

from catalogspark.operators import settling, sweeping

OFFER = "observation_id int, record_id int, field string, source_key string, value_hash string, current string, offered string, overridden boolean, rank int, incumbent string, incumbent_source string, incumbent_rank int, source string, dates_agree boolean, finer int"


def _offer(record, field, current, offered, rank=1, incumbent="source", by="b", of=1, overridden=False):
    return (record + 100, record, field, "a", f"h-{offered}", current, offered, overridden, rank, incumbent, by, of, "a", None, None)


def _settle(spark, offers, proposals=(), suppressions=(), revisions=(), conflicts=()):
    f = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    out = settling.settle(
        f(offers, OFFER), f(proposals, "proposal_id int, observation_id int, state string, record_id int, base int, ops int, changes map<string,string>"), f(suppressions, "record_id int, field string, source_key string, value_hash string"),
        f(revisions, "record_id int, seq int"), f(conflicts, "observation_id int, field string, offered string"),
    )
    return {k: sorted(map(tuple, v.collect()), key=str) for k, v in out.items()}


def test_change_sets(spark):
    offers = [
        _offer(1, "title", None, "T", incumbent="none"), _offer(1, "price", "1", "2", incumbent="human"), _offer(1, "isbn", "3", "4", overridden=True), _offer(2, "price", "1", "2", rank=0), _offer(3, "price", "1", "2", incumbent="human"),
        _offer(4, "price", "2", "2"), _offer(5, "price", "1", "9", incumbent="human"),
    ]
    open_ = [(900, 101, "inReview", 1, 7, 1, {"price": "2", "isbn": "4"}), (901, 103, "inReview", 3, None, 1, {"price": "2"}), (902, 105, "rejected", 5, None, 1, {"price": "9"})]
    got = _settle(spark, offers, open_, [(5, "price", "a", "h-9")], [(1, 6), (1, 7)], [(102, "price", "old"), (102, "x", "kept")])
    assert got["patches"] == [(1, "title", "T")] and got["revisions"] == [(1, 101, 8, {"title": "T"})]
    assert got["queued"] == [(101, 1, 8, {"price": "2", "isbn": "4"}, 900)] and got["withdrawn"] == [(900,)]  # the base has moved
    assert got["conflicts"] == [(102, "price", "2"), (102, "x", "kept")]
    assert got["results"] == [(101, 1, "title", "isbn,price", "", "", True), (102, 2, "", "", "", "price", False), (103, 3, "", "price", "", "", False), (104, 4, "", "", "", "", False), (105, 5, "", "", "price", "", False)]
    # the same offers again, on what that left
    again = [_offer(1, "title", "T", "T"), *offers[1:]]
    got = _settle(spark, again, [(903, 101, "inReview", 1, 8, 1, {"isbn": "4", "price": "2"}), *open_[1:]], [(5, "price", "a", "h-9")], [(1, 6), (1, 7), (1, 8)], [(102, "price", "2"), (102, "x", "kept")])
    assert not got["patches"] and not got["revisions"] and not got["queued"] and not got["withdrawn"] and not any(r[-1] for r in got["results"]) and got["conflicts"] == [(102, "price", "2"), (102, "x", "kept")]


def test_sweeps(spark):
    rows = [(1, "Tom Red", None), (2, "tom red", None), (3, "Red Tom", "x"), (4, "Ann", None)]
    frame = lambda rs: spark.createDataFrame(rs, "id bigint, title string, alt_title string")
    keys, pairs = spark.createDataFrame([], "id bigint, rank int, key string"), spark.createDataFrame([], "a bigint, b bigint, reason string, state string")
    first = sweeping.sweep(frame(rows), keys, pairs)
    assert sorted(map(tuple, first["pairs"].collect())) == [(1, 2, "title", "open"), (1, 3, "tokens", "open"), (2, 3, "tokens", "open")]
    decided = first["pairs"].withColumn("state", F.when(F.col("b") == 3, "distinct").otherwise("open"))
    again = sweeping.sweep(frame(rows), first["keys"], decided)
    assert again["found"].collect() == [] and sweeping.changed_keys(frame(rows), first["keys"])[1].collect() == []
    later = frame([*rows[:3], (4, "Ann", "The Tom Red Manga"), (5, "ann", None)])
    assert sorted(r["id"] for r in sweeping.changed_keys(later, first["keys"])[1].collect()) == [4, 5]
    third = sweeping.sweep(later, first["keys"], decided)
    assert sorted(map(tuple, third["found"].collect())) == [(1, 4, "tokens"), (2, 4, "tokens"), (3, 4, "tokens"), (4, 5, "title")]
    assert sorted(map(tuple, third["pairs"].where("state = 'distinct'").collect())) == [(1, 3, "tokens", "distinct"), (2, 3, "tokens", "distinct")]


def test_pairs_leave_the_join_as_they_are(spark):
    """What is shuffled grows with the records, not with the pairs: 300 of one title are 44,850 pairs, flagged once each and never met by the registry."""
    from catalogspark.operators import matching

    frame = lambda ids: spark.createDataFrame([(i, "The Cat", "Cat (x)" if i % 2 else "Dog Bird") for i in ids], "id bigint, title string, alt_title string")
    pairs = matching.duplicate_pairs(frame(range(300)))
    rows = [tuple(r) for r in pairs.collect()]
    assert len(rows) == len(set(rows)) == 300 * 299 // 2 and {r[2] for r in rows} == {"title"}
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("Join Inner", 1)[0] and "Aggregate" not in plan.split("Join Inner", 1)[0]
    none = spark.createDataFrame([], "id bigint, rank int, key string"), spark.createDataFrame([], "a bigint, b bigint, reason string, state string")
    first = sweeping.sweep(frame(range(1, 300)), *none)
    decided = first["pairs"].withColumn("state", F.lit("distinct"))
    second = sweeping.sweep(frame(range(300)), first["keys"], decided)
    assert sorted((r["a"], r["b"]) for r in second["found"].collect()) == [(0, i) for i in range(1, 300)]
    assert second["pairs"].count() == second["pairs"].distinct().count() == 300 * 299 // 2
    # a record that comes back under its old title was flagged with all of them
    moved = frame(range(1, 300)).where("id <> 7").unionByName(spark.createDataFrame([(7, "Elk", "Elk")], "id bigint, title string, alt_title string"))
    third = sweeping.sweep(moved, first["keys"], decided)
    back = sweeping.sweep(frame(range(300)), third["keys"], decided)
    assert sorted((r["a"], r["b"]) for r in back["found"].collect()) == [(0, i) for i in range(1, 300)]
