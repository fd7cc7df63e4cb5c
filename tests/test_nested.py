"""Pages of a small shelf with merged, hidden, missing and circular records."""

import pytest

from catalogspark.functions import titles
from catalogspark.operators import nested


@pytest.fixture(scope="module")
def shelf(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    return nested.Shelf(
        series=t([(1, "Cat", "active", None, 9), (2, "Dog", "merged", 1, 9), (3, "Fox", "hidden", None, 9), (4, "Owl", "merged", 5, None), (5, "Elk", "merged", 4, None), (6, "Ant", "active", None, 9)], "id int, title string, status string, merged_into int, family_id int"),
        volumes=t([(10, 1, 2, "2", "active", None), (11, 1, 1, None, "active", None), (12, 1, 3, "3", "hidden", None), (13, 3, 1, "1", "active", None), (14, 2, 1, "x", "merged", 11)], "id int, series_id int, position int, label string, status string, merged_into int"),
        editions=t([(20, 1, None, None, "active", None), (21, 2, 5, "4", "active", None), (22, 1, None, None, "hidden", None), (23, 1, None, None, "merged", 20)], "id int, publisher_id int, line_id int, line_position string, status string, merged_into int"),
        lines=t([(5, "Deluxe", "active")], "id int, name string, status string"),
        releases=t(
            [(30, 20, "print", "978", None, None, 5, "c30", "active", None), (31, 20, "digital", None, "10x", 20200101, None, None, "active", None), (32, 20, "print", None, None, 20200101, 1, "c32", "active", None), (33, 20, "print", None, None, 1, 1, None, "hidden", None), (34, 22, "print", None, None, 1, 1, None, "active", None), (35, 23, "print", None, None, 7, 1, None, "active", None), (36, 20, "print", None, None, 7, 1, None, "merged", 35)],
            "id int, edition_id int, format string, isbn13 string, isbn10 string, sort int, price_cents int, cover string, status string, merged_into int",
        ),
        variants=t([(41, 31, "red", "active"), (40, 31, "blue", "active"), (42, 31, "old", "hidden")], "id int, release_id int, name string, status string"),
        publishers=t([(1, "P", "p", "active"), (2, "Q", "q", "hidden")], "id int, name string, slug string, status string"),
        bundles=t([(50, "Box", "active"), (51, "None", "active"), (52, "Gone", "hidden")], "id int, name string, status string"),
        coverage=t([(20, 10, 2, "partial"), (20, 11, 1, "complete"), (20, 12, 3, "complete"), (20, 13, 4, "complete"), (21, 10, 1, "complete"), (22, 10, 1, "complete")], "edition_id int, volume_id int, place int, extent string"),
        members=t([(50, 36, 1, 42), (50, 31, 2, 40), (50, 34, 3, None), (50, 99, 4, None), (52, 31, 1, None)], "bundle_id int, release_id int, position int, variant_id int"),
        families=t([(9, "Pets", "active")], "id int, name string, status string"),
        relations=t([(1, "sequel", "n", 6, 1), (2, "spinoff", None, 1, 6), (3, "sequel", None, 1, 3)], "id int, kind string, note string, from_id int, to_id int"),
    )


def test_edition_page(shelf):
    rows = {r["requested_id"]: r for r in nested.requested(nested.edition_pages(shelf), shelf.editions).collect()}
    assert sorted(rows) == [20, 21, 23] and rows[23]["id"] == 20
    page = rows[20]
    # the covered volume of a hidden series and the hidden volume are absent; order is the coverage's own
    assert [(c["volume_id"], c["title"]) for c in page["coverage"]] == [(11, "Cat"), (10, "Cat Vol 2")]
    assert page["title"] == "Cat Vol 1–2" and [s["id"] for s in page["series"]] == [1]
    assert [(r["id"], r["anchor"]) for r in page["releases"]] == [(31, "10x"), (32, "32"), (30, "978")] and page["cover"] == "c32"
    assert [v["name"] for v in page["releases"][0]["variants"]] == ["blue", "red"] and [b["id"] for b in page["releases"][0]["bundles"]] == [50]
    assert rows[21]["title"] == "Cat Deluxe 4" and rows[21]["publisher"] is None and rows[21]["releases"] == [] and rows[21]["cover"] is None


def test_volume_page(shelf):
    rows = {r["requested_id"]: r for r in nested.requested(nested.volume_pages(shelf), shelf.volumes).collect()}
    assert sorted(rows) == [10, 11, 14] and rows[14]["title"] == "Cat"
    assert [(e["id"], e["extent"]) for e in rows[10]["editions"]] == [(20, "partial"), (21, "complete")] and rows[10]["cover"] == "c32"


def test_series_page(shelf):
    rows = {r["requested_id"]: r for r in nested.requested(nested.series_pages(shelf), shelf.series).collect()}
    assert sorted(rows) == [1, 2, 6]
    page = rows[2]
    assert page["title"] == "Cat" and [v["id"] for v in page["volumes"]] == [11, 10] and page["cover"] == "c30"
    two = page["volumes"][1]["editions"]
    # a series' page shows a hidden publisher's name, and volumes of any series
    assert [e["publisher"]["name"] for e in two] == ["P", "Q"] and [c["volume_id"] for c in two[0]["coverage"]] == [11, 10, 13]
    assert [m["id"] for m in page["family"]["members"]] == [1, 6]
    assert [(x["kind"], x["from"]["id"]) for x in page["family"]["relations"]] == [("spinoff", 1), ("sequel", 6)]
    assert rows[6]["volumes"] == [] and rows[6]["cover"] is None and len(rows[6]["family"]["relations"]) == 2


def test_wide_rows_are_shuffled_once(shelf):
    for pages, records in ((nested.series_pages(shelf), shelf.series), (nested.volume_pages(shelf), shelf.volumes)):
        lines = nested.requested(pages, records)._jdf.queryExecution().executedPlan().toString().splitlines()
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        deal = next(i for i, line in enumerate(lines) if "REPARTITION_BY_COL" in line)
        above, least = [], depth(lines[deal])
        for line in reversed(lines[:deal]):
            if depth(line) < least:
                above, least = [*above, line], depth(line)
        assert above and not [line for line in above if "Exchange" in line or "Sort " in line]


def test_bundle_page(shelf):
    rows = {r["id"]: r for r in nested.bundle_pages(shelf).collect()}
    assert sorted(rows) == [50, 51] and rows[51]["members"] == []
    # the merged release leads to 35, whose edition was merged into 20; its pinned variant is hidden
    assert [(m["position"], m["edition"]["id"], m["anchor"], m["variant"] and m["variant"]["name"]) for m in rows[50]["members"]] == [(1, 20, "35", None), (2, 20, "10x", "blue")]


def test_edition_titles(spark):
    rows = [("A", None, None, []), ("A", None, None, [(None, 1)]), ("A", None, None, [("7", 1)]), ("A", None, None, [(None, 1), ("b", 2), (None, 3)]), ("A", "Max", None, [("7", 1)]), (None, "Max", "2", None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "s string, l string, p string, c array<struct<label:string,position:int>>")
    got = [r[0] for r in df.select(titles.edition_title("s", "l", "p", "c")).collect()]
    assert got == ["A", "A", "A Vol 7", "A Vol 1–3", "A Max", "Edition Max 2", "Edition"]
