"""Reports and the source registry on small cases."""

from catalogspark.operators import registering, reports


def test_reports_one_after_another(spark):
    series = spark.createDataFrame([(1, "Cat", "active"), (2, "Dog", "hidden")], "id int, title string, status string")
    users = spark.createDataFrame([(7, "editor")], "id int, role string")
    long = "\U0001f600" * 1000
    rows = [(1, 7, 1, " a ", 0), (2, 7, 1, " \n", 0), (3, 7, 2, "b", 0), (4, 7, 1, long, 1), (5, 7, 1, long + "x", 1), (6, 7, 1, "c", 1), (7, 7, 1, None, 1), (8, 8, 1, "d", 1), (9, 7, 1, "e", 361)]
    got = reports.submit(spark.createDataFrame(rows, "id int, user_id int, series_id int, message string, at bigint"), series, users, 3600)
    told = {r["id"]: r["problem"] for r in got["told"].collect()}
    # three at once; what is refused otherwise takes no token, and an empty bucket is told first; one comes back in six minutes
    assert told == {1: None, 2: "emptyReport", 3: "notFound", 4: None, 5: "reportTooLong", 6: None, 7: "rateLimited", 8: "unknownUser", 9: None}
    made = {r["id"]: (r["comment"], r["url"]) for r in got["versions"].collect()}
    assert made[1] == ("[Report] Cat: a", "/series/1") and sorted(made) == [1, 4, 6, 9]
    assert {r["role"] for r in got["proposals"].collect()} == {"editor"}


_ROW = "key string, name string, enabled boolean, scope string, authority map<string,string>, cadence string, attribution string"


def test_registry(spark):
    old = spark.createDataFrame([("a", "A", True, "s", {"date": "weak"}, "daily", "thanks", "unhealthy", 5)], _ROW + ", health string, failures int")
    edit = lambda seq, key, name, role="administrator", level="standard", attribution=" ": (key, name, False, " x ", {"date": level}, " Weekly ", attribution, seq, role)
    edits = [edit(1, " A ", "one"), edit(2, "a", " two "), edit(3, "a", "no", role="moderator"), edit(4, "b-1", "B", attribution=" t "), edit(5, "1b", "no"), edit(6, "a", "no", level="strong"), edit(7, None, "no"), edit(8, "a", "no", role=None)]
    got = registering.upsert(old, spark.createDataFrame(edits, _ROW + ", seq int, role string"))
    rows = {r["key"]: r for r in got["registry"].collect()}
    a, b = rows["a"], rows["b-1"]
    assert sorted(rows) == ["a", "b-1"] and (a["name"], a["enabled"], a["scope"], a["cadence"], a["attribution"], a["health"], a["failures"]) == ("two", False, "x", "weekly", None, "unhealthy", 5)
    assert (b["attribution"], b["health"], b["failures"]) == ("t", "healthy", 0)
    assert {r["seq"]: r["problem"] for r in got["told"].collect()} == {1: None, 2: None, 3: "forbidden", 4: None, 5: "invalidKey", 6: "invalidAuthority", 7: "invalidKey", 8: "forbidden"}
    seeded = registering.seed(got["registry"], spark.createDataFrame([("a", "Z", True, "s", {}, "d", None), ("c", "C", True, "s", {}, "d", None)], _ROW))
    assert {r["key"]: r["name"] for r in seeded.collect()} == {"a": "two", "b-1": "B", "c": "C"}


def test_letters(spark):
    turns = spark.createDataFrame([("a", "unhealthy", 3, ["e1", "e2"]), ("z", "unhealthy", 4, None), ("b", "recovered", 3, None)], "key string, turn string, failures int, errors array<string>")
    registry = spark.createDataFrame([("a", "A"), ("b", "B")], "key string, name string")
    got = {r["key"]: r for r in registering.alerts(turns, registry, "Site", "https://x.example/runs", 1).collect()}
    assert got["a"]["subject"] == "[Site] Import source unhealthy: A"
    assert got["a"]["text"].split("\n")[:5] == ['The import source "A" (a) is unhealthy after 3 consecutive failed runs.', "", "Errors from the latest run:", "  - e1", ""]
    assert "Errors" not in got["z"]["text"] and '"z" (z)' in got["z"]["text"]
    assert got["b"]["text"] == 'The import source "B" (b) recovered — its latest run succeeded and it is healthy again.\nRun history: https://x.example/runs'
