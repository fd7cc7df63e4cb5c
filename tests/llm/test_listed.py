"""The listed host and path rules, word for word as their contract has them."""

from catalogspark.llm import op8_url


def test_words_of_the_listed_rules(spark):
    rows = [(1, "x://example.org/en/12"), (2, "x://a.example.org/en/1"), (3, "x://example.org/en/2"), (4, "x://example.org/es/"), (5, "x://www.com/fr/x"), (6, "x://www.com/de/x"), (7, "x://b.org/")]
    df = spark.createDataFrame(rows, "page_id bigint, url string")
    none = spark.createDataFrame([], "items array<array<string>>, index array<string>, confidence double")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in op8_url.judge(df, none, op8_url.LISTED).collect()}
    assert got == {1: ("example.org/en/1", "block"), 2: ("example.org/en/1", "block"), 3: ("org/", "allow"), 4: ("example.org/es/", "block"), 5: ("com/fr/", "allow"), 6: ("com/de/", "block"), 7: ("org/", "allow")}
