import random

import pytest

WORDS = "the of and to in is it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice(["a", "b", "er", "ing"]) if r.random() < 0.6 else "") for _ in range(n))


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, key string, bucket int, node string, n bigint"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and extra columns with clashing names."""
    base = prose(1, 200)
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, "one two", "en", "a"), (5, "ONE two", "en", "b"),
        (6, base, "en", "a"), (6, base, "en", "a"), (7, base + " tail", "en", None), (8, prose(2, 150), None, "c"), (None, prose(3, 80), "de", "c"),
        (9, prose(4, 200_000), "en", "a"), (10, "x" * 300_000, "en", "a"), (11, "ab " * 60_000, "en", "b"), (12, "\u00e9\u00e8 \U0001f600 caf\u00e9 \u4e2d\u6587", "fr", "a"),
    ]
    return spark.createDataFrame([(*r, None, None, "k", 1, "x", 2) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (6, 1, 0), (6, 0, None), (8, None, 1), (None, 1, 1), (9, 1, 0)], "doc_id bigint, quality int, toxic int")
