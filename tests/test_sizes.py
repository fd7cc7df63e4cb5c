"""Cases of tables larger than the given ones: keys that no longer fit a fixed step, and groups that grow."""

import duckdb
import pytest
from pyspark.sql import functions as F

from catalogspark import registry

SHIFTED = {"part": ["p_partkey"], "supplier": ["s_suppkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"]}


def _copies(spark, sf_dir, path, columns, steps):
    """Two copies of each table in ``columns``, the second with its keys moved by ``steps`` (by the key's last name)."""
    for table, keys in columns.items():
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        moved = df.select(*[(F.col(c) + steps[c.split("_")[1]]).alias(c) if c in keys else F.col(c) for c in df.columns])
        both = df.unionByName(moved)
        (both if table == "lineitem" else both.dropDuplicates(keys)).write.parquet(f"{path}/{table}.parquet")
    return str(path)


def _like_sql(spark, path, name):
    df = registry.queries()[name](spark, path)
    got = sorted(str(tuple(r)) for r in df.select(*sorted(df.columns)).collect())
    con = duckdb.connect()
    for t in SHIFTED:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    rel = con.sql(registry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    want = sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())
    ids = [r["id"] for r in df.select("id").collect()]
    return got, want, ids


@pytest.fixture(scope="module")
def many_series(spark, sf_dir, tmp_path_factory):
    """(release, series + 100,000) and (release + 1, series) had one id."""
    return _copies(spark, sf_dir, tmp_path_factory.mktemp("series"), SHIFTED, {"partkey": 100_000, "suppkey": 0, "orderkey": -1})


@pytest.mark.parametrize("name", ["merge_repoint", "split_undo"])
def test_merges_of_many_series(spark, many_series, name):
    got, want, ids = _like_sql(spark, many_series, name)
    assert got == want and len(ids) == len(set(ids)) > 0


@pytest.fixture(scope="module")
def many_releases(spark, sf_dir, tmp_path_factory):
    """(bundle, release + 1,000,000) and (bundle + 1, release) had one id."""
    return _copies(spark, sf_dir, tmp_path_factory.mktemp("releases"), SHIFTED, {"partkey": 0, "suppkey": -1, "orderkey": 1_000_000})


@pytest.mark.parametrize("name", ["merge_members", "merge_split_back", "merge_bundle_order"])
def test_merges_of_many_releases(spark, many_releases, name):
    got, want, ids = _like_sql(spark, many_releases, name)
    assert got == want and (name == "merge_split_back" or len(ids) == len(set(ids)) > 0)


def test_queue_holds_every_submitted_proposal(spark, sf_dir):
    """What was submitted is in review, whatever the order's customer: half of the orders, of those that hold a series."""
    got = registry.queries()["review_queue_open"](spark, sf_dir)
    o, line = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    series = line.where("l_partkey % 3 = 0").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber") % 3).alias("v"))
    want = o.where("o_custkey % 4 IN (0, 1)").withColumn("v", F.col("o_orderkey") % 3).join(series, ["o_orderkey", "v"], "left_semi")
    assert sorted(r[0] for r in got.select("proposal_id").collect()) == sorted(r[0] for r in want.select("o_orderkey").collect())


def test_owners_of_one_bundle_are_dealt_to_parts(spark):
    from catalogspark.operators import people, tracking

    owned = spark.createDataFrame([(u, 1, "owned") for u in range(300)] * 2 + [(7, 2, "owned"), (8, 2, "wanted")], "user_id bigint, bundle_id int, state string")
    members = spark.createDataFrame([(1, 10), (1, 11), (1, 11), (2, 10), (3, 12)], "bundle_id int, release_id bigint")
    want = sorted([(u, r, 1) for u in range(300) for r in (10, 11)] + [(7, 10, 2)])
    got = tracking.derived_ownership(owned.where("state = 'owned'"), members)
    assert sorted(map(tuple, got.collect())) == want
    held = got.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(held) > 4 and max(r["count"] for r in held) < len(want) / 3
    covered = spark.createDataFrame([(10, 1, "complete"), (10, 2, "partial"), (11, 1, "complete")], "release_id bigint, volume_id bigint, extent string")
    entries = spark.createDataFrame([(1, 10, "owned"), (1, 11, "wanted")], "user_id bigint, release_id bigint, state string")
    got = people.volume_ownership(entries, owned, members, covered).collect()
    every = [(u, v, r, b) for u, r, b in [*want, (1, 10, None)] for v in ((1, 2) if r == 10 else (1,))]
    assert sorted(map(str, ((r["user_id"], r["volume_id"], r["release_id"], r["bundle_id"]) for r in got))) == sorted(map(str, every))
