"""Streams that stop and go on: half runs, crashes between a batch's write and its commit, replays."""

import pytest
from pyspark.sql import functions as F

from catalogspark.operators import reconcile
from catalogspark.streaming import observations

SCHEMA = "id bigint, source_key string, record_id string, snapshot string, seen_at timestamp"


def _rows(lo, hi):
    return [(i, f"s{i % 2}", None if i % 7 == 3 else str(i % 5), None if i % 11 == 4 else f"v{i // 20 % 3}", f"2026-01-01 00:{i // 60:02d}:{i % 60:02d}") for i in range(lo, hi)]


def _land(spark, folder, part, rows):
    frame = spark.createDataFrame(rows, SCHEMA.replace("timestamp", "string")).withColumn("seen_at", F.col("seen_at").cast("timestamp"))
    frame.coalesce(1).write.parquet(f"{folder}/landed/part={part}")


def _stream(spark, folder):
    feed = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/landed/part=*").select("id", "source_key", "record_id", "snapshot", "seen_at")
    return observations.upserts(feed)


def _result(spark, folder):
    changes = observations.written(spark, folder, observations._OUT)
    order = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    return order(observations.state(changes)), order(observations.history(changes))


def _expected(spark, rows):
    v = reconcile.versions(spark.createDataFrame(rows, SCHEMA.replace("timestamp", "string"))).collect()
    last = {}
    for r in v:
        last[(r["source_key"], r["record_id"])] = max(last.get((r["source_key"], r["record_id"]), 0), r["version"])
    return sorted(((k[0], k[1], n) for k, n in last.items()), key=str), len(v) - len(last)


@pytest.fixture
def whole(spark, tmp_path):
    folder = str(tmp_path / "whole")
    _land(spark, folder, 0, _rows(0, 300))
    observations.run(_stream(spark, folder), folder)
    return _result(spark, folder)


def test_two_half_runs_are_one(spark, tmp_path, whole):
    folder, reads = str(tmp_path / "halves"), []
    for k in range(3):
        _land(spark, folder, k, _rows(100 * k, 100 * k + 100))
        reads.append(observations.run(_stream(spark, folder), folder))
    assert reads == [{"batches": 1, "rows": 100}] * 3  # nothing is read twice
    assert _result(spark, folder) == whole
    assert observations.run(_stream(spark, folder), folder) == {"batches": 0, "rows": 0}
    keys, superseded = _expected(spark, _rows(0, 300))
    assert sorted(((r[0], r[1], r[4]) for r in whole[0]), key=str) == keys and len(whole[1]) == superseded


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path, whole):
    folder = str(tmp_path / "crash")
    _land(spark, folder, 0, _rows(0, 150))
    observations.run(_stream(spark, folder), folder)
    _land(spark, folder, 1, _rows(150, 300))

    def crash(rows, batch):
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")
        raise RuntimeError("lost before the commit")

    with observations._rocks(spark), pytest.raises(Exception, match="lost before the commit"):
        _stream(spark, folder).writeStream.foreachBatch(crash).option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert _result(spark, folder) == whole  # written, not committed
    assert observations.run(_stream(spark, folder), folder) == {"batches": 1, "rows": 150}
    assert _result(spark, folder) == whole


def test_nothing_landed(spark, tmp_path):
    folder = str(tmp_path / "none")
    _land(spark, folder, 0, [])
    observations.run(_stream(spark, folder), folder)
    assert _result(spark, folder) == ([], [])
