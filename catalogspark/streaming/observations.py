"""Observations kept up to date by a stream that can stop anywhere and go on.

The state of a key is its present snapshot; RocksDB holds it on the executors' disks and the checkpoint folder its changes, so that a batch costs
the groups of keys that it touches. Each batch writes what it changed to a folder of its number. A batch that runs again starts from the
same state and overwrites that folder, so that a replay changes nothing. Offsets, state and changes live under one folder that outlives a run.
"""

from __future__ import annotations

from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "source_key string, record_id string, kind string, version bigint, snapshot string, seen_at timestamp"
#: Keys of a group and their present snapshots, in one order.
_STATE = "source_key array<string>, record_id array<string>, snapshot array<string>, seen_us array<bigint>, version array<bigint>"
PARTS = 4096


@contextmanager
def _rocks(spark: SparkSession):
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def upserts(feed: DataFrame, parts: int = PARTS) -> DataFrame:
    """What each batch of ``feed (id, source_key, record_id, snapshot, seen_at)`` changes, rows of a key in order of ``id``.

    A key gives one row of its new state (kind new, changed or same) and one row of each snapshot that was superseded, with the time it
    was. An equal snapshot is only seen again. ``version`` counts the snapshots of a key from 1. Keys are dealt to ``parts`` groups by their hash, since a call of Python for each
    key costs more than its rows; a group's state holds its keys', and its rows of a batch are bounded by the trigger. ``parts`` must stay as it is while a checkpoint is in use.
    """

    def step(_, frames, state):
        held = {(s, r): (snapshot, seen, version) for s, r, snapshot, seen, version in zip(*state.get)} if state.exists else {}
        rows = pd.concat(list(frames)).sort_values("id")
        out, kinds = [], {}
        for source, record, snapshot, seen in zip(*(rows[c].astype(object).where(rows[c].notna(), None) for c in ("source_key", "record_id", "snapshot", "seen_us"))):
            key, seen = (source, record), None if seen is None else int(seen)
            old = held.get(key)
            if key not in kinds:
                kinds[key] = "same" if old else "new"
            if old is None:
                held[key] = (snapshot, seen, 1)
            elif old[0] == snapshot:
                held[key] = (snapshot, seen, old[2])
            else:
                out.append((*key, "superseded", old[2], old[0], seen))
                held[key] = (snapshot, seen, old[2] + 1)
                if kinds[key] == "same":
                    kinds[key] = "changed"
        out += [(*key, kind, held[key][2], held[key][0], held[key][1]) for key, kind in kinds.items()]
        state.update(tuple(map(list, zip(*((*key, *value) for key, value in held.items())))))
        yield pd.DataFrame(out, columns=["source_key", "record_id", "kind", "version", "snapshot", "seen_us"], dtype=object)

    rows = feed.select("id", "source_key", "record_id", "snapshot", F.unix_micros("seen_at").alias("seen_us"), F.pmod(F.xxhash64("source_key", "record_id"), F.lit(parts)).alias("part"))
    out = rows.groupBy("part").applyInPandasWithState(step, _OUT.replace("seen_at timestamp", "seen_us bigint"), _STATE, "append", "NoTimeout")
    return out.withColumn("seen_us", F.timestamp_micros("seen_us")).withColumnRenamed("seen_us", "seen_at")


def run(stream: DataFrame, folder: str) -> dict[str, int]:
    """Carries a stream on from where the last run under ``folder`` stopped, over all that has landed since; (batches, rows) of this run.

    Each batch's rows overwrite ``folder``/out/batch=<number>. Bounds of a trigger (``maxFilesPerTrigger``, ``maxBytesPerTrigger``) are the reader's options.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    with _rocks(stream.sparkSession):
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    steps = [p for p in query.recentProgress if p["numInputRows"]]
    return {"batches": len(steps), "rows": sum(p["numInputRows"] for p in steps)}


def written(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Rows of all batches, with the number of their ``batch``; none where no batch was written."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{folder}/out")
    if not path.getFileSystem(sc._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("bigint"))
    return spark.read.option("basePath", f"{folder}/out").schema(schema).parquet(f"{folder}/out/batch=*").withColumn("batch", F.regexp_extract(F.input_file_name(), r"/batch=(\d+)/", 1).cast("bigint"))


def state(changes: DataFrame) -> DataFrame:
    """(source_key, record_id, snapshot, last_seen, version): the latest state of each key in the changes of ``upserts``."""
    last = changes.where("kind <> 'superseded'").groupBy("source_key", "record_id").agg(F.max_by(F.struct("snapshot", F.col("seen_at").alias("last_seen"), "version"), "batch").alias("s"))
    return last.select("source_key", "record_id", "s.*")


def history(changes: DataFrame) -> DataFrame:
    """(source_key, record_id, version, snapshot, superseded_at) of every snapshot that isn't the present one."""
    return changes.where("kind = 'superseded'").select("source_key", "record_id", "version", "snapshot", F.col("seen_at").alias("superseded_at"))
