"""Structured Streaming over event folders: windows, sessions, deduplication, upserts and failure streaks."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.operators.tables import shared_folder


def read(spark: SparkSession, path: str) -> DataFrame:
    """Events as a stream of files; ``ts`` becomes a timestamp with a zone, as watermarks need."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return s.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def alerts(events: DataFrame, limit: int = 3) -> DataFrame:
    """(user_id, event_id, streak, alert) for each failure: length of the streak so far, and whether it has just reached ``limit``.

    A source's rows must come in order within a batch's arrival; the state is one number a source.
    """

    def step(key, frames, state):
        streak = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for i, bad in zip(rows["event_id"], rows["event_type"] == "error"):
            streak = streak + 1 if bad else 0
            if bad:
                out.append((key[0], i, streak, streak == limit))
        state.update((streak,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "streak", "alert"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, event_id bigint, streak int, alert boolean", "streak int", "append", "NoTimeout")


def drain(stream: DataFrame, name: str, mode: str = "append", bounded: bool = False) -> DataFrame:
    """Runs a stream over what is there and returns its rows, which executors write to the shared folder.

    In complete mode each batch writes the whole result, and the last one's is read. A ``bounded`` result, whose rows
    don't grow with users or events, goes to the driver's memory.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    out = stream.writeStream.option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True)
    if bounded:
        table = f"{name}_{uuid.uuid4().hex}"
        out.format("memory").queryName(table).start().awaitTermination()
        return spark.table(table)
    if mode == "append":
        out.format("parquet").option("path", f"{base}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    written = []

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/out-{batch}")
        written.append(f"{base}/out-{batch}")

    out.foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(written[-1]) if written else spark.createDataFrame([], stream.schema)
