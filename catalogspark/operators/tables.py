"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only a session on one machine may go without and then uses a folder of that machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not shared and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (shared or "/tmp/checkpoints/catalogspark").rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again, so that its values (a partition's number, a random draw) are fixed and its lineage is cut."""
    path = f"{shared_folder(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def or_alone(key, row: str) -> Column:
    """``key`` as text, or one of the row's own that equals none: rows without a key are dealt to all tasks of a join instead of one."""
    return F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.concat(F.lit("\x00"), F.col(row).cast("string")))
