"""Limits of what a user may submit."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def token_bucket(events: DataFrame, rate: int, period: int, capacity: int, key: str = "user_id", at: str = "at", order: str = "id", takes: str | None = None) -> DataFrame:
    """(order, key, allowed, left): whether each event finds a token in its key's bucket, and the whole tokens left after it.

    A bucket begins full with ``capacity`` tokens and gets ``rate`` of them back in each ``period`` (in ``at``'s units); refused events take none, nor do those whose boolean ``takes`` isn't true.
    Credits are whole numbers, so nothing is rounded. Whether an event is allowed depends on all that were before it, so a key's events are read in order of
    (``at``, ``order``) by one task, which holds one batch of rows and one bucket at a time. Events without a time are refused and leave the bucket as it is; null is a key of its own.
    """
    cost, full = period, capacity * period
    kinds = dict(events.select(order, key).dtypes)
    rows = events.select(F.col(order).alias("o"), F.col(key).alias("k"), F.col(at).cast("bigint").alias("t"), (F.coalesce(takes, F.lit(False)) if takes else F.lit(True)).alias("takes"))
    rows = rows.repartition("k").sortWithinPartitions("k", "t", "o")

    def run(batches):
        started, owner, credit, last = False, None, 0, None
        for batch in batches:
            allowed, left = [], []
            for k, t, pays in zip(*(batch.column(c).to_pylist() for c in ("k", "t", "takes")), strict=True):
                if not started or k != owner:
                    started, owner, credit, last = True, k, full, None
                ok = False
                if t is not None:
                    if last is not None:
                        credit = min(full, credit + (t - last) * rate)
                    last = t
                    ok = credit >= cost
                    credit -= cost if ok and pays else 0
                allowed.append(ok)
                left.append(credit // cost)
            yield pa.RecordBatch.from_arrays([batch.column("o"), batch.column("k"), pa.array(allowed, pa.bool_()), pa.array(left, pa.int64())], ["o", "k", "allowed", "left"])

    out = rows.mapInArrow(run, f"o {kinds[order]}, k {kinds[key]}, allowed boolean, left bigint")
    return out.select(F.col("o").alias(order), F.col("k").alias(key), "allowed", "left")
