"""Conflict-constrained best-fit packing of documents into training sequences.

Texts are cut into pieces of ``capacity`` tokens (words by default); full pieces are sequences of
their own. The other pieces are packed by best fit, longest first: open bins are ordered by
what room they have left; the search starts at the tightest bin that is large enough and goes on to
the next larger ones until a bin has no conflict. A bin carries a bitmap of the sources and one of the
duplicate clusters in it, and a piece conflicts with a bin that has its cluster, or that has
``per_source`` pieces of its source already. A piece that fits no bin opens one.

Pieces are dealt to shards by a hash of their id, so that a hot source or cluster is spread over all
shards; a shard of about ``shard_tokens`` tokens is packed by one task. A shard's bins are its own, so
conflicts are looked for where pieces can meet.

Null and empty texts have no tokens and get no piece: one row with no bin. A null source conflicts
with nothing, and so does a null cluster. Repeated ids are rows of their own. Ties go to the smaller
id, then to the older bin. Extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

NAME = "op5_packing"
CAPACITY = 2048
PER_SOURCE = 2
SHARD_TOKENS = 2_000_000
_WORDS = r"[^\x20\x09-\x0D]+"


def best_fit(pieces: list[tuple], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, offset) for each ``(tokens, source, cluster)``, in the order given.

    The bitmaps number the sources and clusters of this call. A source's bitmaps, one for each piece that
    a bin may have of it, fill from the first to the last.
    """
    bit: dict = {}
    number = lambda kind, value: 0 if value is None else 1 << bit.setdefault((kind, value), len(bit))
    room: list[tuple[int, int]] = []  # (room left, bin), rising
    sources: list[list[int]] = []
    clusters: list[int] = []
    out = []
    for tokens, source, cluster in pieces:
        s, c = number(0, source), number(1, cluster)
        at = bisect_left(room, (tokens, -1))
        while at < len(room):
            b = room[at][1]
            if not (clusters[b] & c or sources[b][-1] & s):
                break
            at += 1
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(clusters)
            sources.append([0] * per_source)
            clusters.append(0)
        out.append((b, capacity - left))
        clusters[b] |= c
        for k in range(per_source):
            if not sources[b][k] & s:
                sources[b][k] |= s
                break
        if left > tokens:
            insort(room, (left - tokens, b))
    return out


def _packer(capacity: int, per_source: int, kind):
    def run(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        data = list(zip(*(rows.column(c).to_pylist() for c in ("tokens", "key", "piece", "source", "cluster"))))
        order = sorted(range(len(data)), key=lambda i: (-data[i][0], data[i][1] is None, data[i][1], data[i][2], data[i][3] or "", data[i][4] or 0))
        data = [data[i] for i in order]
        full = [x for x in data if x[0] >= capacity]
        rest = data[len(full) :]
        bins = [(i, 0) for i in range(len(full))] + [(b + len(full), o) for b, o in best_fit([(x[0], x[3], x[4]) for x in rest], capacity, per_source)]
        cols = list(zip(*data))
        base = shard << 32
        return pa.table({
            "key": pa.array(cols[1], kind), "piece": pa.array(cols[2], pa.int32()), "tokens": pa.array(cols[0], pa.int64()),
            "bin_id": pa.array([base + b for b, _ in bins], pa.int64()), "bin_offset": pa.array([o for _, o in bins], pa.int64()),
        })

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_tokens: int = SHARD_TOKENS, id_column: str = "doc_id", text_column: str = "text", source_column: str | None = "source", cluster=None) -> DataFrame:
    """(id_column, piece, tokens, bin_id, bin_offset): one row for each piece.

    ``cluster`` is a column of any 64-bit cluster ids; without one, texts with the same words in the same
    order and case-folded are a cluster.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = dict(docs.select(id_column).dtypes)[id_column]
    text = F.coalesce(F.col(text_column), F.lit(""))
    same = F.xxhash64(F.lower(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))))
    count = F.regexp_count(text, F.lit(_WORDS)).cast("bigint")
    rows = docs.select(
        F.col(id_column).alias("key"),
        (F.col(source_column).cast("string") if source_column else F.lit(None).cast("string")).alias("source"),
        (same if cluster is None else cluster).cast("bigint").alias("cluster"),
        count.alias("n"),
    )
    from .common import stored

    rows = stored(rows, "lengths")
    total = rows.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    cut = rows.where("n > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity).cast("int"))))
    cut = cut.select("key", "piece", "source", "cluster", F.least(F.lit(capacity).cast("bigint"), F.col("n") - F.col("piece").cast("bigint") * capacity).alias("tokens"))
    cut = cut.withColumn("shard", F.pmod(F.xxhash64("key", "piece", "cluster"), F.lit(shards)))
    packed = cut.groupBy("shard").applyInArrow(_packer(capacity, per_source, to_arrow_type(docs.schema[id_column].dataType)), f"key {kind}, piece int, tokens bigint, bin_id bigint, bin_offset bigint")
    none = rows.where("n = 0").select("key", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("tokens"), F.lit(None).cast("bigint").alias("bin_id"), F.lit(None).cast("bigint").alias("bin_offset"))
    return packed.unionByName(none).withColumnRenamed("key", id_column)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
