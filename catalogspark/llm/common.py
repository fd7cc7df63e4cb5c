"""Vectorised text helpers that run inside Arrow batches, and shared-folder tables.

Everything here works on the UTF-8 bytes of whole texts. Batches are cut into groups of
about ``GROUP_BYTES`` of text so that a task's memory does not follow the batch size; a
longer single text is cut between words.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP_BYTES = 2 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_PLACE = _U(0xD1342543DE82EF95)
#: mask of the first 0 to 8 bytes of a little-endian word
_LEFT = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)

#: word = maximal run without \x20, \x09-\x0D
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: letter run: ASCII letters and all bytes of non-ASCII characters
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x):
    """splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray, limit: int = GROUP_BYTES):
    """Runs [a, b) of rows with about ``limit`` bytes together, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def fold_latin(data: np.ndarray) -> np.ndarray:
    """Lower-cases ASCII and the two-byte letters of Latin-1."""
    out = LOWER[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    at = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
    out[at] += 0x20
    return out


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    """(starts, ends, row) of maximal runs of bytes marked by ``inside``; a row's end ends a run."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    on = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = on.copy()
    first[1:] &= ~on[:-1] | edge[1:n]
    last = on.copy()
    last[:-1] &= ~on[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes: its words of eight bytes are mixed with their place before they are added up."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    pieces = np.maximum((size + 7) // 8, 1)
    first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    of = np.repeat(np.arange(len(starts)), pieces)
    place = np.arange(len(of)) - first[of]
    at = starts[of] + 8 * place
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))[at]
    left = np.minimum(size[of] - 8 * place, 8)
    eight &= _LEFT[left]
    total = np.add.reduceat(mix(eight + mix(place.astype(np.uint64) + _PLACE)), first)
    return mix(total + size.astype(np.uint64) * _BASE)


def word_hashes(data, offsets, inside, fold):
    """(hash, row) of each word, in order; rows over ``GROUP_BYTES`` are cut between words."""
    hashes, rows = [], []
    for a, b in groups(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        while lo < hi:
            to = hi
            if b == a + 1 and hi - lo > GROUP_BYTES:
                to = lo + GROUP_BYTES
                while to < hi:
                    stop = np.flatnonzero(~inside[data[lo:to]])
                    if len(stop) and stop[-1]:
                        to = lo + int(stop[-1])
                        break
                    to = min(hi, to + 4 * GROUP_BYTES)
            part = fold(data[lo:to])
            local = np.clip(offsets[a : b + 1] - lo, 0, to - lo)
            s, e, r = spans(part, local, inside)
            hashes.append(span_hashes(part, s, e))
            rows.append(r + a)
            lo = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(rows)


def ascii_lower(data):
    return LOWER[data]


def _checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. Only a session on one machine may go without: there it is a folder of that machine."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not shared:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir("/tmp/checkpoints/catalogspark")
        shared = sc.getCheckpointDir()
    return shared


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of runs of equal neighbours."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return starts, np.diff(np.append(starts, len(values)))


def by_bucket(keys: np.ndarray, n: int):
    """(order, bucket, starts, lengths): a stable order of the keys by bucket, with the runs of each bucket met."""
    bucket = ((keys >> _U(33)) % _U(n)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    starts, lengths = runs(bucket)
    return order, bucket, starts, lengths


#: Bits of a filter of hashes; its size does not follow the data. False hits only add rows to a join.
FILTER_BITS = 1 << 23


def hash_filter(hashes: DataFrame) -> np.ndarray:
    """Bit array of ``FILTER_BITS`` for a table with one bigint column of hashes: 256 rows of 4 KB at most reach the driver."""
    c = hashes.columns[0]
    bit = F.pmod(F.col(c), F.lit(FILTER_BITS))
    rows = hashes.where(F.col(c).isNotNull()).groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = np.zeros(FILTER_BITS, bool)
    for r in rows:
        bits = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
        # bucket k holds the values (k - 1) * 32768 + 1 ... k * 32768, at the positions 0 ... 32767; bucket 0 holds 0
        out[((r["k"] - 1) * 32768 + 1 + np.flatnonzero(bits)) % FILTER_BITS if r["k"] else 0] = True
    return np.packbits(out, bitorder="little")


def in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes.view(np.uint64) & _U(FILTER_BITS - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of ``edges (a, b)``; component is the least id reachable.

    Large-star and small-star steps until nothing moves, each step's edges written to the
    shared folder; a hub's edges are never gathered in one group.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = stored(e, "edges")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    last = mark(e)
    while last[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = stored(small.where("u <> v").distinct(), "edges")
        now = mark(e)
        if now == last:
            break
        last = now
    out = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return out.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
