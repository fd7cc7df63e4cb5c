"""Language-model scores by cross-entropy difference.

A target and a background bigram model share one vocabulary (all words of the corpus), one order
and one smoothing: p(w | c) = (n(c, w) + A) / (n(c) + A * V). A document's score is its loss
per token under the target model less its loss under the background model; below zero it looks
like the target. The background is every document; the target is the documents that labels
mark as good, or any given set of ids.

Each task reads texts in blocks and counts the word pairs and contexts of each document. The
counts of a block are dealt to buckets by the hash of the pair or context; a bucket adds up what
all blocks sent it, exactly, and returns each document's share of the score. A document sends a pair once
however often it occurs, so a pair that every document has adds one entry a document.

Null and empty texts have no tokens and score 0. With an empty target or corpus both models are
uniform and scores follow from that. Repeated ids are rows of their own; a repeated id in the target
counts once. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GROUP_BYTES, SPACE, _U, ascii_lower, by_bucket, groups, mix, runs, shuffle_partitions, stored, table, text_buffers, word_hashes

NAME = "op10_lm"
SMOOTHING = 0.1
#: Bytes of target ids up to which they are sent to every task.
BROADCAST_BYTES = 8_000_000
#: Words of the corpus for each bucket, so that a bucket's size does not follow the corpus.
BUCKET = 1_500_000
_WORD = ~SPACE
_START = _U(0x51ED270B27A1C9F3)
_MOST_ROWS = 50_000


def _blocks(batch):
    data, offsets = text_buffers(batch.column("text"))
    for a, b in groups(offsets, 2 * GROUP_BYTES):
        for lo in range(a, b, _MOST_ROWS):
            hi = min(b, lo + _MOST_ROWS)
            yield lo, hi, *word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], _WORD, ascii_lower)


def _vocabulary(batches):
    """Distinct words of each block, most of those that the task has met before left out, and in a row without a word how many words it has."""
    met = np.zeros(1 << 20, np.uint64)
    for batch in batches:
        for _, _, word, _ in _blocks(batch):
            total = len(word)
            word = np.unique(word)
            slot = (word & _U(len(met) - 1)).astype(np.int64)
            new = met[slot] != word
            met[slot] = word
            new = word[new].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(new, 0), mask=np.append(np.zeros(len(new), bool), True)), pa.array(np.append(np.zeros(len(new), np.int64), total))], ["word", "n"])


def _entries(word: np.ndarray, row: np.ndarray):
    """(key, row, count) of the pairs and contexts of a block, in rising order; a key's first bit tells a context."""
    before = np.full(len(word), _START)
    same = row[1:] == row[:-1]
    before[1:][same] = word[:-1][same]
    keys = np.concatenate([mix(before * _U(0xD6E8FEB86659FD93) + word) >> _U(1), mix(before + _U(1)) | _U(1 << 63)])
    order = np.lexsort((np.concatenate([row, row]), keys))
    keys, row = keys[order], np.concatenate([row, row])[order]
    if not len(keys):
        return keys, row, row
    starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])]))
    return keys[starts], row[starts], np.diff(np.append(starts, len(keys)))


_SENT = ("bucket int, block bigint, uniq binary, times binary, row binary, n binary, good binary", "keys array<{}>, tokens array<bigint>")


def _sender(buckets: int, kind):
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in ("uniq", "times", "row", "n", "good")), ("keys", pa.list_(kind)), ("tokens", pa.list_(pa.int64()))])

    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            good = np.array(batch.column("good").to_pylist(), bool)
            for a, b, word, row in _blocks(batch):
                block, k = (part << 32) + k, k + 1
                out = {c: [] for c in schema.names}
                key, at, n = _entries(word, row)
                order, bucket, starts, lengths = by_bucket(key, buckets)
                key, at, n = key[order], at[order], n[order]
                marks = np.packbits(good[a:b]).tobytes()
                for s, m in zip(starts.tolist(), lengths.tolist()):
                    first, times = runs(key[s : s + m])
                    # by bytes of equal weight, as rising keys share their first; they pack better so
                    planes = key[s : s + m][first].astype("<u8").view(np.uint8).reshape(-1, 8).T
                    row_blob = (int(bucket[s]), block, planes.tobytes(), times.astype("<u2").tobytes(), at[s : s + m].astype("<u2").tobytes(), n[s : s + m].astype("<u4").tobytes(), marks, None, None)
                    for c, v in zip(schema.names, row_blob):
                        out[c].append(v)
                head = (k % buckets, block, None, None, None, None, None, batch.column("key").slice(a, b - a).to_pylist(), np.bincount(row, minlength=b - a).tolist())
                for c, v in zip(schema.names, head):
                    out[c].append(v)
                yield pa.RecordBatch.from_pydict(out, schema)

    return run


def _adder(total_words: int, kind):
    def run(rows: pa.Table) -> pa.Table:
        sent = [i for i, x in enumerate(rows.column("uniq")) if x.is_valid]
        heads = rows.filter(pa.compute.is_null(rows.column("uniq")))
        parts = rows.take(pa.array(sent, pa.int64()))
        read = lambda c, kind: [np.frombuffer(x.as_py(), kind) for x in parts.column(c)]
        rows_of, n_of = read("row", "<u2"), read("n", "<u4")
        keys = []
        for u, t in zip(read("uniq", np.uint8), read("times", "<u2")):
            keys.append(np.repeat(np.ascontiguousarray(u.reshape(8, -1).T).view("<u8").ravel(), t))
        out = {"block": list(heads.column("block").to_pylist()), "row": [None] * len(heads), "loss": [None] * len(heads), "keys": heads.column("keys").to_pylist(), "tokens": heads.column("tokens").to_pylist()}
        if sent:
            key, n = np.concatenate(keys), np.concatenate(n_of)
            marked = np.concatenate([np.unpackbits(g)[r] for g, r in zip(read("good", np.uint8), rows_of)])
            uniq, at = np.unique(key, return_inverse=True)
            del key, keys
            every = np.bincount(at, n)
            good = np.bincount(at, n * marked, len(uniq))
            context = uniq >> _U(63) == 1
            room = np.where(context, SMOOTHING * max(total_words, 1), SMOOTHING)
            loss = np.where(context, 1.0, -1.0) * (np.log(good + room) - np.log(every + room))
            share = loss[at] * n
            end = np.cumsum([len(x) for x in rows_of])
            for i, (block, r) in enumerate(zip(parts.column("block").to_pylist(), rows_of)):
                who, place = np.unique(r, return_inverse=True)
                sums = np.bincount(place, share[end[i] - len(r) : end[i]])
                for c, v in (("block", block), ("row", who.astype("<u2").tobytes()), ("loss", sums.astype("<f8").tobytes()), ("keys", None), ("tokens", None)):
                    out[c].append(v)
        return pa.table(out, pa.schema([("block", pa.int64()), ("row", pa.binary()), ("loss", pa.binary()), ("keys", pa.list_(kind)), ("tokens", pa.list_(pa.int64()))]))

    return run


def _gather(kind):
    def run(rows: pa.Table) -> pa.Table:
        keys, tokens = next((k, t) for k, t in zip(rows.column("keys").to_pylist(), rows.column("tokens").to_pylist()) if k is not None)
        total = np.zeros(len(keys))
        parts = sorted((bytes(r), bytes(x)) for r, x in zip(rows.column("row").to_pylist(), rows.column("loss").to_pylist()) if r is not None)
        for r, x in parts:  # in one order, so that sums repeat to the last bit
            total[np.frombuffer(r, "<u2")] += np.frombuffer(x, "<f8")
        score = total / np.maximum(tokens, 1)
        return pa.table({"key": pa.array(keys, kind), "n_tokens": pa.array(tokens, pa.int64()), "score": pa.array(score + 0.0)})

    return run


def score(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id_column, n_tokens, score) for each row of ``docs``; ``target`` holds ids in its column ``id_column``."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    kind = dict(docs.select(id_column).dtypes)[id_column]
    arrow = to_arrow_type(docs.schema[id_column].dataType)
    seen = docs.select(F.col(text_column).alias("text")).mapInArrow(_vocabulary, "word bigint, n bigint")
    words, tokens = seen.groupBy("word").agg(F.sum("n").alias("n")).agg(F.count("word"), F.coalesce(F.sum("n"), F.lit(0))).first()
    buckets = max(2 * shuffle_partitions(spark), tokens // BUCKET)
    good = target.select(F.col(id_column).alias("key")).where("key IS NOT NULL").distinct().withColumn("good", F.lit(True))
    small = (good.agg(F.sum(F.octet_length(F.col("key").cast("string")) + 8)).first()[0] or 0) <= BROADCAST_BYTES
    if small:
        good = F.broadcast(good)
    rows = docs.select(F.col(id_column).alias("key"), F.col(text_column).alias("text")).join(good, "key", "left").withColumn("good", F.coalesce("good", F.lit(False)))
    if not small:
        # the texts are shuffled to meet their marks, which leaves their order open; blocks are numbered by place, so that a task that runs again after a loss must find the same rows
        rows = stored(rows, "marked")
    sent = rows.mapInArrow(_sender(buckets, arrow), ", ".join(_SENT).format(kind))
    back = sent.groupBy("bucket").applyInArrow(_adder(words, arrow), f"block bigint, row binary, loss binary, keys array<{kind}>, tokens array<bigint>")
    return back.groupBy("block").applyInArrow(_gather(arrow), f"key {kind}, n_tokens bigint, score double").withColumnRenamed("key", id_column)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``score`` below zero: closer to the documents labelled as good than to the corpus."""
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return score(table(spark, sf_dir, "documents"), good)
