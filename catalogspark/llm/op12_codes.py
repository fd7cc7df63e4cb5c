"""Token ids of a corpus in files of directly addressable codes.

Documents lie in the files by rising id, each with an end id. A file holds one segment: a header, the documents' ids and
first places, and the token ids as levels. An id is cut into chunks from its low bits up; level 1 has the first chunk of
every id, level 2 the second chunk of those that have one, and so on. A level's bitmap marks the ids that continue, and its
directory has the count of marks before each 512 bits, so that any token is reached by one chunk a level and a rank between them, and no
block is decoded. The chunk widths are the ones that make the segment smallest, from the counts of its ids by bit length.

File layout, little-endian: ``DAC1``, seven int64 (bucket, number in the bucket, documents, ids, levels, bits of an id, length of the file's
content), then each level's width, ids and marked ids (int64), then the sections, each padded to 8 bytes (chunks to 64 values): documents' ids, their null marks, first
places (one more than documents), and for each level its chunks, its bitmap and its directory. Spark's text writer puts the bytes into the files, a row a
file, so that any file system of Spark's and its commit of tasks serve; the line end after the content is not part of it.

Texts are encoded by the tokenizers library. Its normaliser and its splitter never look across ASCII blanks, so the words between these are
encoded, and their ids joined; a worker keeps those of the words it has met. Documents are dealt to buckets of rising ids (quantiles of the ids, counted over all
rows), so the only shuffle is that of ids, two bytes a token for up to 65,536 ids. An id that many rows share has several buckets, by a
hash of the text.

Null and empty texts have the end id alone. Null ids come first. Rows of one id are ordered by a hash of their text, then by
their ids, so that equal rows alone are interchangeable (they share one bucket, which its task sorts with spill and writes segment by segment). Ids must be integers. Extra columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from functools import lru_cache
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _checkpoint_dir, shuffle_partitions, stored, table

NAME = "op12_codes"
END = 1
#: Ids of a segment (one document can exceed it), bytes of text for each bucket, and cached words of a worker.
SEGMENT, BUCKET_BYTES, CACHE = 8_000_000, 64_000_000, 1_000_000
MAGIC = b"DAC1"
_SUPER = 512
_LEAST = -(1 << 63)


# --- codes -------------------------------------------------------------------------------------------------------


def widths(lengths: np.ndarray) -> list[int]:
    """Chunk widths with the fewest bits in all, from the counts of ids by bit length (``lengths[b]``; at least one bit each)."""
    top = max([b for b in range(len(lengths)) if lengths[b]], default=1) or 1
    longer = [int(lengths[b + 1 :].sum()) for b in range(top + 1)]  # ids with more than b bits
    longer[0] = int(lengths.sum())
    best: dict[int, tuple[int, list[int]]] = {top: (0, [])}
    for b in range(top - 1, -1, -1):  # ids with more than b bits still have to be written
        best[b] = min((longer[b] * (e - b + 1) + best[e][0], [e - b, *best[e][1]]) for e in range(b + 1, top + 1))
    return best[0][1]


def _places(width: int):
    """(value, word, shift) of the 64 values that fill ``width`` words of 64 bits."""
    return [(k, k * width >> 6, np.uint64(k * width & 63)) for k in range(64)]


def _pack(values: np.ndarray, width: int) -> bytes:
    """Values of ``width`` bits one behind the other; 64 of them fill whole words, and the last are filled up with zeros."""
    v = np.zeros((-(-len(values) // 64), 64), np.uint64)
    v.ravel()[: len(values)] = values
    out = np.zeros((len(v), width), np.uint64)
    for k, at, shift in _places(width):
        out[:, at] |= v[:, k] << shift
        if int(shift) + width > 64:
            out[:, at + 1] |= v[:, k] >> np.uint64(64 - int(shift))
    return out.astype("<u8").tobytes()


def _unpack(words: np.ndarray, width: int, a: int, b: int) -> np.ndarray:
    """Values a to b of packed ones; reads the words of 64 values together."""
    lo, hi = a // 64, -(-b // 64)
    w = words[lo * width : hi * width].reshape(-1, width)
    out = np.empty((len(w), 64), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for k, at, shift in _places(width):
        v = w[:, at] >> shift
        if int(shift) + width > 64:
            v |= w[:, at + 1] << np.uint64(64 - int(shift))
        out[:, k] = v & mask
    return out.ravel()[a - lo * 64 : b - lo * 64]


def _one(words: np.ndarray, width: int, i: int) -> int:
    """A packed value, from the one or two words it lies in."""
    at, shift = i * width >> 6, i * width & 63
    v = int(words[at]) >> shift
    if shift + width > 64:
        v |= int(words[at + 1]) << 64 - shift
    return v & (1 << width) - 1


def encode_segment(bucket: int, number: int, doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    bits = np.maximum(np.frexp(ids.astype(np.float64))[1], 1).astype(np.uint8)  # bit lengths
    chunk_widths = widths(np.bincount(bits, minlength=33))
    sections = [np.array([i or 0 for i in doc_ids], "<i8").tobytes(), np.packbits([i is None for i in doc_ids], bitorder="little").tobytes(), np.concatenate([[0], np.cumsum(counts)]).astype("<i8").tobytes()]
    levels, rest, below = [], ids, 0
    for w in chunk_widths:
        below += w
        more = bits > below
        marks = np.packbits(more, bitorder="little")
        ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), _SUPER), dtype=np.int64))]) if len(more) else [0]
        sections += [_pack(rest & np.uint32((1 << w) - 1), w), marks.tobytes(), np.asarray(ranks, "<u4").tobytes()]
        levels.append((w, len(rest), int(more.sum())))
        rest, bits = rest[more] >> np.uint32(w), bits[more]
    head = np.array([bucket, number, len(doc_ids), len(ids), len(levels), below, 0, *(x for level in levels for x in level)], "<i8")
    body = b"".join(s + b"\0" * (-len(s) % 8) for s in sections)
    head[6] = 8 + head.nbytes + len(body)
    return MAGIC + b"\0" * 4 + head.tobytes() + body


class Segment:
    """A file's content. ``token`` reaches one token, ``ids`` a run of them; neither decodes what lies before."""

    def __init__(self, content):
        raw = np.frombuffer(content, np.uint8)
        if raw[:4].tobytes() != MAGIC:
            raise ValueError("not a file of codes")
        self.bucket, self.number, docs, self.n_ids, levels, _, _ = (int(x) for x in raw[8:64].view("<i8"))
        shape, at = raw[64 : 64 + 24 * levels].view("<i8").reshape(-1, 3).tolist(), 64 + 24 * levels

        def section(size: int) -> np.ndarray:
            nonlocal at
            out = raw[at : at + size]
            at += size + -size % 8
            return out

        self._doc_ids, self._null = section(8 * docs).view("<i8"), section((docs + 7) // 8)
        self.first = section(8 * (docs + 1)).view("<i8")
        self._levels = [(w, section(-(-n // 64) * w * 8).view("<u8"), section((n + 7) // 8), section(4 * (-(-n // _SUPER) + 1)).view("<u4")) for w, n, _ in shape]

    @property
    def doc_ids(self) -> list:
        null = np.unpackbits(self._null, bitorder="little")
        return [None if z else i for i, z in zip(self._doc_ids.tolist(), null)]

    @staticmethod
    def _rank(marks: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Marks before place i: the directory's count, and at most 64 bytes of the bitmap."""
        lo = i // _SUPER
        return int(ranks[lo]) + int(np.unpackbits(marks[lo * _SUPER // 8 : (i + 7) // 8], bitorder="little")[: i - lo * _SUPER].sum())

    def token(self, i: int) -> int:
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = shift = 0
        for w, chunks, marks, ranks in self._levels:
            value |= _one(chunks, w, i) << shift
            if not marks[i >> 3] >> (i & 7) & 1:
                break
            i, shift = self._rank(marks, ranks, i), shift + w
        return value

    def ids(self, a: int, b: int) -> np.ndarray:
        """Tokens a to b."""
        out = np.zeros(b - a, np.uint32)
        where, shift = np.arange(b - a), 0
        for w, chunks, marks, ranks in self._levels:
            if a == b:
                break
            out[where] |= _unpack(chunks, w, a, b) << np.uint32(shift)
            more = np.unpackbits(marks[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 :][: b - a].view(bool)
            a = self._rank(marks, ranks, a)
            where, shift = where[more], shift + w
            b = a + len(where)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.first[k]), int(self.first[k + 1]))


# --- writing -----------------------------------------------------------------------------------------------------


#: The normaliser, and the splitter by a pattern, of files whose words can be encoded one at a time.
_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
#: Texts of Latin letters, digits, signs and ASCII blanks: NFC leaves them alone and lower case takes letters to letters.
_LATIN = re.compile("[\t-\r -~\u00a1-\u012f\u0131-\u017f]*").fullmatch
#: The letter that stands for each byte: itself where it can be seen, else the next free one from 256 on.
_SEEN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_LETTERS = {b: chr(b) if b in _SEEN else chr(256 + sum(x not in _SEEN for x in range(b))) for b in range(256)}


def _split_by(pattern: str) -> dict:
    split = {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Removed", "invert": True}
    return {"type": "Sequence", "pretokenizers": [split, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


@lru_cache(2)
def _words(vocabulary: str, kind: str) -> _Words:
    """One for all tasks of a worker: a word met by a task before isn't encoded again."""
    return _Words(vocabulary, np.dtype(kind))


class _Words(dict):
    """Ids of words as bytes of ``kind``; what isn't there yet is encoded. At ``CACHE`` entries it starts anew.

    A file whose normaliser is NFC, blanks as one blank and lower case, and whose splitter keeps what matches a pattern that never matches blanks, can be asked for a
    word at a time. A text of Latin letters and signs is put in lower case, and the pieces of its words go to the library's model at once. Words of other texts,
    or of texts with a special token, go through all steps. Any other file gets whole texts.
    """

    def __init__(self, vocabulary: str, kind: np.dtype):
        import regex
        from tokenizers import Tokenizer

        self.codec, self.format, self.pieces, self.others = Tokenizer.from_str(vocabulary), "<{}" + {2: "H", 4: "I"}[kind.itemsize], {}, {}
        self.model = self.codec.model
        told = json.loads(vocabulary)
        split = (told.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        self.pattern = regex.compile(split) if split and [told["normalizer"], told["pre_tokenizer"]] == [_NORMAL, _split_by(split)] and not regex.search(split, " \t\n") else None
        self.special = re.compile("|".join(re.escape(t["content"]) for t in told.get("added_tokens", [])) or "(?!)").search

    def _bytes(self, ids: list[int]) -> bytes:
        return struct.pack(self.format.format(len(ids)), *ids)

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.codec.encode(text, add_special_tokens=False).ids)

    def _bound(self) -> None:
        if len(self) + len(self.pieces) + len(self.others) >= CACHE:
            for x in (self, self.pieces, self.others):
                x.clear()

    def __missing__(self, word: str) -> bytes:
        """Of a word in lower case, as Latin texts have them."""
        self._bound()
        out, known = b"", self.pieces
        for piece in self.pattern.findall(word):
            ids = known.get(piece)
            if ids is None:
                letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_LETTERS)
                ids = known[piece] = self._bytes([t.id for t in self.model.tokenize(letters)])
            out += ids
        self[word] = out
        return out

    def _other(self, word: bytes) -> bytes:
        out = self.others.get(word)
        if out is None:
            self._bound()
            out = self.others[word] = self._whole(word.decode("utf-8", "replace"))
        return out

    def of(self, raw: bytes) -> bytes:
        text = raw.decode("utf-8", "replace")
        if self.pattern is None:
            return self._whole(text)
        if _LATIN(text) and not self.special(text):
            return b"".join(map(self.__getitem__, text.lower().split()))
        return b"".join(map(self._other, raw.split()))  # at ASCII blanks


def _encoder(shared, kind: str, cuts: np.ndarray, end: int):
    last = np.array([end], kind).tobytes()

    def run(batches):
        import os

        from .common import groups, text_buffers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = _words(shared.value, kind)
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            key = batch.column("key").fill_null(_LEAST).to_numpy(zero_copy_only=False)
            part = (batch.column("h").to_numpy(zero_copy_only=False).astype(np.float64) / 2.0**64 + 0.5).clip(0, 1)
            low, high = np.searchsorted(cuts, key), np.searchsorted(cuts, key, "right")
            bucket = low + np.minimum((part * (high - low + 1)).astype(np.int64), high - low)
            for a, b in groups(offsets):
                raw = data[offsets[a] : offsets[b]].tobytes()
                at = (offsets[a : b + 1] - offsets[a]).tolist()
                ids = [words.of(raw[i:j]) + last for i, j in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[a:b], pa.int32()), *(batch.column(c).slice(a, b - a) for c in ("key", "h")), pa.array(ids, pa.binary())], ["bucket", "key", "h", "ids"])

    return run


def _writer(kind: str, segment: int):
    def rows(batches):
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("bucket", "key", "ids")))

    def run(batches):
        size = np.dtype(kind).itemsize
        for bucket, members in groupby(rows(batches), lambda r: r[0]):
            number, keys, blobs, n = 0, [], [], 0
            # a row past the bucket's last one closes the open segment
            for _, key, blob in chain(members, [(bucket, None, None)]):
                if blob is None or (keys and n + len(blob) // size > segment):
                    if keys:
                        counts = np.array([len(x) // size for x in blobs])
                        yield pa.RecordBatch.from_arrays([pa.array([encode_segment(bucket, number, keys, counts, np.frombuffer(b"".join(blobs), kind).astype(np.uint32))], pa.binary())], ["value"])
                    number, keys, blobs, n = number + 1, [], [], 0
                if blob is not None:
                    keys.append(key)
                    blobs.append(blob)
                    n += len(blob) // size

    return run


def read_vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def write(docs: DataFrame, vocabulary: str, path: str, id_column: str = "doc_id", text_column: str = "text", end: int = END, segment: int = SEGMENT, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Encodes every text and writes the files under ``path``. ``vocabulary`` is the content of a tokenizer's file, which the tasks get as a broadcast variable."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("bigint").alias("key"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_partitions(spark), -(-size // bucket_bytes))
    steps = [i / buckets for i in range(1, buckets)]
    cuts = rows.agg(F.percentile_approx(F.coalesce("key", F.lit(_LEAST)), steps, max(10_000, 50 * buckets))).first()[0] if steps else []
    kind = "<u2" if max(_Words(vocabulary, np.dtype("<u4")).codec.get_vocab_size(), end + 1) <= 1 << 16 else "<u4"
    encode = _encoder(spark.sparkContext.broadcast(vocabulary), kind, np.array(cuts or [], np.int64), end)
    dealt = rows.withColumn("h", F.xxhash64("text")).mapInArrow(encode, "bucket int, key bigint, h bigint, ids binary").repartitionById(buckets, F.col("bucket"))
    ordered = dealt.sortWithinPartitions("bucket", F.col("key").asc_nulls_first(), "h", "ids")
    files = ordered.mapInArrow(_writer(kind, segment), "value binary")
    # a cast keeps bytes as they are, whether or not they are UTF-8
    files.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).mode("errorifexists").text(path)


# --- reading -----------------------------------------------------------------------------------------------------


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def read(spark: SparkSession, path: str, keep_ids: bool = False, id_column: str = "doc_id") -> DataFrame:
    """(id_column, bucket, number, place, n_tokens, ids_crc32[, ids]): a row for each document in the files; ``place`` counts ids from the file's first."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                s = Segment(content.as_buffer())
                first = s.first
                for lo in range(0, len(first) - 1, 1000):
                    hi = min(lo + 1000, len(first) - 1)
                    ids = s.ids(int(first[lo]), int(first[hi])).astype("<u4")
                    docs = np.split(ids, first[lo + 1 : hi] - first[lo])
                    cols = [pa.array(s.doc_ids[lo:hi], pa.int64()), pa.array([s.bucket] * (hi - lo), pa.int32()), pa.array([s.number] * (hi - lo), pa.int64()), pa.array(first[lo:hi]), pa.array(np.diff(first[lo : hi + 1])), pa.array([zlib.crc32(d) for d in docs], pa.int64())]
                    names = ["key", "bucket", "number", "place", "n_tokens", "ids_crc32"]
                    if keep_ids:
                        cols.append(pa.array([d.astype(np.int64) for d in docs], pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(cols, names)

    schema = "key bigint, bucket int, number bigint, place bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if keep_ids else "")
    return _files(spark, path).mapInArrow(run, schema).withColumnRenamed("key", id_column)


def starts(documents: DataFrame) -> DataFrame:
    """(bucket, number, before): ids of all files before each file. Buckets are added up first; a window then runs over a row a bucket."""
    files = documents.groupBy("bucket", "number").agg(F.sum("n_tokens").alias("ids"))
    buckets = files.groupBy("bucket").agg(F.sum("ids").alias("ids"))
    earlier = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    base = buckets.select("bucket", earlier(Window.orderBy("bucket")).alias("base"))
    return files.withColumn("inside", earlier(Window.partitionBy("bucket").orderBy("number"))).join(base, "bucket").select("bucket", "number", (F.col("base") + F.col("inside")).alias("before"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_checkpoint_dir(spark).rstrip('/')}/tables/codes-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), read_vocabulary(), path)
    documents = stored(read(spark, path), "codes-read")
    return documents.join(starts(documents), ["bucket", "number"]).select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
