"""Byte-level BPE, encoding and decoding, by DuckDB recursive queries in each partition.

The merge table holds every pair of vocabulary entries whose concatenation is an entry. Each
Arrow batch is split into words; the words that the worker has not met become
(word, position, token) rows. A recursive query joins adjacent rows to the merge table and
contracts each word's leftmost pair of least rank until no pair is left; an ordered
aggregation gives the ids, and a second one, over the ids joined to the vocabulary, the
decoded bytes. A document's ids are those of its words in order.

The recursion's rows grow with the square of a word's length. So words are taken together by the sum of
their squares, and a word over ``LONG_WORD`` bytes (a run of letters, digits or signs without a blank) is
contracted pair by pair from a heap instead, in the same order.

Words met before are kept in a bounded table of the Python worker, which only saves work.
Null and empty texts give no ids. Repeated rows are encoded like any other.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

NAME = "op1_bpe"
#: Text taken at a time, and the most bytes of words kept by a worker.
BATCH_CHARS = 4_000_000
#: Bytes of a word, and sum of squared bytes of words, up to which the recursive query is used at once.
LONG_WORD, BATCH_SQUARES = 1500, 5_000_000
KEPT_BYTES = 300_000_000

_FIXPOINT = """
CREATE OR REPLACE TEMP TABLE fixed AS
WITH RECURSIVE st(it, w, pos, tok, nxt, npos, m) AS (
  SELECT 0, i.w, i.pos, i.tok, i.nxt, i.npos, g.m
  FROM init i LEFT JOIN merges g ON g.k = i.tok::INT8 * 16777216 + i.nxt
  UNION ALL
  SELECT u.it, u.w, u.pos, u.tok, u.nxt, u.npos, CASE WHEN u.changed THEN g.m ELSE u.m END
  FROM (
    SELECT s.it + 1 AS it, s.w, s.pos, s.m, s.pos = b.pos OR s.npos = b.pos AS changed,
      CASE WHEN s.pos = b.pos THEN b.m ELSE s.tok END AS tok,
      CASE WHEN s.pos = b.pos THEN b.next_tok WHEN s.npos = b.pos THEN b.m ELSE s.nxt END AS nxt,
      CASE WHEN s.pos = b.pos THEN b.next_pos ELSE s.npos END AS npos
    FROM st s JOIN (
      SELECT p.w, (p.k & 4294967295)::INT AS pos, (p.k >> 32)::INT AS m, p.npos, n.nxt AS next_tok, n.npos AS next_pos
      FROM (SELECT w, min(m::INT8 << 32 | pos) AS k, arg_min(npos, m::INT8 << 32 | pos) AS npos
            FROM st WHERE m IS NOT NULL GROUP BY w) p
      JOIN st n ON n.pos = p.npos
    ) b ON s.w = b.w AND s.pos <> b.npos
  ) u LEFT JOIN merges g ON g.k = CASE WHEN u.changed THEN u.tok::INT8 * 16777216 + u.nxt END
)
SELECT st.w, st.pos, st.tok FROM st JOIN (SELECT w, max(it) AS it FROM st GROUP BY w) z ON st.w = z.w AND st.it = z.it
"""
_DECODED = (
    "SELECT w, list(tok ORDER BY pos) AS ids, list(piece ORDER BY pos) AS pieces FROM fixed JOIN vocab USING (tok) GROUP BY w ORDER BY w"
)


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


class Codec:
    """A vocabulary's tables in an in-memory DuckDB, and the words met so far."""

    def __init__(self, raw: bytes, pattern: str):
        import duckdb
        import regex

        ranks = parse_ranks(raw)
        self.find = regex.compile(pattern).findall
        self.iterate = regex.compile(pattern).finditer
        self.first = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [
            (a * 16777216 + b, r)
            for t, r in ranks.items()
            for i in range(1, len(t))
            if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None
        ]
        self.merged = dict(pairs)
        keys, merged = zip(*pairs) if pairs else ((), ())
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self._load("merges", {"k": pa.array(keys, pa.int64()), "m": pa.array(merged, pa.int32())})
        self._load("vocab", {"tok": pa.array(ranks.values(), pa.int32()), "piece": pa.array(ranks, pa.binary())})
        self.piece = {r: t for t, r in ranks.items()}
        #: word, or segment of words -> (ids, bytes decoded from them), and about how many bytes these take
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.kept = 0

    def _load(self, name: str, columns: dict) -> None:
        rows = pa.table(columns)
        self.db.register("arrow_rows", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM arrow_rows")
        self.db.unregister("arrow_rows")

    def contract(self, raw: bytes) -> list[int]:
        """Ids of a long word: the leftmost pair of least rank first, from a heap."""
        from heapq import heapify, heappop, heappush

        tok = self.first[np.frombuffer(raw, np.uint8)].tolist()
        after, before = list(range(1, len(tok) + 1)), list(range(-1, len(tok) - 1))
        pair = lambda i: self.merged.get(tok[i] * 16777216 + tok[after[i]]) if after[i] < len(tok) else None
        heap = [(m, i, tok[i], tok[i + 1]) for i in range(len(tok) - 1) if (m := pair(i)) is not None]
        heapify(heap)
        while heap:
            m, i, a, b = heappop(heap)
            j = after[i]
            if tok[i] != a or j >= len(tok) or tok[j] != b:
                continue
            tok[i], tok[j], after[i] = m, -1, after[j]
            if after[j] < len(tok):
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (n := pair(k)) is not None:
                    heappush(heap, (n, k, tok[k], tok[after[k]]))
        return [t for t in tok if t >= 0]

    def _keep(self, word: str, ids: bytes, text: bytes) -> None:
        self.known[word] = (ids, text)
        self.kept += 300 + len(ids) + 2 * len(text)

    def learn(self, words: list[str]) -> None:
        """Ids of new words: those that are entries themselves by a join to the vocabulary, the others by the recursion."""
        raw_words = [(w, w.encode()) for w in words]
        for w, raw in raw_words:
            if len(raw) > LONG_WORD:
                ids = self.contract(raw)
                self._keep(w, np.array(ids, "<u4").tobytes(), b"".join([self.piece[i] for i in ids]))
        short = [x for x in raw_words if len(x[1]) <= LONG_WORD]
        if not short:
            return
        self.db.register("words", pa.table({"i": pa.array(range(len(short)), pa.int32()), "piece": pa.array([r for _, r in short], pa.binary())}))
        whole = self.db.sql("SELECT i, tok FROM words JOIN vocab USING (piece)").to_arrow_table()
        self.db.unregister("words")
        entries = dict(zip(whole["i"].to_pylist(), whole["tok"].to_pylist()))
        for i, tok in entries.items():
            self._keep(short[i][0], np.array([tok], "<u4").tobytes(), self.piece[tok])
        short = [x for i, x in enumerate(short) if i not in entries]
        if not short:
            return
        square = np.cumsum([len(r) ** 2 for _, r in short]) // BATCH_SQUARES
        for part in np.split(np.arange(len(short)), np.flatnonzero(np.diff(square)) + 1):
            raw = [short[i][1] for i in part]
            part = [short[i][0] for i in part]
            n = np.array([len(x) for x in raw])
            flat = np.frombuffer(b"".join(raw), np.uint8)
            at = np.arange(1, len(flat) + 1, dtype=np.int32)
            last = np.zeros(len(flat), bool)
            last[np.cumsum(n) - 1] = True
            tok = self.first[flat]
            init = {
                "w": np.repeat(np.arange(len(raw), dtype=np.int32), n), "pos": at - 1, "tok": tok,
                "nxt": pa.array(np.append(tok[1:], tok[:1]), mask=last), "npos": pa.array(at, mask=last),
            }
            self.db.register("init", pa.table(init))
            self.db.execute(_FIXPOINT)
            out = self.db.sql(_DECODED).to_arrow_table().combine_chunks()
            self.db.unregister("init")
            ids, pieces = (out[c].chunk(0) if isinstance(out[c], pa.ChunkedArray) else out[c] for c in ("ids", "pieces"))
            code, flat = ids.flatten().to_numpy().astype("<u4").tobytes(), pieces.flatten().to_numpy(zero_copy_only=False)
            at = np.append(0, np.cumsum(ids.value_lengths().to_numpy()))
            to = np.append(0, np.cumsum([len(x) for x in flat]))[at].tolist()
            at, text = (at * 4).tolist(), b"".join(flat)
            for i, w in enumerate(part):
                self._keep(w, code[at[i] : at[i + 1]], text[to[i] : to[i + 1]])

    def look_up(self, segments: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids, decoded bytes) of each segment; a segment's matches are looked for once."""
        known = self.known
        words = {s: [s] if s.isascii() and s[s[0] == " " :].isalpha() else self.find(s) for s in segments if s and s not in known}
        self.learn(list({w for ws in words.values() for w in ws if w not in known}))
        for s, ws in words.items():
            if s not in known:
                parts = [known[w] for w in ws]
                self._keep(s, b"".join([x for x, _ in parts]), b"".join([x for _, x in parts]))
        return [known[s] if s else (b"", b"") for s in segments]

    def forget(self) -> None:
        if self.kept > KEPT_BYTES:
            self.known, self.kept = {}, 0


_codecs: dict[tuple, Codec] = {}
#: A blank between two characters that aren't blanks starts a match of the pattern, so a text can be cut there.
_CUT = re.compile(r" (?=\S)(?<=\S )")


def _codec(raw: bytes, pattern: str) -> Codec:
    key = (hash(raw), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(raw, pattern)
    return _codecs[key]


def encode_texts(texts: list[str | None], codec: Codec) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(ids, decoded bytes) of all segments of the texts in order, and where each text's segments start."""
    cut = [_CUT.split(t or "") for t in texts]
    at = np.concatenate([[0], np.cumsum([len(c) for c in cut])])
    coded = pa.array([s for c in cut for s in c], pa.large_string()).dictionary_encode()
    code, later = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    heads = list({c[0] for c in cut})
    head = {s: len(later) + i for i, s in enumerate(heads)}
    code[at[:-1]] = [head[c[0]] for c in cut]
    # all segments but a text's first begin with the blank it was cut at; some of the dictionary are first ones only
    used = np.zeros(len(later) + len(heads), bool)
    used[code] = True
    rank = np.cumsum(used) - 1
    found = codec.look_up([s for s, u in zip([*(" " + s for s in later), *heads], used.tolist()) if u])
    code = pa.array(rank[code])
    return *(pa.array([x[i] for x in found], pa.large_binary()).take(code) for i in (0, 1)), at


def _slices(texts: list[str | None]) -> Iterator[list[int]]:
    part, n = [], 0
    for i, t in enumerate(texts):
        part.append(i)
        n += len(t or "")
        if n >= BATCH_CHARS:
            yield part
            part, n = [], 0
    if part:
        yield part


def _long(text: str, codec: Codec) -> Iterator[tuple[bytes, bytes]]:
    """(ids, decoded bytes) of a text over BATCH_CHARS, by parts that end between matches."""
    part, n = [], 0
    for m in codec.iterate(text):
        part.append(m[0])
        n += len(m[0]) + 50
        if n >= BATCH_CHARS:
            yield _joined(part, codec)
            part, n = [], 0
    if part:
        yield _joined(part, codec)


def _joined(words: list[str], codec: Codec) -> tuple[bytes, bytes]:
    codec.forget()
    codec.learn(list({w for w in words if w not in codec.known}))
    found = [codec.known[w] for w in words]
    return b"".join([x for x, _ in found]), b"".join([x for _, x in found])


def _parts(array: pa.Array, at: np.ndarray) -> Iterator[memoryview]:
    """The joined bytes of each run of elements."""
    _, offsets, data = array.buffers()
    data = memoryview(data) if data is not None else memoryview(b"")
    edge = np.frombuffer(offsets, np.int64, len(array) + 1)[at].tolist()
    yield from (data[a:b] for a, b in zip(edge, edge[1:]))


def _mapper(vocabulary, pattern: str, id_column: str, text_column: str, keep_ids: bool):
    def run(batches):
        codec = _codec(vocabulary.value, pattern)
        for batch in batches:
            keys, texts = batch.column(id_column), batch.column(text_column)
            for lo in range(0, len(texts), 1000):
                some = texts.slice(lo, 1000).to_pylist()
                for part in _slices(some):
                    codec.forget()
                    big = [len(some[i] or "") > BATCH_CHARS for i in part]
                    ids, plain, at = encode_texts([None if b else some[i] for i, b in zip(part, big)], codec)
                    rows = []
                    for i, b, x, y in zip(part, big, _parts(ids, at), _parts(plain, at)):
                        sha, whole, n, kept = hashlib.sha256(), hashlib.sha256(), 0, []
                        for a, d in _long(some[i], codec) if b else ((x, y),):
                            n += len(a) // 4
                            sha.update(a)
                            whole.update(d)
                            if keep_ids:
                                kept.append(np.frombuffer(a, "<u4").astype(np.int32))
                        rows.append((n, sha.hexdigest(), whole.hexdigest(), np.concatenate(kept) if kept else []))
                    cols = list(zip(*rows))
                    arrays = [keys.slice(lo + part[0], len(part)), pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2])]
                    names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256"]
                    if keep_ids:
                        arrays.append(pa.array(list(cols[3]), pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def encode(docs: DataFrame, vocabulary: bytes, pattern: str, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = True) -> DataFrame:
    """Ids of every whole text, with the digests of the ids and of the bytes decoded from them.

    ``vocabulary`` is the content of a rank file; its size is that of the vocabulary, not of
    the data, and it reaches the tasks as a broadcast variable.
    """
    spark = docs.sparkSession
    kind = dict(docs.select(id_column).dtypes)[id_column]
    schema = f"`{id_column}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    shared = spark.sparkContext.broadcast(vocabulary)
    return docs.select(id_column, text_column).mapInArrow(_mapper(shared, pattern, id_column, text_column, keep_ids), schema)


def decode(encoded: DataFrame, vocabulary: bytes, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """Bytes of each row's ids: (position, id) rows join the vocabulary, an ordered aggregation joins the pieces.

    Null ids give null; an empty list gives no bytes.
    """
    spark = encoded.sparkSession
    kind = dict(encoded.select(id_column).dtypes)[id_column]
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches):
        codec = _codec(shared.value, ".")
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                rows = pa.table({"r": pa.array(range(part.num_rows), pa.int32()), "ids": part.column(ids_column)})
                codec.db.register("encoded", rows)
                out = codec.db.execute(
                    "SELECT e.r, CASE WHEN any_value(e.ids) IS NULL THEN NULL ELSE list(v.piece ORDER BY u.pos) END AS pieces "
                    "FROM encoded e LEFT JOIN (SELECT r, unnest(ids) AS tok, generate_subscripts(ids, 1) AS pos FROM encoded) u ON u.r = e.r "
                    "LEFT JOIN vocab v ON v.tok = u.tok GROUP BY e.r ORDER BY e.r"
                ).fetchall()
                codec.db.unregister("encoded")
                yield pa.RecordBatch.from_arrays([part.column(id_column), pa.array([None if x is None else b"".join([p for p in x if p is not None]) for _, x in out], pa.binary())], [id_column, "decoded"])

    return encoded.select(id_column, ids_column).mapInArrow(run, f"`{id_column}` {kind}, decoded binary")


def read_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[bytes, str]:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, pattern = read_vocabulary()
    return encode(table(spark, sf_dir, "documents"), raw, pattern, keep_ids=False)
