"""Directly addressable codes: round trips, random access, the library's ids and global starts."""

import json
import random
import tempfile
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from catalogspark.llm import op12_codes as op

from .conftest import prose


def _ids(kind, n=5000):
    rng = np.random.default_rng(3)
    return {
        "skewed": np.minimum(rng.zipf(1.3, n), 49_000), "zeros": np.zeros(n), "wide": rng.integers(0, 1 << 32, n), "one": np.array([7]), "few": rng.integers(0, 70_000, 513), "none": np.zeros(0),
    }[kind].astype(np.uint32)


@pytest.mark.parametrize("kind", ["skewed", "zeros", "wide", "one", "few", "none"])
def test_codes(kind):
    ids = _ids(kind)
    counts = np.array([0, len(ids) // 3, 0, len(ids) - len(ids) // 3])
    s = op.Segment(op.encode_segment(4, 2, [None, 5, 5, 9], counts, ids) + b"\n")
    assert (s.bucket, s.number, s.n_ids, s.doc_ids, np.diff(s.first).tolist()) == (4, 2, len(ids), [None, 5, 5, 9], counts.tolist())
    assert s.ids(0, len(ids)).tolist() == ids.tolist()
    assert np.concatenate([s.document(k) for k in range(4)]).tolist() == ids.tolist()
    r = random.Random(4)
    for _ in range(60 if len(ids) else 0):
        i = r.randrange(len(ids))
        j = r.randrange(i, len(ids) + 1)
        assert s.token(i) == ids[i] and s.ids(i, j).tolist() == ids[i:j].tolist()
    with pytest.raises(IndexError):
        s.token(len(ids))


def test_a_token_is_reached_without_decoding(monkeypatch):
    ids = _ids("skewed", 100_000)
    s = op.Segment(op.encode_segment(0, 0, [1], np.array([len(ids)]), ids))
    assert len(s._levels) > 1
    seen, one = [], op._one
    monkeypatch.setattr(op, "_unpack", None)
    monkeypatch.setattr(op, "_one", lambda *a: seen.append(a) or one(*a))
    assert s.token(99_999) == ids[99_999] and 1 <= len(seen) <= len(s._levels)


def test_widths_are_the_best():
    lengths = np.bincount([1, 1, 1, 1, 1, 1, 3, 3, 3, 12], minlength=33)

    def bits(ws):
        below, total = 0, 0
        for w in ws:
            total += (w + 1) * int(lengths[below + 1 :].sum() if below else lengths.sum())
            below += w
        return total

    def all_of(n):
        return [[]] if n == 0 else [[k, *rest] for k in range(1, n + 1) for rest in all_of(n - k)]

    assert bits(op.widths(lengths)) == min(map(bits, all_of(12)))
    assert op.widths(np.zeros(33, int)) == [1]


def _brute(rows):
    codec = Tokenizer.from_str(op.read_vocabulary())
    want, start = [], 0
    encoded = [(k, np.array([*codec.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for k, t in rows]
    for k, ids in sorted(encoded, key=lambda r: (r[0] is not None, r[0] or 0)):
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return want


def test_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op.query(spark, sf_dir)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and dict(got.dtypes) == {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}
    assert sorted(map(tuple, got.collect())) == sorted(_brute(rows))


def test_words_apart_are_the_text(spark):
    """Blanks of every kind, combining marks, final sigmas, special tokens and contractions at the cuts."""
    r = random.Random(5)
    latin = ["a", "B", "it's", "'LL", "~", "_", "x1y2", "É", "ß", "ª", "²", "¼", "ŉ", "Ÿ", "«", "<|endoftext|>", " ", " ", "\n", "\x0b", "12", "!!"]
    bits = ["a", "B", "it's", "'LL", "~", "_", "x1y2", "É", "ß", "µ", "ª", "²", "¼", "ŉ", "Ÿ", "\u00ad", "«", "Σ", "ΑΣ", "́", "é", "I'll", "'s", "<|endoftext|>", " ", "\x1c", "\x85", " ", " ", "\n", "\t", "\x0b", "中", "١", "12", "!!", "ﬁ", "İ", "\U0001f600"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(30))) for _ in range(6000)] + ["".join(r.choice(latin) for _ in range(r.randrange(30))) for _ in range(6000)]
    codec = Tokenizer.from_str(op.read_vocabulary())
    words = op._Words(op.read_vocabulary(), np.dtype("<u2"))
    got = [words.of(t.encode()) for t in texts]
    assert words and words.others
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [codec.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_file_of_another_kind_gets_whole_texts():
    raw = json.loads(op.read_vocabulary())
    raw["normalizer"] = None
    words = op._Words(json.dumps(raw), np.dtype("<u4"))
    text = "One two, THREE  'S\nfour"
    assert words.pattern is None
    assert np.frombuffer(words.of(text.encode()), "<u4").tolist() == Tokenizer.from_str(json.dumps(raw)).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("segment", [300, 8_000_000])
def test_odd_rows(spark, odd_docs, segment, monkeypatch):
    monkeypatch.setattr(op, "CACHE", 1000)
    op._words.cache_clear()
    hot = [(77, prose(i, 30)) for i in range(40)] + [(None, prose(i, 20)) for i in range(30)]
    docs = odd_docs.select("doc_id", "text", "key", "n").unionByName(spark.createDataFrame(hot, "doc_id bigint, text string"), allowMissingColumns=True)
    path = tempfile.mkdtemp(prefix="spark-") + "/codes"
    op.write(docs, op.read_vocabulary(), path, segment=segment)
    got = op.read(spark, path, keep_ids=True)
    files = op.starts(got)
    assert segment > 300 or files.count() >= 15
    rows = got.join(files, ["bucket", "number"]).collect()
    rows.sort(key=lambda r: r["before"] + r["place"])
    assert [r["doc_id"] for r in rows] == sorted([r["doc_id"] for r in docs.collect()], key=lambda k: (k is not None, k or 0))
    at = 0
    for r in rows:
        assert r["before"] + r["place"] == at and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == 1
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    want = [(k, n, c) for k, _, n, c in _brute([(r["doc_id"], r["text"]) for r in docs.collect()])]
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows), key=str) == sorted(want, key=str)


def test_empty_table(spark, no_docs):
    path = tempfile.mkdtemp(prefix="spark-") + "/codes"
    op.write(no_docs, op.read_vocabulary(), path)
    got = op.read(spark, path)
    assert got.collect() == [] and op.starts(got).collect() == []
