"""The coder against the tiktoken library, and exact round trips."""

import hashlib

import numpy as np
import pytest

from catalogspark.llm import op1_bpe


@pytest.fixture(scope="module")
def coder():
    import tiktoken

    raw, pattern = op1_bpe.read_vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=op1_bpe.parse_ranks(raw), special_tokens={})


def test_like_the_library(spark, sf_dir, coder, odd_docs):
    raw, pattern = op1_bpe.read_vocabulary()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    want = {}
    for r in docs.collect():
        ids = coder.encode_ordinary(r["text"] or "")
        want.setdefault(r["text"], (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    got = op1_bpe.encode(docs.selectExpr("text AS key", "text").distinct(), raw, pattern, id_column="key", keep_ids=False).collect()
    assert {r["key"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want


def test_long_words(coder):
    raw, pattern = op1_bpe.read_vocabulary()
    codec = op1_bpe.Codec(raw, pattern)
    words = ["x" * 5000, "supercalifragilistic" * 100, "中文字" * 400, "a" * 1400, "!?" * 900]
    codec.learn(words)
    for w in words:
        assert np.frombuffer(codec.known[w][0], "<u4").tolist() == coder.encode_ordinary(w)


def test_decode(spark):
    raw, pattern = op1_bpe.read_vocabulary()
    assert [r["decoded"] for r in op1_bpe.decode(spark.createDataFrame([(1, None)], "doc_id int, ids array<int>"), raw).collect()] == [None]
    texts = ["Hello  world\n\n café", "", None, "\U0001f600 x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = op1_bpe.decode(op1_bpe.encode(docs, raw, pattern), raw).collect()
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in out} == {i: t or "" for i, t in enumerate(texts)}
