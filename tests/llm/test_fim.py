"""Ropes against strings, the query against its SQL and against a plain version."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from catalogspark.llm import op13_fim as op

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def _plain(key, text):
    text = text or ""
    u = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(u), "plain", None, None, text
    if h4 % 100 < 80:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def _rope(text):
    raw = text.encode()
    (whole, ends), = op._texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert whole == raw
    return op.build(raw, ends)


def _str(rope):
    return b"".join(rope.leaves()).decode()


def test_splits_by_units_and_points(monkeypatch):
    monkeypatch.setattr(op, "LEAF", 3)
    r = random.Random(1)
    for _ in range(200):
        text = "".join(r.choice(["a", "bé", "\U0001f600", " ", "\n", " ", "中文 ", "\t "]) for _ in range(r.randrange(60)))
        units, rope = UNIT.findall(text), _rope(text)
        assert (rope.units, rope.points, _str(rope)) == (len(units), len(text), text)
        k = r.randrange(len(units) + 1)
        a, b = op.split(rope, k)
        assert (_str(a), _str(b), a.units, b.units) == ("".join(units[:k]), "".join(units[k:]), k, len(units) - k)
        assert (a.points, b.points) == (len(_str(a)), len(_str(b)))
        i = r.randrange(len(text) + 1)
        a, b = op.split(rope, i, True)
        assert (_str(a), _str(b)) == (text[:i], text[i:])


def test_a_split_opens_one_leaf():
    rope, seen = _rope("w " * 100_000), []
    original = op.leaf
    try:
        op.leaf = lambda text, units: seen.append(len(text)) or original(text, units)
        op.split(rope, 77_777)
    finally:
        op.leaf = original
    assert len(seen) == 2 and sum(seen) <= 2 * op.LEAF


@pytest.mark.parametrize("form", ["psm", "spm", "plain"])
def test_restore_across_pieces(form):
    text = "é\U0001f600 " * 20_000 + "\n"
    rope = _rope(text)
    out, *_ = op.transform(rope, form, 12_345, 777)
    assert _str(op.restore(_str(out).encode(), form)) == text


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame([(i, t) for i, t in enumerate(["a <P> b", "<S>", "x<M>", " ", "\n", "one", " two ", "<P", "P>"] * 8, 50)], odd_docs.select("doc_id", "text").schema))
    got = op.fill_in_middle(docs, digests=True)
    rows = got.collect()
    want = sorted(((k is None, k, *_plain(k, t)) for k, t in docs.collect()), key=str)
    assert sorted(((r["doc_id"] is None, r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in rows), key=str) == want
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    back = op.restored(got, into="back").collect()
    texts = sorted(((k is None, k, t or "") for k, t in docs.collect()), key=str)
    assert sorted(((r["doc_id"] is None, r["doc_id"], r["back"]) for r in back), key=str) == texts
    for r in back:
        assert r["restored_sha256"] == hashlib.sha256(r["back"].encode()).hexdigest() and r["output_sha256"] == hashlib.sha256(r["output"].encode()).hexdigest()
    assert op.fill_in_middle(no_docs).collect() == [] and "output_sha256" not in op.fill_in_middle(no_docs).columns


def test_query_like_its_sql(spark, sf_dir):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    rel = duckdb.sql(op.ORACLE_SQL)
    got = op.query(spark, sf_dir)
    assert got.columns == rel.columns
    assert sorted(map(tuple, got.collect())) == sorted(rel.fetchall())
