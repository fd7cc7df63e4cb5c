"""Whitening against plain NumPy and Python integers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from catalogspark.llm import op11_whitening as op


def _frame(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, component int, key string").repartition(3)


def _check(rows, got, components=8):
    """``rows``: (id, vector) of one length."""
    x = [[math.floor(Fraction(c) * 1024) + 100_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(r, sums)] for r in x])
    v = centred.T @ centred / n
    values, directions = np.linalg.eigh(v)
    values, directions = values[::-1], directions[:, ::-1]
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    k = min(components, len(sums))
    for (i, _), a, c in zip(rows, x, centred):
        mine = sorted(by[i], key=lambda r: r["component"])
        assert [r["component"] for r in mine] == list(range(1, k + 1))
        assert {(r["n"], int(r["deviation"])) for r in mine} == {(n, sum((n * p - s) ** 2 for p, s in zip(a, sums)))}
        for r in mine:
            e = values[r["component"] - 1]
            assert r["explained"] == pytest.approx(e / np.trace(v), rel=1e-6)
            assert r["identity_error"] < 1e-8
            assert abs(r["whitened"]) == pytest.approx(abs(c @ directions[:, r["component"] - 1]) / math.sqrt(e), rel=1e-5, abs=1e-6)
    assert len({(r["component"], round(r["explained"], 12)) for r in got}) == k
    w = np.array([[r["whitened"] for r in sorted(by[i], key=lambda r: r["component"])] for i, _ in rows])
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-6


def test_like_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.standard_normal(12) * np.arange(1, 13)).tolist()) for i in range(300)]
    df = _frame(spark, [(*r, 1, "k") for r in rows])
    _check(rows, op.whiten(df, op.fit(df)).collect())


def test_lengths_apart_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    one = [(i, rng.standard_normal(3).tolist()) for i in range(40)]
    two = [(100 + i, rng.standard_normal(9).tolist()) for i in range(40)]
    nan = float("nan")
    odd = [(200, None), (201, []), (202, [1.0, None, 2.0]), (203, [nan, 1.0, 2.0]), (204, [float("inf"), 1.0, 2.0]), (205, [1e300, 0.0, 0.0])]
    df = _frame(spark, [(*r, None, None) for r in one + two + odd])
    got = op.whiten(df, op.fit(df)).collect()
    assert {r["vec_id"] for r in got} == {i for i, _ in one + two}
    _check(one, [r for r in got if r["vec_id"] < 100])
    _check(two, [r for r in got if r["vec_id"] >= 100])


def test_large_entries_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(4) * 10.0 ** rng.integers(0, 14)).tolist()) for i in range(30)]
    df = _frame(spark, [(*r, 1, "k") for r in rows])
    n, x = len(rows), [[math.floor(Fraction(c) * 1024) + 100_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    got = {r["vec_id"]: r["deviation"] for r in op.whiten(df, op.fit(df)).collect()}
    assert {i: int(v) for i, v in got.items()} == {i: sum((n * p - s) ** 2 for p, s in zip(a, sums)) for (i, _), a in zip(rows, x)}


def test_no_variance_repeats_and_empty(spark):
    df = _frame(spark, [(1, [1.0, 2.0], 1, "k"), (1, [1.0, 2.0], 1, "k"), (None, [1.0, 2.0], 1, "k")], "float")
    got = op.whiten(df, op.fit(df)).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2)]
    assert {(r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in got} == {(3, 0, None, 0.0, 0.0)}
    line = _frame(spark, [(i, [float(i), 2.0 * i, 0.0], 1, "k") for i in range(10)])
    got = op.whiten(line, op.fit(line)).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in got) and max(r["identity_error"] for r in got) < 1e-9
    assert op.whiten(df.limit(0), op.fit(df.limit(0))).collect() == []


def test_query(spark, sf_dir):
    got = op.query(spark, sf_dir)
    assert dict(got.dtypes)["deviation"] == "bigint"
    rows = [(r["vec_id"], [float(c) for c in r["embedding"]]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    _check(rows, got.collect())
