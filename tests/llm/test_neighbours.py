"""Neighbours in long lists leave their task packed, and none is lost."""

import types

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from catalogspark.llm import op2_jaccard as op
from catalogspark.llm.common import FILTER_BITS


def test_packed_neighbours():
    rng = np.random.default_rng(5)
    rows, want = [], set()
    for _ in range(20):  # list rows of lists that share most of their members
        lists = [np.sort(rng.choice(np.arange(1, 400), n, replace=False)).astype(np.int64) for n in (300, 250, 1, 17)]
        for x in lists:
            want |= {(int(i), int(j)) for i, j in zip(x[:-1], x[1:])}
        node = np.concatenate(lists)
        rows.append((True, np.array([len(x) for x in lists], "<i8").tobytes(), node.tobytes(), np.zeros(len(node), np.uint8).tobytes(), np.zeros(len(node), "<i4").tobytes()))
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), op._LISTS.types)], schema=op._LISTS)
    poor = types.SimpleNamespace(value=np.packbits(np.ones(FILTER_BITS, bool)))
    made = pa.Table.from_batches(op._neighbours(poor, 8)([batch]))
    assert made.num_rows <= 20 * 8
    got = []
    for part in range(8):
        some = made.filter(pa.compute.equal(made.column("part"), part))
        got += [tuple(r.values()) for r in op._distinct_pairs(some).to_pylist()]
    assert len(got) == len(set(got)) and set(got) == want
