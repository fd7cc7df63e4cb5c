r"""Fill-in-the-middle examples on ropes.

A text is a tree of leaves; a leaf holds up to ``LEAF`` units of the text, and leaves and nodes cache how many units and
code points are below them. A unit is a word with the blanks before it, or the blanks at a text's end. The tree is
split at two unit ranks, which opens one leaf each, and the subtrees are joined in another order with sentinels between them. To undo it, the
tree of the output is split at the code-point ranks of its sentinels.

The cuts, the form and the order of the parts follow from a hash of the seed and the row's id, so that a task that runs again makes
the same example. Nothing is shuffled.

Null texts count as empty, and empty texts stay plain, as do texts that hold a sentinel. A null id counts as the
empty string. Repeated ids get the same cuts. Ties (both cuts at one place) give an empty middle. A text of any length is one row's tree.
Extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import SPACE, groups, spans, table, text_buffers

NAME = "op13_fim"
SEED = 42
#: Percent of texts that are transformed, and percent of those in the order suffix, prefix, middle.
RATE, SPM_RATE = 50, 80
#: Units of a leaf.
LEAF = 512
P, S, M = b"<P>", b"<S>", b"<M>"
_UNIT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@dataclass(slots=True)
class Rope:
    """A leaf (``text``) or the join of two ropes."""

    units: int
    points: int
    text: bytes | None = None
    left: Rope | None = None
    right: Rope | None = None

    def leaves(self):
        todo = [self]
        while todo:
            x = todo.pop()
            if x.text is None:
                todo += (x.right, x.left)
            elif x.text:
                yield x.text


def _points(text: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def leaf(text: bytes, units: int) -> Rope:
    return Rope(units, _points(text), text)


def _pieces(text: bytes, step: int = 1 << 14):
    """A text in pieces of about ``step`` bytes that end between characters."""
    lo = 0
    while lo < len(text):
        hi = min(lo + step, len(text))
        while hi < len(text) and text[hi] & 0xC0 == 0x80:
            hi += 1
        yield text[lo:hi]
        lo = hi


EMPTY = Rope(0, 0, b"")


def concat(a: Rope, b: Rope) -> Rope:
    if not (a.units or a.points):
        return b
    if not (b.units or b.points):
        return a
    return Rope(a.units + b.units, a.points + b.points, None, a, b)


def balanced(parts: list[Rope]) -> Rope:
    while len(parts) > 1:
        parts = [concat(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else EMPTY


def build(text: bytes, ends: np.ndarray) -> Rope:
    """The rope of a text whose units end at ``ends``."""
    cuts = [0, *ends[LEAF - 1 : len(ends) - 1 : LEAF].tolist(), len(text)]
    return balanced([leaf(text[a:b], min(LEAF, len(ends) - LEAF * i)) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a])


def split(rope: Rope, rank: int, points: bool = False) -> tuple[Rope, Rope]:
    """What is before and after ``rank`` units, or code points: one way down the tree, and one leaf opened."""
    size = (lambda x: x.points) if points else (lambda x: x.units)
    before, after = [], []
    while rope.text is None:
        if rank < size(rope.left):
            after.append(rope.right)
            rope = rope.left
        else:
            before.append(rope.left)
            rank -= size(rope.left)
            rope = rope.right
    if rank <= 0 or rank >= size(rope):
        (after if rank <= 0 else before).append(rope)
    else:
        if points:
            starts = np.flatnonzero((np.frombuffer(rope.text, np.uint8) & 0xC0) != 0x80)
            at, units = int(starts[rank]), 0  # units of an output are not asked for
        else:
            at = next(m.end() for i, m in enumerate(_UNIT.finditer(rope.text), 1) if i == rank)
            units = rank
        before.append(leaf(rope.text[:at], units))
        after.append(leaf(rope.text[at:], rope.units - units))
    out = EMPTY
    for x in reversed(before):
        out = concat(x, out)
    rest = EMPTY
    for x in reversed(after):
        rest = concat(rest, x)
    return out, rest


def draws(seed: int, key: str) -> list[int]:
    """Four 32-bit numbers of the seed and a row's id."""
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]


def form_of(text: bytes, h3: int, h4: int, rate: int = RATE, spm_rate: int = SPM_RATE) -> str:
    if not text or P in text or S in text or M in text or h3 % 100 >= rate:
        return "plain"
    return "spm" if h4 % 100 < spm_rate else "psm"


def transform(rope: Rope, form: str, h1: int, h2: int) -> tuple[Rope, int | None, int | None]:
    """(output, code points of the prefix, of the middle)."""
    if form == "plain":
        return rope, None, None
    a, b = sorted((h1 % (rope.units + 1), h2 % (rope.units + 1)))
    rest, suffix = split(rope, b)
    prefix, middle = split(rest, a)
    p, s, m = leaf(P, 0), leaf(S, 0), leaf(M, 0)
    parts = [p, prefix, s, suffix, m, middle] if form == "psm" else [s, suffix, p, prefix, m, middle]
    return balanced(parts), prefix.points, middle.points


def restore(output: bytes, form: str) -> Rope:
    """The text of an output, from the output and its form alone."""
    if form == "plain":
        return leaf(output, 0)
    first, second = (P, S) if form == "psm" else (S, P)
    rope = balanced([leaf(x, 0) for x in _pieces(output)])
    place = [_points(output[: output.index(x)]) for x in (first, second, M)]
    head, middle = split(rope, place[2], True)
    head, two = split(head, place[1], True)
    _, one = split(head, place[0], True)
    one, two, middle = (split(x, 3, True)[1] for x in (one, two, middle))
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return concat(concat(prefix, middle), suffix)


def _texts(data: np.ndarray, offsets: np.ndarray):
    """(text, ends of its units) of each row."""
    _, ends, row = spans(data, offsets, ~SPACE)
    first = np.searchsorted(row, np.arange(len(offsets)))
    raw = data.tobytes()
    for i in range(len(offsets) - 1):
        a, b = int(offsets[i]), int(offsets[i + 1])
        e = ends[first[i] : first[i + 1]] - a
        yield raw[a:b], np.append(e, b - a) if b > a and (not len(e) or e[-1] < b - a) else e


def _mapper(seed: int, rate: int, spm_rate: int, keep_text: bool, digests: bool):
    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            keys = batch.column(2).to_pylist()
            for lo, hi in groups(offsets):
                cols = {c: [] for c in ("n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256")}
                at = offsets[lo : hi + 1]
                for key, (text, ends) in zip(keys[lo:hi], _texts(data[at[0] : at[-1]], at - at[0])):
                    h1, h2, h3, h4 = draws(seed, key or "")
                    form = form_of(text, h3, h4, rate, spm_rate)
                    out, prefix, middle = transform(build(text, ends), form, h1, h2)
                    output = b"".join(out.leaves())
                    sha = hashlib.sha256()
                    if digests:
                        for x in restore(output, form).leaves():
                            sha.update(x)
                    values = (len(ends), form, prefix, middle, output if keep_text else None, hashlib.sha256(output).hexdigest() if digests else None, sha.hexdigest() if digests else None)
                    for c, v in zip(cols.values(), values):
                        c.append(v)
                arrays = [batch.column(0).slice(lo, hi - lo), *(pa.array(v, t) for v, t in zip(cols.values(), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())))]
                names = ["key", *cols]
                kept = [i for i, c in enumerate(names) if (keep_text or c != "output") and (digests or not c.endswith("_sha256"))]
                yield pa.RecordBatch.from_arrays([arrays[i] for i in kept], [names[i] for i in kept])

    return run


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, id_column: str = "doc_id", text_column: str = "text", keep_text: bool = True, digests: bool = False) -> DataFrame:
    """(id_column, n, form, prefix_chars, middle_chars), the ``output`` text with ``keep_text``, and with ``digests`` those of the output and of the text rebuilt from it."""
    from pyspark.sql import functions as F

    kind = dict(docs.select(id_column).dtypes)[id_column]
    schema = f"key {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint" + (", output string" if keep_text else "") + (", output_sha256 string, restored_sha256 string" if digests else "")
    rows = docs.select(F.col(id_column).alias("key"), F.col(text_column).alias("text"), F.col(id_column).cast("string").alias("name"))
    return rows.mapInArrow(_mapper(seed, rate, spm_rate, keep_text, digests), schema).withColumnRenamed("key", id_column)


def restored(examples: DataFrame, output_column: str = "output", form_column: str = "form", into: str = "text") -> DataFrame:
    """``examples`` with the texts rebuilt from outputs and forms; a null output stays null."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def back(output, form):
        import pandas as pd

        return pd.Series([None if o is None else b"".join(restore(o.encode(), f).leaves()).decode() for o, f in zip(output, form)], dtype=object)

    return examples.withColumn(into, back(F.col(output_column), F.col(form_column)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents"), keep_text=False, digests=True)


ORACLE_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), drawn AS (
  SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n,
         CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM units
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle, coalesce(array_to_string(u[b + 1:], ''), '') AS suffix
  FROM cut
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
