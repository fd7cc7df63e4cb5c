"""Language identification in two steps: family first, then languages within the family.

Features are byte trigrams around each letter byte (other bytes count as a blank), hashed to
``DIMS`` and normalised to mean one. Linear support vector machines, one for each pair of
families and one for each pair of languages of a family, are fitted by dual coordinate
descent on a bounded sample: ``PER_LANGUAGE`` labelled rows of each language at most, picked
by a hash of the id. Prediction reads every whole text.

Null texts and texts without a letter: ``und`` with score 0. Rows with a null label aren't
learned from. With no language learned, every row is ``und``. Repeated rows and ties get the
same answer; ties between languages go to the first in order.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LETTER, fold_latin, groups, table, text_buffers

NAME = "op9_langid"
DIMS = 1 << 13
PER_LANGUAGE = 500
#: Families of languages by ISO 639-1 code. A language not listed is its own family.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
}


def held_out(column, divisor: int, remainder: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor == remainder


def _codes(data: np.ndarray, offsets: np.ndarray):
    """(feature, row) for each letter byte."""
    n = len(data)
    letter = LETTER[data]
    sym = np.where(letter, fold_latin(data), 0x20).astype(np.uint32)
    before, after = np.full(n, 0x20, np.uint32), np.full(n, 0x20, np.uint32)
    before[1:] = sym[:-1]
    after[:-1] = sym[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = 0x20
    after[inner - 1] = 0x20
    at = np.flatnonzero(letter)
    code = (before[at] << np.uint32(16)) | (sym[at] << np.uint32(8)) | after[at]
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - 13)
    return code.astype(np.int64), np.searchsorted(offsets, at, "right") - 1


def _parts(column):
    """Groups of rows of bounded size; a longer text comes in pieces that keep their row."""
    data, offsets = text_buffers(column)
    for a, b in groups(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        step = max(4 << 20, 1)
        for x in range(lo, max(hi, lo + 1), step):
            y = min(hi, x + step)
            code, row = _codes(data[x:y], np.clip(offsets[a : b + 1] - x, 0, y - x))
            yield a + row, code


def _features(label_column: str):
    def run(batches):
        for batch in batches:
            rows: dict[int, np.ndarray] = {}
            for row, code in _parts(batch.column("text")):
                starts = np.flatnonzero(np.diff(row, prepend=-1))
                for s, e in zip(starts, [*starts[1:], len(row)]):
                    rows[int(row[s])] = rows.get(int(row[s]), 0) + np.bincount(code[s:e], minlength=DIMS)
            keep, blobs = [], []
            for r, counts in rows.items():
                idx = np.flatnonzero(counts)
                keep.append(r)
                blobs.append(np.concatenate([idx.astype("<f4"), counts[idx].astype("<f4")]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(label_column).take(pa.array(keep, pa.int64())), pa.array(blobs, pa.binary())], ["label", "x"])

    return run


def _svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 30) -> np.ndarray:
    """Weights of a linear machine with hinge loss; the last column of x is the constant."""
    gram = (x @ x.T).astype(np.float64)
    alpha, f = np.zeros(len(y)), np.zeros(len(y))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(y)):
            new = min(max(alpha[i] + (1 - y[i] * f[i]) / max(gram[i, i], 1e-9), 0.0), c)
            step = new - alpha[i]
            if step:
                alpha[i] = new
                f += step * y[i] * gram[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return x.T @ (alpha * y).astype(np.float32)


def fit(docs: DataFrame, label_column: str = "lang", where=None, id_column: str = "doc_id", text_column: str = "text", per_language: int = PER_LANGUAGE) -> dict:
    """The model, small enough for any task: ``(languages^2) * DIMS`` weights."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(label_column).alias("label"))
    rows = rows.where(F.col("label").isNotNull() & F.col("text").isNotNull())
    if where is not None:
        rows = rows.where(where)
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {"languages": [], "pairs": [], "w": np.zeros((DIMS, 0), np.float32), "b": np.zeros(0, np.float32)}
    share = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(1.0, per_language / n))])
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share[F.col("label")] * (1 << 30))
    got = picked.select("label", "text").mapInArrow(_features("label"), "label string, x binary").collect()
    got.sort(key=lambda r: (r["label"], bytes(r["x"])))
    x = np.zeros((len(got), DIMS + 1), np.float32)
    for i, r in enumerate(got):
        v = np.frombuffer(r["x"], "<f4")
        idx, n = v[: len(v) // 2].astype(int), v[len(v) // 2 :]
        x[i, idx] = n * (30.0 / n.sum())
    x[:, DIMS] = 1.0
    labels = np.array([r["label"] for r in got])
    languages = sorted(set(labels.tolist()))
    family = {g: f for f, members in FAMILIES.items() for g in members}
    family = {g: family.get(g, g) for g in languages}
    of = np.array([family[g] for g in labels])
    names = sorted(set(family.values()))
    tasks = [("family", a, b, of) for a, b in combinations(names, 2)]
    for f in names:
        tasks += [("language", a, b, labels) for a, b in combinations([g for g in languages if family[g] == f], 2)]
    weights = []
    for _, a, b, tags in tasks:
        some = np.flatnonzero((tags == a) | (tags == b))
        weights.append(_svm(x[some], np.where(tags[some] == a, 1.0, -1.0)))
    w = np.stack(weights, 1) if weights else np.zeros((DIMS + 1, 0), np.float32)
    return {"languages": languages, "family": family, "pairs": [t[:3] for t in tasks], "w": np.ascontiguousarray(w[:DIMS] * 30.0), "b": w[DIMS]}


def _vote(margins: np.ndarray, names: list, pairs: list):
    """Winner of the one-versus-one votes and the chance of its closest duel."""
    votes, least = np.zeros((len(margins), len(names))), np.full((len(margins), len(names)), np.inf)
    for k, (a, b) in enumerate(pairs):
        i, j = names.index(a), names.index(b)
        for at, sign in ((i, 1), (j, -1)):
            m = sign * margins[:, k]
            votes[:, at] += (m >= 0) if sign > 0 else (m > 0)
            least[:, at] = np.minimum(least[:, at], m)
    best = np.argmax(votes, 1)
    m = least[np.arange(len(best)), best]
    return best, 1 / (1 + np.exp(-2.0 * np.clip(m, -40, 40)))


def _predictor(model, passed: list[str]):
    def run(batches):
        m = model.value
        languages, pairs = m["languages"], m["pairs"]
        for batch in batches:
            n = batch.num_rows
            total, count = np.zeros((n, len(pairs))), np.zeros(n)
            for row, code in _parts(batch.column("text")):
                if len(row):
                    starts = np.flatnonzero(np.diff(row, prepend=-1))
                    at = row[starts]
                    count[at] += np.diff([*starts, len(row)])
                    if pairs:
                        total[at] += np.add.reduceat(m["w"].take(code, 0), starts, 0, dtype=np.float64)
            margins = total / np.maximum(count, 1)[:, None] + m["b"]
            lang, score = np.full(n, "und", object), np.zeros(n)
            plain = np.zeros(n, bool)
            if languages:
                fams = sorted(set(m["family"].values()))
                is_family = np.array([p[0] == "family" for p in pairs], bool)
                which, p_family = _vote(margins[:, is_family], fams, [p[1:] for p in pairs if p[0] == "family"])
                for f, name in enumerate(fams):
                    own = [g for g in languages if m["family"][g] == name]
                    k = [i for i, p in enumerate(pairs) if p[0] == "language" and p[1] in own]
                    rows = np.flatnonzero(which == f)
                    best, p_lang = _vote(margins[np.ix_(rows, k)], own, [pairs[i][1:] for i in k])
                    lang[rows] = np.array(own, object)[best]
                    score[rows] = p_family[rows] * p_lang
                data, offsets = text_buffers(batch.column("text"))
                ascii_letter = LETTER.copy()
                ascii_letter[128:] = False
                for a, b in groups(offsets):
                    hit = np.flatnonzero(ascii_letter[data[offsets[a] : offsets[b]]])
                    plain[a:b] = np.diff(np.searchsorted(hit, offsets[a : b + 1] - offsets[a])) > 0
            for i in np.flatnonzero(~plain):
                text = batch.column("text")[int(i)].as_py() if count[i] else None
                if not (languages and text and any(c.isalpha() for c in text)):
                    lang[i], score[i] = "und", 0.0
            keys = [batch.column(c) for c in passed]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(lang.tolist(), pa.string()), pa.array(score)], [*passed, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: dict, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    spark = docs.sparkSession
    kind = dict(docs.select(id_column).dtypes)[id_column]
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_column).alias("key"), F.col(text_column).alias("text"))
    out = rows.mapInArrow(_predictor(shared, ["key"]), f"key {kind}, lang_pred string, score double")
    return out.withColumnRenamed("key", id_column)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, where=~held_out("id", 4, 2))
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(held_out("doc_id", 4, 2), F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, model: dict, id_column: str = "doc_id", text_column: str = "text", min_score: float = 0.0) -> DataFrame:
    """Rows of ``docs``, unchanged, whose language is predicted with ``min_score`` at least; ``und`` is rejected whatever its score.

    The score of a language that wins its duels is 0.25 at least, so only a higher ``min_score`` rejects more than ``und``.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    score = _predictor(shared, [])

    def run(batches):
        for batch in batches:
            text = pa.RecordBatch.from_arrays([batch.column(text_column)], ["text"])
            for out in score(iter([text])):
                good = np.array(out.column("score")) >= min_score
                good &= np.array(out.column("lang_pred").to_pylist(), object) != "und"
                yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
