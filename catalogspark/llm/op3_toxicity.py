"""Toxicity by a counterfactual-regularised logistic classifier.

Features are the distinct lower-case letter runs of a text and their six-byte prefixes,
hashed to ``DIMS``. The loss is the logistic loss, an L1 and a small L2 term, and the mean
square of score changes over counterfactual pairs: each labelled sentence that names a group
is paired with the same sentence naming another group of the same kind. For a linear score
such a pair differs by the weights of all features of the two terms, whole words and prefixes. What the
penalty leaves of that difference is taken off the whole-word weights after the fit, so group names of a kind end
with equal sums and a swap doesn't move the score. (Where another word of the text has a term's six-byte
prefix, the text keeps that feature after a swap, and the prefix's weight remains as a difference.)

The fit sees a bounded sample: ``SAMPLE`` labelled rows at most, picked by a hash of the id.
Scoring reads every whole text. Null and empty texts get the score of a text without features.
"""

from __future__ import annotations

import re
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LETTER, _U, fold_latin, groups, span_hashes, spans, table, text_buffers
from .op9_langid import held_out

NAME = "op3_toxicity"
BITS = 18
DIMS = 1 << BITS
SAMPLE = 10_000
THRESHOLD = 0.7
#: Group names that may be swapped for each other, by kind.
IDENTITY = {
    "religion": ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist"],
    "orientation": ["gay", "lesbian", "straight", "bisexual"],
    "gender": ["women", "men", "transgender"],
    "ethnicity": ["black", "white", "asian", "latino", "african", "european", "arab"],
    "frauen_maenner": ["frauen", "männer"],
    "religion_de": ["christen", "muslime", "juden", "atheisten"],
    "femmes_hommes": ["femmes", "hommes"],
    "religion_fr": ["chrétiens", "musulmans", "juifs", "athées"],
    "mujeres_hombres": ["mujeres", "hombres"],
    "religion_es": ["cristianos", "musulmanes", "judíos", "ateos"],
}


def _hashed(data: np.ndarray, offsets: np.ndarray):
    data = fold_latin(data) if len(data) else data
    s, e, row = spans(data, offsets, LETTER)
    word = span_hashes(data, s, e) >> _U(64 - BITS)
    long = e - s > 6
    stem = span_hashes(data, s[long], s[long] + 6) ^ _U(0x5BD1E995)
    return np.concatenate([word, stem >> _U(64 - BITS)]).astype(np.int64), np.concatenate([row, row[long]])


def term_features(term: str) -> list[int]:
    """The features of a term: its word first, then its prefix if it has one."""
    raw = np.frombuffer(term.encode(), np.uint8)
    return _hashed(raw, np.array([0, len(raw)]))[0].tolist()


def _distinct(column):
    """(feature, row), each pair once within a group; a very long text may give a pair again."""
    data, offsets = text_buffers(column)
    for a, b in groups(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        while lo < hi:
            to = min(hi, lo + (4 << 20))
            if to < hi:
                stop = np.flatnonzero(~LETTER[data[lo:to]])
                to = lo + int(stop[-1]) if len(stop) and stop[-1] else to
            f, r = _hashed(data[lo:to], np.clip(offsets[a : b + 1] - lo, 0, to - lo))
            yield f, r + a
            lo = to


_SENTENCE = re.compile(r"[.!?\n]+")
_LETTERS = re.compile(r"[^\W\d_]+")


def _sampler(kinds: dict[str, str]):
    def run(batches):
        for batch in batches:
            rows = [[] for _ in range(batch.num_rows)]
            for f, r in _distinct(batch.column("text")):
                order = np.argsort(r, kind="stable")
                f, r = f[order], r[order]
                cut = np.flatnonzero(np.diff(r, prepend=-1))
                for s, e in zip(cut, [*cut[1:], len(r)]):
                    rows[r[s]].append(np.unique(f[s:e]))
            blobs, named = [], []
            for i, parts in enumerate(rows):
                blobs.append((np.unique(np.concatenate(parts)) if parts else np.zeros(0)).astype("<i4").tobytes())
                text = (batch.column("text")[i].as_py() or "").lower()
                named.append([w for x in _SENTENCE.split(text) for w in {*_LETTERS.findall(x)} if w in kinds] if any(k in text for k in kinds) else [])
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(blobs, pa.binary()), pa.array(named, pa.list_(pa.string()))], ["y", "x", "named"])

    return run


def train(examples: list[tuple[int, np.ndarray]], swaps: list[tuple[str, str, float]], l1: float = 3e-4, l2: float = 1e-4, fairness: float = 5.0, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and constant by accelerated proximal descent. swaps: pairs of terms with their weights."""
    w_full = np.zeros(DIMS, np.float32)
    y = np.array([t for t, _ in examples], float)
    if not len(y) or y.min() == y.max():
        return w_full, float(-4.0 if not len(y) or y.max() == 0 else 4.0)
    size = np.array([len(x) for _, x in examples])
    flat = np.concatenate([x for _, x in examples]).astype(np.int64)
    seen = np.bincount(flat, minlength=DIMS)
    weight = np.array([n for _, _, n in swaps], float)
    weight = weight / weight.sum() if len(weight) else weight
    # a pair's gap is the sum of its entries' signs times the weights: what either text has and the other has not
    entries = [(i, f, sign) for i, (a, b, _) in enumerate(swaps) for x, y_, sign in ((a, b, 1.0), (b, a, -1.0)) for f in {*term_features(x)} - {*term_features(y_)}]
    pair, term, sign = (np.array(c, t) for c, t in zip(zip(*entries) if entries else ((), (), ()), (np.int64, np.int64, float)))
    used = np.flatnonzero((seen >= min(3, max(1, len(y) // 50))) | (np.bincount(term, minlength=DIMS) > 0))
    at = np.full(DIMS, -1)
    at[used] = np.arange(len(used))
    row = np.repeat(np.arange(len(y)), size)
    col = at[flat]
    row, col = row[col >= 0], col[col >= 0]
    term = at[term]
    sample = np.where(y == 1, 0.5 / max(y.mean(), 0.05), 1.0) / len(y)
    dot = lambda w, b: np.bincount(row, w[col], len(y)) + b
    z, w, b, zb, t = np.zeros(len(used)), np.zeros(len(used)), -2.0, -2.0, 1.0
    step = 0.5

    def smooth(v, c):
        m = dot(v, c)
        value = (sample * (np.logaddexp(0, m) - y * m)).sum() + l2 / 2 * (v @ v)
        gap = np.bincount(pair, sign * v[term], len(weight)) if len(weight) else np.zeros(0)
        return value + fairness / 2 * (weight * gap * gap).sum(), m, gap

    for _ in range(rounds):
        value, m, gap = smooth(z, zb)
        r = sample * (1 / (1 + np.exp(-np.clip(m, -40, 40))) - y)
        g = np.bincount(col, r[row], len(used)) + l2 * z
        if len(gap):
            g += fairness * np.bincount(term, sign * (weight * gap)[pair], len(used))
        gb = r.sum()
        while True:
            new = z - step * g
            new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
            nb = zb - step * gb
            d, db = new - z, nb - zb
            if step < 1e-6 or smooth(new, nb)[0] <= value + g @ d + gb * db + (d @ d + db * db) / (2 * step) + 1e-12:
                break
            step /= 2
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, zb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t, step = new, nb, t2, step * 1.3
    w_full[used] = w
    return w_full, float(b)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, identity: dict | None = None) -> tuple[np.ndarray, float]:
    """Model from ``docs (doc_id, text)`` and ``labels (doc_id, toxic)``; null labels don't count, of repeated labels the highest holds."""
    identity = IDENTITY if identity is None else identity
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    n = known.count()
    share = min(1.0, sample / max(n, 1))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    kinds = {w: k for k, ws in identity.items() for w in ws}
    # ``picked`` has about ``sample`` rows however large the labels are, so it may be broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(F.col("y").cast("int").alias("y"), "text")
    got = rows.mapInArrow(_sampler(kinds), "y int, x binary, named array<string>").collect()
    got.sort(key=lambda r: (r["y"], bytes(r["x"])))
    count = {w: 1.0 for w in kinds}
    for r in got:
        for w in r["named"] or []:
            count[w] += 1
    swaps = [(a, b, count[a]) for ws in identity.values() for a, b in permutations(ws, 2)]
    weights, bias = train([(r["y"], np.frombuffer(r["x"], "<i4")) for r in got], swaps)
    return level(weights, identity), bias


def level(weights: np.ndarray, identity: dict) -> np.ndarray:
    """``weights`` with the sums of each kind's terms made equal, by their whole-word features.

    A term may be another kind's prefix ("muslim" of "muslime"), so that a pass can undo what an earlier one made.
    """
    weights = weights.astype(np.float64)
    for _ in range(8):
        off = 0.0
        for ws in identity.values():
            total = [weights[[*{*term_features(w)}]].sum() for w in ws]
            for w, n in zip(ws, total):
                weights[term_features(w)[0]] += np.mean(total) - n
            off = max(off, np.ptp(total)) if ws else off
        if off < 1e-9:
            break
    return weights


def _scores(column, weights: np.ndarray, bias: float) -> np.ndarray:
    total = np.full(len(column), bias)
    seen: list[np.ndarray] = []
    for f, r in _distinct(column):
        hit = weights[f] != 0
        seen.append((r[hit] << BITS) | f[hit])
    if seen:
        key = np.unique(np.concatenate(seen))
        total += np.bincount(key >> BITS, weights[key & (DIMS - 1)], len(column))
    return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.select(id_column).dtypes)[id_column]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(_scores(batch.column("text"), *shared.value))], ["key", "score"])

    rows = docs.select(F.col(id_column).alias("key"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", id_column)


def keep_clean(docs: DataFrame, model: tuple[np.ndarray, float], text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, unchanged, with a score below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(text_column), *shared.value) < threshold))

    return docs.mapInArrow(run, docs.schema)


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, training_labels(spark, sf_dir)))
    return out.select("doc_id", F.coalesce(held_out("doc_id", 3, 1), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
