"""Licence scan by a trained paragraph classifier.

Features of a paragraph are its words, word pairs and word triples, hashed and counted; a softmax regression over
the licence families, "none" and "unknown" is trained on the templates below with words left out or put
in, on notices that name other licences (``OTHER``, "unknown"), and on paragraphs of ordinary texts that share less than ``LIKE`` of every
template's triples ("none"). The score's temperature is calibrated on examples kept
back, and a paragraph whose calibrated probability is below ``KNOWN`` is of the class "unknown" too.
A prediction is confirmed where the paragraph holds ``CONFIRM`` of the word triples of some template of
the family, weighted alike; only confirmed predictions count as licences.

A paragraph is a block of lines between blank lines; comment marks at the lines' ends are not words. A block is read in two ways:
line by line, since a notice may be a line of its own, in overlapping windows of ``WINDOW`` words where a line is longer; and with its lines
joined, where runs of words that hold ``CONFIRM`` of a template across a line's end are classified as wrapped notices. Lines
that lie in a wrapped notice don't count beside it. Whole texts are read and every window of every line is classified.
Null and empty texts have no paragraph. Repeated
rows are rows of their own. Training reads all windows and lines of ``SAMPLE`` ordinary documents at most, picked by a hash.

A word is a run of ASCII letters and digits and of characters from U+00C0 on, but for those of general punctuation (U+2000 to U+206F); A-Z and
the capitals of Latin-1 are lower-cased. Lines are classified many at a time over the texts' bytes; what isn't "none" is then read as words.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GROUP_BYTES, SPACE, fold_latin, groups, mix, span_hashes, spans, table, text_buffers

NAME = "op6_license"
DIMS = 1 << 15
SAMPLE = 150
KNOWN, CONFIRM, LIKE = 0.6, 0.7, 0.2
#: Words of a window, and from one window's start to the next one's.
WINDOW, STEP = 60, 40
#: Notices by which licences are declared.
TEMPLATES = {
    "mit": [
        "spdx license identifier mit",
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
    ],
    "apache": [
        "spdx license identifier apache",
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    ],
    "bsd": [
        "spdx license identifier bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "released under the bsd license",
        "use of this source code is governed by a bsd style license",
    ],
    "gpl": [
        "spdx license identifier gpl",
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "licensed under the gnu general public license version 2",
    ],
    "lgpl": ["spdx license identifier lgpl", "licensed under the gnu lesser general public license", "this library is free software under the terms of the gnu lesser general public license"],
    "mpl": ["spdx license identifier mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"],
    "cc-by": ["spdx license identifier cc by 4 0", "licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa": ["spdx license identifier cc by sa", "licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc-by-nc": ["spdx license identifier cc by nc", "licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "proprietary": ["all rights reserved", "no part of this work may be reproduced without written permission of the copyright holder"],
}
#: Notices of other licences, whose names are ordinary words.
OTHER = [
    "licensed under the {} license",
    "licensed under the {} public license {}",
    "released under the {} license",
    "this work is licensed under the {} license version {}",
    "use of this source code is governed by the {} license",
    "subject to the terms of the {} public license",
    "spdx license identifier {}",
]
FAMILIES = ["none", *TEMPLATES, "unknown"]
_FOLD = str.maketrans({i: i + 32 for i in [*range(65, 91), *range(0xC0, 0xDF)] if i != 0xD7})
_WORDS = re.compile("[a-z0-9\u00c0-\u1fff\u2070-\U0010ffff]+")
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_PAIR, _TRIPLE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Words by which comments begin; other marks are no words anyway.
_MARKS = {"rem", "dnl"}


def _words(text: str) -> list[str]:
    return _WORDS.findall(text.translate(_FOLD))


def _word_spans(data: np.ndarray, offsets: np.ndarray):
    """(folded bytes, starts, ends, row) of the words of ``_words``; a long text is cut at blanks."""
    data = fold_latin(data)
    n = len(data)
    latin = np.flatnonzero(data[: max(n - 1, 0)] == 0xC2)
    marks = np.flatnonzero(data[: max(n - 2, 0)] == 0xE2)
    marks = marks[(data[marks + 1] == 0x80) | ((data[marks + 1] == 0x81) & (data[marks + 2] < 0xB0))]
    data[np.concatenate([latin, latin + 1, marks, marks + 1, marks + 2])] = 0x20
    got = []
    for a, b in groups(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        while lo < hi:
            to = hi
            if hi - lo > 2 * GROUP_BYTES:
                to = lo + GROUP_BYTES
                while to < hi and not SPACE[data[to]]:
                    to += 1
            s, e, r = spans(data[lo:to], np.clip(offsets[a : b + 1], lo, to) - lo, _INSIDE)
            got.append((s + lo, e + lo, r + a, span_hashes(data[lo:to], s, e)))
            lo = to
    if not got:
        z = np.zeros(0, np.int64)
        return data, z, z, z, np.zeros(0, np.uint64)
    return data, *(np.concatenate(x) for x in zip(*got, strict=True))


def _hash_words(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw], dtype=np.int64)
    return span_hashes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], ends])[:-1].astype(np.int64), ends)


def _grams(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, of the pairs and of the triples that begin at each word."""
    pairs = mix(h[:-1] * _PAIR + h[1:])
    return h, pairs, mix(pairs[:-1] * _TRIPLE + h[2:])


def features(words: list[str]) -> np.ndarray:
    h = _hash_words(words)
    return (np.concatenate(_grams(h)) % np.uint64(DIMS)).astype(np.int64) if len(h) else np.zeros(0, np.int64)


def _triples(words: list[str]) -> set:
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))}


_MADE = {f: [_triples(_words(t)) for t in ts] for f, ts in TEMPLATES.items()}
_KNOWN_TRIPLES = np.unique(np.concatenate([_grams(_hash_words(_words(t)))[2] for ts in TEMPLATES.values() for t in ts]))


def confirmed(words: list[str], family: str) -> float:
    """Largest share of a template's triples that the paragraph holds."""
    own = _triples(words)
    return max((len(own & t) / len(t) for t in _MADE.get(family, [])), default=0.0)


def _examples(ordinary: list[str], seed: int = 5):
    """(words, family): templates whole and varied, inside ordinary words or alone, notices of other licences, and ordinary paragraphs."""
    rnd = np.random.default_rng(seed)
    loose = [w for x in ordinary for w in _words(x)] or ["the", "of", "and"]
    some = lambda n: [loose[j] for j in rnd.integers(len(loose), size=n)]
    out = [(_words(x), 0) for x in ordinary if _words(x)]
    for k, f in enumerate(FAMILIES[1:-1], 1):
        for t in TEMPLATES[f]:
            base = _words(t)
            for i in range(24):
                words = [w for w in base if rnd.random() > (0.08 if i else 0)]
                if i % 3 == 1:
                    more = some(int(rnd.integers(1, 12)))
                    words = [*more[: len(more) // 2], *words, *more[len(more) // 2 :]]
                if words:
                    out.append((words, k))
    for t in OTHER:
        for i in range(48):
            named = _words(t.replace("{}", " ".join(some(int(rnd.integers(1, 4)))), 1).replace("{}", str(int(rnd.integers(1, 9)))))
            out.append(([*some(i % 3), *named, *some(i % 4)], len(FAMILIES) - 1))
    return out


def train(ordinary: list[str], rounds: int = 100, l2: float = 1e-4) -> dict:
    examples = _examples(sorted(ordinary))
    keep = np.random.default_rng(9).random(len(examples)) < 0.2
    x = [features(w) for w, _ in examples]
    y = np.array([k for _, k in examples])
    size = np.array([len(v) for v in x])
    row, col = np.repeat(np.arange(len(x)), size), np.concatenate(x)
    value = (1 / np.sqrt(np.maximum(size, 1)))[row]
    used, col = np.unique(col, return_inverse=True)
    fit = ~keep
    w, b = np.zeros((len(used), len(FAMILIES))), np.zeros(len(FAMILIES))
    # half the weight is that of ordinary texts
    prior = np.array([0.5, *[0.5 / (len(FAMILIES) - 1)] * (len(FAMILIES) - 1)])
    share = fit / np.bincount(y[fit], minlength=len(FAMILIES)).clip(1)[y] * prior[y]
    goal = np.eye(len(FAMILIES))[y]

    def logits():
        z = np.zeros((len(x), len(FAMILIES)))
        for k in range(len(FAMILIES)):
            z[:, k] = np.bincount(row, w[col, k] * value, len(x)) + b[k]
        return z

    for _ in range(rounds):
        g = (_softmax(logits()) - goal) * share[:, None]
        for k in range(len(FAMILIES)):
            w[:, k] -= 20.0 * (np.bincount(col, g[row, k] * value, len(used)) + l2 * w[:, k])
        b -= 2.0 * g.sum(0)
    z = logits()[keep]
    loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(z)), y[keep]] + 1e-12).mean()
    heat = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss) if keep.any() else 1.0
    full = np.zeros((DIMS, len(FAMILIES)), np.float32)
    full[used] = w
    return {"w": full, "b": b, "heat": heat}


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _said(k: int, p: float) -> str:
    return FAMILIES[k] if p >= KNOWN else "unknown"


def _probabilities(h: np.ndarray, first: np.ndarray, last: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(class, probability) of the windows [first, last) of the words, in order of their starts."""
    kind, sure = np.zeros(len(first), np.int64), np.zeros(len(first))
    for i in range(0, len(first), 2048):
        a, b = first[i : i + 2048], last[i : i + 2048]
        lo = int(a[0])
        z = np.zeros((len(a), len(FAMILIES)))
        for n, g in enumerate(_grams(h[lo : int(b.max())])):
            total = np.zeros((len(g) + 1, len(FAMILIES)))
            np.cumsum(model["w"][(g % np.uint64(DIMS)).astype(np.int64)], axis=0, dtype=np.float64, out=total[1:])
            z += total[np.minimum(np.maximum(b - n, a) - lo, len(g))] - total[np.minimum(a - lo, len(g))]
        count = np.maximum(b - a, 0) + np.maximum(b - a - 1, 0) + np.maximum(b - a - 2, 0)
        p = _softmax((z / np.sqrt(np.maximum(count, 1))[:, None] + model["b"]) / model["heat"])
        kind[i : i + 2048] = p.argmax(1)
        sure[i : i + 2048] = p.max(1)
    return kind, sure


def classify(words: list[str], model: dict) -> tuple[str, float]:
    """Family, "none" or "unknown", and its calibrated probability."""
    k, p = _probabilities(_hash_words(words), np.array([0]), np.array([len(words)]), model)
    return _said(int(k[0]), float(p[0])), float(p[0])


_BLANK = re.compile(r"[\s/*#;%|!>-]*$")
_AT: dict[tuple, list[tuple[str, int]]] = {}
for _f, _made in _MADE.items():
    for _k, _t in enumerate(_made):
        for _x in _t:
            _AT.setdefault(_x, []).append((_f, _k))


def _blocks(text: str):
    """Blocks of lines between blank ones, comment marks or not: (number, start, line) for each line."""
    block, at = [], 0
    for i, line in enumerate(text.split("\n")):
        if _BLANK.match(line):
            if block:
                yield block
            block = []
        else:
            block.append((i, at, line))
        at += len(line) + 1
    if block:
        yield block


def _windows(words: list[str]) -> list[list[str]]:
    return [words[lo : lo + WINDOW] for lo in range(0, max(1, len(words)), STEP)] if len(words) > WINDOW else [words]


def _wrapped(block: list[tuple[int, int, str]]) -> list[tuple[int, int, list[str], str]]:
    """(first line, last line, words, family) of the runs in the joined lines that hold ``CONFIRM`` of a template and cross a line's end."""
    words, of = [], []
    for i, (_, _, line) in enumerate(block):
        own = _words(line)
        if own and own[0] in _MARKS:
            own = own[1:]
        words += own
        of += [i] * len(own)
    hits: dict[tuple[str, int], list[int]] = {}
    for i in range(len(words) - 2):
        for template in _AT.get(tuple(words[i : i + 3]), ()):
            hits.setdefault(template, []).append(i)
    found = []
    for (family, k), at in hits.items():
        need, reach = CONFIRM * len(_MADE[family][k]), len(_MADE[family][k]) + 8
        lo = 0
        while lo < len(at):
            hi = lo
            while hi + 1 < len(at) and at[hi + 1] - at[lo] < reach:
                hi += 1
            if len({tuple(words[i : i + 3]) for i in at[lo : hi + 1]}) < need:
                lo += 1
                continue
            a, b = at[lo], at[hi] + 3
            if of[a] != of[b - 1]:
                found.append((of[a], of[b - 1], words[a:b], family))
            lo = hi + 1
    return sorted(found, key=lambda x: (x[0], x[1], x[3]))


def _line_windows(h, starts, rows, offsets, breaks, model):
    """(row, line of the row, first word, last word, class, probability) of the windows of lines that aren't "none"."""
    line = np.searchsorted(breaks, starts)
    new = np.concatenate([[True], (line[1:] != line[:-1]) | (rows[1:] != rows[:-1])])
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate([first, [len(h)]]))
    count = np.where(size > WINDOW, -(-size // STEP), 1)
    of = np.repeat(np.arange(len(first)), count)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    a = first[of] + nth * STEP
    b = np.minimum(a + WINDOW, (first + size)[of])
    kind, p = _probabilities(h, a, b, model)
    at = np.flatnonzero((kind != 0) | (p < KNOWN))
    row = rows[a[at]]
    own = line[a[at]] - np.searchsorted(breaks, offsets[row])
    return zip(row.tolist(), own.tolist(), a[at].tolist(), b[at].tolist(), kind[at].tolist(), p[at].tolist(), strict=True)


def _with_triples(h, starts, rows, breaks) -> set[int]:
    """Rows that hold some triple of a template, with the words by which comments begin or without."""
    mark = np.isin(h, _hash_words(sorted(_MARKS)))
    line = np.searchsorted(breaks, starts[mark])
    before = np.flatnonzero(mark) - 1
    head = (before < 0) | (rows[before] != rows[mark]) | (np.searchsorted(breaks, starts[before]) != line)
    mark[np.flatnonzero(mark)[~head]] = False
    h, rows = h[~mark], rows[~mark]
    at = np.flatnonzero(np.isin(_grams(h)[2], _KNOWN_TRIPLES))
    return set(rows[at[rows[at] == rows[at + 2]]].tolist())


def _assemble(text: str, lines: list[tuple[int, list[str], int, float]], wrap: bool, model: dict) -> list[tuple[int, str, float, float]]:
    """Spans of one text from its lines' windows, (line, words, class, probability), and its wrapped notices."""
    found = []
    by_line: dict[int, list] = {}
    for i, words, k, p in lines:
        by_line.setdefault(i, []).append((words, k, p))
    for block in _blocks(text):
        inside: set[int] = set()
        seen: set[tuple[str, int]] = set()
        if wrap and len(block) > 1:
            for first, last, words, family in _wrapped(block):
                said, p = classify(words, model)
                own = {(family, i) for i in range(first, last + 1)}
                if said == family and not seen & own:
                    found.append((block[first][1], family, p, confirmed(words, family)))
                    seen |= own
                    inside |= set(range(first, last + 1))
        for i, (number, at, _) in enumerate(block):
            for words, k, p in by_line.get(number, ()):
                family = _said(k, p)
                sure = confirmed(words, family)
                # of a wrapped notice's lines only what confirms another family counts
                if not (i in inside and (sure < CONFIRM or (family, i) in seen)):
                    found.append((at, family, p, sure))
    return sorted(found, key=lambda x: x[0])


def _scan(column, model: dict) -> list[list[tuple[int, str, float, float]]]:
    """For each text of an Arrow column its spans: (start, family, probability, share of the template)."""
    out: list[list] = [[] for _ in range(len(column))]
    data, offsets = text_buffers(column)
    for a, b in groups(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        own = offsets[a : b + 1] - lo
        folded, starts, ends, rows, h = _word_spans(data[lo:hi], own)
        if not len(h):
            continue
        breaks = np.flatnonzero(folded == 0x0A)
        lines: dict[int, list] = {}
        for row, line, x, y, k, p in _line_windows(h, starts, rows, own, breaks, model):
            words = [folded[starts[i] : ends[i]].tobytes().decode() for i in range(x, y)]
            lines.setdefault(row, []).append((line, words, k, p))
        wrap = _with_triples(h, starts, rows, breaks)
        for row in sorted(wrap | set(lines)):
            out[a + row] = _assemble(column[a + row].as_py(), lines.get(row, []), row in wrap, model)
    return out


def _like(words: list[str]) -> bool:
    """Whether a passage shares ``LIKE`` of some template's triples."""
    hits: dict[tuple[str, int], int] = {}
    for x in _triples(words):
        for t in _AT.get(x, ()):
            hits[t] = hits.get(t, 0) + 1
    return any(n >= LIKE * len(_MADE[f][k]) for (f, k), n in hits.items())


def _ordinary(text: str | None) -> list[str]:
    """Passages to learn "none" from: the windows of each line, and of each block's joined lines, that are unlike all templates."""
    out = []
    for block in _blocks(text or ""):
        for line in [*(x for _, _, x in block), *([" ".join(x for _, _, x in block)] if len(block) > 1 else [])]:
            out += [" ".join(w) for w in _windows(_words(line)) if w and not _like(w)]
    return out


def fit(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id", sample: int = SAMPLE) -> dict:
    n = docs.count()
    share = min(1.0, sample / max(n, 1))
    some = docs.where(F.pmod(F.xxhash64(id_column, F.lit(6)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x for t in batch.column("text") for x in _ordinary(t.as_py())], pa.string())], ["x"])

    return train([r["x"] for r in some.select(F.col(text_column).alias("text")).mapInArrow(run, "x string").collect()])


def scan(docs: DataFrame, model: dict, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id_column, spans): for each row the paragraphs that may be licences, with start, family, probability and the share of the template found."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kind = dict(docs.select(id_column).dtypes)[id_column]
    span = pa.list_(pa.struct([("start", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("matched", pa.float64())]))

    def run(batches):
        for batch in batches:
            out = [[{"start": a, "family": f, "probability": p, "matched": m} for a, f, p, m in spans] for spans in _scan(batch.column("text"), shared.value)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, span)], ["key", "spans"])

    rows = docs.select(F.col(id_column).alias("key"), F.col(text_column).alias("text"))
    out = rows.mapInArrow(run, f"key {kind}, spans array<struct<start:bigint,family:string,probability:double,matched:double>>")
    return out.withColumnRenamed("key", id_column)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = scan(docs, fit(docs))
    sure = F.filter("spans", lambda s: (s["family"] != "unknown") & (s["matched"] >= CONFIRM))
    first = sure[F.lit(0)]
    return spans.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda s: s["family"]))), ",").alias("licenses"),
        F.size(sure).cast("bigint").alias("n_licenses"),
        F.size(F.filter("spans", lambda s: ~((s["family"] != "unknown") & (s["matched"] >= CONFIRM)))).cast("bigint").alias("n_unconfirmed"),
        F.when(F.size(sure) > 0, first["start"]).alias("first_start"),
        F.when(F.size(sure) > 0, F.round(first["probability"], 6)).alias("probability"),
    )
