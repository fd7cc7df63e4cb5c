"""Mined url rules against brute force, on labels that depend on urls and pages of many items."""

import itertools
import random
from collections import Counter

from catalogspark.llm import op8_url


def test_baskets_hold_every_combination(spark):
    sizes = [1, 3, 4, 9, 11]
    sets = spark.createDataFrame([([f"{n}-{i}" for i in range(n)], True) for n in sizes], "items array<string>, poor boolean")
    rows = [set(r["items"]) for r in op8_url.baskets(sets, 3, 2).collect()]
    assert max(map(len, rows)) <= 6
    for n in sizes:
        own = [f"{n}-{i}" for i in range(n)]
        for some in itertools.combinations(own, min(3, n)):
            assert any(set(some) <= r for r in rows)
        assert set().union(*(r for r in rows if own[0] in r or own[-1] in r)) <= set(own)
    # 11 items are 6 blocks: a row for each 3 of them
    assert len(rows) == 1 + 1 + 1 + 10 + 20


def _brute(pages, least, confidence):
    n, bad = len(pages), sum(p for _, p in pages)
    of = {}
    for i, (own, _) in enumerate(pages):
        for t in own:
            of.setdefault(t, set()).add(i)
    same = {}
    for t, rows in of.items():
        same.setdefault(frozenset(rows), []).append(t)
    name = {min(ts): rows for rows, ts in same.items()}
    poor = {i for i, (_, p) in enumerate(pages) if p}
    items = {t: rows for t, rows in name.items() if len(rows & poor) >= int(least * confidence)}
    found = {}
    for size in range(1, op8_url.MOST_TOKENS + 1):
        for some in itertools.combinations(sorted(items), size):
            rows = set.intersection(*(set(items[t]) for t in some))
            hit = len(rows & poor)
            if hit >= least * confidence and hit / len(rows) >= confidence and hit / len(rows) > bad / n:
                found[some] = hit / len(rows)
    return {k: v for k, v in found.items() if not any(set(f) < set(k) and s >= v for f, s in found.items())}


def test_mined_rules_like_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(17)]
    rows, labels = [], []
    for i in range(400):
        path = [w for w in words if rng.random() < (0.5 if w in ("w15", "w16") else 0.8)]
        # two words that say little alone make a page poor together
        poor = "w15" in path and "w16" in path and rng.random() < 0.8 or rng.random() < 0.03
        rows.append((i, f"http://h.net/{'/'.join(path)}?u{i}=1"))
        labels.append((i, int(not poor)))
    assert Counter(len(u.split("/")) - 3 > 12 for _, u in rows)[True] > 100
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    rules = op8_url.mine(pages, spark.createDataFrame(labels, "doc_id bigint, quality int"), least=20, confidence=0.5)
    got = {tuple(sorted(min(ts) for ts in r["items"])): r["confidence"] for r in rules.collect()}
    seen = [({"h:h", "h:net", f"q:u{i}", *(f"p:{w}" for w in u.split("?")[0].split("/")[3:] if w)}, 1 - q) for (i, u), (_, q) in zip(rows, labels, strict=True)]
    want = _brute(seen, 20, 0.5)
    assert want and any({"p:w15", "p:w16"} <= set(k) for k in want)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
