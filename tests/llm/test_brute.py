"""Operators against plain brute-force versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from catalogspark.llm import op2_jaccard, op3_toxicity, op4_embedding, op5_packing, op6_license, op7_quality, op8_url, op9_langid, op10_lm

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _near_docs(spark):
    """Copies edited more and more, a passage that many texts share, and one hot group."""
    r = random.Random(3)
    passage = prose(99, 60)
    texts = []
    for k in range(12):
        words = prose(100 + k, r.choice([6, 9, 20, 120, 400])).split()
        for _ in range(r.choice([1, 3, 40])):
            w = list(words)
            for _ in range(r.choice([0, 1, max(1, len(w) // 40), len(w) // 25])):
                w[r.randrange(len(w))] = r.choice(["swap", "other", "new"])
            texts.append(" ".join(w))
    texts += [passage + " " + prose(500 + k, r.choice([4, 10, 20, 60])) for k in range(60)]
    r.shuffle(texts)
    return spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(5)


def _components(rows):
    sets = {}
    for k, t in rows:
        w = WORD.findall(t.lower())
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {k: k for k in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {k: (len(s), top(k)) for k, s in sets.items()}


def test_jaccard(spark):
    docs = _near_docs(spark)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op2_jaccard.similar_components(docs).collect()}
    want = _components([(r[0], r[1]) for r in docs.collect()])
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)
    kept = {r["doc_id"] for r in op2_jaccard.keep_one(docs).collect()}
    assert kept == {c for _, c in want.values()}


def _swapped(n: int) -> str:
    """The first 2 ** n letters of the sequence of Thue and Morse over a and b."""
    return "".join("ab"[bin(i).count("1") % 2] for i in range(1 << n))


def test_jaccard_of_words_that_polynomials_confuse(spark):
    w = _swapped(11)
    docs = spark.createDataFrame([(1, w), (2, w.translate(str.maketrans("ab", "ba"))), (3, w + " x")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["component_id"] for r in op2_jaccard.similar_components(docs).collect()} == {1: 1, 2: 2, 3: 3}


def test_keep_one_tells_rows_apart(spark):
    t, u = prose(11, 60), prose(12, 60)
    rows = [(2, t, "a"), (6, t, "b"), (6, u, "c"), (7, u + " x", "d"), (8, u, "e"), (8, u, "e"), (None, t, "f"), (9, "", "g"), (9, "", "g"), (10, None, "h"), (11, prose(13, 60), "i"), (11, prose(13, 60), "j")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, h string")
    got = [(r["doc_id"], r["h"]) for r in op2_jaccard.keep_one(docs).collect()]
    assert sorted(x for x in got if x[0] != 11) == [(2, "a"), (6, "c"), (9, "g"), (9, "g"), (10, "h")] and sum(x[0] == 11 for x in got) == 1


def test_long_lists_in_blocks(spark):
    """Members of a long list meet across blocks, and each pair once."""
    import numpy as np

    sets = [list(range(k, k + 40)) for k in range(0, 60, 1)]
    one = spark.createDataFrame([(i, len(s), bytearray(op2_jaccard._sketches(np.array(s, np.uint64), np.array([0, len(s)]))[0])) for i, s in enumerate(sets)], "node bigint, n bigint, sketch binary")
    left = spark.createDataFrame([(7, i, i) for i in range(len(sets))] + [(9, 0, 0), (9, 1, 1)], "list bigint, node bigint, part bigint")
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * (40 - (j - i)) >= 75 * (40 + (j - i))}
    for block in (8, 1024):
        got = [(r["a"], r["b"]) for r in op2_jaccard._in_long_lists(left, one, block).collect()]
        assert len(got) == len(set(got)) and want <= set(got)


def test_embedding(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 16))
    x[300:420] = x[0] + rng.standard_normal((120, 16)) * 0.15
    x[420:450] = x[1] * 2
    x[450:560] = x[2:112] + rng.standard_normal((110, 16)) * 0.2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: r for r in op4_embedding.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    found = np.array([got[i]["n_links"] for i in range(600)])
    assert (found <= link.sum(1)).all() and found.sum() >= 0.95 * link.sum()
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in got)


def test_packing(spark):
    r = random.Random(2)
    rows = [(i, prose(i, r.choice([3, 40, 90, 130])), f"s{r.choice([0, 0, 0, 1, 2, 3])}") for i in range(300)] + [(1000 + i, prose(7, 50), "t") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = op5_packing.pack(docs, capacity=128, per_source=2, shard_tokens=6000).collect()
    source = {i: s for i, _, s in rows}
    bins = defaultdict(list)
    for p in out:
        bins[p["bin_id"]].append(p)
    assert Counter(p["doc_id"] for p in out) == Counter({i: -(-len(t.split()) // 128) for i, t, _ in rows})
    for members in bins.values():
        assert sum(p["tokens"] for p in members) <= 128
        assert max(Counter(source[p["doc_id"]] for p in members).values()) <= 2
        assert sum(p["doc_id"] >= 1000 for p in members) <= 1
        at = 0
        for p in sorted(members, key=lambda p: p["bin_offset"]):
            assert p["bin_offset"] == at
            at += p["tokens"]


def test_best_fit_order():
    r = random.Random(5)
    pieces = sorted(((r.randint(1, 60), r.choice("ab") + str(r.randint(0, 5)), r.randint(0, 40)) for _ in range(400)), key=lambda p: -p[0])
    got = op5_packing.best_fit(pieces, 100, 2)
    bins: list = []
    for (n, s, c), (b, at) in zip(pieces, got):
        able = [(room, i) for i, (room, src, cl) in enumerate(bins) if room >= n and src[s] < 2 and c not in cl]
        want = min(able)[1] if able else len(bins)
        if want == len(bins):
            bins.append([100, Counter(), set()])
        assert b == want and at == 100 - bins[b][0]
        bins[b][0] -= n
        bins[b][1][s] += 1
        bins[b][2].add(c)


def test_quality_statistics(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in op7_quality.statistics(docs).collect()}
    for k, t in docs.collect():
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        c = Counter(zip(w, w[1:], w[2:]))
        covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered))


def test_quality_windows_are_compared_by_words(spark, monkeypatch):
    """With a hash that gives all windows one number, repeats are still found by their words."""
    monkeypatch.setattr(op7_quality, "_REPEATS", op7_quality._REPEATS.replace("xxhash64(w[i], w[i + 1], w[i + 2])", "cast(7 AS bigint)"))
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c x a b c y z a b c")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["n_repeat_words"] for r in op7_quality.statistics(docs).collect()} == {1: 0, 2: 9}


def test_quality_list(spark):
    r = random.Random(4)
    rows = [(i, " ".join(prose(i, 80).split() + ["#", "$"] * (r.randint(8, 20) if i % 4 == 0 else 0))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i, _ in rows], "doc_id bigint, quality int")
    stats = op7_quality.statistics(docs)
    rules = op7_quality.learn(stats, labels)
    assert rules
    out = stats.withColumn("rule", op7_quality.verdict(rules)).collect()
    assert {x["doc_id"] for x in out if x["rule"]} == {i for i, _ in rows if i % 4 == 0}


def test_url_rules(spark):
    r = random.Random(6)
    rows = [(i, f"http://{r.choice(['a', 'b', 'c'])}.example.net/{r.choice(['x', 'y'])}/{i}") for i in range(900)]
    poor = lambda u: "//a." in u and "/y/" in u
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = spark.createDataFrame([(i, int(not poor(u))) for i, u in rows], "doc_id bigint, quality int")
    rules = op8_url.mine(pages, labels)
    assert [sorted(x["items"]) for x in rules.collect()] == [[["h:a"], ["p:y"]]]
    got = {x["page_id"]: x["verdict"] for x in op8_url.judge(pages, rules, []).collect()}
    assert got == {i: "block" if poor(u) else "allow" for i, u in rows}


def test_a_template_of_many_keys(spark):
    """25 keys that come together are one item, and any of them stands for it; nothing explodes."""
    keys = "&".join(f"k{i}=1" for i in range(25))
    rows = [(i, f"http://bad.example.net/p?{keys}" if i % 3 == 0 else f"http://good.example.net/p{i % 7}?id={i}") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    rules = op8_url.mine(pages, spark.createDataFrame([(i, int(i % 3 != 0)) for i, _ in rows], "doc_id bigint, quality int"))
    new = spark.createDataFrame([(1, "http://x.net/?k7=2"), (2, "http://good.example.net/p1?id=1")], "page_id bigint, url string")
    assert {r["page_id"]: r["verdict"] for r in op8_url.judge(new, rules, []).collect()} == {1: "block", 2: "allow"}


def test_language_and_toxicity(spark, sf_dir):
    """Held-out accuracy."""
    d = sf_dir.replace("sf0.001", "sf0.1")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = op9_langid.query(spark, d).join(docs, "doc_id").where("held_out").select("lang", "lang_pred").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)
    got = op3_toxicity.query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").select("toxic", "predicted").collect()
    assert sum(r["toxic"] == r["predicted"] for r in got) >= 0.97 * len(got)


def test_swapped_groups_score_alike(spark):
    rows = [(i, f"the {g} people are awful vermin {i}" if i % 2 else f"the {h} people are at the market {i}") for i, (g, h) in enumerate([("muslim", "christian")] * 200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = op3_toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, toxic int"))
    test = spark.createDataFrame([(1, "the muslim people are at the market"), (2, "the christian people are at the market")], "doc_id bigint, text string")
    a, b = (r["score"] for r in op3_toxicity.score(test, model).orderBy("doc_id").collect())
    assert abs(a - b) < 0.1 and a < 0.5


def test_language_model(spark):
    rows = [(i, prose(i % 37, 30 + i % 11)) for i in range(120)] + [(200, "ONE one"), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    good = {i for i, _ in rows if i % 5 == 0}
    got = {r["doc_id"]: r for r in op10_lm.score(docs, spark.createDataFrame([(i,) for i in good], "doc_id bigint")).collect()}
    words = {i: [None, *WORD.findall(t.lower())] for i, t in rows}
    v = len({w for x in words.values() for w in x[1:]})
    pair, ctx = [Counter(), Counter()], [Counter(), Counter()]
    for i, x in words.items():
        for g in range(1 + (i in good)):
            pair[g].update(zip(x, x[1:]))
            ctx[g].update(x[:-1])
    a = op10_lm.SMOOTHING
    for i, x in words.items():
        loss = [sum(-math.log((pair[g][p] + a) / (ctx[g][p[0]] + a * v)) for p in zip(x, x[1:])) for g in (0, 1)]
        assert got[i]["n_tokens"] == len(x) - 1
        assert abs(got[i]["score"] - (loss[1] - loss[0]) / max(1, len(x) - 1)) < 1e-9


def test_license(spark):
    rows = [(1, "Intro\nReleased under the MIT License.\nx"), (2, "Licensed under CC BY-NC 4.0."), (3, "a driving license is needed"), (4, "This work is licensed under the GNU General Public License, version 3."), (5, "Licensed under the Foo Bar License of 1999")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r["doc_id"]: [(s["family"], s["start"]) for s in r["spans"] if s["family"] != "unknown" and s["matched"] >= op6_license.CONFIRM] for r in op6_license.scan(docs, op6_license.fit(docs)).collect()}
    assert out == {1: [("mit", 6)], 2: [("cc-by-nc", 0)], 3: [], 4: [("gpl", 0)], 5: []}


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {r["doc_id"] for r in out}
    assert ids and ids <= {r[0] for r in docs.select("doc_id").collect()}
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:2]:
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == docs.columns
    want = _components([(r["doc_id"], r["text"]) for r in kept.collect()])
    assert ids == {c for _, c in want.values()}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).collect() == []
