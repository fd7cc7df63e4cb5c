"""Every operator on odd rows and on empty tables: defined results, one row for each input row."""

import pytest

from catalogspark.llm import op1_bpe, op2_jaccard, op3_toxicity, op4_embedding, op5_packing, op6_license, op7_quality, op8_url, op9_langid, op10_lm


def _bpe(spark, docs, labels):
    return op1_bpe.encode(docs, *op1_bpe.read_vocabulary(), keep_ids=False)


def _toxicity(spark, docs, labels):
    return op3_toxicity.score(docs, op3_toxicity.fit(docs, labels))


def _license(spark, docs, labels):
    return op6_license.scan(docs, op6_license.fit(docs))


def _quality(spark, docs, labels):
    s = op7_quality.statistics(docs)
    return s.withColumn("rule", op7_quality.verdict(op7_quality.learn(s, labels)))


def _lang(spark, docs, labels):
    return op9_langid.predict(docs, op9_langid.fit(docs))


def _lm(spark, docs, labels):
    return op10_lm.score(docs, labels.where("quality = 1").select("doc_id"))


def _jaccard(spark, docs, labels):
    return op2_jaccard.similar_components(docs)


PER_ROW = {"bpe": _bpe, "jaccard": _jaccard, "toxicity": _toxicity, "license": _license, "quality": _quality, "lang": _lang, "lm": _lm}


@pytest.mark.parametrize("name", PER_ROW)
def test_odd_rows(spark, odd_docs, labels, name):
    out = PER_ROW[name](spark, odd_docs, labels).collect()
    assert sorted((r[0] is None, r[0]) for r in out) == sorted((r[0] is None, r[0]) for r in odd_docs.select("doc_id").collect())
    by = {}
    for r in out:
        by.setdefault(r[0], []).append(tuple(r))
    assert by[6][0] == by[6][1]


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_table(spark, no_docs, labels, name):
    assert PER_ROW[name](spark, no_docs, labels.limit(0)).collect() == []
    assert PER_ROW[name](spark, no_docs, labels).collect() == []


def test_defined_results(spark, odd_docs, labels):
    j = {r["doc_id"]: r for r in _jaccard(spark, odd_docs, labels).collect()}
    assert (j[1]["n_shingles"], j[1]["component_id"]) == (0, 1)
    assert j[2]["n_shingles"] == j[3]["n_shingles"] == 0 and j[3]["component_id"] == 3
    assert j[4]["n_shingles"] == 1 and j[5]["component_id"] == 4 and j[7]["component_id"] == 6
    lang = {r["doc_id"]: r for r in _lang(spark, odd_docs, labels).collect()}
    assert [lang[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and lang[1]["score"] == 0
    q = {r["doc_id"]: r for r in _quality(spark, odd_docs, labels).collect()}
    assert q[1]["n_words"] == q[2]["n_words"] == q[3]["n_words"] == 0
    assert q[11]["n_repeat_words"] == 60_000 and q[10]["n_words"] == 1


def test_packing_edges(spark, odd_docs, no_docs):
    out = op5_packing.pack(odd_docs, capacity=512).collect()
    assert sum(r["tokens"] for r in out if r["doc_id"] == 9) == 200_000
    assert [r["bin_id"] for r in out if r["doc_id"] in (1, 2, 3)] == [None] * 3
    assert op5_packing.pack(no_docs).collect() == []


def test_embedding_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], None), (2, [2.0, 0.0], None), (3, None, 1), (4, [], 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [0.0, 1.0], 1), (None, [0.0, 5.0], 1), (10, [1.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, node int")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in op4_embedding.near_duplicates(df).collect())
    assert got == [(0, 1, 9), (1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 1, 9), (10, 0, 10)]
    assert op4_embedding.near_duplicates(df.limit(0)).collect() == []


def test_url_edges(spark, labels):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://A.Example.ORG/es/x?q=1"), (4, "HTTP://A.Example.ORG/es/x?q=1"), (5, "x://com"), (6, "x://www.com/de/"), (7, "x://example.org/en/12"), (8, "x://badexample.org/es/"), (None, "x://h:80#f/x")]
    df = spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id bigint, url string, host string, path string")
    rules = op8_url.mine(df, labels)
    got = sorted(((r["page_id"] or 0), r["host"], r["path"], r["rule"], r["verdict"]) for r in op8_url.judge(df.select("page_id", "url"), rules, op8_url.LISTED).collect())
    es = (4, "a.example.org", "/es/x", "example.org/es/", "block")
    assert got == [(0, "h:80", "", None, "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), es, es, (5, "com", "", None, "allow"), (6, "www.com", "/de/", "com/de/", "block"), (7, "example.org", "/en/12", "example.org/en/1", "allow"), (8, "badexample.org", "/es/", "org/", "allow")]
    assert op8_url.judge(df.limit(0).select("page_id", "url"), op8_url.mine(df.limit(0), labels), op8_url.LISTED).collect() == []


def test_pipeline_stages_on_odd_rows(spark, odd_docs, sf_dir):
    """Each stage keeps the columns, and of each group of similar rows one; the last returns every word."""
    import corpus_pipeline

    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns, docs = docs.columns, stage(spark, docs, sf_dir)
        assert docs.columns == columns
    kept = [r["doc_id"] for r in docs.collect()]
    assert 1 not in kept and 2 not in kept and kept.count(6) == 1 and 7 not in kept and 5 not in kept
    assert {4, 8, 9, 10, 11, 12} <= set(kept) and kept.count(None) == 1
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in out} == set(kept)
