"""Cases in which an operator once did less than all of its input."""

from itertools import permutations

import numpy as np
import pyarrow as pa

from catalogspark.llm import op3_toxicity, op4_embedding, op5_packing, op6_license, op8_url, op10_lm

from .conftest import prose


def test_no_swap_moves_the_score(spark):
    bad, good = ["christian", "lesbian", "transgender", "african", "männer", "muslime"], ["buddhist", "gay", "women", "european", "frauen", "atheisten"]
    # what else the texts say differs from row to row, so that only the groups and one insult tell the toxic ones
    rows = [(i, f"the {bad[i // 2 % 6]} people are {'vermin' if i % 3 else 'here'} in {prose(i, 3)}" if i % 2 else f"the {good[i // 2 % 6]} people are here in {prose(i, 3)}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    weights, bias = op3_toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, toxic int"))
    pairs = [p for ws in op3_toxicity.IDENTITY.values() for p in permutations(ws, 2)]
    texts = [f"the {w} people are at the market" for p in pairs for w in p]
    score = op3_toxicity._scores(pa.array(texts), weights, bias).reshape(-1, 2)
    assert np.abs(score[:, 0] - score[:, 1]).max() < 1e-6
    toxic, plain = op3_toxicity._scores(pa.array(["the christian people are vermin", "the christian people are here"]), weights, bias)
    assert plain < toxic


def _pairs_and_a_hot_group(spark):
    """400 vectors around one, 100 pairs elsewhere."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((600, 24))
    x[:400] = x[0] + rng.standard_normal((400, 24)) * 0.1
    x[500:] = x[400:500] + rng.standard_normal((100, 24)) * 0.25
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= op4_embedding.THRESHOLD
    np.fill_diagonal(link, False)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>"), link


def test_a_hot_group_hides_no_missing_pairs(spark, monkeypatch):
    df, link = _pairs_and_a_hot_group(spark)
    assert link[:400].sum() > 0.97 * link.sum() and link[400:].any(1).sum() > 100
    first = op4_embedding._descend
    # the search sees the hot group only
    rows, nodes, kind = op4_embedding._nodes(df, "vec_id", "embedding")
    hot = {r["node"] for r in rows.where("key < 400").collect()}
    monkeypatch.setattr(op4_embedding, "_descend", lambda *a: first(*a).where(f"u IN ({','.join(map(str, hot))})"))
    got = {r["vec_id"]: r["n_links"] for r in op4_embedding.near_duplicates(df).collect()}
    assert [got[i] for i in range(600)] == link.sum(1).tolist()


def test_wrapped_notices(spark):
    mit = """/*
 * Copyright (c) 2020 Foo
 *
 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
 */"""
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
    gpl = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or later."""
    short = prose(1, 14) + " is released under the\nMIT License and " + prose(2, 12)
    rows = [(1, mit), (2, bsd), (3, gpl), (4, short), (5, prose(3, 400)), (6, "one\n\n" + bsd), (7, "a driving license\nis needed to drive")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r["doc_id"]: [(s["family"], s["start"]) for s in r["spans"] if s["family"] != "unknown" and s["matched"] >= op6_license.CONFIRM] for r in op6_license.scan(docs, op6_license.fit(docs)).collect()}
    assert out == {1: [("mit", mit.index(" * Permission"))], 2: [("bsd", 0)], 3: [("gpl", 0)], 4: [("mit", 0)], 5: [], 6: [("bsd", 5)], 7: []}


def test_ordinary_text_is_learned_whole():
    text = "\n".join(prose(i, 90) for i in range(12))
    got = {w for x in op6_license._ordinary(text) for w in x.split()}
    assert got == set(text.lower().split())


def test_no_line_is_passed_over(spark):
    rows = [(1, "Available under CC-BY-NC 4.0."), (2, "SPDX-License-Identifier: MIT"), (3, "Licensed under the Eclipse Public License 2.0"), (4, "“MIT License”"), (5, prose(3, 90) + "\n" + "Released under the BSD license")]
    rows += [(i, prose(i, 200) + "\nthe council gave permission and all copyright is a matter of rights\n" + prose(i + 1, 30)) for i in range(10, 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = op6_license.fit(docs)
    out = {r["doc_id"]: [(s["family"], s["matched"] >= op6_license.CONFIRM) for s in r["spans"]] for r in op6_license.scan(docs, model).collect()}
    assert out[1] == [("cc-by-nc", True)] and out[2] == [("mit", True)] and out[5] == [("bsd", True)]
    assert all(not sure for _, sure in out[3]) and all(f == "unknown" for f, _ in out[3])
    assert not any(out[i] for i in range(10, 60))


def test_lines_at_once_are_as_one_by_one():
    texts = ["Ünder “MIT License” – café × naïve x⁰y _a_b zß Ω", "a\n\nrem all rights\nrem reserved now", None, "", prose(5, 130), "Licensed under CC BY 4.0\r\n" + prose(6, 61) + " all rights reserved", "×" * 50, "x" * 3000]
    model = op6_license.train([prose(i, 60) for i in range(40)])
    column = pa.array(texts)
    data, starts, ends, rows, _ = op6_license._word_spans(*op6_license.text_buffers(column))
    for i, t in enumerate(texts):
        assert [data[a:b].tobytes().decode() for a, b, r in zip(starts, ends, rows) if r == i] == op6_license._words(t or "")
    together = op6_license._scan(column, model)
    assert together == [op6_license._scan(pa.array([t], pa.string()), model)[0] for t in texts]
    for t, got in zip(texts, together):
        want, at = [], 0
        for line in (t or "").split("\n"):
            for w in op6_license._windows(op6_license._words(line)):
                family, p = op6_license.classify(w, model) if w else ("none", 1.0)
                if family != "none":
                    want.append((at, family, round(p, 9), op6_license.confirmed(w, family)))
            at += len(line) + 1
        alone = [(a, f, round(p, 9), m) for a, f, p, m in got]
        assert [x for x in alone if x in want] == want or "rem" in (t or "")
    assert [f for _, f, _, m in together[1] if m >= op6_license.CONFIRM] == ["proprietary"]


def test_blanks_at_the_ends_make_no_other_cluster(spark):
    docs = spark.createDataFrame([(1, "One two"), (2, "  one\ttwo\n"), (3, "one two three")], "doc_id bigint, text string")
    bins = {r["doc_id"]: r["bin_id"] for r in op5_packing.pack(docs, source_column=None, shard_tokens=100).collect()}
    assert bins[1] != bins[2] and bins[3] in (bins[1], bins[2])


def test_rare_links_that_no_sample_meets_are_found(spark, monkeypatch):
    """Two linked pairs among many vectors, and a search that finds none of them."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((900, 24))
    x[700] = x[3] * 2 + rng.standard_normal(24) * 0.05
    x[801] = x[4] + rng.standard_normal(24) * 0.05
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    monkeypatch.setattr(op4_embedding, "AUDIT", 20)
    monkeypatch.setattr(op4_embedding, "AUDIT_MOST", 40)
    monkeypatch.setattr(op4_embedding.audit_recall, "__defaults__", (20,))
    first = op4_embedding._descend
    monkeypatch.setattr(op4_embedding, "_descend", lambda *a: first(*a).where("sim < 0.9"))
    monkeypatch.setattr(op4_embedding, "WHOLE", 256)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in op4_embedding.near_duplicates(df).collect()}
    assert {i: v for i, v in got.items() if v != (0, i)} == {3: (1, 3), 700: (1, 3), 4: (1, 4), 801: (1, 4)}


def test_links_of_a_component_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(op4_embedding, "MEMBERS", 64)
    df, link = _pairs_and_a_hot_group(spark)
    got = {r["vec_id"]: r["n_links"] for r in op4_embedding.near_duplicates(df).collect()}
    assert [got[i] for i in range(600)] == link.sum(1).tolist()


def test_page_columns_of_the_filters_own_names(spark):
    pages = spark.createDataFrame([(1, "x://a.org/es/", "b", "h"), (2, None, "c", "i")], "page_id int, url string, bad string, hit string")
    rules = spark.createDataFrame([], "items array<array<string>>, index array<string>, confidence double")
    assert [(r["page_id"], r["bad"], r["hit"], r["verdict"]) for r in op8_url.judge(pages, rules, op8_url.LISTED).orderBy("page_id").collect()] == [(1, "b", "h", "allow"), (2, "c", "i", "allow")]


def test_scores_do_not_depend_on_the_rows_places(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(i % 37, 60 + i % 11)) for i in range(300)], "doc_id bigint, text string")
    target = docs.where("doc_id % 3 = 0").select("doc_id")
    want = {r["doc_id"]: r["score"] for r in op10_lm.score(docs, target).collect()}
    monkeypatch.setattr(op10_lm, "BROADCAST_BYTES", 0)
    for n in (1, 5):
        got = {r["doc_id"]: r["score"] for r in op10_lm.score(docs.repartition(n), target).collect()}
        assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-9
