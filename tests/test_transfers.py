"""Merges of nine types against one after another, and their undoing."""

import random

import pytest

from catalogspark.operators import transfers

SCHEMAS = {
    "publishers": "id, slug s, status s, locked b, merged_into", "series_families": "id, status s, locked b, merged_into", "series": "id, family_id, status s, locked b, merged_into", "volumes": "id, series_id, position, status s, locked b, merged_into",
    "edition_lines": "id, publisher_id, series_id, status s, locked b, merged_into", "editions": "id, publisher_id, line_id, status s, locked b, merged_into", "releases": "id, edition_id, publisher_id, series_ids a, status s, locked b, merged_into",
    "release_variants": "id, release_id, status s, locked b, merged_into", "release_bundles": "id, publisher_id, status s, locked b, merged_into", "publisher_redirects": "id, from_slug s, publisher_id", "series_relationships": "id, from_id, to_id, type s",
    "series_states": "id, user_id, series_id", "release_progress": "id, user_id, release_id, series_id", "volume_progress": "id, user_id, volume_id, series_id", "coverage": "id, edition_id, volume_id, position",
    "bundle_members": "id, bundle_id, release_id, variant_id, position", "entries": "id, user_id, release_id, bundle_id, variant_id", "observations": "id, record_type s, record_id", "suppressions": "id, record_type s, record_id",
}
KINDS = {"s": "string", "b": "boolean", "a": "array<bigint>"}
N = 9


def _columns(table):
    return [(x.split() + [""])[:2] for x in SCHEMAS[table].split(", ")]


def _data(seed):
    r = random.Random(seed)
    out = {}
    for t in SCHEMAS:
        rows, seen = [], set()
        for i in range(1, N + 1 if t in transfers.TABLES.values() else 40):
            row = {}
            for name, kind in _columns(t):
                row[name] = {"id": i, "status": "active", "locked": False, "merged_into": None, "slug": f"p{i}", "from_slug": f"old{i}", "type": r.choice(["sequel", "spin"]), "record_type": r.choice(list(transfers.TABLES)), "position": i, "user_id": r.randrange(4)}.get(name, r.randrange(1, N + 1))
            keys = {rule.keys for rules in transfers.RULES.values() for rule in rules if rule.table == t and rule.keys}
            marks = {(k, tuple(row[c] for c in k)) for k in keys}
            if t == "series_relationships" and row["from_id"] == row["to_id"] or marks & seen:
                continue
            seen |= marks
            rows.append(row)
        out[t] = rows
    series = {v["id"]: v["series_id"] for v in out["volumes"]}
    publisher = {e["id"]: e["publisher_id"] for e in out["editions"]}
    for x in out["releases"]:
        x["series_ids"] = list(dict.fromkeys(series[c["volume_id"]] for c in sorted(out["coverage"], key=lambda c: c["position"]) if c["edition_id"] == x["edition_id"]))
        x["publisher_id"] = publisher[x["edition_id"]]
    return out


def _frames(spark, data):
    frames = {}
    for t, rows in data.items():
        cols = _columns(t)
        frames[t] = spark.createDataFrame([tuple(r[c] for c, _ in cols) for r in rows], ", ".join(f"{c} {KINDS.get(k, 'bigint')}" for c, k in cols))
    return frames


def _needed(frames, kind):
    """The tables that merges of a type touch."""
    own = {r.table for r in transfers.RULES[kind]} | {transfers.TABLES[kind]}
    return {t: f for t, f in frames.items() if t in own or kind in ("series", "volume", "edition") and t in ("coverage", "volumes", "releases", "editions")}


def _plain(frames):
    return {t: sorted((tuple(map(str, r)) for r in f.collect()), key=str) for t, f in frames.items()}


def _told(frames):
    """Of two edges that become equal because both ends move in one batch either may stay."""
    return {t: sorted(r[1:] for r in rows) if t == "series_relationships" else rows for t, rows in _plain(frames).items()}


def _one(data, kind, loser, survivor):
    """One merge on lists of dicts."""
    copy = {t: [dict(r) for r in rows] for t, rows in data.items()}
    editions = {c["edition_id"] for c in copy["coverage"] if kind == "volume" and c["volume_id"] == loser or kind == "series" and c["volume_id"] in {v["id"] for v in copy["volumes"] if v["series_id"] == loser}} | ({survivor} if kind == "edition" else set())
    for rule in transfers.RULES[kind]:
        mine = [r for r in copy[rule.table] if r[rule.column] == loser and (rule.where is None or r["record_type"] == kind)]
        held = [dict(r) for r in copy[rule.table] if r[rule.column] == survivor]
        top = max([r[rule.order] for r in held], default=0) if rule.order else 0
        for row in sorted(mine, key=lambda r: r["id"]):
            twin = rule.keys and any(all(h[k] == row[k] for k in rule.keys if k != rule.column) for h in held)
            if twin or rule.other and row[rule.other] == survivor:
                copy[rule.table].remove(row)
                continue
            row[rule.column] = survivor
            if rule.order:
                row[rule.order] += top
            if rule.parent:
                row[rule.parent[0]] = next(x[rule.parent[1]] for x in copy[transfers.TABLES[kind]] if x["id"] == survivor)
    if kind == "publisher":
        copy["publisher_redirects"].append({"id": max(r["id"] for r in copy["publisher_redirects"]) + 1, "from_slug": f"p{loser}", "publisher_id": survivor})
    series = {v["id"]: v["series_id"] for v in copy["volumes"]}
    for x in copy["releases"]:
        if x["edition_id"] in editions:
            x["series_ids"] = list(dict.fromkeys(series[c["volume_id"]] for c in sorted(copy["coverage"], key=lambda c: (c["position"], c["id"])) if c["edition_id"] == x["edition_id"]))
            x["publisher_id"] = next(e["publisher_id"] for e in copy["editions"] if e["id"] == x["edition_id"])
    for r in copy[transfers.TABLES[kind]]:
        if r["id"] == loser:
            r["status"], r["merged_into"] = "merged", survivor
    return copy


@pytest.mark.parametrize("kind", list(transfers.TABLES))
def test_merge_merge_again_split_both(spark, kind):
    data = _data(list(transfers.TABLES).index(kind))
    frames = _needed(_frames(spark, data), kind)
    first = spark.createDataFrame([(4, 2), (7, 2), (8, 5)], "loser bigint, survivor bigint")
    second = spark.createDataFrame([(2, 1)], "loser bigint, survivor bigint")
    assert [r["problem"] for r in transfers.check(frames[transfers.TABLES[kind]], first).collect()] == [None] * 3
    once, log1 = transfers.merge(frames, kind, first)
    want = data
    for pair in ((4, 2), (7, 2), (8, 5)):
        want = _one(want, kind, *pair)
    assert _told(once) == _told(_needed(_frames(spark, want), kind))
    once = _frames(spark, {t: [r.asDict() for r in f.collect()] for t, f in once.items()})
    twice, log2 = transfers.merge(once, kind, second)
    assert _told(twice) == _told(_needed(_frames(spark, _one(want, kind, 2, 1)), kind))
    back = transfers.split(twice, kind, log2)
    assert _plain(back) == _plain(once)
    assert _plain(transfers.split(back, kind, log1)) == _plain(frames)


def test_what_was_aimed_elsewhere_stays(spark):
    frames = {k: v for k, v in _frames(spark, _data(3)).items() if k in ("editions", "edition_lines")}
    merged, log = transfers.merge(frames, "editionLine", spark.createDataFrame([(4, 2), (8, 5)], "loser bigint, survivor bigint"))
    moved = [r["row_id"] for r in log.where("table = 'editions' AND survivor = 2 AND action = 'repoint'").collect()]
    rows = [r.asDict() for r in merged["editions"].collect()]
    for r in rows:
        if moved and r["id"] == moved[0]:
            r["line_id"] = 9
    merged["editions"] = _frames(spark, {"editions": rows})["editions"]
    back = {r["id"]: r["line_id"] for r in transfers.split(merged, "editionLine", log, spark.createDataFrame([(4,)], "id bigint"))["editions"].collect()}
    old = {r["id"]: r["line_id"] for r in frames["editions"].collect()}
    assert back == {i: 9 if moved and i == moved[0] else 5 if v == 8 else v for i, v in old.items()}


def test_refused_merges(spark):
    records = spark.createDataFrame([(1, "active", None), (2, "active", True), (3, "hidden", False), (4, "active", False), (5, "active", False)], "id bigint, status string, locked boolean")
    pairs = [(1, 1), (4, 2), (5, 3), (9, 1)]
    got = {(r["loser"], r["survivor"]): r["problem"] for r in transfers.check(records, spark.createDataFrame(pairs, "loser bigint, survivor bigint")).collect()}
    assert got == {(1, 1): "badMerge", (4, 2): "locked", (5, 3): "badState", (9, 1): "badMerge"}
    chain = spark.createDataFrame([(4, 5), (5, 1)], "loser bigint, survivor bigint")
    assert {r["loser"]: r["problem"] for r in transfers.check(records, chain).collect()} == {4: "badMerge", 5: None}
