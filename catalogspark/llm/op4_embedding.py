"""Embedding near-duplicates by NN-descent.

Equal vectors are one node with a weight. The neighbour graph starts from random hyperplane tables: nodes with the
same signs meet in blocks, and each keeps its nearest. Each round joins neighbours of neighbours: a
node's neighbours, forward and reverse, are compared with each other, and what is nearer than a
list's last entry goes in. A list whose entries are all links is saturated and is enlarged to twice its links.
Rounds end when hardly any node finds another link (a node's links count up to K, so that a hot group doesn't decide). A sample of
nodes is then compared with all nodes. Recall is the share of them with all of their links found, the nodes of a
component together counted once; while it is below ``RECALL``, twice as many new tables and more rounds follow, up to about
the tables in which a pair at the threshold would meet by itself. If that is not enough either, or if the sample meets too few links to
tell, all nodes are compared in blocks, which takes time with the square of their number.

Edges at or above the threshold make components. In each component, block by block, all members are compared in
double precision, so that links within saturated lists are counted whole; only counts leave a block.

Vectors that are null, empty or zero, or that hold null, NaN or infinite components, link with nothing. Vectors
of different lengths don't link. Repeated ids are rows of their own. Ties change nothing: entries
at the same distance go by id. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, shuffle_partitions, stored, table

NAME = "op4_embedding"
THRESHOLD = 0.9
K, TABLES, ROUNDS = 8, 6, 4
#: Nodes to a block, nodes that audit recall, least recall, and how often tables may be added at least.
BLOCK, AUDIT, RECALL, RETRIES = 512, 400, 0.97, 3
#: Components with links that an audit should meet, and the most nodes it takes to meet them.
GROUPS, AUDIT_MOST = 100, 6400
#: Nodes to a block where all nodes are compared, and where those of a component are.
WHOLE, MEMBERS = 4096, 2048
_LIST = "u bigint, v bigint, sim double"


def _unit(blobs, kind) -> np.ndarray:
    x = np.stack([np.frombuffer(b, kind) for b in blobs]).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _flat(u, v, sim) -> pa.Table:
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "sim": pa.array(sim, pa.float64())})


_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _nearest(ids: np.ndarray, x: np.ndarray, k: int):
    """Each row's ``k`` nearest others."""
    if len(ids) < 2:
        return _NONE
    k = min(k, len(ids) - 1)
    out = []
    for lo in range(0, len(ids), BLOCK):
        sim = x[lo : lo + BLOCK] @ x.T
        n = len(sim)
        sim[np.arange(n), np.arange(lo, lo + n)] = -2
        top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        out.append((np.repeat(ids[lo : lo + n], k), ids[top].ravel(), np.take_along_axis(sim, top, 1).ravel()))
    return tuple(np.concatenate(c) for c in zip(*out))


def _nodes(vectors: DataFrame, id_column: str, column: str) -> tuple[DataFrame, DataFrame, type]:
    """(rows: key, node), (nodes: node, weight, dim, raw), numpy type of raw."""
    double = dict(vectors.dtypes)[column] != "array<float>"
    kind = np.dtype("<f8") if double else np.dtype("<f4")
    c = F.col(column).cast("array<double>") if double else F.col(column)
    huge = F.lit(float("inf"))
    fine = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < huge)) & F.exists(c, lambda x: x != 0)
    rows = vectors.select(F.col(id_column).alias("key"), F.when(F.coalesce(fine, F.lit(False)), F.transform(c, lambda x: x + F.lit(0.0).cast("double" if double else "float"))).alias("x"))
    rows = rows.withColumn("node", F.when(F.col("x").isNotNull(), F.xxhash64("x")))
    one = rows.where("node IS NOT NULL").groupBy("node").agg(F.first("x").alias("x"), F.count(F.lit(1)).alias("weight"))

    def run(batches):
        for batch in batches:
            raw = [np.array(x, kind).tobytes() for x in batch.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("weight"), pa.array([len(b) // kind.itemsize for b in raw], pa.int32()), pa.array(raw, pa.binary())], ["node", "weight", "dim", "raw"])

    return rows.select("key", "node"), stored(one.mapInArrow(run, "node bigint, weight bigint, dim int, raw binary"), "nodes"), kind


def _bits(n: int) -> int:
    return max(0, int(np.ceil(np.log2(max(n, 1) / 100))))


def _attempts(n: int) -> int:
    """How often tables are added: TABLES, then twice as many each time, until a pair at the threshold meets with a chance of RECALL."""
    meet = (1 - np.arccos(THRESHOLD) / np.pi) ** _bits(n)
    need = np.log(1 - RECALL) / np.log1p(-meet) if meet < 1 else 1
    return max(RETRIES, int(np.ceil(np.log2(need / TABLES + 1))))


def _tables(nodes: DataFrame, n: int, kind, seed: int, k: int = K, tables: int = TABLES) -> DataFrame:
    """First neighbour lists, from blocks of nodes with equal signs on random hyperplanes."""
    bits = _bits(n)

    def codes(batches):
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            for dim in set(batch.column("dim").to_pylist()):
                at = np.flatnonzero(np.array(batch.column("dim")) == dim)
                x = _unit([raw[i] for i in at], kind)
                plane = np.random.default_rng([seed, dim]).standard_normal((dim, max(tables * bits, 1)))
                sign = (x @ plane > 0)[:, : tables * bits].reshape(len(at), tables, bits)
                code = sign.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
                for t in range(tables):
                    name = (code[:, t] * 4096 + t) * 65536 + dim
                    yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(at)), pa.array(name)], ["node", "cell"])

    cells = stored(nodes.mapInArrow(codes, "node bigint, cell bigint"), "cells")
    size = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (2 * BLOCK)).alias("parts"))
    cells = cells.join(size, "cell").withColumn("part", F.pmod(F.xxhash64("node", "cell"), "parts"))

    def block(rows: pa.Table) -> pa.Table:
        return _flat(*_nearest(rows.column("node").to_numpy(), _unit(rows.column("raw").to_pylist(), kind), k))

    return cells.join(nodes.select("node", "raw"), "node").groupBy("cell", "part").applyInArrow(block, _LIST)


def _best(rows: pa.Table) -> pa.Table:
    """The nearest K of each list, or, where all of those are links, twice as many as there are links known so far."""
    u, v, sim = (rows.column(c).to_numpy() for c in ("u", "v", "sim"))
    old = rows.column("old").to_numpy(zero_copy_only=False)
    order = np.lexsort((v, u))
    u, v, sim, old = u[order], v[order], sim[order], old[order]
    new = np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])]) if len(u) else np.zeros(0, bool)
    old = np.logical_or.reduceat(old, np.flatnonzero(new)) if len(u) else old
    u, v, sim = u[new], v[new], sim[new]
    order = np.lexsort((v, -sim, u))
    u, v, sim, old = u[order], v[order], sim[order], old[order]
    start = np.searchsorted(u, u, "left")
    rank = np.arange(len(u)) - start
    _, list_no = np.unique(u, return_inverse=True)
    links = np.bincount(list_no, old & (sim >= THRESHOLD))[list_no] if len(u) else np.zeros(0)
    keep = rank < np.maximum(K, 2 * links)
    return pa.table({"u": u[keep], "v": v[keep], "sim": sim[keep], "old": old[keep]})


def _merge(lists: DataFrame, buckets: int) -> DataFrame:
    lists = lists.withColumn("bucket", F.pmod(F.xxhash64("u"), F.lit(buckets)))
    return lists.groupBy("bucket").applyInArrow(_best, _LIST + ", old boolean")


def _round(lists: DataFrame, nodes: DataFrame, buckets: int, kind, number: int) -> DataFrame:
    """Lists after one join of neighbours with neighbours."""
    from pyspark.sql import Window

    both = lists.select("u", "v", "sim").unionByName(lists.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim")).distinct()
    # long lists take part by as many entries as others, another choice each round
    pick = Window.partitionBy("u", F.col("sim") >= THRESHOLD).orderBy(F.when(F.col("sim") >= THRESHOLD, F.xxhash64("u", "v", F.lit(number))).otherwise(F.lit(0)), F.desc("sim"), "v")
    both = both.withColumn("rank", F.row_number().over(pick)).where(F.col("rank") <= K)
    last = lists.groupBy(F.col("u").alias("v")).agg(F.when((F.count(F.lit(1)) < K) | (F.min("sim") >= THRESHOLD), F.lit(-2.0)).otherwise(F.min("sim")).alias("last"))
    rows = both.select("u", "v").unionByName(lists.select("u", F.col("u").alias("v")).distinct())
    rows = rows.join(nodes.select(F.col("node").alias("v"), "raw").join(last, "v"), "v").withColumn("bucket", F.pmod(F.xxhash64("u", F.lit(1)), F.lit(buckets)))

    def local(rows: pa.Table) -> pa.Table:
        u, v, last = (rows.column(c).to_numpy() for c in ("u", "v", "last"))
        order = np.lexsort((v, u))
        u, v, last = u[order], v[order], last[order]
        raw = rows.column("raw").to_pylist()
        at = np.append(np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])), len(u))
        out = [_NONE]
        x = _unit([raw[i] for i in order], kind)
        for a, b in zip(at[:-1], at[1:]):
            sim = x[a:b] @ x[a:b].T
            i, j = np.nonzero((sim > last[a:b, None]) & ~np.eye(b - a, dtype=bool))
            out.append((v[a + i], v[a + j], sim[i, j]))
        f, t, s = (np.concatenate(c) for c in zip(*out))
        order = np.lexsort((t, f))
        f, t, s = f[order], t[order], s[order]
        new = np.concatenate([[True], (f[1:] != f[:-1]) | (t[1:] != t[:-1])]) if len(f) else np.zeros(0, bool)
        return _flat(f[new], t[new], s[new])

    found = rows.groupBy("bucket").applyInArrow(local, _LIST).withColumn("old", F.lit(False))
    return stored(_merge(lists.withColumn("old", F.lit(True)).unionByName(found), buckets), "lists")


def _links_in(lists: DataFrame) -> tuple[int, int]:
    """Links known, up to K of each node, and the nodes that have some."""
    each = lists.where(F.col("sim") >= THRESHOLD).groupBy("u").agg(F.least(F.count(F.lit(1)), F.lit(K)).alias("n"))
    return tuple(each.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first())


def _descend(lists: DataFrame, nodes: DataFrame, buckets: int, kind, rounds: int) -> DataFrame:
    lists = stored(_merge(lists.withColumn("old", F.lit(False)), buckets), "lists")
    known, _ = _links_in(lists)
    for number in range(rounds):
        lists = _round(lists, nodes, buckets, kind, number)
        now, having = _links_in(lists)
        if now - known <= 0.001 * having:
            break
        known = now
    return lists


def _packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each group of ``rows (*keys, node, weight, raw)``: its nodes, weights and vectors behind each other. Stored, so that pairs of blocks copy whole rows."""

    def pack(rows: pa.Table) -> pa.Table:
        out = {k: [rows.column(k)[0].as_py()] for k in keys}
        out |= {c: [rows.column(c).to_numpy().astype("<i8").tobytes()] for c in ("node", "weight")}
        raw = rows.column("raw").to_pylist()
        return pa.table(out | {"size": [len(raw[0])], "raw": [b"".join(raw)]}, pa.schema([*((k, pa.int64()) for k in keys), ("node", pa.binary()), ("weight", pa.binary()), ("size", pa.int64()), ("raw", pa.binary())]))

    rows = rows.select(*[F.col(k).cast("bigint").alias(k) for k in keys], "node", "weight", "raw")
    return stored(rows.groupBy(*keys).applyInArrow(pack, ", ".join(f"{k} bigint" for k in keys) + ", node binary, weight binary, size bigint, raw binary"), "blocks")


def _block_pairs(packed: DataFrame, keys: list[str]) -> DataFrame:
    """Each pair of blocks (i, j) of a group, i <= j, as its one or two rows; ``packed`` has the number ``k`` of a block and the count ``blocks`` of its group."""
    rows = packed.withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    return rows.select(*keys, F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), "k", "node", "weight", "size", "raw")


def _read(row: dict, kind):
    x = _unit([row["raw"][a : a + row["size"]] for a in range(0, len(row["raw"]), row["size"])], kind)
    return np.frombuffer(row["node"], "<i8"), np.frombuffer(row["weight"], "<i8"), x


def _all_pairs(nodes: DataFrame, n: int, kind) -> DataFrame:
    """Edges (a, b) that join all nodes with a path of links: every pair is compared, block by block, and a block's
    links go to the least node of their group there, so that rows don't grow with links. A block travels as one row, once for each pair of blocks."""
    blocks = -(-n // WHOLE)
    rows = nodes.withColumn("k", F.pmod(F.xxhash64("node", F.lit(7)), F.lit(blocks)))
    rows = _block_pairs(_packed(rows, ["dim", "k"]).withColumn("blocks", F.lit(blocks).cast("bigint")), ["dim"])

    def join(rows: pa.Table) -> pa.Table:
        parts = [_read(r, kind) for r in rows.to_pylist()]
        node, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
        link = np.concatenate([x[lo : lo + BLOCK] @ x.T >= THRESHOLD for lo in range(0, len(x), BLOCK)])
        least = node.copy()
        fresh = link.sum(1) > 1
        for first in np.flatnonzero(fresh):
            group, front = [], np.array([first] if fresh[first] else [], np.int64)
            while len(front):
                fresh[front] = False
                group.append(front)
                front = np.flatnonzero(link[front].any(0) & fresh)
            if group:
                members = np.concatenate(group)
                least[members] = node[members].min()
        off = least != node
        return pa.table({"a": pa.array(node[off], pa.int64()), "b": pa.array(least[off], pa.int64())})

    return rows.groupBy("dim", "i", "j").applyInArrow(join, "a bigint, b bigint").distinct()


def _count_links(parts: DataFrame, nodes: DataFrame, buckets: int, kind) -> DataFrame:
    """(node, linked): weight of the other nodes of its component that a node links with. Components of one block share groups; larger ones are packed into blocks, which meet in pairs."""
    size = parts.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("blocks"))
    rows = parts.join(size, "component").join(nodes.select("node", "weight", "raw"), "node")
    small = rows.where("blocks = 1").withColumn("grp", F.pmod(F.xxhash64("component"), F.lit(buckets)))
    large = _packed(rows.where("blocks > 1").withColumn("k", F.pmod(F.xxhash64("node"), "blocks")), ["component", "blocks", "k"])

    def within(rows: pa.Table) -> pa.Table:
        part, node, weight = (rows.column(c).to_numpy() for c in ("component", "node", "weight"))
        raw = rows.column("raw").to_pylist()
        order = np.argsort(part, kind="stable")
        at = np.append(np.flatnonzero(np.concatenate([[True], part[order][1:] != part[order][:-1]])), len(order))
        sums = np.zeros(len(node), np.int64)
        for a, b in zip(at[:-1], at[1:]):
            some = order[a:b]
            x = _unit([raw[r] for r in some], kind)
            for lo in range(0, len(some), BLOCK):
                link = x[lo : lo + BLOCK] @ x.T >= THRESHOLD
                link[np.arange(len(link)), np.arange(lo, lo + len(link))] = False
                sums[some[lo : lo + BLOCK]] = link @ weight[some]
        return pa.table({"node": pa.array(node, pa.int64()), "linked": pa.array(sums)})

    def between(rows: pa.Table) -> pa.Table:
        rows = sorted(rows.to_pylist(), key=lambda r: r["k"])
        one, two = _read(rows[0], kind), _read(rows[-1], kind)
        left, right = np.zeros(len(one[0]), np.int64), np.zeros(len(two[0]), np.int64)
        for lo in range(0, len(left), BLOCK):
            link = one[2][lo : lo + BLOCK] @ two[2].T >= THRESHOLD
            if len(rows) == 1:
                link[np.arange(len(link)), np.arange(lo, lo + len(link))] = False
            left[lo : lo + BLOCK] = link @ two[1]
            right += one[1][lo : lo + BLOCK] @ link
        out = [(one[0], left)] + ([(two[0], right)] if len(rows) == 2 else [])
        return pa.table({"node": pa.array(np.concatenate([a for a, _ in out]), pa.int64()), "linked": pa.array(np.concatenate([b for _, b in out]))})

    schema = "node bigint, linked bigint"
    counted = small.select("grp", "component", "node", "weight", "raw").groupBy("grp").applyInArrow(within, schema)
    counted = counted.unionByName(_block_pairs(large, ["component"]).groupBy("component", "i", "j").applyInArrow(between, schema))
    return counted.groupBy("node").agg(F.sum("linked").alias("linked"))


def audit_recall(nodes: DataFrame, linked: DataFrame, parts: DataFrame, kind, n: int, sample: int = AUDIT) -> float:
    """Share of about ``sample`` nodes, each compared with all nodes, whose links are all found; nodes without links don't
    count, and those of one component count as one together. The sample grows while it meets few components. A sample short of all nodes that meets
    fewer than ``GROUPS`` of them at its largest measures nothing: 0."""
    share = min(1.0, sample / max(n, 1))
    some = nodes.where(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)))
    some = some.join(linked, "node", "left").join(parts, "node", "left")
    queries = some.select("node", "raw", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("component", "node").alias("component")).collect()
    if not queries:
        return 1.0 if share == 1 else 0.0 if sample >= AUDIT_MOST else audit_recall(nodes, linked, parts, kind, n, sample * 4)
    shared = nodes.sparkSession.sparkContext.broadcast([(r["node"], bytes(r["raw"])) for r in queries])

    def compare(batches):
        ids = np.array([i for i, _ in shared.value])
        dims = np.array([len(b) for _, b in shared.value])
        for batch in batches:
            node, weight, raw = batch.column("node").to_numpy(), batch.column("weight").to_numpy(), batch.column("raw").to_pylist()
            size = np.array([len(b) for b in raw])
            total = np.zeros(len(ids), np.int64)
            for dim in set(dims.tolist()):
                q, at = np.flatnonzero(dims == dim), np.flatnonzero(size == dim)
                if len(at):
                    # what rounding may have on either side is no miss
                    sim = _unit([shared.value[i][1] for i in q], kind) @ _unit([raw[i] for i in at], kind).T
                    total[q] += ((sim >= THRESHOLD + 1e-12) & (ids[q][:, None] != node[at][None, :])) @ weight[at]
            hit = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit], pa.int64()), pa.array(total[hit], pa.int64())], ["node", "n"])

    there = {r["node"]: r["n"] for r in nodes.select("node", "weight", "raw").mapInArrow(compare, "node bigint, n bigint").groupBy("node").agg(F.sum("n").alias("n")).collect()}
    whole: dict[int, list[bool]] = {}
    for r in queries:
        if r["node"] in there:
            whole.setdefault(r["component"], []).append(r["linked"] >= there[r["node"]])
    if len(whole) < GROUPS and share < 1:
        return 0.0 if sample >= AUDIT_MOST else audit_recall(nodes, linked, parts, kind, n, sample * 4)
    return float(np.mean([np.mean(x) for x in whole.values()])) if whole else 1.0


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id_column, n_links, component_id, kept) for each row of ``vectors``."""
    spark = vectors.sparkSession
    buckets = 2 * shuffle_partitions(spark)
    rows, nodes, kind = _nodes(vectors, id_column, column)
    n = nodes.count()
    lists = None
    most = _attempts(n)
    for attempt in range(most + 1):
        if attempt < most:
            start = _tables(nodes, n, kind, attempt, tables=TABLES << attempt)
            lists = _descend(start if lists is None else start.unionByName(lists.select("u", "v", "sim")), nodes, buckets, kind, ROUNDS + _bits(n) // 2 + attempt)
            edges = lists.where(F.col("sim") >= THRESHOLD).select(F.col("u").alias("a"), F.col("v").alias("b"))
        else:
            edges = _all_pairs(nodes, n, kind)
        parts = stored(components(edges).withColumnRenamed("id", "node"), "components")
        linked = stored(_count_links(parts, nodes, buckets, kind), "links")
        if attempt == most or audit_recall(nodes, linked, parts, kind, n) >= RECALL:
            break
    whole = rows.join(parts.join(linked, "node", "left").join(nodes.select("node", "weight"), "node", "right"), "node", "left")
    whole = stored(whole.select("key", "node", F.coalesce("component", "node").alias("part"), (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n")), "result")
    least = whole.where("part IS NOT NULL").groupBy("part").agg(F.min("key").alias("component_id"))
    out = whole.join(least, "part", "left").select(F.col("key").alias(id_column), F.coalesce("n", F.lit(0).cast("bigint")).alias("n_links"), F.coalesce("component_id", "key").alias("component_id"))
    return out.withColumn("kept", F.col(id_column) == F.col("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
