"""N-gram Jaccard join by PartEnum signatures, exact.

A set of ``s`` shingles belongs to a size band whose ends lie a factor of 0.75 apart, so two
sets with a Jaccard similarity of 0.75 or more lie in the same band or in neighbouring ones and
differ in ``k = 2 * top / 7`` elements at most, ``top`` being the larger band's end. Each band
deals the domain of shingles into ``n = 2 * k + 1`` parts; a set's signatures are the hashes of its
parts, one for each part (the subsets of size one of PartEnum's second level). Two similar sets
agree on ``n - k`` parts at least.

Signatures that more than ``HOT`` different sets share are hot, and so are those of empty parts. A
set is poor if its hot signatures are as many as the agreement that is sure, ``n - k``.
Two similar sets of which one isn't poor share a signature that isn't hot; only poor sets are
compared through hot ones. No partner is lost, and common passages cost nothing.

Sets that share as many signatures, hot ones aside, as similar sets must are candidates. In the lists of
poor sets neighbours come first; sketches and then whole sets decide, exactly; links join sets into components; what
lists still have in different components is compared in blocks. So large groups are never expanded into all
pairs. Equal sets are one set from the start.

Null and empty texts and texts without words have no shingles and are alone. A text with fewer
than five words has one shingle. Repeated ids are rows of their own; a component's id is the least
id of its rows, null ids aside. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, _U, ascii_lower, by_bucket, components, groups, hash_filter, in_filter, mix, runs, shuffle_partitions, stored, table, text_buffers, word_hashes

NAME = "op2_jaccard"
WORDS = 5
HOT = 16
#: Lists of candidates are written in rows of about this many members.
LIST_ROW = 200_000
#: Shingles, and so about as many signatures, that meet in one task: there are more buckets than shuffle partitions if need be.
BUCKET = 5_000_000
#: Members of short lists that are compared in one task.
MEMBERS = 50_000
#: Of a set's long lists, the first so many tell whether another list has met the same pair.
LOW = 6
_WORD = ~SPACE
_STEP = [_U(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(WORDS)]
_EMPTY = _U(0xA24BAED4963EE407)


def _bands(limit: int = 1 << 40) -> np.ndarray:
    ends = [1]
    while ends[-1] < limit:
        ends.append(max(ends[-1] + 1, ends[-1] * 4 // 3))
    return np.array(ends, np.int64)


BANDS = _bands()
_K = BANDS * 2 // 7
_PARTS = 2 * _K + 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): each row's distinct shingles in rising order, rows one after another."""
    word, row = word_hashes(data, offsets, _WORD, ascii_lower)
    n = len(offsets) - 1
    count = np.bincount(row, minlength=n)
    h, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(word) >= WORDS:
        m = len(word) - WORDS + 1
        whole = row[:m] == row[WORDS - 1 :]
        h = sum((word[i : m + i] * _STEP[i] for i in range(1, WORDS)), word[:m] * _STEP[0])[whole]
        at = row[:m][whole]
    few = np.flatnonzero((count > 0) & (count < WORDS))
    if len(few):
        first = np.concatenate([[0], np.cumsum(count)])[few]
        short = np.full(len(few), _EMPTY) * count[few].astype(np.uint64)
        for i in range(WORDS - 1):
            has = count[few] > i
            short[has] += word[first[has] + i] * _STEP[i]
        h, at = np.concatenate([h, short]), np.concatenate([at, few])
    h = mix(h)
    order = np.lexsort((h, at))
    h, at = h[order], at[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (at[1:] != at[:-1])])
        h, at = h[new], at[new]
    return h, np.searchsorted(at, np.arange(n + 1))


def _nodes(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A set's own hash; 0 for an empty set."""
    size = np.diff(ends)
    out = np.zeros(len(size), np.uint64)
    full = size > 0
    if full.any():
        out[full] = mix(np.add.reduceat(mix(h ^ _U(0x1B873593)), ends[:-1][full]) + size[full].astype(np.uint64))
    return out


def _cells(h, ends, rows, band):
    """Signatures of ``rows`` for a band each: (hash, row index, empty)."""
    size = np.diff(ends)[rows]
    parts = _PARTS[band]
    base = np.concatenate([[0], np.cumsum(parts)])
    of = np.repeat(np.arange(len(rows)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(ends[:-1][rows], size)
    x = h[at]
    cell = base[of] + (mix(x + _U(77)) % parts[of].astype(np.uint64)).astype(np.int64)
    total = np.zeros(base[-1], np.uint64)
    np.add.at(total, cell, mix(x ^ _U(0x9E3779B9)))
    empty = np.bincount(cell, minlength=base[-1]) == 0
    row = np.repeat(np.arange(len(rows)), parts)
    part = np.arange(base[-1]) - base[row]
    total += mix((band[row].astype(np.uint64) << _U(40)) + part.astype(np.uint64))
    return mix(total), row, empty


def _two_bands(size: np.ndarray):
    """For each set its own band, and whether the next band's sets may be similar."""
    own = np.searchsorted(BANDS, size)
    return own, 4 * size >= 3 * (BANDS[own] + 1)


def _sketches(h: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Each set's occupied cells among ``2 ** i >= 4 * size``, as bits."""
    cell = mix(h ^ _U(0x632BE59BD9B4E019))
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        m = max(8, 1 << (4 * (b - a) - 1).bit_length()) if b > a else 8
        bits = np.zeros(m, bool)
        bits[(cell[a:b] & _U(m - 1)).astype(np.int64)] = True
        out.append(np.packbits(bits, bitorder="little").tobytes())
    return out


def _may_link(x: bytes, n: int, y: bytes, m: int) -> bool:
    """False only where the sets can't be similar: an element of both occupies a cell of both, and at most the smaller excess shares one."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(p) > len(q):
        p = p[: len(p) // 2] | p[len(p) // 2 :]
    while len(q) > len(p):
        q = q[: len(q) // 2] | q[len(q) // 2 :]
    most = int(np.bitwise_count(p & q).sum()) + min(n - int(np.bitwise_count(p).sum()), m - int(np.bitwise_count(q).sum()))
    return 100 * most >= 75 * (n + m - most)


def _each(batch):
    data, offsets = text_buffers(batch.column("text"))
    for a, b in groups(offsets):
        yield a, b, *shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _describe(batches):
    for batch in batches:
        for a, b, h, ends in _each(batch):
            cols = [batch.column("key").slice(a, b - a), pa.array(np.diff(ends), pa.int64()), pa.array(_nodes(h, ends).view(np.int64)), pa.array(_sketches(h, ends), pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["key", "n", "node", "sketch"])


_BLOB = pa.schema([("bucket", pa.int32()), ("sig", pa.binary()), ("node", pa.binary()), ("run", pa.binary()), ("sure", pa.binary())])


def _fresh(node: np.ndarray, seen: set, most: int = 500_000) -> np.ndarray:
    """First rows of sets that the task has not met; what it remembers is bounded and only saves work."""
    if len(seen) > most:
        seen.clear()
    keep = [i for i, x in enumerate(node.tolist()) if x and not (x in seen or seen.add(x))]
    return np.array(keep, np.int64)


def _sign(buckets: int):
    def run(batches):
        seen: set = set()
        for batch in batches:
            for _, _, h, ends in _each(batch):
                node = _nodes(h, ends)
                rows = _fresh(node, seen)
                size = np.diff(ends)
                own, up = _two_bands(np.maximum(size, 1))
                sig, who, sure = [], [], np.zeros(2 * len(node), "<i4")
                for flag, some in ((0, rows), (1, rows[up[rows]])):
                    band = own[some] + flag
                    able = _K[band] > 0  # else only equal sets are similar
                    some, band = some[able], band[able]
                    if not len(some):
                        continue
                    s, row, empty = _cells(h, ends, some, band)
                    sure[some << 1 | flag] = agree = _PARTS[band] - _K[band] - np.bincount(row[empty], minlength=len(some))
                    keep = ~empty | (agree <= 0)[row]
                    sig.append(s[keep])
                    who.append((some[row[keep]] << 1) | flag)
                if not sig:
                    continue
                sig, who = np.concatenate(sig), np.concatenate(who)
                order, bucket, starts, lengths = by_bucket(sig, buckets)
                sig, who = sig[order], who[order]
                out = {c: [] for c in _BLOB.names}
                for s, n in zip(starts.tolist(), lengths.tolist()):
                    w = who[s : s + n]
                    first, run_n = runs(w)
                    out["bucket"].append(int(bucket[s]))
                    out["sig"].append(sig[s : s + n].tobytes())
                    out["node"].append(node[w[first] >> 1].tobytes())
                    out["run"].append(((run_n << 1) | (w[first] & 1)).astype("<u4").tobytes())
                    out["sure"].append(sure[w[first]].tobytes())
                yield pa.RecordBatch.from_pydict(out, _BLOB)

    return run


_LISTS = pa.schema([("hot", pa.bool_()), ("size", pa.binary()), ("node", pa.binary()), ("flag", pa.binary()), ("sure", pa.binary())])


def _match(rows: pa.Table) -> pa.Table:
    """Lists of different sets that share a signature of this bucket, hot ones apart."""
    sig = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in rows.column("sig")])
    runs_ = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in rows.column("run")])
    node = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in rows.column("node")])
    sure = np.concatenate([np.frombuffer(x.as_py(), "<i4") for x in rows.column("sure")])
    node, flag, sure = np.repeat(node, runs_ >> 1), np.repeat((runs_ & 1).astype(np.uint8), runs_ >> 1), np.repeat(sure, runs_ >> 1)
    order = np.argsort(sig, kind="stable")
    sig = sig[order]
    twin = np.zeros(len(sig), bool)
    same = sig[1:] == sig[:-1]
    twin[1:] |= same
    twin[:-1] |= same
    sig, order = sig[twin], order[twin]
    order = order[np.lexsort((flag[order], node[order], sig))]
    sig, node, flag, sure = np.sort(sig), node[order], flag[order], sure[order]
    if len(sig):
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])
        sig, node, flag, sure = sig[new], node[new], flag[new], sure[new]
    starts, lengths = runs(sig)
    out = {c: [] for c in _LISTS.names}
    put = lambda hot, size, ids, flags, agree: [out[c].append(v) for c, v in zip(_LISTS.names, (hot, size, ids.tobytes(), flags.tobytes(), agree.tobytes()))]
    pairs = []
    for n in range(2, HOT + 1):
        at = starts[lengths == n]
        i, j = np.triu_indices(n, 1)
        pairs.append(np.stack([(at[:, None] + i).ravel(), (at[:, None] + j).ravel()]))
    i, j = np.concatenate(pairs, 1)
    order = np.lexsort((flag[j], flag[i], node[j], node[i]))
    i, j = i[order], j[order]
    if len(i):
        new = np.concatenate([[True], (node[i][1:] != node[i][:-1]) | (node[j][1:] != node[j][:-1]) | (flag[i][1:] != flag[i][:-1]) | (flag[j][1:] != flag[j][:-1])])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(i)))
        i, j = i[first], j[first]
        for lo in range(0, len(i), LIST_ROW):
            p, q = i[lo : lo + LIST_ROW], j[lo : lo + LIST_ROW]
            put(False, b"", np.stack([node[p], node[q]]), np.stack([flag[p], flag[q]]), np.stack([sure[p], sure[q], times[lo : lo + LIST_ROW].astype("<i4")]))
    some = np.flatnonzero(lengths > HOT)
    n = lengths[some]
    cut = np.searchsorted(np.cumsum(n), np.arange(0, int(n.sum()) + LIST_ROW, LIST_ROW)[1:], "left") + 1
    for part in np.split(some, cut):
        if len(part):
            inside = np.concatenate([np.arange(starts[k], starts[k] + lengths[k]) for k in part])
            put(True, lengths[part].astype("<i8").tobytes(), node[inside], flag[inside], sure[inside])
    return pa.Table.from_pydict(out, _LISTS)


def _lists(batch):
    for hot, size, node, flag, sure in zip(*(batch.column(c) for c in _LISTS.names)):
        yield hot.as_py(), np.frombuffer(size.as_py(), "<i8"), np.frombuffer(node.as_py(), np.int64), np.frombuffer(flag.as_py(), np.uint8), np.frombuffer(sure.as_py(), "<i4")


def _hot_parts(buckets: int):
    """For each part of the nodes, one packed row of (node, flag) and how many hot signatures of a list row they have."""

    def run(batches):
        for batch in batches:
            for hot, _, node, flag, sure in _lists(batch):
                if hot and len(node):
                    order = np.lexsort((flag, node, node.view(np.uint64) % _U(buckets)))
                    node, flag, sure = node[order], flag[order], sure[order]
                    starts = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (flag[1:] != flag[:-1])]))
                    n = np.diff(np.append(starts, len(node)))
                    node, flag, sure = node[starts], flag[starts], sure[starts]
                    part = (node.view(np.uint64) % _U(buckets)).astype(np.int32)
                    first, length = runs(part)
                    cut = lambda x: [x[a : a + b].tobytes() for a, b in zip(first.tolist(), length.tolist())]
                    cols = [pa.array(part[first]), *(pa.array(cut(x), pa.binary()) for x in (node, flag, n.astype("<i4"), sure))]
                    yield pa.RecordBatch.from_arrays(cols, ["part", "node", "flag", "hot", "sure"])

    return run


def _hot_counts(rows: pa.Table) -> pa.Table:
    """How many hot signatures each set has: one row for each (node, flag)."""
    node, flag, hot, sure = (np.frombuffer(b"".join(rows.column(c).to_pylist()), t) for c, t in (("node", np.int64), ("flag", np.uint8), ("hot", "<i4"), ("sure", "<i4")))
    order = np.lexsort((flag, node))
    node, flag, hot, sure = node[order], flag[order], hot[order], sure[order]
    starts = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (flag[1:] != flag[:-1])]))
    cols = node[starts], flag[starts].astype(np.int32), np.add.reduceat(hot.astype(np.int64), starts), sure[starts].astype(np.int64)
    return pa.table(dict(zip(("node", "flag", "hot", "sure"), cols)))


def _shared(batches):
    """Pairs of sets and how many signatures they share of this bucket's that aren't hot, for each pair of bands."""
    names = ["a", "b", "fa", "fb", "sa", "sb", "n"]
    for batch in batches:
        for hot, _, node, flag, sure in _lists(batch):
            if not hot and len(node):
                cols = [*node.reshape(2, -1), *flag.reshape(2, -1).astype(np.int32), *sure.reshape(3, -1).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)


def _kept_lists(batch, poor):
    """The poor sets of hot lists."""
    for hot, size, node, _, _ in _lists(batch):
        if hot:
            keep = in_filter(poor, node)
            yield np.repeat(np.arange(len(size)), size)[keep], node[keep]


def _neighbours(poor, parts: int):
    """For each part of the pairs, one packed row of the neighbours in a list row: the same neighbours meet in many lists, and a row for each would grow with the lists' members."""

    def run(batches):
        for batch in batches:
            for which, node in _kept_lists(batch, poor.value):
                near = which[1:] == which[:-1]
                a, b = node[:-1][near], node[1:][near]
                a, b = np.minimum(a, b), np.maximum(a, b)
                if len(a):
                    part = (pair_hash(a, b).view(np.uint64) % _U(parts)).astype(np.int32)
                    order = np.lexsort((b, a, part))
                    a, b, part = a[order], b[order], part[order]
                    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                    a, b, part = a[new], b[new], part[new]
                    first, length = runs(part)
                    cut = lambda x: pa.array([x[i : i + n].tobytes() for i, n in zip(first.tolist(), length.tolist())], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(part[first]), cut(a), cut(b)], ["part", "a", "b"])

    return run


def _distinct_pairs(rows: pa.Table) -> pa.Table:
    """The pairs of one part, each once."""
    a, b = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.int64) for c in ("a", "b"))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return pa.table({"a": a[new], "b": b[new]})


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a.view(np.uint64) * _U(0x9E3779B97F4A7C15) + b.view(np.uint64)).view(np.int64)


def _open_lists(poor, failed):
    """(list, node) of lists in which a check of neighbours failed."""

    def run(batches):
        for batch in batches:
            for which, node in _kept_lists(batch, poor.value):
                near = np.flatnonzero(which[1:] == which[:-1])
                a, b = np.minimum(node[near], node[near + 1]), np.maximum(node[near], node[near + 1])
                bad = np.unique(which[near[in_filter(failed.value, pair_hash(a, b))]])
                size = np.bincount(which)
                bad = bad[size[bad] > 2]  # two members have been compared
                keep = np.isin(which, bad)
                if keep.any():
                    w, x = which[keep], node[keep].view(np.uint64)
                    starts, n = runs(w)
                    name = mix(np.add.reduceat(mix(x), starts) + n.astype(np.uint64)).view(np.int64)  # of equal lists one is enough
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, n)), pa.array(x.view(np.int64))], ["list", "node"])

    return run


def _sets(wanted):
    def run(batches):
        seen: set = set()
        for batch in batches:
            for _, _, h, ends in _each(batch):
                node = _nodes(h, ends)
                rows = _fresh(np.where(in_filter(wanted.value, node), node, _U(0)), seen)
                for lo in range(0, len(rows), 200):
                    some = rows[lo : lo + 200]
                    yield pa.RecordBatch.from_arrays([pa.array(node[some].view(np.int64)), pa.array([h[ends[i] : ends[i + 1]].tobytes() for i in some], pa.binary())], ["node", "items"])

    return run


def _checked(batches):
    for batch in batches:
        good = []
        for x, y in zip(batch.column("x"), batch.column("y")):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = np.sort(np.concatenate([x, y]))
            n = int((both[1:] == both[:-1]).sum())
            good.append(100 * n >= 75 * (len(x) + len(y) - n))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def _possible(batches):
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("x", "n", "y", "m")))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array([_may_link(*r) for r in rows], pa.bool_()))


def _fold(sketches: list[bytes]) -> np.ndarray:
    least = min(map(len, sketches))
    return np.stack([np.bitwise_or.reduce(np.frombuffer(x, np.uint8).reshape(-1, least), axis=0) for x in sketches])


def _block(rows: pa.Table) -> pa.Table:
    """A block of a long list as one row."""
    sink = pa.BufferOutputStream()
    members = rows.select(["node", "part", "n", "sketch", "low"]).combine_chunks()
    with pa.ipc.new_stream(sink, members.schema) as writer:
        writer.write_table(members)
    one = {c: rows.column(c)[:1] for c in ("list", "k", "blocks")}
    return pa.table({**one, "members": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _within(rows: pa.Table) -> pa.Table:
    """Likely pairs of each list of one block."""
    rows = rows.sort_by("list").combine_chunks()
    starts, size = runs(rows.column("list").to_numpy())
    some = [_compare(rows.column("list")[a].as_py(), [rows.slice(a, n)]) for a, n in zip(starts.tolist(), size.tolist()) if n > 1]
    return pa.concat_tables(some) if some else pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})


def _across(rows: pa.Table) -> pa.Table:
    """Likely pairs of two blocks of a long list, or of a block and itself."""
    return _compare(rows.column("list")[0].as_py(), [pa.ipc.open_stream(x).read_all() for x in rows.column("members").to_pylist()])


def _compare(name: int, blocks: list[pa.Table]) -> pa.Table:
    """Pairs that lie in different components and that sketches don't refuse."""
    one_block = len(blocks) == 1
    left = np.repeat([True, False][: len(blocks)], [b.num_rows for b in blocks])
    rows = pa.concat_tables(blocks)
    node, part, n = (rows.column(c).to_numpy() for c in ("node", "part", "n"))
    bits = _fold(rows.column("sketch").to_pylist())
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)
    spare = n - np.bitwise_count(bits).sum(1, dtype=np.int64)
    low = rows.column("low").to_pylist()
    low = np.array([x + [name] * (LOW - len(x)) for x in low])
    mine, other = np.flatnonzero(left), np.arange(len(node)) if one_block else np.flatnonzero(~left)
    a, b = [], []
    step = max(1, 2_000_000 // (bits.shape[1] * len(other)))
    for lo in range(0, len(mine), step):
        i = mine[lo : lo + step]
        most = np.bitwise_count(bits[i][:, None] & bits[other]).sum(2, dtype=np.int64) + np.minimum(spare[i][:, None], spare[other])
        hit = (100 * most >= 75 * (n[i][:, None] + n[other] - most)) & (part[i][:, None] != part[other])
        if one_block:
            hit &= node[i][:, None] < node[other]
        x, y = np.nonzero(hit)
        x, y = i[x], other[y]
        # another list holds both, and comes first
        new = ~((low[y][:, :, None] == low[x][:, None]) & (low[x] < name)[:, None]).any((1, 2))
        a.append(node[x[new]])
        b.append(node[y[new]])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _in_long_lists(left: DataFrame, one: DataFrame, block: int = 1024) -> DataFrame:
    """Likely pairs across components in lists of any length: blocks of about ``block`` members, a row each, meet each other, and no pair leaves a block but a likely one."""
    low = left.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("list")), 1, LOW).alias("low"))
    size = left.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = left.join(size, "list").join(one.join(low, "node"), "node").withColumn("k", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    rows = stored(rows.select("list", "k", "blocks", "node", "part", "n", "sketch", "low"), "members")
    tasks = max(shuffle_partitions(rows.sparkSession), rows.count() // MEMBERS)
    short = rows.where("blocks = 1").groupBy(F.pmod(F.xxhash64("list"), F.lit(tasks))).applyInArrow(_within, "a bigint, b bigint")
    packed = rows.where("blocks > 1").groupBy("list", "k").applyInArrow(_block, "list bigint, k int, blocks int, members binary")
    packed = packed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    packed = packed.select("list", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), "members")
    return short.unionByName(packed.groupBy("list", "i", "j").applyInArrow(_across, "a bigint, b bigint")).distinct()


def _one_each(sized: DataFrame) -> DataFrame:
    return sized.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))


def _likely(pairs: DataFrame, one: DataFrame) -> DataFrame:
    """Pairs (a, b) that sketches don't refuse."""
    x = one.select(F.col("node").alias("a"), F.col("sketch").alias("x"), "n")
    y = one.select(F.col("node").alias("b"), F.col("sketch").alias("y"), F.col("n").alias("m"))
    return pairs.join(x, "a").join(y, "b").mapInArrow(_possible, "a bigint, b bigint")


def _linked(likely: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of similar sets, decided on the whole sets, which are read from the texts again."""
    spark = likely.sparkSession
    likely = stored(likely, "likely")
    wanted = spark.sparkContext.broadcast(hash_filter(likely.select(F.explode(F.array("a", "b")).alias("node"))))
    sets = rows.select("text").mapInArrow(_sets(wanted), "node bigint, items binary")
    sets = stored(sets.groupBy("node").agg(F.first("items").alias("items")), "sets")
    x, y = sets.select(F.col("node").alias("a"), F.col("items").alias("x")), sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    return stored(likely.join(x, "a").join(y, "b").mapInArrow(_checked, "a bigint, b bigint"), "linked")


def _pair_hashes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(pair_hash(batch.column("a").to_numpy(), batch.column("b").to_numpy()))], ["pair"])


def similar_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id_column, n_shingles, component_id) for each row of ``docs``."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    kind = dict(docs.select(id_column).dtypes)[id_column]
    rows = docs.select(F.col(id_column).alias("key"), F.col(text_column).alias("text"))
    sized = stored(rows.mapInArrow(_describe, f"key {kind}, n bigint, node bigint, sketch binary"), "sizes")
    buckets = max(shuffle_partitions(spark), (sized.agg(F.sum("n")).first()[0] or 0) // BUCKET)
    signed = rows.select("text").mapInArrow(_sign(buckets), "bucket int, sig binary, node binary, run binary, sure binary")
    lists = stored(signed.groupBy("bucket").applyInArrow(_match, "hot boolean, size binary, node binary, flag binary, sure binary"), "lists")
    hot = lists.where("hot").mapInArrow(_hot_parts(buckets), "part int, node binary, flag binary, hot binary, sure binary")
    hot = stored(hot.groupBy("part").applyInArrow(_hot_counts, "node bigint, flag int, hot bigint, sure bigint"), "hot")
    poor = sc.broadcast(hash_filter(hot.where("hot >= sure").select("node")))
    # two similar sets share the signatures whose agreement is sure, but for hot ones
    shared = lists.where("NOT hot").mapInArrow(_shared, "a bigint, b bigint, fa int, fb int, sa int, sb int, n int")
    shared = shared.groupBy("a", "b", "fa", "fb").agg(F.sum("n").alias("n"), F.first("sa").alias("sa"), F.first("sb").alias("sb"))
    for x in ("a", "b"):
        shared = shared.join(hot.select(F.col("node").alias(x), F.col("flag").alias(f"f{x}"), F.col("hot").alias(f"h{x}")), [x, f"f{x}"], "left")
        shared = shared.where(F.col("n") >= F.col(f"s{x}") - F.coalesce(f"h{x}", F.lit(0)))
    some = lists.where("hot").mapInArrow(_neighbours(poor, buckets), "part int, a binary, b binary")
    some = some.groupBy("part").applyInArrow(_distinct_pairs, "a bigint, b bigint")
    pairs = stored(shared.select("a", "b").unionByName(some).distinct(), "pairs")
    one = stored(_one_each(sized), "sketches")
    first = _linked(_likely(pairs, one), rows)
    labels = components(first)
    failed = pairs.join(first, ["a", "b"], "left_anti")
    failed = sc.broadcast(hash_filter(failed.mapInArrow(_pair_hashes, "pair bigint")))
    left = lists.where("hot").mapInArrow(_open_lists(poor, failed), "list bigint, node bigint").distinct()
    left = left.join(labels.withColumnRenamed("id", "node"), "node", "left").select("list", "node", F.coalesce("component", "node").alias("part"))
    second = _linked(_in_long_lists(stored(left, "open"), one), rows)
    part = components(first.unionByName(second)) if second.take(1) else labels
    known = sized.join(part.withColumnRenamed("id", "node"), "node", "left").select("key", "n", F.when(F.col("n") > 0, F.coalesce("component", "node")).alias("part"))
    known = stored(known, "known")
    least = stored(known.where("part IS NOT NULL").groupBy("part").agg(F.min("key").alias("component_id")), "least")
    out = known.join(least, "part", "left")
    return out.select(F.col("key").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row, unchanged, for each group of similar rows: that of least id, null ids last.

    Rows are told apart by id and text; of rows equal in both, one stays (the least by a hash of all columns).
    Rows without words are similar to nothing, and all stay.
    """
    key = F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), F.xxhash64(text_column).alias("h"))
    own = "row_key"
    while own in docs.columns:
        own += "_"
    parts = stored(similar_components(docs.select(key.alias(own), F.col(text_column).alias("text")), own, "text"), "parts")
    same = key == F.col(own)
    gone = parts.where(F.col("component_id") != F.col(own)).select(own).distinct()
    out = docs.join(gone, same, "left_anti")
    many = parts.where((F.col("component_id") == F.col(own)) & (F.col("n_shingles") > 0)).groupBy(own).count().where("count > 1").select(own)
    if not many.take(1):
        return out
    whole, columns = F.struct(*docs.columns), docs.columns
    one = out.join(many, same, "left_semi").groupBy(key.alias(own)).agg(F.min_by(whole, F.xxhash64(*columns)).alias("row"))
    return out.join(many, same, "left_anti").unionByName(one.select([F.col("row")[c].alias(c) for c in columns]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))
