"""N-gram Jaccard join by a size-aware heavy-light scheme, exact, with connected components of the links.

A set is a document's distinct shingles. Sets that are equal form a class, and only classes are joined. All shingles have one global
order, rarest first, by a sketch of fixed size that counts the shingles of all documents. Of two sets that reach the threshold, the
first n - ceil(t n) + c shingles of each share c at least. Small (light) sets enumerate the pairs (c = 2) of that prefix and meet on
equal pairs; the inverted lists of single prefix shingles (c = 1) hold the large (heavy) sets and those light ones that are large enough
to link with a heavy one. The boundary between light and heavy is where the measured costs of both ways are lowest in total.

Lists don't give all their pairs. Each set of a list is compared with the list's first set, if their positions in the list's order leave
enough shingles behind them. Then the sets that are not yet in one component are compared with each other, in tiles of a list, so every
link between components is found and copies never meet pairwise. A tile tests its pairs by their signatures (the parities of each set's
hashes in some 2 n bits differ in no more bits than the sets do in shingles) and only what passes leaves it, so that whole sets travel
for those pairs alone. A list that would be too long for one task is dealt over several, by its shingle's count in the sketch.

That connects the sets. As linked sets lie in one component, all links are then found by comparing all sets of each component; a large
component is cut into blocks and each pair of blocks is a task, so a set travels once a block and not once a link.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, written

PERCENT = 75
WIDTH = 5
#: Sets of more shingles are heavy in any case: their pairs of prefix shingles are too many.
MOST_LIGHT = 48
#: Counters of the sketch, and the parts in which its sums are taken. Their number changes cost alone.
CELLS, SLICES = 1 << 22, 64
#: Entries of a list that one task takes; a longer list is dealt over several.
MOST_ENTRIES = 500_000
#: Sets of a list's tile.
TILE = 512
_BLOCK = 1_000_000
#: Sets, and shingles, of a block of a large component.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1_000_000
_K = np.uint64(0x9E3779B97F4A7C15)
ENTRY = np.dtype([("key", "<u8"), ("part", "<u4"), ("node", "<i8"), ("n", "<i4"), ("at", "<u2")])


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, memo: _Words) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct WIDTH-word shingles; of fewer words, the whole sequence is one."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and the six ASCII blanks
    if len(memo) > 250_000:
        memo.clear()
    h = np.fromiter(map(memo.__getitem__, w), np.uint64, len(w))
    width = min(WIDTH, len(h))
    if not width:
        return h
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = out * _K + h[k : len(h) - width + 1 + k]
    return np.unique(_mix(out))


def node_of(s: np.ndarray) -> int:
    """A 64-bit hash of a whole set; no two sets of the same documents are told apart by less."""
    both = np.array([np.bitwise_xor.reduce(_mix(s + _K))]) + np.array([s.sum()]) * _K + np.uint64(len(s))
    return int(_mix(both).view(np.int64)[0])


def signature(s: np.ndarray) -> bytes:
    """Of each residue of the hashes, whether it is met an odd number of times; as many residues as the power of two from 2 n on."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def may_link(x: bytes, n: int, y: bytes, m: int, percent: int) -> bool:
    """Whether the signatures of sets of n and m shingles leave it open that they link: linked sets differ in (n + m)(1 - t) / (1 + t) shingles at most."""
    if len(x) < len(y):
        x, y = y, x
    u, v, bits = int.from_bytes(x, "little"), int.from_bytes(y, "little"), len(x) * 8
    while bits > len(y) * 8:  # half the residues: both halves fall together
        bits //= 2
        u = (u >> bits) ^ (u & ((1 << bits) - 1))
    return (u ^ v).bit_count() * (100 + percent) <= (n + m) * (100 - percent)


def need(n, percent: int = PERCENT):
    """Shingles that a set of n must share with any partner."""
    return -(-n * percent // 100)


def _sets(batches: Iterator[pa.RecordBatch]):
    """Blocks of (doc ids, sets, nodes), bounded by shingles."""
    memo, held, size = _Words(), [], 0
    for b in batches:
        for doc, t in zip(b.column(0).to_pylist(), b.column(1)):
            s = shingles(t.as_py(), memo)
            held.append((doc, s, node_of(s) if len(s) else 0))
            size += len(s)
            if size >= _BLOCK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _distinct(block) -> list[tuple[int, np.ndarray]]:
    return list({node: s for _, s, node in block if len(s)}.items())


def _row_batches(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def packed(v: np.ndarray) -> bytes:
    """Counters of a slice, at their smallest width; the non-zero ones alone where that is shorter."""
    kind = next(k for k in "BHIQ" if v.max(initial=0) < 1 << 8 * np.dtype(k).itemsize)
    at = np.flatnonzero(v)
    if len(at) * (2 + np.dtype(kind).itemsize) < len(v) * np.dtype(kind).itemsize:
        return f"s{kind}".encode() + at.astype("<u2").tobytes() + v[at].astype(kind).tobytes()
    return f"d{kind}".encode() + v.astype(kind).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    kind, body = np.dtype(chr(raw[1])), raw[2:]
    if raw[:1] == b"d":
        return np.frombuffer(body, kind).astype(np.uint64)
    n = len(body) // (2 + kind.itemsize)
    out = np.zeros(CELLS // SLICES, np.uint64)
    out[np.frombuffer(body, "<u2", n)] = np.frombuffer(body, kind, n, 2 * n)
    return out


_FIRST = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("sig", pa.binary()), ("slice", pa.int32()), ("salt", pa.int32()), ("cells", pa.binary()), ("costs", pa.binary()), ("blocks", pa.int64())])


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its set's size, node and signature; per task, in rows without them, the slices of its sketch and the costs of light and heavy by size."""
    cells, costs, blocks = np.zeros(CELLS, np.uint32), np.zeros((MOST_LIGHT + 1, 3)), 0
    for block in _sets(batches):
        n = len(block)
        rows = {"doc_id": [d for d, _, _ in block], "n": [len(s) for _, s, _ in block], "node": [k for _, _, k in block], "sig": [signature(s) if len(s) else None for _, s, _ in block]}
        yield _row_batches(rows | dict.fromkeys(("slice", "salt", "cells", "costs", "blocks"), [None] * n), _FIRST)
        sets = [s for _, s in _distinct(block)]
        if not sets:
            continue
        values, counts = np.unique(np.concatenate(sets), return_counts=True)
        np.add.at(cells, (values % np.uint64(CELLS)).astype(np.int64), counts.astype(np.uint32))
        blocks += 1
        for s in sets:
            if len(s) <= MOST_LIGHT:
                c = np.sort(counts[np.searchsorted(values, s)])
                p = len(s) - need(len(s))
                costs[len(s)] += ((p + 2) * (p + 1) / 2, p + 1, c[: p + 1].sum() - (p + 1))
    if blocks:
        parts = [(k, packed(v)) for k, v in enumerate(np.split(cells, SLICES)) if v.any()]
        m = len(parts) + 1
        salt = int(values[0] % np.uint64(16))  # sums are taken in two steps, so no task meets a slice of all others
        yield _row_batches(dict.fromkeys(("doc_id", "n", "node", "sig"), [None] * m) | {"slice": [*[k for k, _ in parts], None], "salt": [salt] * m, "cells": [*[v for _, v in parts], None], "costs": [*[None] * (m - 1), costs.tobytes()], "blocks": [*[None] * (m - 1), blocks]}, _FIRST)


def _summed_cells(last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slices of the sketch added up; last: as weights, six a doubling of the count, in one byte each."""
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1)):
                v = unpacked(v.as_py())
                total[k] = total[k] + v if k in total else v
        own = [np.minimum(255, np.round(6 * np.log2(1.0 + v))).astype(np.uint8).tobytes() if last else packed(v) for v in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(own, pa.binary())], ["slice", "cells"])

    return run


def boundary(costs: np.ndarray, blocks: int) -> int:
    """The largest size of light sets: the total cost of lights up to it and heavies above is lowest. costs: by size, pairs of a light set, shingles of a heavy one, and other sets met in its lists in a block."""
    light, heavy = costs[:, 0], costs[:, 1] + costs[:, 2] * blocks
    return int(np.argmin(np.cumsum(light) + heavy.sum() - np.cumsum(heavy)))


def entries(node: int, s: np.ndarray, weight: np.ndarray, light: int, percent: int) -> np.ndarray:
    """What a set puts into the join: its light pairs and its heavy shingles, as ENTRY rows. weight: of each shingle, how often it is, by the sketch; s is sorted.

    at is how many of the set's shingles come before the list's (before the second one of a pair, less one): of two sets that meet in a
    list first there, no more are shared than min(n - at) of both. part deals a long list over several tasks.
    """
    n, o = len(s), need(len(s), percent)
    order = np.argsort(weight, kind="stable")
    s, weight = s[order], weight[order]
    keys, at, often = [], [], []
    if n <= light:
        p = min(n, n - o + 2)
        i, j = np.triu_indices(p, 1) if p > 1 else (np.zeros(1, np.int64), np.ones(1, np.int64))
        keys.append(_mix(s[i] * _K + s[j]) if p > 1 else s[:1])  # a single shingle links with its equal alone, which is in its class
        at.append(j - 1)
        often.append(weight[i])
    if n > light or n * 100 > (light + 1) * percent - 100:
        keys.append(s[: n - o + 1])
        at.append(np.arange(n - o + 1))
        often.append(weight[: n - o + 1])
    out = np.zeros(sum(map(len, keys)), ENTRY)
    out["key"], out["node"], out["n"], out["at"] = np.concatenate(keys), node, n, np.minimum(np.concatenate(at), 65535)
    parts = (np.exp2(np.concatenate(often) / 6) / MOST_ENTRIES).astype(np.uint64)
    if parts.any():
        out["part"] = np.where(parts > 0, np.uint64(node & 0x7FFFFFFF) % (parts + np.uint64(1)) + np.uint64(1), 0)
    return out


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_PACKED = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])


def _second_pass(weights: np.ndarray, light: int, buckets: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _sets(batches):
            sets = _distinct(block)
            if not sets:
                continue
            e = np.concatenate([entries(node, s, weights[(s % np.uint64(CELLS)).astype(np.int64)], light, percent) for node, s in sets])
            bucket = ((_mix(e["key"] + e["part"] * _K) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            e, bucket = e[order], bucket[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            yield _row_batches({"bucket": bucket[cuts], "payload": [x.tobytes() for x in np.split(e, cuts[1:])]}, _PACKED)

    return run


_LISTS = "kind int, a long, b long, list_id long, nodes array<long>, sizes array<int>"
_LISTS_ARROW = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("list_id", pa.int64()), ("nodes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))])


def _fits(n, m, percent: int):
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _lists(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one bucket: pairs of each list's first set with its others (kind 0), and the lists of three sets or more, equal ones once, and parts of dealt ones under their list's name (kind 1)."""
        e = np.frombuffer(b"".join(x.as_py() for x in table.column("payload")), ENTRY)
        e = e[np.lexsort((e["at"], e["node"], e["part"], e["key"]))]
        fresh = (e["key"][1:] != e["key"][:-1]) | (e["part"][1:] != e["part"][:-1])
        e = e[np.r_[True, fresh | (e["node"][1:] != e["node"][:-1])]]
        start = np.flatnonzero(np.r_[True, (e["key"][1:] != e["key"][:-1]) | (e["part"][1:] != e["part"][:-1])])
        size = np.diff(np.r_[start, len(e)])
        stays = (size > 1) | (e["part"][start] > 0)
        e, size = e[np.repeat(stays, size)], size[stays]
        start = np.cumsum(size) - size
        first = np.repeat(start, size)
        other = np.flatnonzero(first != np.arange(len(e)))
        m, n = e["n"][other], e["n"][first[other]]
        shared = np.minimum(m - e["at"][other], n - e["at"][first[other]])
        ok = other[_fits(m, n, percent) & (100 * shared >= percent * (m + n - shared))]
        a, b = e["node"][first[ok]], e["node"][ok]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
        a, b = a[fresh], b[fresh]
        lists, dealt = {}, []
        for i, n in zip(start.tolist(), size.tolist()):
            if e["part"][i]:
                dealt.append((int(e["key"][i] | np.uint64(1 << 63)) - (1 << 64), i, n))
            elif n > 2:
                lists.setdefault(xxhash.xxh3_64_intdigest(e["node"][i : i + n].tobytes()) >> 1, (i, n))
        own = [*[(k, i, n) for k, (i, n) in lists.items()], *dealt]
        k, m = len(a), len(own)
        return pa.Table.from_arrays(
            [
                pa.array([0] * k + [1] * m, pa.int32()), pa.array([*a.tolist(), *[None] * m], pa.int64()), pa.array([*b.tolist(), *[None] * m], pa.int64()),
                pa.array([None] * k + [x for x, _, _ in own], pa.int64()), pa.array([None] * k + [e["node"][i : i + n] for _, i, n in own], pa.list_(pa.int64())), pa.array([None] * k + [e["n"][i : i + n] for _, i, n in own], pa.list_(pa.int32())),
            ],
            schema=_LISTS_ARROW,
        )

    return run


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits the signature x differs from each row of y, as 64-bit words; the longer ones are folded to the length of the others."""
    while len(x) > y.shape[1]:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while y.shape[1] > len(x):
        y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def _across(percent: int, best: bool):
    def pairs(table: pa.Table) -> Iterator[tuple[int, int]]:
        groups: dict[tuple, list] = {}
        for k, i, j, *row in zip(*(table.column(c).to_pylist() for c in ("list_id", "i", "j", "block", "node", "root", "n", "sig"))):
            groups.setdefault((k, i, j), []).append(row)
        for (_, i, j), rows in groups.items():
            block, node, root, n = (np.array(c, np.int64) for c in list(zip(*rows))[:4])
            length = np.array([len(r[4]) for r in rows])
            of = {m: np.flatnonzero(length == m) for m in set(length.tolist())}
            words = {m: np.frombuffer(b"".join(rows[r][4] for r in at), "<u8").reshape(len(at), -1) for m, at in of.items()}
            nearest: dict[int, tuple] = {}
            for m, at in of.items():
                for k, x in zip(at.tolist(), words[m]):
                    if block[k] != i:
                        continue
                    for other in (m, m * 2, m // 2):  # a partner's size is within a third
                        to = of.get(other)
                        if to is None:
                            continue
                        open_ = (root[to] != root[k]) & (block[to] == j) & _fits(n[to], n[k], percent)
                        open_ &= node[to] > node[k] if i == j else True
                        if open_.any():
                            to = to[open_]
                            apart = _differing(x, words[other][open_]) / (n[to] + n[k])
                            near = apart * (100 + percent) <= 100 - percent + 1e-9
                            if not best:
                                yield from ((min(int(node[k]), y), max(int(node[k]), y)) for y in node[to[near]].tolist())
                            else:
                                for d, y in zip(apart[near].tolist(), to[near].tolist()):
                                    pair = (d, min(int(node[k]), int(node[y])), max(int(node[k]), int(node[y])))
                                    for r in (int(root[k]), int(root[y])):
                                        nearest[r] = min(nearest.get(r, pair), pair)
            yield from (p[1:] for p in nearest.values())

    def run(table: pa.Table) -> pa.Table:
        """Of tiles (list_id, i, j): the pairs of sets in different components that their signatures leave open; best: of each component its likeliest one."""
        own = list(dict.fromkeys(pairs(table)))
        return pa.Table.from_arrays([pa.array([p[k] for p in own], pa.int64()) for k in (0, 1)], schema=_LINKS)

    return run


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _sets(batches):
        own = _distinct(block)
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.int64()), pa.array([s.tobytes() for _, s in own], pa.binary())], ["node", "set"])


def _open(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [may_link(*row, percent) for row in zip(*(b.column(c).to_pylist() for c in ("sig", "n", "sig_b", "n_b")))]
            yield b.select(["a", "b", "count"]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _shared(x: list[np.ndarray], y: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Of each set of x, how many shingles it shares with each set of y."""
    values = np.concatenate(y)
    owner = np.repeat(np.arange(len(y)), [len(s) for s in y])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    for i, s in enumerate(x):
        lo, hi = np.searchsorted(values, s), np.searchsorted(values, s, "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield i, np.bincount(owner[at], minlength=len(y))


_COUNTS = pa.schema([("node", pa.int64()), ("n_links", pa.int64())])


def _links_within(percent: int, counted: bool):
    def batches(table: pa.Table) -> Iterator[pa.RecordBatch]:
        groups = {}
        for root, i, j, block, node, copies, s in zip(*(table.column(c).to_pylist() for c in ("root", "i", "j", "block", "node", "copies")), table.column("set")):
            groups.setdefault((root, i, j), {})[node] = (block, copies, np.frombuffer(s.as_buffer(), "<u8"))  # a repeated doc_id may have brought a set twice
        for (_, i, j), own in groups.items():
            side = [[(k, c, s) for k, (block, c, s) in own.items() if block == b] for b in (i, j)]
            if not side[0] or not side[1]:
                continue
            (x, cx, sx), (y, cy, sy) = (tuple(zip(*v)) for v in side)
            x, y, cx, cy = (np.array(v, np.int64) for v in (x, y, cx, cy))
            m, nx, ny = np.array([len(s) for s in sy]), np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
            for k, shared in _shared(sx, sy):
                at = 100 * shared >= percent * (len(sx[k]) + m - shared)
                at &= x[k] < y if i == j else x[k] != y
                at = np.flatnonzero(at)
                if counted:
                    nx[k] += cy[at].sum()
                    ny[at] += cx[k]
                elif len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x[k], y[at])), pa.array(np.maximum(x[k], y[at]))], schema=_LINKS)
            if counted:
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[x, y]), pa.array(np.r_[nx, ny])], schema=_COUNTS)

    def run(table: pa.Table) -> pa.Table:
        """Of each pair of blocks (root, i, j): the links (a, b), a < b, or of each node the sum of its partners' copies."""
        return pa.Table.from_batches(batches(table), _COUNTS if counted else _LINKS)

    return run


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """(node, root) of each node of edges (a, b): root is the smallest node that it reaches. By alternating large and small stars, each round written, so a hub's edges are never one group."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), name)
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        was = e
        e = written(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
        discard(was)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


@contextmanager
def _small_batches(spark):
    """Arrow batches of 1,000 rows while a step is planned and run: rows hold whole texts or two sets, of which 10,000 are 100 MB on both sides of a worker. The session's own setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(min(1000, int(was)) if int(was) > 0 else 1000))
    try:
        yield
    finally:
        spark.conf.set(key, was)


class Join:
    """The steps of the join over one table of documents."""

    def __init__(self, docs: DataFrame, text: str = "text", percent: int = PERCENT):
        self.spark, self.percent = docs.sparkSession, percent
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
        with _small_batches(self.spark):
            first = written(self.docs.mapInArrow(_first_pass, "doc_id long, n long, node long, sig binary, slice int, salt int, cells binary, costs binary, blocks long"), "sets")
        self.sets = first.where(F.col("n").isNotNull()).select("doc_id", "n", "node", "sig")
        part = first.where(F.col("slice").isNotNull()).repartition(SLICES, "slice", "salt").select("slice", "cells").mapInArrow(_summed_cells(False), "slice int, cells binary")
        weights = part.repartition(SLICES, "slice").mapInArrow(_summed_cells(True), "slice int, cells binary").collect()  # CELLS bytes in all
        self.weights = np.zeros((SLICES, CELLS // SLICES), np.uint8)
        for r in weights:
            self.weights[r["slice"]] = np.frombuffer(r["cells"], np.uint8)
        self.weights = self.weights.ravel()
        costs = first.where(F.col("costs").isNotNull()).select("costs", "blocks").mapInArrow(_summed_costs, "costs binary, blocks long").collect()  # one row a task
        blocks = sum(r["blocks"] for r in costs)
        self.light = boundary(sum((np.frombuffer(r["costs"]).reshape(-1, 3) for r in costs), np.zeros((MOST_LIGHT + 1, 3))), blocks)
        self.shingles = self.sets.agg(F.sum("n")).first()[0] or 0
        self.classes = written(self.sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("copies")), "classes")

    def lists(self) -> DataFrame:
        """Pairs and lists of all buckets; a bucket holds some 16 MB of entries, however many there are."""
        buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), int(self.shingles * 0.3 * ENTRY.itemsize / 16e6))
        rows = self.docs.mapInArrow(_second_pass(self.weights, self.light, buckets, self.percent), "bucket int, payload binary")
        with _small_batches(self.spark):
            return written(rows.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_lists(self.percent), _LISTS), "lists")

    def load(self, nodes: DataFrame) -> DataFrame:
        """(node, set) of the nodes, from the texts of one document of each. A null doc_id brings the sets of all null ones; only those of the nodes stay."""
        ids = written(self.classes.join(nodes, "node", "left_semi").select("doc_id", "node"), "candidates")
        few = ids.count() <= 500_000  # 16 bytes each; beyond that the texts are shuffled
        to_all = F.broadcast if few else lambda df: df
        own = ids.select(F.col("doc_id").alias("_id")).distinct()
        sets = self.docs.join(to_all(own), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").mapInArrow(_set_rows, "node long, set binary")
        with _small_batches(self.spark):
            return written(sets.join(to_all(ids.select("node")), "node", "left_semi"), "candidate-sets")

    def passed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, count) that their signatures leave open."""
        x = self.classes.select(F.col("node").alias("a"), "sig", "n")
        y = self.classes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"), F.col("n").alias("n_b"))
        return pairs.join(x, "a").join(y, "b").select("a", "b", "count", "sig", "n", "sig_b", "n_b").mapInArrow(_open(self.percent), "a long, b long, count long")

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) that link. The pairs are sent to the sets where there are few of them, so each set of b travels once a pair, and of the others those of a alone."""
        few = pairs.count() <= 500_000  # 16 bytes each; beyond that both sides are shuffled
        to_all = F.broadcast if few else lambda df: df
        y = sets.select(F.col("node").alias("b"), F.col("set").alias("y")).join(to_all(pairs), "b")
        x = sets.select(F.col("node").alias("a"), F.col("set").alias("x")).join(to_all(pairs.select("a").distinct()), "a", "left_semi")
        return y.join(x, "a").select("a", "b", "x", "y").mapInArrow(_linked(self.percent), "a long, b long")

    def across(self, lists: DataFrame, roots: DataFrame, best: bool) -> DataFrame:
        """Pairs (a, b) of sets of one list and different components (node, root) that their signatures leave open; best: of each component the likeliest one in each tile. Lists whose sets all lie in one component give none."""
        flat = lists.select("list_id", F.explode(F.arrays_zip(F.col("nodes").alias("node"), F.col("sizes").alias("n"))).alias("x")).select("list_id", "x.node", "x.n")
        known = flat.join(roots, "node", "left").select("list_id", "node", "n", F.coalesce("root", "node").alias("root"))
        mixed = known.groupBy("list_id").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.count("*") / TILE).cast("int").alias("k")).where("lo != hi").select("list_id", "k")
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions")) * 4
        of = known.join(mixed, "list_id").join(self.classes.select("node", "sig"), "node").withColumn("block", F.expr("cast(pmod(xxhash64(node), k) as int)"))
        of = of.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumns({"i": F.least("block", "c"), "j": F.greatest("block", "c")})
        task = F.when(F.col("k") == 1, F.expr(f"pmod(xxhash64(list_id), {buckets})")).otherwise(F.xxhash64("list_id", "i", "j"))  # short lists share tasks
        return of.select(task.alias("task"), "list_id", "i", "j", "block", "node", "root", "n", "sig").groupBy("task").applyInArrow(_across(self.percent, best), "a long, b long")

    def edges(self) -> DataFrame:
        """Edges (a, b) between classes: verified links, enough of them to connect all that link. Their sets stay in self.loaded."""
        found = self.lists()
        with _small_batches(self.spark):
            pairs = written(self.passed(found.where("kind = 0").groupBy("a", "b").count()), "pairs")
            # each set meets the one first set with which it shares most; of its other pairs those stay open that lie in two components after that
            likeliest = written(pairs.groupBy("b").agg(F.max_by("a", F.struct("count", "a")).alias("a")).select("a", "b"), "likeliest")
            self.loaded = self.load(_nodes(likeliest))
            edges = written(self.verified(likeliest, self.loaded), "links")
            lists = found.where("kind = 1").select("list_id", "nodes", "sizes")
            lists = lists.where("list_id >= 0").dropDuplicates(["list_id"]).unionByName(lists.where("list_id < 0"))  # equal lists once; the parts of a dealt one all
            tested = likeliest
            # components join at their likeliest pairs first, so a group of near copies is one when all pairs that are still open between components are tried
            for best in (True, False):
                roots = written(components(edges), "roots")
                more = self.across(lists, roots, best)
                if not best:
                    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: B023, E731
                    rest = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
                    more = more.unionByName(rest.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b"))
                more = written(more.distinct().join(tested, ["a", "b"], "left_anti"), "more-pairs")
                discard(roots)
                if more.isEmpty():
                    continue
                late = self.load(_nodes(more).join(self.loaded.select("node").distinct(), "node", "left_anti"))
                self.loaded = self.loaded.unionByName(late)
                edges = written(edges.unionByName(self.verified(more, self.loaded)), "links")
                tested = tested.unionByName(more)
            return edges

    def _within(self, roots: DataFrame, counted: bool) -> DataFrame:
        """All links (a, b) between classes, or (node, n_links), from all pairs of sets of each component (node, root)."""
        of = roots.join(self.classes.select("node", "n", "copies"), "node")
        parts = of.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("k"))
        size = of.agg(F.sum("n")).first()[0] or 0
        buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), int(size * 8 / 16e6))
        of = of.join(parts, "root").select("node", "root", "copies", "k", F.expr("cast(pmod(xxhash64(node), k) as int)").alias("block"))
        of = of.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumns({"i": F.least("block", "c"), "j": F.greatest("block", "c")})
        task = F.when(F.col("k") == 1, F.expr(f"pmod(xxhash64(root), {buckets})")).otherwise(F.xxhash64("root", "i", "j"))  # small components share tasks
        sets = of.withColumn("task", task).join(self.loaded, "node").select("task", "root", "i", "j", "block", "node", "copies", "set")
        return sets.groupBy("task").applyInArrow(_links_within(self.percent, counted), "node long, n_links long" if counted else "a long, b long")

    def links(self) -> DataFrame:
        """All links (a, b), a < b, between classes, by node."""
        return self._within(written(components(self.edges()), "roots"), False)

    def documents(self, count_links: bool = True) -> DataFrame:
        """doc_id, n_shingles and component_id of each document, and n_links if asked for."""
        roots = components(self.edges())
        if count_links:
            roots = written(roots, "roots")
        known = self.classes.select("node", "doc_id").join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
        least = known.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        of = known.join(least, "root").select(F.col("node").alias("_c"), "component_id")
        if count_links:
            n = self._within(roots, True).groupBy("node").agg(F.sum("n_links").alias("others"))
            n = self.classes.join(n, "node", "left").select(F.col("node").alias("_c"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
            of = of.join(n, "_c")
        # one join of the documents for both columns; a class of very many copies is still one key of it
        out = self.sets.join(of, (self.sets["node"] == of["_c"]) & (self.sets["n"] > 0), "left")
        columns = ["doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")]
        return out.select(*columns, *([F.coalesce("n_links", F.lit(0)).alias("n_links")] if count_links else []))


def _summed_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros((MOST_LIGHT + 1) * 3), 0
    for b in batches:
        for c, k in zip(b.column(0), b.column(1).to_pylist()):
            total, n = total + np.frombuffer(c.as_py()), n + k
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["costs", "blocks"])


def join(docs: DataFrame, text: str = "text", percent: int = PERCENT, count_links: bool = True) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, the smallest doc_id reachable by links of Jaccard similarity percent / 100 or more,
    and n_links, its number of links: the other rows that reach this similarity with it, equal texts among them. Without count_links that column is left out.

    Null and blank texts have no shingles and no links. Repeated rows are linked by their equal texts; null doc_ids take part, but name a
    component only where all its doc_ids are null. Other columns are left out.
    """
    return Join(docs, text, percent).documents(count_links)


def query(docs: DataFrame) -> DataFrame:
    return join(docs)
