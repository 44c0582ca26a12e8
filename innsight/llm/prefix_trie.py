"""The prefix trie of conversations, from globally sorted turn arrays: LCP intervals swept by a stack, open stacks stitched across range partitions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

WIDTH = 16  # bytes of a turn's mark in a key
TURNS = 500_000  # of a range partition; changes cost alone
CHUNK = 65_536  # ids of a list that crosses partitions, a row
NODE, ORPHAN, PIECE, ENDS = 0, 1, 2, 3
_OUT = "kind int, part int, name binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, seq long, ids array<long>"
_ARROW = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("name", pa.binary()), ("parent", pa.binary()), *((c, pa.int64()) for c in ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string()), ("seq", pa.int64()), ("ids", pa.list_(pa.int64()))])
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): one row a conversation, its turns as an array of (turn, mark, words) by turn, null first.

    A mark is 128 bits of SHA-256 over role and text (null: empty), so texts stay behind; words counts `[^\\x20\\x09-\\x0D]+` in the text. Turns of one number come by their marks, repeated rows
    are turns of their own, rows without a conv_id belong to none. Other columns are ignored. An array takes 48 bytes a turn: a conversation of ten million turns still fits a task.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    mark = F.left(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(2 * WIDTH))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), mark.alias("mark"), words.alias("words")).where("conv_id IS NOT NULL")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "mark", "words"))).alias("turns"))


def rebuilt(arrays: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """arrays where conversation c begins with the first h turns of c - c % every (none if that is absent) in place of its own first h; h = crc32 of c as text, modulo most."""
    heads = arrays.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    j = arrays.join(heads, F.col("conv_id") - F.col("conv_id") % every == F.col("base"), "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    none = F.slice("turns", 1, 0)
    return j.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def shared(a: bytes, b: bytes) -> int:
    """How many turns two keys share from the start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    low, high = 0, n // WIDTH
    while high - low > 1:
        mid = (low + high) // 2
        at, to = low * WIDTH, mid * WIDTH
        low, high = (mid, high) if a[at:to] == b[at:to] else (low, mid)
    return low


def names(key: bytes, depth: int) -> list[bytes]:
    """Names of the nodes on a key's path, to a depth."""
    h = hashlib.blake2b(digest_size=WIDTH)
    out = [h.digest()]
    for i in range(depth):
        h.update(key[i * WIDTH : (i + 1) * WIDTH])
        out.append(h.copy().digest())
    return out


class _Node:
    __slots__ = ("starts", "words", "low", "n", "children", "leaves", "told", "once", "ends", "waiting")

    def __init__(self, starts: bool, words: int):
        self.starts, self.words, self.low, self.n, self.children, self.leaves, self.told, self.once, self.ends, self.waiting = starts, words, None, 0, 0, 0, 0, 0, [], []


class Sweep:
    """Sweeps the sorted (key, conv_id, words) of one range partition; a stack holds the nodes on the last key's path.

    left and right: how many turns the partition's first and last key share with their neighbours, -1 without one. Nodes at most so deep go on there and come out as PIECE rows; every
    distinct node counts once, where it starts, and a leaf where it ends, so that a node's pieces add up. Nodes inside come out whole: as NODE rows, or as ORPHAN rows with their parent's name
    while that goes on elsewhere. What it holds is bounded by the partition and the depth.
    """

    def __init__(self, part: int, left: int, right: int):
        self.part, self.left, self.right = part, left, right
        self.stack: list[_Node] = []
        self.key: bytes | None = None
        self.out: list[tuple] = []

    def add(self, key: bytes, conv_id: int, words: list[int]) -> None:
        if self.key is None:
            limit, self.at_left = self.left, names(key, max(self.left, 0))
        else:
            limit = -1
            self._close(shared(self.key, key))
        depth = len(key) // WIDTH
        for d in range(len(self.stack), depth + 1):
            node = _Node(d > limit, words[d - 1] if d else 0)
            if d and node.starts:
                self.stack[-1].children += 1
            self.stack.append(node)
        end = self.stack[depth]
        end.n += 1
        end.low = conv_id if end.low is None else min(end.low, conv_id)
        end.ends.append(conv_id)
        self.key = key

    def end(self) -> None:
        if self.key is not None:
            self.at_right = names(self.key, max(self.right, 0))
            self._close(-1, True)

    def _close(self, keep: int, last: bool = False) -> None:
        """Takes the nodes below a depth from the stack; last: also what goes on in the next partition."""
        leaf = len(self.key) // WIDTH
        while len(self.stack) > keep + 1:
            d = len(self.stack) - 1
            x = self.stack.pop()
            on_right = last and d <= self.right
            x.leaves += d == leaf and not on_right
            x.told += x.n * x.words
            x.once += x.words if x.starts else 0
            up = self.stack[-1] if d else None
            if up:
                up.n, up.leaves, up.told, up.once = up.n + x.n, up.leaves + x.leaves, up.told + x.told, up.once + x.once
                up.low = x.low if up.low is None else min(up.low, x.low)
            figures = (x.n, x.children, x.leaves, x.told - x.once)
            if on_right or not x.starts:
                path = self.at_right if on_right else self.at_left
                name = path[d]
                self.out.append((PIECE, self.part, name, path[d - 1] if d else None, d, x.low, None, *figures, None, None, None))
                self.out += [(ENDS, self.part, name, *[None] * 9, i, x.ends[i : i + CHUNK]) for i in range(0, len(x.ends), CHUNK)]
                self.out += [(ORPHAN, self.part, None, name, *w, None, None) for w in x.waiting]
                continue
            digest = hashlib.sha256(",".join(map(str, x.ends)).encode()).hexdigest() if x.ends else EMPTY
            own = (d, x.low, None, *figures, digest)
            self.out += [(NODE, self.part, None, None, w[0], w[1], x.low, *w[3:], None, None) for w in x.waiting]
            if up is None:
                self.out.append((NODE, self.part, None, None, *own, None, None))
            elif up.starts:
                up.waiting.append(own)
            else:
                self.out.append((ORPHAN, self.part, None, self.at_left[d - 1], *own, None, None))


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
        rows.clear()


def _swept(edges: dict[int, tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            for part, key, conv_id, words in zip(*[c.to_pylist() for c in b.columns]):
                if now is None or part != now.part:
                    if now:
                        now.end()
                        yield from _batches(now.out)
                    now = Sweep(part, *edges[part])
                now.add(key, conv_id, words)
                if len(now.out) > 20_000:
                    yield from _batches(now.out)
        if now:
            now.end()
            yield from _batches(now.out)

    return run


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (part, low, high) in order: (part, left, right), what a part's ends share with the parts beside it."""
    before, high, left = None, b"", -1
    for b in batches:
        rows = []
        for part, lo, hi in zip(*[c.to_pylist() for c in b.columns]):
            met = -1
            if before is not None:
                met = shared(high, lo)
                rows.append((before, left, met))
            before, high, left = part, hi, met
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in zip(*rows)], ["part", "lo", "hi"])
    if before is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()) for c in (before, left, -1)], ["part", "lo", "hi"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each name's ids, streamed in order: a digest is sequential, but holds no more than one chunk."""
    name, h = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([h.hexdigest()])], ["name", "ends_sha256"])
    for b in batches:
        for n, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if n != name:
                if h:
                    yield row()
                name, h = n, hashlib.sha256()
            else:
                h.update(b",")
            h.update(",".join(map(str, ids)).encode())
    if h:
        yield row()


def trie(arrays: DataFrame) -> DataFrame:
    """The nodes over (conv_id, turns) of turn_arrays(), conv_id being unique: one row each distinct sequence of first turns, from the root at depth 0.

    A node is known by conv_id, its smallest member, and depth; parent_conv_id is that of its parent (null for the root), n_convs its members, n_children and n_leaves the children
    and the childless nodes below or at it, saved_tokens the words that its subtree's texts need not be read again for, and ends_sha256 digests the sorted ids of the members that end at it.
    Conversations without turns end at the root; without conversations there is no node.

    Range partitions are cut by key and then conv_id, so that equal conversations spread over tasks. The driver gets two numbers for each partition.
    """
    spark = arrays.sparkSession
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["mark"]), ""))
    rows = written(arrays.select(key.alias("key"), "conv_id", F.transform("turns", lambda t: t["words"]).alias("words")), "turn-keys")
    turns = rows.agg(F.sum(F.size("words"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // TURNS))
    ranged = written(rows.repartitionByRange(n, "key", "conv_id").select(F.spark_partition_id().alias("part"), "key", "conv_id", "words"), "turn-ranges")
    ends = ranged.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    edges = {r["part"]: (r["lo"], r["hi"]) for r in ends.repartition(1).sortWithinPartitions("part").mapInArrow(_edges, "part int, lo int, hi int").collect()}
    dealt = ranged.repartitionByRange(n, "part").sortWithinPartitions("part", "key", "conv_id")
    out = written(dealt.mapInArrow(_swept(edges), _OUT), "trie")
    pieces = out.where(F.col("kind") == PIECE)
    figures = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    open_ = written(pieces.groupBy("name", "parent", "depth").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in figures]), "trie-stitched")
    chunks = out.where(F.col("kind") == ENDS).select("name", "ids", "part", "seq").repartition("name").sortWithinPartitions("name", "part", "seq")
    digests = chunks.select("name", "ids").mapInArrow(_digests, "name binary, ends_sha256 string")
    above = open_.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    stitched = open_.join(digests, "name", "left").join(above, "parent", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    here = pieces.select("part", "name").distinct().join(open_.select("name", F.col("conv_id").alias("up")), "name").select("part", F.col("name").alias("parent"), "up")
    orphans = out.where(F.col("kind") == ORPHAN).join(here, ["part", "parent"]).withColumn("parent_conv_id", F.col("up"))
    return out.where(F.col("kind") == NODE).select(COLUMNS).unionByName(orphans.select(COLUMNS)).unionByName(stitched.select(COLUMNS))


def node_turns(nodes: DataFrame, arrays: DataFrame) -> DataFrame:
    """(conv_id, depth, turn, mark, words): the last turn of each node but the root, as the node's first conversation has it."""
    at: Column = F.posexplode("turns")
    turns = arrays.select("conv_id", at.alias("i", "t")).select("conv_id", (F.col("i") + 1).cast("long").alias("depth"), "t.*")
    return nodes.select("conv_id", "depth").join(turns, ["conv_id", "depth"])


def query(conversations: DataFrame) -> DataFrame:
    return trie(rebuilt(turn_arrays(conversations)))
