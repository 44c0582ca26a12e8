"""Interpolated modified Kneser-Ney language model: n-grams counted by Spark into sorted hash arrays, which workers map into memory to score texts."""

from __future__ import annotations

import io
import mmap
import os
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fold, shared_dir, written

PAD, BOS, END = 0, 1, 2  # word hashes from 3 on
WINDOWS = 2_000_000  # counted or scored at once in a task; changes cost alone
SHARD_BYTES = 16 << 20  # of text for each shard of the model; changes cost alone
FAN = 512  # blocks that some WINDOWS are cut into at once; more shards take more passes
PIECE = 1 << 20  # characters of a text that are split at once
FALLBACK = (0.5, 1.0, 1.5)  # discounts where too few counts are there to estimate them

# ---- words and windows


def tokens(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, and the end."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: ASCII letters alone are lowered, ASCII blanks alone split
    out, at = [], 0
    while at < len(data):
        to = min(at + PIECE, len(data))
        while to < len(data) and data[to] not in b" \t\n\x0b\x0c\r":
            to += 1
        words = data[at:to].split()
        out.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        at = to
    out.append(np.array([END], np.uint64))
    hashes = np.concatenate(out)
    hashes[:-1] = np.maximum(hashes[:-1], np.uint64(3))
    return hashes


def windows(hashes: np.ndarray, order: int) -> np.ndarray:
    """One row a token: the order - 1 words before it and itself; BOS stands before the first, PAD before that."""
    whole = np.concatenate([np.full(max(order - 2, 0), PAD, np.uint64), np.full(min(order - 1, 1), BOS, np.uint64), hashes])
    return np.lib.stride_tricks.sliding_window_view(whole, order)


def keyed(grams: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each row; of single words the words themselves."""
    out = grams[:, 0].copy()
    for c in range(1, grams.shape[1]):
        x = out * np.uint64(0x9E3779B97F4A7C15) + grams[:, c]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out = x ^ (x >> np.uint64(31))
    return out


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, where each is first found, and the sums of values over each."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[start], order[start], [np.add.reduceat(v[order], start) if len(start) else v[:0] for v in values]


def small(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


def packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}


# ---- arrays in the shared folder


def _local(uri: str) -> str | None:
    """The path of a folder that is mounted on every machine; None for stores that are read through a client."""
    u = urllib.parse.urlparse(uri)
    return urllib.parse.unquote(u.path) if u.scheme in ("", "file") else None


def put(uri: str, arrays: list[np.ndarray]) -> None:
    """Writes arrays one after the other into a file, which appears whole or not at all: a task that is repeated puts the same arrays in its place."""
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    parts = [len(head).to_bytes(8, "little"), head.ljust(-(-len(head) // 8) * 8)]
    for a in arrays:
        raw = a.tobytes()
        parts += [raw, b"\0" * (-len(raw) % 8)]
    path, own = _local(uri), uuid.uuid4().hex
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(f"{path}.{own}", "wb") as f:
            f.writelines(parts)
        os.replace(f"{path}.{own}", path)
    else:
        store, base = pa.fs.FileSystem.from_uri(uri)
        store.create_dir(os.path.dirname(base))
        with store.open_output_stream(f"{base}.{own}") as f:
            for p in parts:
                f.write(p)
        store.move(f"{base}.{own}", base)


def get(uri: str) -> list[np.ndarray] | None:
    """The arrays of put(), mapped into memory, not read; from a store without files, fetched into anonymous memory. None where nothing was put."""
    path = _local(uri)
    try:
        if path is not None:
            with open(path, "rb") as f:
                data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        else:
            store, base = pa.fs.FileSystem.from_uri(uri)
            with store.open_input_file(base) as f:
                data = f.read()
    except FileNotFoundError:
        return None
    size = int.from_bytes(data[:8], "little")
    at, out = 8 + -(-size // 8) * 8, []
    for kind, n in (x.split(",") for x in bytes(data[8 : 8 + size]).decode().split(";")):
        a = np.frombuffer(data, np.dtype(kind), int(n), at)
        out.append(a)
        at += -(-a.nbytes // 8) * 8
    return out


class Shards:
    """Sorted hash arrays over many files; opened where first needed, by each worker for itself."""

    def __init__(self, prefix: str, shards: int, columns: int):
        self.prefix, self.shards, self.columns, self.open = prefix, shards, columns, {}

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def look_up(self, keys: np.ndarray, shard: np.ndarray) -> list[np.ndarray]:
        """For each key its columns as int64, 0 for keys that aren't there. Keys are looked up in order, so that maps are read from front to back."""
        out = [np.zeros(len(keys), np.int64) for _ in range(self.columns)]
        order = np.lexsort((keys, shard))
        cuts = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            at, s = order[lo:hi], int(shard[order[lo]])
            if s not in self.open:
                self.open[s] = get(f"{self.prefix}-{s}")
            if self.open[s] is None:
                continue
            known, *values = self.open[s]
            i = np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)
            found = known[i] == keys[at]
            for o, v in zip(out, values):
                o[at[found]] = v[i[found]]
        return out


# ---- counting


def _spread(grams: np.ndarray, shards: int, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, shards) of n-grams: those of one context share a shard, but for heavy contexts, whose n-grams are dealt over all. Words are dealt by themselves."""
    keys = keyed(grams)
    if grams.shape[1] == 1:
        return keys, (keys % np.uint64(shards)).astype(np.int64)
    context = keyed(grams[:, :-1])
    place = np.where(np.isin(context, heavy), keys, context) if len(heavy) else context
    return keys, (place % np.uint64(shards)).astype(np.int64)


def _blocks(grams: np.ndarray, count: np.ndarray, raw: np.ndarray, shards: int, heavy: np.ndarray, width: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, block) of n-grams, equal ones drawn together; a bucket holds `width` shards. count: what the level counts, raw: occurrences."""
    keys, shard = _spread(grams, shards, heavy)
    shard //= width
    _, first, (count, raw) = summed(keys, count, raw)
    grams, shard = grams[first], shard[first]
    order = np.lexsort((*grams.T[::-1], shard))
    grams, shard, count, raw = grams[order], shard[order], count[order], raw[order]
    cuts = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        g, c, r = grams[lo:hi], count[lo:hi], raw[lo:hi]
        head = np.flatnonzero(np.concatenate([[True], (g[1:, :-1] != g[:-1, :-1]).any(axis=1)])) if g.shape[1] > 1 else np.arange(len(g))
        runs = np.diff(np.append(head, len(g)))  # a context is written once for all that follows it
        same = {} if (c == r).all() else {"raw": small(r)}
        yield int(shard[lo]), packed(contexts=g[head, :-1], runs=small(runs), last=g[:, -1], count=small(c), **same)


def _grams(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    z = unpacked(block)
    grams = np.concatenate([np.repeat(z["contexts"], z["runs"], axis=0), z["last"][:, None]], axis=1)
    count = z["count"].astype(np.int64)
    return grams, count, z["raw"].astype(np.int64) if "raw" in z else count


def _parts(texts: Iterator[tuple[object, str]], most: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(keys, tokens) of some texts at a time, of `most` tokens together unless one text has more."""
    keys, held, n = [], [], 0
    for k, t in texts:
        keys.append(k)
        held.append(tokens(t))
        n += len(held[-1])
        if n >= most:
            yield keys, held
            keys, held, n = [], [], 0
    if keys:
        yield keys, held


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str]]:
    for b in batches:
        for i in range(b.num_rows):  # one at a time: a batch of long texts is held once, by Arrow
            yield b.column(0)[i].as_py(), b.column(1)[i].as_py()


def _rows(blocks: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for bucket, block in blocks:
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([block], pa.binary())], ["bucket", "block"])


def _counted(order: int, shards: int, heavy: np.ndarray, width: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _parts(_texts(batches), most):
            grams = np.concatenate([windows(h, order) for h in held])
            one = np.ones(len(grams), np.int64)
            yield from _rows(_blocks(grams, one, one, shards, heavy, width))

    return run


def _finer(shards: int, heavy: np.ndarray, width: int, most: int):
    """Draws blocks of a bucket together and cuts them into buckets of `width` shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, now = [], 0, None
        for b in batches:
            for i in range(b.num_rows):
                bucket = b.column(0)[i].as_py()
                if held and (bucket != now or n >= most):
                    yield from _rows(_blocks(*(np.concatenate(x) for x in zip(*held)), shards, heavy, width))
                    held, n = [], 0
                now = bucket
                held.append(_grams(b.column(1)[i].as_py()))
                n += len(held[-1][0])
        if held:
            yield from _rows(_blocks(*(np.concatenate(x) for x in zip(*held)), shards, heavy, width))

    return run


def _by_shard(blocks: DataFrame, shards: int, heavy: np.ndarray, width: int) -> DataFrame:
    """Blocks (bucket, block) whose buckets are shards, from buckets of `width` shards: these are cut FAN ways at once, and again until each is one."""
    while width > 1:
        width = -(-width // FAN)
        blocks = blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_finer(shards, heavy, width, WINDOWS), "bucket long, block binary")
    return blocks


def _contexts_of(order: int, most: int):
    """(key, n): how often the contexts of all levels are met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _parts(_texts(batches), most):
            grams = np.concatenate([windows(h, order) for h in held])
            for k in range(2, order + 1):
                keys, _, (n,) = summed(keyed(grams[:, order - k : order - 1]), np.ones(len(grams), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

    return run


_ROWS = "kind string, bucket long, block binary, key long, figures array<long>"


def _reduced(level: int, shards: int, heavy: np.ndarray, width: int, folder: str):
    """All blocks of one level and shard: n-grams and contexts become files of sorted arrays; out come what they add up to, the shard's part of heavy contexts, and blocks for the level below."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("bucket")[0].as_py()
        grams, count, raw = (np.concatenate(x) for x in zip(*(_grams(b.as_py()) for b in table.column("block"))))
        keys, first, (count, raw) = summed(keyed(grams), count, raw)
        grams, rows = grams[first], []
        whole = grams[:, 0] != PAD  # others are shorter than the level: they count below
        c, r = count[whole], raw[whole]
        if len(c):
            put(f"{folder}/{level}-{shard}", [keys[whole], small(c)] if level > 1 else [keys[whole], small(c), small(r)])
            rows.append(("totals", None, None, None, [len(c), int(c.sum()), int(r.sum()), *(int((c == k).sum()) for k in (1, 2, 3, 4))]))
        if level > 1:
            context, _, sums = summed(keyed(grams[whole, :-1]), c, *((c == k).astype(np.int64) for k in (1, 2)), (c >= 3).astype(np.int64))
            spread = np.isin(context, heavy)
            if not spread.all():
                put(f"{folder}/{level}-contexts-{shard}", [context[~spread], *(small(s[~spread]) for s in sums)])
            rows += [("heavy", None, None, int(context[i].view(np.int64)), [int(s[i]) for s in sums]) for i in np.flatnonzero(spread)]
            below = np.where(whole & (grams[:, 1] != BOS), 1, raw)  # a new word to the left counts once; what begins a text has none and counts as often as it is found
            rows += [("below", k, b, None, None) for k, b in _blocks(grams[:, 1:], below, raw, shards, heavy, width)]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64())))], names=["kind", "bucket", "block", "key", "figures"])

    return run


# ---- the model


@dataclass
class Model:
    """What workers need: where the sorted arrays are, discounts, totals, and the sums of heavy contexts, a thousand a level at most. n: training tokens, distinct: different ones."""

    order: int
    n: int
    distinct: int
    heavy: np.ndarray
    heavy_sums: dict[int, np.ndarray]
    grams: dict[int, Shards]
    contexts: dict[int, Shards]
    discounts: dict[int, tuple[float, float, float]]
    total: int  # of the counts of level 1
    counts: list[int]  # at level 1: words counted once, twice, more often

    def discount(self, level: int, count: np.ndarray) -> np.ndarray:
        return np.array([0.0, *self.discounts[level]])[np.minimum(count, 3)]

    def look_up(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability, occurrences of the last word) of each window: each level takes discounted counts and gives what is taken to the level below, the lowest to all words alike, one unknown among them."""
        known = self.grams[1]
        word, place = _spread(grams[:, -1:], known.shards, self.heavy)
        count, raw = known.look_up(word, place)
        p = np.full(len(grams), 1.0 / (self.distinct + 1))
        if self.total:
            p = np.maximum(count - self.discount(1, count), 0) / self.total + p * float(np.dot(self.discounts[1], self.counts)) / self.total
        for level in range(2, self.order + 1):
            own = grams[:, self.order - level :]
            key, place = _spread(own, self.grams[level].shards, self.heavy)
            context = keyed(own[:, :-1])
            sums = self.contexts[level].look_up(context, (context % np.uint64(self.contexts[level].shards)).astype(np.int64))
            if len(self.heavy):
                at = np.minimum(np.searchsorted(self.heavy, context), len(self.heavy) - 1)
                sums = [np.where(self.heavy[at] == context, h[at], s) for h, s in zip(self.heavy_sums[level], sums)]
            total, *few = sums
            (count,) = self.grams[level].look_up(key, place)
            met = (own[:, 0] != PAD) & (total > 0)
            share = sum(d * f for d, f in zip(self.discounts[level], few))
            p = np.where(met, (np.maximum(count - self.discount(level, count), 0) + share * p) / np.maximum(total, 1), p)
        return p, raw


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from counts of counts; fixed ones where these are too few."""
    if not (n1 and n2 and n3 and n4):
        return FALLBACK
    y = n1 / (n1 + 2 * n2)
    out = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return out if all(0 <= d <= k for k, d in enumerate(out, 1)) else FALLBACK


def train(docs: DataFrame, order: int = 2, sample: float = 0.01) -> Model:
    """A model of the texts of docs (doc_id, text; null: empty; repeated rows count each), up to n-grams of `order` words. An empty table gives a model in which all words are unknown.

    Tasks send n-grams drawn together to shards, by hash of the context; a shard's task holds what about 16 MB of text have. Contexts with a thousandth or more of a sampled share of texts,
    a thousand a level at most, are spread over all shards; the sample changes cost alone. Words and n-grams are known by 64-bit hashes. The driver gets sums of each level and of the heavy contexts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id"), F.col("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    met = rows.sample(sample, 1).mapInArrow(_contexts_of(order, WINDOWS), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    total = met.agg(F.sum("n")).first()[0] or 0
    often = met.where(F.col("n") * 1000 * max(order - 1, 1) >= total).collect() if total and shards > 1 else []
    heavy = np.sort(np.array([r["key"] for r in often], np.int64).view(np.uint64))
    width = -(-shards // FAN)
    folder = f"{shared_dir(spark).rstrip('/')}/ngrams-{uuid.uuid4().hex}"
    blocks = rows.mapInArrow(_counted(order, shards, heavy, width, WINDOWS), "bucket long, block binary")
    sums, heavy_sums, tables = {}, {}, []
    for level in range(order, 0, -1):
        out = written(_by_shard(blocks, shards, heavy, width).groupBy("bucket").applyInArrow(_reduced(level, shards, heavy, width, folder), _ROWS), "ngram-counts")
        tables.append(out)
        added = {(r["key"], r["pos"]): r["n"] for r in out.where("kind != 'below'").select("key", F.posexplode("figures").alias("pos", "x")).groupBy("key", "pos").agg(F.sum("x").alias("n")).collect()}
        sums[level] = [added.get((None, i), 0) for i in range(7)]
        heavy_sums[level] = np.array([[added.get((int(k.view(np.int64)), i), 0) for k in heavy] for i in range(4)], np.int64)
        blocks = out.where("kind = 'below'").select("bucket", "block")
    discard(*tables)
    distinct, mass, n, n1, n2 = sums[1][:5]
    return Model(
        order, n, distinct, heavy, heavy_sums,
        {k: Shards(f"{folder}/{k}", shards, 2 if k == 1 else 1) for k in range(1, order + 1)},
        {k: Shards(f"{folder}/{k}-contexts", shards, 4) for k in range(2, order + 1)},
        {k: _discounts(*s[3:]) for k, s in sums.items()},
        mass, [n1, n2, distinct - n1 - n2],
    )


def _scored(model: Model, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, held in _parts(_texts(batches), most):
            grams = np.concatenate([windows(h, model.order) for h in held])
            of = np.repeat(np.arange(len(held)), [len(h) for h in held])
            own, first, inverse = np.unique(keyed(grams), return_index=True, return_inverse=True)
            p, raw = model.look_up(grams[first])
            base = np.log10((raw + 1) / (model.n + model.distinct + 1))
            sums = [np.bincount(of, x[inverse], len(held)) for x in (np.log10(p), base, raw > 0)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([len(h) for h in held], pa.int64()), pa.array(sums[2].astype(np.int64)), pa.array(sums[1]), pa.array(sums[0])], ["row", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(row, n_tokens, n_known, base_score, score, perplexity) for each row of docs, row being its key, cast to long: log10 probabilities of the whole text by add-one unigrams and by the model, and 10 ** (-score / n_tokens)."""
    out = docs.select(F.col(key).cast("long").alias("row"), "text").mapInArrow(_scored(model, WINDOWS), "row long, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def query(docs: DataFrame, order: int = 2) -> DataFrame:
    """Scores of all texts by what the rows of six folds of seven have. Null texts count as empty ones, a null doc_id as empty text when folds are made; repeated rows are scored each."""
    rows = docs.select("doc_id", "text")
    model = train(rows.where(fold("doc_id", 7) != 2), order)
    return score(rows, model).withColumnRenamed("row", "doc_id").select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
