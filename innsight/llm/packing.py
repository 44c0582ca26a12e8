"""Harmonic packing of token sequences, independently on each worker.

A piece of L tokens belongs to class k = capacity // L, and a sequence of class k takes exactly k pieces. A piece stays whole if k of its
length fill a sequence but for `slack` tokens; else capacity // (k + 1) tokens are cut from its front, k + 1 of which fill one, and the
rest is classed anew. What is left in half-filled classes at a partition's end is laid end to end, and the very last tokens go to
sequences whose lengths are powers of two. So no worker waits for another and nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .token_counts import tokenizer

#: doc_id, start, ids of a piece, its document's tokens.
Piece = tuple[int | None, int, np.ndarray, int]


def pieces(n: int, capacity: int, slack: int) -> list[int]:
    """Lengths into which a document of n tokens is cut, in order; full sequences first."""
    out, n = [capacity] * (n // capacity), n % capacity
    while n:
        k = capacity // n
        if capacity - k * n <= slack:
            return [*out, n]
        out.append(capacity // (k + 1))
        n -= out[-1]
    return out


def pack(docs: Iterable[tuple[int | None, np.ndarray]], capacity: int = 4096, slack: int = 32) -> Iterator[list[Piece]]:
    """Sequences, as lists of pieces in order. Holds one open sequence for each class: capacity tokens each at most."""
    open_: dict[int, list[Piece]] = {}
    for doc, ids in docs:
        start = 0
        for n in pieces(len(ids), capacity, slack):
            k = capacity // n
            own = open_.setdefault(k, [])
            own.append((doc, start, ids[start : start + n], len(ids)))
            start += n
            if len(own) == k:
                yield open_.pop(k)
    rest = [p for k in sorted(open_) for p in open_[k]]
    total = sum(len(p[2]) for p in rest)
    sizes = [capacity] * (total // capacity)
    sizes += [1 << b for b in range(total.bit_length(), -1, -1) if total % capacity >> b & 1]
    sequence, room = [], sizes.pop(0) if sizes else 0
    for doc, start, ids, n in rest:
        while len(ids):
            cut = ids[:room]
            sequence.append((doc, start, cut, n))
            start, ids, room = start + len(cut), ids[len(cut) :], room - len(cut)
            if not room:
                yield sequence
                sequence, room = [], sizes.pop(0) if sizes else 0


_FIELDS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack_documents(docs: DataFrame, path: str, text: str = "text", end: int = 2, capacity: int = 4096, slack: int = 32, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset; with_ids adds the ids.

    A document's tokens are those of its whole text and then `end`; null and empty texts have that one token. Rows that repeat are packed
    as often as they stand. capacity is a power of two. sequence_id is unique: a partition's number and a count in it. Other columns are left out.
    """
    fields = _FIELDS.append(pa.field("ids", pa.list_(pa.int64()))) if with_ids else _FIELDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tokens():
            bpe, last = tokenizer(path, "ids"), np.array([end], "<u4")
            for b in batches:
                keys = b.column(0).to_pylist()
                for doc, ids in zip(keys, bpe.ids(t.as_py() for t in b.column(1))):
                    yield doc, np.concatenate([ids, last])

        rows: list[tuple] = []

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)
            rows.clear()
            return out

        base = TaskContext.get().partitionId() << 40
        for n, sequence in enumerate(pack(tokens(), capacity, slack)):
            at = 0
            for doc, start, ids, total in sequence:
                rows.append((doc, start, len(ids), zlib.crc32(ids), total, base + n, at, *([ids.tolist()] if with_ids else [])))
                at += len(ids)
            if len(rows) > 20_000:
                yield batch()
        if rows:
            yield batch()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text).mapInArrow(run, schema)


def query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
