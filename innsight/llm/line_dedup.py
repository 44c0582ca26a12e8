"""Line deduplication by range-partitioned line hashes, answered as compressed keep bitmaps per document."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, ascii_lower, written

DROP, PENDING, PART = 0, 1, 2
LINES = 4_000_000  # of a range partition
_OUT = "kind int, doc_id long, text_hash long, pos int, h1 long, h2 long, docs long"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def line_hashes(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, text_hash, pos) of each line whose key has min_chars code points at least; h1 and h2 are independent 64-bit hashes of the key."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash(text).alias("text_hash"), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    keyed = lines.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc_id", "text_hash", "pos")


def _streamed(min_docs: int, keep_first: bool):
    """A function over one range partition that is sorted by key, document and position. It holds the lines of one key only until the key is decided, so at most min_docs documents' lines.

    The partition's first and last key may go on in a neighbour; what is still open of them comes out as PENDING, with a PART row that has the key's documents and first line here.
    keep_first: the first occurrence of a key is not dropped; for keys at an edge the caller takes it out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first_key, first, doc, docs, held, out = None, None, None, None, 0, [], []

        def flush(n: int = 0):
            if len(out) <= n:
                return
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["kind", "doc_id", "text_hash", "pos", "h1", "h2", "docs"])
            out.clear()

        def close(at_edge: bool):
            if key is not None and at_edge:
                out.extend((PENDING, d, t, p, *key, None) for d, t, p in held)
                out.append((PART, *first, *key, docs))

        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(5)]
            for h1, h2, d, t, p in zip(*cols):
                if (h1, h2) != key:
                    close(key == first_key)
                    key, first, doc, docs, held = (h1, h2), (d, t, p), None, 0, []
                    if first_key is None:
                        first_key = key
                if (d, t) != doc:
                    doc, docs = (d, t), docs + 1
                if docs < min_docs:
                    held.append((d, t, p))
                else:
                    if held:
                        out.extend((DROP, *x, *key, None) for x in held[1 if keep_first and key != first_key else 0 :])
                        held = []
                    if not (keep_first and key != first_key and (d, t, p) == first):
                        out.append((DROP, d, t, p, *key, None))
            yield from flush(50_000)
        close(True)
        yield from flush()

    return run


def dropped_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(doc_id, text_hash, pos) of each line whose key stands in min_docs documents at least; with keep_first, its first line by doc_id, text_hash and pos stays.

    The range partitions are cut by key and then document, so a key with a third of all lines spreads over many tasks while all its lines in one document stay in one.
    """
    keys = ["h1", "h2", "doc_id", "text_hash"]
    spark = docs.sparkSession
    lines = written(line_hashes(docs, text, min_chars), "line-hashes")  # the range bounds need a pass of their own: over hashes, not texts
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // LINES))  # a stated number of range partitions is not adapted later
    dealt = lines.repartitionByRange(n, *keys).sortWithinPartitions(*keys, "pos")
    found = written(dealt.mapInArrow(_streamed(min_docs, keep_first), _OUT), "line-runs")
    totals = found.where(F.col("kind") == PART).groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.min(F.struct("doc_id", "text_hash", "pos")).alias("first")).where(F.col("docs") >= min_docs)
    open_ = found.where(F.col("kind") == PENDING).drop("docs").join(totals, ["h1", "h2"], "left_semi")
    columns = ["doc_id", "text_hash", "pos"]
    out = found.where(F.col("kind") == DROP).select("h1", "h2", *columns).unionByName(open_.select("h1", "h2", *columns))
    if keep_first:  # of keys at the edges of partitions, two for each at most
        firsts = totals.select("h1", "h2", F.col("first.doc_id").alias("d"), F.col("first.text_hash").alias("t"), F.col("first.pos").alias("p"))
        out = out.alias("o").join(firsts.alias("f"), F.expr("o.h1 = f.h1 AND o.h2 = f.h2 AND o.doc_id <=> f.d AND o.text_hash = f.t AND o.pos = f.p"), "left_anti")
    return out.select(columns)


@F.pandas_udf(T.BinaryType())
def _bitmap(dropped: pd.Series, n_lines: pd.Series) -> pd.Series:
    def one(at, n):
        keep = np.ones(-(-n // 8) * 8, bool)  # whole bytes: padding keeps, too
        keep[at] = False
        return zlib.compress(np.packbits(keep).tobytes())

    return pd.Series([one(a, n) for a, n in zip(dropped, n_lines)], dtype=object)


def keep_bitmaps(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(doc_id, text_hash, n_dropped, bitmap) of each document that loses a line. bitmap: zlib over numpy's packed bits, one bit a line, 1 keeps it.

    A document is a distinct pair of doc_id and text: repeated rows count once and get the same bitmap. Null and empty texts have one empty line, which is never dropped. Other columns are ignored.
    """
    dropped = dropped_lines(docs, text, min_docs, min_chars, keep_first)
    return dropped.groupBy("doc_id", "text_hash").agg(F.collect_list("pos").alias("at"), F.count("*").alias("n_dropped")).select("doc_id", "text_hash", "n_dropped", _bitmap("at", F.array_max("at") + 1).alias("bitmap"))


def bits(bitmap: bytes, n: int) -> np.ndarray:
    """The n keep bits of a bitmap; lines after its last dropped one are kept."""
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8)).astype(bool)
    return np.concatenate([keep, np.ones(max(0, n - len(keep)), bool)])[:n]


@F.pandas_udf(T.StringType())
def _kept(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    def one(t, b):
        if b is None or t is None:
            return t
        lines = t.split("\n")
        return "\n".join(x for x, k in zip(lines, bits(b, len(lines))) if k)

    return pd.Series([one(t, b) for t, b in zip(text, bitmap)], dtype=object)


def dedup(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """docs with kept_text, n_lines and n_dropped; a null text stays null in kept_text. Columns of these names are replaced; all rows stay."""
    own = ("kept_text", "n_lines", "n_dropped")
    maps = keep_bitmaps(docs, text, min_docs, min_chars, keep_first).select(F.struct("doc_id", "text_hash", "n_dropped", "bitmap").alias("m"))
    base = docs.select([c for c in docs.columns if c not in own])
    names = base.columns
    base = base.select(F.struct(*[F.col(c) for c in names if c != text]).alias("r"), F.col("doc_id").cast("long").alias("d"), F.col(text).alias("t"), _text_hash(text).alias("h"))  # what the table's columns are called doesn't matter
    j = base.join(maps, (F.col("h") == F.col("m.text_hash")) & F.col("d").eqNullSafe(F.col("m.doc_id")), "left")
    some, lost = F.coalesce("t", F.lit("")), F.col("m.bitmap").isNotNull()
    return j.select(
        *[F.col("t").alias(c) if c == text else F.col("r")[c].alias(c) for c in names],
        (F.length(some).cast("long") - F.length(F.translate(some, "\n", "")) + 1).alias("n_lines"),
        F.coalesce("m.n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(~lost, F.col("t")).otherwise(_kept(F.when(lost, F.col("t")), F.col("m.bitmap"))).alias("kept_text"),
    )


def query(docs: DataFrame) -> DataFrame:
    out = dedup(docs.select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM d),
k AS (SELECT doc_id, line, i, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT doc_id, line, i, key IN (SELECT key FROM hot) AS drop FROM k)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (drop))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT drop), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
