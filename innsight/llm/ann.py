"""Nearest neighbours by randomly rotated one-bit codes.

Rows are dealt to cells around centres, which are fitted on a bounded sample. Each vector, less its cell's centre, is rotated and kept as the
signs of its components in packed bits, with two scalars: its length and the inner product of its direction with its code's. From these the
inner product with a query is estimated, with a bound on the error that holds at `epsilon` standard deviations. What may be among the k nearest
by these bounds is scored anew on the vectors themselves. All rows are coded, once. A query visits as many cells as a bounded sample of queries,
compared with all rows, needs to find `PROBED` of its nearest; where vectors form no clusters these are nearly all cells.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

CANDIDATES, QUERIES = 16384, 8192  # of a block, at most as many as BLOCK_VALUES allows
BLOCK_VALUES = 1 << 22
CELL, MOST_CELLS = 4096, 4096  # rows a cell, and cells; beyond, cells have more rows, in several blocks
SAMPLE, SAMPLE_VALUES = 64, 1 << 22  # rows a cell that centres are fitted on, and components of these rows in all
PROBED, MEASURED = 0.985, 256  # share of the nearest that lie in visited cells, on so many queries
_OUT = "query_id long, vec_id long, score double"


@lru_cache(maxsize=2)
def rotation(d: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def cells_of(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of each row's nearest centre, ties to the smaller."""
    half = (centres**2).sum(1) / 2
    return np.concatenate([(x[a : a + 1024] @ centres.T - half).argmax(1) for a in range(0, len(x), 1024)] or [np.zeros(0, int)])


def fit_centres(x: np.ndarray, m: int, rounds: int = 8) -> np.ndarray:
    """m centres of the rows of x, by alternating assignment and means from m rows drawn by chance."""
    centres = x[np.random.default_rng(5).choice(len(x), min(m, len(x)), replace=False)]
    for _ in range(rounds):
        cell = cells_of(x, centres)
        n = np.bincount(cell, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, cell, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


class Codes:
    """One-bit codes of rows that share a centre."""

    def __init__(self, centre: np.ndarray, bits: np.ndarray, length: np.ndarray, share: np.ndarray):
        self.centre, self.bits, self.length, self.share, self.d = centre, bits, length, share, len(centre)
        self.signs = np.unpackbits(bits, axis=1, count=self.d).astype(np.float32)  # once a block, as products of these are faster in numpy than counted bits
        self.signs *= 2
        self.signs -= 1

    @staticmethod
    def of(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed bits, length and share of each row of x, less its row of centre (or the one row)."""
        rest = x - centre
        length = np.linalg.norm(rest, axis=1)
        turned = rest @ rotation(x.shape[1]).T
        share = np.abs(turned).sum(1) / np.sqrt(x.shape[1]) / np.where(length > 0, length, 1)
        return np.packbits(turned > 0, axis=1), length, np.where(length > 0, np.maximum(share, 1e-9), 1)

    def estimate(self, q: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of the inner products of the rows of q with all coded vectors, and their error bounds."""
        scale = self.length / self.share / np.sqrt(self.d)
        products = (q @ rotation(self.d).T).astype(np.float32) @ self.signs.T
        spread = self.length * np.sqrt(np.maximum(1 - self.share**2, 0)) / self.share / np.sqrt(max(self.d - 1, 1))
        slack = 1e-5 * (1 + self.length) * (1 + np.abs(self.centre).sum())  # single precision
        products *= scale.astype(np.float32)
        products += (q @ self.centre)[:, None].astype(np.float32)
        return products, (epsilon * np.linalg.norm(q, axis=1)).astype(np.float32)[:, None] * (spread + slack).astype(np.float32)


def nearest(codes: Codes, ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of each query's k nearest of x but itself, ties to the smaller id; scores in double precision."""
    out = ([], [], [])
    for at in range(0, len(q), 256):
        own, mine = q[at : at + 256], query_ids[at : at + 256]
        est, err = codes.estimate(own, epsilon)
        est[mine[:, None] == ids[None, :]] = -np.inf
        few = min(4 * k, len(ids))
        first = np.argpartition(est, len(ids) - few, axis=1)[:, len(ids) - few :]  # the k-th best exact score of the likeliest is what the bounds must reach
        reached = np.where(np.take_along_axis(est, first, 1) > -np.inf, np.einsum("ij,ikj->ik", own, x[first]), -np.inf)
        least = np.partition(reached, few - k, axis=1)[:, few - k] if few > k else np.full(len(own), -np.inf)
        est += err
        i, j = np.divmod(np.flatnonzero(est >= np.maximum(least - 1e-6 * (1 + np.abs(least)), -3e38).astype(np.float32)[:, None]), len(ids))
        score = np.empty(len(i))
        for a in range(0, len(i), 20_000):
            score[a : a + 20_000] = np.einsum("ij,ij->i", own[i[a : a + 20_000]], x[j[a : a + 20_000]])
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, int)
        top = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)])) < k
        for o, v in zip(out, (mine[i[top]], ids[j[top]], score[top])):
            o.append(v)
    return tuple(np.concatenate(o) if o else np.zeros(0) for o in out)


def _matrix(v) -> np.ndarray:
    """Arrow's lists of equal length as rows of doubles."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)


def _empty(schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], t) for t in schema.types], schema=schema)


def _order(q: np.ndarray, centres: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """For each row of q all cells, likeliest first: by the inner product with the centre and what a cell's rows add to it."""
    return np.argsort(-(q @ centres.T + np.linalg.norm(q, axis=1)[:, None] * reach), axis=1, kind="stable")


def _probes(coded: DataFrame, centres: np.ndarray, reach: np.ndarray, k: int) -> int:
    """How many cells a query visits: enough for PROBED of the k nearest of MEASURED queries, found by comparison with all rows."""
    some = coded.where("q").orderBy(F.xxhash64("id", F.lit(7)), "id").limit(MEASURED).select("id", "v").toArrow()
    if not some.num_rows:
        return 1
    own, q = some.column("id").to_numpy(), _matrix(some.column("v"))
    schema = pa.schema([("i", pa.int32()), ("id", pa.int64()), ("cell", pa.int32()), ("s", pa.float64())])

    def best(batches):
        kept = None  # of each query the k best of this partition
        for b in batches:
            if b.num_rows:
                ids, cell = b.column("id").to_numpy(), b.column("cell").to_numpy()
                s = q @ _matrix(b.column("v")).T
                s[own[:, None] == ids[None, :]] = -np.inf
                new = [s, np.broadcast_to(ids, s.shape), np.broadcast_to(cell, s.shape)]
                kept = new if kept is None else [np.concatenate(p, axis=1) for p in zip(kept, new)]
                if kept[0].shape[1] > k:
                    top = np.argpartition(-kept[0], k - 1, axis=1)[:, :k]
                    kept = [np.take_along_axis(c, top, 1) for c in kept]
        if kept is None:
            yield _empty(schema)
        else:
            i, j = np.nonzero(kept[0] > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((i, kept[1][i, j], kept[2][i, j], kept[0][i, j]), schema.types)], schema=schema)

    found = coded.select("id", "cell", "v").mapInArrow(best, "i int, id long, cell int, s double")
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("s"), "id"))
    near = found.withColumn("r", rank).where(F.col("r") <= k).select("i", "cell").toArrow()  # MEASURED times k rows
    place = np.argsort(_order(q, centres, reach), axis=1)[near.column("i").to_numpy(), near.column("cell").to_numpy()]
    return 1 + int(np.sort(place)[max(0, int(np.ceil(PROBED * len(place))) - 1)]) if len(place) else 1


def search(vectors: DataFrame, is_query, k: int = 20, epsilon: float = 1.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: of each row that is_query admits, the k rows of the largest inner product among all others.

    Each visited cell meets its queries in blocks of bounded size, each pair of blocks in a task of its own, so neither a large cell nor one that
    all queries visit meets in one task; only centres (MOST_CELLS at most) are broadcast. Rows with null id, null or zero vectors, null or
    non-finite components, or another length than most vectors have take no part. Of rows that repeat an id one takes part, that of the smallest
    vector, as query and as candidate. Other columns are ignored. Of an empty table there are no rows.
    """
    spark, v = vectors.sparkSession, F.col(vector_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = sizes["d"], sizes["n"]
    rows = rows.where(F.size("v") == d)
    most = lambda m: max(1, min(m, BLOCK_VALUES // d))
    m = max(1, min(MOST_CELLS, -(-n // CELL)))
    wanted = max(m, min(SAMPLE * m, SAMPLE_VALUES // d))
    drawn = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) < min(1 << 20, int((1 << 20) * 1.1 * wanted / n) + 64)
    sample = rows.where(drawn).select("id", "v").limit(2 * wanted).toArrow().sort_by("id")
    x = _matrix(sample.column("v"))
    centres = fit_centres(x, m) if len(x) else np.zeros((1, d))

    kind = rows.schema["v"].dataType.simpleString()

    def encode(batches):
        for b in batches:
            x = _matrix(b.column("v"))
            cell = cells_of(x, centres)
            bits, length, share = Codes.of(x, centres[cell])
            packed = pa.array([r.tobytes() for r in bits], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), packed, pa.array(length), pa.array(share)], names=[*b.schema.names, "cell", "bits", "length", "share"])

    one = rows.groupBy("id").agg(F.min(F.struct("v", "q")).alias("s")).select("id", "s.v", "s.q")
    coded = written(one.mapInArrow(encode, f"id long, v {kind}, q boolean, cell int, bits binary, length double, share double"), "codes")
    counted = {r["cell"]: r for r in coded.groupBy("cell").agg(F.count("*").alias("n"), F.avg(F.col("length") ** 2).alias("l")).collect()}  # MOST_CELLS rows
    reach = np.array([2 * np.sqrt(counted[c]["l"] / d) if c in counted else -np.inf for c in range(len(centres))])
    probes = min(len(counted), _probes(coded, centres, reach, k)) if len(counted) > 1 else 1

    def visits(batches):
        for b in batches:
            chosen = _order(_matrix(b.column("v")), centres, reach)[:, :probes].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.ListArray.from_arrays(pa.array(np.arange(0, chosen.size + 1, probes, dtype=np.int32)), pa.array(chosen.ravel()))], names=["id", "v", "cells"])

    queries = written(coded.where("q").select("id", "v").mapInArrow(visits, f"id long, v {kind}, cells array<int>"), "visits")
    visitors = {r["cell"]: r["n"] for r in queries.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()}
    shape = [(c, -(-r["n"] // most(CANDIDATES)), -(-visitors[c] // most(QUERIES))) for c, r in counted.items() if c in visitors]
    shape = F.broadcast(spark.createDataFrame(shape, "cell int, gs int, hs int"))  # MOST_CELLS rows
    block = lambda m: F.pmod(F.xxhash64("id"), F.col(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    left = coded.join(shape, "cell").select("cell", block("gs").alias("g"), every("hs").alias("h"), "id", "v", "bits", "length", "share")
    right = queries.select("id", "v", F.explode("cells").alias("cell")).join(shape, "cell").select("cell", every("gs").alias("g"), block("hs").alias("h"), "id", "v")

    def of_blocks(left: pa.Table, right: pa.Table) -> pa.Table:
        found = ([], [], [])
        if left.num_rows and right.num_rows:
            bits = np.frombuffer(b"".join(left.column("bits").to_pylist()), np.uint8).reshape(left.num_rows, -1)
            codes = Codes(centres[left.column("cell")[0].as_py()], bits, left.column("length").to_numpy(), left.column("share").to_numpy())
            found = nearest(codes, left.column("id").to_numpy(), _matrix(left.column("v")), right.column("id").to_numpy(), _matrix(right.column("v")), k, epsilon)
        return pa.table([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    by = ("cell", "g", "h")
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(of_blocks, _OUT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(vectors: DataFrame) -> DataFrame:
    return search(vectors, F.col("vec_id") % 20 == 0)
