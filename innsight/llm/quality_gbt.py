"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays for vectorised numpy traversal."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold
from .quality_rules import STOP_WORDS, SYMBOLS

_STOP = frozenset(STOP_WORDS)
FEATURES = (
    "log_chars log_words mean_word_chars capitals digits symbols punctuation exclamations high_bytes blanks distinct_words top_word stop_words "
    "distinct_fives adjacent_repeats log_lines mean_line_words dup_lines full_stops short_words long_words entropy capital_words odd_ends"
).split()
_BYTES = {
    "capitals": range(65, 91), "digits": range(48, 58), "symbols": map(ord, SYMBOLS), "punctuation": map(ord, ".,;:?'\"()-"),
    "exclamations": b"!", "high_bytes": range(128, 256), "blanks": b" \t\n\x0b\x0c\r", "full_stops": b".",
}
_MASKS = np.stack([np.isin(np.arange(256), list(v)) for v in _BYTES.values()]).astype(np.float64)


def statistics(text: str | None) -> np.ndarray:
    """FEATURES of a whole text; shares are of bytes, words or lines. Null and empty texts give zeros."""
    out = np.zeros(len(FEATURES))
    if not text:
        return out
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    total = raw.sum()
    by_class = dict(zip(_BYTES, _MASKS @ raw / total))
    p = raw[raw > 0] / total
    w = text.split()
    n = max(len(w), 1)
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(x, len(seen)) for x in w), np.int64, len(w))
    own = np.bincount(ids, minlength=1)
    lengths = np.fromiter(map(len, seen), np.int64, len(seen))
    stop = sum(int(own[i]) for x, i in seen.items() if x in _STOP or x.lower() in _STOP) if seen else 0
    upper = sum(int(own[i]) for x, i in seen.items() if x.isupper())
    odd = sum(int(own[i]) for x, i in seen.items() if not x[-1].isalnum() and x[-1] not in ".,;:?!'\")")
    fives = len(ids) - 4
    mixed = sum((ids[k : len(ids) - 4 + k] + 1) * m for k, m in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1))) if fives > 0 else np.zeros(0)
    lines = [x for x in text.split("\n") if x.strip()]
    occurring = own[: len(seen)]
    values = {
        "log_chars": math.log1p(len(text)), "log_words": math.log1p(len(w)), "mean_word_chars": float(occurring @ lengths) / n if seen else 0, **by_class,
        "distinct_words": len(seen) / n, "top_word": own.max() / n, "stop_words": stop / n, "distinct_fives": len(np.unique(mixed)) / fives if fives > 0 else 1,
        "adjacent_repeats": float((ids[1:] == ids[:-1]).mean()) if len(ids) > 1 else 0, "log_lines": math.log1p(len(lines)), "mean_line_words": len(w) / max(len(lines), 1),
        "dup_lines": 1 - len(set(lines)) / len(lines) if lines else 0, "short_words": float(occurring @ (lengths <= 2)) / n if seen else 0,
        "long_words": float(occurring @ (lengths >= 14)) / n if seen else 0, "entropy": float(-(p * np.log2(p)).sum()), "capital_words": upper / n, "odd_ends": odd / n,
    }
    return np.array([values[f] for f in FEATURES])


@dataclass
class Trees:
    """Full binary trees of one depth: node i has children 2i + 1 and 2i + 2. feature and cut: trees x inner nodes; leaf: trees x leaves."""

    depth: int
    bias: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The sigmoid of the sum of leaves; all rows walk a tree at once."""
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.1, l2: float = 1.0, least: float = 5.0) -> Trees:
    """Newton boosting of the logistic loss; splits are sought among `bins` quantiles of each feature. least: hessian or rows that a child must have."""
    inner, leaves = 2**depth - 1, 2**depth
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = math.log(share / (1 - share))
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    if not len(y) or y.min() == y.max():
        return Trees(depth, bias, feature, cut, leaf)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)  # bin b: at most edge b
    n_f, f = x.shape[1], np.full(len(y), bias)
    flat = binned + np.arange(n_f) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            width = 2**level
            local = at - (width - 1)
            key = (flat + (local * n_f * bins)[:, None]).ravel()
            sums = [np.bincount(key, np.repeat(v, n_f), width * n_f * bins).reshape(width, n_f, bins) for v in (g, h, np.ones(len(y)))]
            (gl, hl, nl), total = (np.cumsum(s, 2) for s in sums), [s.sum(2, keepdims=True) for s in sums]
            gr, hr, nr = total[0] - gl, total[1] - hl, total[2] - nl
            gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - total[0] ** 2 / (total[1] + l2)
            gain[(nl < least) | (nr < least)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for node in range(width):
                k, b = divmod(int(best[node]), bins)
                if gain[node, k, b] > 1e-9 and b < len(edges[k]):
                    feature[t, width - 1 + node], cut[t, width - 1 + node] = k, edges[k][b]
            own = feature[t][at]
            at = 2 * at + 1 + (x[np.arange(len(y)), own] > cut[t][at])
        local = at - inner
        leaf[t] = -rate * np.bincount(local, g, leaves) / (np.bincount(local, h, leaves) + l2)
        f = f + leaf[t][local]
    return Trees(depth, bias, feature, cut, leaf)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _statistics(texts: pa.Array) -> pa.Array:
    return pa.array([statistics(t.as_py()).tolist() for t in texts], pa.list_(pa.float64()))


def training_rows(docs: DataFrame, labels: DataFrame, learn, most: int) -> pd.DataFrame:
    """Statistics and labels of `most` labelled documents at most, of those that `learn` admits, drawn by a hash of doc_id."""
    known = labels.where(learn & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    drawn = known.orderBy(F.xxhash64(F.lit("draw"), "doc_id"), "doc_id").limit(most).toPandas()
    ids = docs.sparkSession.createDataFrame(drawn, "doc_id long, quality int")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "quality", _statistics("text").alias("x")).toPandas()
    return rows.sort_values("doc_id").reset_index(drop=True)


def score(docs: DataFrame, labels: DataFrame, learn=None, most: int = 12000, threshold: float = 0.3) -> DataFrame:
    """docs with score (that a document is good) and predicted. Labels are learnt from `most` labelled rows at most, of those that `learn` admits.

    Null texts count as empty. Statistics are of whole texts, however long. Repeated rows all stay, with equal scores. Without labels, or with labels of one kind, all scores are alike. Columns named score or predicted are replaced.
    """
    rows = training_rows(docs, labels.select("doc_id", "quality"), F.lit(True) if learn is None else learn, most)
    x = np.array(rows["x"].tolist()).reshape(len(rows), len(FEATURES))
    model = fit(x, rows["quality"].to_numpy(float))

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(np.array([statistics(t.as_py()) for t in texts]).reshape(len(texts), len(FEATURES))))

    return docs.withColumn("score", scored("text")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = fold("doc_id", 5) == 0
    return score(docs, labels, ~held_out).select("doc_id", held_out.alias("held_out"), "score", "predicted")
