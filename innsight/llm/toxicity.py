"""Toxicity by non-negative positive-unlabelled learning: linear numpy classifiers on the presence of words and of families of words that begin alike.

Only confirmed toxic documents are taken as labelled; the unlabelled texts are drawn from the others. Of class prior p, the toxic share of
the labelled rows, the confirmed ones are thus missing among the unlabelled, where the prior is q. The risk
    p * R(positives as 1) + (1 - p) / (1 - q) * max(0, R(unlabelled as 0) - q * R(positives as 0))
is minimised; where the second term would turn negative, its gradient is reversed.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, written

_WORD = re.compile(r"[^\W\d_]+")


BEGINNINGS = (4,)  # letters that the words of a family share
SIZES = (1, 2, 3, 5)  # how many different words of a family a text has at least


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def marks(own: set[str], stems=None) -> set[str]:
    """What a text with these words is known by: the words, and "stem*n" where n or more of them begin with the stem. With stems, of these families alone."""
    found = Counter(w[:n] for w in own for n in BEGINNINGS if len(w) >= n and (stems is None or w[:n] in stems))
    return own | {f"{stem}*{n}" for stem, k in found.items() for n in SIZES if k >= n}


@dataclass
class Model:
    """weights of marks; the score is the mean of the classifiers' sigmoids."""

    vocabulary: dict[str, int]
    weights: np.ndarray  # marks x classifiers
    bias: np.ndarray

    def score(self, texts) -> np.ndarray:
        """One number from 0 to 1 for each text; null and empty texts get that of a text without any known mark."""
        out = np.tile(self.bias, (len(texts), 1))
        known = self.vocabulary.keys()
        stems = {m.partition("*")[0] for m in known if "*" in m}
        for i, t in enumerate(texts):
            own = [self.vocabulary[m] for m in marks(words(t), stems) & known]
            if own:
                out[i] += self.weights[sorted(own)].sum(0)
        return (1 / (1 + np.exp(-np.clip(out, -30, 30)))).mean(1)


def gradient(w: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float, left: float) -> np.ndarray:
    """The gradient of the risk at weights w (the bias last), of positives xp and unlabelled xu; where what the unlabelled add is negative, it is that of its opposite alone."""
    sp, su = (1 / (1 + np.exp(-np.clip(a @ w[:-1] + w[-1], -30, 30))) for a in (xp, xu))  # the loss of g as 0; as 1 it is 1 less this
    dp, du = sp * (1 - sp), su * (1 - su)
    grad_p = np.append(dp @ xp, dp.sum()) / len(xp)
    grad_u = np.append(du @ xu, du.sum()) / len(xu)
    part = (1 - prior) / (1 - left)
    if su.mean() >= left * sp.mean():
        return -prior * grad_p + part * (grad_u - left * grad_p)
    return -part * (grad_u - left * grad_p)


def train_nnpu(x: np.ndarray, positive: np.ndarray, prior: float, left: float, steps: int = 2000, rate: float = 0.1, decay: float = 0.0, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of one linear classifier, by Adam on the non-negative risk with the sigmoid loss. x: rows by features; positive: a mask, the other rows are unlabelled; left: the prior among these."""
    rng = np.random.default_rng(seed)
    w = np.concatenate([rng.normal(0, 0.01, x.shape[1]), [math.log(prior / (1 - prior))]]).astype(np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    xp, xu = x[positive], x[~positive]
    for t in range(1, steps + 1):
        g = gradient(w, xp, xu, prior, left)
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(vocabulary: list[str], x: np.ndarray, pos: np.ndarray, prior: float, left: float, classifiers: int = 3, seed: int = 7) -> Model:
    """x: presence of the marks of the vocabulary, a row for each text; pos: a mask of the positives; prior: of all texts, left: of those that are no positives. Each classifier sees its own bootstrap of the rows."""
    n_p, n_u = int(pos.sum()), int((~pos).sum())
    if not n_p or not n_u:
        share = min(max(prior, 1e-6), 1 - 1e-6)
        return Model({}, np.zeros((0, 1)), np.array([math.log(share / (1 - share))]))
    rng, weights, bias = np.random.default_rng(seed), [], []
    for k in range(classifiers):
        rows = np.concatenate([rng.choice(np.flatnonzero(mask), n) for mask, n in ((pos, n_p), (~pos, n_u))])
        w, b = train_nnpu(x[rows], pos[rows], min(max(prior, 0.001), 0.9), min(max(left, 0.0), 0.9), seed=seed + k)
        weights.append(w)
        bias.append(b)
    return Model({w: i for i, w in enumerate(vocabulary)}, np.stack(weights, 1), np.array(bias))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _marks(texts: pa.Array) -> pa.Array:
    return pa.array([sorted(marks(words(t.as_py()))) for t in texts], pa.list_(pa.string()))


def parting_marks(sample: DataFrame, n_p: int, n_u: int, n_features: int) -> list[str]:
    """The n_features marks that part positives and unlabelled most, of those in five texts at least; counted on the executors, ties by the mark."""
    share = (F.col("p") + F.col("u") + 1) / F.lit(n_p + n_u + 2)
    parts = F.abs((F.col("p") / F.lit(max(n_p, 1)) - F.col("u") / F.lit(max(n_u, 1))) / F.sqrt(share * (1 - share) * F.lit(1 / max(n_p, 1) + 1 / max(n_u, 1))))
    counts = sample.select("positive", F.explode("marks").alias("w")).groupBy("w").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u"))
    return [r["w"] for r in counts.where("p + u >= 5").orderBy(parts.desc(), "w").select("w").limit(n_features).collect()]


def training_sample(docs: DataFrame, labels: DataFrame, learn, max_positive: int, max_unlabelled: int, n_features: int = 100) -> tuple[list[str], np.ndarray, np.ndarray, float, float]:
    """Of max_positive toxic and max_unlabelled other documents at most, of those that `learn` admits, drawn by a hash of doc_id: the marks that part
    them, which marks each row has, which rows are positive; the share of toxic rows among the labelled ones, and what is left of it without the confirmed ones. Texts and their marks stay on the executors."""
    known = labels.where(learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    draw = F.xxhash64(F.lit("draw"), "doc_id")
    toxic = known.where("toxic = 1").select("doc_id").orderBy(draw, "doc_id").limit(max_positive)
    admitted = docs.where(learn & F.col("doc_id").isNotNull()).select("doc_id")
    free = admitted.join(known.where("toxic = 1"), "doc_id", "left_anti").orderBy(draw, "doc_id").limit(max_unlabelled)
    drawn = toxic.withColumn("positive", F.lit(True)).unionByName(free.withColumn("positive", F.lit(False)))
    ids = docs.sparkSession.createDataFrame(drawn.toPandas(), "doc_id long, positive boolean")  # as many rows as the two bounds
    sample = written(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "positive", _marks("text").alias("marks")), "toxicity")
    n_p, n_u = sample.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    vocabulary = parting_marks(sample, n_p, n_u, n_features) if n_p and n_u else []
    known_marks = F.array(*map(F.lit, vocabulary)).cast("array<string>")
    at = F.transform(F.array_intersect("marks", known_marks), lambda w: (F.array_position(known_marks, w) - 1).cast("int"))
    rows = sample.select("doc_id", "positive", F.array_sort(at).alias("at")).orderBy("doc_id", "positive", "at").toArrow()
    own = rows.column("at").combine_chunks()
    x = np.zeros((rows.num_rows, len(vocabulary)), np.float32)
    x[np.repeat(np.arange(rows.num_rows), own.value_lengths().to_numpy(zero_copy_only=False)), own.flatten().to_numpy(zero_copy_only=False)] = 1
    positive = rows.column("positive").to_numpy().astype(bool)
    prior, confirmed = (n["t"] or 0) / n["n"] if n["n"] else 0.0, (n["t"] or 0) / max(admitted.distinct().count(), 1)
    return vocabulary, x, positive, prior, max(prior - confirmed, 0.0) / max(1 - confirmed, 1e-9)


def score(docs: DataFrame, labels: DataFrame, learn=None, max_positive: int = 4000, max_unlabelled: int = 8000, threshold: float = 0.7, n_features: int = 100) -> DataFrame:
    """docs with score and predicted. Labels are learnt from rows that `learn` admits, max_positive confirmed toxic ones at most, beside max_unlabelled texts without regard to labels.
    The classifiers are over the n_features marks (words, and families of words) that part the two most. A text is scored by all its words, however long it is.

    Null texts count as empty. Repeated rows all stay, with equal scores; of a doc_id that repeats, each row may be in the sample. Without any toxic label every score is the share of toxic labels. Columns named score or predicted are replaced.
    """
    model = fit(*training_sample(docs, labels.select("doc_id", "toxic"), F.lit(True) if learn is None else learn, max_positive, max_unlabelled, n_features))

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([model.score([t.as_py() for t in texts[i : i + 500]]) for i in range(0, len(texts), 500)] or [np.zeros(0)]))

    return docs.withColumn("score", scored("text")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = fold("doc_id", 3) == 1
    return score(docs, labels, ~held_out).select("doc_id", held_out.alias("held_out"), "score", "predicted")
