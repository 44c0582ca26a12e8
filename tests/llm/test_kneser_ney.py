import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from innsight.llm import kneser_ney

SCHEMA = "doc_id long, text string, score string, row string"  # clashing extra columns


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


class Brute:
    """The model from dictionaries of word tuples."""

    def __init__(self, texts, order):
        self.order, self.raw = order, collections.Counter(w for t in texts for w in words(t))
        found = collections.Counter()
        for t in texts:
            seq = ["<s>", *words(t)]
            for i in range(1, len(seq)):
                for k in range(1, order + 1):
                    if i - k + 1 >= 0:
                        found[tuple(seq[i - k + 1 : i + 1])] += 1
        self.counts = {order: {g: n for g, n in found.items() if len(g) == order}}
        for k in range(order - 1, 0, -1):
            left = collections.Counter(g[1:] for g in found if len(g) == k + 1)
            self.counts[k] = {g: n if g[0] == "<s>" else left[g] for g, n in found.items() if len(g) == k}
        self.d = {k: kneser_ney._discounts(*(sum(n == j for n in c.values()) for j in (1, 2, 3, 4))) for k, c in self.counts.items()}
        self.by = {k: collections.defaultdict(list) for k in self.counts}
        for k, c in self.counts.items():
            for g, n in c.items():
                self.by[k][g[:-1]].append(n)

    def p(self, gram):
        k = len(gram)
        lower = self.p(gram[1:]) if k > 1 else 1 / (len(self.raw) + 1)
        own = self.by[k].get(gram[:-1])
        if not own:
            return lower
        d = lambda n: self.d[k][min(n, 3) - 1]
        n = self.counts[k].get(gram, 0)
        return (max(n - d(n), 0) if n else 0) / sum(own) + sum(map(d, own)) / sum(own) * lower

    def score(self, text):
        seq = ["<s>", *words(text)]
        return sum(math.log10(self.p(tuple(seq[max(0, i - self.order + 1) : i + 1]))) for i in range(1, len(seq)))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    pool = [f"w{int(rnd.paretovariate(0.8))}" for _ in range(300)] + ["THE", "the", "É", "é"]
    out = [(i, rnd.choice([" ", "\n\t", "\x0b"]).join(rnd.choices(pool, k=rnd.randint(0, 30))), "s", None) for i in range(250)]
    return out + [(300, None, None, None), (301, "", None, None), (302, " never\x1cseen unknown", None, None), (None, "no doc id", None, None), (5, "w1 w1 w1", None, None), (5, "w1 w1 w1", None, None), (400, "hot " * 3000, None, None)]


@pytest.mark.parametrize("order,shard_bytes,windows,fan", [(2, 16 << 20, 2_000_000, 512), (2, 700, 50, 3), (3, 2000, 300, 512), (1, 16 << 20, 100, 512)])
def test_equals_brute_force(spark, rows, monkeypatch, order, shard_bytes, windows, fan):
    monkeypatch.setattr(kneser_ney, "FAN", fan)  # fewer than the shards: blocks are cut in several passes
    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(kneser_ney, "WINDOWS", windows)
    held = [zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 7 == 2 for r in rows]
    train = [r[1] for r, h in zip(rows, held) if not h]
    brute = Brute(train, order)
    n, v = sum(brute.raw.values()), len(brute.raw)
    want = sorted(((r[0] is None, r[0] or 0, h, len(words(r[1])), sum(brute.raw[w] > 0 for w in words(r[1])), n, sum(math.log10((brute.raw[w] + 1) / (n + v + 1)) for w in words(r[1])), brute.score(r[1])) for r, h in zip(rows, held)))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if shard_bytes < 16 << 20:
        assert len(kneser_ney.train(df, order, sample=1.0).heavy)  # some contexts are spread over all shards
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in kneser_ney.query(df, order).collect())
    assert [g[:6] for g in got] == [w[:6] for w in want]
    assert np.allclose([g[6:] for g in got], [w[6:] for w in want], rtol=1e-9)


def test_probabilities_add_up_to_one(spark, rows):
    texts = [r[1] for r in rows]
    model = kneser_ney.train(spark.createDataFrame(rows, SCHEMA), 2)
    all_words = sorted({w for t in texts for w in words(t) if w}) + ["an unknown one"]
    hashes = np.array([kneser_ney.xxhash.xxh3_64_intdigest(w.encode()) for w in all_words] + [kneser_ney.END], np.uint64)
    for before in (hashes[0], hashes[7], np.uint64(kneser_ney.BOS)):
        p, _ = model.look_up(np.stack([np.full(len(hashes), before), hashes], axis=1))
        assert abs(p.sum() - 1) < 1e-9


def test_empty_and_untrained(spark, rows):
    none = spark.createDataFrame([], SCHEMA)
    assert kneser_ney.query(none).count() == 0
    model = kneser_ney.train(none)
    assert kneser_ney.score(spark.createDataFrame(rows[:3], SCHEMA), model).where("score = 0 and n_known = 0").count() == 3


def test_context_lowers_perplexity(spark):
    rnd = random.Random(1)
    follow = {w: rnd.sample(range(200), 3) for w in range(200)}

    def text():
        w = rnd.randrange(200)
        out = [w]
        for _ in range(60):
            w = rnd.choice(follow[w])
            out.append(w)
        return " ".join(f"w{x}" for x in out)

    df = spark.createDataFrame([(i, text()) for i in range(400)], "doc_id long, text string")
    got = kneser_ney.query(df).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert 10 ** (-got["s"] / got["n"]) < 6 < 100 < 10 ** (-got["b"] / got["n"])


def test_long_text_is_split_at_blanks(monkeypatch):
    text = "Ab  cd e " * 50
    whole = kneser_ney.tokens(text)
    monkeypatch.setattr(kneser_ney, "PIECE", 7)
    assert (kneser_ney.tokens(text) == whole).all() and len(whole) == 101
