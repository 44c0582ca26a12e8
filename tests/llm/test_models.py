import collections
import math
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from innsight.llm import packing, quality_gbt, quality_rules, token_counts, toxicity


def test_risk_gradient_is_that_of_the_risk():
    rng = np.random.default_rng(1)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    kept = turned = 0
    for _ in range(40):
        xp, xu, w = rng.integers(0, 2, (7, 4)).astype(float), rng.integers(0, 2, (9, 4)).astype(float), rng.normal(0, 2, 5)
        prior, left = 0.4, 0.35

        def parts(w):
            p, u = sigmoid(xp @ w[:-1] + w[-1]), sigmoid(xu @ w[:-1] + w[-1])
            return prior * (1 - p).mean(), (1 - prior) / (1 - left) * (u.mean() - left * p.mean())

        negative = parts(w)[1] < 0
        risk = (lambda w: -parts(w)[1]) if negative else (lambda w: sum(parts(w)))
        kept, turned = kept + (not negative), turned + negative
        numeric = [(risk(w + e) - risk(w - e)) / 2e-5 for e in np.eye(5) * 1e-5]
        assert np.allclose(toxicity.gradient(w, xp, xu, prior, left), numeric, atol=1e-6)
    assert kept and turned


def test_trees_walk_like_one_row_at_a_time_and_split_like_brute_force():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 9, (300, 3)).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 6)).astype(float)
    model = quality_gbt.fit(x, y, trees=6, depth=3)

    def walk(row):
        total = model.bias
        for feature, cut, leaf in zip(model.feature, model.cut, model.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            total += leaf[node - len(feature)]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(model.score(x), [walk(r) for r in x])
    one = quality_gbt.fit(x, y, trees=1, depth=1)
    p = 1 / (1 + math.exp(-one.bias))
    g, h, best = p - y, np.full(len(y), p * (1 - p)), (-1.0, None)
    for k in range(3):
        for c in np.unique(x[:, k])[:-1]:
            side = x[:, k] <= c
            gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (side, ~side)) - g.sum() ** 2 / (h.sum() + 1)
            best = max(best, (gain, (k, c)), key=lambda b: b[0])
    (k, c), cut = best[1], one.cut[0, 0]
    assert one.feature[0, 0] == k and ((x[:, k] <= cut) == (x[:, k] <= c)).all()


def test_rules_equal_brute_force(spark):
    rnd = random.Random(7)
    texts = [None, "", "\n\n", "a " * 30, "x#*$ " * 40, ("one two three four five six seven eight nine ten\n") * 5]
    texts += ["\n".join(" ".join(rnd.choice(["the", "of", "word", "Ab#", "a|b", "zz", "é", "and"]) for _ in range(rnd.randrange(0, 12))) for _ in range(rnd.randrange(1, 9))) for _ in range(80)]
    got = {r["doc_id"]: r for r in quality_rules.query(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        blanks = " \t\n\x0b\x0c\r"
        words = [w for w in "".join(" " if c in blanks else c for c in t).split(" ") if w]
        windows = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        repeated = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] >= 2 for j in range(8)}
        lines, seen, dup = t.split("\n"), set(), 0
        for line in lines:
            if line.strip(blanks):
                dup += line in seen
                seen.add(line)
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(repeated), len(words) < 20 or 100 * len(repeated) > 30 * len(words))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want, t
        assert not (got[i]["kept"] and want[-1])


def test_repeated_and_very_long_rows_count_and_pack(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, giant = Tokenizer.from_file(path), "".join(random.Random(1).choice(["word ", "Zürich ", "漢字", "x1 ", "\n"]) for _ in range(60_000))
    rows = [(1, giant), (1, giant), (2, "a b"), (2, "a b"), (None, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_tokens", "2 AS length").repartition(2)
    n = {t: len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows}
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in token_counts.query(docs).collect()), key=str)
    assert got == sorted(((i, n[t]) for i, t in rows), key=str)
    pieces = packing.query(docs).collect()
    total = collections.Counter()
    for r in pieces:
        total[r["doc_id"]] += r["length"]
    assert total == {1: 2 * (n[giant] + 1), 2: 2 * (n["a b"] + 1), None: 1, 3: 1}
    assert packing.query(docs.limit(0)).count() == 0 == token_counts.query(docs.limit(0)).count()
