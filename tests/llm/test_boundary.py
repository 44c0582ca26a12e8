import random

import pytest

from innsight.llm import ngram_join


def shingles(text):
    w = text.split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


@pytest.mark.parametrize("light", [6, 20, 48])
def test_light_and_heavy_sets_equal_brute_force(spark, monkeypatch, light):
    """A boundary that is forced: smaller sets go by pairs of prefix shingles, larger ones by lists of single ones, and links cross it in both ways."""
    monkeypatch.setattr(ngram_join, "boundary", lambda costs, blocks: light)
    rnd, texts = random.Random(light), [""]
    for n in [1, 4, 5, 6, *range(7, 13), *range(light - 3, light + 12, 2), 60, 90] * 2:
        base = [f"w{rnd.randrange(60)}" for _ in range(max(1, n + 4))]  # few words, so that differing texts share shingles
        for _ in range(5):
            t = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2])):
                at = rnd.choice([0, len(t) - 1, rnd.randrange(len(t))])
                t[at : at + 1] = rnd.choice([[], ["x"], [t[at], "y"]])
            texts.append(" ".join(t))
    sets = [shingles(t) for t in texts]
    like = lambda a, b: bool(a) and 100 * len(a & b) >= 75 * len(a | b)
    links = [[j for j, b in enumerate(sets) if like(a, b)] for a in sets]
    root = list(range(len(sets)))
    for _ in sets:
        root = [min([root[i], *(root[j] for j in links[i])]) for i in range(len(sets))]
    crossing = [(i, j) for i, own in enumerate(links) for j in own if len(sets[i]) <= light < len(sets[j])]
    assert len(crossing) >= 2 and sum(0 < len(s) <= light for s in sets) > 30 and sum(len(s) > light for s in sets) > 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"], r["n_links"]) for r in ngram_join.query(docs).collect()}
    assert got == {i: (root[i], len(sets[i]), len(links[i]) - (i in links[i])) for i in range(len(sets))}
