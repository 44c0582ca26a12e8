import random

import pytest
from pyspark.sql import functions as F

from innsight.llm import ngram_join


def sets_of(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        k = min(5, len(w))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    return out


@pytest.mark.parametrize("block", [2048, 3])
def test_all_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    rnd, texts = random.Random(8), []
    for n in (8, 40, 120):
        for _ in range(4):
            base = [f"w{rnd.randrange(400)}" for _ in range(n)]
            for _ in range(8):  # groups of more than two differing near copies
                t = list(base)
                for _ in range(rnd.randint(0, max(1, n // 25))):
                    t[rnd.randrange(n)] = rnd.choice(["zz", "yy", "xx"])
                texts.append(" ".join(t))
    texts += ["", None, texts[0], texts[0].upper()]
    sets = sets_of(texts)
    like = lambda a, b: bool(a) and 100 * len(a & b) >= 75 * len(a | b)
    want = {i: sum(like(a, b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["n_links"] for r in ngram_join.query(docs).collect()} == want
    different = {frozenset(s) for s in sets if s}
    join = ngram_join.Join(docs)
    links = join.links()
    rows = [tuple(r) for r in links.collect()]
    assert len(rows) == len(set(rows)) == sum(like(a, b) for a in different for b in different if a != b) // 2
    assert links.where(F.col("a") >= F.col("b")).isEmpty()
