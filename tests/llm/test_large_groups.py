import random

from innsight.llm import ngram_join


def sets_of(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        k = min(5, len(w))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    return out


def test_a_large_group_of_near_copies_and_mixed_lists(spark, monkeypatch):
    """700 near copies that share a passage with 300 others: lists hold many components and span tiles and parts."""
    monkeypatch.setattr(ngram_join, "TILE", 50)
    monkeypatch.setattr(ngram_join, "MOST_ENTRIES", 100)
    rnd = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(700):
        t = list(base)
        for _ in range(rnd.randint(0, 2)):
            t[rnd.randrange(60)] = f"x{rnd.randrange(9)}"
        texts.append(" ".join(t))
    for _ in range(300):
        own = [f"y{rnd.randrange(2000)}" for _ in range(rnd.randint(5, 40))]
        texts.append(" ".join(own + base[10:50]))
    sets = sets_of(texts)
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = [0] * len(texts)
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in ngram_join.query(docs).collect()}
    assert got == {i: (find(i), links[i]) for i in range(len(texts))}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_sketch_slices_keep_their_sums():
    import numpy as np

    n = ngram_join.CELLS // ngram_join.SLICES
    sparse, dense = np.zeros(n, np.uint64), np.arange(n, dtype=np.uint64) * 70000
    sparse[[1, n - 1]] = 3, 1 << 33
    for v in (sparse, dense, np.zeros(n, np.uint64)):
        assert (ngram_join.unpacked(ngram_join.packed(v)) == v).all()
