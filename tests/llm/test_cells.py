import numpy as np

from innsight.llm import ann


def _recall(got, x, queries, k=20):
    hit = 0
    for q in queries:
        s = np.einsum("ij,j->i", x, x[q])
        s[q] = -np.inf
        hit += len(set(np.lexsort((np.arange(len(x)), -s))[:k]) & set(got[q]))
    return hit / (k * len(queries))


def _search(spark, x):
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in ann.query(vectors).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(got) == set(range(0, len(x), 20)) and all(len(v) == len(set(v)) == 20 for v in got.values())
    return got


def test_clustered_vectors_need_few_cells(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 60)
    probes, seen = ann._probes, []
    monkeypatch.setattr(ann, "_probes", lambda *a: seen.append((probes(*a), len(a[1]))) or seen[-1][0])
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 32))[rng.integers(0, 30, 2400)] + 0.2 * rng.normal(size=(2400, 32))
    assert _recall(_search(spark, x), x, range(0, 2400, 20)) >= 0.95
    assert seen[0][1] == 40 and seen[0][0] <= 10


def test_scattered_vectors_and_a_third_alike(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 100)
    monkeypatch.setattr(ann, "CANDIDATES", 120)
    monkeypatch.setattr(ann, "QUERIES", 15)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 24)) * rng.uniform(0.1, 4, size=(1200, 1))
    x[400:800] = 20 * x[400] / np.linalg.norm(x[400])
    got = _search(spark, x)
    assert _recall(got, x, [q for q in got if not 400 <= q < 800]) >= 0.9
    assert got[420] == [i for i in range(400, 421) if i != 420]
