import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from innsight.llm import ann, line_dedup

SF = "/root/testdata/sf0.001"


def test_stages_keep_extra_columns_of_any_name(spark):
    own = ("score", "predicted", "n_lines", "n_dropped", "kept_text", "_d", "_h", "_row", "row", "id", "hash", "r", "t", "d", "h", "m")
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit(42.0) for c in own})
    docs = docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string")}))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.select(*own).distinct().collect()
        assert [tuple(r) for r in rows] == [(42.0,) * len(own)], name


def test_search_over_many_blocks_with_repeats(spark, monkeypatch):
    monkeypatch.setattr(ann, "CANDIDATES", 150)
    monkeypatch.setattr(ann, "QUERIES", 12)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [rows[5], rows[40], (60, [1e3] * 24), (None, [1.0] * 24)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    hit, got = 0, {}
    for r in ann.query(vectors).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    x[60] = min(tuple(x[60]), (1e3,) * 24)
    assert set(got) == set(range(0, 900, 20))
    for q, found in got.items():
        ids = [i for i, _ in found]
        assert len(ids) == len(set(ids)) == 20
        s = np.einsum("ij,j->i", x, x[q])
        assert np.allclose([v for _, v in found], s[ids])
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20]) & set(ids))
    assert hit >= 0.9 * 20 * len(got)
    assert ann.query(vectors.limit(0)).count() == 0
    assert {r["query_id"]: 0 for r in ann.query(vectors.where("vec_id < 5")).collect()} == {0: 0}


def test_many_range_partitions_drop_the_same_lines(spark, monkeypatch):
    rows = [(i, "\n".join(["shared", f"own {i}", "twice", "twice"][: 2 + i % 3])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    one = sorted(map(tuple, line_dedup.query(docs).collect()))
    monkeypatch.setattr(line_dedup, "LINES", 7)
    assert sorted(map(tuple, line_dedup.query(docs).collect())) == one
