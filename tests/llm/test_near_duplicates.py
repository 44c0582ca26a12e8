import corpus_pipeline
from innsight.llm import ngram_join

WORDS = " ".join(f"w{i}" for i in range(60))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def test_one_row_of_each_component_stays(spark):
    near, other = WORDS + " more", " ".join(f"v{i}" for i in range(60))
    texts = [(5, WORDS), (5, WORDS), (5, near), (7, near), (None, WORDS), (None, WORDS), (None, other), (None, other), (8, ""), (8, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], SCHEMA).repartition(3)
    out = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len([x for x in got if x[1]]) == 2 and [i for i, t in got if t in (WORDS, near)] == [5] and (None, other) in got
    assert sorted(str(x) for x in got if not x[1]) == sorted(map(str, [(8, ""), (8, ""), (None, None)]))


def test_classes_with_null_ids_alone_link(spark):
    docs = spark.createDataFrame([(None, WORDS), (None, WORDS + " more"), (3, WORDS + " other")], "doc_id long, text string")
    got = ngram_join.query(docs).collect()
    assert {r["component_id"] for r in got} == {3} and {r["n_links"] for r in got} == {2}
