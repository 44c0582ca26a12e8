"""What the classifier learns from: terms counted without all pairs of words, and texts taken apart once."""

import random
from collections import Counter

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from innsight.operators import classify


def _terms(texts, words):
    """The most frequent terms by brute force: all words and pairs of neighbours, those in two texts at least."""
    n, held = Counter(), Counter()
    for t in texts:
        own = [(1, w) for w in t] + [(2, f"{a} {b}") for a, b in zip(t, t[1:])]
        n.update(own)
        held.update(set(own))
    return [t for _, t in sorted((x for x in n if held[x] > 1), key=lambda x: (-n[x], *x))][:words]


@pytest.mark.parametrize("words", [1, 7, 30, 60, 5000])
def test_terms_are_those_of_all_pairs(spark, words):
    """Words of very unlike frequencies with ties at every cut, pairs more frequent than most words, repeats in one text, texts without words."""
    rnd = random.Random(words)
    known = [f"w{i}" for i in range(60)] + ["é", "غرفة", "𐐨", "ﬁ"]
    texts = [[known[min(int(rnd.expovariate(0.1)), 63)] for _ in range(rnd.randrange(25))] + ["hot", "tub"] * rnd.randrange(3) for _ in range(150)] + [[], ["once"] * 40, ["x"]]
    df = spark.createDataFrame([(t,) for t in texts], "_words array<string>")
    want = _terms(texts, words)
    for parts in (1, 7):
        assert classify.vocabulary(df.repartition(parts), words) == want
    assert words != 30 or "hot tub" in want and len(want) == 30
    assert words != 5000 or len(want) < 5000
    # what the library counts, but for terms as frequent as the last
    n = Counter(x for t in texts for x in [*t, *(f"{a} {b}" for a, b in zip(t, t[1:]))])
    terms = spark.createDataFrame([([*t, *(f"{a} {b}" for a, b in zip(t, t[1:]))],) for t in texts], "t array<string>")
    library = CountVectorizer(inputCol="t", outputCol="v", vocabSize=words, minDF=2.0).fit(terms).vocabulary
    assert [n[t] for t in library] == [n[t] for t in want]


def _samples(spark, n=300):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(["grand", "hotel", "room", "the", "bed"] if i % 2 else ["corner", "shop", "of", "milk", "room"]) for _ in range(12)), f"{i % 5}.5/5", i % 2) for i in range(n)]
    return classify.features(spark.createDataFrame(rows, "id long, name string, rating string, is_hotel int"))


def test_texts_are_taken_apart_once(spark):
    """Training reads each text once, however many steps learn from it, and keeps nothing cached."""
    read = spark.sparkContext.accumulator(0)

    def told(text):
        read.add(1)
        return text

    samples, before = _samples(spark), spark.sparkContext._jsc.getPersistentRDDs().size()
    classify.train(samples.withColumn("combined_text", F.udf(told, StringType()).asNondeterministic()("combined_text")), trees=5)
    assert read.value == 300
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_stored_words_give_the_model_of_the_plain_steps(spark):
    """The same vocabulary and rows in the same partition: equal weights and probabilities to a pipeline that runs over the texts."""
    samples = _samples(spark).coalesce(1)
    model = classify.train(samples, trees=10, words=12)
    assert len(model.stages[4].vocabulary) == 12
    weights = Pipeline(stages=classify.forest(10, 42)).fit(PipelineModel(model.stages[:5]).transform(samples))
    plain = PipelineModel([*model.stages[:5], *weights.stages])
    assert weights.stages[0].idf == model.stages[5].idf
    got, want = ([tuple(r) for r in classify.classified(m, samples).select("id", "confidence", "contributions").sort("id").collect()] for m in (model, plain))
    assert got == want and len({r[1] for r in got}) > 2
