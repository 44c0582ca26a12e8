"""Learnt operators over the registry: hotels among properties (random forest), groups of reviews (k-means), their metrics and files."""

from __future__ import annotations

import os

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, CountVectorizerModel, NGram, Normalizer, RegexTokenizer, SQLTransformer, StopWordsRemover, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.scalars import present
from .graphs import settled

# fixed values
IN_CATEGORY = r"hotel|accommodation|lodging|guest.house|motel|inn|rental|furnished"
CLUSTER_TERMS = ["hotel", "room", "bed", "stay", "reception", "check", "breakfast", "towel", "shower", "service", "clean", "accommodation", "night"]
NUMBERS = ["rating_numeric", "has_price", "hotel_in_category", "has_website", "name_length"]


def rating_number(text: Column) -> Column:
    """The first number of a rating like "4.5/5"; 0 without one."""
    return F.coalesce(F.regexp_extract(F.coalesce(text.cast("string"), F.lit("")), r"\d+\.?\d*", 0).try_cast("double"), F.lit(0.0))


def features(samples: DataFrame) -> DataFrame:
    """samples with combined_text and the numeric features; columns that samples lack count as empty."""
    col = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in samples.columns else F.lit("")
    number = lambda c: F.when(c, 1.0).otherwise(0.0)
    reviews = F.array_join("reviews", " ") if "reviews" in samples.columns else F.lit("")
    return samples.withColumns(
        {
            "combined_text": F.concat_ws(" ", col("name"), col("description"), col("address"), F.coalesce(reviews, F.lit(""))),
            "rating_numeric": rating_number(col("rating")), "has_price": number(col("price") != ""), "hotel_in_category": number(F.lower(col("category")).rlike(IN_CATEGORY)),
            "has_website": number(col("website") != ""), "name_length": F.length(col("name")).cast("double"),
        }
    )


def vocabulary(texts: DataFrame, words: int = 1000) -> list[str]:
    """The most frequent of the words and pairs of neighbours in texts (_words) that stand in two rows at least, at most `words`; of equally frequent ones single words first, then by code points.

    A pair is at most as frequent as its rarer word, so what comes before the last of `words` single words is a word or a pair of words that do. Other pairs are not counted, as none of them can be in the result.
    """
    rows = texts.select(F.monotonically_increasing_id().alias("row"), "_words")
    counts = lambda df, *term: df.groupBy(*term).agg(F.count("*").alias("n"), F.min("row").alias("low"), F.max("row").alias("high")).where("low < high")
    best = lambda df: [(-r["n"], r["term"]) for r in df.orderBy(F.desc("n"), "term").limit(words).collect()]
    single = best(counts(rows.select("row", F.explode("_words").alias("term")), "term"))
    least = -single[-1][0] if len(single) == words else 0
    often = [w for n, w in single if -n > least]
    met = rows.select("row", F.explode(F.arrays_zip(F.col("_words").alias("a"), F.slice("_words", 2, F.size("_words")).alias("b"))).alias("p")).select("row", "p.a", "p.b")
    pairs = best(counts(met.where(F.col("a").isin(often) & F.col("b").isin(often)), "a", "b").where(F.col("n") > least).select("n", F.concat_ws(" ", "a", "b").alias("term")))
    return [t for _, _, t in sorted([(n, 1, t) for n, t in single] + [(n, 2, t) for n, t in pairs])][:words]


def forest(trees: int, seed: int) -> list:
    """What learns from counts of terms (_tf) and the numeric features."""
    return [
        IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_text"), VectorAssembler(inputCols=["_text", *NUMBERS], outputCol="features"),
        RandomForestClassifier(labelCol="is_hotel", featuresCol="features", numTrees=trees, seed=seed),
    ]


def train(samples: DataFrame, trees: int = 100, words: int = 1000, seed: int = 42) -> PipelineModel:
    """A random forest on TF-IDF of words and pairs of words and the numeric features; is_hotel is the label. samples have been through features().

    Texts are taken apart once, into a table of words in the shared folder; counts of terms are kept in its partitions, and what follows reads these alone.
    """
    tokens = [RegexTokenizer(inputCol="combined_text", outputCol="_w", pattern=r"[\p{L}\p{N}_]+", gaps=False, minTokenLength=2), StopWordsRemover(inputCol="_w", outputCol="_words")]
    texts = settled(PipelineModel(tokens).transform(samples).select("_words", "is_hotel", *NUMBERS))
    terms = [
        NGram(n=2, inputCol="_words", outputCol="_pairs"), SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _terms FROM __THIS__"),
        CountVectorizerModel.from_vocabulary(vocabulary(texts, words), inputCol="_terms", outputCol="_tf"),
    ]
    counted = PipelineModel(terms).transform(texts).select("_tf", "is_hotel", *NUMBERS).persist(StorageLevel.DISK_ONLY)
    try:
        return PipelineModel([*tokens, *terms, *Pipeline(stages=forest(trees, seed)).fit(counted).stages])
    finally:
        counted.unpersist()


def split(samples: DataFrame, key: str, share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Rows to learn from and rows held out, by a hash of the key, so the same rows on any cluster."""
    held = F.pmod(F.xxhash64(F.lit("split"), key), F.lit(1000)) < int(share * 1000)
    return samples.where(~held), samples.where(held)


def classified(model: PipelineModel, samples: DataFrame, least: float = 0.5, top: int = 5) -> DataFrame:
    """samples with confidence, likely, and contributions: the `top` features of the largest value times importance."""
    names = model.stages[4].vocabulary + NUMBERS
    weights = F.array(*[F.lit(float(w)) for w in model.stages[-1].featureImportances.toArray()])
    named = F.array(*[F.lit(n) for n in names])
    x = vector_to_array("features")
    parts = F.filter(F.zip_with(F.arrays_zip(named.alias("name"), weights.alias("w")), x, lambda a, v: F.struct((a["w"] * v).alias("value"), a["name"].alias("feature"))), lambda p: p["value"] > 0)
    out = model.transform(samples).withColumn("confidence", vector_to_array("probability")[1])
    best = F.slice(F.reverse(F.array_sort(parts)), 1, top)
    return out.select(*samples.columns, "confidence", (F.col("confidence") >= least).alias("likely"), F.transform(best, lambda p: p["feature"]).alias("contributions"))


def metrics(predicted: DataFrame, label: str = "is_hotel", guess: str = "likely") -> DataFrame:
    """(label, precision, recall, f1, support, accuracy) of each class."""
    p = predicted.select(F.col(label).cast("int").alias("y"), F.col(guess).cast("int").alias("p"))
    rows = p.select("y", "p", F.explode(F.array(F.lit(0), F.lit(1))).alias("label"))
    hit, said, real = (F.col("y") == F.col("label")) & (F.col("p") == F.col("label")), F.col("p") == F.col("label"), F.col("y") == F.col("label")
    g = rows.groupBy("label").agg(F.count_if(hit).alias("tp"), F.count_if(said).alias("said"), F.count_if(real).alias("support"), F.avg((F.col("y") == F.col("p")).cast("double")).alias("accuracy"))
    g = g.withColumns({"precision": F.coalesce(F.try_divide("tp", "said"), F.lit(0.0)), "recall": F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))})
    return g.select("label", "precision", "recall", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)).alias("f1"), "support", "accuracy")


def importances(model: PipelineModel, top: int = 20) -> list[tuple[str, float]]:
    """The features that count most, at most as many as the vocabulary's bound."""
    names = model.stages[4].vocabulary + NUMBERS
    return sorted(zip(names, model.stages[-1].featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))[:top]


def save(model: PipelineModel, folder: str, name: str) -> str:
    path = os.path.join(folder, name)
    model.write().overwrite().save(path)
    return path


def load_latest(spark, folder: str) -> PipelineModel | None:
    """The saved model of the last name in the folder, read by Spark's own file system; None where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []
    return PipelineModel.load(f"{folder.rstrip('/')}/{names[-1]}") if names else None


def review_clusters(reviews: DataFrame, k: int = 5, words: int = 1000, top: int = 10, seed: int = 42) -> DataFrame:
    """(cluster, reviews, places, terms, about_hotels): k-means groups of reviews by TF-IDF, with the terms of the largest weight in their centres and whether these say lodging."""
    prepare = Pipeline(
        stages=[
            RegexTokenizer(inputCol="review", outputCol="_w", pattern=r"[\p{L}\p{N}_]+", gaps=False, minTokenLength=2), StopWordsRemover(inputCol="_w", outputCol="_words"),
            CountVectorizer(inputCol="_words", outputCol="_tf", vocabSize=words), IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="features"), KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster"),
        ]
    ).fit(reviews.where(present("review")))
    vocabulary, centres = prepare.stages[2].vocabulary, prepare.stages[-1].clusterCenters()
    best = [(i, [vocabulary[j] for j in sorted(range(len(c)), key=lambda j: (-c[j], vocabulary[j]))[:top]]) for i, c in enumerate(centres)]
    table = reviews.sparkSession.createDataFrame([(i, ",".join(ws), any(t in w for w in ws for t in CLUSTER_TERMS)) for i, ws in best], "cluster int, terms string, about_hotels boolean")  # k rows
    n = prepare.transform(reviews.where(present("review"))).groupBy("cluster").agg(F.count("*").alias("reviews"), F.countDistinct("place_id").alias("places"))
    return n.join(F.broadcast(table), "cluster")


def review_samples(clustered: DataFrame, top: int = 5) -> DataFrame:
    """The first `top` reviews of each cluster, by review_id."""
    return clustered.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy("review_id"))).where(F.col("rank") <= top)
