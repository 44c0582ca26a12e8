"""From raw documents to packed training sequences: toxicity, quality, line dedup, near-duplicate join, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight.llm import line_dedup, ngram_join, packing, quality_gbt, toxicity
from innsight.llm.common import documents, written


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _beside(docs: DataFrame, own: tuple[str, ...], stage) -> DataFrame:
    """stage(docs) where an operator's own columns may be called like some of docs: these bear other names meanwhile. All stages take extra columns of any name and return docs' columns as they are."""
    clash = {c: f"{c} of documents" for c in docs.columns if c.lower() in own}
    return stage(docs.withColumnsRenamed(clash)).drop(*own).withColumnsRenamed({v: k for k, v in clash.items()}).select([F.col(f"`{c}`") for c in docs.columns])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects as toxic go; labels come from all folds, as they are known. Null and empty texts count as texts without words; repeated rows stay or go together."""
    return _beside(docs, ("score", "predicted"), lambda d: toxicity.score(d, _labels(spark, sf_dir)).where("predicted = 0"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects as bad go. Null and empty texts are judged by their statistics; repeated rows stay or go together."""
    return _beside(docs, ("score", "predicted"), lambda d: quality_gbt.score(d, _labels(spark, sf_dir)).where("predicted = 1"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go, wherever they stand; all documents stay, with n_chars of the new text. A null text stays null."""

    def stage(d: DataFrame) -> DataFrame:
        text = {"text": F.col("kept_text")} | ({"n_chars": F.length("kept_text").cast(d.schema["n_chars"].dataType)} if "n_chars" in d.columns else {})
        return line_dedup.dedup(d, min_docs=10).withColumns(text)

    return _beside(docs, ("kept_text", "n_lines", "n_dropped"), stage)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates one row stays, of the smallest doc_id and of its rows that of the smallest text hash; documents without words stay."""
    row = "row"
    while row in (c.lower() for c in docs.columns):
        row += "_"
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = ngram_join.Join(rows.select(F.col(row).alias("doc_id"), "text")).documents(count_links=False)
    own = rows.select(F.col(row).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    known = own.join(found.select(F.col("doc_id").alias("row"), "component_id", "n_shingles"), "row").where("n_shingles > 0")
    order = F.struct(F.col("id").isNull(), "id", "hash", "row")
    stays = known.groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.row").alias("row"))
    gone = known.select(F.col("row").alias(row)).join(stays.withColumnRenamed("row", row), row, "left_anti")
    return rows.join(gone, row, "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4,096 tokens, the columns of op8; null and empty texts are their end token alone, repeated rows are packed each."""
    return packing.query(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality_classifier", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("packing", packing_stage),
]

#: Trained classifiers can't be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
