"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import ann, kneser_ney, licenses, line_dedup, ngram_join, packing, piece_scan, prefix_trie, quality_gbt, quality_rules, spelling, token_counts, toxicity
from .common import documents


def _of_documents(query):
    return lambda spark, sf_dir: query(documents(spark, sf_dir))


def _with_labels(query):
    return lambda spark, sf_dir: query(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {
    "op1_toxicity": _with_labels(toxicity.query),
    "op2_one_bit_codes": lambda spark, sf_dir: ann.query(spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
    "op3_piece_scan": _of_documents(piece_scan.query),
    "op4_quality_gbt": _with_labels(quality_gbt.query),
    "op5_line_dedup": _of_documents(line_dedup.query),
    "op6_quality_rules": _of_documents(quality_rules.query),
    "op7_token_counts": _of_documents(token_counts.query),
    "op8_packing": _of_documents(packing.query),
    "op9_license_scan": _of_documents(licenses.query),
    "op10_ngram_jaccard": _of_documents(ngram_join.query),
    "op11_prefix_trie": lambda spark, sf_dir: prefix_trie.query(spark.read.parquet(f"{sf_dir}/conversations.parquet")),
    "op12_spelling_variants": _of_documents(spelling.query),
    "op13_kneser_ney": _of_documents(kneser_ney.query),
}

ORACLE_SQL = {"op5_line_dedup": line_dedup.ORACLE_SQL, "op6_quality_rules": quality_rules.ORACLE_SQL, "op9_license_scan": licenses.ORACLE_SQL}
