"""Token counts of whole texts by rank-synchronous array merging."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import WordBpe

_loaded: dict[str, WordBpe] = {}


def tokenizer(path: str, use: str) -> WordBpe:
    """One tokenizer for each file and use in each worker process."""
    key = f"{use}:{path}"
    if key not in _loaded:
        _loaded[key] = WordBpe(path)
    return _loaded[key]


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit of the whole text; a null text counts as empty. Columns of these names are replaced."""

    @F.arrow_udf(T.LongType())
    def n_tokens(texts: pa.Array) -> pa.Array:
        return pa.array(tokenizer(path, "counts").counts(t.as_py() for t in texts))

    out = docs.withColumn("n_bytes", F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")).withColumn("n_tokens", n_tokens(F.col(text)))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return count_tokens(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
