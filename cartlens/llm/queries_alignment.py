"""Registered query of the tokenizer alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm import alignment
from cartlens.llm.frames import documents


def vocabularies() -> tuple[str, str, str]:
    """The public files every node has with the package public_tokenizers, and the pattern of the first."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of every text, and its links' counts over the corpus."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = alignment.alignment(docs, *vocabularies(), digest=True).docs
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
