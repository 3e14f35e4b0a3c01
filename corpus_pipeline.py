"""Corpus pipeline: five stages from raw documents to tokens, each written before the next one reads it.

1. language: documents without a recognisable or a leading language go.
2. near_duplicates: of every group of documents linked by five-word shingles at similarity 0.75 the smallest id stays.
3. contamination: documents that contain a benchmark item go.
4. personal_data: plain and disguised identifiers become their kind in brackets.
5. tokens: token ids of the remaining texts, and a digest of the bytes they decode to.

Stages 1 to 4 return the columns of documents. A document without an id cannot be grouped or named, so stages 2 and 3
keep it; rows that repeat an id and a text count once from stage 2 on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm import bpe, decontaminate, jaccard, language, pii
from cartlens.llm.frames import documents, held_out, importable, set_aside, table
from cartlens.llm.queries import rank_file, split_pattern
from cartlens.session import stage

#: Share that a document's leading language must have.
MIN_SHARE = 0.4


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Languages are learnt from the rows that the language query does not hold out either."""
    importable(spark)
    model = language.train(docs.filter(~held_out(3, 1)))
    own, back = set_aside(docs, "_lang", "_share", "_mix")
    found = language.identify(own, model, lang_col="_lang", score_col="_share", mix_col="_mix")
    kept = found.filter((F.col("_lang") != language.UNKNOWN) & (F.col("_share") >= MIN_SHARE))
    return back(kept.select(*own.columns)).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    found = jaccard.groups(docs.select("doc_id", "text"))
    others = found.filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hits = decontaminate.find(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return docs.join(hits.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    texts = docs.select("doc_id", "lang", "source", "text")
    back = bpe.encode(texts, rank_file(), split_pattern(), bytes_col="decoded")
    return back.select(
        "doc_id",
        "lang",
        "source",
        F.size("token_ids").cast("long").alias("n_tokens"),
        "token_ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_languages),
    ("near_duplicates", keep_one_of_each_group),
    ("contamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("tokens", tokens),
]

#: Language inference, near duplicates and tokens cannot be told in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
