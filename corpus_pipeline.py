"""A training corpus from ``documents``: toxic documents go, copies and near copies keep one document, sources are mixed to
target weights, and what is left is encoded and decoded. Every stage is written to the shared folder and read again by the next."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesearch.llm import exact_dedup, mixing, ngram_join, sentencepiece, toxicity
from lakesearch.llm.rows import materialise

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the model is fitted on this input's labelled documents outside the held-out fold."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the smallest doc_id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 over five-word shingles the smallest doc_id."""
    return ngram_join.one_of_each(docs, n=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: weights 3, 1, 2 in turn, 150% of all words, no source above twice its size."""
    return mixing.mixed_rows(docs, weights=(3, 1, 2), share=1.5, most=2)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with begin and end ids, and what they decode to as its hash."""
    rows = docs.select("doc_id", "text", "lang", "source")
    done = sentencepiece.encode_decode(rows, PIECES, results=("token_ids", "n_tokens", "ids_sha256", "text_sha256"), with_text=False)
    return done.select("doc_id", "lang", "source", "n_tokens", "token_ids", "ids_sha256", F.col("text_sha256").alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: A trained score and a subword segmentation have no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
