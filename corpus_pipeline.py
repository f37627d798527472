"""Corpus pipeline: quality, exact copies, near copies, source mix, tokens.

Every stage takes all documents that the one before kept and returns the columns of ``documents``; the last returns
the tokens. ``run`` writes each stage as Parquet to the shared folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densegrid.llm import exact_dedup, mixing, near_dedup, quality, sentencepiece_codec
from densegrid.llm.queries import PIECES
from densegrid.llm.text import table
from densegrid.runtime import stage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    model = quality.fit(quality.features(docs), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts, that with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the smallest doc_id."""
    return near_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, one or two rows each."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, token_ids, and whether decoding gives the text back."""
    tokens = sentencepiece_codec.encode(docs.select("doc_id", "source", "text"), PIECES, check="round_trip")
    return tokens.select("doc_id", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "round_trip")


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: A learned classifier, a sampled mix and a tokenizer are not SQL; the tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.split()[0])
    return docs
