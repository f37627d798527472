"""Queries of the operators over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densegrid.llm import (
    centroids, exact_dedup, html_main, licenses, lm, mixing, near_dedup, quality, sentencepiece_codec, suffix_dedup, topk, vector_codes, warc,
)
from densegrid.llm.text import table

#: Model file of the public tokenizer; read on the driver only.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, and whether decoding gives the text back (U+2581 reads back as a blank)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = sentencepiece_codec.encode(docs, PIECES, check="round_trip")
    return tokens.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "round_trip")


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents")).drop("node")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the calibrated scores of both views, their combination, and whether the document is kept."""
    found = quality.features(table(spark, sf_dir, "documents"))
    model = quality.fit(found, table(spark, sf_dir, "labels"))
    return quality.score(found, model).withColumn("kept", F.coalesce(F.col("quality") >= quality.LEAST, F.lit(True)))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("rarest_words")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantize(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(table(spark, sf_dir, "pages"), min_bytes=1000)
    return warc.read_records(index).drop("payload")


def op10_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_corpus(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), d=64, k=40, rounds=5)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated(table(spark, sf_dir, "documents"), length=400)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings"), d=64, parts=16, k=64, rounds=2)


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_order_minhash": op2_order_minhash,
    "op3_html_extraction": op3_html_extraction,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_quality": op5_quality,
    "op6_license_scan": op6_license_scan,
    "op7_topk_search": op7_topk_search,
    "op8_mixing": op8_mixing,
    "op9_warc": op9_warc,
    "op10_stupid_backoff": op10_stupid_backoff,
    "op11_centroids": op11_centroids,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_vector_codes": op13_vector_codes,
}
