"""The queries of the operators in this subpackage, by name, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnline.llm import bpe, language_id, licenses, media, near_dedup, nearest, packing, substring_dedup, token_files, toxicity


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 50 words that a document of smaller id has too leave all documents."""
    return substring_dedup.dedup(_docs(spark, sf_dir), texts=False)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written in bit planes and read again."""
    return token_files.digests(token_files.read_tokens(token_files.write_tokens(_docs(spark, sf_dir))))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    return bpe.encode_decode(_docs(spark, sf_dir), keep=False)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 ids."""
    return packing.pack(_docs(spark, sf_dir), keep_ids=False)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_dedup.near_duplicates(_docs(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = _docs(spark, sf_dir)
    return language_id.identify(docs, language_id.learn(docs))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    docs = _docs(spark, sf_dir)
    return toxicity.scored(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of all documents."""
    return licenses.scan(_docs(spark, sf_dir))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every hundredth vector."""
    return nearest.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as images, stored as NPY tiles and read again."""
    return media.read_media(media.store_texts(_docs(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_files": op2_token_files,
    "op3_bpe": op3_bpe,
    "op4_packing": op4_packing,
    "op5_near_dedup": op5_near_dedup,
    "op6_language_id": op6_language_id,
    "op7_license_scan": op7_license_scan,
    "op8_nearest": op8_nearest,
    "op9_toxicity": op9_toxicity,
    "op10_media": op10_media,
}
ORACLE_SQL: dict[str, str] = {"op7_license_scan": licenses.containment_sql()}
