"""The corpus pipeline: documents without toxic ones, without those of no known language, without near copies and long repeats, packed.

STAGES are (name, function); each function takes (spark, docs, sf_dir), works on all rows it is given and returns the columns of documents, but
the last, which returns the pieces of the packed sequences. Between stages docs is a written table.

Rows with nulls: a null text is not toxic, has no language and goes with the second stage; a null doc_id is never a copy of another. Empty
tables pass through. Texts that lose words get their words kept, joined by one space, and their n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnline.llm import language_id, near_dedup, packing, substring_dedup, toxicity
from tarnline.llm.common import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    return toxicity.clean(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned, by more than even odds."""
    return language_id.known(docs, language_id.learn(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate class."""
    return near_dedup.first_of_class(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of 50 words that a document of smaller id has too."""
    return substring_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids."""
    return packing.pack(docs, keep_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("packing", pack),
]

#: SQL can't express the classifiers and the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
