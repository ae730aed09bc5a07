"""The training-data pipeline over ``documents``: five stages, each by one operator of ``evidex.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents.  The caller writes each result and reads it again as the next stage's input.  Two
stages read a second table of ``sf_dir``: labels (a bounded sample) and benchmark (in blocks).

Defined results: every stage takes null columns, empty and very long texts, repeated rows, empty
tables and extra columns as its operator does; extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidex.llm import decontaminate, jaccard, mixing, quality, tokens
from evidex.llm.common import scratch_path

#: The rows follow from a fitted model, tilings and tokenizer ids, which SQL cannot express.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.filter_quality(docs, quality.train(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the least id.

    Linked are texts whose SimHash fingerprints of four-word shingles differ by 4 bits at most, found by covering
    masks as in ``op4``, and texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    return jaccard.dedup(docs, shingle=5, similarity=0.8, radius=4)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain half of a test item or more go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come near their target weights."""
    return mixing.apply_mix(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in bit-packed blocks; the result is read back from them.

    The workers still hold memory of the stages before, so each remembers a third of the pieces that the operator's own query keeps."""
    return tokens.round_trip(docs, pieces=300_000)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_benchmark),
    ("mixing", mix_sources),
    ("token_ids", write_token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
