"""A corpus pipeline: toxicity, n-gram Jaccard join, substring dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs, in files of a
size that follows docs, not one for each shuffle partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.llm.decontamination import decontaminated
from loomdoc.llm.jaccard_join import one_of_each
from loomdoc.llm.packing import pack_documents
from loomdoc.llm.substring_dedup import substring_dedup
from loomdoc.llm.toxicity import may_teach, toxicity_scores
from loomdoc.session import file_count, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity_scores(docs, labels.where(may_teach(labels["doc_id"])), threshold=0.7, keep=COLUMNS[1:])
    return scored.where("predicted = 0").select(*COLUMNS).coalesce(file_count(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 5-word shingles at a Jaccard similarity of 0.8 or more join, the one with the least doc_id stays."""
    return one_of_each(docs, size=5, percent=80).select(*COLUMNS).coalesce(file_count(docs))


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 50-word windows that a document with a smaller doc_id has too go; documents that had no other words go."""
    cut = substring_dedup(docs, min_words=50, keep=("lang", "source", "n_chars"))
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.where("n_removed = 0 or n_removed < n_words").withColumn("n_chars", n_chars).select(*COLUMNS).coalesce(file_count(docs))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a benchmark item's 5-word shingles go."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=5, threshold=0.8).select(*COLUMNS).coalesce(file_count(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences of at most 1024."""
    return pack_documents(docs, "byte_bpe_50k.json", size=1024, end_id=0).coalesce(file_count(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("jaccard_join", without_near_copies),
    ("substring_dedup", without_repeated_passages),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: The first stage trains a model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
