"""From documents to a sharded training mix: toxic documents go, near copies go, benchmark text goes, sources are mixed, rows are sharded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from treeweave.llm.contamination import without_benchmark
from treeweave.llm.mixing import mix_sources
from treeweave.llm.near_duplicates import PERCENT, without_near_duplicates
from treeweave.llm.sharding import with_shard
from treeweave.llm.support import table
from treeweave.llm.toxicity import fit_toxicity, held_out, without_toxic
from treeweave.session import new_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model does not reject; it learns from the labels of `docs`, but for the held-out fold."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return without_near_duplicates(docs, percent=PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of a benchmark item."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the target of their source asks for."""
    return mix_sources(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with their shard."""
    return with_shard(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]

# A trained model decides in the first stage, so no SQL gives these rows; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage is written to the shared folder and read again, so a lost executor costs one stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
