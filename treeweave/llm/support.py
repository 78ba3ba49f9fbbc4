"""Small helpers shared by the operators: column access, folds and word counts."""

from __future__ import annotations

import pathlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from treeweave.session import new_folder

# A word is a run of characters other than space and the control characters tab to carriage return.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: Iterable[str], name: str) -> str:
    """`name`, or a variant of it that no column of `taken` has in any case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def utf8(text: Column) -> Column:
    """The bytes of a text: Python gets them as they are, even where they are no valid UTF-8."""
    return text.cast("string").cast("binary")


def fold(doc_id: Column, folds: int) -> Column:
    """Stable fold of a row: checksum of its id as text; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def word_count(text: Column) -> Column:
    """Words of a text as long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written compressed to the shared folder and read again: later steps see the same rows if executors are lost."""
    folder = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def stored_by(df: DataFrame, label: str, key: str) -> DataFrame:
    """As `stored`, in as many buckets of `key` as shuffles have partitions: a join or grouping on `key` leaves these rows where they are."""
    spark = df.sparkSession
    folder = new_folder(spark, label)
    name = pathlib.PurePosixPath(folder).name.replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", folder).format("parquet").saveAsTable(name)
    rows = spark.table(name)
    # Only the name goes: the files lie in the shared folder, and `rows` knows them and their buckets.
    spark.sql(f"DROP TABLE {name}")
    return rows


def bounded_sample(rows: DataFrame, size: int, id_col: str) -> DataFrame:
    """At most `size` rows, the same in every run: those whose ids have the smallest hashes. Meant for narrow rows."""
    rank = fresh(rows.columns, "_rank")
    return rows.withColumn(rank, F.xxhash64(id_col)).orderBy(rank, id_col).limit(size).drop(rank)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, size: int, id_col: str, text_col: str
) -> DataFrame:
    """`id`, `bytes`, `label` of at most `size` labelled rows for which `learn`, a condition on the id, holds.

    Rows without id or label are no examples; an id with several labels takes the greatest, and one with several texts the
    first of these by bytes, so repeated rows count once. Only the sample, bounded by `size` narrow rows, is broadcast.
    """
    chosen = (
        labels.where(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    )
    texts = docs.select(F.col(id_col).alias("id"), utf8(F.col(text_col)).alias("bytes"))
    return one_text(texts.join(F.broadcast(bounded_sample(chosen, size, "id")), "id"), "id", "label")


def one_text(rows: DataFrame, *keys: str) -> DataFrame:
    """One row (`keys`, `bytes`) per key, however many repeat it: the first text by bytes; tasks reduce before the shuffle."""
    return rows.groupBy(*keys).agg(F.min("bytes").alias("bytes"))


def decoded(text: bytes | None) -> str:
    return text.decode("utf-8", "replace") if text else ""


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
