"""Text and message output."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from treeweave.functions import text as T
from treeweave.sources.files import BUCKETS, repo_bucket


def write_documents(
    document: DataFrame, path: str, buckets: int = BUCKETS, mode: str = "errorifexists", partitions: int | None = None
) -> None:
    """Write document rows (repo_url, section, seq, text) as text files by bucket, each repository in order.

    The range partitioning follows the order of the text, so a repository larger than one task continues in the
    next file of its bucket, and file names sort in reading order. `partitions` sets the number of tasks, and so the
    size of files; by default that of shuffles.
    """
    partitions = partitions or int(document.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["bucket", "repo_url", "section", "seq"]
    # The text writer ends every row with a line break; blocks bring their own.
    line = F.regexp_replace("text", r"\n\z", "")
    (
        document.withColumn("bucket", repo_bucket(F.col("repo_url"), buckets))
        .repartitionByRange(partitions, *order)
        .sortWithinPartitions(*order)
        .select("bucket", line.alias("value"))
        .write.mode(mode)
        .partitionBy("bucket")
        .text(path)
    )


def export_messages(blocks: DataFrame, stats: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Tagged JSON messages (repo_url, stage, seq, message), in this order per repository.

    Stages: 0 progress, 1 filter statistics, 2 one message per file, 3 complete, 4 error.
    """

    def message(df: DataFrame, stage: int, seq, body) -> DataFrame:
        return df.select("repo_url", F.lit(stage).alias("stage"), seq.cast("bigint").alias("seq"), F.to_json(body).alias("message"))

    def tagged(kind: str, *columns):
        return F.struct(F.lit(kind).alias("type"), *columns)

    steps = [
        ("starting", F.concat(F.lit("Processing "), F.col("repo_url"))),
        ("ingesting", F.lit("Processing files...")),
    ]
    progress = stats.select(
        "repo_url",
        F.posexplode(F.array(*[F.struct(F.lit(s).alias("stage"), m.alias("message")) for s, m in steps])).alias("at", "step"),
    )
    counted = (
        blocks.groupBy("repo_url")
        .agg(F.count(F.lit(1)).alias("files"), F.sum(T.byte_count(F.col("block"))).alias("bytes"))
    )
    complete = stats.select("repo_url").join(counted, "repo_url", "left").fillna(0, ["files", "bytes"])
    stat_columns = [
        "total_files", "included_files", "excluded_files", "total_size", "included_size", "excluded_size",
        "excluded_by_filter",
    ]
    one = F.lit(1)
    messages = (
        message(progress, 0, F.col("at") + 1, tagged("Progress", F.col("step.stage"), F.col("step.message")))
        .unionByName(message(stats, 1, one, tagged("FilterStats", F.struct(*stat_columns).alias("stats"))))
        .unionByName(message(blocks, 2, F.col("seq"), tagged("File", F.col("path"), F.col("block").alias("content"))))
        .unionByName(message(complete, 3, one, tagged("Complete", F.col("files"), F.col("bytes"))))
    )
    if errors is not None:
        messages = messages.unionByName(message(errors, 4, one, tagged("Error", F.col("message"))))
    return messages
