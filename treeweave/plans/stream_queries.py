"""The streaming jobs, run over the given tables as streams until all rows are taken."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from treeweave.plans.registry import query
from treeweave.plans.request_queries import HOURS, REPO_USAGE, TOP
from treeweave.plans.text_queries import STANDARD, kept_sql
from treeweave.plans.file_queries import with_content
from treeweave.plans.views import load, with_views
from treeweave.session import new_folder
from treeweave.sources.files import write_worktree
from treeweave.streaming import streams


def appended(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream to its end into a table of the shared folder."""
    spark = stream.sparkSession
    folder = new_folder(spark, label)
    (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def updated(stream: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Run a stream in update mode and keep the last row of each key."""
    spark = stream.sparkSession
    folder = new_folder(spark, label)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/rows/part={batch_id}")

    (
        stream.writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    rest = [c for c in stream.columns if c not in keys]
    return (
        spark.read.parquet(f"{folder}/rows")
        .groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), "_batch").alias("last"))
        .select(*keys, "last.*")
    )


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.ingest_files(with_content(load(spark, sf_dir, "sized_files", stream=True)), STANDARD)


KEPT = {k: v for k, v in kept_sql(STANDARD).items() if k in ("given", "kept", "blocks")}
BELOW = {"tracked": "SELECT * FROM sized_files WHERE git_status = 'tracked' AND starts_with(path, 'src/')", **KEPT}


@query("stream_ingest", with_views("SELECT repo_url, path, block FROM blocks", KEPT))
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return appended(_blocks(spark, sf_dir), "stream-ingest")


@query("stream_ingest_below", with_views("SELECT repo_url, path, block FROM blocks", BELOW))
def stream_ingest_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = with_content(load(spark, sf_dir, "sized_files", stream=True))
    return appended(streams.ingest_files(files, replace(STANDARD, path_prefix="src")), "stream-ingest")


@query("stream_paths", with_views("SELECT repo_url, path, block FROM blocks", KEPT))
def stream_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracked files written as a tree, and read again from a stream of their names."""
    files = with_content(load(spark, sf_dir, "tracked"))
    root = new_folder(spark, "tree")
    short = F.regexp_replace("repo_url", "^https://", "")
    write_worktree(files.withColumn("repo_url", short), root)
    names = load(spark, sf_dir, "tracked", stream=True).select(F.lit(root).alias("root"), short.alias("repo_url"), "path")
    blocks = appended(streams.stream_paths(names, STANDARD), "stream-paths")
    return blocks.withColumn("repo_url", F.concat(F.lit("https://"), "repo_url"))


@query("stream_tree", with_views("SELECT repo_url, path, block FROM blocks", KEPT))
def stream_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracked files dropped into a tree in two goes, each followed by a run of the same stream on the tree."""
    short = F.regexp_replace("repo_url", "^https://", "")
    files = with_content(load(spark, sf_dir, "tracked")).withColumn("repo_url", short)
    root, own = new_folder(spark, "tree"), new_folder(spark, "stream-tree")
    first = F.pmod(F.xxhash64("repo_url", "path"), F.lit(2)) == 0
    for part in (first, ~first):
        write_worktree(files.where(part), root)
        arrived = streams.stream_tree(spark, root, f"{own}/listings", STANDARD, repo_depth=3)
        (
            arrived.writeStream.format("parquet").option("path", f"{own}/rows").option("checkpointLocation", f"{own}/progress")
            .trigger(availableNow=True).start().awaitTermination()
        )
    blocks = spark.read.schema("repo_url string, path string, block string").parquet(f"{own}/rows")
    return blocks.withColumn("repo_url", F.concat(F.lit("https://"), "repo_url"))


@query("stream_messages", with_views("SELECT repo_url, 'File' AS type, path, block AS content FROM blocks", KEPT))
def stream_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages, read back."""
    sent = appended(streams.stream_messages(_blocks(spark, sf_dir)), "stream-messages")
    body = F.from_json("message", "type string, path string, content string").alias("m")
    return sent.select("repo_url", body).select("repo_url", "m.type", "m.path", "m.content")


@query(
    "stream_hourly",
    with_views(
        f"SELECT * FROM (SELECT {HOURS} FROM usage_log GROUP BY 1) t WHERE (hour + 1) * 3600 <= (SELECT max(ts_sec) FROM usage_log) - 86400"
    ),
)
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return appended(streams.stream_hourly(load(spark, sf_dir, "usage_log", stream=True)), "stream-hourly")


@query("stream_repo_usage", with_views(REPO_USAGE))
def stream_repo_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updated(streams.stream_repo_usage(load(spark, sf_dir, "usage_log", stream=True)), "stream-usage", ["url"])


@query("stream_top_repositories", with_views(REPO_USAGE + TOP))
def stream_top_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = streams.stream_top_repositories(load(spark, sf_dir, "usage_log", stream=True))
    folder = new_folder(spark, "stream-top")

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows")

    (
        top.writeStream.outputMode("complete")
        .foreachBatch(store)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.schema(top.schema).parquet(f"{folder}/rows")


@query(
    "stream_recent_latency",
    with_views(
        "SELECT instance, CAST(sum(response_ms) // count(*) AS BIGINT) AS average_response_time_ms, count(*) AS held FROM (SELECT *, row_number() "
        "OVER (PARTITION BY instance ORDER BY ts_sec DESC, request_id DESC) AS n FROM usage_log) t WHERE n <= 1000 GROUP BY instance"
    ),
)
def stream_recent_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = streams.latest_responses(load(spark, sf_dir, "usage_log", stream=True))
    return updated(means, "stream-latency", ["instance"])


@query(
    "stream_freshness",
    with_views(
        "SELECT cache_key, first_seen, last_validated, access_count FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY n DESC) AS back "
        "FROM walk) t WHERE back = 1",
        {
            "used": "SELECT cache_key, ts_sec, count(*) AS uses, row_number() OVER (PARTITION BY cache_key ORDER BY ts_sec) AS n FROM access_log "
            "GROUP BY cache_key, ts_sec",
            "walk": "SELECT cache_key, n, ts_sec AS first_seen, ts_sec AS last_validated, CAST(uses AS BIGINT) AS access_count FROM used WHERE n = 1 "
            "UNION ALL SELECT u.cache_key, u.n, CASE WHEN u.ts_sec - first_seen > 604800 THEN u.ts_sec ELSE first_seen END, "
            "CASE WHEN u.ts_sec - first_seen > 604800 OR u.ts_sec - last_validated >= 300 THEN u.ts_sec ELSE last_validated END, "
            "CASE WHEN u.ts_sec - first_seen > 604800 THEN 0 ELSE access_count END + u.uses "
            "FROM walk w JOIN used u ON u.cache_key = w.cache_key AND u.n = w.n + 1",
        },
        recursive=True,
    ),
)
def stream_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = streams.key_freshness(load(spark, sf_dir, "access_log", stream=True))
    return updated(states, "stream-freshness", ["cache_key"])


class Tally(streams.Hooks):
    """Totals reported at the end of each batch."""

    def __init__(self) -> None:
        self.files = self.size = 0

    def on_complete(self, files: int, size: int) -> None:
        self.files += files
        self.size += size


@query(
    "callback_sink",
    with_views("SELECT count(*) AS files, CAST(sum(strlen(block)) AS BIGINT) AS bytes FROM blocks", KEPT),
)
def callback_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    tally = Tally()
    progress = new_folder(spark, "callback-progress")
    streams.run_with_callbacks(_blocks(spark, sf_dir), tally, progress).awaitTermination()
    return spark.createDataFrame([(tally.files, tally.size)], "files bigint, bytes bigint")
