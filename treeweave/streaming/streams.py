"""Structured Streaming jobs: the batch transforms on arriving files and requests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from treeweave.functions import text as T
from treeweave.operators.catalog import EXPIRE_SECONDS, FRESH_SECONDS
from treeweave.operators.filters import IngestOptions, taken
from treeweave.operators.render import block_of, texts_of
from treeweave.operators.usage import ingested
from treeweave.sources.files import file_size, read_file
from treeweave.sources.tree import TreeSource, register_tree


def ingest_files(files: DataFrame, options: IngestOptions) -> DataFrame:
    """Arriving file rows to rendered blocks, the same as in a batch; no state, no shuffle."""
    kept = files.where(taken(options) & (F.col("size") <= options.max_file_size))
    return texts_of(kept, options.indexed).select(
        "repo_url", "path", block_of(F.col("path"), F.col("text")).alias("block")
    )


def stream_ingest(spark: SparkSession, folder: str, schema: str, options: IngestOptions) -> DataFrame:
    """Blocks of the file rows (parquet) that arrive in a folder."""
    return ingest_files(spark.readStream.schema(schema).parquet(folder), options)


def stream_paths(paths: DataFrame, options: IngestOptions) -> DataFrame:
    """Blocks of files named by arriving rows (root, repo_url, path): each is read by the task that holds its row.

    Unlike a file source on the tree itself, this takes names that begin with a dot or an underscore. Sizes are looked up first, and files
    above the limit are never opened.
    """
    name = F.concat_ws("/", F.when(F.col("repo_url") != "", F.col("repo_url")), "path")
    known = paths.withColumn("git_status", F.lit("tracked")).where(taken(options)).withColumn("size", file_size("root", name))
    small = F.when(F.col("size") <= options.max_file_size, name)
    return ingest_files(known.withColumn("content", read_file("root", small)), options)


def stream_tree(
    spark: SparkSession, root: str, listings: str, options: IngestOptions, repo_depth: int = 1
) -> DataFrame:
    """Blocks of the files that arrive in a directory tree, or change in it; see `sources.tree.TreeSource`.

    `listings` is a folder that belongs to the query, like its checkpoint. Files above the size limit are never opened.
    """
    register_tree(spark)
    arrived = (
        spark.readStream.format(TreeSource.name()).option("listings", listings).option("repoDepth", repo_depth)
        .option("maxSize", options.max_file_size).load(root)
    )
    return ingest_files(arrived.withColumn("git_status", F.lit("tracked")), options)


def stream_messages(blocks: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Tagged JSON message per block, and per error row."""
    files = blocks.select(
        "repo_url", F.to_json(F.struct(F.lit("File").alias("type"), "path", F.col("block").alias("content"))).alias("message")
    )
    if errors is None:
        return files
    return files.unionByName(
        errors.select("repo_url", F.to_json(F.struct(F.lit("Error").alias("type"), "message")).alias("message"))
    )


def complete_message(batch: DataFrame) -> DataFrame:
    """`Complete` message per repository of one batch of blocks."""
    counted = batch.groupBy("repo_url").agg(
        F.count(F.lit(1)).alias("files"), F.sum(T.byte_count(F.col("block"))).alias("bytes")
    )
    return counted.select(
        "repo_url", F.to_json(F.struct(F.lit("Complete").alias("type"), "files", "bytes")).alias("message")
    )


def event_time(ts_sec: str = "ts_sec") -> Column:
    return F.timestamp_seconds(F.col(ts_sec))


def stream_hourly(requests: DataFrame, lateness: str = "24 hours") -> DataFrame:
    """Requests, hits and bytes per hour. An hour is emitted once the watermark has passed it."""
    hours = (
        requests.withColumn("ts", event_time())
        .withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 hour").alias("w"))
        .agg(
            F.count_if(ingested()).alias("requests"),
            F.count_if("cache_hit").alias("cache_hits"),
            F.coalesce(F.sum(F.when(ingested(), F.col("bytes_out"))), F.lit(0)).alias("bytes"),
        )
    )
    return hours.select(
        F.floor(F.unix_timestamp("w.start") / 3600).alias("hour"), "requests", "cache_hits", "bytes"
    )


def stream_repo_usage(requests: DataFrame) -> DataFrame:
    """Running figures per repository, for update or complete mode."""
    latest = F.max_by(F.struct("bytes_out", "files_out"), F.struct("ts_sec", "request_id"))
    return (
        requests.where(ingested())
        .groupBy("url")
        .agg(F.count(F.lit(1)).alias("request_count"), F.max("ts_sec").alias("last_accessed"), latest.alias("l"))
        .select(
            "url", "request_count", "last_accessed",
            F.col("l.bytes_out").alias("size_bytes"), F.col("l.files_out").alias("file_count"),
        )
    )


def stream_top_repositories(requests: DataFrame, n: int = 10) -> DataFrame:
    """Running list of the most requested repositories, for complete mode."""
    return stream_repo_usage(requests).orderBy(F.desc("request_count"), "url").limit(n)


def latest_responses(requests: DataFrame, n: int = 1000) -> DataFrame:
    """Mean of the last `n` responses per instance after each trigger, for update mode.

    Before the shuffle each task keeps only rows that can still be among the last `n` of their instance, so a busy
    instance sends at most `n` rows per task; the state holds at most `n` values per instance.
    """
    columns = ["instance", "ts_sec", "request_id", "response_ms"]

    def newest(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for page in pages:
            both = page if held is None else pd.concat([held, page])
            held = both.sort_values(["ts_sec", "request_id"]).groupby("instance").tail(n)
        if held is not None:
            yield held

    def update(key: tuple, pages: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, ids, values = state.get if state.exists else ([], [], [])
        held = pd.DataFrame({"ts_sec": times, "request_id": ids, "response_ms": values}, dtype="int64")
        for page in pages:
            held = (
                pd.concat([held, page[["ts_sec", "request_id", "response_ms"]]])
                .sort_values(["ts_sec", "request_id"])
                .tail(n)
            )
        state.update(tuple(held[c].tolist() for c in ("ts_sec", "request_id", "response_ms")))
        mean = int(held["response_ms"].sum() // len(held))
        yield pd.DataFrame({"instance": [key[0]], "average_response_time_ms": [mean], "held": [len(held)]})

    return (
        requests.select(*columns)
        .mapInPandas(newest, "instance string, ts_sec bigint, request_id bigint, response_ms bigint")
        .groupBy("instance")
        .applyInPandasWithState(
            update,
            "instance string, average_response_time_ms bigint, held bigint",
            "times array<bigint>, ids array<bigint>, values array<bigint>",
            "update",
            GroupStateTimeout.NoTimeout,
        )
    )


def key_freshness(accesses: DataFrame, lateness: str = f"{EXPIRE_SECONDS} seconds") -> DataFrame:
    """First access, last validation and access count per key, for update mode.

    A validation older than the fresh period is renewed by the next access; state expires with the entry. Accesses that come
    later than `lateness`, by default the life of an entry, are dropped; `late_rows` tells how many a query has lost.
    Accesses of one key within a second are merged before the shuffle and once more page by page, so a key takes two numbers
    per second in which it is used, whatever number of accesses these hold.
    """

    def per_second(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            yield page.groupby(["cache_key", "ts_sec"], as_index=False).size().rename(columns={"size": "uses"})

    def update(key: tuple, pages: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seconds, uses = np.empty(0, np.int64), np.empty(0, np.int64)
        for page in pages:
            both = np.concatenate([seconds, page["ts_sec"].to_numpy()])
            weights = np.concatenate([uses, page["uses"].to_numpy()])
            seconds, place = np.unique(both, return_inverse=True)
            uses = np.bincount(place, weights, minlength=len(seconds)).astype(np.int64)
        first, validated, count = state.get if state.exists else (int(seconds[0]), int(seconds[0]), 0)
        at = 0
        while at < len(seconds):
            # Up to the next second that renews or restarts the entry, accesses only count.
            due = min(validated + FRESH_SECONDS, first + EXPIRE_SECONDS + 1)
            until = max(int(np.searchsorted(seconds, due)), at)
            count += int(uses[at:until].sum())
            if until == len(seconds):
                break
            now = int(seconds[until])
            if now - first > EXPIRE_SECONDS:
                first, validated, count = now, now, 0
            else:
                validated = now
            count += int(uses[until])
            at = until + 1
        state.update((first, validated, count))
        state.setTimeoutTimestamp(max((first + EXPIRE_SECONDS + 1) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(
            {"cache_key": [key[0]], "first_seen": [first], "last_validated": [validated], "access_count": [count]}
        )

    return (
        accesses.select("cache_key", "ts_sec")
        .mapInPandas(per_second, "cache_key string, ts_sec bigint, uses bigint")
        .withColumn("ts", event_time())
        .withWatermark("ts", lateness)
        .groupBy("cache_key")
        .applyInPandasWithState(
            update,
            "cache_key string, first_seen bigint, last_validated bigint, access_count bigint",
            "first_seen bigint, last_validated bigint, access_count bigint",
            "update",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


def late_rows(query: StreamingQuery) -> int:
    """Rows that the stateful steps of a query have dropped as too late, over the progress it still holds."""
    return sum(
        int(step.get("numRowsDroppedByWatermark", 0)) for progress in query.recentProgress for step in progress["stateOperators"]
    )


class Hooks:
    """User hooks of a run; override what is needed. `on_file` runs on the executors and must be picklable."""

    def on_progress(self, stage: str, message: str) -> None: ...

    def on_file(self, path: str, content: str) -> None: ...

    def on_complete(self, files: int, size: int) -> None: ...

    def on_error(self, error: str) -> None: ...


def run_with_callbacks(blocks: DataFrame, hooks: Hooks, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a stream of blocks that reports to `hooks` before, during and after each batch."""

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        on_file: Callable[[str, str], None] | None = None if getattr(hooks.on_file, "__func__", None) is Hooks.on_file else hooks.on_file

        def report(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for page in pages:
                for path, block in zip(page["path"], page["block"]):
                    on_file(path, block)
                yield pd.DataFrame({"files": [len(page)], "size": [sum(len(b.encode()) for b in page["block"])]})

        hooks.on_progress("ingesting", f"batch {batch_id}")
        try:
            # One pass: with a hook it counts as it goes, without one nothing reaches Python.
            counted = batch.select(F.lit(1).alias("files"), T.byte_count(F.col("block")).alias("size"))
            if on_file:
                counted = batch.select("path", "block").mapInPandas(report, "files long, size long")
            totals = counted.agg(F.coalesce(F.sum("files"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
        except Exception as error:
            hooks.on_error(str(error))
            raise
        hooks.on_complete(totals[0], totals[1])

    return (
        blocks.writeStream.foreachBatch(each_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
