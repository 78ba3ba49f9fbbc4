"""Usage figures of a request log.

Requests: `request_id, ts_sec, instance, url, cache_hit, is_error, response_ms, bytes_out, files_out`.
An ingestion is a request that was neither a cache hit nor an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from treeweave.operators.ordering import with_running

def ingested() -> Column:
    return ~F.col("cache_hit") & ~F.col("is_error")


def usage_totals(requests: DataFrame) -> DataFrame:
    return requests.agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(ingested()).alias("total_ingestions"),
        F.count_if("cache_hit").alias("cache_hits"),
        F.count_if(~F.col("cache_hit")).alias("cache_misses"),
        F.coalesce(F.sum(F.when(ingested(), F.col("bytes_out"))), F.lit(0)).alias("total_bytes_processed"),
        F.coalesce(F.sum(F.when(ingested(), F.col("files_out"))), F.lit(0)).alias("total_files_processed"),
        F.count_if("is_error").alias("errors"),
    )


def repo_usage(requests: DataFrame) -> DataFrame:
    """Ingestions per repository with the size and file count of the latest one."""
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


def hourly_usage(requests: DataFrame, now: int, hours: int = 24) -> DataFrame:
    """Ingestions, bytes and all cache hits per hour of the last `hours` hours."""
    hour = F.floor(F.col("ts_sec") / 3600)
    return (
        requests.where(F.col("ts_sec") >= (now // 3600 - hours + 1) * 3600)
        .groupBy(hour.alias("hour"))
        .agg(
            F.count_if(ingested()).alias("requests"),
            F.count_if("cache_hit").alias("cache_hits"),
            F.coalesce(F.sum(F.when(ingested(), F.col("bytes_out"))), F.lit(0)).alias("bytes"),
        )
    )


def top_repositories(requests: DataFrame, n: int = 10) -> DataFrame:
    return repo_usage(requests).orderBy(F.desc("request_count"), "url").limit(n)


def recent_latency(requests: DataFrame, n: int = 1000) -> DataFrame:
    """Whole-number mean of the last `n` responses."""
    last = requests.select("ts_sec", "request_id", "response_ms").orderBy(F.desc("ts_sec"), F.desc("request_id")).limit(n)
    return last.agg(F.expr("sum(response_ms) div count(*)").alias("average_response_time_ms"))


def latency_series(requests: DataFrame, n: int = 1000) -> DataFrame:
    """The same mean after each response of each instance.

    It is the running sum minus the running sum `n` responses earlier, an equi-join on the position, so that no
    task has to hold the responses of a whole instance.
    """
    running = with_running(
        requests.select("instance", "request_id", "ts_sec", "response_ms"),
        ["instance"], [F.col("ts_sec"), F.col("request_id")], number="place", sums={"total": "response_ms"},
    )
    earlier = running.select("instance", (F.col("place") + n).alias("place"), F.col("total").alias("_before"))
    mean = F.expr(f"(total - coalesce(_before, 0)) div least(place, {n})")
    return running.join(earlier, ["instance", "place"], "left").select(
        "instance", "request_id", mean.alias("average_response_time_ms")
    )


def health_snapshot(catalog: DataFrame, diff_catalog: DataFrame) -> DataFrame:
    """One status row over both catalogues."""
    none = F.lit(0).cast("bigint")
    one = F.lit(1).cast("bigint")
    rows = catalog.select(
        one.alias("repo"), F.col("size_bytes"), F.greatest(F.col("access_count") - 1, none).alias("hits"),
        "access_count", none.alias("diff"), none.alias("content_bytes"),
    ).unionByName(
        diff_catalog.select(
            none.alias("repo"), none.alias("size_bytes"), none.alias("hits"), none.alias("access_count"),
            one.alias("diff"), "content_bytes",
        )
    )
    summed = rows.agg(*[F.coalesce(F.sum(c), none).alias(c) for c in rows.columns])
    rate = F.when(F.col("access_count") > 0, F.col("hits") / F.col("access_count")).otherwise(0.0)
    return summed.select(
        F.lit("ok").alias("status"),
        F.col("repo").alias("repo_entries"),
        F.expr("size_bytes div 1048576").alias("size_mb"),
        F.concat(F.replace(F.format_number(rate * 100, 1), F.lit(","), F.lit("")), F.lit("%")).alias("hit_rate"),
        F.col("diff").alias("diff_entries"),
        F.expr("content_bytes div 1024").alias("size_kb"),
    )
