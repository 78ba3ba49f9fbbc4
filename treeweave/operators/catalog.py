"""Refresh and retention planning over a catalogue of stored snapshots. `now` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from treeweave.operators.filters import IngestOptions
from treeweave.operators.ordering import numbered, with_running
from treeweave.operators.render import repo_document
from treeweave.session import pin

# Seconds a checked entry is served unasked, and seconds until any entry expires.
FRESH_SECONDS = 300
EXPIRE_SECONDS = 604_800


def commit_status(catalog: DataFrame, heads: DataFrame) -> DataFrame:
    """Match, Outdated or NotCached for each current head."""
    stored = catalog.select("cache_key", "commit_hash")
    return heads.join(stored, "cache_key", "left").select(
        "cache_key", "head_sha",
        F.when(F.col("commit_hash").isNull(), "NotCached")
        .when(F.col("commit_hash") == F.col("head_sha"), "Match")
        .otherwise("Outdated")
        .alias("status"),
    )


def refresh_plan(catalog: DataFrame, heads: DataFrame) -> DataFrame:
    """Heads with no stored snapshot of the same commit."""
    stored = catalog.select("cache_key", F.col("commit_hash").alias("head_sha"))
    return heads.join(stored, ["cache_key", "head_sha"], "left_anti")


def refreshed_documents(
    files: DataFrame, catalog: DataFrame, heads: DataFrame, options: IngestOptions, now: int
) -> tuple[DataFrame, DataFrame]:
    """Documents of the repositories whose head has no stored snapshot, and their new catalogue entries.

    `heads` has (cache_key, head_sha, repo_url). Files of all other repositories are dropped before anything is decoded or ordered.
    """
    plan = pin(refresh_plan(catalog, heads).select("cache_key", "head_sha", "repo_url"))
    changed = files.join(plan.select("repo_url").distinct(), "repo_url", "left_semi")
    document = repo_document(changed, options)
    # Header and tree rows are lines, blocks bring their line ends.
    size = F.octet_length("text") + F.when(F.col("section") < 2, 1).otherwise(0)
    sizes = document.groupBy("repo_url").agg(F.sum(size.cast("long")).alias("size_bytes"))
    at = F.lit(now).cast("long")
    entries = plan.join(sizes, "repo_url", "left").select(
        "cache_key", F.col("repo_url").alias("url"), F.lit(options.branch).cast("string").alias("branch"),
        F.col("head_sha").alias("commit_hash"), F.coalesce("size_bytes", F.lit(0)).cast("long").alias("size_bytes"),
        at.alias("created_at"), at.alias("last_accessed"), at.alias("last_validated"), F.lit(1).cast("long").alias("access_count"),
    )
    return document, entries


def _state(created: Column, validated: Column, now: Column) -> Column:
    return (
        F.when(created.isNull(), "Miss")
        .when(now - created > EXPIRE_SECONDS, "Expired")
        .when(now - validated < FRESH_SECONDS, "Fresh")
        .otherwise("Valid")
    )


def freshness(catalog: DataFrame, requests: DataFrame, now: int) -> DataFrame:
    stored = catalog.select("cache_key", "created_at", "last_validated")
    return requests.join(stored, "cache_key", "left").select(
        *requests.columns,
        _state(F.col("created_at"), F.col("last_validated"), F.lit(now)).alias("freshness"),
    )


def serve_decision(requests: DataFrame, catalog: DataFrame, heads: DataFrame, now: int) -> DataFrame:
    """serve, revalidate, invalidate or refetch per request; decided once per key, then joined to the requests."""
    state = _state(F.col("created_at"), F.col("last_validated"), F.lit(now))
    decided = catalog.join(heads, "cache_key", "left").select(
        "cache_key",
        F.when(state == "Fresh", "serve")
        .when((state == "Valid") & (F.col("head_sha") == F.col("commit_hash")), "revalidate")
        .when((state == "Valid") & F.col("head_sha").isNotNull(), "invalidate")
        .otherwise("refetch")
        .alias("decision"),
    )
    joined = requests.join(decided, "cache_key", "left")
    return joined.select(
        *requests.columns, F.coalesce("decision", F.lit("refetch")).alias("decision")
    ).withColumn("last_validated", F.when(F.col("decision") == "revalidate", F.lit(now).cast("bigint")))


def expired_entries(catalog: DataFrame, now: int, max_age: int = EXPIRE_SECONDS) -> DataFrame:
    return catalog.where(F.lit(now) - F.col("created_at") > max_age)


def lru_eviction_plan(
    catalog: DataFrame, capacity: int, incoming: int, scope: list[str] | None = None
) -> DataFrame:
    """Entries to evict, least recently used first, until `incoming` bytes fit; per scope if one is named."""
    scope = scope or []
    entries = catalog.select(*scope, "cache_key", "size_bytes", "last_accessed")
    freed = with_running(
        entries, scope, [F.col("last_accessed"), F.col("cache_key")], sums={"freed": "size_bytes"}
    )
    left = F.col("_total") - (F.col("freed") - F.col("size_bytes"))
    if scope:
        totals = entries.groupBy(*scope).agg(F.sum("size_bytes").alias("_total"))
        freed = freed.join(totals, scope)
    else:
        freed = freed.withColumn("_total", entries.agg(F.sum("size_bytes")).scalar())
    return freed.where(left + incoming > capacity).drop("_total")


def lfu_eviction_plan(diff_catalog: DataFrame, max_entries: int) -> DataFrame:
    """Least accessed entries to evict so that one more fits; ties go by key."""
    entries = diff_catalog.select("cache_key", "access_count")
    placed = numbered(entries, [], [F.col("access_count"), F.col("cache_key")], "place")
    total = entries.agg(F.count(F.lit(1))).scalar()
    return placed.where(F.col("place") <= total - max_entries + 1)


def catalog_stats(catalog: DataFrame, now: int, capacity: int) -> DataFrame:
    return catalog.agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size"),
        F.lit(capacity).cast("bigint").alias("max_size"),
        F.count_if(F.lit(now) - F.col("created_at") > EXPIRE_SECONDS).alias("expired_entries"),
    )


def hit_rate(catalog: DataFrame) -> DataFrame:
    hits, accesses = F.sum(F.greatest(F.col("access_count") - 1, F.lit(0))), F.sum("access_count")
    return catalog.agg(F.when(accesses > 0, hits / accesses).otherwise(0.0).alias("hit_rate"))


def top_accessed(catalog: DataFrame, n: int = 10) -> DataFrame:
    return catalog.select("url", "access_count").orderBy(F.desc("access_count"), "url").limit(n)


def diff_catalog_stats(diff_catalog: DataFrame, max_entries: int) -> DataFrame:
    return diff_catalog.agg(
        F.count(F.lit(1)).alias("entries"),
        F.lit(max_entries).cast("bigint").alias("max_entries"),
        F.coalesce(F.sum("content_bytes"), F.lit(0)).alias("total_size"),
    )


def upsert_entries(catalog: DataFrame, new: DataFrame, accesses: DataFrame) -> DataFrame:
    """Next version of the catalogue: newest entry per key, with accesses (cache_key, ts_sec) folded in."""
    rest = [c for c in catalog.columns if c != "cache_key"]
    newest = (
        catalog.unionByName(new)
        .groupBy("cache_key")
        .agg(F.max_by(F.struct(*rest), F.struct("created_at", "last_accessed")).alias("e"))
        .select("cache_key", "e.*")
    )
    used = accesses.groupBy("cache_key").agg(
        F.count(F.lit(1)).alias("_uses"), F.max("ts_sec").alias("_last")
    )
    return newest.join(used, "cache_key", "left").select(
        "cache_key",
        *[
            F.greatest("last_accessed", F.coalesce("_last", "last_accessed")).alias(c) if c == "last_accessed"
            else (F.col(c) + F.coalesce("_uses", F.lit(0))).alias(c) if c == "access_count"
            else F.col(c)
            for c in rest
        ],
    )


def purge_entries(catalog: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """The catalogue without the named keys; without any entry if no keys are given."""
    return catalog.limit(0) if keys is None else catalog.join(keys.select("cache_key"), "cache_key", "left_anti")
