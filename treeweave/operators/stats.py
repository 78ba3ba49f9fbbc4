"""Per-repository statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from treeweave.functions import text as T
from treeweave.operators.filters import IngestOptions, should_include
from treeweave.operators.render import blocks, selected_files, tree_rows


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def filter_stats(files: DataFrame, options: IngestOptions) -> DataFrame:
    """Included and excluded files and bytes; prefix and size limit play no part here."""
    kept = should_include(options)
    size = F.col("size")
    counted = (
        files.where(F.col("git_status") == "tracked").groupBy("repo_url").agg(
            F.count(F.lit(1)).alias("total_files"),
            F.count_if(kept).alias("included_files"),
            F.count_if(~kept).alias("excluded_files"),
            F.sum(size).alias("total_size"),
            F.sum(F.when(kept, size).otherwise(0)).alias("included_size"),
            F.sum(F.when(kept, 0).otherwise(size)).alias("excluded_size"),
        )
    )
    return counted.select(
        "*",
        F.lit(0).cast("bigint").alias("excluded_by_filter"),
        _share(F.col("included_files"), F.col("total_files")).alias("inclusion_rate"),
        _share(F.col("excluded_size"), F.col("total_size")).alias("size_reduction"),
    )


def repo_summary(files: DataFrame, options: IngestOptions, display: bool = False) -> DataFrame:
    """Counts of the rendered document (tree and blocks). Every piece ends in a line break, so counts add up."""
    rendered, named = selected_files(files, options)
    pieces = tree_rows(named.select("repo_url", "path"), files.select("repo_url")).select(
        "repo_url", F.concat("line", F.lit("\n")).alias("piece")
    ).unionByName(blocks(rendered, options.indexed).select("repo_url", F.col("block").alias("piece")))
    piece = F.col("piece")
    counted = pieces.groupBy("repo_url").agg(
        F.sum(T.marker_count(piece)).alias("files_analyzed"),
        F.sum(T.byte_count(piece)).alias("total_size"),
        F.sum(T.word_count(piece)).alias("words"),
        F.sum(T.line_count(piece)).alias("lines"),
    )
    preset = options.preset or "standard"
    summary = counted.select(
        F.col("repo_url").alias("repository"),
        F.lit(options.branch or "main").alias("branch"),
        F.lit(options.path_prefix).cast("string").alias("subpath"),
        "files_analyzed",
        "total_size",
        T.token_estimate(F.col("total_size"), F.col("words"), F.col("lines")).alias("estimated_tokens"),
        F.lit(preset).alias("filter_preset"),
        F.lit(preset != "raw").alias("filtering_enabled"),
    )
    if display:
        summary = summary.select(
            "*",
            T.size_label(F.col("total_size")).alias("size_label"),
            T.token_label(F.col("estimated_tokens")).alias("token_label"),
        )
    return summary


LOCAL_BRANCH = "refs/heads/"


def repo_branches(refs: DataFrame) -> DataFrame:
    """Local branch names, one row each."""
    return refs.where(F.col("ref_name").startswith(LOCAL_BRANCH)).select(
        "repo_url", F.substring("ref_name", len(LOCAL_BRANCH) + 1, 1 << 30).alias("branch")
    ).distinct()


def repo_metadata(refs: DataFrame, commits: DataFrame, files: DataFrame) -> DataFrame:
    """Default branch, number of branches, bytes, last commit and address of each repository.

    The branch names themselves are rows of `repo_branches`, as a repository may have any number of them.
    """
    repos = refs.select("repo_url").unionByName(files.select("repo_url")).distinct()
    head = (
        refs.where(F.col("ref_name") == "HEAD")
        .groupBy("repo_url")
        .agg(F.max("target_sha").alias("sha"), F.max("branch").alias("head_branch"))
    )
    last = head.join(commits.select("repo_url", "sha", "summary"), ["repo_url", "sha"], "left").select(
        "repo_url", "head_branch",
        F.concat(
            F.substring("sha", 1, 8), F.lit(" - "), F.coalesce("summary", F.lit("No message"))
        ).alias("last_commit"),
    )
    branches = repo_branches(refs).groupBy("repo_url").agg(F.count(F.lit(1)).alias("branch_count"))
    sizes = files.groupBy("repo_url").agg(F.sum("size").alias("size"))
    return (
        repos.join(last, "repo_url", "left")
        .join(branches, "repo_url", "left")
        .join(sizes, "repo_url", "left")
        .select(
            F.col("repo_url").alias("url"),
            F.coalesce("head_branch", F.lit("main")).alias("default_branch"),
            F.coalesce("branch_count", F.lit(0)).alias("branch_count"),
            "size", "last_commit",
            F.col("repo_url").alias("remote_url"),
        )
    )
