"""File tables: from directory trees, from stored snapshots, and their metadata index."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from operator import or_

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, LongType

from treeweave.operators.content import is_binary
from treeweave.session import pin, ship_package

# Fixed value: version tag of index rows.
INDEX_VERSION = "2.0.0"
BUCKETS = 64


@lru_cache(maxsize=64)
def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address and the path in it; addresses without a scheme are local paths."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    # A local path may hold characters that an address would have to escape.
    if uri.startswith("file://"):
        uri = uri[7:]
    return (fs.LocalFileSystem(), uri) if "://" not in uri else fs.FileSystem.from_uri(uri)


def folder_entries(root: str, folder: str) -> Iterator[tuple[str, int | None, int]]:
    """(path below `root`, size, time of change in ns) of folders and regular files in a folder; the size of a folder is null.

    Links are neither: they are left out wherever they point, so a tree has no loops and nothing outside of it is read.
    """
    system, base = file_system(root)
    top = base.rstrip("/")
    here = f"{top}/{folder}".rstrip("/") or "/"
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(here) as entries:
            for entry in entries:
                path = entry.path[len(top):].lstrip("/")
                if entry.is_dir(follow_symlinks=False):
                    yield path, None, 0
                elif entry.is_file(follow_symlinks=False):
                    about = entry.stat(follow_symlinks=False)
                    yield path, about.st_size, about.st_mtime_ns
        return
    for entry in system.get_file_info(fs.FileSelector(here)):
        path = entry.path[len(top):].lstrip("/")
        if entry.type == fs.FileType.Directory:
            yield path, None, 0
        elif entry.type == fs.FileType.File:
            yield path, entry.size, entry.mtime_ns or 0


def _listed(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries of folders (`root`, `folder`): (`root`, `folder`, `size`), the size null for a folder."""
    for page in pages:
        for root, folder in zip(page["root"], page["folder"]):
            rows = [(root, path, size) for path, size, _ in folder_entries(root, folder)]
            yield pd.DataFrame(rows, columns=["root", "folder", "size"]).astype({"size": "Int64"})


def content_of(root: str, path: str) -> bytes:
    system, top = file_system(root)
    with system.open_input_stream(f"{top.rstrip('/')}/{path}") as stream:
        return stream.read()


@F.pandas_udf(BinaryType())
def read_file(root: pd.Series, path: pd.Series) -> pd.Series:
    """Contents of files below their roots; null where the path is null."""
    return pd.Series([None if p is None else content_of(r, p) for r, p in zip(root, path)], dtype=object)


@F.pandas_udf(LongType())
def file_size(root: pd.Series, path: pd.Series) -> pd.Series:
    """Sizes of files below their roots, without opening them; null where there is no regular file."""
    sizes = []
    for base, name in zip(root, path):
        system, top = file_system(base)
        about = system.get_file_info(f"{top.rstrip('/')}/{name}")
        sizes.append(about.size if about.type == fs.FileType.File else None)
    return pd.Series(sizes, dtype="Int64")


def scan_worktree(spark: SparkSession, root: str, repo_depth: int = 1) -> DataFrame:
    """Regular files below `root` with sizes and paths relative to their repository, whatever their names begin with.

    The first `repo_depth` folders below `root` name the repository; files above that depth belong to the repository of the folders
    there are. Folders are listed by tasks, one round per level of the tree; links are not followed. `content` is read only where it
    is used, and filters on the other columns, `size` too, come before the reading.
    """
    ship_package(spark)
    listing = "root string, folder string, size long"
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders = spark.createDataFrame([(root, "")], "root string, folder string")
    found = None
    while True:
        entries = pin(folders.repartition(slices).mapInPandas(_listed, listing))
        files = entries.where("size IS NOT NULL")
        found = files if found is None else found.union(files)
        folders = entries.where("size IS NULL").select("root", "folder")
        if folders.isEmpty():
            break
    parts = F.split("folder", "/")
    depth = F.least(F.lit(repo_depth), F.size(parts) - 1)
    return found.select(
        F.array_join(F.slice(parts, F.lit(1), depth), "/").alias("repo_url"),
        F.array_join(F.slice(parts, depth + 1, F.size(parts)), "/").alias("path"),
        "size",
        F.lit("tracked").alias("git_status"),
        read_file("root", "folder").alias("content"),
    )


def write_worktree(files: DataFrame, root: str) -> int:
    """Write file rows (repo_url, path, content) as a tree below `root`, by tasks; returns how many."""

    def write(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            system, top = file_system(root)
            for repo, path, content in zip(page["repo_url"], page["path"], page["content"]):
                name = "/".join(x for x in (top.rstrip("/"), repo, path) if x)
                system.create_dir(name.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(name) as stream:
                    stream.write(content or b"")
            yield pd.DataFrame({"files": [len(page)]})

    written = files.select("repo_url", "path", "content").mapInPandas(write, "files long")
    return written.agg(F.sum("files")).first()[0] or 0


def repo_bucket(repo_url: Column, buckets: int = BUCKETS) -> Column:
    """Stable bucket of a repository, the same in every engine that has md5."""
    return F.conv(F.substring(F.md5(repo_url), 1, 6), 16, 10).cast("int") % buckets


def write_snapshot(
    files: DataFrame, path: str, buckets: int = BUCKETS, mode: str = "append", partitions: int | None = None
) -> None:
    """Store file rows by repository bucket, sorted by path so that row groups cover path ranges.

    Rows of a bucket are spread by path range as well, so one huge repository is written by many tasks.
    """
    partitions = partitions or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        files.withColumn("bucket", repo_bucket(F.col("repo_url"), buckets))
        .repartitionByRange(partitions, "bucket", "repo_url", "path")
        .sortWithinPartitions("bucket", "repo_url", "path")
        .write.mode(mode)
        .partitionBy("bucket")
        .parquet(path)
    )


def scan_snapshot(
    spark: SparkSession, path: str, repos: Iterable[str] | DataFrame | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """Stored file rows. Named repositories prune the buckets read and filter row groups.

    Repositories given as a table (`repo_url`) are joined, and prune buckets while the query runs.
    """
    files = spark.read.parquet(path)
    if isinstance(repos, DataFrame):
        wanted = repos.select("repo_url", repo_bucket(F.col("repo_url"), buckets).alias("bucket")).distinct()
        files = files.join(wanted, ["bucket", "repo_url"], "left_semi")
    elif repos is not None:
        wanted = sorted(set(repos))
        # One foldable comparison per repository: the optimizer turns each into a constant bucket.
        own_bucket = reduce(
            or_, [F.col("bucket") == repo_bucket(F.lit(repo), buckets) for repo in wanted], F.lit(False)
        )
        files = files.where(own_bucket & F.col("repo_url").isin(wanted))
    return files.drop("bucket")


def index_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metadata rows per file, and totals per repository and commit."""
    index = files.select(
        "repo_url", "commit_sha", "path", "size", is_binary(F.col("content")).alias("is_binary")
    )
    totals = files.groupBy("repo_url", "commit_sha").agg(
        F.count(F.lit(1)).alias("total_files"), F.sum("size").alias("total_size")
    )
    return index, totals.withColumn("version", F.lit(INDEX_VERSION))
