"""Differences between two file trees."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from treeweave.functions import text as T
from treeweave.functions.keys import blob_id
from treeweave.functions.linediff import common_count, hunks, split_lines
from treeweave.session import kept

# Fixed value: the id that stands for "no blob" in patch headers.
NO_BLOB = "0000000"


def with_blob_id(files: DataFrame) -> DataFrame:
    return files if "blob_id" in files.columns else files.withColumn("blob_id", blob_id(F.col("content")))


def changed_paths(base: DataFrame, head: DataFrame, by: list[str]) -> DataFrame:
    """Status of each path whose blob ids differ, from trees (by, path, blob_id)."""
    old = base.select(*by, "path", F.col("blob_id").alias("old_blob"))
    new = head.select(*by, "path", F.col("blob_id").alias("new_blob"))
    return (
        old.join(new, [*by, "path"], "full_outer")
        .where(~F.col("old_blob").eqNullSafe(F.col("new_blob")))
        .withColumn(
            "status",
            F.when(F.col("old_blob").isNull(), "added").when(F.col("new_blob").isNull(), "deleted").otherwise("modified"),
        )
    )


def snapshot_diff(base: DataFrame, head: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Status of each path that differs. Only keys and blob ids are shuffled; renames are not followed."""
    return changed_paths(with_blob_id(base), with_blob_id(head), by or ["repo_url"])


def folder_digests(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Digest of every folder of every tree: (by, folder, parent, level, files, d0..d3); the root is folder "" of level 0, its parent is null.

    A folder's digest sums, in four lanes of 60 bits each, the SHA-256 sums of the paths and blob ids of all files below it, so folders are equal
    where their files are, and partial sums are taken before the shuffle: a folder of any size is a few rows per task. Digests are
    made once per snapshot and stored (`kept`, or a table partitioned by level); where files carry stored blob ids, no content is read.
    """
    by = by or ["repo_url"]
    parts = F.split("path", "/")
    # Folders above a file, the root included.
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(n.alias("level"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("folder")))
    digest = F.sha2(F.to_json(F.struct("path", "blob_id")), 256)
    lanes = [F.conv(F.substring(digest, 1 + 15 * n, 15), 16, 10).cast("decimal(38, 0)").alias(f"d{n}") for n in range(4)]
    placed = with_blob_id(files).where(F.col("path").isNotNull()).select(*by, F.inline(above), *lanes)
    parent = F.when(F.col("folder").contains("/"), F.regexp_replace("folder", r"/[^/]*\z", "")).when(F.col("level") > 0, "")
    return placed.groupBy(*by, "level", "folder").agg(
        F.count(F.lit(1)).alias("files"), *[F.sum(f"d{n}").cast("decimal(38, 0)").alias(f"d{n}") for n in range(4)]
    ).select(*by, "folder", parent.alias("parent"), "level", "files", *[f"d{n}" for n in range(4)])


def changed_folders(base: DataFrame, head: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Folders (by, folder) that differ between two trees, from their digests, compared level by level.

    Only folders whose parent differs are compared, so what is below two equal folders is never read. A round per level of the
    deepest difference; the driver sees whether a level has any.
    """
    by = by or ["repo_url"]
    key, sums = [*by, "folder"], ["files", "d0", "d1", "d2", "d3"]
    found, level = None, 0
    while True:
        sides = []
        for tree, side in ((base, "old"), (head, "new")):
            rows = tree.where(F.col("level") == level)
            if found is not None:
                rows = rows.join(last.select(*by, F.col("folder").alias("parent")), [*by, "parent"], "left_semi")
            sides.append(rows.select(*key, F.struct(*sums).alias(side)))
        last = kept(sides[0].join(sides[1], key, "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select(*key), f"level{level}")
        if last.isEmpty():
            return last if found is None else found
        found, level = last if found is None else found.union(last), level + 1


def snapshot_diff_by_folders(
    base: DataFrame, head: DataFrame, base_folders: DataFrame, head_folders: DataFrame, by: list[str] | None = None
) -> DataFrame:
    """As `snapshot_diff`, from trees and their stored `folder_digests`: only files that lie directly in folders that differ are compared."""
    by = by or ["repo_url"]
    folders = changed_folders(base_folders, head_folders, by)
    name_size = F.length(F.substring_index("path", "/", -1))
    folder = F.when(F.col("path").contains("/"), F.substring("path", F.lit(1), F.length("path") - name_size - 1)).otherwise("")
    near = [tree.withColumn("folder", folder).join(folders, [*by, "folder"], "left_semi").drop("folder") for tree in (base, head)]
    return snapshot_diff(*near, by)


def changed_files(base: DataFrame, head: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Differing paths with both contents, which join in by key.

    Paths that differ are found first, on keys and blob ids alone, and only their contents go on to a join. Where trees come with stored
    blob ids (see `write_snapshot`), finding them reads no content.
    """
    by = by or ["repo_url"]
    changed = kept(snapshot_diff(base, head, by), "changed")
    paths = changed.select(*by, "path")
    old, new = (
        tree.join(paths, [*by, "path"], "left_semi").select(*by, "path", F.col("content").alias(name))
        for tree, name in ((base, "old_content"), (head, "new_content"))
    )
    return changed.join(old, [*by, "path"], "left").join(new, [*by, "path"], "left")


def write_contents(files: DataFrame, table: str, path: str | None = None, mode: str = "errorifexists") -> DataFrame:
    """Store each distinct content once, as a table (blob_id, content) bucketed by blob id, and return it.

    Copies go before the shuffle, task by task, so a file that a third of all trees hold is a row per task. There are as many buckets as
    shuffles have partitions: what is grouped by blob id is written where it is. A null content has no blob. The table lies
    at `path`, or in the warehouse.
    """
    spark = files.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blobs = with_blob_id(files).where(F.col("content").isNotNull()).select("blob_id", "content").dropDuplicates(["blob_id"])
    writer = blobs.write.bucketBy(buckets, "blob_id").mode(mode).format("parquet").option("compression", "zstd")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return spark.table(table)


def fetched(contents: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of `contents` (blob_id, content) whose blob is `wanted`. Where contents are bucketed by blob id only `wanted` is shuffled."""
    return contents.select("blob_id", "content").join(wanted.select("blob_id").distinct().hint("shuffle_hash"), "blob_id", "left_semi")


def with_stored_contents(changes: DataFrame, contents: DataFrame) -> DataFrame:
    """Changes (status, old_blob, new_blob, ...) with `old_content` and `new_content` from contents by blob id.

    Where contents are bucketed by blob id they stay in place; only the old contents of modified files are shuffled, to the new ones.
    """

    def side(changes: DataFrame, blob: str, name: str) -> DataFrame:
        found = fetched(contents, changes.select(F.col(blob).alias("blob_id")).where("blob_id IS NOT NULL"))
        return changes.join(found.select(F.col("blob_id").alias(blob), F.col("content").alias(name)), blob, "left")

    none = F.lit(None).cast("binary")
    modified = side(side(changes.where("status = 'modified'"), "old_blob", "old_content"), "new_blob", "new_content")
    added = side(changes.where("status = 'added'").withColumn("old_content", none), "new_blob", "new_content")
    deleted = side(changes.where("status = 'deleted'"), "old_blob", "old_content").withColumn("new_content", none)
    return modified.unionByName(added).unionByName(deleted)


def _nul_inside(content: Column) -> Column:
    return F.coalesce(F.contains(F.substring(content, 1, 8000), F.lit(bytearray(b"\0"))), F.lit(False))


def _is_binary_change() -> Column:
    return _nul_inside(F.col("old_content")) | _nul_inside(F.col("new_content"))


@F.pandas_udf(LongType())
def _shared_lines(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series(
        [None if a is None or b is None else common_count(split_lines(a), split_lines(b)) for a, b in zip(old, new)],
        dtype="Int64",
    )


def _lines(content: Column) -> Column:
    """Number of lines of bytes, whatever their encoding."""
    return F.coalesce(T.line_count(F.decode(content, "ISO-8859-1")), F.lit(0))


def file_diff_stats(changes: DataFrame) -> DataFrame:
    """Inserted and deleted lines per changed file. Only modified text files reach Python."""
    binary = _is_binary_change()
    both = (F.col("status") == "modified") & ~binary
    shared = F.coalesce(
        _shared_lines(F.when(both, F.col("old_content")), F.when(both, F.col("new_content"))), F.lit(0)
    )
    return changes.withColumn("_shared", shared).select(
        *[c for c in changes.columns if c not in ("old_content", "new_content")],
        F.when(binary, 0).otherwise(_lines(F.col("new_content")) - F.col("_shared")).alias("insertions"),
        F.when(binary, 0).otherwise(_lines(F.col("old_content")) - F.col("_shared")).alias("deletions"),
    )


def diff_stats(base: DataFrame, head: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Changed files, insertions and deletions per pair of trees."""
    by = by or ["repo_url"]
    return file_diff_stats(changed_files(base, head, by)).groupBy(*by).agg(
        F.count(F.lit(1)).alias("files_changed"),
        F.sum("insertions").alias("insertions"),
        F.sum("deletions").alias("deletions"),
    )


def _whole_file(text: Column, mark: str) -> Column:
    """Hunk of a file that is all new (`+`) or all gone (`-`)."""
    closed = text.endswith("\n")
    stem = F.when(closed, F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    body = F.concat(
        F.lit(mark), F.replace(stem, F.lit("\n"), F.lit("\n" + mark)),
        F.when(closed, F.lit("\n")).otherwise("\n\\ No newline at end of file\n"),
    )
    count = T.line_count(text)
    span = F.when(count == 1, F.lit("1")).otherwise(F.concat(F.lit("1,"), count.cast("string")))
    title = (
        F.concat(F.lit("@@ -0,0 +"), span, F.lit(" @@\n"))
        if mark == "+"
        else F.concat(F.lit("@@ -"), span, F.lit(" +0,0 @@\n"))
    )
    return F.when(F.length(text) == 0, F.lit("")).otherwise(F.concat(title, body))


def file_patches(changes: DataFrame, context: int = 3) -> DataFrame:
    """Patch text and line counts per changed file. Whole-file hunks and headers are column expressions.

    A column `context` of the changes, where there is one, gives the lines of context per row.
    """

    @F.pandas_udf("hunks string, shared bigint")
    def line_hunks(old: pd.Series, new: pd.Series, around: pd.Series) -> pd.DataFrame:
        rows = [
            (None, 0) if a is None and b is None else hunks(a or b"", b or b"", max(int(n), 0)) for a, b, n in zip(old, new, around)
        ]
        return pd.DataFrame(rows, columns=["hunks", "shared"])

    around = F.col("context").cast("long") if "context" in changes.columns else F.lit(context).cast("long")

    path, status = F.col("path"), F.col("status")
    old, new = F.col("old_content"), F.col("new_content")
    binary = _is_binary_change()
    side = F.coalesce(new, old).cast("string")
    in_python = ~binary & ((status == "modified") | ~F.is_valid_utf8(side))
    hunk_text = line_hunks(F.when(in_python, old), F.when(in_python, new), around)
    body = (
        F.when(in_python, F.col("_lines.hunks"))
        .when(status == "added", _whole_file(side, "+"))
        .otherwise(_whole_file(side, "-"))
    )
    short = lambda c: F.coalesce(F.substring(c, 1, 7), F.lit(NO_BLOB))
    ids = F.concat(F.lit("index "), short(F.col("old_blob")), F.lit(".."), short(F.col("new_blob")))
    old_name = F.when(status == "added", F.lit("/dev/null")).otherwise(F.concat(F.lit("a/"), path))
    new_name = F.when(status == "deleted", F.lit("/dev/null")).otherwise(F.concat(F.lit("b/"), path))
    title = F.concat(
        F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n"),
        F.when(status == "added", F.concat(F.lit("new file mode 100644\n"), ids))
        .when(status == "deleted", F.concat(F.lit("deleted file mode 100644\n"), ids))
        .otherwise(F.concat(ids, F.lit(" 100644"))),
        F.lit("\n"),
    )
    patch = F.when(
        binary, F.concat(title, F.lit("Binary files "), old_name, F.lit(" and "), new_name, F.lit(" differ\n"))
    ).otherwise(
        F.concat(
            title,
            F.when(body == "", F.lit("")).otherwise(
                F.concat(F.lit("--- "), old_name, F.lit("\n+++ "), new_name, F.lit("\n"), body)
            ),
        )
    )
    shared = F.coalesce("_lines.shared", F.lit(0))
    return changes.withColumn("_lines", hunk_text).select(
        *[c for c in changes.columns if c not in ("old_content", "new_content")],
        patch.alias("patch"),
        F.when(binary, 0).otherwise(_lines(new) - shared).alias("insertions"),
        F.when(binary, 0).otherwise(_lines(old) - shared).alias("deletions"),
    )


def unified_patch(
    base: DataFrame, head: DataFrame, context: int = 3, by: list[str] | None = None
) -> DataFrame:
    return file_patches(changed_files(base, head, by), context)
