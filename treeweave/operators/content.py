"""What is inside the files: binary flag, text, licences, tokens, kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from treeweave.functions import text as T
from treeweave.functions.globs import extension, file_name
from treeweave.functions.licenses import compressed_text, is_license_path, license_tag

# File kinds by name ending.
FILE_KINDS = {
    "rust": ["rs"],
    "javascript": ["js", "jsx"],
    "typescript": ["ts", "tsx"],
    "python": ["py"],
    "go": ["go"],
    "java": ["java"],
    "c": ["c", "cpp", "cc"],
    "header": ["h", "hpp"],
    "markdown": ["md"],
    "json": ["json"],
    "config": ["toml", "yaml", "yml"],
    "html": ["html"],
    "style": ["css", "scss", "sass"],
    "image": ["png", "jpg", "jpeg", "gif", "svg"],
    "lock": ["lock"],
}


def is_binary(content: Column) -> Column:
    """A NUL byte among the first 8,192 bytes."""
    return F.contains(F.substring(content, 1, 8192), F.lit(bytearray(b"\0")))


def flag_binary(files: DataFrame) -> DataFrame:
    return files.withColumn("is_binary", is_binary(F.col("content")))


def decoded(content: Column, indexed: bool) -> Column:
    """Text of a file, or the placeholder of the chosen mode."""
    raw = content.cast("string")
    if not indexed:
        return F.when(F.is_valid_utf8(raw), raw).otherwise("[binary file]")
    return (
        F.when(is_binary(content), F.lit("[binary file]"))
        .when(F.is_valid_utf8(raw), raw)
        .otherwise("[error reading file]")
    )


def decode(files: DataFrame, indexed: bool = True) -> DataFrame:
    return files.withColumn("text", decoded(F.col("content"), indexed)).drop("content")


def license_census(texts: DataFrame) -> DataFrame:
    """Recognised licence files per repository and licence."""
    return (
        texts.where(is_license_path(F.col("path")))
        .select("repo_url", license_tag(F.col("path"), F.col("text")).alias("license"))
        .where(F.col("license").isNotNull())
        .groupBy("repo_url", "license")
        .agg(F.count(F.lit(1)).alias("files"))
    )


def compress_licenses(texts: DataFrame) -> DataFrame:
    """Replace recognised licence files by their tag; `saved` is the number of bytes this takes away."""
    path, text = F.col("path"), F.col("text")
    return texts.withColumn("_short", compressed_text(path, text)).select(
        *[c for c in texts.columns if c != "text"],
        F.col("_short").alias("text"),
        (T.byte_count(text) - T.byte_count(F.col("_short"))).alias("saved"),
    )


def file_kind(path: Column) -> Column:
    ending = extension(file_name(path))
    kind = F.lit("other")
    for name, endings in FILE_KINDS.items():
        kind = F.when(ending.isin(endings), F.lit(name)).otherwise(kind)
    return kind


def file_kind_census(files: DataFrame) -> DataFrame:
    return files.groupBy(file_kind(F.col("path")).alias("kind")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")
    )


def token_budget(texts: DataFrame, by: str = "repo") -> DataFrame:
    """Estimated tokens per `file`, per `repo`, or per repository and file kind with all totals (`corpus`)."""
    tokens = texts.select(
        "repo_url", "path", file_kind(F.col("path")).alias("kind"), T.text_tokens(F.col("text")).alias("tokens")
    )
    if by == "file":
        return tokens.select("repo_url", "path", "tokens")
    totals = (F.count(F.lit(1)).alias("files"), F.sum("tokens").alias("tokens"))
    if by == "repo":
        return tokens.groupBy("repo_url").agg(*totals)
    return tokens.rollup("repo_url", "kind").agg(*totals)


def marker_counts(documents: DataFrame) -> DataFrame:
    return documents.withColumn("markers", T.marker_count(F.col("text"))).drop("text")
