"""Content addresses and request keys as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def blob_id(content: Column) -> Column:
    """Git content address of a file."""
    header = F.concat(F.lit("blob "), F.octet_length(content).cast("string"))
    return F.sha1(F.concat(header.cast("binary"), F.lit(bytearray(b"\0")), content))


def request_key(url: Column, branch: Column, preset: Column, path: Column) -> Column:
    """Missing parts are skipped, so equal texts in different parts give the same key."""
    return F.sha2(F.concat_ws(":", url, branch, preset, path), 256)


def diff_key(kind: Column, owner: Column, repo: Column, identifier: Column, context: Column) -> Column:
    suffix = F.coalesce(F.concat(F.lit(":ctx"), context.cast("string")), F.lit(""))
    return F.sha2(F.concat(kind, F.lit(":"), owner, F.lit("/"), repo, F.lit(":"), identifier, suffix), 256)
