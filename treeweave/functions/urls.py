"""Repository addresses as Spark columns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from treeweave.functions.steps import once

# Address prefixes that count as remote, and folder names that end a branch name in a
# `tree` or `blob` address.
REMOTE_PREFIXES = [
    "https://github.com/", "http://github.com/",
    "https://gitlab.com/", "http://gitlab.com/",
    "https://gist.github.com/",
    "https://raw.githubusercontent.com/",
    "https://gist.githubusercontent.com/",
]
PATH_ROOTS = [
    "src", "lib", "test", "tests", "docs", "bin", "pkg", "cmd",
    "internal", "api", "web", "client", "server", "assets", "public",
]
# Characters that count as white space at the ends of an address.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))

HOST_PREFIXES = {
    "gist": ["https://gist.github.com/", "http://gist.github.com/"],
    "raw": ["https://raw.githubusercontent.com/", "http://raw.githubusercontent.com/"],
    "hub": ["https://github.com/", "http://github.com/", "github.com/"],
    "lab": ["https://gitlab.com/", "http://gitlab.com/", "gitlab.com/"],
}


def trimmed(source: Column) -> Column:
    return F.rtrim(F.btrim(source, F.lit(SPACES)), F.lit("/"))


def is_remote_url(url: Column) -> Column:
    return reduce(or_, [url.startswith(prefix) for prefix in REMOTE_PREFIXES])


def _path_of(url: Column, host: str) -> Column:
    """What follows the host, NULL for another host."""
    path = F
    for prefix in HOST_PREFIXES[host]:
        path = path.when(url.startswith(prefix), F.substring(url, len(prefix) + 1, 1 << 30))
    return path


def _joined(parts: Column, start: int | Column, count: Column | None = None) -> Column:
    """Parts from `start` (1-based) on as a path, NULL if `start` is behind the last one."""
    start = F.lit(start) if isinstance(start, int) else start
    count = F.size(parts) if count is None else count
    sliced = F.slice(parts, F.greatest(start, F.lit(1)), F.greatest(count, F.lit(0)))
    return F.when(start <= F.size(parts), F.array_join(sliced, "/"))


def with_parsed(df: DataFrame, gitlab: bool = True) -> DataFrame:
    """Add `parsed`, a struct of the address in `source`, NULL where it is none we know.

    The steps are projections of their own, so that each part of the address is worked out once per row.
    """
    c = F.col
    part = lambda n: F.get("_parts", n if isinstance(n, Column) else F.lit(n))
    url = c("_url")
    host_path = (
        F.when(url.contains("gist.github.com"), _path_of(url, "gist"))
        .when(url.contains("raw.githubusercontent.com"), _path_of(url, "raw"))
    )
    plain = _path_of(url, "hub")
    host = (
        F.when(url.contains("gist.github.com"), "gist")
        .when(url.contains("raw.githubusercontent.com"), "raw")
        .when(plain.isNotNull(), "hub")
    )
    path = F.when(host.isin("gist", "raw"), host_path).otherwise(plain)
    # An address of a gist or raw host that does not start with it can still be a GitLab address, as can any other.
    lab_path = _path_of(url, "lab")

    parts = F.split(F.coalesce(c("_path"), c("_lab")) if gitlab else c("_path"), "/")
    size = F.size("_parts")
    roots = F.transform(
        F.slice("_parts", 4, 1 << 20), lambda p: (p.contains(".") & ~p.endswith(".git")) | p.isin(PATH_ROOTS)
    )
    is_lab = c("_path").isNull() & c("_lab").isNotNull()
    kind = (
        F.when(is_lab, F.lit(None))
        .when((c("_host") == "gist") & (size >= 1), "Gist")
        .when((c("_host") == "raw") & (size >= 3), "Raw")
        .when((c("_host") == "hub") & (size == 2), "Repository")
        .when(
            (c("_host") == "hub") & (size >= 4) & part(2).isin("tree", "blob", "commit", "compare"), F.initcap(part(2))
        )
    )
    mark = c("_mark")
    acts = mark > 1
    lab_kind = F.when(size >= 2, F.when(mark == 0, "GitLabRepository")
        .when(acts & (part(mark) == "tree") & (size >= mark + 2), "GitLabTree")
        .when(acts & (part(mark) == "blob") & (size >= mark + 3), "GitLabBlob")
        .when(acts & (part(mark) == "merge_requests") & (size >= mark + 2), "GitLabMergeRequest"))
    if gitlab:
        kind = F.when(is_lab, lab_kind).otherwise(kind)

    k, lab_deep = c("_kind"), c("_kind").isin("GitLabTree", "GitLabBlob", "GitLabMergeRequest")
    branchy = k.isin("Tree", "Blob")
    owner = F.when((k == "Gist") & (size == 1), "anonymous").otherwise(part(0))
    repo = (
        F.when(k == "Gist", F.when(size == 1, part(0)).otherwise(part(1)))
        .when(k == "GitLabRepository", part(size - 1))
        .when(lab_deep, part(mark - 2))
        .otherwise(part(1))
    )
    cut = c("_cut")
    branch = (
        F.when(branchy, F.when(cut == 1, F.lit("")).when(cut > 1, _joined(c("_parts"), 4, cut - 1)).otherwise(_joined(c("_parts"), 4)))
        .when(k == "Raw", part(2))
        .when(k == "Commit", part(3))
        .when(k == "Compare", _joined(c("_parts"), 4))
        .when(lab_deep, part(mark + 1))
    )
    inner = (
        F.when(branchy & (cut > 0), _joined(c("_parts"), cut + 3))
        .when(k == "Raw", _joined(c("_parts"), 4))
        .when(k.isin("GitLabTree", "GitLabBlob"), _joined(c("_parts"), mark + 3))
    )
    canonical = (
        F.when(k == "Gist", F.concat(F.lit("https://gist.github.com/"), _joined(c("_parts"), 1, F.lit(2))))
        .when(k == "GitLabRepository", F.concat(F.lit("https://gitlab.com/"), _joined(c("_parts"), 1)))
        .when(lab_deep, F.concat(F.lit("https://gitlab.com/"), _joined(c("_parts"), 1, mark - 1)))
        .otherwise(F.concat(F.lit("https://github.com/"), _joined(c("_parts"), 1, F.lit(2))))
    )
    fields = F.struct(
        owner.alias("owner"), repo.alias("repo"), branch.alias("branch"), inner.alias("path"),
        k.alias("url_type"), canonical.alias("canonical_url"),
    )
    stepwise = (
        df.withColumn("_url", trimmed(c("source")))
        .withColumns({"_host": host, "_path": path, "_lab": lab_path})
        .withColumn("_parts", parts)
        .withColumns({
            "_mark": F.array_position("_parts", "-").cast("int"),
            "_cut": F.when(part(2).isin("tree", "blob"), F.array_position(roots, F.lit(True)).cast("int")),
        })
        .withColumn("_kind", kind)
    )
    return once(stepwise, df.columns, parsed=F.when(k.isNotNull(), fields))


def valid_name(name: Column) -> Column:
    """Owner and repository names: 1-39 bytes of letters, digits, `-_.`, with no `-` or `.` at either end."""
    return (
        name.isNotNull()
        & F.octet_length(name).between(1, 39)
        & name.rlike(r"^[\p{IsAlphabetic}\p{N}_.-]+$")
        & ~name.rlike(r"^[-.]|[-.]$")
    )


def valid_display_name(name: Column) -> Column:
    """The looser rule of the web form: up to 100 bytes, only `.` barred at the ends."""
    return (
        name.isNotNull()
        & F.octet_length(name).between(1, 100)
        & name.rlike(r"^[\p{IsAlphabetic}\p{N}_.-]+$")
        & ~name.rlike(r"^\.|\.$")
    )


def shorthand_parts(source: Column) -> Column:
    """`owner/repo` without scheme as a two-part array, else NULL."""
    parts = F.split(source, "/")
    return F.when(~source.contains("://") & (F.size(parts) == 2), parts)


def valid_sha(sha: Column) -> Column:
    return sha.isNotNull() & sha.rlike("^[0-9a-fA-F]{7,40}$")


def valid_number(text: Column) -> Column:
    """Decimal text, with or without a plus sign, that fits 32 unsigned bits."""
    return text.isNotNull() & text.rlike(r"^\+?0*[0-9]{1,10}$") & F.coalesce(text.try_cast("bigint") <= 4294967295, F.lit(False))
