"""Request tables: addresses, validation, patterns, keys and work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from treeweave.functions import urls as U
from treeweave.functions.keys import diff_key, request_key
from treeweave.functions.steps import once


def classify_sources(requests: DataFrame) -> DataFrame:
    """Add `parsed`, a struct of the address, NULL where it is none we know."""
    return U.with_parsed(requests)


def normalize_sources(requests: DataFrame, explicit_wins: bool = True) -> DataFrame:
    """Canonical `url`, `branch` and `path`.

    Branch and path named beside the address win over those inside it, or lose with `explicit_wins=False`.
    """
    source = F.col("source")
    parsed = F.col("parsed")
    parts = U.shorthand_parts(source)
    short = F.when(
        U.valid_name(parts[0]) & U.valid_name(F.get(parts, F.lit(1))),
        F.concat_ws("/", F.lit("https://github.com"), parts[0], F.get(parts, F.lit(1))),
    )
    pick = (lambda name: F.coalesce(name, f"parsed.{name}")) if explicit_wins else (
        lambda name: F.coalesce(f"parsed.{name}", name)
    )
    return once(
        classify_sources(requests),
        [c for c in requests.columns if c not in ("branch", "path")],
        url=F.coalesce(parsed.canonical_url, short, source),
        branch=pick("branch"),
        path=pick("path"),
    )


def validate_requests(requests: DataFrame, strict: bool = True) -> DataFrame:
    """Add `reason`, why a request is refused, NULL if it is good. Needs `source`, `operation` and `argument`.

    `strict=False` is the rule of the web form: it takes `source` only and allows longer names.
    """
    if not strict:
        text = F.col("_text")
        hub = text.startswith("https://github.com/") | text.startswith("http://github.com/") | text.startswith("github.com/")
        parts = F.col("_parts")
        shaped = F.when(hub, F.size(parts) >= 2).otherwise((F.size(parts) == 2) & ~text.contains("://"))
        named = U.valid_display_name(F.get(parts, F.lit(0))) & U.valid_display_name(F.get(parts, F.lit(1)))
        prepared = requests.withColumn("_text", F.btrim("source", F.lit(U.SPACES))).withColumn(
            "_parts", F.split(F.when(hub, F.regexp_replace(text, r"^(https?://)?github\.com/", "")).otherwise(text), "/")
        )
        reason = (
            F.when(text.contains("..") | text.contains("//") | text.contains("\\"), "unsafe")
            .when(~shaped, "not_a_repository")
            .when(~named, "invalid_name")
        )
        return once(prepared, requests.columns, reason=reason)

    operation, argument, url = F.col("operation"), F.col("argument"), F.col("url")
    known = normalize_sources(requests)
    prepared = known.withColumn("_address", F.split(F.regexp_replace(url, r"^https?://[^/]+/", ""), "/"))
    named = U.valid_name(F.get("_address", F.lit(0))) & U.valid_name(F.element_at("_address", -1))
    hub = url.rlike(r"^https?://(github|gitlab)\.com/")
    reason = (
        F.when(F.coalesce("source", F.lit("")) == "", "empty_url")
        .when(~U.is_remote_url(url), "invalid_url")
        .when(hub & ~named, "invalid_name")
        .when((operation == "commit") & ~U.valid_sha(argument), "invalid_sha")
        .when(operation.isin("pull", "merge_request") & ~U.valid_number(argument), "invalid_number")
        .when((operation == "compare") & compare_sides(argument).isNull(), "invalid_compare")
    )
    return once(prepared, known.columns, reason=reason)


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good and quarantined rows."""
    return checked.where(F.col("reason").isNull()), checked.where(F.col("reason").isNotNull())


def compare_sides(spec: Column, allow_empty: bool = False) -> Column:
    """Struct (base, head) of `base...head`, else of `base..head`; NULL if neither, or if a side is empty."""
    three, two = F.instr(spec, "..."), F.instr(spec, "..")
    at = F.when(three > 0, three).otherwise(two)
    width = F.when(three > 0, 3).otherwise(2)
    base = F.substring(spec, F.lit(1), at - 1)
    head = F.substring(spec, at + width, F.length(spec))
    given = F.lit(True) if allow_empty else (base != "") & (head != "")
    return F.when((at > 0) & given, F.struct(base.alias("base"), head.alias("head")))


def compare_pairs(requests: DataFrame, allow_empty: bool = False) -> DataFrame:
    """Requests with a `spec` column, plus `base` and `head`."""
    sides = compare_sides(F.col("spec"), allow_empty)
    return requests.withColumn("_sides", sides).select(*requests.columns, "_sides.base", "_sides.head")


def pattern_list(text: Column) -> Column:
    """Comma list to trimmed, non-empty patterns; an absent list is empty."""
    items = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(items, lambda p: p != "")


def pattern_rows(requests: DataFrame, column: str = "include_csv") -> DataFrame:
    return requests.select("request_id", F.explode(pattern_list(F.col(column))).alias("pattern"))


def safe_path_prefix(requests: DataFrame) -> DataFrame:
    """`prefix` from `path`, else `subpath`, unless it climbs or is absolute."""
    wanted = F.coalesce("path", "subpath")
    return requests.withColumn("prefix", F.when(~wanted.contains("..") & ~wanted.startswith("/"), wanted))


def route_requests(requests: DataFrame) -> DataFrame:
    """`route` (an address path) to operation, host, owner, repository, branch, path and argument.

    Paths with a `-` part belong to GitLab and keep that host.
    """
    parts = F.split(F.col("route"), "/")
    part = lambda n: F.get(parts, F.lit(n))
    lab = part(3) == "-"
    tail = F.when(lab, F.slice(parts, 5, 1 << 20)).otherwise(F.slice(parts, 4, 1 << 20))
    item = lambda n: F.get(tail, F.lit(n))
    count = F.size(tail)
    filled = F.forall(F.slice(parts, 2, 5), lambda p: p != "") & (part(0) == "")
    service = F.col("route").isin("/api/ingest", "/cache/stats") | F.col("route").rlike("^/api/(result|download)/[^/]+$") | (
        F.col("route") == "/api/metrics/top"
    )
    single = count == 2
    operation = (
        F.when(~filled | service | (F.size(parts) < 3), None)
        .when((F.size(parts) == 3), "repository")
        .when(item(0).isin("tree", "blob") & single, "branch")
        .when(item(0).isin("tree", "blob") & (count > 2) & (F.length("route") > 0), "path")
        .when((item(0) == "commit") & single, "commit")
        .when((item(0) == "compare") & single, "compare")
        .when((item(0) == "pull") & single & ~lab, "pull")
        .when((item(0) == "merge_requests") & single & lab, "merge_request")
        .when((item(0) == "releases") & (item(1) == "tag") & (count == 3) & ~lab, "tag")
    )
    known = requests.withColumn("operation", operation)
    op = F.col("operation")
    return known.select(
        *requests.columns, "operation",
        F.when(op.isNotNull(), F.when(F.coalesce(lab, F.lit(False)), "gitlab.com").otherwise("github.com")).alias("host"),
        F.when(op.isNotNull(), part(1)).alias("owner"),
        F.when(op.isNotNull(), part(2)).alias("repo"),
        F.when(op.isin("branch", "path"), item(1)).when(op == "tag", item(2)).alias("branch"),
        F.when(op == "path", F.array_join(F.slice(tail, 3, 1 << 20), "/")).alias("path"),
        F.when(op.isin("commit", "compare", "pull", "merge_request"), item(1)).alias("argument"),
    )


def dispatch_sources(requests: DataFrame) -> DataFrame:
    """Where a command-line source goes: `github` (with its kind), `git_url` or `local`."""
    source = F.col("source")
    parts = U.shorthand_parts(source)
    compare = F.split(source, "/", 4)
    is_compare = (
        ~source.contains("://") & (F.size(compare) == 4) & (F.get(compare, F.lit(2)) == "compare")
    )
    known = U.with_parsed(requests, gitlab=False)
    found = F.col("parsed").isNotNull()
    target = (
        F.when(found | parts.isNotNull() | is_compare, "github")
        .when(U.is_remote_url(source), "git_url")
        .otherwise("local")
    )
    return known.select(
        *requests.columns, target.alias("target"),
        F.when(found, F.col("parsed.url_type")).when(parts.isNotNull(), "Repository").when(is_compare, "Compare").alias("url_type"),
        F.when(found, F.col("parsed.owner")).when(target == "github", F.get(compare, F.lit(0))).alias("owner"),
        F.when(found, F.col("parsed.repo")).when(target == "github", F.get(compare, F.lit(1))).alias("repo"),
        F.when(found, F.col("parsed.branch")).when(parts.isNull() & is_compare, F.get(compare, F.lit(3))).alias("branch"),
        F.col("parsed.path").alias("path"),
    )


def with_request_key(requests: DataFrame) -> DataFrame:
    return requests.withColumn(
        "request_key", request_key(F.col("url"), F.col("branch"), F.col("preset"), F.col("path"))
    )


def with_diff_key(requests: DataFrame) -> DataFrame:
    """Needs kind, owner, repo, identifier and context."""
    return requests.withColumn("diff_key", diff_key(*[F.col(c) for c in ("kind", "owner", "repo", "identifier", "context")]))


def work_list(requests: DataFrame) -> DataFrame:
    """Distinct work items with request counts; address parts are those of the first request."""
    first = F.min_by(F.struct("url", "branch", "preset", "path"), F.struct("ts_sec", "request_id"))
    return (
        with_request_key(requests)
        .groupBy("request_key")
        .agg(F.count(F.lit(1)).alias("requests"), F.min("ts_sec").alias("first_seen"), first.alias("item"))
        .select("request_key", "requests", "first_seen", "item.*")
    )
