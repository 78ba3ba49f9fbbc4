"""Which files of a tree are taken."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from treeweave.functions.globs import (
    extension,
    file_name,
    first_component,
    glob_match,
    include_match,
    included_by_any,
    matches_any,
)
from treeweave.operators.rules import PRESETS, dropped_under, effective_patterns, preset_name
from treeweave.session import kept

MAX_FILE_SIZE = 1024 * 1024
# Default limit of a request.
MAX_REQUEST_SIZE = 10 * 1024 * 1024


@dataclass(frozen=True)
class IngestOptions:
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    max_file_size: int = MAX_FILE_SIZE
    include_untracked: bool = False
    branch: str | None = None
    path_prefix: str | None = None
    preset: str | None = None
    apply_default_filters: bool = True
    indexed: bool = field(default=True)

    @property
    def patterns(self) -> list[str]:
        return effective_patterns(self.exclude, self.preset, self.apply_default_filters)


def glob_filter(files: DataFrame, patterns: Iterable[str]) -> DataFrame:
    return files.where(matches_any(patterns, F.col("path")))


def exclude(files: DataFrame, patterns: Iterable[str]) -> DataFrame:
    """Drop files that a known rule list matches: a narrow filter on the path column."""
    return files.where(~matches_any(patterns, F.col("path")))


def exclude_by_table(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Drop files that a rule table (`pattern`), of any size, matches: see `matched_paths`.

    As with a list, no rule matches a null path.
    """
    return files.join(matched_paths(files, rules.select("pattern").distinct()), "path", "left_anti")


def filed_under(pattern: Column) -> Column:
    """Struct (place, text): what every match of a pattern has at its `first` part, as its `extension`, at its `begin` or its `end`."""
    star = F.instr(pattern, "*")
    several = F.length(pattern) - F.length(F.replace(pattern, F.lit("*"), F.lit(""))) > 1
    suffix, folder = pattern.startswith("*."), pattern.endswith("/*")
    literal = ~suffix & ~folder & ((star == 0) | several)
    at_end = suffix | ((star == 1) & ~folder & ~several)
    plain = F.substring(pattern, 3, 1 << 30)
    by_extension = suffix & ~plain.contains(".") & ~plain.contains("/")
    text = (
        F.when(by_extension, plain).when(literal, pattern).when(at_end, F.substring(pattern, 2, 1 << 30))
        .when(folder, F.substring(pattern, F.lit(1), F.length(pattern) - 2)).otherwise(F.substring(pattern, F.lit(1), star - 1))
    )
    place = F.when(by_extension, "extension").when(literal & ~pattern.contains("/"), "first").when(at_end, "end").otherwise("begin")
    return F.struct(place.alias("place"), text.alias("text"))


def lookups(path: Column, beginnings: Column, endings: Column) -> Column:
    """All (place, text) under which a pattern that matches `path` may be filed, for beginnings and endings of these lengths."""

    def at(place: str, lengths: Column, cut) -> Column:
        fitting = F.filter(lengths, lambda n: n <= F.length(path))
        return F.transform(fitting, lambda n: F.struct(F.lit(place).alias("place"), cut(n).alias("text")))

    named = F.array(
        F.struct(F.lit("first").alias("place"), first_component(path).alias("text")),
        F.struct(F.lit("extension").alias("place"), F.when(path.contains("."), extension(path)).alias("text")),
    )
    return F.concat(
        named, at("begin", beginnings, lambda n: F.substring(path, F.lit(1), n)),
        at("end", endings, lambda n: F.substring(path, F.length(path) - n + 1, n)),
    )


def matched_paths(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct paths that any pattern matches, for rule tables of any size.

    Each pattern is filed under a text that its matches must have at a certain place, the paths under what they have there, and
    equal texts meet in a hash join and are then compared in full. A pattern that names an extension or a first part meets paths
    by their last extension or first part, one text each; the rest meets beginnings and endings of the lengths that such patterns
    have. What reaches the driver is these lengths, and whether a pattern matches every path.
    """
    pattern, path = F.col("pattern"), F.col("path")
    filed = rules.select("pattern", filed_under(pattern).alias("at")).select("pattern", "at.*")
    facts = filed.agg(
        *[F.sort_array(F.collect_set(F.when(F.col("place") == p, F.length("text")))).alias(p) for p in ("begin", "end")],
        F.max(pattern == "*").alias("every"), F.max(pattern == "/*").alias("nonempty"),
    ).first()
    paths = files.select("path").where(path.isNotNull()).distinct()
    if facts["every"]:
        return paths
    beginnings, endings = (F.array(*[F.lit(n) for n in facts[p] if n]).cast("array<int>") for p in ("begin", "end"))
    looked_up = lookups(path, beginnings, endings)
    found = (
        paths.select("path", F.inline(looked_up))
        .join(filed, ["place", "text"])
        .where(glob_match(pattern, path))
        .select("path")
    )
    return (found.union(paths.where(path != "")) if facts["nonempty"] else found).distinct()


def include(files: DataFrame, patterns: Iterable[str]) -> DataFrame:
    return files.where(included_by_any(patterns, F.col("path")))


def below(prefix: str | None) -> Column:
    """Tracked files below a directory; untracked ones by bare text prefix."""
    if not prefix:
        return F.lit(True)
    folder = prefix if prefix.endswith("/") else prefix + "/"
    path = F.col("path")
    return F.when(F.col("git_status") == "untracked", path.startswith(prefix)).otherwise(path.startswith(folder))


def under_prefix(files: DataFrame, prefix: str | None) -> DataFrame:
    return files.where(below(prefix))


def by_status(files: DataFrame, include_untracked: bool, commits: DataFrame | None = None) -> DataFrame:
    """Tracked files; untracked ones only if asked for, or in a repository that has no commit."""
    if include_untracked:
        return files
    tracked = files.where(F.col("git_status") == "tracked")
    if commits is None:
        return tracked
    born = commits.select("repo_url").distinct()
    unborn = files.where(F.col("git_status") == "untracked").join(born, "repo_url", "left_anti")
    return tracked.unionByName(unborn)


def in_git_dir(path: Column) -> Column:
    return F.concat(F.lit("/"), path, F.lit("/")).contains("/.git/")


def drop_git_dir(files: DataFrame) -> DataFrame:
    return files.where(~in_git_dir(F.col("path")))


def max_size(files: DataFrame, limit: int) -> DataFrame:
    return files.where(F.col("size") <= limit)


def distinct_paths(files: DataFrame) -> DataFrame:
    return files.dropDuplicates(["repo_url", "path"])


def should_include(options: IngestOptions) -> Column:
    """The inclusion decision for one file: ignored, repository folder, excludes, includes."""
    path = F.col("path")
    seen = F.lit(True) if options.include_untracked else F.col("git_status") != "ignored"
    return (
        seen
        & ~in_git_dir(path)
        & ~matches_any(options.patterns, path)
        & included_by_any(options.include, path)
    )


def taken(options: IngestOptions) -> Column:
    """Whether a file row enters a document, by status, prefix and rules; what batches and streams share."""
    take_untracked = options.include_untracked and not options.indexed
    listed = F.lit(True) if take_untracked else F.col("git_status") == "tracked"
    return listed & below(options.path_prefix) & should_include(options)


def ingestable(files: DataFrame, options: IngestOptions, commits: DataFrame | None = None) -> DataFrame:
    """Files that enter a document, without the size limit."""
    take_untracked = options.include_untracked and not options.indexed
    if commits is None:
        kept = files.where(taken(options))
    else:
        kept = by_status(files, take_untracked, commits).where(below(options.path_prefix) & should_include(options))
    # A path is listed twice only where untracked files join the tracked ones.
    return distinct_paths(kept) if take_untracked or commits is not None else kept


def work_specs(requests: DataFrame) -> DataFrame:
    """Requests with a `spec_key`, equal where repository and all options are equal.

    Options that have no column take their defaults: no `branch` (that of the checkout), no `path_prefix`, not `raw`, and
    `MAX_REQUEST_SIZE` for `max_size`. A raw request has the raw preset, whatever it names.
    """
    defaults = {"branch": F.lit(None).cast("string"), "path_prefix": F.lit(None).cast("string"), "max_size": F.lit(MAX_REQUEST_SIZE)}
    for name, value in defaults.items():
        requests = requests.withColumn(name, F.coalesce(name, value) if name in requests.columns else value)
    raw = F.col("raw") if "raw" in requests.columns else None
    requests = requests.withColumn("preset", preset_name(F.col("preset"), raw))
    spec = F.struct(
        "repo_url", "preset", *defaults, F.array_sort("include").alias("include"), F.array_sort("exclude").alias("exclude"),
    )
    return requests.withColumn("spec_key", F.sha2(F.to_json(spec), 256))


def _list_rules(patterns: Column, including: bool) -> Column:
    """Patterns of a list as array of (pattern, subject, place, text); `subject` says whether path or file name has to match."""

    def rule(p: Column) -> Column:
        at = filed_under(p)
        place, text, subject = at["place"], at["text"], F.lit("path")
        if including:
            folder = p.endswith("/")
            place = F.when(folder, "begin").otherwise(place)
            text = F.when(folder, F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(text)
            subject = F.when(p.contains("/"), "path").otherwise("name")
        return F.struct(p.alias("pattern"), subject.alias("subject"), place.alias("place"), text.alias("text"))

    return F.transform(F.array_distinct(patterns), rule)


def pattern_lists(specs: DataFrame) -> DataFrame:
    """Distinct lists of patterns of `specs` (include_id, include, exclude_id, exclude): (list_id, including, rules)."""
    each = [
        specs.select(F.col(f"{kind}_id").alias("list_id"), F.lit(kind == "include").alias("including"), _list_rules(F.col(kind), kind == "include").alias("rules"))
        for kind in ("include", "exclude")
    ]
    return each[0].unionByName(each[1]).where(F.col("list_id").isNotNull()).dropDuplicates(["list_id"])


def list_hits(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """Those of the distinct `pairs` (list_id, path) where a pattern of the list matches the path.

    Patterns are filed under a text that their matches have at a certain place, paths are looked up there, and only equal texts of one
    list meet. The lengths of beginnings and endings are those of the list; nothing reaches the driver. No pattern matches a null path.
    """
    path, name = F.col("path"), file_name(F.col("path"))
    lengths = lambda place: F.array_distinct(
        F.transform(F.filter("rules", lambda r: r["place"] == place), lambda r: F.length(r["text"]))
    ).alias(place)
    facts = lists.select("list_id", "including", lengths("begin"), lengths("end"))
    rules = lists.select("list_id", "including", F.inline("rules"))
    looked_up = lambda subject, text: F.transform(
        lookups(text, F.col("begin"), F.col("end")), lambda at: F.struct(F.lit(subject).alias("subject"), at["place"].alias("place"), at["text"].alias("text"))
    )
    places = F.when(F.col("including"), F.concat(looked_up("path", path), looked_up("name", name))).otherwise(looked_up("path", path))
    pattern = F.col("pattern")
    return (
        pairs.where(path.isNotNull()).join(facts, "list_id").select("list_id", "path", F.inline(places))
        .join(rules, ["list_id", "subject", "place", "text"])
        .where(F.when(F.col("including"), include_match(pattern, path)).otherwise(glob_match(pattern, path)))
        .select("list_id", "path").distinct()
    )


def filter_for_requests(files: DataFrame, requests: DataFrame) -> DataFrame:
    """Files kept for each distinct specification: (spec_key, repo_url, path, size).

    Equal requests are merged first, so work grows with distinct specifications and not with requests. What the presets drop is
    found once per file, before files meet specifications. Files with a `branch` meet requests for that branch, null with null.
    Lists of patterns that several specifications have are one list, each path meets it once (`list_hits`), and
    specifications take the result by the id of the list.
    """
    list_id = lambda kind: F.when(F.size(kind) > 0, F.sha2(F.to_json(F.struct(kind)), 256)).alias(f"{kind}_id")
    specs = work_specs(requests).select(
        "spec_key", F.col("repo_url").alias("_repo"), F.col("branch").alias("_branch"), "preset", "path_prefix", "max_size",
        "include", "exclude", list_id("include"), list_id("exclude"),
    ).dropDuplicates(["spec_key"])
    path = F.col("path")
    dropped = F.struct(*[dropped_under(name, path).alias(name) for name in PRESETS])
    branch = F.col("branch") if "branch" in files.columns else F.lit(None).cast("string")
    listed = files.where((F.col("git_status") == "tracked") & ~in_git_dir(path)).select(
        "repo_url", branch.alias("branch"), "path", "size", dropped.alias("dropped")
    )
    under_preset = reduce(lambda rest, name: F.when(F.col("preset") == name, F.col("dropped")[name]).otherwise(rest), PRESETS, F.lit(False))
    folder = F.when(F.col("path_prefix").endswith("/"), F.col("path_prefix")).otherwise(F.concat("path_prefix", F.lit("/")))
    same_branch = F.col("branch").eqNullSafe(F.col("_branch")) if "branch" in files.columns else F.lit(True)
    met = kept(
        listed.join(specs.drop("include", "exclude"), (F.col("repo_url") == F.col("_repo")) & same_branch)
        .where(~under_preset & (F.col("size") <= F.col("max_size")))
        .where(F.coalesce(path.startswith(folder), F.lit(True)))
        .select("spec_key", "repo_url", "path", "size", "include_id", "exclude_id"),
        "met",
    )
    pairs = met.select("path", F.explode(F.array_compact(F.array("include_id", "exclude_id"))).alias("list_id")).distinct()
    hits = list_hits(pairs, pattern_lists(specs))
    excluded = hits.select(F.col("list_id").alias("exclude_id"), "path")
    included = hits.select(F.col("list_id").alias("include_id"), "path", F.lit(True).alias("_in"))
    return (
        met.join(excluded, ["exclude_id", "path"], "left_anti")
        .join(included, ["include_id", "path"], "left")
        .where(F.col("include_id").isNull() | F.col("_in"))
        .select("spec_key", "repo_url", "path", "size")
    )


def request_totals(files: DataFrame, requests: DataFrame) -> DataFrame:
    """Kept files and bytes per request."""
    totals = (
        filter_for_requests(files, requests)
        .groupBy("spec_key")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    )
    return (
        work_specs(requests)
        .join(totals, "spec_key", "left")
        .select(
            "request_id", "repo_url", "preset",
            F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"),
        )
    )
