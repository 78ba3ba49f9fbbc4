"""Commit graphs, references and reports over them.

Tables: `commits(repo_url, sha, author, summary, committed_at)`, `parents(repo_url, sha, parent_ord, parent_sha)`,
`refs(repo_url, ref_name, target_sha)`, `trees(repo_url, commit_sha, path, content[, blob_id])`. Reports may be given `contents`
(blob_id, content), see `snapshots.write_contents`; trees then need blob ids and no contents.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from treeweave.operators.graph import CommitGraph, commit_graph, graph_merge_bases
from treeweave.operators.snapshots import changed_paths, file_patches, with_blob_id, with_stored_contents
from treeweave.session import kept, pin

# Where a reference name is looked up, in this order; then the base branches.
# A commit id prefix is tried before the last place.
REF_PLACES = ["", "refs/", "refs/tags/", "refs/heads/", "refs/remotes/", "refs/remotes/origin/"]
BASE_BRANCHES = ["main", "master", "develop"]


def resolve_short_sha(names: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo_url, name) with the full sha where 7-40 hexadecimal characters start exactly one commit id."""
    name = F.lower("name")
    asked = names.where(F.col("name").rlike("^[0-9a-fA-F]{7,40}$")).select(
        "repo_url", "name", F.substring(name, 1, 7).alias("_start")
    ).distinct()
    known = commits.select("repo_url", "sha", F.substring("sha", 1, 7).alias("_start"))
    return (
        asked.join(known, ["repo_url", "_start"])
        .where(F.startswith(F.col("sha"), F.lower("name")))
        .groupBy("repo_url", "name")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("sha").alias("sha"))
        .where(F.col("_n") == 1)
        .drop("_n")
    )


def resolve_refs(names: DataFrame, refs: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo_url, name) with `sha`, NULL where nothing fits, and `found_as`, the place that decided."""
    asked = names.select("repo_url", "name").distinct()
    places = F.array(*[F.concat(F.lit(place), "name") for place in REF_PLACES])
    candidates = asked.select("repo_url", "name", F.posexplode(places).alias("_at", "ref_name")).withColumn(
        "rank", F.col("_at") * 2
    )
    by_ref = candidates.join(refs, ["repo_url", "ref_name"]).select(
        "repo_url", "name", "rank", "ref_name", F.col("target_sha").alias("sha")
    )
    by_sha = resolve_short_sha(asked, commits).select(
        "repo_url", "name", F.lit(len(REF_PLACES) * 2 - 3).alias("rank"), F.lit("commit").alias("ref_name"), "sha"
    )
    best = by_ref.unionByName(by_sha).groupBy("repo_url", "name").agg(
        F.min(F.struct("rank", "ref_name", "sha")).alias("best")
    )
    return asked.join(best, ["repo_url", "name"], "left").select(
        "repo_url", "name", F.col("best.sha").alias("sha"), F.col("best.ref_name").alias("found_as")
    )


def branch_heads(wanted: DataFrame, refs: DataFrame) -> DataFrame:
    """(repo_url, branch) with the head of the branch, else of HEAD."""
    heads = refs.select("repo_url", "ref_name", "target_sha")
    named = heads.select("repo_url", F.col("ref_name").alias("_ref"), F.col("target_sha").alias("_branch_sha"))
    exact = heads.select("repo_url", F.col("ref_name").alias("branch"), F.col("target_sha").alias("_exact_sha"))
    default = heads.where(F.col("ref_name") == "HEAD").select("repo_url", F.col("target_sha").alias("_head_sha"))
    return (
        wanted.select("repo_url", "branch")
        .distinct()
        .withColumn("_ref", F.concat(F.lit("refs/heads/"), F.coalesce("branch", F.lit("HEAD"))))
        .join(named, ["repo_url", "_ref"], "left")
        .join(exact, ["repo_url", "branch"], "left")
        .join(default, "repo_url", "left")
        .select("repo_url", "branch", F.coalesce("_branch_sha", "_exact_sha", "_head_sha").alias("head_sha"))
    )


def merge_bases(pairs: DataFrame, commits: DataFrame, parents: DataFrame, graph: CommitGraph | None = None) -> DataFrame:
    """(repo_url, base_sha, head_sha) with `merge_base`, the best common ancestor, NULL if there is none.

    A common ancestor is best if no other one descends from it; of several, the newest, then the largest sha. Where the graph of
    the history is stored (`graph.commit_graph`), only its part above the meeting points is read; else it is made of the repositories asked for.
    """
    if graph is None:
        repos = pairs.select("repo_url").distinct()
        graph = commit_graph(commits.join(repos, "repo_url", "left_semi"), parents.join(repos, "repo_url", "left_semi"))
    return graph_merge_bases(pairs, graph)


def base_commits(heads: DataFrame, refs: DataFrame, commits: DataFrame, parents: DataFrame) -> DataFrame:
    """(repo_url, head_sha) with base branch, base commit and `error` where no base branch exists.

    The base is the merge base with the first existing base branch, else the head of that branch.
    """
    names = [f"refs/remotes/origin/{name}" for name in BASE_BRANCHES]
    branch = (
        refs.where(F.col("ref_name").isin(names))
        .withColumn("rank", F.array_position(F.array(*[F.lit(name) for name in names]), F.col("ref_name")))
        .groupBy("repo_url")
        .agg(F.min(F.struct("rank", "ref_name", "target_sha")).alias("best"))
        .select(
            "repo_url",
            F.substring_index("best.ref_name", "/", -1).alias("base_branch"),
            F.col("best.target_sha").alias("base_sha"),
        )
    )
    asked = heads.select("repo_url", "head_sha").distinct().join(branch, "repo_url", "left")
    found = merge_bases(asked.where(F.col("base_sha").isNotNull()), commits, parents)
    return asked.join(found, ["repo_url", "base_sha", "head_sha"], "left").select(
        "repo_url", "head_sha", "base_branch",
        F.coalesce("merge_base", "base_sha").alias("base_sha"),
        F.when(F.col("base_branch").isNull(), "Could not find any base branch (main/master/develop)").alias("error"),
    )


PAIR = ["repo_url", "base_sha", "head_sha"]


# Rows that a list of one change, or a part of one file, holds before it is split.
GROUP = 1_000
# What up to so many pairs or lots need is looked up in the trees; for more, all that is stored is taken, each version of a file once.
FEW = 20_000
EDIT = ["repo_url", "path", "status", "old_blob", "new_blob", "context"]


def pair_changes(pairs: DataFrame, blobs: DataFrame) -> DataFrame:
    """Changed paths with blob ids of pairs of commits (pair, repo_url, base_sha, head_sha, context), which go by their number `pair`."""

    def side(column: str) -> DataFrame:
        asked = pairs.select("pair", "context", "repo_url", F.col(column).alias("commit_sha"))
        return blobs.join(asked, ["repo_url", "commit_sha"]).drop("commit_sha")

    return changed_paths(side("base_sha"), side("head_sha"), ["pair", "context", "repo_url"])


def _long(named: DataFrame, keys: list[str], name: str) -> DataFrame:
    """`named` with, in column `name`, how many times `GROUP` rows its rows with the same keys are. Counted by hashes: a chance meeting of two only splits more."""
    key = F.xxhash64(*keys)
    counts = named.groupBy(key.alias("_key")).agg(F.ceil(F.count(F.lit(1)) / GROUP).alias(name)).where(F.col(name) > 1)
    found = named.withColumn("_key", key).join(kept(counts, name), "_key", "left").drop("_key")
    return found.withColumn(name, F.coalesce(name, F.lit(1)))


def _copies(blobs: DataFrame, ends: DataFrame) -> DataFrame | None:
    """(repo_url, blob_id, n) of blobs whose first place in the commits `ends` is stored more than once, if there are any."""
    place = ["repo_url", "commit_sha", "path", "blob_id"]
    if blobs.groupBy(F.xxhash64(*place)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return None
    places = blobs.join(ends, ["repo_url", "commit_sha"], "left_semi").groupBy(*place).agg(F.count(F.lit(1)).alias("n"))
    copies = places.groupBy("repo_url", "blob_id").agg(F.min(F.struct("commit_sha", "path", "n")).getField("n").alias("n"))
    return kept(copies.where("n > 1"), "copies")


def _lots(named: DataFrame, copies: DataFrame | None) -> DataFrame:
    """Distinct changes of `named` (EDIT, pair, lead, names), each with the list `asked` of the rows that have it.

    Lists hold about `GROUP` rows, so a change that many pairs have is several lots; files with many rows are dealt in several parts.
    """
    dealt = _long(_long(named, EDIT, "lists"), ["repo_url", "path"], "parts").withColumn("list", F.pmod("pair", "lists")).withColumn(
        "part", F.pmod(F.xxhash64("status", "old_blob", "new_blob", "context", "list"), "parts")
    )
    lots = dealt.groupBy(*EDIT, "part", "list").agg(F.collect_list(F.struct("pair", "lead", "names")).alias("asked")).drop("list")
    if copies is not None:
        # A file that is stored more than once counts as often as at the first of its places.
        for side in ("old", "new"):
            lots = lots.join(copies.select("repo_url", F.col("blob_id").alias(f"{side}_blob"), F.col("n").alias(side)), ["repo_url", f"{side}_blob"], "left")
        times = (F.coalesce("old", F.lit(1)) * F.coalesce("new", F.lit(1))).cast("int")
        lots = lots.withColumn("asked", F.flatten(F.array_repeat("asked", times))).drop("old", "new")
    return kept(lots.withColumn("lot", F.monotonically_increasing_id()), "lots", "zstd")


def _with_contents(lots: DataFrame, trees: DataFrame, blobs: DataFrame) -> DataFrame:
    """`lots` with `old_content` and `new_content` from the trees.

    Contents and the lots that need them meet by file, in one shuffle: the versions of a file travel side by side, where they compress well,
    and both sides of a change come to the same place. A window hands each content on to the lots that need it.
    """
    file = ["repo_url", "path", "part"]
    about = F.struct(*[c for c in lots.columns if c not in file])
    needs = lots.select(*file, "lot", about.alias("about"), F.explode(F.array_compact(F.array(*[
        F.when(F.col(f"{side}_blob").isNotNull(), F.struct(F.lit(side).alias("side"), F.col(f"{side}_blob").alias("blob_id"))) for side in ("old", "new")
    ]))).alias("need")).select(*file, "need.*", "lot", F.when(
        (F.col("need.side") == "new") | F.col("about.new_blob").isNull(), F.col("about")
    ).alias("about"))
    stored = trees.where("path IS NOT NULL").select("repo_url", "commit_sha", "path", "content", *[c for c in trees.columns if c == "blob_id"])
    if lots.count() <= FEW:
        wanted = needs.select("repo_url", "path", "blob_id").distinct()
        places = blobs.join(wanted, ["repo_url", "path", "blob_id"]).groupBy("repo_url", "path", "blob_id").agg(F.min("commit_sha").alias("commit_sha"))
        stored = stored.join(kept(places.select("repo_url", "commit_sha", "path"), "places"), ["repo_url", "commit_sha", "path"])
    versions = with_blob_id(stored).where("blob_id IS NOT NULL").select("repo_url", "path", "blob_id", "content").dropDuplicates(["repo_url", "path", "blob_id"])
    # Parts other than the first are there for files with many rows only: their contents go where they are needed, all others to part 0.
    spread = kept(lots.where("part > 0").select("repo_url", "path").distinct(), "files")
    if spread.isEmpty():
        versions = versions.withColumn("part", F.lit(0).cast("long"))
    else:
        places = needs.join(spread, ["repo_url", "path"], "left_semi").select(*file, "blob_id").distinct()
        versions = versions.join(kept(places, "places"), ["repo_url", "path", "blob_id"], "left").withColumn("part", F.coalesce("part", F.lit(0)))
    both = needs.unionByName(versions, True)
    order = F.col("lot").isNotNull()
    before = W.partitionBy(*file, "blob_id").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    met = both.repartition(*file).withColumn("content", F.first("content", ignorenulls=True).over(before)).where(order)
    content = lambda side: F.max(F.when(F.col("side") == side, F.col("content"))).alias(f"{side}_content")
    return met.groupBy(*file, "lot").agg(F.first("about", ignorenulls=True).alias("about"), content("old"), content("new")).select(
        "path", "about.*", "old_content", "new_content"
    )


def _count_lines() -> list[Column]:
    return [
        F.lit("Files changed: "), F.col("files_changed").cast("string"),
        F.lit("\nInsertions: "), F.col("insertions").cast("string"),
        F.lit("\nDeletions: "), F.col("deletions").cast("string"), F.lit("\n\n"),
    ]


def _report(
    pairs: DataFrame, trees: DataFrame, title: list[Column], keys: list[str], context: int, failed: DataFrame | None = None,
    contents: DataFrame | None = None,
) -> DataFrame:
    """Report rows (keys, section, path, text): the title with its counts, then one patch per file, section -1 for errors.

    `pairs` have both commits, with the base '' for the empty tree, and may have their own `context`. Ordered by section and
    path the texts are the report. Trees are compared by blob ids, worked out once per stored file; contents are fetched and lines
    compared once per distinct change, whatever number of pairs has it.
    """
    pairs = pairs if "context" in pairs.columns else pairs.withColumn("context", F.lit(context))
    pairs = pin(pairs.withColumn("context", F.coalesce("context", F.lit(context))).withColumn("row", F.monotonically_increasing_id()))
    pair = [*PAIR, "context"]
    # Distinct pairs go by the number of one of their rows, which leads.
    asked = kept(pairs.groupBy(*pair).agg(F.min("row").alias("pair")), "pairs")
    rows = kept(pairs.select("row", *dict.fromkeys([*keys, *pair])).join(asked, pair).select(
        "pair", (F.col("row") == F.col("pair")).alias("lead"), F.struct(*keys).alias("names")
    ), "rows")
    blobs = with_blob_id(trees).select("repo_url", "commit_sha", "path", "blob_id")
    ends = asked.select("repo_url", F.explode(F.array("base_sha", "head_sha")).alias("commit_sha")).distinct()
    if asked.count() <= FEW:
        # Joined, not filtered: a filter would go below the ids, where contents would be shuffled for it.
        blobs = blobs.join(ends, ["repo_url", "commit_sha"])
    blobs = kept(blobs, "blobs")
    named = kept(pair_changes(asked, blobs).join(rows, "pair"), "changes", "zstd")
    lots = _lots(named, _copies(blobs, ends) if contents is None else None)
    changes = _with_contents(lots, trees, blobs) if contents is None else with_stored_contents(lots, contents)
    patches = kept(file_patches(changes).select("path", "asked", "patch", "insertions", "deletions"), "patches", "zstd")
    each = patches.select("insertions", "deletions", F.inline("asked"))
    counts = each.where("lead").groupBy("pair").agg(
        F.count(F.lit(1)).alias("files_changed"),
        F.sum("insertions").alias("insertions"),
        F.sum("deletions").alias("deletions"),
    )
    counted = asked.join(counts, "pair").drop("pair")
    titles = pairs.join(counted, pair, "left").fillna(0, ["files_changed", "insertions", "deletions"]).select(
        *keys, F.lit(0).alias("section"), F.lit("").alias("path"), F.concat(*title, *_count_lines()).alias("text")
    )
    texts = patches.select("path", "patch", F.inline("asked")).select(
        "names.*", F.lit(1).alias("section"), "path", F.col("patch").alias("text")
    )
    report = titles.unionByName(texts)
    return report if failed is None else report.unionByName(
        failed.select(*keys, F.lit(-1).alias("section"), F.lit("").alias("path"), "text")
    )


def compare_report(pairs: DataFrame, trees: DataFrame, context: int = 3, contents: DataFrame | None = None) -> DataFrame:
    """Pairs (repo_url, base, head, base_sha, head_sha[, context]), names and resolved commits, to report rows.

    A name that is not resolved, the base first, gives an error row.
    """
    title = [F.lit("# Comparing "), F.col("base"), F.lit(" to "), F.col("head"), F.lit("\n\n")]
    missing = F.when(F.col("base_sha").isNull(), F.col("base")).when(F.col("head_sha").isNull(), F.col("head"))
    failed = pairs.where(missing.isNotNull()).withColumn("text", F.concat(F.lit("Failed to resolve reference: "), missing))
    return _report(pairs.where(missing.isNull()), trees, title, ["repo_url", "base", "head"], context, failed, contents)


def commit_pairs(shas: DataFrame, commits: DataFrame, parents: DataFrame) -> DataFrame:
    """Commits asked for (repo_url, sha[, context]), by id or by its unique beginning, with `name` as asked.

    `base_sha` is the first parent, '' for a root; `head_sha` is null where no commit is found.
    """
    first = parents.where(F.col("parent_ord") == 0).select(
        "repo_url", F.col("sha").alias("head_sha"), F.col("parent_sha").alias("base_sha")
    )
    asked = shas.withColumnRenamed("sha", "name").dropDuplicates()
    exact = commits.select("repo_url", F.col("sha").alias("name"), F.col("sha").alias("_exact"))
    short = resolve_short_sha(asked, commits).select("repo_url", "name", F.col("sha").alias("_short"))
    found = asked.join(exact, ["repo_url", "name"], "left").join(short, ["repo_url", "name"], "left")
    about = commits.select("repo_url", F.col("sha").alias("head_sha"), "author", "summary")
    return (
        found.withColumn("head_sha", F.coalesce("_exact", "_short")).drop("_exact", "_short")
        .join(about, ["repo_url", "head_sha"], "left")
        .join(first, ["repo_url", "head_sha"], "left")
        .withColumn("base_sha", F.coalesce("base_sha", F.lit("")))
        .withColumn("sha", F.coalesce("head_sha", "name"))
    )


def commit_report(
    shas: DataFrame, commits: DataFrame, parents: DataFrame, trees: DataFrame, context: int = 3, contents: DataFrame | None = None
) -> DataFrame:
    """Commits (repo_url, sha[, context]) to report rows; `sha` is the full id, or as asked where there is none."""
    title = [
        F.lit("# Commit "), F.col("sha"), F.lit("\n\n"),
        F.coalesce(F.concat(F.lit("Message: "), "summary", F.lit("\n")), F.lit("")),
        F.coalesce(F.concat(F.lit("Author: "), "author", F.lit("\n")), F.lit("")), F.lit("\n"),
    ]
    pairs = pin(commit_pairs(shas, commits, parents))
    failed = pairs.where("head_sha IS NULL").withColumn("text", F.concat(F.lit("Failed to find commit: "), "name"))
    return _report(pairs.where("head_sha IS NOT NULL"), trees, title, ["repo_url", "sha"], context, failed, contents)


def _request_report(
    numbers: DataFrame, refs: DataFrame, commits: DataFrame, parents: DataFrame, trees: DataFrame, context: int,
    place: str, name: str, short: str, contents: DataFrame | None,
) -> DataFrame:
    own = ["context"] if "context" in numbers.columns else []
    wanted = numbers.select(
        "repo_url", "number", *own, F.concat(F.lit(f"refs/{place}/"), F.col("number").cast("string"), F.lit("/head")).alias("ref_name")
    ).distinct()
    heads = pin(
        wanted.join(refs, ["repo_url", "ref_name"], "left").select("repo_url", "number", *own, F.col("target_sha").alias("head_sha"))
    )
    based = base_commits(heads.where(F.col("head_sha").isNotNull()), refs, commits, parents)
    asked = pin(heads.join(based, ["repo_url", "head_sha"], "left"))
    title = [
        F.lit(f"# {name} "), F.lit(short), F.col("number").cast("string"), F.lit("\n\nBase: "), F.col("base_branch"),
        F.lit(" ("), F.col("base_sha"), F.lit(f")\nHead: {'MR' if short == '!' else 'PR'} {short}"),
        F.col("number").cast("string"), F.lit(" ("), F.col("head_sha"), F.lit(")\n\n"),
    ]
    good = asked.where(F.col("base_sha").isNotNull())
    failed = asked.where(F.col("base_sha").isNull()).select(
        "repo_url", "number",
        F.coalesce("error", F.lit(f"Failed to find {'MR' if short == '!' else 'PR'} ref after fetch")).alias("text"),
    )
    return _report(good, trees, title, ["repo_url", "number"], context, failed, contents)


def pull_request_report(
    numbers: DataFrame, refs: DataFrame, commits: DataFrame, parents: DataFrame, trees: DataFrame, context: int = 3,
    contents: DataFrame | None = None,
) -> DataFrame:
    """(repo_url, number) to report rows; section -1 holds the error of a request that cannot be reported."""
    return _request_report(numbers, refs, commits, parents, trees, context, "pull", "Pull Request", "#", contents)


def merge_request_report(
    numbers: DataFrame, refs: DataFrame, commits: DataFrame, parents: DataFrame, trees: DataFrame, context: int = 3,
    contents: DataFrame | None = None,
) -> DataFrame:
    return _request_report(numbers, refs, commits, parents, trees, context, "merge-requests", "Merge Request", "!", contents)
