"""Queries over snapshots and commit graphs."""

from __future__ import annotations

import pathlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from treeweave.operators import history, snapshots
from treeweave.plans.file_queries import with_content
from treeweave.plans.registry import query
from treeweave.plans.views import load, with_views
from treeweave.session import kept, new_folder

LINE_LIST = (
    "list_filter(list_transform(string_split({0}, chr(10)), lambda x, i: CASE WHEN i < length({0}) - length(replace({0}, chr(10), '')) + 1 "
    "THEN x || chr(10) ELSE x END), lambda x: x <> '')"
)


def blob_sql(text: str) -> str:
    return f"sha1('blob ' || CAST(strlen({text}) AS VARCHAR) || chr(0) || {text})"


def change_views(old: str, new: str, keys: list[str]) -> dict[str, str]:
    """Views `changes` and `change_stats` of two trees, by lines as multisets (edits of the inputs move no lines)."""
    on = " AND ".join(f"o.{k} = n.{k}" for k in [*keys, "path"])
    cols = ", ".join(f"coalesce(o.{k}, n.{k}) AS {k}" for k in [*keys, "path"])
    listed = ", ".join([*keys, "path"])
    return {
        "changes": f"SELECT {cols}, o.text AS old_text, n.text AS new_text, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL "
        f"THEN 'deleted' ELSE 'modified' END AS status FROM {old} o FULL JOIN {new} n ON {on} WHERE o.text IS DISTINCT FROM n.text",
        "line_rows": f"SELECT {listed}, unnest({LINE_LIST.format('old_text')}) AS line, -1 AS side FROM changes WHERE old_text IS NOT NULL "
        f"UNION ALL SELECT {listed}, unnest({LINE_LIST.format('new_text')}) AS line, 1 AS side FROM changes WHERE new_text IS NOT NULL",
        "line_sums": f"SELECT {listed}, line, sum(side) AS d FROM line_rows GROUP BY ALL",
        "change_stats": f"SELECT {listed}, CAST(sum(greatest(d, 0)) AS BIGINT) AS insertions, CAST(sum(greatest(-d, 0)) AS BIGINT) AS deletions "
        f"FROM line_sums GROUP BY {listed}",
    }


BASE_HEAD = change_views("files_base", "files_head", ["repo_url"])


def _base_head(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base, head = load(spark, sf_dir, "files_base", "files_head")
    return with_content(base), with_content(head)


@query(
    "snapshot_diff",
    with_views(
        f"SELECT repo_url, path, {blob_sql('old_text')} AS old_blob, {blob_sql('new_text')} AS new_blob, status FROM changes", BASE_HEAD
    ),
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.snapshot_diff(*_base_head(spark, sf_dir))


@query(
    "snapshot_diff_by_folders",
    with_views(
        f"SELECT repo_url, path, {blob_sql('old_text')} AS old_blob, {blob_sql('new_text')} AS new_blob, status FROM changes", BASE_HEAD
    ),
)
def snapshot_diff_by_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = [snapshots.with_blob_id(tree).select("repo_url", "path", "blob_id") for tree in _base_head(spark, sf_dir)]
    folders = [kept(snapshots.folder_digests(tree), "folders") for tree in trees]
    return snapshots.snapshot_diff_by_folders(*trees, *folders)


@query("blob_id", with_views(f"SELECT repo_url, path, {blob_sql('text')} AS blob_id FROM repo_files"))
def blob_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.with_blob_id(with_content(load(spark, sf_dir, "repo_files"))).select("repo_url", "path", "blob_id")


@query(
    "diff_stats",
    with_views(
        "SELECT repo_url, count(*) AS files_changed, CAST(sum(coalesce(insertions, 0)) AS BIGINT) AS insertions, "
        "CAST(sum(coalesce(deletions, 0)) AS BIGINT) AS deletions FROM changes LEFT JOIN change_stats USING (repo_url, path) GROUP BY repo_url",
        BASE_HEAD,
    ),
)
def diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.diff_stats(*_base_head(spark, sf_dir))


def patch_title_sql() -> str:
    """Everything of a patch before its first hunk."""
    return (
        "'diff --git a/' || path || ' b/' || path || chr(10) || CASE status "
        f"WHEN 'added' THEN 'new file mode 100644' || chr(10) || 'index 0000000..' || left({blob_sql('new_text')}, 7) || chr(10) || '--- /dev/null' "
        f"|| chr(10) || '+++ b/' || path WHEN 'deleted' THEN 'deleted file mode 100644' || chr(10) || 'index ' || left({blob_sql('old_text')}, 7) "
        "|| '..0000000' || chr(10) || '--- a/' || path || chr(10) || '+++ /dev/null' "
        f"ELSE 'index ' || left({blob_sql('old_text')}, 7) || '..' || left({blob_sql('new_text')}, 7) || ' 100644' || chr(10) || '--- a/' || path "
        "|| chr(10) || '+++ b/' || path END || chr(10)"
    )


def hunk_sql() -> str:
    """The hunk of a change of the inputs: whole files, or one or two first lines put in or left out.

    One line slides past the lines after it that equal it. The longer side holds all lines shown.
    """
    old, new = LINE_LIST.format("old_text"), LINE_LIST.format("new_text")
    long = f"CASE WHEN len({old}) > len({new}) THEN {old} ELSE {new} END"
    shown = "list_transform({0}, lambda x: {1} || x || CASE WHEN ends_with(x, chr(10)) THEN '' ELSE chr(10) || '\\ No newline at end of file' || chr(10) END)"
    whole = "'{0}' || CASE WHEN len({1}) = 1 THEN '1' ELSE '1,' || len({1}) END || '{2} @@' || chr(10) || array_to_string({3}, '')"

    def span(start: str, count: str) -> str:
        return f"(CASE WHEN {count} = 0 THEN {start} - 1 ELSE {start} END) || CASE WHEN {count} = 1 THEN '' ELSE ',' || {count} END"

    changed = "(CASE WHEN gone THEN '-' ELSE '+' END)"
    first, after = "(at_line - least(3, at_line - 1))", "least(3, len(lines) - at_line - size + 1)"
    kept = f"(least(3, at_line - 1) + {after})"
    hunk = (
        f"'@@ -' || {span(first, f'({kept} + CASE WHEN gone THEN size ELSE 0 END)')} || ' +' || {span(first, f'({kept} + CASE WHEN gone THEN 0 ELSE size END)')} "
        f"|| ' @@' || chr(10) || array_to_string({shown.format(f'list_slice(lines, {first}, at_line - 1)', repr(' '))}, '') "
        f"|| array_to_string({shown.format('list_slice(lines, at_line, at_line + size - 1)', changed)}, '') "
        f"|| array_to_string({shown.format(f'list_slice(lines, at_line + size, at_line + size + {after} - 1)', repr(' '))}, '')"
    )
    slide = "CASE WHEN abs(len({0}) - len({1})) = 1 THEN coalesce(list_position(list_transform({2}, lambda x: x = ({2})[1]), false), len({2}) + 1) - 1 ELSE 1 END"
    modified = (
        f"(SELECT {hunk} FROM (SELECT {long} AS lines, len({old}) > len({new}) AS gone, abs(len({old}) - len({new})) AS size, "
        f"{slide.format(old, new, long)} AS at_line) h)"
    )
    return (
        f"CASE status WHEN 'added' THEN {whole.format('@@ -0,0 +', new, '', shown.format(new, repr('+')))} "
        f"WHEN 'deleted' THEN {whole.format('@@ -', old, ' +0,0', shown.format(old, repr('-')))} ELSE {modified} END"
    )


@query("unified_patch", with_views(f"SELECT repo_url, path, status, {patch_title_sql()} || {hunk_sql()} AS patch FROM changes", BASE_HEAD))
def unified_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.unified_patch(*_base_head(spark, sf_dir)).select("repo_url", "path", "status", "patch")


@query(
    "unified_patch_lines",
    with_views(
        f"SELECT repo_url, path, {patch_title_sql()} AS title, insertions AS plus_lines, deletions AS minus_lines "
        "FROM changes JOIN change_stats USING (repo_url, path)",
        BASE_HEAD,
    ),
)
def unified_patch_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patch headers, and the marked lines counted in the patch text."""
    patches = snapshots.unified_patch(*_base_head(spark, sf_dir), context=0)
    title = F.substring_index("patch", "@@ -", 1)
    body = F.substring("patch", F.length("title") + 1, F.length("patch"))
    lines = F.split("body", "\n")
    counted = lambda mark: F.size(F.filter(lines, lambda x: x.startswith(mark))).cast("bigint")
    return patches.withColumn("title", title).withColumn("body", body).select(
        "repo_url", "path", "title", counted("+").alias("plus_lines"), counted("-").alias("minus_lines")
    )


@query(
    "resolve_short_sha",
    with_views(
        "SELECT n.repo_url, n.name, min(c.sha) AS sha FROM ref_names n JOIN commits c ON n.repo_url = c.repo_url AND starts_with(c.sha, n.name) "
        "WHERE length(n.name) BETWEEN 7 AND 40 AND regexp_full_match(n.name, '[0-9a-f]+') GROUP BY n.repo_url, n.name HAVING count(*) = 1"
    ),
)
def resolve_short_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.resolve_short_sha(*load(spark, sf_dir, "ref_names", "commits"))


@query(
    "resolve_refs",
    with_views(
        """
SELECT n.repo_url, n.name, arg_min(sha, pos) AS sha, arg_min(found_as, pos) AS found_as FROM (SELECT DISTINCT * FROM ref_names) n LEFT JOIN (
  SELECT n.repo_url, n.name, p.pos, r.ref_name AS found_as, r.target_sha AS sha FROM ref_names n
  JOIN places p ON TRUE JOIN refs r ON r.repo_url = n.repo_url AND r.ref_name = p.place || n.name
  UNION ALL
  SELECT n.repo_url, n.name, 6, 'commit', min(c.sha) FROM ref_names n JOIN commits c ON n.repo_url = c.repo_url AND starts_with(c.sha, n.name)
  WHERE length(n.name) >= 7 AND regexp_full_match(n.name, '[0-9a-f]+') GROUP BY n.repo_url, n.name HAVING count(*) = 1
) m ON m.repo_url = n.repo_url AND m.name = n.name GROUP BY n.repo_url, n.name""",
        {
            "places": "SELECT * FROM (VALUES (1, ''), (2, 'refs/'), (3, 'refs/tags/'), (4, 'refs/heads/'), (5, 'refs/remotes/'), "
            "(7, 'refs/remotes/origin/')) v(pos, place)"
        },
    ),
)
def resolve_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.resolve_refs(*load(spark, sf_dir, "ref_names", "refs", "commits"))


@query(
    "branch_head",
    with_views(
        """
SELECT w.repo_url, w.branch, coalesce(b.target_sha, e.target_sha, h.target_sha) AS head_sha FROM wanted w
LEFT JOIN refs b ON b.repo_url = w.repo_url AND b.ref_name = 'refs/heads/' || w.branch
LEFT JOIN refs e ON e.repo_url = w.repo_url AND e.ref_name = w.branch
LEFT JOIN refs h ON h.repo_url = w.repo_url AND h.ref_name = 'HEAD'""",
        {"wanted": "SELECT DISTINCT repo_url, branch FROM wanted_branches"},
    ),
)
def branch_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted, refs = load(spark, sf_dir, "wanted_branches", "refs")
    return history.branch_heads(wanted, refs)


def merge_base_views(pairs: str) -> dict[str, str]:
    """View `bases` (repo_url, base_sha, head_sha, merge_base) of the pairs of a view."""
    return {
        "starts": f"SELECT repo_url, base_sha AS start_sha FROM {pairs} UNION SELECT repo_url, head_sha FROM {pairs}",
        "reach": "SELECT repo_url, sha AS start_sha, sha FROM commits UNION SELECT a.repo_url, a.start_sha, p.parent_sha FROM reach a "
        "JOIN commit_parents p ON p.repo_url = a.repo_url AND p.sha = a.sha",
        "common": f"SELECT DISTINCT p.repo_url, p.base_sha, p.head_sha, x.sha FROM {pairs} p "
        "JOIN reach x ON x.repo_url = p.repo_url AND x.start_sha = p.base_sha "
        "JOIN reach y ON y.repo_url = p.repo_url AND y.start_sha = p.head_sha AND y.sha = x.sha",
        "best": "SELECT c.* FROM common c WHERE NOT EXISTS (SELECT 1 FROM common d JOIN reach z ON z.repo_url = d.repo_url AND z.start_sha = d.sha "
        "WHERE d.repo_url = c.repo_url AND d.base_sha = c.base_sha AND d.head_sha = c.head_sha AND d.sha <> c.sha AND z.sha = c.sha)",
        "bases": "SELECT b.repo_url, base_sha, head_sha, (max({'t': committed_at, 's': b.sha})).s AS merge_base FROM best b "
        "JOIN commits c ON c.repo_url = b.repo_url AND c.sha = b.sha GROUP BY b.repo_url, base_sha, head_sha",
    }


@query(
    "merge_base",
    with_views(
        "SELECT DISTINCT p.repo_url, p.base_sha, p.head_sha, merge_base FROM compare_pairs p LEFT JOIN bases b "
        "ON b.repo_url = p.repo_url AND b.base_sha = p.base_sha AND b.head_sha = p.head_sha",
        merge_base_views("compare_pairs"),
        recursive=True,
    ),
)
def merge_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.merge_bases(*load(spark, sf_dir, "compare_pairs", "commits", "commit_parents"))


def base_views(heads: str) -> dict[str, str]:
    """View `based` (repo_url, head_sha, base_branch, base_sha, error) of the heads of a view."""
    return {
        "branches": "SELECT repo_url, arg_min(name, pos) AS base_branch, arg_min(target_sha, pos) AS base_sha FROM refs "
        "JOIN (VALUES (1, 'main'), (2, 'master'), (3, 'develop')) v(pos, name) ON ref_name = 'refs/remotes/origin/' || name GROUP BY repo_url",
        "asked": f"SELECT h.repo_url, h.head_sha, base_branch, base_sha FROM (SELECT DISTINCT repo_url, head_sha FROM {heads} "
        "WHERE head_sha IS NOT NULL) h LEFT JOIN branches b ON b.repo_url = h.repo_url",
        **merge_base_views("asked"),
        "based": "SELECT a.repo_url, a.head_sha, base_branch, coalesce(merge_base, a.base_sha) AS base_sha, CASE WHEN base_branch IS NULL THEN "
        "'Could not find any base branch (main/master/develop)' END AS error FROM asked a LEFT JOIN bases b ON b.repo_url = a.repo_url "
        "AND b.base_sha = a.base_sha AND b.head_sha = a.head_sha",
    }


PULL_HEADS = {"heads": "SELECT repo_url, target_sha AS head_sha FROM refs WHERE starts_with(ref_name, 'refs/pull/')"}


@query("base_commit", with_views("SELECT * FROM based", {**PULL_HEADS, **base_views("heads")}, recursive=True))
def base_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, commits, parents = load(spark, sf_dir, "refs", "commits", "commit_parents")
    heads = refs.where(F.col("ref_name").startswith("refs/pull/")).select("repo_url", F.col("target_sha").alias("head_sha"))
    return history.base_commits(heads, refs, commits, parents)


def report_sql(pairs: str, keys: list[str], title: str, before: dict[str, str], recursive: bool = False, failed: str = "") -> str:
    """Report rows of the pairs of a view, with whole patches."""
    pair = ["repo_url", "base_sha", "head_sha"]
    views = {
        **before,
        "wanted": f"SELECT DISTINCT repo_url, coalesce(base_sha, '') AS base_sha, head_sha FROM {pairs}",
        "old_trees": "SELECT w.*, path, text FROM wanted w JOIN trees t ON t.repo_url = w.repo_url AND t.commit_sha = w.base_sha",
        "new_trees": "SELECT w.*, path, text FROM wanted w JOIN trees t ON t.repo_url = w.repo_url AND t.commit_sha = w.head_sha",
        **change_views("old_trees", "new_trees", pair),
        "sums": "SELECT repo_url, base_sha, head_sha, count(*) AS n, CAST(sum(coalesce(insertions, 0)) AS BIGINT) AS ins, "
        "CAST(sum(coalesce(deletions, 0)) AS BIGINT) AS del FROM changes LEFT JOIN change_stats USING (repo_url, base_sha, head_sha, path) GROUP BY ALL",
    }
    on = "s.repo_url = p.repo_url AND s.base_sha = coalesce(p.base_sha, '') AND s.head_sha = p.head_sha"
    own = ", ".join(f"p.{k}" for k in keys)
    counts = (
        "'Files changed: ' || coalesce(n, 0) || chr(10) || 'Insertions: ' || coalesce(ins, 0) || chr(10) || 'Deletions: ' || coalesce(del, 0) "
        "|| chr(10) || chr(10)"
    )
    sql = (
        f"SELECT {own}, 0 AS section, '' AS path, {title} || {counts} AS text FROM {pairs} p LEFT JOIN sums s ON {on} "
        f"UNION ALL SELECT {own}, 1, s.path, {patch_title_sql()} || {hunk_sql()} FROM {pairs} p JOIN (SELECT *, path AS _p FROM changes) s ON {on} {failed}"
    )
    return with_views(sql, views, recursive)


COMPARE_SQL = report_sql(
    "resolved_pairs", ["repo_url", "base", "head"], "'# Comparing ' || base || ' to ' || head || chr(10) || chr(10)",
    {"resolved_pairs": "SELECT * FROM named_pairs WHERE base_sha IS NOT NULL AND head_sha IS NOT NULL"},
    failed="UNION ALL SELECT repo_url, base, head, -1, '', 'Failed to resolve reference: ' || CASE WHEN base_sha IS NULL THEN base ELSE head END "
    "FROM named_pairs WHERE base_sha IS NULL OR head_sha IS NULL",
)


@query("compare_report", COMPARE_SQL)
def compare_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, trees = load(spark, sf_dir, "named_pairs", "trees")
    return history.compare_report(pairs, with_content(trees))


@query("compare_report_stored", COMPARE_SQL)
def compare_report_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from trees of blob ids and a table of contents by blob id."""
    pairs, trees = load(spark, sf_dir, "named_pairs", "trees")
    files = snapshots.with_blob_id(with_content(trees))
    folder = new_folder(spark, "contents")
    contents = snapshots.write_contents(files, pathlib.PurePosixPath(folder).name.replace("-", "_"), folder)
    return history.compare_report(pairs, kept(files.drop("content"), "trees"), contents=contents)


@query(
    "commit_report",
    report_sql(
        "commit_pairs", ["repo_url", "sha"],
        "'# Commit ' || sha || chr(10) || chr(10) || 'Message: ' || summary || chr(10) || 'Author: ' || author || chr(10) || chr(10)",
        {
            "commit_pairs": "SELECT c.repo_url, c.sha, c.sha AS head_sha, summary, author, parent_sha AS base_sha FROM commits c "
            "LEFT JOIN (SELECT * FROM commit_parents WHERE parent_ord = 0) f ON f.repo_url = c.repo_url AND f.sha = c.sha"
        },
        failed="UNION ALL SELECT repo_url, name, -1, '', 'Failed to find commit: ' || name FROM asked_shas WHERE starts_with(name, 'zz')",
    ),
)
def commit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, commits, parents, trees = load(spark, sf_dir, "asked_shas", "commits", "commit_parents", "trees")
    asked = asked.withColumnRenamed("name", "sha")
    return history.commit_report(asked, commits, parents, with_content(trees))


def request_report_sql(place: str, name: str, short: str, tag: str, step: int) -> str:
    numbered = f"SELECT repo_url, k AS number FROM commits WHERE k % {step} = 0"
    return report_sql(
        "good", ["repo_url", "number"],
        f"'# {name} {short}' || number || chr(10) || chr(10) || 'Base: ' || base_branch || ' (' || p.base_sha || ')' || chr(10) || 'Head: {tag} {short}' "
        "|| number || ' (' || p.head_sha || ')' || chr(10) || chr(10)",
        {
            "numbers": numbered,
            "heads": f"SELECT n.repo_url, number, target_sha AS head_sha FROM numbers n LEFT JOIN refs r ON r.repo_url = n.repo_url "
            f"AND r.ref_name = 'refs/{place}/' || number || '/head'",
            **base_views("heads"),
            "joined": "SELECT h.repo_url, number, h.head_sha, base_branch, base_sha, error FROM heads h LEFT JOIN based b "
            "ON b.repo_url = h.repo_url AND b.head_sha = h.head_sha",
            "good": "SELECT * FROM joined WHERE base_sha IS NOT NULL",
        },
        recursive=True,
        failed=f"UNION ALL SELECT repo_url, number, -1, '', coalesce(error, 'Failed to find {tag} ref after fetch') FROM joined WHERE base_sha IS NULL",
    )


@query("pull_request_report", request_report_sql("pull", "Pull Request", "#", "PR", 3))
def pull_request_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, commits, parents, trees = load(spark, sf_dir, "refs", "commits", "commit_parents", "trees")
    numbers = commits.where("k % 3 = 0").select("repo_url", F.col("k").alias("number"))
    return history.pull_request_report(numbers, refs, commits, parents, with_content(trees))


@query("merge_request_report", request_report_sql("merge-requests", "Merge Request", "!", "MR", 2))
def merge_request_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, commits, parents, trees = load(spark, sf_dir, "refs", "commits", "commit_parents", "trees")
    numbers = commits.where("k % 2 = 0").select("repo_url", F.col("k").alias("number"))
    return history.merge_request_report(numbers, refs, commits, parents, with_content(trees))
