"""Queries over file tables: sources, filters, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from treeweave.operators import filters, rules
from treeweave.operators.filters import IngestOptions
from treeweave.operators.requests import pattern_list, pattern_rows, safe_path_prefix
from treeweave.plans.registry import glob_sql, include_sql, query, values
from treeweave.plans.views import load, with_views
from treeweave.session import new_folder
from treeweave.sources import files as sources

GLOBS = ["*.rs", "build/*", "bin/*", "f*.md", "docs", "src/core"]
INCLUDES = ["src/", "f1*", "docs/*.md"]
OPTIONS = IngestOptions(preset="standard", exclude=("*.toml", "docs"), include=("src/", "*.ts", "f*"))
RULES = {
    "rules": values(
        [(c, p) for c, ps in rules.CATEGORY_RULES.items() for p in ps]
        + [("code_only_extra", p) for p in rules.CODE_ONLY_EXTRA],
        "category, pattern",
    )
}


def patterns(items) -> dict[str, str]:
    return {"given": values([(p,) for p in items], "pattern")}


def any_of(table: str, test=glob_sql) -> str:
    return f"EXISTS (SELECT 1 FROM {table} g WHERE {test('g.pattern', 'f.path')})"


def with_content(files: DataFrame) -> DataFrame:
    return files.withColumn("content", F.col("text").cast("binary")).drop("text")


@query("scan_worktree", with_views("SELECT source AS repo_url, path, CAST(strlen(text) AS BIGINT) AS size, md5(text) AS digest FROM worktree"))
def scan_worktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files written as a tree, with hidden, underscored and spaced names, and scanned."""
    files = with_content(load(spark, sf_dir, "worktree").withColumnRenamed("source", "repo_url"))
    root = new_folder(spark, "tree")
    sources.write_worktree(files, root)
    return sources.scan_worktree(spark, root).select("repo_url", "path", "size", F.md5("content").alias("digest"))


@query(
    "scan_snapshot",
    with_views(
        "SELECT repo_url, path, size, git_status FROM sized_files "
        "WHERE repo_url IN ('https://github.com/src3/en', 'https://github.com/src7/en', 'https://github.com/src11/fr')"
    ),
)
def scan_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "snapshot")
    sources.write_snapshot(with_content(load(spark, sf_dir, "sized_files")), folder)
    wanted = [f"https://github.com/{r}" for r in ("src3/en", "src7/en", "src11/fr")]
    return sources.scan_snapshot(spark, folder, wanted).select("repo_url", "path", "size", "git_status")


@query(
    "index_files",
    with_views(
        "SELECT repo_url, commit_sha, count(*) AS total_files, CAST(sum(strlen(text)) AS BIGINT) AS total_size, "
        "'2.0.0' AS version FROM trees GROUP BY repo_url, commit_sha"
    ),
)
def index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = with_content(load(spark, sf_dir, "trees")).withColumn("size", F.octet_length("content").cast("bigint"))
    return sources.index_files(trees)[1]


@query("glob_filter", with_views(f"SELECT repo_url, path FROM repo_files f WHERE {any_of('given')}", patterns(GLOBS)))
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.glob_filter(load(spark, sf_dir, "repo_files"), GLOBS).select("repo_url", "path")


@query(
    "exclude_rules",
    with_views(
        f"SELECT repo_url, path FROM repo_files f WHERE NOT {any_of('given')}", patterns(rules.DEFAULT_PATTERNS)
    ),
)
def exclude_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.exclude(load(spark, sf_dir, "repo_files"), rules.DEFAULT_PATTERNS).select("repo_url", "path")


@query(
    "exclude_rules_by_join",
    with_views(
        f"SELECT repo_url, path FROM repo_files f WHERE NOT {any_of('given')}", patterns(rules.DEFAULT_PATTERNS)
    ),
)
def exclude_rules_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with the rules as a table."""
    known = rules.rule_table(spark).where(F.col("category") != "code_only_extra")
    return filters.exclude_by_table(load(spark, sf_dir, "repo_files"), known).select("repo_url", "path")


@query(
    "include_rules",
    with_views(f"SELECT repo_url, path FROM repo_files f WHERE {any_of('given', include_sql)}", patterns(INCLUDES)),
)
def include_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.include(load(spark, sf_dir, "repo_files"), INCLUDES).select("repo_url", "path")


@query(
    "path_prefix_filter",
    with_views(
        "SELECT repo_url, path, git_status FROM repo_files "
        "WHERE starts_with(path, CASE WHEN git_status = 'untracked' THEN 'src' ELSE 'src/' END)"
    ),
)
def path_prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.under_prefix(load(spark, sf_dir, "repo_files"), "src").select("repo_url", "path", "git_status")


@query(
    "git_status_filter",
    with_views(
        "SELECT repo_url, path, git_status FROM repo_files WHERE git_status = 'tracked' OR (git_status = 'untracked' "
        "AND repo_url NOT IN (SELECT repo_url FROM repo_files WHERE doc_id % 7 = 0))"
    ),
)
def git_status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = load(spark, sf_dir, "repo_files")
    born = files.where("doc_id % 7 = 0").select("repo_url")
    return filters.by_status(files, False, born).select("repo_url", "path", "git_status")


@query(
    "git_dir_filter",
    with_views(
        "SELECT repo_url, p AS path FROM (SELECT repo_url, doc_id, CASE doc_id % 4 WHEN 0 THEN '.git/' WHEN 1 THEN 'a/.git/' "
        "WHEN 2 THEN 'a.git/' ELSE '' END || path AS p FROM repo_files) t WHERE NOT list_contains(string_split(p, '/'), '.git')"
    ),
)
def git_dir_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.element_at(F.array(*[F.lit(x) for x in (".git/", "a/.git/", "a.git/", "")]), (F.col("doc_id") % 4 + 1).cast("int"))
    files = load(spark, sf_dir, "repo_files").withColumn("path", F.concat(folder, "path"))
    return filters.drop_git_dir(files).select("repo_url", "path")


@query("max_size_filter", with_views("SELECT repo_url, path, size FROM sized_files WHERE size <= 2000"))
def max_size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.max_size(load(spark, sf_dir, "sized_files"), 2000).select("repo_url", "path", "size")


@query("distinct_paths", with_views("SELECT DISTINCT repo_url, path FROM repo_files"))
def distinct_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = load(spark, sf_dir, "repo_files").select("repo_url", "path", "git_status")
    listed_twice = files.unionByName(files.where(F.col("git_status") == "untracked"))
    return filters.distinct_paths(listed_twice).select("repo_url", "path")


@query(
    "ingestable",
    with_views(
        f"SELECT repo_url, path, size FROM tracked f WHERE NOT {any_of('given')} AND {any_of('wanted', include_sql)}",
        {**patterns(OPTIONS.patterns), "wanted": values([(p,) for p in OPTIONS.include], "pattern")},
    ),
)
def ingestable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.ingestable(load(spark, sf_dir, "sized_files"), OPTIONS).select("repo_url", "path", "size")


def _preset_sql(preset: str) -> str:
    return (
        f"CASE lower({preset}) WHEN 'raw' THEN 'raw' WHEN 'minimal' THEN 'minimal' WHEN 'code-only' THEN 'code-only' "
        "WHEN 'code_only' THEN 'code-only' WHEN 'codeonly' THEN 'code-only' ELSE 'standard' END"
    )


PRESET_RULES = {
    "preset_rules": values([(n, p) for n, ps in rules.PRESET_PATTERNS.items() for p in ps], "preset, pattern")
}
LIST_SQL = "list_filter(list_transform(string_split(coalesce({0}, ''), ','), lambda p: trim(p)), lambda p: p <> '')"


@query(
    "per_request_filter",
    with_views(
        "SELECT request_id, q.repo_url, q.preset, count(size) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes "
        "FROM asked q LEFT JOIN hits h USING (request_id) GROUP BY request_id, q.repo_url, q.preset",
        {
            **PRESET_RULES,
            "asked": f"SELECT request_id, repo_url, CASE WHEN raw THEN 'raw' ELSE {_preset_sql('preset')} END AS preset, {LIST_SQL.format('include_csv')} AS inc, "
            f"{LIST_SQL.format('exclude_csv')} AS exc, branch, coalesce(max_size, 10485760) AS max_size, "
            "CASE WHEN NOT contains(coalesce(path, subpath), '..') AND NOT starts_with(coalesce(path, subpath), '/') "
            "THEN rtrim(coalesce(path, subpath), '/') || '/' ELSE '' END AS prefix FROM ingest_requests",
            "dropped": f"SELECT DISTINCT g.preset, f.doc_id FROM tracked f JOIN preset_rules g ON {glob_sql('g.pattern', 'f.path')}",
            "hits": "SELECT q.request_id, f.size FROM asked q JOIN branch_files f ON q.repo_url = f.repo_url "
            "AND q.branch IS NOT DISTINCT FROM f.branch AND f.git_status = 'tracked' AND f.size <= q.max_size AND starts_with(f.path, q.prefix) "
            "WHERE NOT EXISTS (SELECT 1 FROM dropped d WHERE d.preset = q.preset AND d.doc_id = f.doc_id) "
            f"AND NOT len(list_filter(q.exc, lambda p: {glob_sql('p', 'f.path')})) > 0 "
            f"AND (len(q.inc) = 0 OR len(list_filter(q.inc, lambda p: {include_sql('p', 'f.path')})) > 0)",
        },
    ),
)
def per_request_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, files = load(spark, sf_dir, "ingest_requests", "branch_files")
    asked = safe_path_prefix(asked).withColumnRenamed("prefix", "path_prefix")
    asked = asked.withColumn("include", pattern_list(F.col("include_csv"))).withColumn(
        "exclude", pattern_list(F.col("exclude_csv"))
    )
    return filters.request_totals(files, asked)


@query(
    "preset_filter",
    with_views(
        "SELECT n.preset, f.repo_url, f.path FROM tracked f, names n WHERE NOT EXISTS (SELECT 1 FROM preset_rules g "
        f"WHERE g.preset = n.preset AND {glob_sql('g.pattern', 'f.path')})",
        {**PRESET_RULES, "names": values([(p,) for p in rules.PRESETS], "preset")},
    ),
)
def preset_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.preset_filter(load(spark, sf_dir, "tracked")).select("preset", "repo_url", "path")


@query(
    "category_filter",
    with_views(
        "SELECT repo_url, path FROM tracked f WHERE NOT EXISTS (SELECT 1 FROM rules g "
        f"WHERE g.category IN ('media_files', 'secrets', 'logs', 'nonsense') AND {glob_sql('g.pattern', 'f.path')})",
        RULES,
    ),
)
def category_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["media_files", "secrets", "logs", "nonsense"]
    return rules.category_filter(load(spark, sf_dir, "tracked"), names).select("repo_url", "path")


@query(
    "effective_filter",
    with_views(
        f"SELECT repo_url, path FROM tracked f WHERE NOT {any_of('given')}",
        patterns([*rules.PRESET_PATTERNS["minimal"], "*.toml", "src/core", "*.png"]),
    ),
)
def effective_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = ["*.toml", "src/core", "*.png"]
    return rules.effective_filter(load(spark, sf_dir, "tracked"), user, "minimal").select("repo_url", "path")


@query(
    "custom_default_filter",
    with_views(
        f"SELECT repo_url, path FROM tracked f WHERE NOT {any_of('given')}",
        patterns([*rules.DEFAULT_PATTERNS, "*.ts", "tests/*"]),
    ),
)
def custom_default_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.custom_default_filter(load(spark, sf_dir, "tracked"), ["*.ts", "tests/*"]).select("repo_url", "path")


@query(
    "redundant_patterns",
    with_views(
        "SELECT pattern, count(*) AS uses FROM (SELECT unnest(" + LIST_SQL.format("exclude_csv") + ") AS pattern FROM requests) t "
        "WHERE pattern IN (SELECT pattern FROM given) GROUP BY pattern",
        patterns(rules.DEFAULT_PATTERNS),
    ),
)
def redundant_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.redundant_patterns(pattern_rows(load(spark, sf_dir, "requests"), "exclude_csv"))


@query(
    "exclusion_census",
    with_views(
        "SELECT category, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT DISTINCT g.category, f.doc_id, f.size "
        f"FROM tracked f JOIN rules g ON {glob_sql('g.pattern', 'f.path')} WHERE g.category <> 'code_only_extra') t GROUP BY category",
        RULES,
    ),
)
def exclusion_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.exclusion_census(load(spark, sf_dir, "tracked"))
