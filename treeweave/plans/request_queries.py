"""Queries over request logs, the snapshot catalogue and usage figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from treeweave.functions.urls import PATH_ROOTS, REMOTE_PREFIXES
from treeweave.operators import catalog, requests as req, usage
from treeweave.plans.file_queries import LIST_SQL
from treeweave.plans.registry import query
from treeweave.plans.views import NOW, load, with_views

# Classification in steps: cleaned text, host parts, fields.
ROOTS = ", ".join(f"'{r}'" for r in PATH_ROOTS)
PARSED = {
    "cleaned": "SELECT *, rtrim(trim(source), '/') AS u FROM requests",
    "split_up": """
SELECT *, CASE WHEN contains(u, 'gist.github.com') THEN 'gist' WHEN contains(u, 'raw.githubusercontent.com') THEN 'raw'
    WHEN regexp_matches(u, '^(https?://)?github\\.com/') THEN 'hub' WHEN regexp_matches(u, '^(https?://)?gitlab\\.com/') THEN 'lab' END AS host,
  string_split(regexp_replace(u, '^(https?://)?(gist\\.github|raw\\.githubusercontent|github|gitlab)\\.com/', ''), '/') AS p FROM cleaned""",
    "marked": f"""
SELECT *, list_position(p, '-') AS mark,
  list_position(list_transform(p[4:], lambda x: (contains(x, '.') AND NOT ends_with(x, '.git')) OR x IN ({ROOTS})), true) AS cut FROM split_up""",
    "kinds": """
SELECT *, CASE
  WHEN host = 'gist' THEN 'Gist'
  WHEN host = 'raw' AND len(p) >= 3 THEN 'Raw'
  WHEN host = 'hub' AND len(p) = 2 THEN 'Repository'
  WHEN host = 'hub' AND len(p) >= 4 THEN CASE p[3] WHEN 'tree' THEN 'Tree' WHEN 'blob' THEN 'Blob' WHEN 'commit' THEN 'Commit' WHEN 'compare' THEN 'Compare' END
  WHEN host = 'lab' AND len(p) >= 2 AND coalesce(mark, 0) = 0 THEN 'GitLabRepository'
  WHEN host = 'lab' AND mark > 1 AND p[mark + 1] = 'tree' AND len(p) >= mark + 2 THEN 'GitLabTree'
  WHEN host = 'lab' AND mark > 1 AND p[mark + 1] = 'blob' AND len(p) >= mark + 3 THEN 'GitLabBlob'
  WHEN host = 'lab' AND mark > 1 AND p[mark + 1] = 'merge_requests' AND len(p) >= mark + 2 THEN 'GitLabMergeRequest' END AS url_type FROM marked""",
    "fields": """
SELECT request_id, ts_sec, source, preset, branch, path, url_type,
  CASE WHEN url_type IS NULL THEN NULL WHEN url_type = 'Gist' AND len(p) = 1 THEN 'anonymous' ELSE p[1] END AS owner,
  CASE WHEN url_type IS NULL THEN NULL WHEN url_type = 'Gist' THEN CASE WHEN len(p) = 1 THEN p[1] ELSE p[2] END
    WHEN url_type = 'GitLabRepository' THEN p[len(p)] WHEN starts_with(url_type, 'GitLab') THEN p[mark - 1] ELSE p[2] END AS repo,
  CASE WHEN url_type = 'Raw' THEN p[3] WHEN url_type = 'Commit' THEN p[4] WHEN url_type = 'Compare' THEN array_to_string(p[4:], '/')
    WHEN url_type IN ('Tree', 'Blob') THEN array_to_string(CASE WHEN coalesce(cut, 0) > 0 THEN p[4:3 + cut - 1] ELSE p[4:] END, '/')
    WHEN url_type IN ('GitLabTree', 'GitLabBlob', 'GitLabMergeRequest') THEN p[mark + 2] END AS parsed_branch,
  CASE WHEN url_type = 'Raw' AND len(p) > 3 THEN array_to_string(p[4:], '/')
    WHEN url_type IN ('Tree', 'Blob') AND coalesce(cut, 0) > 0 THEN array_to_string(p[3 + cut:], '/')
    WHEN url_type IN ('GitLabTree', 'GitLabBlob') AND len(p) > mark + 2 THEN array_to_string(p[mark + 3:], '/') END AS parsed_path,
  CASE WHEN url_type IS NULL THEN NULL WHEN url_type = 'Gist' THEN 'https://gist.github.com/' || array_to_string(p[1:2], '/')
    WHEN url_type = 'GitLabRepository' THEN 'https://gitlab.com/' || array_to_string(p, '/')
    WHEN starts_with(url_type, 'GitLab') THEN 'https://gitlab.com/' || array_to_string(p[1:mark - 1], '/')
    ELSE 'https://github.com/' || p[1] || '/' || p[2] END AS canonical_url FROM kinds""",
}
GOOD_NAME = "(length({0}) BETWEEN 1 AND 39 AND regexp_full_match({0}, '[a-zA-Z0-9_.-]+') AND NOT regexp_matches({0}, '^[-.]|[-.]$'))"
SHORT = (
    "CASE WHEN NOT contains(source, '://') AND len(string_split(source, '/')) = 2 AND "
    + GOOD_NAME.format("split_part(source, '/', 1)") + " AND " + GOOD_NAME.format("split_part(source, '/', 2)")
    + " THEN 'https://github.com/' || source END"
)
NORMAL = {
    **PARSED,
    "normal": f"SELECT request_id, ts_sec, preset, coalesce(canonical_url, {SHORT}, source) AS url, coalesce(branch, parsed_branch) AS branch, "
    "coalesce(path, parsed_path) AS path, parsed_branch, parsed_path FROM fields",
}


@query(
    "classify_sources",
    with_views(
        "SELECT request_id, url_type, owner, repo, parsed_branch AS branch, parsed_path AS path, canonical_url FROM fields", PARSED
    ),
)
def classify_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return req.classify_sources(load(spark, sf_dir, "requests")).select("request_id", "parsed.*")


def _normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = load(spark, sf_dir, "requests").select("request_id", "ts_sec", "source", "preset", "branch", "path")
    return req.normalize_sources(asked)


@query("normalize_sources", with_views("SELECT request_id, url, branch, path FROM normal", NORMAL))
def normalize_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normal(spark, sf_dir).select("request_id", "url", "branch", "path")


@query(
    "validate_requests",
    with_views(
        f"""
SELECT request_id, url, CASE WHEN source = '' THEN 'empty_url'
  WHEN NOT ({' OR '.join(f"starts_with(url, '{p}')" for p in REMOTE_PREFIXES)}) THEN 'invalid_url'
  WHEN NOT ({GOOD_NAME.format("split_part(url, '/', 4)")} AND {GOOD_NAME.format("split_part(url, '/', -1)")}) THEN 'invalid_name'
  WHEN operation = 'commit' AND NOT regexp_full_match(argument, '[0-9a-fA-F]{{7,40}}') THEN 'invalid_sha'
  WHEN operation IN ('pull', 'merge_request') AND NOT (regexp_full_match(argument, '\\+?[0-9]+') AND TRY_CAST(ltrim(argument, '+') AS BIGINT) <= 4294967295)
    THEN 'invalid_number'
  WHEN operation = 'compare' AND NOT regexp_full_match(argument, '[a-z]+\\.\\.\\.?[a-z]+') THEN 'invalid_compare' END AS reason
FROM (SELECT *, CASE WHEN len(string_split(source, '/')) = 2 AND NOT contains(source, '/.') THEN 'https://github.com/' || source
  ELSE source END AS url FROM operations) t"""
    ),
)
def validate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return req.validate_requests(load(spark, sf_dir, "operations")).select("request_id", "url", "reason")


@query(
    "validate_display_names",
    with_views(
        "SELECT request_id, CASE request_id % 8 WHEN 2 THEN 'invalid_name' WHEN 3 THEN 'unsafe' WHEN 5 THEN 'not_a_repository' "
        "WHEN 6 THEN 'unsafe' WHEN 7 THEN 'invalid_name' END AS reason FROM display_names"
    ),
)
def validate_display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return req.validate_requests(load(spark, sf_dir, "display_names"), strict=False).select("request_id", "reason")


@query(
    "parse_compare_specs",
    with_views(
        """
SELECT request_id, spec, CASE WHEN b <> '' AND h <> '' THEN b END AS base, CASE WHEN b <> '' AND h <> '' THEN h END AS head
FROM (SELECT request_id, spec, CASE WHEN contains(spec, '...') THEN left(spec, instr(spec, '...') - 1)
    WHEN contains(spec, '..') THEN left(spec, instr(spec, '..') - 1) ELSE '' END AS b,
  CASE WHEN contains(spec, '...') THEN substr(spec, instr(spec, '...') + 3) WHEN contains(spec, '..') THEN substr(spec, instr(spec, '..') + 2)
    ELSE '' END AS h FROM compare_specs) t"""
    ),
)
def parse_compare_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return req.compare_pairs(load(spark, sf_dir, "compare_specs"))


@query("parse_pattern_lists", with_views(f"SELECT request_id, unnest({LIST_SQL.format('include_csv')}) AS pattern FROM requests"))
def parse_pattern_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return req.pattern_rows(load(spark, sf_dir, "requests"))


@query(
    "safe_path_prefix",
    with_views(
        "SELECT request_id, CASE WHEN NOT contains(coalesce(path, subpath), '..') AND NOT starts_with(coalesce(path, subpath), '/') "
        "THEN coalesce(path, subpath) END AS prefix FROM requests"
    ),
)
def safe_path_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return req.safe_path_prefix(load(spark, sf_dir, "requests")).select("request_id", "prefix")


ROUTES = [
    (0, "repository", "github.com", None, None, None), (1, "pull", "github.com", None, None, "*"),
    (2, "commit", "github.com", None, None, "abc1234"), (3, "compare", "github.com", None, None, "a...b"),
    (4, "branch", "github.com", "main", None, None), (5, "path", "github.com", "main", "src/a.rs", None),
    (6, "branch", "github.com", "main", None, None), (7, "path", "github.com", "main", "x", None),
    (8, "tag", "github.com", "v1", None, None), (9, "branch", "gitlab.com", "main", None, None),
    (10, "path", "gitlab.com", "main", "src/lib", None), (11, "branch", "gitlab.com", "main", None, None),
    (12, "path", "gitlab.com", "main", "a/b", None), (13, "commit", "gitlab.com", None, None, "abc1234"),
    (14, "compare", "gitlab.com", None, None, "a..b"), (15, "merge_request", "gitlab.com", None, None, "12"),
]


def _routes_sql() -> str:
    quoted = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in ROUTES) + ") v(m, operation, host, branch, path, argument)"


@query(
    "route_requests",
    with_views(
        "SELECT request_id, route, operation, host, CASE WHEN operation IS NOT NULL THEN 'o' END AS owner, CASE WHEN operation IS NOT NULL "
        "THEN 'r' END AS repo, branch, path, CASE WHEN argument = '*' THEN split_part(route, '/', 5) ELSE argument END AS argument "
        "FROM route_log LEFT JOIN expected ON request_id % 20 = m",
        {"expected": _routes_sql()},
    ),
)
def route_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return req.route_requests(load(spark, sf_dir, "route_log"))


@query(
    "dispatch_sources",
    with_views(
        f"""
SELECT request_id, CASE WHEN hub OR short OR spec THEN 'github' WHEN ({' OR '.join(f"starts_with(source, '{p}')" for p in REMOTE_PREFIXES)}) THEN 'git_url'
    ELSE 'local' END AS target,
  CASE WHEN hub THEN url_type WHEN short THEN 'Repository' WHEN spec THEN 'Compare' END AS url_type,
  CASE WHEN hub THEN owner WHEN short OR spec THEN split_part(source, '/', 1) END AS owner,
  CASE WHEN hub THEN repo WHEN short OR spec THEN split_part(source, '/', 2) END AS repo,
  CASE WHEN hub THEN parsed_branch WHEN spec THEN array_to_string(string_split(source, '/')[4:], '/') END AS branch,
  CASE WHEN hub THEN parsed_path END AS path
FROM (SELECT *, url_type IS NOT NULL AND NOT starts_with(url_type, 'GitLab') AS hub,
  NOT contains(source, '://') AND len(string_split(source, '/')) = 2 AS short,
  NOT contains(source, '://') AND len(string_split(source, '/')) >= 4 AND split_part(source, '/', 3) = 'compare' AS spec FROM fields) t""",
        {
            "requests": "SELECT event_id AS request_id, 0 AS ts_sec, CASE event_id % 4 WHEN 0 THEN 'me/proj/compare/v' || user_id || '...main/x' "
            "WHEN 1 THEN 'https://github.com/org/repo/blob/dev/src/a.rs' WHEN 2 THEN './local' ELSE 'https://gitlab.com/a/b' END AS source, "
            "NULL AS preset, NULL AS branch, NULL AS path FROM events",
            **PARSED,
        },
    ),
)
def dispatch_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 4
    source = (
        F.when(kind == 0, F.concat(F.lit("me/proj/compare/v"), F.col("user_id").cast("string"), F.lit("...main/x")))
        .when(kind == 1, "https://github.com/org/repo/blob/dev/src/a.rs")
        .when(kind == 2, "./local")
        .otherwise("https://gitlab.com/a/b")
    )
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return req.dispatch_sources(events.select(F.col("event_id").alias("request_id"), source.alias("source"))).drop("source")


KEY_SQL = "sha256(concat_ws(':', url, branch, preset, path))"


@query("request_key", with_views(f"SELECT request_id, {KEY_SQL} AS request_key FROM normal", NORMAL))
def request_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return req.with_request_key(_normal(spark, sf_dir)).select("request_id", "request_key")


@query(
    "diff_key",
    with_views(
        "SELECT request_id, sha256(kind || ':' || owner || '/' || repo || ':' || identifier || coalesce(':ctx' || context, '')) AS diff_key FROM diff_requests"
    ),
)
def diff_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return req.with_diff_key(load(spark, sf_dir, "diff_requests")).select("request_id", "diff_key")


FIRST_ITEM = "min({'t': ts_sec, 'r': request_id, 'url': url, 'branch': branch, 'preset': preset, 'path': path})"


@query(
    "work_list",
    with_views(
        "SELECT request_key, requests, first_seen, item.url AS url, item.branch AS branch, item.preset AS preset, item.path AS path FROM "
        f"(SELECT {KEY_SQL} AS request_key, count(*) AS requests, min(ts_sec) AS first_seen, {FIRST_ITEM} AS item FROM normal GROUP BY 1) t",
        NORMAL,
    ),
)
def work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return req.work_list(_normal(spark, sf_dir))


@query(
    "commit_status",
    with_views(
        "SELECT h.cache_key, h.head_sha, CASE WHEN c.cache_key IS NULL THEN 'NotCached' WHEN c.commit_hash = h.head_sha THEN 'Match' "
        "ELSE 'Outdated' END AS status FROM current_heads h LEFT JOIN catalog c ON c.cache_key = h.cache_key"
    ),
)
def commit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.commit_status(*load(spark, sf_dir, "catalog", "current_heads"))


@query(
    "refresh_plan",
    with_views(
        "SELECT cache_key, head_sha FROM current_heads h WHERE NOT EXISTS (SELECT 1 FROM catalog c WHERE c.cache_key = h.cache_key "
        "AND c.commit_hash = h.head_sha)"
    ),
)
def refresh_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.refresh_plan(*load(spark, sf_dir, "catalog", "current_heads"))


STATE = (
    f"CASE WHEN c.cache_key IS NULL THEN 'Miss' WHEN {NOW} - c.created_at > 604800 THEN 'Expired' "
    f"WHEN {NOW} - c.last_validated < 300 THEN 'Fresh' ELSE 'Valid' END"
)


@query(
    "freshness",
    with_views(
        f"SELECT a.request_id, a.cache_key, {STATE} AS freshness FROM access_log a LEFT JOIN catalog c ON c.cache_key = a.cache_key"
    ),
)
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, asked = load(spark, sf_dir, "catalog", "access_log")
    return catalog.freshness(stored, asked.drop("ts_sec"), NOW)


@query(
    "serve_decision",
    with_views(
        f"""
SELECT request_id, cache_key, decision, CASE WHEN decision = 'revalidate' THEN CAST({NOW} AS BIGINT) END AS last_validated FROM (
SELECT a.request_id, a.cache_key, CASE WHEN {STATE} = 'Fresh' THEN 'serve' WHEN {STATE} = 'Valid' AND h.head_sha = c.commit_hash THEN 'revalidate'
  WHEN {STATE} = 'Valid' AND h.head_sha IS NOT NULL THEN 'invalidate' ELSE 'refetch' END AS decision
FROM access_log a LEFT JOIN catalog c ON c.cache_key = a.cache_key LEFT JOIN current_heads h ON h.cache_key = a.cache_key) t"""
    ),
)
def serve_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, stored, heads = load(spark, sf_dir, "access_log", "catalog", "current_heads")
    return catalog.serve_decision(asked.drop("ts_sec"), stored, heads, NOW)


@query("expired_entries", with_views(f"SELECT cache_key, created_at FROM catalog WHERE {NOW} - created_at > 604800"))
def expired_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.expired_entries(load(spark, sf_dir, "catalog"), NOW).select("cache_key", "created_at")


CAPACITY, INCOMING = 30_000_000, 5_000_000


@query(
    "lru_eviction_plan",
    with_views(
        f"""
SELECT cache_key, size_bytes, last_accessed, freed FROM (
  SELECT cache_key, size_bytes, last_accessed, CAST(sum(size_bytes) OVER () AS BIGINT) AS total,
    CAST(sum(size_bytes) OVER (ORDER BY last_accessed, cache_key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS freed FROM catalog) t
WHERE total - (freed - size_bytes) + {INCOMING} > {CAPACITY}"""
    ),
)
def lru_eviction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.lru_eviction_plan(load(spark, sf_dir, "catalog"), CAPACITY, INCOMING)


@query(
    "lfu_eviction_plan",
    with_views(
        "SELECT cache_key, access_count, place FROM (SELECT cache_key, access_count, row_number() OVER (ORDER BY access_count, cache_key) AS place, "
        "count(*) OVER () AS total FROM diff_catalog) t WHERE place <= total - 60 + 1"
    ),
)
def lfu_eviction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.lfu_eviction_plan(load(spark, sf_dir, "diff_catalog"), 60)


@query(
    "catalog_stats",
    with_views(
        f"SELECT count(*) AS total_entries, CAST(sum(size_bytes) AS BIGINT) AS total_size, CAST({CAPACITY} AS BIGINT) AS max_size, "
        f"count(*) FILTER ({NOW} - created_at > 604800) AS expired_entries FROM catalog"
    ),
)
def catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.catalog_stats(load(spark, sf_dir, "catalog"), NOW, CAPACITY)


@query(
    "hit_rate", with_views("SELECT sum(greatest(access_count - 1, 0))::DOUBLE / sum(access_count)::DOUBLE AS hit_rate FROM catalog")
)
def hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.hit_rate(load(spark, sf_dir, "catalog"))


@query("top_accessed", with_views("SELECT url, access_count FROM catalog ORDER BY access_count DESC, url LIMIT 10"))
def top_accessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.top_accessed(load(spark, sf_dir, "catalog"))


@query(
    "diff_catalog_stats",
    with_views(
        "SELECT count(*) AS entries, CAST(10000 AS BIGINT) AS max_entries, CAST(sum(content_bytes) AS BIGINT) AS total_size FROM diff_catalog"
    ),
)
def diff_catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.diff_catalog_stats(load(spark, sf_dir, "diff_catalog"), 10_000)


@query(
    "upsert_entries",
    with_views(
        """
SELECT n.cache_key, url, branch, commit_hash, size_bytes, created_at, last_validated, greatest(last_accessed, coalesce(last_ts, last_accessed)) AS last_accessed,
  access_count + coalesce(uses, 0) AS access_count
FROM (SELECT * FROM catalog c WHERE cache_key NOT IN (SELECT cache_key FROM catalog_new) UNION ALL SELECT * FROM catalog_new) n
LEFT JOIN (SELECT cache_key, count(*) AS uses, max(ts_sec) AS last_ts FROM access_log GROUP BY cache_key) a ON a.cache_key = n.cache_key"""
    ),
)
def upsert_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.upsert_entries(*load(spark, sf_dir, "catalog", "catalog_new", "access_log"))


@query("purge_entries", with_views("SELECT * FROM catalog WHERE cache_key NOT IN (SELECT cache_key FROM purge_keys)"))
def purge_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.purge_entries(*load(spark, sf_dir, "catalog", "purge_keys"))


INGESTED = "NOT cache_hit AND NOT is_error"


@query(
    "usage_totals",
    with_views(
        f"""
SELECT count(*) AS total_requests, count(*) FILTER ({INGESTED}) AS total_ingestions, count(*) FILTER (cache_hit) AS cache_hits,
  count(*) FILTER (NOT cache_hit) AS cache_misses, CAST(sum(bytes_out) FILTER ({INGESTED}) AS BIGINT) AS total_bytes_processed,
  CAST(sum(files_out) FILTER ({INGESTED}) AS BIGINT) AS total_files_processed, count(*) FILTER (is_error) AS errors FROM usage_log"""
    ),
)
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.usage_totals(load(spark, sf_dir, "usage_log"))


REPO_USAGE = f"""
SELECT url, count(*) AS request_count, max(ts_sec) AS last_accessed, (max({{'t': ts_sec, 'r': request_id, 'b': bytes_out}})).b AS size_bytes,
  (max({{'t': ts_sec, 'r': request_id, 'f': files_out}})).f AS file_count FROM usage_log WHERE {INGESTED} GROUP BY url"""
TOP = " ORDER BY request_count DESC, url LIMIT 10"


@query("repo_usage", with_views(REPO_USAGE))
def repo_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.repo_usage(load(spark, sf_dir, "usage_log"))


@query("top_repositories", with_views(REPO_USAGE + TOP))
def top_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.top_repositories(load(spark, sf_dir, "usage_log"))


HOURS = (
    f"CAST(floor(ts_sec / 3600) AS BIGINT) AS hour, count(*) FILTER ({INGESTED}) AS requests, count(*) FILTER (cache_hit) AS cache_hits, "
    f"CAST(coalesce(sum(bytes_out) FILTER ({INGESTED}), 0) AS BIGINT) AS bytes"
)


@query("hourly_usage", with_views(f"SELECT {HOURS} FROM usage_log WHERE floor(ts_sec / 3600) > {NOW // 3600 - 24} GROUP BY 1"))
def hourly_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.hourly_usage(load(spark, sf_dir, "usage_log"), NOW)


@query(
    "response_time_average",
    with_views(
        "SELECT CAST(sum(response_ms) // count(*) AS BIGINT) AS average_response_time_ms FROM (SELECT response_ms FROM usage_log "
        "ORDER BY ts_sec DESC, request_id DESC LIMIT 1000) t"
    ),
)
def response_time_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.recent_latency(load(spark, sf_dir, "usage_log"))


@query(
    "response_time_series",
    with_views(
        "SELECT instance, request_id, CAST(sum(response_ms) OVER w // count(*) OVER w AS BIGINT) AS average_response_time_ms FROM usage_log "
        "WINDOW w AS (PARTITION BY instance ORDER BY ts_sec, request_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"
    ),
)
def response_time_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.latency_series(load(spark, sf_dir, "usage_log"), 100)


@query(
    "health_snapshot",
    with_views(
        """
SELECT 'ok' AS status, c.n AS repo_entries, CAST(c.b // 1048576 AS BIGINT) AS size_mb, printf('%.1f', c.r * 100) || '%' AS hit_rate, d.n AS diff_entries,
  CAST(d.b // 1024 AS BIGINT) AS size_kb
FROM (SELECT count(*) AS n, sum(size_bytes) AS b, sum(greatest(access_count - 1, 0))::DOUBLE / sum(access_count)::DOUBLE AS r FROM catalog) c,
  (SELECT count(*) AS n, sum(content_bytes) AS b FROM diff_catalog) d"""
    ),
)
def health_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.health_snapshot(*load(spark, sf_dir, "catalog", "diff_catalog"))
