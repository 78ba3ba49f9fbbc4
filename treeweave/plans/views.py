"""Input tables of the registered queries, derived from the given tables.

Each text is valid for Spark and for the SQL engine of the checks; `{secs}`, `{bytes}` stand for the function that
gives whole epoch seconds and the byte length.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from treeweave.session import ship_package

NOW = 1706659200
BASE_TABLES = ("documents", "events")

VIEWS = {
    "repo_files": """
SELECT doc_id, 'https://github.com/' || source || '/' || lang AS repo_url,
  CASE doc_id % 13 WHEN 0 THEN '' WHEN 1 THEN 'src/' WHEN 2 THEN 'src/core/' WHEN 3 THEN 'docs/'
    WHEN 4 THEN 'tests/' WHEN 5 THEN 'build/' WHEN 6 THEN 'node_modules/lib/'
    WHEN 7 THEN 'packages/app/node_modules/' WHEN 8 THEN '.github/workflows/'
    WHEN 9 THEN 'bin' WHEN 10 THEN 'src-gen/' WHEN 11 THEN 'licenses/' ELSE 'logs/' END
  || 'f' || CAST(doc_id AS STRING) ||
  CASE doc_id % 11 WHEN 0 THEN '.rs' WHEN 1 THEN '.py' WHEN 2 THEN '.md' WHEN 3 THEN '.json'
    WHEN 4 THEN '.png' WHEN 5 THEN '.lock' WHEN 6 THEN '.txt' WHEN 7 THEN '.env.local'
    WHEN 8 THEN '.toml' WHEN 9 THEN '.ts' ELSE '' END AS path,
  CASE WHEN doc_id % 13 = 11 THEN
    CASE doc_id % 5
      WHEN 0 THEN 'MIT License' || chr(10) || 'Permission is hereby granted, free of charge, to any person' || chr(10) || text
      WHEN 1 THEN 'GNU General Public License' || chr(10) || 'Version 3, 29 June 2007' || chr(10) || text
      WHEN 2 THEN 'Redistribution and use in source and binary forms' || chr(10) || text
      ELSE text END
    ELSE text END AS text,
  CASE WHEN doc_id % 29 = 0 THEN 'ignored' WHEN doc_id % 31 = 0 THEN 'untracked' ELSE 'tracked' END AS git_status
FROM documents""",
    "sized_files": "SELECT *, CAST({bytes}(text) AS BIGINT) AS size FROM repo_files",
    "worktree": """
SELECT f.doc_id, d.source, CASE f.doc_id % 6 WHEN 0 THEN '_x/' WHEN 1 THEN '.cfg/' WHEN 2 THEN 'a b/%41/' WHEN 3 THEN '__pycache__/.d/' ELSE '' END
  || f.path AS path, f.text
FROM repo_files f JOIN documents d ON d.doc_id = f.doc_id""",
    "tracked": "SELECT * FROM sized_files WHERE git_status = 'tracked'",
    "files_base": "SELECT repo_url, path, text FROM repo_files WHERE git_status = 'tracked' AND doc_id % 19 <> 4",
    "files_head": """
SELECT repo_url, path,
  CASE WHEN doc_id % 5 = 2 THEN 'inserted line' || chr(10) || text
       WHEN doc_id % 7 = 1 AND instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1)
       ELSE text END AS text
FROM repo_files WHERE git_status = 'tracked' AND doc_id % 17 <> 3""",
    "history": """
SELECT CAST(floor(doc_id / 16) AS BIGINT) AS r, doc_id % 16 + 1 AS k,
  'https://github.com/hist/r' || CAST(CAST(floor(doc_id / 16) AS BIGINT) AS STRING) AS repo_url, text
FROM documents""",
    "commits": """
SELECT repo_url, r, k, sha1(repo_url || ':' || CAST(k AS STRING)) AS sha,
  'author' || CAST(k % 7 AS STRING) AS author, 'commit ' || CAST(k AS STRING) AS summary,
  1704067200 + k * 60 AS committed_at
FROM history""",
    "commit_parents": """
SELECT repo_url, sha, 0 AS parent_ord, sha1(repo_url || ':' || CAST(CAST(floor(k / 2) AS BIGINT) AS STRING)) AS parent_sha
FROM commits WHERE k > 1
UNION ALL
SELECT repo_url, sha, 1 AS parent_ord, sha1(repo_url || ':' || CAST(k - 1 AS STRING)) AS parent_sha
FROM commits WHERE k > 2 AND k % 5 = 0""",
    "tips": """
SELECT * FROM (
  SELECT *, greatest(max(k) OVER (PARTITION BY repo_url) - r % 4, 1) AS tip FROM commits) t""",
    "refs": """
SELECT repo_url, 'HEAD' AS ref_name, sha AS target_sha, CASE WHEN r % 4 <> 0 THEN 'trunk' ELSE NULL END AS branch FROM tips WHERE k = tip
UNION ALL
SELECT repo_url, 'refs/heads/main' AS ref_name, sha AS target_sha, NULL AS branch FROM tips WHERE k = tip
UNION ALL
SELECT repo_url, 'refs/heads/feature' AS ref_name, sha AS target_sha, NULL AS branch FROM tips WHERE k = 2 AND r % 2 = 1
UNION ALL
SELECT repo_url, 'refs/remotes/origin/main' AS ref_name, sha AS target_sha, NULL AS branch FROM tips WHERE k = tip AND r % 3 <> 0
UNION ALL
SELECT repo_url, 'refs/remotes/origin/develop' AS ref_name, sha AS target_sha, NULL AS branch FROM tips WHERE k = 2 AND r % 2 = 0
UNION ALL
SELECT repo_url, 'refs/tags/v1' AS ref_name, sha AS target_sha, NULL AS branch FROM tips WHERE k = 1
UNION ALL
SELECT repo_url, 'refs/pull/' || CAST(k AS STRING) || '/head' AS ref_name, sha AS target_sha, NULL AS branch FROM tips WHERE k % 6 = 3
UNION ALL
SELECT repo_url, 'refs/merge-requests/' || CAST(k AS STRING) || '/head' AS ref_name, sha AS target_sha, NULL AS branch FROM tips WHERE k % 6 = 4""",
    "trees": """
SELECT c.repo_url, c.sha AS commit_sha,
  CASE d.k % 4 WHEN 0 THEN '' WHEN 1 THEN 'src/' WHEN 2 THEN 'src-gen/' ELSE 'docs/' END
    || 'f' || CAST(d.k AS STRING) || CASE WHEN d.k % 3 = 0 THEN '.md' ELSE '.rs' END AS path,
  CASE WHEN (c.k + d.k) % 3 = 0 THEN 'inserted line' || chr(10) || d.text
       WHEN (c.k + d.k) % 3 = 1 AND instr(d.text, chr(10)) > 0 THEN substr(d.text, instr(d.text, chr(10)) + 1)
       ELSE d.text END AS text
FROM commits c JOIN history d ON c.repo_url = d.repo_url AND d.k <= c.k AND d.k > c.k - 6""",
    "requests": """
SELECT event_id AS request_id, {secs}(ts) AS ts_sec, user_id,
  'instance' || CAST(user_id % 4 AS STRING) AS instance,
  CASE event_id % 13
    WHEN 0 THEN 'org' || CAST(user_id AS STRING) || '/repo'
    WHEN 1 THEN 'https://github.com/org' || CAST(user_id AS STRING) || '/repo/'
    WHEN 2 THEN 'github.com/org' || CAST(user_id AS STRING) || '/repo/tree/main/src/core'
    WHEN 3 THEN 'https://github.com/org' || CAST(user_id AS STRING) || '/repo/blob/feature/x/README.md'
    WHEN 4 THEN 'https://github.com/org' || CAST(user_id AS STRING) || '/repo/commit/abc123f'
    WHEN 5 THEN 'https://github.com/org' || CAST(user_id AS STRING) || '/repo/compare/main...feature/y'
    WHEN 6 THEN 'https://raw.githubusercontent.com/org' || CAST(user_id AS STRING) || '/repo/main/a/b.py'
    WHEN 7 THEN 'https://gist.github.com/' || CAST(user_id AS STRING)
    WHEN 8 THEN 'https://gitlab.com/grp/sub/proj' || CAST(user_id AS STRING)
    WHEN 9 THEN 'https://gitlab.com/grp/sub/proj' || CAST(user_id AS STRING) || '/-/tree/main/lib'
    WHEN 10 THEN 'https://gitlab.com/grp/proj' || CAST(user_id AS STRING) || '/-/merge_requests/12'
    WHEN 11 THEN '-bad/repo'
    ELSE 'https://example.com/x/y' END AS source,
  CASE event_id % 5 WHEN 0 THEN 'raw' WHEN 1 THEN 'standard' WHEN 2 THEN 'code_only' WHEN 3 THEN 'Minimal' ELSE NULL END AS preset,
  CASE WHEN event_id % 4 = 0 THEN 'src/, *.rs ,,docs/*' ELSE NULL END AS include_csv,
  CASE event_id % 3 WHEN 0 THEN '*.lock, target/*,*.tmpl' WHEN 1 THEN ' *.png,mine/* ' ELSE NULL END AS exclude_csv,
  CASE WHEN event_id % 6 = 0 THEN 'dev' ELSE NULL END AS branch,
  CASE event_id % 8 WHEN 0 THEN 'src' WHEN 1 THEN '../etc' WHEN 2 THEN '/abs' ELSE NULL END AS path,
  CASE WHEN event_id % 7 = 3 THEN 'docs/guide' ELSE NULL END AS subpath,
  event_type IN ('view', 'click') AS cache_hit,
  event_type = 'error' AS is_error,
  CAST(floor(value) AS BIGINT) AS response_ms,
  CAST(floor(value * 1000) AS BIGINT) AS bytes_out,
  CAST(event_id % 50 AS BIGINT) AS files_out
FROM events""",
    "usage_log": """
SELECT request_id, ts_sec, instance, 'https://github.com/org' || CAST(user_id AS STRING) || '/repo' AS url,
  cache_hit, is_error, response_ms, bytes_out, files_out FROM requests""",
    "operations": """
SELECT event_id AS request_id,
  CASE WHEN event_id % 9 = 8 THEN '' WHEN event_id % 9 = 7 THEN 'ftp://example.com/a/b'
    WHEN event_id % 9 = 6 THEN 'https://github.com/bad-/repo' WHEN event_id % 9 = 5 THEN 'https://gitlab.com/grp/sub/proj'
    WHEN event_id % 9 = 4 THEN 'own' || CAST(user_id AS STRING) || '/.hidden'
    ELSE 'https://github.com/org' || CAST(user_id AS STRING) || '/repo' END AS source,
  CAST(NULL AS STRING) AS branch, CAST(NULL AS STRING) AS path,
  CASE event_id % 5 WHEN 0 THEN 'commit' WHEN 1 THEN 'pull' WHEN 2 THEN 'merge_request' WHEN 3 THEN 'compare' ELSE 'repository' END AS operation,
  CASE event_id % 5
    WHEN 0 THEN CASE WHEN event_id % 2 = 0 THEN sha1(CAST(event_id AS STRING)) WHEN event_id % 3 = 0 THEN 'abc12' ELSE 'abcdefg' END
    WHEN 1 THEN CASE event_id % 4 WHEN 0 THEN CAST(event_id AS STRING) WHEN 1 THEN '4294967295' WHEN 2 THEN '4294967296' ELSE '12x' END
    WHEN 2 THEN CASE event_id % 3 WHEN 0 THEN '+7' WHEN 1 THEN '-7' ELSE '00000000000012' END
    WHEN 3 THEN CASE event_id % 4 WHEN 0 THEN 'main...dev' WHEN 1 THEN 'main..dev' WHEN 2 THEN '...dev' ELSE 'main' END
    ELSE NULL END AS argument
FROM events""",
    "display_names": """
SELECT event_id AS request_id,
  CASE event_id % 8
    WHEN 0 THEN 'org' || CAST(user_id AS STRING) || '/repo' WHEN 1 THEN '-org/re.po' WHEN 2 THEN 'org/.repo'
    WHEN 3 THEN 'https://github.com/org/repo' WHEN 4 THEN 'github.com/org/repo/tree/main' WHEN 5 THEN 'a/b/c'
    WHEN 6 THEN 'org/../repo' ELSE 'my org/repo' END AS source
FROM events""",
    "compare_specs": """
SELECT event_id AS request_id,
  CASE event_id % 7 WHEN 0 THEN 'main...feature/' || CAST(user_id AS STRING) WHEN 1 THEN 'v1..v2' WHEN 2 THEN '...dev'
    WHEN 3 THEN 'main..' WHEN 4 THEN 'a..b...c' WHEN 5 THEN 'main' ELSE 'x....y' END AS spec
FROM events""",
    "route_log": """
SELECT event_id AS request_id,
  CASE event_id % 20
    WHEN 0 THEN '/o/r' WHEN 1 THEN '/o/r/pull/' || CAST(user_id AS STRING) WHEN 2 THEN '/o/r/commit/abc1234'
    WHEN 3 THEN '/o/r/compare/a...b' WHEN 4 THEN '/o/r/tree/main' WHEN 5 THEN '/o/r/tree/main/src/a.rs'
    WHEN 6 THEN '/o/r/blob/main' WHEN 7 THEN '/o/r/blob/main/x' WHEN 8 THEN '/o/r/releases/tag/v1'
    WHEN 9 THEN '/o/r/-/tree/main' WHEN 10 THEN '/o/r/-/tree/main/src/lib' WHEN 11 THEN '/o/r/-/blob/main'
    WHEN 12 THEN '/o/r/-/blob/main/a/b' WHEN 13 THEN '/o/r/-/commit/abc1234' WHEN 14 THEN '/o/r/-/compare/a..b'
    WHEN 15 THEN '/o/r/-/merge_requests/12' WHEN 16 THEN '/o' WHEN 17 THEN '/o/r/wiki/Home' WHEN 18 THEN '/cache/stats'
    ELSE '/o/r/' END AS route
FROM events""",
    "diff_requests": """
SELECT event_id AS request_id,
  CASE event_id % 3 WHEN 0 THEN 'pr' WHEN 1 THEN 'commit' ELSE 'compare' END AS kind,
  'org' || CAST(user_id AS STRING) AS owner, 'repo' AS repo, CAST(event_id % 40 AS STRING) AS identifier,
  CASE WHEN event_id % 2 = 0 THEN event_id % 5 ELSE NULL END AS context
FROM events""",
    "ingest_requests": """
SELECT doc_id AS request_id, repo_url,
  CASE doc_id % 5 WHEN 0 THEN 'raw' WHEN 1 THEN 'standard' WHEN 2 THEN 'code_only' WHEN 3 THEN 'Minimal' ELSE NULL END AS preset,
  CASE WHEN doc_id % 4 = 0 THEN 'src/, *.rs ,,docs/*' WHEN doc_id % 4 = 1 THEN 'f1*,*.md' ELSE NULL END AS include_csv,
  CASE WHEN doc_id % 3 = 0 THEN 'src/core, *.ts' ELSE NULL END AS exclude_csv,
  doc_id % 14 = 5 AS raw, CAST(CASE WHEN doc_id % 9 = 2 THEN 1500 ELSE NULL END AS BIGINT) AS max_size,
  CASE WHEN doc_id % 10 = 7 THEN 'dev' ELSE NULL END AS branch,
  CASE doc_id % 8 WHEN 1 THEN 'src' WHEN 2 THEN '../etc' WHEN 3 THEN '/abs' ELSE NULL END AS path,
  CASE WHEN doc_id % 7 = 4 THEN 'docs/' ELSE NULL END AS subpath
FROM repo_files""",
    "branch_files": """
SELECT CAST(NULL AS STRING) AS branch, * FROM sized_files
UNION ALL
SELECT 'dev' AS branch, * FROM sized_files WHERE doc_id % 3 = 0""",
    "catalog": """
SELECT cache_key, url, branch, commit_hash, size_bytes, created_at, last_accessed,
  CASE WHEN user_id % 3 = 0 THEN 1706659200 - 100 ELSE created_at END AS last_validated, access_count
FROM (
  SELECT user_id, sha1('key' || CAST(user_id AS STRING)) AS cache_key,
    'https://github.com/org' || CAST(user_id AS STRING) || '/repo' AS url,
    CASE WHEN user_id % 2 = 0 THEN 'main' ELSE NULL END AS branch,
    sha1('c' || CAST(user_id AS STRING)) AS commit_hash,
    CAST(sum(floor(value * 1000)) AS BIGINT) AS size_bytes,
    least(min({secs}(ts)) + (user_id % 4) * 777600, 1706659200 - 60) AS created_at,
    max({secs}(ts)) AS last_accessed, count(*) AS access_count
  FROM events GROUP BY user_id) t""",
    "current_heads": """
SELECT cache_key, CASE WHEN substr(cache_key, 1, 1) IN ('0', '4', '8', 'c') THEN sha1('moved' || cache_key) ELSE commit_hash END AS head_sha
FROM catalog WHERE substr(cache_key, 2, 1) <> '7'
UNION ALL
SELECT sha1('key-new') AS cache_key, sha1('c-new') AS head_sha""",
    "file_heads": """
SELECT DISTINCT repo_url, sha1(repo_url) AS cache_key, sha1('head' || repo_url) AS head_sha FROM repo_files""",
    "file_catalog": """
SELECT cache_key, CASE WHEN substr(cache_key, 1, 1) < '6' THEN head_sha ELSE sha1('old' || repo_url) END AS commit_hash FROM file_heads
WHERE substr(cache_key, 2, 1) <> '3'""",
    "access_log": """
SELECT event_id AS request_id, {secs}(ts) AS ts_sec,
  sha1(CASE WHEN event_id % 11 = 0 THEN 'key-miss' ELSE 'key' END || CAST(user_id AS STRING)) AS cache_key
FROM events""",
    "catalog_new": """
SELECT sha1(CASE WHEN user_id % 3 = 1 THEN 'key' ELSE 'key-miss' END || CAST(user_id AS STRING)) AS cache_key,
  'https://github.com/org' || CAST(user_id AS STRING) || '/repo' AS url, CAST(NULL AS STRING) AS branch,
  sha1('n' || CAST(user_id AS STRING)) AS commit_hash, CAST(user_id * 10 AS BIGINT) AS size_bytes,
  CAST(1706659200 AS BIGINT) AS created_at, CAST(1706659200 AS BIGINT) AS last_accessed,
  CAST(1706659200 AS BIGINT) AS last_validated, CAST(1 AS BIGINT) AS access_count
FROM events WHERE user_id % 3 > 0 GROUP BY user_id""",
    "purge_keys": "SELECT DISTINCT sha1('key' || CAST(user_id AS STRING)) AS cache_key FROM events WHERE user_id % 5 = 1",
    "diff_catalog": """
SELECT sha1('d' || CAST(user_id AS STRING) || event_type) AS cache_key,
  CAST(sum(floor(value * 10)) AS BIGINT) AS content_bytes, min({secs}(ts)) AS created_at, count(*) AS access_count
FROM events GROUP BY user_id, event_type""",
    "ref_names": """
SELECT repo_url, 'main' AS name FROM commits WHERE k = 1
UNION ALL SELECT repo_url, 'v1' AS name FROM commits WHERE k = 1
UNION ALL SELECT repo_url, 'develop' AS name FROM commits WHERE k = 1
UNION ALL SELECT repo_url, 'pull/3/head' AS name FROM commits WHERE k = 1
UNION ALL SELECT repo_url, substr(sha, 1, 6 + k % 4) AS name FROM commits""",
    "compare_pairs": """
SELECT repo_url, base, head, sha1(repo_url || ':' || base) AS base_sha, sha1(repo_url || ':' || head) AS head_sha
FROM (SELECT repo_url, CAST(k AS STRING) AS head, CAST(k - 1 - k % 3 AS STRING) AS base FROM commits WHERE k > 3) t""",
    "named_pairs": """
SELECT repo_url, base, head, CASE WHEN (r + CAST(head AS INT)) % 11 = 0 THEN NULL ELSE base_sha END AS base_sha,
  CASE WHEN (r + CAST(head AS INT)) % 7 = 0 THEN NULL ELSE head_sha END AS head_sha
FROM (SELECT p.*, c.r FROM compare_pairs p JOIN commits c ON c.repo_url = p.repo_url AND c.sha = p.head_sha) t""",
    "asked_shas": """
SELECT repo_url, CASE WHEN k % 3 = 0 THEN substr(sha, 1, 12) ELSE sha END AS name FROM commits
UNION ALL
SELECT repo_url, 'zz' || substr(sha, 1, 8) AS name FROM commits WHERE k = 1""",
    "wanted_branches": """
SELECT repo_url, CASE k % 4 WHEN 1 THEN 'main' WHEN 2 THEN 'feature' WHEN 3 THEN 'refs/tags/v1' ELSE 'gone' END AS branch FROM commits""",
}

NAMES = re.compile(r"\b(?:FROM|JOIN)\s+([a-z_]+)")


def needed(names: list[str]) -> list[str]:
    """The named views with everything they read, inputs first."""
    found: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in found:
            for inner in NAMES.findall(VIEWS[name]):
                visit(inner)
            found.append(name)

    for name in names:
        visit(name)
    return found


def load(spark: SparkSession, sf_dir: str, *names: str, stream: bool = False) -> DataFrame | tuple[DataFrame, ...]:
    """The named views as DataFrames over the given tables, read as streams if asked for."""
    ship_package(spark)
    for table in BASE_TABLES:
        path = f"{sf_dir}/{table}.parquet"
        given = spark.read.parquet(path)
        if stream:
            # A pattern, as a stream source takes a plain path for a folder and the table may be one file.
            given = spark.readStream.schema(given.schema).parquet(path[:-1] + "[t]")
        given.createOrReplaceTempView(table)
    frames = {}
    for name in needed(list(names)):
        text = re.sub(r"\{secs\}\((\w+)\)", r"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', \1)", VIEWS[name])
        frames[name] = spark.sql(text.replace("{bytes}", "octet_length"))
        frames[name].createOrReplaceTempView(name)
    picked = tuple(frames[n] for n in names)
    return picked if len(picked) > 1 else picked[0]


def with_views(sql: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """The check text with the views it reads put in front."""
    extra = extra or {}
    used = [n for text in [*extra.values(), sql] for n in NAMES.findall(text) if n not in extra]
    parts = []
    for name in needed(used):
        text = re.sub(r"\{secs\}\((\w+)\)", r"CAST(floor(epoch(\1)) AS BIGINT)", VIEWS[name])
        parts.append(f"{name} AS ({text.replace('{bytes}', 'strlen')})")
    parts += [f"{name} AS ({text})" for name, text in extra.items()]
    if not parts:
        return sql
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + sql
