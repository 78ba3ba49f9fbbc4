"""Queries over file contents: text, licences, rendering, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from treeweave.functions.licenses import LICENSE_PATH_WORDS, LICENSES
from treeweave.operators import content, render, stats
from treeweave.operators.catalog import refreshed_documents
from treeweave.operators.filters import IngestOptions, ingestable
from treeweave.plans.file_queries import OPTIONS, any_of, patterns, with_content
from treeweave.plans.registry import (
    include_sql, lines_sql, query, text_tokens_sql, tokens_sql, values, words_sql,
)
from treeweave.plans.views import NOW, load, with_views
from treeweave.session import new_folder
from treeweave.sources import sinks
from treeweave.sources.files import index_files

STANDARD = IngestOptions(preset="standard")


def _mixed_content() -> Column:
    """Texts, some with a NUL byte before or after, some with a byte that is no UTF-8."""
    text, kind = F.col("text").cast("binary"), F.col("doc_id") % 7
    nul, odd = F.lit(bytearray(b"\0")), F.lit(bytearray(b"\xff"))
    return (
        F.when(kind == 2, F.concat(nul, text)).when(kind == 0, F.concat(text, nul)).when(kind == 1, F.concat(text, odd)).otherwise(text)
    )


HAS_NUL = "(doc_id % 7 = 2 OR (doc_id % 7 = 0 AND strlen(text) < 8192))"


@query("binary_flag", with_views(f"SELECT repo_url, path, {HAS_NUL} AS is_binary FROM repo_files"))
def binary_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = load(spark, sf_dir, "repo_files").withColumn("content", _mixed_content())
    return content.flag_binary(files).select("repo_url", "path", "is_binary")


@query(
    "file_index",
    with_views(f"SELECT repo_url, path, CAST(strlen(text) + CASE WHEN doc_id % 7 < 3 THEN 1 ELSE 0 END AS BIGINT) AS size, {HAS_NUL} AS is_binary FROM repo_files"),
)
def file_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = load(spark, sf_dir, "repo_files").withColumn("content", _mixed_content())
    sized = files.withColumn("size", F.octet_length("content").cast("bigint")).withColumn("commit_sha", F.lit("c"))
    return index_files(sized)[0].drop("commit_sha")


DECODED = {
    "decoded": f"""
SELECT path, 'direct' AS mode, CASE doc_id % 7 WHEN 1 THEN '[binary file]' WHEN 0 THEN text || chr(0) WHEN 2 THEN chr(0) || text ELSE text END AS shown
FROM repo_files
UNION ALL
SELECT path, 'indexed', CASE WHEN {HAS_NUL} THEN '[binary file]' WHEN doc_id % 7 = 1 THEN '[error reading file]'
  WHEN doc_id % 7 = 0 THEN text || chr(0) ELSE text END
FROM repo_files"""
}


@query(
    "decode_content",
    with_views(
        "SELECT path, mode, CASE WHEN shown IN ('[binary file]', '[error reading file]') THEN shown END AS placeholder, "
        "CAST(strlen(shown) AS BIGINT) AS bytes, md5(shown) AS digest FROM decoded",
        DECODED,
    ),
)
def decode_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = load(spark, sf_dir, "repo_files").withColumn("content", _mixed_content()).select("path", "content")
    both = [content.decode(files, mode == "indexed").withColumn("mode", F.lit(mode)) for mode in ("direct", "indexed")]
    text = F.col("text")
    return both[0].unionByName(both[1]).select(
        "path", "mode",
        F.when(text.isin("[binary file]", "[error reading file]"), text).alias("placeholder"),
        F.octet_length("text").cast("bigint").alias("bytes"), F.md5("text").alias("digest"),
    )


def _tag_sql() -> str:
    tests = []
    for tag, alternatives in LICENSES:
        fits = " OR ".join("(" + " AND ".join(f"contains(lower(text), '{p}')" for p in ps) + ")" for ps in alternatives)
        tests.append(f"WHEN {fits} THEN '{tag}'")
    named = " OR ".join(f"contains(lower(path), '{word}')" for word in LICENSE_PATH_WORDS)
    return f"CASE WHEN {named} THEN CASE {' '.join(tests)} END END"


@query(
    "license_census",
    with_views(
        f"SELECT repo_url, license, count(*) AS files FROM (SELECT repo_url, {_tag_sql()} AS license FROM repo_files) t "
        "WHERE license IS NOT NULL GROUP BY repo_url, license"
    ),
)
def license_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.license_census(load(spark, sf_dir, "repo_files"))


@query(
    "compress_licenses",
    with_views(
        f"SELECT repo_url, path, coalesce({_tag_sql()}, text) AS text, "
        f"CAST(strlen(text) - strlen(coalesce({_tag_sql()}, text)) AS BIGINT) AS saved FROM repo_files"
    ),
)
def compress_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.compress_licenses(load(spark, sf_dir, "repo_files").select("repo_url", "path", "text"))


def _kind_sql() -> str:
    ending = "split_part(split_part(path, '/', -1), '.', -1)"
    tests = " ".join(
        f"WHEN {ending} IN ({', '.join(repr(e) for e in endings)}) THEN '{name}'" for name, endings in content.FILE_KINDS.items()
    )
    return f"CASE {tests} ELSE 'other' END"


@query(
    "file_kind_census",
    with_views(f"SELECT {_kind_sql()} AS kind, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM sized_files GROUP BY 1"),
)
def file_kind_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.file_kind_census(load(spark, sf_dir, "sized_files"))


@query(
    "token_budget",
    with_views(
        "SELECT repo_url, kind, count(*) AS files, CAST(sum(tokens) AS BIGINT) AS tokens FROM "
        f"(SELECT repo_url, {_kind_sql()} AS kind, {text_tokens_sql('text')} AS tokens FROM repo_files) t "
        "GROUP BY ROLLUP (repo_url, kind)"
    ),
)
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.token_budget(load(spark, sf_dir, "repo_files"), by="corpus")


def kept_sql(options: IngestOptions, files: str = "tracked") -> dict[str, str]:
    """Views `kept` (rendered files with `shown` text) for the checks."""
    wanted = f"AND {any_of('wanted', include_sql)}" if options.include else ""
    extra = {"wanted": values([(p,) for p in options.include], "pattern")} if options.include else {}
    return {
        **patterns(options.patterns or ["\t"]),
        **extra,
        "kept": f"SELECT *, coalesce({_tag_sql()}, text) AS shown FROM {files} f WHERE NOT {any_of('given')} {wanted} "
        f"AND size <= {options.max_file_size}",
        "blocks": "SELECT repo_url, path, '=== ' || path || ' ===' || chr(10) || shown || chr(10) || chr(10) AS block FROM kept",
        "entries": "SELECT repo_url, CASE WHEN contains(path, '/') THEN left(path, length(path) - length(split_part(path, '/', -1)) - 1) "
        "ELSE '.' END AS dir, split_part(path, '/', -1) AS name FROM kept",
        "repo_counts": f"SELECT repo_url, count(name) AS n FROM (SELECT DISTINCT repo_url FROM {files.replace('tracked', 'sized_files')}) r "
        "LEFT JOIN entries USING (repo_url) GROUP BY repo_url",
        "tree": """
SELECT repo_url, 1 AS part, '' AS dir, '' AS name, '# File Structure' AS line FROM repo_counts
UNION ALL SELECT repo_url, 2, '', '', '' FROM repo_counts
UNION ALL SELECT repo_url, 3, '', '', 'Total files: ' || n FROM repo_counts
UNION ALL SELECT repo_url, 4, '', '', '' FROM repo_counts
UNION ALL SELECT DISTINCT repo_url, 5, dir, '', '  ' || dir || '/' FROM entries WHERE dir <> '.'
UNION ALL SELECT repo_url, 5, dir, name, CASE WHEN dir = '.' THEN '  ' ELSE '    ' END || name FROM entries
UNION ALL SELECT repo_url, 6, '', '', '' FROM repo_counts""",
    }


@query(
    "render_blocks",
    with_views(
        "SELECT repo_url, path, block, row_number() OVER (PARTITION BY repo_url ORDER BY path) AS seq FROM blocks", kept_sql(STANDARD)
    ),
)
def render_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = with_content(load(spark, sf_dir, "sized_files"))
    return render.render_blocks(render.selected_files(files, STANDARD)[0])


@query(
    "write_documents",
    with_views(
        "SELECT CAST(('0x' || substr(md5(repo_url), 1, 6)) AS BIGINT) % 64 AS bucket, "
        "CAST(sum(length(block) - length(replace(block, chr(10), ''))) AS BIGINT) AS lines, CAST(sum(strlen(block)) AS BIGINT) AS bytes "
        "FROM blocks GROUP BY 1",
        kept_sql(STANDARD),
    ),
)
def write_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks written as text and read back, counted per bucket."""
    files = with_content(load(spark, sf_dir, "sized_files"))
    rows = render.render_blocks(render.selected_files(files, STANDARD)[0]).select(
        "repo_url", F.lit(2).alias("section"), "seq", F.col("block").alias("text")
    )
    folder = new_folder(spark, "documents")
    sinks.write_documents(rows, folder)
    written = spark.read.text(folder)
    return written.groupBy(F.col("bucket").cast("bigint").alias("bucket")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("value") + 1).alias("bytes")
    )


STAGE = "SELECT repo_url, {0} AS stage, CAST({1} AS BIGINT) AS seq, '{2}' AS type, {3} AS path, {4} AS content, {5} AS files FROM {6}"


@query(
    "export_messages",
    with_views(
        " UNION ALL ".join([
            STAGE.format(0, 1, "Progress", "NULL", "'Processing ' || repo_url", "NULL", "all_repos"),
            STAGE.format(0, 2, "Progress", "NULL", "'Processing files...'", "NULL", "all_repos"),
            STAGE.format(1, 1, "FilterStats", "NULL", "NULL", "n_kept", "counted"),
            STAGE.format(2, "row_number() OVER (PARTITION BY repo_url ORDER BY path)", "File", "path", "block", "NULL", "blocks"),
            STAGE.format(3, 1, "Complete", "NULL", "NULL", "n_kept", "counted"),
        ]),
        {
            **kept_sql(STANDARD), "all_repos": "SELECT DISTINCT repo_url FROM tracked",
            "counted": "SELECT repo_url, count(path) AS n_kept FROM all_repos LEFT JOIN kept USING (repo_url) GROUP BY repo_url",
        },
    ),
)
def export_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages with what they hold, read back from their text."""
    files = with_content(load(spark, sf_dir, "sized_files"))
    rendered = render.render_blocks(render.selected_files(files, STANDARD)[0])
    messages = sinks.export_messages(rendered, stats.filter_stats(files, STANDARD))
    body = F.from_json(
        "message", "type string, path string, message string, content string, files long, stats struct<included_files:long>"
    ).alias("m")
    return messages.select("repo_url", "stage", "seq", body).select(
        "repo_url", "stage", "seq", "m.type", "m.path", F.coalesce("m.content", "m.message").alias("content"),
        F.coalesce("m.files", "m.stats.included_files").alias("files"),
    )


@query(
    "path_order",
    with_views(
        "SELECT repo_url, path, row_number() OVER (PARTITION BY repo_url ORDER BY path) AS byte_pos, "
        "row_number() OVER (PARTITION BY repo_url ORDER BY string_split(path, '/')) AS component_pos FROM repo_files"
    ),
)
def path_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.path_order(load(spark, sf_dir, "repo_files"))


TREE_NO = "row_number() OVER (PARTITION BY repo_url ORDER BY part, dir, name)"


@query("directory_tree", with_views(f"SELECT repo_url, {TREE_NO} AS line_no, line FROM tree", kept_sql(OPTIONS)))
def directory_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = load(spark, sf_dir, "sized_files").drop("text")
    return render.directory_tree(ingestable(files, OPTIONS), files)


DOCUMENT_SQL = f"""
SELECT repo_url, 0 AS section, 1 AS seq, '# Repository: ' || repo_url AS text FROM repo_counts
UNION ALL SELECT repo_url, 0, 2, '# Generated by treeweave' FROM repo_counts
UNION ALL SELECT repo_url, 0, 3, '# Filter preset: standard (smart filtering)' FROM repo_counts
UNION ALL SELECT repo_url, 0, 4, '' FROM repo_counts
UNION ALL SELECT repo_url, 1, {TREE_NO}, line FROM tree
UNION ALL SELECT repo_url, 2, row_number() OVER (PARTITION BY repo_url ORDER BY path), block FROM blocks"""


@query(
    "repo_document",
    with_views(
        DOCUMENT_SQL,
        kept_sql(OPTIONS),
    ),
)
def repo_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.repo_document(with_content(load(spark, sf_dir, "sized_files")), OPTIONS)


CHANGED = {
    "stale": "SELECT h.* FROM file_heads h LEFT JOIN file_catalog c ON c.cache_key = h.cache_key AND c.commit_hash = h.head_sha WHERE c.cache_key IS NULL",
    "changed_sized_files": "SELECT * FROM sized_files WHERE repo_url IN (SELECT repo_url FROM stale)",
    "changed_tracked": "SELECT * FROM changed_sized_files WHERE git_status = 'tracked'",
    **kept_sql(OPTIONS, "changed_tracked"),
}


def _refreshed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files, stored, heads = load(spark, sf_dir, "sized_files", "file_catalog", "file_heads")
    return refreshed_documents(with_content(files), stored, heads, OPTIONS, NOW)


@query("refresh_documents", with_views(DOCUMENT_SQL, CHANGED))
def refresh_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the repositories that have moved on, and of no other."""
    return _refreshed(spark, sf_dir)[0]


@query(
    "refresh_entries",
    with_views(
        f"SELECT s.cache_key, s.repo_url AS url, s.head_sha AS commit_hash, CAST(sum(strlen(text) + CASE WHEN section < 2 THEN 1 ELSE 0 END) AS BIGINT) "
        f"AS size_bytes, CAST({NOW} AS BIGINT) AS created_at FROM stale s JOIN document d ON d.repo_url = s.repo_url GROUP BY ALL",
        {**CHANGED, "document": DOCUMENT_SQL},
    ),
)
def refresh_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue entries that go with them."""
    return _refreshed(spark, sf_dir)[1].select("cache_key", "url", "commit_hash", "size_bytes", "created_at")


EXTENDED = (
    "SELECT doc_id, '=== ' || path || ' ===' || chr(10) || text || chr(10) || '=== extra/' || path || ' ===' || chr(10) "
    "|| 'body a === b' || chr(10) || '=== ===' || chr(10) AS text FROM repo_files"
)


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "repo_files")
    return spark.sql(EXTENDED)


@query(
    "parse_documents",
    with_views(
        """
SELECT doc_id, CAST(0 AS BIGINT) AS seq, 'Repository structure:' AS line FROM repo_files
UNION ALL SELECT doc_id, CAST(1 AS BIGINT), '📄 ' || path FROM repo_files
UNION ALL SELECT doc_id, CAST(2 AS BIGINT), '📄 extra/' || path FROM repo_files"""
    ),
)
def parse_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.flat_listing(render.parse_documents(_rendered(spark, sf_dir)), ["doc_id"])


@query(
    "marker_count",
    with_views(
        "SELECT doc_id, CAST(len(regexp_extract_all(text, '=== ')) AS BIGINT) AS markers FROM rendered", {"rendered": EXTENDED}
    ),
)
def marker_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.marker_counts(_rendered(spark, sf_dir))


FILTER_STATS_SQL = """
SELECT repo_url, total_files, included_files, total_files - included_files AS excluded_files, total_size, included_size,
  total_size - included_size AS excluded_size, CAST(0 AS BIGINT) AS excluded_by_filter,
  CASE WHEN total_files = 0 THEN 0.0 ELSE included_files::DOUBLE / total_files END AS inclusion_rate,
  CASE WHEN total_size = 0 THEN 0.0 ELSE (total_size - included_size)::DOUBLE / total_size END AS size_reduction
FROM (SELECT repo_url, count(*) AS total_files, count(*) FILTER (kept) AS included_files, CAST(sum(size) AS BIGINT) AS total_size,
  CAST(sum(CASE WHEN kept THEN size ELSE 0 END) AS BIGINT) AS included_size FROM flagged GROUP BY repo_url) t"""


@query(
    "filter_stats",
    with_views(
        FILTER_STATS_SQL,
        {
            **patterns(OPTIONS.patterns),
            "wanted": values([(p,) for p in OPTIONS.include], "pattern"),
            "flagged": f"SELECT *, NOT {any_of('given')} AND {any_of('wanted', include_sql)} AS kept FROM tracked f",
        },
    ),
)
def filter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.filter_stats(load(spark, sf_dir, "sized_files"), OPTIONS)


ONE_DECIMAL = "printf('%.1f', {0})"


@query(
    "repo_summary",
    with_views(
        f"""
SELECT repository, branch, subpath, files_analyzed, total_size, estimated_tokens, filter_preset, filtering_enabled,
  CASE WHEN total_size < 1024 THEN {ONE_DECIMAL.format('total_size::DOUBLE')} || ' B'
    WHEN total_size < 1048576 THEN {ONE_DECIMAL.format('total_size / 1024.0')} || ' KB'
    WHEN total_size < 1073741824 THEN {ONE_DECIMAL.format('total_size / 1048576.0')} || ' MB'
    ELSE {ONE_DECIMAL.format('total_size / 1073741824.0')} || ' GB' END AS size_label,
  CASE WHEN estimated_tokens >= 1000000 THEN {ONE_DECIMAL.format('estimated_tokens / 1000000.0')} || 'M'
    WHEN estimated_tokens >= 1000 THEN {ONE_DECIMAL.format('estimated_tokens / 1000.0')} || 'k'
    ELSE CAST(estimated_tokens AS VARCHAR) END AS token_label
FROM (SELECT repo_url AS repository, 'main' AS branch, CAST(NULL AS VARCHAR) AS subpath,
  CAST(sum(len(regexp_extract_all(piece, '=== '))) AS BIGINT) AS files_analyzed, CAST(sum(strlen(piece)) AS BIGINT) AS total_size,
  {tokens_sql('sum(strlen(piece))', f"sum({words_sql('piece')})", f"sum({lines_sql('piece')})")} AS estimated_tokens,
  'standard' AS filter_preset, TRUE AS filtering_enabled FROM pieces GROUP BY repo_url) t""",
        {
            **kept_sql(STANDARD),
            "pieces": "SELECT repo_url, block AS piece FROM blocks UNION ALL SELECT repo_url, line || chr(10) AS piece FROM tree",
        },
    ),
)
def repo_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.repo_summary(with_content(load(spark, sf_dir, "sized_files")), STANDARD, display=True)


@query(
    "repo_metadata",
    with_views(
        """
SELECT r.repo_url AS url, coalesce(h.branch, 'main') AS default_branch, coalesce(b.n, 0) AS branch_count, s.size,
  left(h.target_sha, 8) || ' - ' || coalesce(c.summary, 'No message') AS last_commit, r.repo_url AS remote_url
FROM (SELECT repo_url FROM refs UNION SELECT repo_url FROM trees) r
LEFT JOIN (SELECT * FROM refs WHERE ref_name = 'HEAD') h ON h.repo_url = r.repo_url
LEFT JOIN commits c ON c.repo_url = r.repo_url AND c.sha = h.target_sha
LEFT JOIN (SELECT repo_url, count(*) AS n FROM refs WHERE starts_with(ref_name, 'refs/heads/') GROUP BY repo_url) b ON b.repo_url = r.repo_url
LEFT JOIN (SELECT repo_url, CAST(sum(strlen(text)) AS BIGINT) AS size FROM trees GROUP BY repo_url) s ON s.repo_url = r.repo_url"""
    ),
)
def repo_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, commits, trees = load(spark, sf_dir, "refs", "commits", "trees")
    sized = trees.select("repo_url", F.octet_length("text").cast("bigint").alias("size"))
    return stats.repo_metadata(refs, commits, sized)


@query(
    "repo_branches",
    with_views("SELECT DISTINCT repo_url, substr(ref_name, 12) AS branch FROM refs WHERE starts_with(ref_name, 'refs/heads/')"),
)
def repo_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.repo_branches(load(spark, sf_dir, "refs"))
