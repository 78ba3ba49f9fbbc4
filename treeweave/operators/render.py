"""Rendered text: blocks, directory tree, documents, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from treeweave.functions.globs import file_name
from treeweave.functions.licenses import compressed_text
from treeweave.operators.content import decoded
from treeweave.operators.filters import IngestOptions, ingestable, max_size
from treeweave.operators.ordering import numbered

# How presets are named in a document header.
PRESET_LABELS = {
    "raw": "raw (no filtering)",
    "standard": "standard (smart filtering)",
    "code-only": "code-only",
    "minimal": "minimal filtering",
}


def order_key(path: Column, indexed: bool) -> Column:
    """Byte order of the whole path for indexed trees, component by component otherwise."""
    return path if indexed else F.split(path, "/")


def path_order(files: DataFrame) -> DataFrame:
    """Position of each path within its repository under both orders."""
    paths = files.select("repo_url", "path")
    by_bytes = numbered(paths, ["repo_url"], [order_key(F.col("path"), True)], "byte_pos")
    by_parts = numbered(paths, ["repo_url"], [order_key(F.col("path"), False)], "component_pos")
    return by_bytes.join(by_parts, ["repo_url", "path"])


def texts_of(files: DataFrame, indexed: bool = True) -> DataFrame:
    """Text of each file as it enters a document: decoded, licences shortened."""
    shown = compressed_text(F.col("path"), F.col("text"))
    return (
        files.select("repo_url", "path", decoded(F.col("content"), indexed).alias("text"))
        .select("repo_url", "path", shown.alias("text"))
    )


def block_of(path: Column, text: Column) -> Column:
    return F.concat(F.lit("=== "), path, F.lit(" ===\n"), text, F.lit("\n\n"))


def blocks(files: DataFrame, indexed: bool = True) -> DataFrame:
    """One block per file, unnumbered."""
    return texts_of(files, indexed).select(
        "repo_url", "path", block_of(F.col("path"), F.col("text")).alias("block")
    )


def render_blocks(files: DataFrame, indexed: bool = True) -> DataFrame:
    """Blocks with their place in the repository. Only paths are sorted; contents join in by key."""
    places = numbered(files.select("repo_url", "path"), ["repo_url"], [order_key(F.col("path"), indexed)])
    return blocks(files, indexed).join(places, ["repo_url", "path"])


def _folder(path: Column) -> Column:
    name_size = F.length(file_name(path))
    return F.when(
        path.contains("/"), F.substring(path, F.lit(1), F.length(path) - name_size - 1)
    ).otherwise(".")


def tree_rows(kept: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Lines of the directory tree with the columns that order them.

    `repos` names repositories that get a tree even if no file is left.
    """
    path = F.col("path")
    entries = kept.select("repo_url", _folder(path).alias("dir"), file_name(path).alias("name"))
    # Grouped once: the folder rows, and through them the file counts, share one shuffle of partial counts.
    per_folder = entries.groupBy("repo_url", "dir").agg(F.count(F.lit(1)).alias("n"))
    counts = per_folder.groupBy("repo_url").agg(F.sum("n").alias("n"))
    if repos is not None:
        counts = (
            repos.select("repo_url").distinct().join(counts, "repo_url", "left").fillna({"n": 0})
        )
    frame = counts.select(
        "repo_url",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(part).alias("part"), line.alias("line"))
                    for part, line in (
                        (1, F.lit("# File Structure")),
                        (2, F.lit("")),
                        (3, F.concat(F.lit("Total files: "), F.col("n").cast("string"))),
                        (4, F.lit("")),
                        (6, F.lit("")),
                    )
                ]
            )
        ),
    ).select("repo_url", "part", F.lit("").alias("dir"), F.lit("").alias("name"), "line")
    body = F.lit(5).alias("part")
    root = F.col("dir") == "."
    folders = (
        per_folder.where(~root)
        .select("repo_url", body, "dir", F.lit("").alias("name"), F.concat(F.lit("  "), "dir", F.lit("/")).alias("line"))
    )
    names = entries.select(
        "repo_url", body, "dir", "name",
        F.concat(F.when(root, F.lit("  ")).otherwise("    "), F.col("name")).alias("line"),
    )
    return frame.unionByName(folders).unionByName(names)


TREE_ORDER = ["part", "dir", "name"]


def directory_tree(kept: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    lines = numbered(tree_rows(kept, repos), ["repo_url"], [F.col(c) for c in TREE_ORDER], "line_no")
    return lines.select("repo_url", "line_no", "line")


def header_rows(repos: DataFrame, options: IngestOptions, cached: bool, generator: str) -> DataFrame:
    preset = options.preset or "standard"
    lines = [
        F.concat(F.lit("# Repository: "), F.col("repo_url")),
        F.lit(f"# Generated by {generator}"),
        F.lit(f"# Filter preset: {PRESET_LABELS[preset]}"),
        *([F.lit("# Cache: enabled")] if cached else []),
        F.lit(""),
    ]
    return repos.select("repo_url", F.posexplode(F.array(*lines)).alias("_at", "text")).select(
        "repo_url", F.lit(0).alias("section"), (F.col("_at") + 1).cast("bigint").alias("seq"), "text"
    )


def selected_files(files: DataFrame, options: IngestOptions) -> tuple[DataFrame, DataFrame]:
    """Files that are rendered, and files named by the tree; only the direct mode names files above the limit."""
    listed = ingestable(files, options)
    rendered = max_size(listed, options.max_file_size)
    return rendered, (rendered if options.indexed else listed)


def repo_document(
    files: DataFrame,
    options: IngestOptions,
    header: bool = True,
    cached: bool = False,
    generator: str = "treeweave",
) -> DataFrame:
    """Documents as ordered rows (repo_url, section, seq, text): 0 header, 1 tree, 2 blocks.

    Joined in this order, each header and tree row with a line end, the rows are the document.
    """
    rendered, named = selected_files(files, options)
    repos = files.select("repo_url").distinct()
    tree = directory_tree(named.select("repo_url", "path"), repos).select(
        "repo_url", F.lit(1).alias("section"), F.col("line_no").alias("seq"), F.col("line").alias("text")
    )
    body = render_blocks(rendered, options.indexed).select(
        "repo_url", F.lit(2).alias("section"), "seq", F.col("block").alias("text")
    )
    document = tree.unionByName(body)
    return header_rows(repos, options, cached, generator).unionByName(document) if header else document


def parse_documents(documents: DataFrame) -> DataFrame:
    """Paths named by the block headers of rendered texts, in order; other columns are kept."""
    is_header = lambda line: line.startswith("=== ") & line.endswith(" ===") & (F.length(line) >= 8)
    headers = F.filter(F.split(F.col("text"), "\n"), is_header)
    keep = [c for c in documents.columns if c != "text"]
    line = F.col("_line")
    return documents.select(*keep, F.posexplode(headers).alias("_at", "_line")).select(
        *keep, (F.col("_at") + 1).cast("bigint").alias("seq"),
        F.substring(line, F.lit(5), F.length(line) - 8).alias("path"),
    )


def flat_listing(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """The parsed paths as a listing: a title line and one line per path."""
    title = parsed.select(*keys).distinct().select(
        *keys, F.lit(0).cast("bigint").alias("seq"), F.lit("Repository structure:").alias("line")
    )
    return title.unionByName(parsed.select(*keys, "seq", F.concat(F.lit("📄 "), "path").alias("line")))
