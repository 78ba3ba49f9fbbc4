"""Directory trees: links, sizes, and trees as a stream."""

import os
import subprocess
import sys
from pathlib import Path

import treeweave.sources.tree as tree_module
from treeweave.operators.filters import IngestOptions
from treeweave.sources import files as sources
from treeweave.streaming import streams


def drop(root: Path, names: dict[str, bytes]) -> None:
    for name, body in names.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)


def test_links_are_not_followed(spark, tmp_path):
    root = tmp_path / "w"
    drop(root, {"r/src/a.rs": b"1", "r/b.rs": b"22"})
    drop(tmp_path, {"outside.txt": b"secret", "other/c.rs": b"3"})
    os.symlink("..", root / "r/src/up")
    os.symlink(tmp_path / "outside.txt", root / "r/out")
    os.symlink(tmp_path / "other", root / "r/other")
    os.symlink("nowhere", root / "r/broken")
    scanned = sources.scan_worktree(spark, str(root))
    assert sorted((r.repo_url, r.path, bytes(r.content)) for r in scanned.collect()) == [("r", "b.rs", b"22"), ("r", "src/a.rs", b"1")]
    blocks = streams.stream_tree(spark, str(root), str(tmp_path / "l"), IngestOptions())
    assert sorted(r[1] for r in run(blocks, tmp_path)) == ["b.rs", "src/a.rs"]


def test_a_filter_on_size_opens_no_larger_file(spark, tmp_path):
    drop(tmp_path / "w", {"r/a": b"1", "r/large": b"1" * 100})
    os.chmod(tmp_path / "w/r/large", 0)
    scanned = sources.scan_worktree(spark, str(tmp_path / "w")).where("size <= 10")
    # A file that cannot be read would fail the job, had it been opened (not so for a privileged user).
    assert [(r.path, bytes(r.content)) for r in scanned.collect()] == [("a", b"1")]


def run(blocks, folder) -> list[tuple]:
    (
        blocks.writeStream.format("parquet").option("path", str(folder / "rows")).option("checkpointLocation", str(folder / "progress"))
        .trigger(availableNow=True).start().awaitTermination()
    )
    rows = blocks.sparkSession.read.schema(blocks.schema).parquet(str(folder / "rows"))
    return sorted(tuple(r) for r in rows.select("repo_url", "path", "block").collect())


def block(path: str, body: str) -> str:
    return f"=== {path} ===\n{body}\n\n"


def test_files_of_a_tree_come_once_and_again_when_they_change(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tree_module, "SHARE", 2)
    root = tmp_path / "w"
    options = IngestOptions(max_file_size=20)
    arrive = lambda: run(streams.stream_tree(spark, str(root), str(tmp_path / "l"), options), tmp_path)

    drop(root, {"r1/a.rs": b"1", "r1/.hid/_x.rs": b"2", "r2/b c.rs": b"3", "r2/large.rs": b"4" * 21, "top.rs": b"5"})
    first = [("", "top.rs", block("top.rs", "5")), ("r1", ".hid/_x.rs", block(".hid/_x.rs", "2")), ("r1", "a.rs", block("a.rs", "1")), ("r2", "b c.rs", block("b c.rs", "3"))]
    assert arrive() == first
    assert arrive() == first

    drop(root, {"r1/é.rs": b"6", "r3/n.rs": b"7", **{f"r2/many/{n}.rs": b"8" for n in range(7)}})
    drop(root, {"r1/a.rs": b"changed"})
    (root / "r2/b c.rs").unlink()
    more = [("r1", "a.rs", block("a.rs", "changed")), ("r1", "é.rs", block("é.rs", "6")), ("r3", "n.rs", block("n.rs", "7"))]
    more += [("r2", f"many/{n}.rs", block(f"many/{n}.rs", "8")) for n in range(7)]
    assert arrive() == sorted(first + more)
    assert arrive() == sorted(first + more)
    # Old manifests and listings do not pile up.
    assert len(list((tmp_path / "l").glob("manifest-*.json"))) <= 2 and len(list((tmp_path / "l").glob("*.parquet"))) <= 6


def test_the_size_is_known_before_a_file_is_read(spark, tmp_path):
    drop(tmp_path / "w", {"r/a.rs": b"1", "r/large.rs": b"1" * 50})
    names = spark.createDataFrame([(str(tmp_path / "w"), "r", "a.rs"), (str(tmp_path / "w"), "r", "large.rs")], "root string, repo_url string, path string")
    blocks = streams.stream_paths(names, IngestOptions(max_file_size=10))
    assert [r.path for r in blocks.collect()] == ["a.rs"]
    name = "concat_ws('/', repo_url, path)"
    sizes = names.select(sources.file_size("root", sources.F.expr(name)).alias("n")).collect()
    assert [r.n for r in sizes] == [1, 50]


def test_core_queries_are_there_without_an_optional_library():
    code = (
        "import sys, warnings; warnings.simplefilter('ignore'); sys.modules['ahocorasick'] = None\n"
        "import __spark_entry__ as e; from treeweave.plans import QUERIES\n"
        "assert set(e.queries()) == set(QUERIES) and len(QUERIES) >= 97 and set(e.oracle_sql()) <= set(QUERIES)"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])
