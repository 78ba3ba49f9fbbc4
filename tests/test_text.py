"""Counts, licences, rendering, keys."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeweave.functions import text as T
from treeweave.functions.keys import blob_id
from treeweave.functions.licenses import license_tag
from treeweave.operators import content, render
from treeweave.operators.filters import IngestOptions
from treeweave.operators.stats import repo_summary
from treeweave.sources import files as sources, sinks

SPACES = [chr(c) for c in [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("text,want", [("", 0), ("a", 1), ("a\n", 1), ("a\n\n", 2), ("\n", 1), ("a\nb", 2)])
def test_lines(spark, text, want):
    assert one(spark, T.line_count(F.lit(text))) == want


def test_words(spark):
    texts = ["", "  ", "a b", " a​b ", *[f"x{c}y" for c in SPACES], "x\x1cy", "日本 語"]
    for text in texts:
        want = len([w for w in "".join(" " if c in SPACES else c for c in text).split(" ") if w])
        assert one(spark, T.word_count(F.lit(text))) == want, repr(text)


def test_markers(spark):
    assert one(spark, T.marker_count(F.lit("=== a ===\nif (x === y)\n"))) == 2
    assert one(spark, T.marker_count(F.lit("==== === "))) == 2


@pytest.mark.parametrize("size,want", [(0, "0.0 B"), (1023, "1023.0 B"), (1536, "1.5 KB"), (1048576, "1.0 MB"), (5368709120, "5.0 GB"), (5497558138880, "5120.0 GB")])
def test_size_label(spark, size, want):
    assert one(spark, T.size_label(F.lit(size))) == want


@pytest.mark.parametrize("n,want", [(999, "999"), (1500, "1.5k"), (2500000, "2.5M"), (1000, "1.0k")])
def test_token_label(spark, n, want):
    assert one(spark, T.token_label(F.lit(n))) == want


def test_tokens_in_single_precision(spark):
    f = np.float32
    rng = np.random.default_rng(7)
    rows = [tuple(int(v) for v in r) for r in rng.integers(0, 10**8, (500, 3))]
    got = spark.createDataFrame(rows, "b bigint, w bigint, l bigint").select("*", T.token_estimate(F.col("b"), F.col("w"), F.col("l")).alias("t"))
    for r in got.collect():
        want = int((f(r.b) / f(3.3) + f(r.w) * f(0.75)) / f(2.0) + f(r.l) * f(0.1))
        assert r.t == want, r


def test_blob_id(spark):
    assert one(spark, blob_id(F.lit(bytearray(b"hi")))) == "32f95c0d1244a78b2be1bab8de17906fabb2c4a8"
    assert one(spark, blob_id(F.lit(bytearray(b"")))) == "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"


# The tags of licences.
MIT = "[mit license - https://opensource.org/licenses/MIT]"
APACHE = "[apache license 2.0 - https://www.apache.org/licenses/LICENSE-2.0]"
GPL3 = "[gnu gpl v3 - https://www.gnu.org/licenses/gpl-3.0.html]"
GPL2 = "[gnu gpl v2 - https://www.gnu.org/licenses/gpl-2.0.html]"
BSD3 = "[bsd 3-clause license - https://opensource.org/licenses/BSD-3-Clause]"
BSD2 = "[bsd 2-clause license - https://opensource.org/licenses/BSD-2-Clause]"
ISC = "[isc license - https://opensource.org/licenses/ISC]"
MOZILLA = "[mozilla public license 2.0 - https://www.mozilla.org/MPL/2.0/]"
LGPL = "[gnu lgpl - https://www.gnu.org/licenses/lgpl.html]"
AGPL = "[gnu agpl - https://www.gnu.org/licenses/agpl.html]"
UNLICENSE = "[unlicense - public domain - https://unlicense.org/]"
COMMONS = "[creative commons license - see repository for details]"


def test_licenses(spark):
    bsd = "Redistribution and use in source and binary forms"
    cases = [
        ("LICENSE", "MIT License\nPermission is hereby granted, free of charge", MIT),
        ("LICENSE", "Permission is hereby granted, free of charge", None),
        ("LICENSE", "MIT License", None),
        ("LICENSE", "without restriction ... above copyright notice", MIT),
        ("LICENSE", "without restriction", None),
        ("LICENSE", "above copyright notice", None),
        ("licence.txt", "Apache License Version 2.0", APACHE),
        ("licence.txt", "Apache License", None),
        ("COPYING", "GNU General Public License Version 3", GPL3),
        ("COPYING", "GNU General Public License\nversion 2", GPL2),
        ("COPYING", "GNU General Public License", None),
        ("COPYING", "version 3, version 2, version 2.0", None),
        ("LICENSE", bsd + ". Neither the name of", BSD3),
        ("LICENSE", bsd + ".", BSD2),
        ("LICENSE", "Neither the name of", None),
        ("LICENSE", "ISC License", ISC),
        ("LICENSE", "Permission to use, copy, modify and/or sell copies", ISC),
        ("LICENSE", "Permission to use, copy, modify", None),
        ("LICENSE", "and/or sell copies", None),
        ("LICENSE", "Mozilla Public License, version 2.0", MOZILLA),
        ("LICENSE", "Mozilla Public License", None),
        ("LICENSE", "GNU Lesser General Public License", LGPL),
        ("LICENSE", "GNU Lesser General Public License, see GNU General Public License version 3", GPL3),
        ("LICENSE", "GNU Affero General Public License", AGPL),
        ("LICENSE", "This is free and unencumbered software released into the public domain", UNLICENSE),
        ("src/license/mod.rs", "creative commons", COMMONS),
        ("docs/Copying.md", "Creative Commons", COMMONS),
        ("README.md", "MIT License Permission is hereby granted, free of charge", None),
        ("LICENSE", "my own", None),
    ]
    rows = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(cases)], "i int, path string, text string")
    got = {r.i: r.tag for r in rows.select("i", license_tag(F.col("path"), F.col("text")).alias("tag")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, _, want in cases]


def test_decode_modes(spark):
    rows = [(bytearray(b"ok"),), (bytearray(b"\xff"),), (bytearray(b"a\0b"),), (bytearray(b"x" * 8192 + b"\0"),)]
    files = spark.createDataFrame(rows, "content binary")
    indexed = [r.text for r in content.decode(files, True).collect()]
    assert indexed == ["ok", "[error reading file]", "[binary file]", "x" * 8192 + "\0"]
    assert [r.text for r in content.decode(files, False).collect()] == ["ok", "[binary file]", "a\0b", "x" * 8192 + "\0"]


def files_of(spark, rows):
    table = spark.createDataFrame(
        [(repo, path, len(body), "tracked", bytearray(body)) for repo, path, body in rows],
        "repo_url string, path string, size bigint, git_status string, content binary",
    )
    return table


def assembled(document, repo):
    rows = sorted((r.section, r.seq, r.text) for r in document.collect() if r.repo_url == repo)
    return "".join(text if section == 2 else text + "\n" for section, _, text in rows)


def test_document(spark):
    files = files_of(spark, [("r", "src/a.rs", b"fn"), ("r", "b.rs", b"x\n"), ("r", "a.rs", b"y"), ("r", "big.rs", b"z" * 50), ("empty", "x.png", b"p")])
    options = IngestOptions(preset="standard", max_file_size=40)
    want = (
        "# Repository: r\n# Generated by treeweave\n# Filter preset: standard (smart filtering)\n\n"
        "# File Structure\n\nTotal files: 3\n\n  a.rs\n  b.rs\n  src/\n    a.rs\n\n"
        "=== a.rs ===\ny\n\n=== b.rs ===\nx\n\n\n=== src/a.rs ===\nfn\n\n"
    )
    document = render.repo_document(files, options)
    assert assembled(document, "r") == want
    assert assembled(document, "empty").endswith("# File Structure\n\nTotal files: 0\n\n\n")
    direct = render.repo_document(files, IngestOptions(preset="standard", max_file_size=40, indexed=False), header=False)
    assert "Total files: 4" in assembled(direct, "r") and "=== big.rs" not in assembled(direct, "r")

    body = want.split("\n\n", 1)[1]
    summary = {r.repository: r for r in repo_summary(files, options).collect()}["r"]
    assert (summary.files_analyzed, summary.total_size) == (body.count("=== "), len(body.encode()))
    f = np.float32
    assert summary.estimated_tokens == int(
        (f(len(body.encode())) / f(3.3) + f(len(body.split())) * f(0.75)) / f(2) + f(len(body.splitlines())) * f(0.1)
    )


def test_orders(spark):
    paths = files_of(spark, [("r", p, b"") for p in ("a/b", "a-b", "a.c", "a")])
    rows = render.path_order(paths).collect()
    assert [r.path for r in sorted(rows, key=lambda r: r.component_pos)] == ["a", "a/b", "a-b", "a.c"]
    assert [r.path for r in sorted(rows, key=lambda r: r.byte_pos)] == ["a", "a-b", "a.c", "a/b"]


def test_rendered_text_parses_back(spark):
    files = files_of(spark, [("r", f"d{i % 3}/f{i}", b"text === x\n") for i in range(20)])
    blocks = render.render_blocks(files)
    parsed = render.parse_documents(blocks.select("seq", F.col("block").alias("text")).withColumnRenamed("seq", "doc"))
    assert sorted((r.doc, r.seq, r.path) for r in parsed.collect()) == sorted((r.seq, 1, r.path) for r in blocks.collect())


def test_messages(spark):
    from treeweave.operators.stats import filter_stats

    files = files_of(spark, [("r", "a.rs", b"x\"y\n"), ("r", "b.png", b"p")])
    options = IngestOptions(preset="standard")
    stats = filter_stats(files, options)
    errors = spark.createDataFrame([("r", "Failed: x")], "repo_url string, message string")
    rows = sinks.export_messages(render.render_blocks(render.selected_files(files, options)[0]), stats, errors).collect()
    sent = [json.loads(r.message) for r in sorted(rows, key=lambda r: (r.stage, r.seq))]
    assert [m["type"] for m in sent] == ["Progress", "Progress", "FilterStats", "File", "Complete", "Error"]
    assert sent[3] == {"type": "File", "path": "a.rs", "content": '=== a.rs ===\nx"y\n\n\n'}
    assert sent[2]["stats"]["included_files"] == 1 and sent[4]["files"] == 1


def test_worktree_and_documents(spark, tmp_path):
    tree = {
        "r1/a.rs": b"1", "r1/src/b.rs": b"22", "r2/c d.txt": b"333", "r3/.github/ci.yml": b"4444", "r3/.gitignore": b"5", "r3/src/__init__.py": b"",
        "r3/_build/x": b"6", "r3/__pycache__/.d/y%20z": b"7", "top": b"8",
    }
    for name, body in tree.items():
        (tmp_path / "w" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "w" / name).write_bytes(body)
    scanned = sources.scan_worktree(spark, str(tmp_path / "w"))
    assert sorted((r.repo_url, r.path, r.size, bytes(r.content)) for r in scanned.collect()) == [
        (*(("", n) if "/" not in n else n.split("/", 1)), len(b), b) for n, b in sorted(tree.items(), key=lambda x: ("" if "/" not in x[0] else x[0].split("/")[0], x[0]))
    ]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan(scanned.where("size <= 2").select("path", "size"))
    # Files above a limit are not opened: the filter stands below the reading.
    limited = plan(scanned.where("size <= 2"))
    assert limited.index("EvalPython") < limited.index("<= 2")

    sources.write_snapshot(scanned, str(tmp_path / "s"))
    found = sources.scan_snapshot(spark, str(tmp_path / "s"), ["r2"])
    assert [r.path for r in found.collect()] == ["c d.txt"]
    assert "PartitionFilters: [" in found._jdf.queryExecution().executedPlan().toString()
    assert sources.scan_snapshot(spark, str(tmp_path / "s"), []).count() == 0
    table = spark.createDataFrame([("r1",)], "repo_url string")
    assert sorted(r.path for r in sources.scan_snapshot(spark, str(tmp_path / "s"), table).collect()) == ["a.rs", "src/b.rs"]

    document = render.repo_document(scanned.where("repo_url = 'r1'"), IngestOptions(preset="standard"))
    sinks.write_documents(document, str(tmp_path / "d"))
    written = "".join(p.read_text() for p in sorted((tmp_path / "d").glob("bucket=*/*.txt")))
    assert written == assembled(document, "r1")
