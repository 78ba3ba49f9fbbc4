"""Line differences, patches, commit graphs."""

import pathlib
import random
import re
import shutil
import subprocess
import time

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from treeweave.functions.linediff import _few_edits, _halved, common_count, common_pairs, hunks, split_lines
from treeweave.operators import history, snapshots
from treeweave.operators.graph import CommitGraph, commit_graph
from treeweave.session import shared_dir


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def apply(old: bytes, patch: str) -> bytes:
    """Apply unified hunks."""
    lines, out, at = split_lines(old), [], 0
    rows = patch.split("\n")[:-1]
    k = 0
    while k < len(rows):
        start, count = re.match(r"@@ -(\d+)(?:,(\d+))? \+", rows[k]).groups()
        start, count = int(start), 1 if count is None else int(count)
        begin = start - 1 if count else start
        out += lines[at:begin]
        at = begin
        k += 1
        while k < len(rows) and not rows[k].startswith("@@"):
            row = rows[k]
            open_end = k + 1 < len(rows) and rows[k + 1].startswith("\\")
            body = row[1:].encode() + (b"" if open_end else b"\n")
            if row[0] in " -":
                assert lines[at] == body
                at += 1
            if row[0] in " +":
                out.append(body)
            k += 2 if open_end else 1
    return b"".join(out + lines[at:])


LINES = st.lists(st.sampled_from(["a", "b", "c", "", "dd"]), max_size=12)


@settings(max_examples=300, deadline=None)
@given(LINES, LINES, st.booleans(), st.booleans(), st.integers(0, 3))
def test_diff_is_minimal_and_applies(a, b, end_a, end_b, context):
    old = "\n".join(a).encode() + (b"\n" if end_a and a else b"")
    new = "\n".join(b).encode() + (b"\n" if end_b and b else b"")
    x, y = split_lines(old), split_lines(new)
    pairs = common_pairs(x, y)
    assert all(x[i] == y[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(pairs) == lcs(x, y) == common_count(x, y)
    text, shared = hunks(old, new, context)
    assert shared == len(pairs) and apply(old, text) == new


def test_large_diff_is_quick():
    rng = random.Random(3)
    a = [b"%d\n" % rng.randrange(9000) for _ in range(9000)]
    b = a[3000:6000] + [b"%d\n" % rng.randrange(9000) for _ in range(3000)] + a[:3000]
    assert len(common_pairs(a, b)) == common_count(a, b) >= 3000


@pytest.mark.skipif(shutil.which("git") is None, reason="needs git")
@pytest.mark.parametrize("context", [0, 1, 3])
def test_hunks_equal_those_of_git(tmp_path, context):
    cases = [
        ("a\nb\nc\n", "a\nx\nc\n"), ("", "a\nb"), ("a\nb", ""), ("a\n", "a"), ("1\n2\n3\n4\n5\n6\n7\n8\n9\n", "0\n1\n2\n3\n4\n5\n6\n7\n8\n"),
        ("1\n2\n3\n4\n5\n6\n7\n8\n9\n10\n11\n12\n", "x\n2\n3\n4\n5\n6\n7\n8\ny\n10\n11\nz\n"),
    ]
    for old, new in cases:
        (tmp_path / "o").write_text(old)
        (tmp_path / "n").write_text(new)
        shown = subprocess.run(
            ["git", "diff", "--no-index", f"-U{context}", "o", "n"], cwd=tmp_path, capture_output=True, text=True
        ).stdout
        want = re.sub(r"(?m)^(@@ [^@]* @@).*$", r"\1", shown[shown.index("@@"):])
        assert hunks(old.encode(), new.encode(), context)[0] == want, (old, new)


def tree(spark, rows):
    return spark.createDataFrame([("r", p, bytearray(c)) for p, c in rows], "repo_url string, path string, content binary")


def test_patches(spark):
    base = tree(spark, [("same", b"x\n"), ("mod", b"a\nb\n"), ("gone", b"1\n2"), ("bin", b"a\0"), ("odd", b"\xff\n")])
    head = tree(spark, [("same", b"x\n"), ("mod", b"a\nc\n"), ("new", b"n\n"), ("empty", b""), ("bin", b"b\0"), ("odd", b"\xff\nz\n")])
    got = {r.path: r for r in snapshots.unified_patch(base, head).collect()}
    assert set(got) == {"mod", "gone", "bin", "odd", "new", "empty"}
    assert got["mod"].patch == (
        "diff --git a/mod b/mod\nindex 422c2b7..0f7bc76 100644\n--- a/mod\n+++ b/mod\n@@ -1,2 +1,2 @@\n a\n-b\n+c\n"
    )
    assert got["gone"].patch.endswith("--- a/gone\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-1\n-2\n\\ No newline at end of file\n")
    assert got["new"].patch.endswith("--- /dev/null\n+++ b/new\n@@ -0,0 +1 @@\n+n\n")
    assert got["empty"].patch == "diff --git a/empty b/empty\nnew file mode 100644\nindex 0000000..e69de29\n"
    assert got["bin"].patch.endswith("Binary files a/bin and b/bin differ\n")
    assert got["odd"].patch.endswith("@@ -1 +1,2 @@\n [binary]+z\n")
    assert [(got[p].insertions, got[p].deletions) for p in ("mod", "gone", "new", "empty", "bin", "odd")] == [
        (1, 1), (0, 2), (1, 0), (0, 0), (0, 0), (1, 0)
    ]
    stats = snapshots.diff_stats(base, head).first()
    assert (stats.files_changed, stats.insertions, stats.deletions) == (6, 3, 3)


def test_patches_apply_to_the_given_tables(spark):
    from treeweave.plans.history_queries import _base_head

    base, head = _base_head(spark, "/root/testdata/sf0.001")
    old = {(r.repo_url, r.path): bytes(r.content) for r in base.collect()}
    new = {(r.repo_url, r.path): bytes(r.content) for r in head.collect()}
    rows = snapshots.unified_patch(base, head).collect()
    assert {(r.repo_url, r.path) for r in rows} == {k for k in old.keys() | new.keys() if old.get(k) != new.get(k)}
    for r in rows:
        key = (r.repo_url, r.path)
        at = r.patch.find("@@ -")
        assert apply(old.get(key, b""), r.patch[at:] if at >= 0 else "") == new.get(key, b"")
        lines = lambda data: len(split_lines(data))
        assert r.insertions - r.deletions == lines(new.get(key, b"")) - lines(old.get(key, b""))


def graph(spark, edges, times=None):
    """edges: child -> parents."""
    shas = sorted(set(edges) | {p for ps in edges.values() for p in ps})
    commits = spark.createDataFrame(
        [("r", s, "au", "su", (times or {}).get(s, i)) for i, s in enumerate(shas)],
        "repo_url string, sha string, author string, summary string, committed_at bigint",
    )
    parents = spark.createDataFrame(
        [("r", c, o, p) for c, ps in edges.items() for o, p in enumerate(ps)],
        "repo_url string, sha string, parent_ord int, parent_sha string",
    )
    return commits, parents


def brute_bases(edges, a, b):
    def up(x):
        seen, todo = set(), [x]
        while todo:
            s = todo.pop()
            if s not in seen:
                seen.add(s)
                todo += edges.get(s, [])
        return seen

    common = up(a) & up(b)
    return {c for c in common if not any(c != d and c in up(d) for d in common)}


def test_merge_bases_of_random_graphs(spark):
    rng = random.Random(11)
    edges = {}
    for i in range(1, 60):
        count = min(i, rng.choice([1, 1, 1, 2, 2, 3]))
        edges[f"c{i:02}"] = rng.sample([f"c{j:02}" for j in range(max(0, i - 8), i)], count)
    commits, parents = graph(spark, edges)
    shas = [f"c{i:02}" for i in range(60)]
    pairs = [(rng.choice(shas), rng.choice(shas)) for _ in range(60)]
    table = spark.createDataFrame([("r", a, b) for a, b in pairs], "repo_url string, base_sha string, head_sha string")
    several = 0
    for row in history.merge_bases(table, commits, parents).collect():
        want = brute_bases(edges, row.base_sha, row.head_sha)
        several += len(want) > 1
        assert row.merge_base == max(want, default=None), (row, want)
    assert several > 0


def test_merge_base_of_unrelated_and_criss_cross(spark):
    edges = {"b": ["a"], "c": ["a"], "d": ["b", "c"], "e": ["c", "b"], "y": ["x"]}
    commits, parents = graph(spark, edges, {"b": 50, "c": 9})
    table = spark.createDataFrame([("r", "d", "e"), ("r", "d", "y"), ("r", "d", "d"), ("r", "a", "d")], "repo_url string, base_sha string, head_sha string")
    got = {(r.base_sha, r.head_sha): r.merge_base for r in history.merge_bases(table, commits, parents).collect()}
    assert got == {("d", "e"): "b", ("d", "y"): None, ("d", "d"): "d", ("a", "d"): "a"}


def test_deep_history(spark):
    """A long chain takes a logarithmic number of rounds."""
    n = 5000
    edges = {f"m{i:05}": [f"m{i - 1:05}"] for i in range(1, n)}
    edges["f0"] = ["m02500"]
    edges["f1"] = ["f0"]
    commits, parents = graph(spark, edges)
    table = spark.createDataFrame([("r", f"m{n - 1:05}", "f1")], "repo_url string, base_sha string, head_sha string")
    assert history.merge_bases(table, commits, parents).first().merge_base == "m02500"


def test_merge_bases_read_nothing_behind_the_meeting_point(spark, tmp_path):
    """A history of many merges far behind the fork: its edges may as well be gone."""
    edges, times = {"m000": []}, {"m000": 0}
    for i in range(1, 120):
        edges[f"m{i:03}"] = [f"m{i - 1:03}", f"s{i:03}"]
        edges[f"s{i:03}"] = [f"m{max(i - 3, 0):03}"]
        times[f"m{i:03}"], times[f"s{i:03}"] = i * 100_000, i * 100_000 - 50_000
    edges |= {"f0": ["m110"], "f1": ["f0", "m111"]}
    times |= {"f0": 11_000_050, "f1": 11_100_050}
    commits, parents = graph(spark, edges, times)
    pairs = [("m119", "f1"), ("f1", "m112"), ("f0", "m119")]
    table = spark.createDataFrame([("r", a, b) for a, b in pairs], "repo_url string, base_sha string, head_sha string")
    commit_graph(commits, parents).write(str(tmp_path / "g"))
    whole = CommitGraph.read(spark, str(tmp_path / "g"))
    late = CommitGraph(whole.nodes, whole.sides.where("generation > 9000000"))
    assert late.sides.count() < whole.sides.count() / 3
    for stored in (whole, late):
        got = {(r.base_sha, r.head_sha): r.merge_base for r in history.merge_bases(table, commits, parents, stored).collect()}
        assert got == {("m119", "f1"): "m111", ("f1", "m112"): "m111", ("f0", "m119"): "m110"}


def test_generations_where_clocks_disagree(spark):
    rng = random.Random(4)
    edges = {f"c{i:02}": rng.sample([f"c{j:02}" for j in range(max(0, i - 6), i)], min(i, rng.choice([1, 1, 2]))) for i in range(1, 40)}
    commits, parents = graph(spark, edges, {f"c{i:02}": rng.choice([5, 5, 100, rng.randrange(200)]) for i in range(40)})
    made = commit_graph(commits.where("sha <> 'c07'"), parents)
    generation = {r.sha: r.generation for r in made.nodes.collect()}
    assert len(generation) == 40 and all(generation[c] > generation[p] for c, ps in edges.items() for p in ps)
    line = {}
    for r in made.nodes.collect():
        line.setdefault(r.chain, []).append((r.place, r.generation))
    assert all([p for p, _ in sorted(v)] == list(range(len(v))) and sorted(g for _, g in v) == [g for _, g in sorted(v)] for v in line.values())


def test_references(spark):
    commits, _ = graph(spark, {"abcdef1234": ["abcdef9999"], "1234567aaa": []})
    refs = spark.createDataFrame(
        [("r", "refs/heads/main", "m"), ("r", "refs/remotes/origin/dev", "d"), ("r", "refs/tags/v1", "t"), ("r", "v1", "x"), ("r", "HEAD", "h")],
        "repo_url string, ref_name string, target_sha string",
    )
    names = spark.createDataFrame([("r", n) for n in ("main", "dev", "v1", "HEAD", "1234567", "abcdef1", "abcdef", "nope", "1234567AAA")], "repo_url string, name string")
    got = {r.name: r.sha for r in history.resolve_refs(names, refs, commits).collect()}
    assert got == {
        "main": "m", "dev": "d", "v1": "x", "HEAD": "h", "1234567": "1234567aaa", "abcdef1": "abcdef1234", "abcdef": None, "nope": None,
        "1234567AAA": "1234567aaa",
    }
    wanted = spark.createDataFrame([("r", "main"), ("r", "gone"), ("r", None), ("r", "refs/tags/v1")], "repo_url string, branch string")
    heads = {r.branch: r.head_sha for r in history.branch_heads(wanted, refs).collect()}
    assert heads == {"main": "m", "gone": "h", None: "h", "refs/tags/v1": "t"}


def test_pull_request_report(spark):
    commits, parents = graph(spark, {"b": ["a"], "p": ["a"]})
    refs = spark.createDataFrame(
        [("r", "refs/remotes/origin/main", "b"), ("r", "refs/pull/7/head", "p"), ("q", "refs/pull/7/head", "z")],
        "repo_url string, ref_name string, target_sha string",
    )
    trees = spark.createDataFrame(
        [("r", "a", "f", bytearray(b"1\n")), ("r", "b", "f", bytearray(b"2\n")), ("r", "p", "f", bytearray(b"1\n3\n"))],
        "repo_url string, commit_sha string, path string, content binary",
    )
    numbers = spark.createDataFrame([("r", 7), ("r", 8), ("q", 7)], "repo_url string, number int")
    rows = history.pull_request_report(numbers, refs, commits, parents, trees).collect()
    text = {(r.repo_url, r.number, r.section): r.text for r in rows}
    assert text["r", 7, 0] == "# Pull Request #7\n\nBase: main (a)\nHead: PR #7 (p)\n\nFiles changed: 1\nInsertions: 1\nDeletions: 0\n\n"
    assert text["r", 7, 1].endswith("@@ -1 +1,2 @@\n 1\n+3\n")
    assert text["q", 7, -1].startswith("Could not find any base branch") and text["r", 8, -1].startswith("Failed to find PR ref")
    assert len(rows) == 4


def test_reports_from_stored_contents(spark, tmp_path):
    """Each content is stored once; where it lies in buckets by blob id, fetching it shuffles the wanted ids alone."""
    trees = spark.createDataFrame(
        [("r", c, f"same{i}", bytearray(b"x\n")) for c in "abp" for i in range(20)]
        + [("r", "a", "f", bytearray(b"1\n")), ("r", "b", "f", bytearray(b"2\n")), ("r", "p", "f", bytearray(b"1\n3\n")), ("r", "p", "g", None)]
        + [("s", "a", "h", bytearray(b"1\n")), ("s", "b", "h", bytearray(b"x\n"))],
        "repo_url string, commit_sha string, path string, content binary",
    )
    files = snapshots.with_blob_id(trees)
    contents = snapshots.write_contents(files, "contents_of_reports", str(tmp_path / "contents"))
    try:
        assert sorted(bytes(r.content) for r in contents.collect()) == [b"1\n", b"1\n3\n", b"2\n", b"x\n"]
        pairs = spark.createDataFrame(
            [(r, a, b, a, b) for r in "rs" for a, b in (("a", "b"), ("a", "p"), ("b", "a"))] + [("r", "a", "zz", "a", None)],
            "repo_url string, base string, head string, base_sha string, head_sha string",
        )
        whole = history.compare_report(pairs, trees).collect()
        stored = history.compare_report(pairs, files.drop("content"), contents=contents).collect()
        assert sorted(map(repr, stored)) == sorted(map(repr, whole)) and any("+3" in r.text for r in stored)
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            wanted = files.where("path = 'f'").select("blob_id")
            found = snapshots.fetched(contents, wanted)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert found.count() == 3
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        lines = plan[: plan.index("== Initial Plan ==")].splitlines() if "== Initial Plan ==" in plan else plan.splitlines()
        scan = next(i for i, line in enumerate(lines) if "FileScan" in line and "contents_of_reports" in line)
        depth = len(lines[scan]) - len(lines[scan].lstrip(" :+-*()0123456789"))
        above = [line for line in lines[:scan] if len(line) - len(line.lstrip(" :+-*()0123456789")) < depth]
        assert above and not any("Exchange" in line for line in above), plan
    finally:
        spark.sql("DROP TABLE contents_of_reports")


def test_changes_in_every_second_line_are_quick():
    old = [b"line %d\n" % i for i in range(60_000)]
    new = [line if i % 2 else b"new %d\n" % i for i, line in enumerate(old)]
    started = time.perf_counter()
    pairs = common_pairs(old, new)
    assert time.perf_counter() - started < 0.5
    assert pairs == [(i, i) for i in range(1, 60_000, 2)] and common_count(old, new) == 30_000


@pytest.mark.parametrize("most", [0, 1, 3, 50])
def test_few_edits_and_halving_find_as_much(most):
    rng = random.Random(most)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(20))] for _ in range(2))
        few, many = _few_edits(a, b, most), _halved(a, b)
        edits = len(a) + len(b) - 2 * len(many)
        assert (few is None) == (edits > most)
        for pairs in [many] if few is None else [few, many]:
            assert len(pairs) == len(many) and all(a[i] == b[j] for i, j in pairs)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_equal_folders_are_not_opened(spark):
    """One change among 1,000 folders: the rows of all other folders, and their files, can be taken away."""
    paths = [f"d{i % 10}/e{i // 10 % 10}/f{i // 100}/x{j}" for i in range(1000) for j in range(2)] + ["top", "d1/mid"]
    old = spark.createDataFrame([("r", p, f"b{n}") for n, p in enumerate(paths)], "repo_url string, path string, blob_id string")
    hit = "d3/e4/f7/x1"
    new = old.withColumn("blob_id", F.when(F.col("path") == hit, "changed").otherwise(F.col("blob_id")))
    folders = [snapshots.folder_digests(tree).cache() for tree in (old, new)]
    assert folders[0].count() == 1 + 10 + 100 + 1000
    differ = sorted(r.folder for r in snapshots.changed_folders(*folders).collect())
    assert differ == ["", "d3", "d3/e4", "d3/e4/f7"]
    # Siblings of the path stay, as their digests are compared; nothing below them is read, and no file of theirs.
    read = F.coalesce(F.col("parent").isin(differ), F.lit(True))
    poorer = [folders[0].where(read), folders[1].where(read)]
    assert poorer[0].count() == 1 + 3 * 10
    beside = F.col("path").rlike("^(top|d3/e4/f7/x.)$")
    got = snapshots.snapshot_diff_by_folders(old.where(beside), new.where(beside), *poorer).collect()
    assert [(r.path, r.status, r.new_blob) for r in got] == [(hit, "modified", "changed")]


@pytest.mark.parametrize("seed", [1, 2])
def test_folders_and_whole_trees_differ_alike(spark, seed):
    rng = random.Random(seed)
    parts = ["a", "b", "é", "", "a b"]

    def tree():
        rows = {(rng.choice("rs"), "/".join(rng.choice(parts) for _ in range(rng.randrange(1, 5)))): f"b{rng.randrange(3)}" for _ in range(60)}
        return spark.createDataFrame([(*k, v) for k, v in rows.items()], "repo_url string, path string, blob_id string")

    trees = [tree(), tree()]
    told = lambda df: sorted(map(str, df.select("repo_url", "path", "status", "old_blob", "new_blob").collect()))
    want = told(snapshots.snapshot_diff(*trees))
    assert want and told(snapshots.snapshot_diff_by_folders(*trees, *[snapshots.folder_digests(t) for t in trees])) == want
    empty = trees[0].limit(0)
    assert told(snapshots.snapshot_diff_by_folders(empty, empty, *[snapshots.folder_digests(empty)] * 2)) == []


def versions_and_pairs(spark, versions=40):
    """Versions of a long file, one after the other put in front by a line, and pairs that have them whole, changed and several times."""
    draw = random.Random(5)
    lines = [f"{draw.getrandbits(256):064x}\n" for _ in range(300)]
    text = lambda n: bytearray("".join([f"line {n}\n", *lines[n:]]).encode())
    trees = spark.createDataFrame(
        [("r", f"c{n:02d}", "a/f", text(n)) for n in range(versions)] + [("r", "c00", "g", bytearray(b"x\n")), ("r", "c01", "n", None)],
        "repo_url string, commit_sha string, path string, content binary",
    )
    asked = [("", f"c{n:02d}") for n in range(versions)] + [(f"c{n:02d}", f"c{n + 1:02d}") for n in range(versions - 1)] + [("c00", "c01")]
    pairs = spark.createDataFrame([("r", a, b, a, b) for a, b in asked], "repo_url string, base string, head string, base_sha string, head_sha string")
    return trees, pairs, sum(300 * 65 for a, _ in asked if not a)


def test_reports_write_less_than_their_texts(spark):
    """Versions of a file are compressed side by side, so what a report writes on the way is a small part of its texts."""
    trees, pairs, size = versions_and_pairs(spark)
    folder = pathlib.Path(shared_dir(spark))
    written = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = written()
    report = history.compare_report(pairs, trees)
    assert report.where("section = 1").agg(F.sum(F.length("text"))).first()[0] > 0.9 * size
    assert written() - before < size / 4


def test_reports_of_files_and_changes_with_many_rows(spark, monkeypatch):
    """Files in parts, changes in several lists, and files looked up one by one or taken with all that is stored give the same reports."""
    trees, pairs, _ = versions_and_pairs(spark, 12)
    found = []
    for group, few in ((1_000, 20_000), (1_000, 0), (1, 0), (1, 20_000)):
        monkeypatch.setattr(history, "GROUP", group)
        monkeypatch.setattr(history, "FEW", few)
        found.append(sorted(map(repr, history.compare_report(pairs.unionByName(pairs.limit(5)), trees).collect())))
    assert found[0] == found[1] == found[2] == found[3] and len(found[0]) > 40
