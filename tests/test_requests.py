"""Addresses, validation, routes and keys."""

import hashlib

import pytest

from treeweave.operators import catalog, requests as req

HUB, LAB = "https://github.com/o/r", "https://gitlab.com/"
ADDRESSES = [
    (HUB, ("o", "r", None, None, "Repository", HUB)),
    (HUB + "///", ("o", "r", None, None, "Repository", HUB)),
    ("  github.com/o/r\n", ("o", "r", None, None, "Repository", HUB)),
    ("http://github.com/o/r/tree/main", ("o", "r", "main", None, "Tree", HUB)),
    (HUB + "/tree/feature/x/src/core", ("o", "r", "feature/x", "src/core", "Tree", HUB)),
    (HUB + "/blob/main/README.md", ("o", "r", "main", "README.md", "Blob", HUB)),
    (HUB + "/blob/a.git/b", ("o", "r", "a.git/b", None, "Blob", HUB)),
    (HUB + "/tree/docs", ("o", "r", "", "docs", "Tree", HUB)),
    (HUB + "/tree/v1.0/x", ("o", "r", "", "v1.0/x", "Tree", HUB)),
    (HUB + "/commit/abc/x", ("o", "r", "abc", None, "Commit", HUB)),
    (HUB + "/compare/a...b/c", ("o", "r", "a...b/c", None, "Compare", HUB)),
    (HUB + "/pull/7", None),
    (HUB + "/tree", None),
    ("https://github.com/o", None),
    ("https://gist.github.com/abc", ("anonymous", "abc", None, None, "Gist", "https://gist.github.com/abc")),
    ("https://gist.github.com/u/abc/x", ("u", "abc", None, None, "Gist", "https://gist.github.com/u/abc")),
    ("gist.github.com/u/abc", None),
    ("https://raw.githubusercontent.com/o/r/main", ("o", "r", "main", None, "Raw", HUB)),
    ("https://raw.githubusercontent.com/o/r/main/a/b.py", ("o", "r", "main", "a/b.py", "Raw", HUB)),
    ("https://raw.githubusercontent.com/o/r", None),
    (LAB + "g/s/p", ("g", "p", None, None, "GitLabRepository", LAB + "g/s/p")),
    (LAB + "g", None),
    (LAB + "g/s/p/-/tree/main/lib/x", ("g", "p", "main", "lib/x", "GitLabTree", LAB + "g/s/p")),
    (LAB + "g/p/-/blob/main", None),
    (LAB + "g/p/-/blob/main/a", ("g", "p", "main", "a", "GitLabBlob", LAB + "g/p")),
    (LAB + "g/p/-/merge_requests/12/diffs", ("g", "p", "12", None, "GitLabMergeRequest", LAB + "g/p")),
    (LAB + "g/p/-/issues/1", None),
    (LAB + "-/tree/main", None),
    ("o/r", None),
    ("", None),
]


def test_addresses(spark):
    table = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(ADDRESSES)], "i int, source string")
    for row in req.classify_sources(table).collect():
        want = ADDRESSES[row.i][1]
        assert (tuple(row.parsed) if row.parsed else None) == want, row.source


def test_normal_form(spark):
    rows = [
        (HUB + "/tree/dev/src", "main", None), (HUB + "/tree/dev/src", None, "docs"), ("o/r", "b", "p"), ("-o/r", None, None),
        ("ftp://x/y", None, None), ("a/b/c", None, None),
    ]
    table = spark.createDataFrame(rows, "source string, branch string, path string")
    got = [(r.url, r.branch, r.path) for r in req.normalize_sources(table).collect()]
    assert got == [
        (HUB, "main", "src"), (HUB, "dev", "docs"), (HUB, "b", "p"), ("-o/r", None, None), ("ftp://x/y", None, None), ("a/b/c", None, None)
    ]
    other = [(r.branch, r.path) for r in req.normalize_sources(table, explicit_wins=False).collect()]
    assert other[:2] == [("dev", "src"), ("dev", "src")]


def test_validation(spark):
    rows = [
        (HUB, "repository", None, None), ("", "repository", None, "empty_url"), ("x", "repository", None, "invalid_url"),
        ("https://github.com/-o/r", "repository", None, "invalid_name"), ("https://github.com/" + "o" * 40 + "/r", "repository", None, "invalid_name"),
        ("https://github.com/o/é.r", "repository", None, None), (HUB, "commit", "abcdef", "invalid_sha"), (HUB, "commit", "ABCDEF1", None),
        (HUB, "pull", "4294967295", None), (HUB, "pull", "4294967296", "invalid_number"), (HUB, "pull", "+1", None), (HUB, "pull", "", "invalid_number"),
        (HUB, "pull", "0" * 30 + "7", None), (HUB, "compare", "a..b", None), (HUB, "compare", "...b", "invalid_compare"),
    ]
    table = spark.createDataFrame([(s, o, a, None, None, w) for s, o, a, w in rows], "source string, operation string, argument string, branch string, path string, want string")
    checked = req.validate_requests(table)
    for row in checked.collect():
        assert row.reason == row.want, row
    good, bad = req.split_valid(checked)
    assert good.count() + bad.count() == len(rows)


@pytest.mark.parametrize("spec,strict,loose", [
    ("a...b", ("a", "b"), ("a", "b")), ("a..b", ("a", "b"), ("a", "b")), ("a..b...c", ("a..b", "c"), ("a..b", "c")), ("...b", None, ("", "b")),
    ("a..", None, ("a", "")), ("a", None, None), ("a....b", ("a", ".b"), ("a", ".b")),
])
def test_compare(spark, spec, strict, loose):
    table = spark.createDataFrame([(spec,)], "spec string")
    for allow, want in ((False, strict), (True, loose)):
        row = req.compare_pairs(table, allow).first()
        assert (row.base, row.head) == (want or (None, None))


def test_patterns_and_prefix(spark):
    table = spark.createDataFrame([(1, " a , ,b,", "x", None), (2, None, None, "sub"), (3, "", "a/../b", "sub")], "request_id int, include_csv string, path string, subpath string")
    assert sorted((r.request_id, r.pattern) for r in req.pattern_rows(table).collect()) == [(1, "a"), (1, "b")]
    assert [r.prefix for r in req.safe_path_prefix(table).collect()] == ["x", "sub", None]


def test_keys(spark):
    table = spark.createDataFrame([("u", "x", None, None, 1), ("u", None, "x", None, 0), ("u", None, None, None, 2)], "url string, branch string, preset string, path string, ts_sec int")
    keys = [r.request_key for r in req.with_request_key(table).collect()]
    assert keys[0] == keys[1] == hashlib.sha256(b"u:x").hexdigest() and keys[2] == hashlib.sha256(b"u").hexdigest()
    work = req.work_list(table.withColumn("request_id", table.ts_sec)).collect()
    assert sorted((r.requests, r.first_seen, r.branch, r.preset) for r in work) == [(1, 2, None, None), (2, 0, None, "x")]


def test_dispatch(spark):
    rows = ["o/r", "o/r/compare/a...b/c", HUB + "/compare/a..b", LAB + "g/p", "./x", "/abs/path", "o//r", "https://example.com/x"]
    got = [(r.target, r.url_type, r.branch) for r in req.dispatch_sources(spark.createDataFrame([(r,) for r in rows], "source string")).collect()]
    assert got == [
        ("github", "Repository", None), ("github", "Compare", "a...b/c"), ("github", "Compare", "a..b"), ("git_url", None, None),
        ("github", "Repository", None), ("local", None, None), ("local", None, None), ("local", None, None),
    ]


def test_purge_of_all_and_of_named_entries(spark):
    entries = spark.createDataFrame([("a", "u1"), ("b", "u2")], "cache_key string, url string")
    assert catalog.purge_entries(entries).collect() == [] and catalog.purge_entries(entries).columns == entries.columns
    left = catalog.purge_entries(entries, spark.createDataFrame([("a",)], "cache_key string"))
    assert [tuple(r) for r in left.collect()] == [("b", "u2")]
