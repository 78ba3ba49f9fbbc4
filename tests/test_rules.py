"""Path patterns, presets and the inclusion decision."""

import itertools

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from treeweave.functions.globs import any_glob, any_include, glob_match, include_match, included_by_any, matches_any
from treeweave.operators import filters, rules
from treeweave.operators.filters import IngestOptions

GLOB_CASES = [
    ("*.rs", "main.rs", True), ("*.rs", "src/main.rs", True), ("src/*", "src/main.rs", True), ("*.rs", "main.py", False),
    ("target", "target/debug/main", True), ("bin/*", "binary.txt", True), ("build/*", "build.rs", True), ("bin/*", "bin", False),
    ("node_modules/*", "a/node_modules/x", False), ("cmake-build-*/*", "cmake-build-debug/x", False),
    ("[Dd]esktop.ini", "Desktop.ini", False), ("LICENSE*", "sub/LICENSE", False), (".env.*.local", ".env.prod.local", True),
    ("ab*ba", "aba", True), ("**/*.rs", "src/a.rs", False), ("*", "anything", True), ("/*", "a", True), ("*.env", "x/.env", True),
    ("credentials", "credentials/x", True), ("a/b", "a/b/c", True), ("a/b", "a/bc", False), ("*.tar.gz", "x.tar.gz", True),
    ("$R/*", "$R/x", True), ("x+y/*", "x+y/z", True), ("x+y/*", "xxy/z", False), ("*~", "a~", True), ("", "/x", True),
]


def python_glob(pattern: str, path: str) -> bool:
    if pattern.startswith("*."):
        return path.endswith(pattern[1:])
    if pattern.endswith("/*"):
        return path.startswith(pattern[:-2]) and len(path) > len(pattern) - 2
    if pattern.count("*") == 1:
        head, tail = pattern.split("*")
        return path.startswith(head) and path.endswith(tail)
    return path == pattern or path.startswith(pattern + "/")


def test_glob_cases(spark):
    table = spark.createDataFrame(GLOB_CASES, "pattern string, path string, want boolean")
    for row in table.withColumn("got", glob_match(F.col("pattern"), F.col("path"))).collect():
        assert row.got == row.want, row
        assert python_glob(row.pattern, row.path) == row.want, row
    one = spark.createDataFrame([(p,) for _, p, _ in GLOB_CASES], "path string")
    for pattern, path, want in GLOB_CASES:
        got = one.where(F.col("path") == path).select(matches_any([pattern], F.col("path"))).first()[0]
        assert got == want, (pattern, path)


@settings(max_examples=8, deadline=None)
@given(
    st.lists(st.text("ab*./~", min_size=1, max_size=5), min_size=1, max_size=12),
    st.lists(st.text("ab./~", min_size=1, max_size=6), min_size=1, max_size=40),
)
def test_compiled_rules_equal_one_by_one(spark, patterns, paths):
    table = spark.createDataFrame([(p,) for p in paths], "path string")
    got = [r[0] for r in table.select(matches_any(patterns, F.col("path"))).collect()]
    assert got == [any(python_glob(p, path) for p in patterns) for path in paths]
    known = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    kept = sorted(r.path for r in filters.exclude_by_table(table, known).collect())
    assert kept == sorted(p for p in paths if not any(python_glob(q, p) for q in patterns))


def test_lists_and_tables_agree_on_null_and_odd_paths(spark):
    patterns = ["*", "/*", "*.md", "src/*", "LICENSE", "a*b", "x/y", "*.tar.gz", "docs"]
    table = spark.createDataFrame([(p,) for p in [None, "", "a", "a/b", "src", "src/x", "LICENSE/z", "ab", "x/y/z", "k.tar.gz", "docs"]], "path string")
    for size in range(len(patterns)):
        chosen = patterns[size:]
        known = spark.createDataFrame([(p,) for p in chosen], "pattern string")
        listed = sorted(str(r.path) for r in filters.exclude(table, chosen).collect())
        assert listed == sorted(str(r.path) for r in filters.exclude_by_table(table, known).collect())
        assert "None" in listed


def test_include_modes(spark):
    cases = [
        ("src/", "src/a", True), ("src/", "srcfile", True), ("src/", "src", False), ("*.rs", "deep/a.rs", True),
        ("f*", "deep/f1", True), ("docs/*", "docs/a", True), ("main.rs", "src/main.rs", True), ("src/main", "src/main/x", True),
    ]
    table = spark.createDataFrame(cases, "pattern string, path string, want boolean")
    for row in table.withColumn("got", include_match(F.col("pattern"), F.col("path"))).collect():
        assert row.got == row.want, row
        single = spark.range(1).select(included_by_any([row.pattern], F.lit(row.path))).first()[0]
        assert single == row.want, row


def test_rule_counts():
    sizes = {name: len(patterns) for name, patterns in rules.CATEGORY_RULES.items()}
    assert sizes == dict(
        lock_files=15, dependencies=20, build_artifacts=26, ide_files=17, media_files=34, binary_files=21, documents=14,
        data_files=17, fonts=10, logs=8, cache=15, os_files=25, version_control=13, secrets=27,
    )
    assert len(rules.DEFAULT_PATTERNS) == 259
    assert [len(rules.PRESET_PATTERNS[p]) for p in rules.PRESETS] == [0, 259, 269, 119]
    assert {"*.lock", "node_modules/*"} <= set(rules.DEFAULT_PATTERNS)
    assert "*.md" in rules.PRESET_PATTERNS["code-only"]
    assert rules.category_patterns(["nonsense"]) == []


@pytest.mark.parametrize("text,raw,want", [
    ("RAW", None, "raw"), ("Code_Only", None, "code-only"), ("codeonly", None, "code-only"), ("code-only", None, "code-only"),
    ("Minimal", None, "minimal"), ("other", None, "standard"), (None, None, "standard"), ("minimal", True, "raw"),
])
def test_preset_names(spark, text, raw, want):
    row = spark.range(1).select(rules.preset_name(F.lit(text).cast("string"), F.lit(raw).cast("boolean"))).first()
    assert row[0] == want


def test_golden_preset_numbers(spark):
    """Numbers of an independent rendering of the rules."""
    from treeweave.plans.views import load

    files = load(spark, "/root/testdata/sf0.01", "tracked")
    got = {
        r.preset: (r.n, r.b)
        for r in rules.preset_filter(files).groupBy("preset").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()
    }
    assert got == {
        "raw": (934, 2295388), "standard": (418, 1056816), "code-only": (315, 807629), "minimal": (784, 1911539)
    }


def test_filter_stats_add_up(spark):
    from treeweave.operators.stats import filter_stats
    from treeweave.plans.views import load

    files = load(spark, "/root/testdata/sf0.001", "sized_files")
    for row in filter_stats(files, IngestOptions(preset="standard")).collect():
        assert row.included_files + row.excluded_files == row.total_files
        assert row.included_size + row.excluded_size == row.total_size


def test_status_and_duplicates(spark):
    rows = [("r1", "a", "tracked", 1), ("r1", "b", "untracked", 1), ("r2", "c", "untracked", 1), ("r1", "a", "untracked", 1), ("r1", "d", "ignored", 1)]
    files = spark.createDataFrame(rows, "repo_url string, path string, git_status string, size bigint")
    born = spark.createDataFrame([("r1",)], "repo_url string")
    kept = filters.by_status(files, False, born)
    assert sorted((r.repo_url, r.path) for r in kept.collect()) == [("r1", "a"), ("r2", "c")]
    direct = IngestOptions(preset="raw", include_untracked=True, indexed=False)
    assert sorted(r.path for r in filters.ingestable(files, direct).collect()) == ["a", "b", "c", "d"]
    assert [r.path for r in filters.ingestable(files, IngestOptions(preset="raw")).collect()] == ["a"]


def test_spelled_options():
    combos = itertools.product([None, "minimal"], [True, False])
    assert [len(rules.effective_patterns(["x"], p, d)) for p, d in combos] == [260, 1, 120, 120]


LISTS = [["*"], ["/*"], [""], ["*.rs"], ["src/"], ["src"], ["src/*", "*.py"], ["*.tar.gz"], ["a*b"], ["*/x*"], ["docs/a.md"], ["*.x/"], ["*."], ["é*"], ["s*c"]]
PATHS = ["src/a.rs", "src", "srcs/b.py", "a.tar.gz", "ab", "axb", "docs/a.md", "docs/a.md/z", "x", "n/ab", "v.x/y", "", "k.", "ému", "deep/src/é.py", "src/"]


def test_lists_of_requests_meet_each_path_once(spark):
    """Hits by index against pattern by pattern; lists that several specifications have are one list with one hit per path."""
    from treeweave.operators.filters import list_hits, pattern_lists

    specs = spark.createDataFrame([(f"i{n}", ps, f"e{n}", ps) for n, ps in enumerate(LISTS)] * 3 + [(None, [], None, None)],
                                  "include_id string, include array<string>, exclude_id string, exclude array<string>")
    lists = pattern_lists(specs)
    assert lists.count() == 2 * len(LISTS)
    pairs = lists.select("list_id").crossJoin(spark.createDataFrame([(p,) for p in PATHS] + [(None,)], "path string"))
    got = sorted((r.list_id, r.path) for r in list_hits(pairs, lists).collect())
    path = F.col("path")
    plain = specs.where("include_id IS NOT NULL").distinct().crossJoin(spark.createDataFrame([(p,) for p in PATHS], "path string"))
    rows = plain.select("include_id", "exclude_id", "path", any_include(F.col("include"), path).alias("i"), any_glob(F.col("exclude"), path).alias("e")).collect()
    assert got == sorted([(r.include_id, r.path) for r in rows if r.i] + [(r.exclude_id, r.path) for r in rows if r.e])
