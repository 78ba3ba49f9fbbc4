"""Near copies, benchmark windows and repeated passages against brute force, and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from odd import base_rows, empty_docs, lower_ascii, odd_docs, ranked, spaced

from pyspark.sql import functions as F

import treeweave.llm.near_duplicates as near_duplicate_module
from treeweave.llm.contamination import PatternTables, benchmark_hits, without_benchmark
from treeweave.llm.near_duplicates import components, near_duplicates, without_near_duplicates
from treeweave.llm.passages import PieceAutomaton, repeated_passages
from treeweave.llm.support import fold


def brute_near(rows, percent, size=5):
    """(id, set size, component) per row; rows of one id are one document."""
    sets = []
    for doc, text in rows:
        words = spaced(lower_ascii(text or ""))
        sets.append((doc, {tuple(words[i:i + size]) for i in range(max(len(words) - size + 1, 1))} if words else set()))
    parent = {doc: doc for doc, _ in sets if doc is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in combinations([x for x in sets if x[0] is not None and x[1]], 2):
        if 100 * len(s & t) >= percent * len(s | t):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return ranked((d, len(s), None if d is None else root(d), d is not None and root(d) == d) for d, s in sets)


@pytest.mark.parametrize("percent", [85, 80, 60])
def test_near_copies_of_edited_texts(spark, percent):
    draw = random.Random(percent)
    rows = []
    for group in range(30):
        base = [f"g{group}w{i}" for i in range(draw.choice([4, 30, 120]))]
        for _ in range(draw.choice([1, 3, 12])):
            words = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 4])):
                words[draw.randrange(len(words))] = f"edit{draw.randrange(10**6)}"
            rows.append((len(rows) * 7 % 1009, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert ranked(near_duplicates(docs, percent=percent).collect()) == brute_near(rows, percent)


def test_large_groups_of_near_copies(spark):
    """More documents around one text than a node may hold, in several components."""
    draw = random.Random(5)
    rows = []
    for i in range(900):
        words = [f"w{j}" for j in range(80)]
        for _ in range(draw.randrange(6)):
            words[draw.randrange(80)] = f"e{i}-{draw.randrange(99)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert ranked(near_duplicates(docs, percent=85).collect()) == brute_near(rows, 85)


def test_chance_missed_at_every_depth():
    assert near_duplicate_module.chance_missed(80, 12, 3) == pytest.approx(2.1e-5, rel=0.05)
    assert all(near_duplicate_module.chance_missed(p, near_duplicate_module.TREES, d) < 5e-5 for p in (80, 85) for d in range(1, near_duplicate_module.DEPTH + 1))


def test_pairs_at_the_threshold_stay_together_to_the_last_level(spark):
    """Isolated pairs of similarity 0.8 followed down as those of large nodes are: all but about 1 in 20,000 share a node of the last level."""
    draw = np.random.default_rng(8)
    rows = []
    for pair in range(1000):
        words = draw.integers(0, 1 << 63, 450, dtype=np.uint64)
        for own in (words[:450], words[50:]):
            rows.append((pair, near_duplicate_module.sketch_of(np.concatenate([own, draw.integers(0, 1 << 63, 450 - len(own), dtype=np.uint64)])).tolist()))
    docs = spark.createDataFrame(rows, "pair long, sketch array<int>").repartition(8)
    trees = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(near_duplicate_module.TREES).cast("long")))
    nodes = docs.withColumn("node", trees)
    for level in range(near_duplicate_module.DEPTH):
        nodes = near_duplicate_module.branches(nodes, 80, *[1] * (level >= near_duplicate_module.FIRST_LEVELS))
    together = nodes.groupBy("node", "pair").count().where("count > 1").select("pair").distinct().count()
    assert together >= 999


def test_near_copies_of_odd_rows(spark):
    rows = [r[:2] for r in base_rows()]
    got = near_duplicates(odd_docs(spark), percent=80)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert ranked(got.collect()) == brute_near(rows, 80)
    assert near_duplicates(empty_docs(spark)).count() == 0
    docs = odd_docs(spark)
    left = without_near_duplicates(docs)
    assert left.columns == docs.columns
    check_one_row_per_group(rows, [tuple(r) for r in left.select("doc_id", "text").collect()], 80)
    assert without_near_duplicates(empty_docs(spark)).count() == 0


def check_one_row_per_group(rows, left, percent):
    """Of each group of linked rows exactly one is left, one with the smallest id; rows without words are all left."""
    groups = {}
    for (key, size, root, _), (doc, text) in zip(
        sorted(brute_near([(n, text) for n, (_, text) in enumerate(rows)], percent)), rows
    ):
        groups.setdefault(root if size else ("wordless", key), []).append((doc, text))
    rest = Counter(left)
    for group in groups.values():
        lowest = min((doc is None, doc or 0) for doc, _ in group)
        found = [r for r in set(group) if rest[r] and (r[0] is None, r[0] or 0) == lowest]
        assert found
        rest[found[0]] -= 1
    assert not +rest


def test_ids_that_repeat_with_texts_linked_elsewhere(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (3, a), (3, b), (8, b), (3, None), (9, "alone in the world")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(docs, percent=80)
    assert ranked(got.collect()) == brute_near(rows, 80)
    assert {(r["doc_id"], r["component_id"]) for r in got.collect()} == {(1, 1), (3, 1), (8, 1), (9, 9)}
    left = ranked(without_near_duplicates(docs).collect())
    assert left == ranked([(1, a), (3, b), (3, None), (9, "alone in the world")])


@pytest.mark.parametrize("seed", [1, 2])
def test_random_ids_with_repeats_and_nulls(spark, seed):
    draw = random.Random(seed)
    rows = []
    for group in range(40):
        base = [f"g{group}w{i}" for i in range(draw.choice([3, 30, 60]))]
        for _ in range(draw.choice([1, 2, 6])):
            words = list(base)
            for _ in range(draw.choice([0, 0, 1])):
                words[draw.randrange(len(words))] = f"edit{draw.randrange(10**6)}"
            rows.append((draw.choice([None, *range(60)]), draw.choice([" ".join(words)] * 9 + [None])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert ranked(near_duplicates(docs, percent=80).collect()) == brute_near(rows, 80)
    check_one_row_per_group(rows, [tuple(r) for r in without_near_duplicates(docs).collect()], 80)


def test_components_of_chains_and_stars(spark):
    draw = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(draw.randrange(500, 600), draw.randrange(500, 600)) for _ in range(70)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    want = sorted((i, root(i)) for i in parent if sum(root(j) == root(i) for j in parent) > 1)
    draw.shuffle(links)
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert sorted(tuple(r) for r in got.collect()) == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(text or ""))


def brute_hits(rows, items, window):
    patterns = []
    for item, text in items:
        words = bench_words(text)
        size = min(window, len(words))
        patterns += [(item, words[i:i + size]) for i in range(len(words) - size + 1 if words else 0)]
    out = []
    for doc, text in rows:
        words, hit, found = bench_words(text), set(), set()
        for item, p in patterns:
            for i in range(len(words) - len(p) + 1):
                if words[i:i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    found.add(item)
        out.append((doc, len(words), len(hit), sorted(str(f) for f in found if f is not None)))
    return ranked(out)


@pytest.mark.parametrize("block_windows", [100_000, 3])
def test_benchmark_windows(spark, block_windows):
    draw = random.Random(3)
    pool = ["a", "b", "c1", "é", "D"]
    texts = [" ".join(draw.choice(pool) for _ in range(draw.randrange(60))) for _ in range(80)]
    items = [(i, " ".join(draw.choice(pool) for _ in range(draw.choice([0, 1, 2, 4, 5, 9])))) for i in range(12)]
    items += [(None, "a b c1 a"), (3, "c1 c1, c1. C1"), (90, None), (91, texts[0])]
    rows = list(enumerate(texts)) + [(None, "a b c1 a"), (100, None), (101, "A-B c1_a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = benchmark_hits(docs, bench, window=4, block_windows=block_windows)
    assert ranked(got.select("doc_id", "hits.*").collect()) == brute_hits(rows, items, 4)


def test_benchmark_windows_of_odd_rows(spark):
    docs = odd_docs(spark)
    items = [(1, base_rows()[0][1]), (1, "one two"), (2, ""), (3, None)]
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = benchmark_hits(docs, bench, result="hits")
    assert ranked(got.select("doc_id", "hits.*").collect()) == brute_hits([r[:2] for r in base_rows()], items, 10)
    left = without_benchmark(docs, bench)
    assert left.columns == docs.columns
    assert left.count() == sum(n == 0 for _, _, n, _ in brute_hits([r[:2] for r in base_rows()], items, 10))
    none = bench.where("false")
    assert without_benchmark(docs, none).count() == docs.count()
    assert benchmark_hits(docs, none).where("hits.n_hit > 0 OR hits.n_words IS NULL").count() == 0
    assert without_benchmark(empty_docs(spark), bench).count() == 0


def test_shift_tables_skip_nothing():
    words = [w.encode() for w in "x a b c d x a b c x b c d".split()]
    tables = PatternTables(3, {(b"a", b"b", b"c"): ["1"], (b"b", b"c", b"d"): ["2"]})
    hit, found = bytearray(len(words)), set()
    tables.search(words, hit, found)
    assert bytes(hit) == bytes([0, 1, 1, 1, 1, 0, 1, 1, 1, 0, 1, 1, 1]) and found == {"1", "2"}


def brute_passages(rows, window):
    owners, out = {}, []
    for doc, text in rows:
        words = spaced(text)
        for i in range(len(words) - window + 1 if doc is not None else 0):
            key = tuple(words[i:i + window])
            owners[key] = min(owners.get(key, doc), doc)
    for doc, text in rows:
        words = spaced(text)
        gone = set()
        for i in range(len(words) - window + 1 if doc is not None else 0):
            if owners[tuple(words[i:i + window])] < doc:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return ranked(out)


@pytest.mark.parametrize("shard_bytes", [4 << 20, 2_000])
def test_repeated_passages(spark, shard_bytes):
    draw = random.Random(shard_bytes)
    shared = [[f"p{k}-{i}" for i in range(draw.choice([12, 20, 300]))] for k in range(8)] + [["the"] * 40]
    rows = []
    for i in range(120):
        words = [f"d{i}-{j}" for j in range(draw.randrange(30))]
        for _ in range(draw.randrange(4)):
            passage = draw.choice(shared)
            at = draw.randrange(len(words) + 1)
            begin = draw.randrange(len(passage))
            words[at:at] = passage[begin:begin + draw.choice([8, 12, 25, 400])]
        rows.append((draw.randrange(100), " ".join(words)))
    rows += rows[:5]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = repeated_passages(docs, window=12, phrase=4, shard_bytes=shard_bytes)
    assert ranked(got.drop("removed").collect()) == brute_passages(rows, 12)
    spans = got.where("removed IS NOT NULL").selectExpr("n_removed", "aggregate(removed, 0L, (n, s) -> n + s.end - s.start) AS total").collect()
    assert all(r["n_removed"] == r["total"] for r in spans)


def test_repeated_passages_of_odd_rows(spark):
    rows = [r[:2] for r in base_rows()]
    got = repeated_passages(odd_docs(spark))
    assert ranked(got.drop("removed").collect()) == brute_passages(rows, 50)
    assert repeated_passages(empty_docs(spark)).count() == 0


def test_automaton_marks_whole_common_runs():
    piece = np.arange(1, 61, dtype=np.uint64)
    text = np.concatenate([np.arange(900, 905), np.arange(20, 61), np.arange(7, 12), np.arange(1, 9)]).astype(np.uint64)
    automaton = PieceAutomaton([4], [piece], 10)
    assert np.flatnonzero(automaton.covered(5, text)).tolist() == list(range(5, 46))
    assert not automaton.covered(4, text).any() and not automaton.covered(3, text).any()


def test_folds(spark):
    ids = [0, 17, -4, 2**40, None]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", fold(F.col("doc_id"), 5).alias("fold")).collect()
    assert {r["doc_id"]: r["fold"] for r in rows} == {i: None if i is None else zlib.crc32(str(i).encode()) % 5 for i in ids}
