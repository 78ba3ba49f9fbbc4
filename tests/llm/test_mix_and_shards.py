"""Source mix and shards against plain programs, and on odd tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from odd import base_rows, empty_docs, odd_docs, ranked, spaced
from pyspark.sql import functions as F

from treeweave.llm.mixing import mix_plan, mix_sources, source_targets
from treeweave.llm.sharding import jump, shard_index, stable_key, with_shard


def brute_targets(sizes, share, weights, most):
    """Round by round: sources over their limit stop there and the rest shares what is left."""
    names = sorted(sizes)
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    full, left = set(), share * sum(sizes.values())
    while True:
        rest = [n for n in names if n not in full]
        level = (left - sum(most * sizes[n] for n in full)) / sum(weight[n] for n in rest) if rest else 0
        over = {n for n in rest if weight[n] * level > most * sizes[n]}
        if not over:
            return {n: most * sizes[n] if n in full else weight[n] * level for n in names}
        full |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    draw = random.Random(seed)
    sizes = {f"{i:03d}": draw.choice([0, 1, 10, 500, draw.randrange(10_000)]) for i in range(draw.choice([1, 5, 40]))}
    share = draw.choice([0.3, 1.5, 2.5])
    got = source_targets(spark.createDataFrame(list(sizes.items()), "key string, source_size long"), share)
    want = brute_targets(sizes, min(share, 2), (3, 1, 2), 2)
    for row in got.collect():
        assert row["target"] == pytest.approx(want[row["key"]], abs=1e-6)


def test_mix_of_odd_rows(spark):
    docs = odd_docs(spark)
    plan = mix_plan(docs).collect()
    assert len(plan) == len(base_rows())
    assert Counter((r["doc_id"], r["size"]) for r in plan) == Counter((r[0], len(spaced(r[1]))) for r in base_rows())
    largest = defaultdict(int)
    taken, target = Counter(), {}
    for r in plan:
        assert 0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    for source, words in target.items():
        assert abs(taken[source] - words) <= largest[source]
    again = mix_plan(docs.repartition(5)).collect()
    assert ranked((r["doc_id"], r["size"], r["taken"]) for r in again) == ranked((r["doc_id"], r["size"], r["taken"]) for r in plan)
    mixed = mix_sources(docs)
    assert mixed.columns == docs.columns
    want = Counter()
    for r in plan:
        want[r["doc_id"], r["size"], r["source"]] += r["copies"]
    got = Counter((r["doc_id"], len(spaced(r["text"])), r["source"]) for r in mixed.collect())
    assert got == +want
    assert mix_plan(empty_docs(spark)).count() == 0 and mix_sources(empty_docs(spark)).count() == 0


def test_mix_comes_near_targets_of_a_hot_source(spark):
    draw = random.Random(9)
    rows = [(i, "w " * min(int(draw.paretovariate(1)), 400), "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    plan = mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in plan.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect():
        assert r["taken"] == pytest.approx(r["target"], abs=400)


def brute_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = math.floor((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def number(key):
    return int(hashlib.md5(("null" if key is None else f"k{key}").encode()).hexdigest()[:16], 16)


@pytest.mark.parametrize("shards", [1, 2, 40, 1000])
def test_jump_hash(spark, shards):
    keys = spark.createDataFrame([(str(i),) for i in range(500)] + [(None,)], "key string")
    for r in keys.select("key", jump(stable_key(F.col("key")), shards)["shard"].alias("shard")).collect():
        assert r["shard"] == brute_jump(number(r["key"]), shards)


def test_shards_of_odd_rows(spark):
    docs = odd_docs(spark)
    index = shard_index(docs).collect()
    assert len(index) == len(base_rows())
    for r in index:
        assert r["shard"] == brute_jump(number(r["doc_id"]), 40) and r["grown_shard"] == brute_jump(number(r["doc_id"]), 41)
        assert r["grown_shard"] in (r["shard"], 40)
    slots = defaultdict(list)
    for r in index:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((i, len((t or "").encode()) + 16, None if t is None else zlib.crc32(t.encode())) for i, t, *_ in base_rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in index) == want
    sharded = with_shard(docs)
    assert sharded.columns == docs.columns and sharded.where("shard IS NULL").count() == 0
    assert shard_index(empty_docs(spark)).count() == 0
    with pytest.raises(ValueError):
        with_shard(docs, 0)
