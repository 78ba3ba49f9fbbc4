"""Hot groups, running sums, catalogue plans and streams against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from treeweave.operators import catalog, usage
from treeweave.operators.ordering import numbered, with_running
from treeweave.streaming import streams


def hot_rows(n=4000):
    rng = random.Random(5)
    return [("hot" if i % 3 else f"g{i % 7}", rng.randrange(1000), f"k{i:05}", rng.randrange(50)) for i in range(n)]


def test_hot_group_is_numbered_in_slices(spark):
    rows = hot_rows()
    table = spark.createDataFrame(rows, "g string, at int, k string, v bigint")
    made = with_running(table, ["g"], [F.col("at"), F.col("k")], number="n", sums={"total": "v"})
    got = {r.k: (r.n, r.total) for r in made.collect()}
    seen = {}
    for g, at, k, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        n, total = seen.get(g, (0, 0))
        seen[g] = (n + 1, total + v)
        assert got[k] == seen[g]
    assert len(got) == len(rows)


def test_no_window_covers_a_whole_group(spark):
    table = spark.createDataFrame(hot_rows(), "g string, at int, k string, v bigint")
    sliced = table.repartitionByRange(8, "g", "at", "k").withColumn("s", F.spark_partition_id())
    assert sliced.where("g = 'hot'").groupBy("s").count().count() > 3
    plan = numbered(table, ["g"], [F.col("at"), F.col("k")])._jdf.queryExecution().optimizedPlan().toString()
    rank = [line for line in plan.split("\n") if "row_number()" in line]
    assert rank and all("_slice" in line for line in rank)


def test_global_order(spark):
    table = spark.createDataFrame(hot_rows(500), "g string, at int, k string, v bigint")
    order = [r.k for r in sorted(numbered(table, [], [F.col("at"), F.col("k")]).collect(), key=lambda r: r.seq)]
    assert order == [r[2] for r in sorted(hot_rows(500), key=lambda r: (r[1], r[2]))]


def entries(spark, rows):
    return spark.createDataFrame(rows, "cache_key string, size_bytes bigint, last_accessed bigint, access_count bigint")


@pytest.mark.parametrize("capacity,incoming", [(1000, 0), (1000, 200), (200, 10), (10, 500), (100_000, 1)])
def test_lru_plan(spark, capacity, incoming):
    rng = random.Random(1)
    rows = [(f"k{i:02}", rng.randrange(1, 60), rng.randrange(9), 1) for i in range(40)]
    used, evicted = sum(r[1] for r in rows), []
    for key, size, _, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if used + incoming <= capacity:
            break
        used -= size
        evicted.append(key)
    plan = catalog.lru_eviction_plan(entries(spark, rows), capacity, incoming)
    assert sorted(r.cache_key for r in plan.collect()) == sorted(evicted)


def test_lru_plan_by_scope(spark):
    rows = entries(spark, [("a", 5, 1, 1), ("b", 5, 2, 1), ("c", 5, 1, 1)]).withColumn("tenant", F.substring("cache_key", 1, 1) == "c")
    assert [r.cache_key for r in catalog.lru_eviction_plan(rows, 10, 5, ["tenant"]).collect()] == ["a"]


@pytest.mark.parametrize("limit,want", [(3, ["b"]), (2, ["b", "c"]), (4, []), (0, ["a", "b", "c"])])
def test_lfu_plan(spark, limit, want):
    rows = entries(spark, [("a", 1, 1, 9), ("b", 1, 1, 1), ("c", 1, 1, 2)])
    assert sorted(r.cache_key for r in catalog.lfu_eviction_plan(rows, limit).collect()) == want


def test_catalog_figures_of_nothing(spark):
    empty = entries(spark, []).withColumn("created_at", F.lit(0)).withColumn("content_bytes", F.lit(0).cast("bigint"))
    assert catalog.hit_rate(empty).first().hit_rate == 0.0
    assert catalog.catalog_stats(empty, 100, 5).first().total_size == 0
    row = usage.health_snapshot(empty, empty).first()
    assert (row.repo_entries, row.hit_rate, row.size_kb) == (0, "0.0%", 0)


def test_freshness_borders(spark):
    now = 1_000_000
    rows = [("fresh", 0, 299), ("valid", 0, 300), ("old", 604_800, 0), ("expired", 604_801, 0)]
    stored = spark.createDataFrame([(k, now - a, now - v) for k, a, v in rows], "cache_key string, created_at bigint, last_validated bigint")
    asked = spark.createDataFrame([(k,) for k in ("fresh", "valid", "old", "expired", "none")], "cache_key string")
    got = {r.cache_key: r.freshness for r in catalog.freshness(stored, asked, now).collect()}
    assert got == {"fresh": "Fresh", "valid": "Valid", "old": "Fresh", "expired": "Expired", "none": "Miss"}


def run(stream, tmp_path, mode="update"):
    out = {}

    def keep(batch, batch_id):
        for row in batch.collect():
            out[row[0]] = row

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", str(tmp_path / "progress"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return out


def arriving(spark, tmp_path, rows, schema, parts):
    """Rows as a stream of several files, one per batch."""
    folder = tmp_path / "in"
    for i in range(parts):
        spark.createDataFrame(rows[i::1] if parts == 1 else rows[i * len(rows) // parts:(i + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_key_freshness_over_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = sorted((rng.randrange(0, 1_500_000), f"k{rng.randrange(3)}") for _ in range(600))
    rows = [(k, t) for t, k in rows]
    stream = arriving(spark, tmp_path, rows, "cache_key string, ts_sec bigint", 3)
    got = run(streams.key_freshness(stream, "30 days"), tmp_path)
    state = {}
    for key, at in rows:
        first, validated, count = state.get(key, (at, at, 0))
        if at - first > 604_800:
            first, validated, count = at, at, 0
        elif at - validated >= 300:
            validated = at
        state[key] = (first, validated, count + 1)
    assert {k: tuple(r)[1:] for k, r in got.items()} == state


def test_latest_responses_over_batches(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"i{rng.randrange(2)}", t, t, rng.randrange(500)) for t in range(900)]
    schema = "instance string, ts_sec bigint, request_id bigint, response_ms bigint"
    got = run(streams.latest_responses(arriving(spark, tmp_path, rows, schema, 3), n=50), tmp_path)
    for instance in ("i0", "i1"):
        last = [r[3] for r in rows if r[0] == instance][-50:]
        assert tuple(got[instance])[1:] == (sum(last) // 50, 50)


class Recorder(streams.Hooks):
    def __init__(self, folder):
        self.folder, self.calls = folder, []

    def on_progress(self, stage, message):
        self.calls.append(stage)

    def on_complete(self, files, size):
        self.calls.append((files, size))

    def on_error(self, error):
        self.calls.append("error")


class FileHook:
    """Runs on the executors."""

    def __init__(self, folder, fail=False):
        self.folder, self.fail = folder, fail

    def __call__(self, path, content):
        if self.fail:
            raise ValueError("no")
        with open(f"{self.folder}/{path}", "w") as out:
            out.write(content)


@pytest.mark.parametrize("fail", [False, True])
def test_callbacks(spark, tmp_path, fail):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    (tmp_path / "seen").mkdir()
    rows = [("r", f"f{i}", f"=== f{i} ===\nx\n\n") for i in range(5)]
    blocks = arriving(spark, tmp_path, rows, "repo_url string, path string, block string", 1)
    hooks = Recorder(str(tmp_path))
    hooks.on_file = FileHook(str(tmp_path / "seen"), fail)
    query = streams.run_with_callbacks(blocks, hooks, str(tmp_path / "progress"))
    if fail:
        with pytest.raises(Exception):
            query.awaitTermination()
        assert hooks.calls == ["ingesting", "error"]
    else:
        query.awaitTermination()
        assert hooks.calls == ["ingesting", (5, sum(len(r[2]) for r in rows))]
        assert sorted(p.name for p in (tmp_path / "seen").iterdir()) == [r[1] for r in rows]


def test_stream_equals_batch_on_closed_hours(spark, tmp_path):
    schema = "request_id bigint, ts_sec bigint, cache_hit boolean, is_error boolean, bytes_out bigint"
    rows = [(i, i * 700, i % 3 == 0, False, i) for i in range(400)]
    stream = arriving(spark, tmp_path, rows, schema, 1)
    got = {h: tuple(r)[1:] for h, r in run(streams.stream_hourly(stream), tmp_path, "append").items()}
    batch = usage.hourly_usage(
        spark.createDataFrame(rows, schema).withColumn("files_out", F.lit(1)), now=10**9, hours=10**9
    )
    want = {r.hour: tuple(r)[1:] for r in batch.collect()}
    closed = {h for h in want if (h + 1) * 3600 <= rows[-1][1] - 86400}
    assert closed and got == {h: want[h] for h in closed}
