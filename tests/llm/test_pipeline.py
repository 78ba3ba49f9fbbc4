"""The stages of the pipeline against brute force on the smallest tables, and on odd tables."""

import pathlib
from collections import Counter

import pytest
from odd import base_rows, empty_docs, odd_docs
from test_mix_and_shards import brute_jump, number
from test_searches import brute_hits, brute_near

import corpus_pipeline
from treeweave.llm.toxicity import fit_toxicity, held_out, with_toxicity
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF_DIR).exists(), reason="tables not present")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def as_rows(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)

    first = stages["toxicity"](spark, docs, SF_DIR)
    model = fit_toxicity(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"), ~held_out(F.col("doc_id")))
    clean = with_toxicity(docs, model).where("toxicity < 0.3")
    assert first.columns == COLUMNS and Counter(as_rows(first)) == Counter(as_rows(clean))
    assert 0.8 * docs.count() < first.count() < docs.count()

    given = as_rows(first)
    second = stages["near_dedup"](spark, first, SF_DIR)
    roots = {c for _, _, c, _ in brute_near([r[:2] for r in given], 80)}
    assert second.columns == COLUMNS and sorted(as_rows(second)) == sorted(r for r in given if r[0] in roots)

    given = as_rows(second)
    third = stages["decontamination"](spark, second, SF_DIR)
    hit = {d for d, _, n, _ in brute_hits([r[:2] for r in given], bench, 10) if n}
    assert hit and third.columns == COLUMNS and sorted(as_rows(third)) == sorted(r for r in given if r[0] not in hit)

    given = as_rows(third)
    fourth = stages["mixing"](spark, third, SF_DIR)
    times = Counter(as_rows(fourth))
    assert fourth.columns == COLUMNS and set(times) <= set(given) and max(times.values()) <= 2
    words = sum(len(t.split()) * n for (_, t, *_), n in times.items())
    assert words == pytest.approx(1.5 * sum(len(r[1].split()) for r in given), rel=0.15)

    fifth = stages["sharding"](spark, fourth, SF_DIR)
    assert fifth.columns == [*COLUMNS, "shard"] and Counter(as_rows(fifth)) == times
    assert all(r["shard"] == brute_jump(number(r["doc_id"]), 40) for r in fifth.select("doc_id", "shard").distinct().collect())
    assert Counter(as_rows(corpus_pipeline.run(spark, SF_DIR))) == times


def test_stages_on_odd_and_empty_tables(spark):
    for docs in (odd_docs(spark), empty_docs(spark)):
        for _, stage in corpus_pipeline.STAGES:
            before = docs.columns
            docs = stage(spark, docs, SF_DIR)
            assert set(before) <= set(docs.columns)
            docs.count()
    assert len(base_rows()) == 20
