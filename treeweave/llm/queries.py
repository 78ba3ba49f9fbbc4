"""The registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from treeweave.llm import sql
from treeweave.llm.chat import chat_parts, chat_verdicts, read_back
from treeweave.llm.collocations import collocations
from treeweave.llm.contamination import benchmark_hits
from treeweave.llm.html_text import main_texts
from treeweave.llm.language import predicted_languages
from treeweave.llm.mixing import mix_plan
from treeweave.llm.near_duplicates import near_duplicates
from treeweave.llm.passages import repeated_passages
from treeweave.llm.periodic import periodic_runs
from treeweave.llm.quality_model import scored_quality
from treeweave.llm.quality_rules import fit_rules, held_out, judged_quality
from treeweave.llm.sharding import shard_index
from treeweave.llm.support import table
from treeweave.llm.toxicity import scored_toxicity


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted_languages(table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_index(table(spark, sf_dir, "documents"))


def op5_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = benchmark_hits(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "hits.n_words", "hits.n_hit",
        F.size("hits.item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("hits.n_hit") > 0).alias("contaminated"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = fit_rules(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return judged_quality(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).drop("removed")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def _with_planted_runs(checksums: pd.Series, texts: pd.Series) -> pd.Series:
    """Texts of rows with a checksum divisible by 10 repeat their words from some place on; place and period follow from the checksum."""

    def planted(h: int, text: bytes | None) -> bytes | None:
        words = text.split() if text else []
        if h % 10 or not words:
            return text
        rest = int(h) // 10
        start = rest % len(words)
        period = 1 + (len(words) - start) // (3 + rest % 8)
        return b" ".join(words[:start] + [words[start + i % period] for i in range(len(words) - start)])

    return pd.Series([planted(h, t) for h, t in zip(checksums, texts)], dtype=object)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # A row without an id has no checksum and stays as it is.
    checksum = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(1))
    plant = F.pandas_udf(_with_planted_runs, "binary")
    found = periodic_runs(docs.select("doc_id", plant(checksum, F.col("text").cast("binary")).alias("text")))

    def higher_first(a: Column, b: Column) -> Column:
        # length / period compared without a division.
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        key = F.when(left > right, -1).when(left < right, 1)
        for name in ("start", "period"):
            key = key.when(a[name] < b[name], -1).when(a[name] > b[name], 1)
        return key.otherwise(0)

    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.get(F.array_sort("runs", higher_first), F.lit(0))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    names = planted.columns
    rows = table(spark, sf_dir, "conversations").select(*names).unionByName(planted)
    # Digests are of whole conversations: dealt out by conversation, their parts are made and joined without another shuffle.
    parts = chat_parts(rows.repartition("conv_id"))
    said = read_back(parts).select(
        "conv_id", "part", "chars", F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join("learned", "").alias("learned"),
    )
    whole = said.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("part", "turns", "learned"))).alias("parts"),
    )
    learned = F.array_join(F.transform("parts", lambda p: p["learned"]), "")
    digests = whole.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.transform("parts", lambda p: p["turns"]), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned.cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )
    verdicts = chat_verdicts(rows).select(F.col("conv_id").alias("conv"), "valid", "complete", "bad_turn")
    return digests.join(verdicts, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (
        op1_language, op2_near_duplicates, op3_source_mix, op4_jump_shards, op5_benchmark_hits, op6_toxicity, op7_quality_rules,
        op8_quality_model, op9_repeated_passages, op10_main_text, op11_collocations, op12_periodic_runs, op13_chat_format,
    )
}
# No SQL says what a trained model says; tests hold those against brute force and held-out labels.
ORACLES: dict[str, str] = {
    "op2_near_duplicates": sql.NEAR_DUPLICATES,
    "op3_source_mix": sql.SOURCE_MIX,
    "op4_jump_shards": sql.JUMP_SHARDS,
    "op5_benchmark_hits": sql.BENCHMARK_HITS,
    "op9_repeated_passages": sql.REPEATED_PASSAGES,
    "op11_collocations": sql.COLLOCATIONS,
    "op12_periodic_runs": sql.PERIODIC_RUNS,
    "op13_chat_format": sql.CHAT_FORMAT,
}
