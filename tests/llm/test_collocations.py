"""Phrases by SETM against plain counting."""

import pathlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from odd import base_rows, empty_docs, lower_ascii, odd_docs
from pyspark.sql import functions as F

from treeweave.llm.collocations import WORD, _Counts, _grouped, _lowest_cut, collocations
from treeweave.session import shared_dir

PARTS = ["a", "b", "c", "B", "dé", "x\x1cy", "the", "of", ".", ",", ";", "\n", "\x0b", "\t", "  ", "!?", "\r\n", "\x85"]


def by_hand(rows, least, longest, top, absorbed=80, scale=2_000_000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower_ascii(text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for s in range(len(words) - size + 1):
                    f[lang, tuple(words[s:s + size])] += 1
    often = {g for g, count in f.items() if len(g[1]) > 1 and count >= least}
    found = {}
    for lang, words in often:
        a = f[lang, words]
        cuts = [(scale * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        if any(
            l == lang and len(w) > len(words) and 100 * f[l, w] >= absorbed * a
            and any(w[s:s + len(words)] == words for s in range(len(w) - len(words) + 1)) for l, w in often
        ):
            continue
        found.setdefault(lang, []).append((score, a, " ".join(words), f[lang, words[:k]], f[lang, words[k:]], k))
    out = []
    for lang, phrases in found.items():
        phrases.sort(key=lambda p: (-p[0], -p[1], p[2].encode()))
        out += [(lang, rank, p, a, l, r, n[lang], score, k) for rank, (score, a, p, l, r, k) in enumerate(phrases[:top], 1)]
    return sorted(out)


def told(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "k").collect())


@pytest.mark.parametrize("seed,shard_bytes,longest,top,bucket_groups,merged", [(1, 1, 4, 50, 9, 5), (4, 200, 5, 30, 10_000, 4_096), (7, 200, 3, 30, 1, 2)])
def test_against_plain_counting(spark, seed, shard_bytes, longest, top, bucket_groups, merged):
    rng = random.Random(seed)
    rows = [
        ("".join(rng.choice(PARTS) + rng.choice([" ", " ", "\t", ""]) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None, "und"]))
        for _ in range(80)
    ] + [("a a a a a a a", "en"), ("new york city . new york city new york city", "de"), (None, "en"), ("", None)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    want = by_hand(rows, 3, longest, top)
    made = collocations(df, least=3, longest=longest, top=top, shard_bytes=shard_bytes, bucket_groups=bucket_groups, merged_shards=merged)
    assert want and told(made) == want


def test_odd_and_empty_tables(spark):
    rows = [(r[1], r[2]) for r in base_rows()]
    want = by_hand(rows, 2, 4, 2_000)
    assert told(collocations(odd_docs(spark), least=2)) == want and want
    assert collocations(empty_docs(spark)).count() == 0
    assert collocations(odd_docs(spark), least=10_000).count() == 0


def test_scores_beyond_64_bits(spark):
    a, head, tail = 9 * 10**15, 9 * 10**18, 9 * 10**18 + 7
    df = spark.createDataFrame([(a, [head, a], [tail, a])], "a long, heads array<long>, tails array<long>")
    assert df.select(_lowest_cut(2, 2_000_000).alias("c")).select("c.score").first()[0] == 2_000_000 * a // (head + tail)


def test_words_of_pieces_and_documents_do_not_meet(spark):
    df = spark.createDataFrame([("x y", "en"), ("x, y", "en"), ("x", "en"), ("y", "en")] * 30, "text string, lang string").coalesce(1)
    assert [(r["phrase"], r["a"]) for r in collocations(df).select("phrase", "a").collect()] == [("x y", 30)]
    assert collocations(df.withColumn("lang", F.lit(None).cast("string"))).first()["lang"] == "und"


def test_groups_are_sent_once_and_not_written_with_their_places(spark, monkeypatch):
    sent, rows_of = [], _Counts._rows
    monkeypatch.setattr(_Counts, "_rows", lambda counts: sent.append(counts.names) or rows_of(counts))
    rng = random.Random(5)
    rows = [(" ".join(f"w{int(500 * rng.random() ** 2)}" for _ in range(300)), "en") for _ in range(200)]
    folder = pathlib.Path(shared_dir(spark)) / spark.sparkContext.applicationId
    before = set(folder.glob("*"))
    assert told(collocations(spark.createDataFrame(rows, "text string, lang string").coalesce(2), least=3, top=100)) == by_hand(rows, 3, 4, 100)
    assert sent == [WORD, ["w1", "w2"], ["w1", "w2", "w3"], ["w1", "w2", "w3", "w4"]]
    size = {label: sum(f.stat().st_size for d in set(folder.glob(f"{label}-*")) - before for f in d.rglob("*.parquet")) for label in ("occurrences1", "occurrences3")}
    assert 0 < size["occurrences3"] < size["occurrences1"] / 4


@pytest.mark.parametrize("below", [2, 7, 1 << 22, 1 << 31])
def test_groups_of_numbers_of_any_size(below):
    rng = random.Random(below)
    values = [rng.randrange(below) for _ in range(3)]
    rows = [tuple(rng.choice(values) for _ in range(4)) for _ in range(300)]
    row, of, n = _grouped([np.array(c) for c in zip(*rows)], below)
    assert [rows[row[g]] for g in of] == rows
    assert {rows[at]: count for at, count in zip(row, n.tolist())} == Counter(rows)
