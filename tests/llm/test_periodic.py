"""Runs of repeated words by grammar against a plain search of every period."""

import hashlib
import random

import numpy as np
import pytest
from odd import base_rows, empty_docs, odd_docs, ranked, spaced

from treeweave.llm.periodic import Grammar, batch_runs, periodic_runs, probe_size


def plain_runs(words: list, least: int, times: int) -> list[tuple[int, int, int]]:
    found = []
    for period in range(1, len(words) // times + 1):
        place = 0
        while place + period < len(words):
            stop = place
            while stop + period < len(words) and words[stop] == words[stop + period]:
                stop += 1
            length = stop + period - place
            if length >= max(least, times * period) and not any(
                period % q == 0 and b <= place and place + length <= b + n for b, n, q in found
            ):
                found.append((place, length, period))
            place = stop + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def some_words(rng: random.Random) -> list[int]:
    letters = rng.choice([1, 2, 3, 5, 30])
    words = [rng.randrange(letters) for _ in range(rng.choice([0, 1, 5, 23, 24, 25, 60, 200]))]
    for _ in range(rng.randrange(4)):
        base = [rng.randrange(letters) for _ in range(rng.randrange(1, 20))]
        if rng.random() < 0.4:
            base = (base * 4)[:-1] + [99]
        at, copies = rng.randrange(len(words) + 1), rng.randrange(2, 9)
        words[at:at] = (base * copies)[:len(base) * copies - rng.randrange(len(base))]
    return words


def bounds_of(docs):
    return np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)


def numbers_of(docs):
    return np.array([w for d in docs for w in d], np.int64)


@pytest.mark.parametrize("seed", range(40))
def test_runs_against_every_period(seed):
    rng = random.Random(seed)
    least, times = rng.choice([(24, 3), (24, 3), (6, 3), (10, 4), (9, 3), (30, 5)])
    docs = [some_words(rng) for _ in range(rng.randrange(1, 12))]
    docs += docs[:rng.randrange(3)]
    got = batch_runs(numbers_of(docs), bounds_of(docs), least, times)
    assert [got.get(n, []) for n in range(len(docs))] == [plain_runs(d, least, times) for d in docs]


@pytest.mark.parametrize("seed", range(5))
def test_grammar_derives_its_documents(seed):
    rng = random.Random(seed)
    docs = [some_words(rng) for _ in range(6)]
    words, bounds = numbers_of(docs), bounds_of(docs)
    grammar = Grammar(words, bounds)

    def derive(symbol):
        if symbol < grammar.first:
            return [symbol]
        rule = symbol - grammar.first
        return derive(grammar.left[rule]) + derive(grammar.right[rule])

    assert [derive(grammar.roots[n]) if d else [] for n, d in enumerate(docs)] == docs
    for rule in range(len(grammar.left)):
        start, mid, end = grammar.start[rule], grammar.mid[rule], grammar.end[rule]
        assert derive(grammar.left[rule]) == words[start:mid].tolist() and derive(grammar.right[rule]) == words[mid:end].tolist()
    symbol = grammar.first + len(grammar.left) // 3
    inside = derive(symbol)
    for place in grammar.derived({symbol}, bounds[:-1])[symbol]:
        assert words[place:place + len(inside)].tolist() == inside


def test_repeats_make_a_small_grammar():
    words = np.arange(20_000) % 1_000
    assert len(Grammar(words, np.array([0, 20_000])).left) < 1_100
    words = np.zeros(1 << 16, np.int64)
    assert len(Grammar(words, np.array([0, 1 << 16])).left) < 40


def test_probe_covers_half_of_every_run():
    for least, times in ((24, 3), (10, 4), (9, 3)):
        size = probe_size(least, times)
        for period in range(1, 200):
            for length in range(max(least, times * period), 3 * times * period + least):
                assert (length + 1) // 2 >= period + size


def by_hand(text):
    words = spaced(text)
    runs = plain_runs(words, 24, 3)
    gone = {i for b, n, q in runs for i in range(b + q, b + n)}
    return len(words), runs, " ".join(w for i, w in enumerate(words) if i not in gone)


def test_odd_and_empty_tables(spark):
    want = [(r[0], *by_hand(r[1])) for r in base_rows() if not (r[1] or "").startswith("long")]
    rows = periodic_runs(odd_docs(spark)).collect()
    got = [
        (r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"].decode())
        for r in rows if not r["collapsed"].startswith(b"long")
    ]
    assert ranked(got) == ranked(want) and len(rows) == len(base_rows())
    assert [r["runs"] for r in rows if r["collapsed"].startswith(b"long")] == [[], []]
    assert periodic_runs(empty_docs(spark)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(odd_docs(spark), times=2)


def test_very_long_texts_and_texts_of_one_word(spark):
    texts = ["ja " * 300_000, "a b " * 60_000 + "c", " ".join(str(i % 997) for i in range(200_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: ([tuple(x) for x in r["runs"]], hashlib.sha256(r["collapsed"]).hexdigest()) for r in periodic_runs(df).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {
        0: ([(0, 300_000, 1)], digest("ja")), 1: ([(0, 120_000, 2)], digest("a b c")),
        2: ([(0, 200_000, 997)], digest(" ".join(map(str, range(997))))),
    }
