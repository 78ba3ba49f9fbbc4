"""Language, toxicity, rules and quality model: plain re-computation, held-out accuracy, odd tables."""

import math
import pathlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from odd import base_rows, empty_docs, odd_docs, ranked, spaced
from pyspark.sql import functions as F

from treeweave.llm import language, quality_model, quality_rules, toxicity
from treeweave.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not pathlib.Path(SF_DIR).exists(), reason="tables not present")


def plain_bundle(text, dimensions):
    """One permuted and bound vector per n-gram, summed up."""
    table, vectors = language._symbol_table(), language._letter_vectors(dimensions).astype(int)
    symbols = [0, *(int(table[ord(c)]) for c in text.lower()), 0]
    symbols = [s for i, s in enumerate(symbols) if s or i == 0 or symbols[i - 1]]
    total = np.zeros(dimensions, int)
    if any(symbols):
        for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
            total += np.roll(vectors[a], 2) * np.roll(vectors[b], 1) * vectors[c]
    return total


def test_bundles_are_sums_of_bound_letters():
    texts = ["Der Hund, ein Über-Hund!", "", "12 34", "日本語 русский", "a", "x" * 40, "one two " * 30]
    got = language.bundles(texts, 64)
    for text, vector in zip(texts, got):
        assert vector.astype(int).tolist() == plain_bundle(text, 64).tolist()


@needs_tables
def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op1_language"](spark, SF_DIR)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.join(docs, "doc_id").toPandas()
    assert len(rows) == docs.count() and rows.score.between(0, 1).all()
    assert (rows[rows.held_out].lang == rows[rows.held_out].lang_pred).mean() > 0.98


def test_languages_learn_from_one_text_of_an_id_and_no_more_than_asked(spark):
    rows = [(i, f"{'der hund und' if i % 2 else 'the dog and'} {i}", "de" if i % 2 else "en") for i in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, few = language.language_prototypes(docs, F.lit(True), per_language=20, dimensions=64)
    assert names == ["de", "en"] and np.allclose(np.linalg.norm(few, axis=1), 1)
    again = language.language_prototypes(docs.union(docs).repartition(5), F.lit(True), per_language=20, dimensions=64)[1]
    assert np.allclose(few, again)


def test_languages_of_odd_rows(spark):
    got = {r["doc_id"]: r for r in language.predicted_languages(odd_docs(spark)).collect()}
    assert got[4]["lang_pred"] == got[5]["lang_pred"] == got[14]["lang_pred"] == "und" and got[4]["score"] == 0
    assert got[1]["lang_pred"] in ("en", "de") and got[12]["lang_pred"] in ("en", "de")
    assert language.predicted_languages(odd_docs(spark)).count() == len(base_rows())
    assert language.predicted_languages(empty_docs(spark)).count() == 0
    nothing = language.predicted_languages(odd_docs(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def labelled(spark, name):
    ids = [1, 2, 3, 4, 5, 7, 8, 10, 12, 16, None, 99]
    return spark.createDataFrame([(i, n % 2 if n != 3 else None) for n, i in enumerate(ids)] + [(1, 1)], f"doc_id long, {name} int")


def test_buckets_are_those_of_all_n_grams():
    text = "Ab ça"
    got = [len(b) for b in toxicity.gram_buckets(text)]
    assert got == [len(f" {text} ") - n + 1 for n in toxicity.ORDERS]
    whole = np.unique(np.concatenate(list(toxicity.gram_buckets("abc d" * 50))))
    before, toxicity.PART = toxicity.PART, 7
    try:
        parts = np.unique(np.concatenate(list(toxicity.gram_buckets("abc d" * 50))))
    finally:
        toxicity.PART = before
    assert whole.tolist() == parts.tolist()


@needs_tables
def test_toxicity_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    got = QUERIES["op6_toxicity"](spark, SF_DIR)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(labels, "doc_id").toPandas()
    held = rows[rows.held_out]
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.3)).all()
    assert held[held.toxic == 1].score.mean() > 5 * held[held.toxic == 0].score.mean()
    assert (held.toxic == held.predicted).mean() > 0.9
    # Documents with a word that only toxic examples have must not pass.
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = toxicity.fit_toxicity(docs, spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), ~toxicity.held_out(F.col("doc_id")))
    plain = "the quiet house stands by the river and the old man reads his book there every evening"
    words = ["idiot and moron", "scum or loser", "worthless", "stupid trash"]
    cases = [(i, f"{plain} {word} {plain}") for i, word in enumerate(words)] + [(9, plain)]
    scores = {r["doc_id"]: r["toxicity"] for r in toxicity.with_toxicity(spark.createDataFrame(cases, "doc_id long, text string"), model).collect()}
    assert scores.pop(9) < 0.3 and all(s >= 0.3 for s in scores.values())


def test_toxic_words_of_a_rare_label_count():
    """1 % toxic of a full sample, each toxic word in a quarter of these: 20 examples of 8,000."""
    draw = np.random.default_rng(6)
    labels = np.arange(8_000) % 100 == 0
    rows = [np.unique(draw.integers(100, 5_000, 60)) for _ in labels]
    for number in np.flatnonzero(labels):
        rows[number] = np.append(rows[number], 5_000 + number // 100 % 4)
    truth = labels.astype(float)
    used, weights, bias = toxicity.fit_scaled_logistic(rows, truth, toxicity.chosen_support(rows, truth))
    full = np.zeros(toxicity.BUCKETS)
    full[used] = weights
    said = np.array([1 / (1 + np.exp(-(full[row].sum() + bias))) for row in rows]) >= toxicity.THRESHOLD
    assert {5_000, 5_001, 5_002, 5_003} <= set(used.tolist())
    assert said[labels].mean() > 0.95 and said[~labels].mean() < 0.02


def plain_buckets(text):
    """Buckets of all n-grams, one letter at a time."""
    text, buckets = f" {text.lower()} ", set()
    for order in toxicity.ORDERS:
        for begin in range(len(text) - order + 1):
            total = order * 0x9E3779B1 & 0xFFFFFFFF
            for char in text[begin:begin + order]:
                total = (total ^ ord(char)) * 0x85EBCA6B & 0xFFFFFFFF
                total ^= total >> 15
            buckets.add(total % toxicity.BUCKETS)
    return buckets


def plain_model(texts, labels, support):
    """Dictionaries of ratios and weights; the same steps, one bucket at a time."""
    rows = [plain_buckets(t) for t in texts]
    have = defaultdict(lambda: [0, 0])
    for row, label in zip(rows, labels):
        for bucket in row:
            have[bucket][label] += 1
    size = [labels.count(0), labels.count(1)]
    ratios = {}
    for bucket, (bad, good) in have.items():
        ratio = math.log((good + 0.5) / (size[1] + 1)) - math.log((bad + 0.5) / (size[0] + 1))
        if (good if ratio > 0 else bad) >= support and abs(ratio) >= toxicity.LEAST_RATIO:
            ratios[bucket] = ratio
    share = (size[1] + 0.5) / (len(labels) + 1)
    values = dict.fromkeys(ratios, 0.0) | {"bias": math.log(share / (1 - share))}
    first, second = dict.fromkeys(values, 0.0), dict.fromkeys(values, 0.0)
    kept = [[b for b in row if b in ratios] for row in rows]
    for step in range(1, toxicity.STEPS + 1):
        slopes = {b: toxicity.PENALTY * values[b] for b in ratios} | {"bias": 0.0}
        for row, label in zip(kept, labels):
            margin = values["bias"] + sum(values[b] * ratios[b] for b in row)
            wrong = (1 / (1 + math.exp(-margin)) - label) / len(labels)
            slopes["bias"] += wrong
            for bucket in row:
                slopes[bucket] += wrong * ratios[bucket]
        for name, slope in slopes.items():
            first[name] = 0.9 * first[name] + 0.1 * slope
            second[name] = 0.99 * second[name] + 0.01 * slope * slope
            values[name] -= 0.02 * (first[name] / (1 - 0.9 ** step)) / (math.sqrt(second[name] / (1 - 0.99 ** step)) + 1e-8)
    return lambda text: 1 / (1 + math.exp(-values["bias"] - sum(values[b] * ratios[b] for b in plain_buckets(text) if b in ratios)))


def test_toxicity_scores_are_those_of_a_plain_classifier(spark):
    draw = random.Random(8)
    good, bad = ["Quiet", "house", "river", "écrit"], ["scum", "IDIOT", "river", "日本"]
    rows = [(i, " ".join(draw.choices(bad if i % 3 == 0 else good, k=6)), int(i % 3 == 0)) for i in range(45)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    # An id that is there again with a text later by bytes is one example.
    model = toxicity.fit_toxicity(docs.select("doc_id", "text").union(docs.select("doc_id", F.lit("\U0010FFFF"))), docs, F.lit(True), supports=(3,))
    score = plain_model([t for _, t, _ in rows], [label for *_, label in rows], 3)
    cases = [(i, t) for i, t, _ in rows] + [(90, ""), (91, None), (92, "a scum by the river"), (93, "house " * 3_000)]
    for row in toxicity.with_toxicity(spark.createDataFrame(cases, "doc_id long, text string"), model).collect():
        assert row["toxicity"] == pytest.approx(score(row["text"] or ""), abs=2e-4)


def test_support_is_chosen_by_folds_of_the_examples():
    draw = random.Random(9)
    texts = [" ".join(draw.choices(["abc", "bcd", "cde", "xyz" if i % 3 else "uvw"], k=4)) for i in range(24)]
    labels = [int(i % 3 == 0) if i % 5 else i % 2 for i in range(24)]
    losses = {}
    for support in (1, 2, 4):
        total = 0.0
        for fold in range(3):
            inside = [i for i in range(24) if i % 3 != fold]
            score = plain_model([texts[i] for i in inside], [labels[i] for i in inside], support)
            total -= sum(math.log(score(texts[i]) if labels[i] else 1 - score(texts[i])) for i in range(24) if i % 3 == fold)
        losses[support] = total / 24
    rows = [np.array(sorted(plain_buckets(t))) for t in texts]
    truth = np.array(labels, float)
    assert all(toxicity.fold_loss(rows, truth, s) == pytest.approx(loss, abs=1e-4) for s, loss in losses.items())
    assert toxicity.chosen_support(rows, truth, (1, 2, 4)) == min(losses, key=losses.get)


def test_toxicity_of_odd_rows(spark):
    for labels in (labelled(spark, "toxic"), labelled(spark, "toxic").where("toxic = 1"), labelled(spark, "toxic").where("false")):
        rows = toxicity.scored_toxicity(odd_docs(spark), labels).collect()
        assert len(rows) == len(base_rows()) and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] in (4, 5)}) == 1
    docs = odd_docs(spark)
    model = toxicity.fit_toxicity(docs, labelled(spark, "toxic"), F.lit(True))
    assert toxicity.without_toxic(docs, model).columns == docs.columns
    assert toxicity.scored_toxicity(empty_docs(spark), labelled(spark, "toxic")).count() == 0


def plain_counts(text):
    words = spaced(text)
    text = text or ""
    lines = [line for line in text.split("\n") if spaced(line)]
    triples = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if triples[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": sum(line in lines[:i] for i, line in enumerate(lines)), "n_repeat_words": len(covered),
    }


def test_counts():
    draw = random.Random(4)
    texts = [None, "", " \n ", "a a a a", "é ß\x0b日本 x\n\nx\nx \nx"] + [
        "".join(draw.choice("ab é\n|#\t") for _ in range(draw.randrange(200))) for _ in range(200)
    ]
    for text in texts:
        got = dict(zip(quality_rules.COUNTS, quality_rules.text_counts(None if text is None else text.encode())))
        assert {k: got[k] for k in plain_counts(text)} == plain_counts(text)


def test_rules_cover_what_they_were_grown_for_and_say_the_same_in_spark(spark):
    draw = np.random.default_rng(0)
    rows = pd.DataFrame({c: draw.integers(50, 200, 600) for c in quality_rules.COUNTS})
    rows["label"] = np.where((rows.n_symbols / rows.n_words > 1.5) | ((rows.n_marks / rows.n_words > 1.2) & (rows.n_upper / rows.word_chars > 1)), 0, 1)
    rows["held_back"] = draw.random(600) < 0.33
    rules = quality_rules.learn_rules(rows)
    covered = np.zeros(600, bool)
    for rule in rules:
        covered |= quality_rules._covered(rule, quality_rules._ratios(rows), 600)
    assert 2 <= len(rules) <= 8 and (covered == (rows.label == 0)).mean() > 0.95
    frame = spark.createDataFrame(rows.reset_index().astype("int64")).select("index", F.struct(*quality_rules.COUNTS).alias("counts"))
    said = frame.select("index", quality_rules.verdict(rules, "counts").isNotNull().alias("bad")).toPandas().sort_values("index")
    assert said.bad.tolist() == covered.tolist()


@needs_tables
def test_quality_rules_over_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    rows = QUERIES["op7_quality_rules"](spark, SF_DIR).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = plain_counts(r["text"])
        assert {k: r[k] for k in want} == want
        assert r["base_failed"] == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
        assert not (r["base_failed"] and r["kept"])
    judged = labels.toPandas().merge(pd.DataFrame([r.asDict() for r in rows]), on="doc_id")
    judged = judged[~judged.base_failed & (judged.doc_id.map(lambda i: __import__("zlib").crc32(str(i).encode()) % 4) == 2)]
    assert (judged.kept == (judged.quality == 1)).mean() > 0.97


def test_quality_rules_of_odd_rows(spark):
    docs = odd_docs(spark)
    for labels in (labelled(spark, "quality"), labelled(spark, "quality").where("false")):
        rules = quality_rules.fit_rules(docs, labels, F.lit(True))
        rows = quality_rules.judged_quality(docs, rules).collect()
        want = [(i, *plain_counts(t).values()) for i, t, *_ in base_rows()]
        assert ranked((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows) == ranked(want)
    assert quality_rules.judged_quality(empty_docs(spark), []).count() == 0


def test_slopes_of_the_attention_model():
    draw = np.random.default_rng(1)
    passages, starts, labels = draw.normal(size=(9, quality_model.STATISTICS)), np.array([0, 2, 3, 7]), np.array([1.0, 0, 1, 0])
    model = quality_model.AttentionModel.begin(passages, 0.5)

    def loss():
        p, _ = model.forward(passages, starts)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for name, slope in model.slopes(passages, starts, labels).items():
        flat = model.values[name].reshape(-1)
        for at in range(0, len(flat), 7):
            before = flat[at]
            flat[at] = before + 1e-5
            up = loss()
            flat[at] = before - 1e-5
            down = loss()
            flat[at] = before
            assert slope.reshape(-1)[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def plain_score(model, bag):
    """One passage after another through encoder, gate and attention, then the weighted sum."""
    v, encoded, energies = model.values, [], []
    for passage in bag.astype(float):
        x = [min(max((s - m) / d, -6), 6) for s, m, d in zip(passage, v["mean"], v["spread"])]
        h = [math.tanh(sum(x[i] * v["encode"][i, j] for i in range(len(x))) + v["encode_bias"][j]) for j in range(quality_model.ENCODED)]
        energy = 0.0
        for k in range(quality_model.ATTENTION):
            turn = math.tanh(sum(h[j] * v["turn"][j, k] for j in range(len(h))))
            gate = 1 / (1 + math.exp(-sum(h[j] * v["gate"][j, k] for j in range(len(h)))))
            energy += turn * gate * v["attend"][k]
        encoded.append(h)
        energies.append(energy)
    weights = [math.exp(e) for e in energies]
    whole = [sum(w * h[j] for w, h in zip(weights, encoded)) / sum(weights) for j in range(quality_model.ENCODED)]
    return 1 / (1 + math.exp(-sum(z * s for z, s in zip(whole, v["score"])) - v["bias"][0]))


def test_quality_scores_are_those_of_a_plain_network(spark):
    draw = random.Random(5)
    words = ["the", "old", "house", "###", "42", "Écrit", "日本", "x|y"]
    rows = [(i, " ".join(draw.choices(words[: 4 + i % 5], k=draw.choice([3, 70, 700]))), i % 2) for i in range(24)]
    rows += [(24, None, 0), (25, "", 1), (26, " ".join(draw.choices(words, k=64 * 90)), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality_model.fit_quality(docs, docs, F.lit(True))
    for row in quality_model.with_quality(docs, model).collect():
        assert row["quality_score"] == pytest.approx(plain_score(model, quality_model.passage_statistics(row["text"] or "")), abs=1e-6)


def test_slopes_of_a_step_are_those_of_all_its_passages(monkeypatch):
    draw = np.random.default_rng(2)
    bags = [draw.normal(size=(n, quality_model.STATISTICS)).astype(np.float32) for n in (1, 300, 2, 90, 1, 1, 7)]
    labels = np.array([1.0, 0, 1, 1, 0, 1, 0])
    model = quality_model.AttentionModel.begin(np.concatenate(bags), 0.5)
    starts = np.cumsum([0, *(len(b) for b in bags[:-1])])
    whole = model.slopes(np.concatenate(bags).astype(float), starts, labels)
    monkeypatch.setattr(quality_model, "PART_PASSAGES", 64)
    parts = model.step_slopes(bags, labels)
    assert all(np.allclose(parts[n], whole[n]) for n in whole)


def test_the_last_passage_of_a_long_text_is_learned_from(spark):
    """Texts of 200 passages that differ in one passage only, anywhere in them."""
    draw = random.Random(3)
    rows = []
    for i in range(120):
        passages = [" ".join(draw.choices(["stone", "water", "light"], k=64)) for _ in range(200)]
        passages[draw.randrange(200)] = " ".join(["###" if i % 2 else "stone"] * 64)
        rows.append((i, " ".join(passages), i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    said = quality_model.with_quality(docs, quality_model.fit_quality(docs, docs, F.lit(True))).collect()
    assert sum((r["quality_score"] > 0.5) == (r["quality"] == 1) for r in said) > 114


def test_passages():
    words = [f"w{i}" for i in range(150)]
    stats = quality_model.passage_statistics(" ".join(words))
    assert stats.shape == (3, quality_model.STATISTICS)
    assert np.allclose(stats[:, :quality_model.CLASSES].sum(axis=1), 1)
    assert quality_model.passage_statistics(" \n").shape == (1, quality_model.STATISTICS)
    repeated = quality_model.passage_statistics("again " * 64)[0]
    assert repeated[quality_model.CLASSES + 2] == pytest.approx(1 / 64) and repeated[quality_model.CLASSES + 4] == pytest.approx(63 / 64)


@needs_tables
def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    got = QUERIES["op8_quality_model"](spark, SF_DIR)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(labels, "doc_id").toPandas()
    held = rows[rows.held_out]
    assert rows.score.between(0, 1).all() and (held.quality == held.predicted).mean() > 0.95


def test_quality_of_odd_rows(spark):
    for labels in (labelled(spark, "quality"), labelled(spark, "quality").where("quality = 1"), labelled(spark, "quality").where("false")):
        rows = quality_model.scored_quality(odd_docs(spark), labels).collect()
        assert len(rows) == len(base_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality_model.scored_quality(empty_docs(spark), labelled(spark, "quality")).count() == 0
