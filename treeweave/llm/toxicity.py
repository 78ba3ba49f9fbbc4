"""Toxicity of documents: a linear classifier on letter n-grams scaled by naive Bayes log-count ratios.

After Wang and Manning (2012). A document is the set of its character n-grams, hashed into buckets. The log-count ratio of
a bucket says how much more often toxic examples have it than others; buckets are scaled by their ratios, and a logistic
regression is fitted on the scaled features. Buckets with few examples of the label they speak for or a ratio near zero are left
out of the model; how many examples are few is chosen by folds within the examples.

The model is fitted in one task on a bounded sample of labelled rows and is one row; scoring reads every row once, whole texts,
and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from treeweave.llm.support import code_points, decoded, fold, fresh, labelled_sample, utf8
from treeweave.session import ship_package

ORDERS = (3, 4, 5)
BUCKETS = 1 << 20
# Labelled documents that the model is fitted on, at most.
SAMPLE = 8_000
# Examples of the label that a bucket speaks for which must have it: that of these with the least log loss over folds of the examples
# counts. None grows with the sample, so rare words count in large ones.
SUPPORTS = (2, 3, 5)
FOLDS = 3
LEAST_RATIO = 1.2
SMOOTHING = 0.5
PENALTY = 0.001
STEPS = 200
THRESHOLD = 0.3
# Letters of a very long text that are looked at together; parts overlap, so every n-gram is met.
PART = 1 << 20


def gram_buckets(text: str) -> Iterator[np.ndarray]:
    """Buckets of the character n-grams of a lower-cased text between two gaps, as they come."""
    codes = code_points(f" {text.lower()} ").astype(np.uint32)
    for begin in range(0, max(len(codes), 1), PART):
        part = codes[begin:begin + PART + max(ORDERS) - 1]
        for order in ORDERS:
            count = min(len(part) - order + 1, PART)
            if count > 0:
                total = np.full(count, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
                for place in range(order):
                    total = (total ^ part[place:place + count]) * np.uint32(0x85EBCA6B)
                    total ^= total >> np.uint32(15)
                yield total % np.uint32(BUCKETS)


def fold_loss(rows: list[np.ndarray], labels: np.ndarray, support: int) -> float:
    """Mean log loss of examples under models fitted on the other folds."""
    fold_of, losses = np.arange(len(rows)) % FOLDS, []
    for fold in range(FOLDS):
        inside = np.flatnonzero(fold_of != fold)
        model = ToxicityModel(*fit_scaled_logistic([rows[i] for i in inside], labels[inside], support))
        table = model.table()
        for i in np.flatnonzero(fold_of == fold):
            margin = table[rows[i]].sum(dtype=np.float64) + model.bias
            losses.append(np.logaddexp(0, -margin if labels[i] else margin))
    return float(np.mean(losses))


def chosen_support(rows: list[np.ndarray], labels: np.ndarray, supports: tuple[int, ...] = SUPPORTS) -> int:
    """The support with the least loss over folds; the smallest of equals."""
    if len(supports) == 1 or len(rows) < FOLDS or labels.min() == labels.max():
        return supports[0]
    return min(supports, key=lambda support: fold_loss(rows, labels, support))


def fit_scaled_logistic(rows: list[np.ndarray], labels: np.ndarray, support: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets, their weights (ratio included) and the intercept from documents' bucket sets."""
    positive, negative = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row, label in zip(rows, labels):
        (positive if label else negative)[row] += 1
    p, q = positive + SMOOTHING, negative + SMOOTHING
    # Shares of the documents of a class; with few of one class the prior, not the ratio, carries the difference.
    ratios = np.log(p / (labels.sum() + 1)) - np.log(q / (len(labels) - labels.sum() + 1))
    often = np.where(ratios > 0, positive, negative) >= support
    used = np.flatnonzero(often & (np.abs(ratios) >= LEAST_RATIO))
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    if not len(used) or labels.min(initial=1) == labels.max(initial=0):
        return used[:0], np.zeros(0), float(np.log(share / (1 - share)))
    place = np.full(BUCKETS, -1, np.int64)
    place[used] = np.arange(len(used))
    kept = [place[row][place[row] >= 0] for row in rows]
    owner = np.repeat(np.arange(len(rows)), [len(k) for k in kept])
    features = np.concatenate(kept)
    scale = ratios[used]
    weights, bias = np.zeros(len(used)), float(np.log(share / (1 - share)))
    # Full gradient steps with per-weight rates.
    first, second = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    values = scale[features]
    for step in range(1, STEPS + 1):
        margin = np.bincount(owner, weights[features] * values, minlength=len(rows)) + bias
        wrong = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels
        slope = np.bincount(features, wrong[owner] * values, minlength=len(used)) / len(rows) + PENALTY * weights
        slope = np.append(slope, wrong.mean())
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope * slope
        move = 0.02 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return used, weights * scale, float(bias)


@dataclass
class ToxicityModel:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        full = np.zeros(BUCKETS, np.float32)
        full[self.buckets] = self.weights
        return full


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, learn: Column, size: int = SAMPLE,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", supports: tuple[int, ...] = SUPPORTS,
) -> ToxicityModel:
    """The model of at most `size` labelled rows; without examples of both labels it scores their share, one half for none.

    Which of `supports` is used is chosen within these rows.
    """
    ship_package(docs.sparkSession)
    sample = labelled_sample(docs, labels, label_col, learn, size, id_col, text_col)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        rows = [
            np.unique(np.concatenate([np.unique(b) for b in gram_buckets(decoded(text))] or [np.empty(0, np.uint32)]))
            for text in group["bytes"]
        ]
        truth = group["label"].to_numpy(np.float64)
        used, weights, bias = fit_scaled_logistic(rows, truth, chosen_support(rows, truth, supports))
        return pd.DataFrame({"buckets": [used], "weights": [weights], "bias": [bias]})

    fitted = sample.groupBy(F.lit(0).alias("all")).applyInPandas(fit, "buckets array<long>, weights array<double>, bias double").first()
    if fitted is None:
        return ToxicityModel(np.empty(0, np.int64), np.empty(0), 0.0)
    return ToxicityModel(np.array(fitted["buckets"], np.int64), np.array(fitted["weights"]), fitted["bias"])


def with_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", result: str = "toxicity") -> DataFrame:
    """`docs` with a double column `result` from 0 to 1, higher for texts more likely toxic.

    A null text scores like an empty one, a very long one is read whole, in parts. Rows are judged one by one, so equal texts
    agree; an empty table stays empty. A column named `result` is replaced.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.buckets, model.weights.astype(np.float32), model.bias))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = ToxicityModel(*shared.value).table()
        bias = shared.value[2]
        for texts in batches:
            margins = np.full(len(texts), bias)
            for number, text in enumerate(texts):
                held = [b[table[b] != 0] for b in gram_buckets(decoded(text))]
                if held:
                    margins[number] += table[np.unique(np.concatenate(held))].sum(dtype=np.float64)
            yield pd.Series(1 / (1 + np.exp(-np.clip(margins, -30, 30))))

    return docs.withColumn(result, score(utf8(F.col(text_col))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id, 4) == 2, F.lit(False))


def scored_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `held_out`, `score`, `predicted` of every row; learned from the labelled rows that are not held out.

    Repeated rows are each returned; a null id is not held out and teaches nothing; an empty table gives none. Texts as in `with_toxicity`.
    """
    model = fit_toxicity(docs, labels, ~held_out(F.col(id_col)), id_col=id_col, text_col=text_col)
    result = fresh(docs.columns, "_toxicity")
    return with_toxicity(docs, model, text_col, result).select(
        F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(result).alias("score"),
        (F.col(result) >= THRESHOLD).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that score below `threshold`, with their columns."""
    result = fresh(docs.columns, "_toxicity")
    return with_toxicity(docs, model, text_col, result).where(F.col(result) < threshold).drop(result)
