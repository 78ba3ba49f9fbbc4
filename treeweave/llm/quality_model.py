"""Quality of documents by attention-based multiple-instance learning.

After Ilse, Tomczak and Welling (2018). A document is a bag of passages and only the bag has a label. An encoder maps
the statistics of each passage to a vector; gated attention gives every passage a weight; the weighted sum of the vectors is scored.
Encoder, attention and classifier are trained together from document labels.

The network is trained in one task on a bounded sample of labelled rows and is a few hundred numbers. All passages of the sampled
texts count; their statistics are made where the texts are, so texts never come together in a task. Scoring encodes every
passage of every text, one row at a time, and shuffles nothing but the sample.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from treeweave.llm.near_duplicates import _mixed
from treeweave.llm.support import code_points, decoded, fold, fresh, labelled_sample, utf8
from treeweave.session import ship_package

# Labelled documents that the network is trained on, at most.
SAMPLE = 6_000
PASSAGE_WORDS = 64
ENCODED = 16
ATTENTION = 8
# Times that all bags are trained on, bags of one step, and passages held at a time: a step adds up the slopes of its parts.
ROUNDS = 40
STEP_BAGS = 256
PART_PASSAGES = 20_000
RATE = 0.02
PENALTY = 1e-4
THRESHOLD = 0.3

SPACES = (0x20, *range(0x09, 0x0E))
OWN_CLASSES = ".,;:!?#*$%&|<>-'\"()"
CLASSES = 6 + len(OWN_CLASSES)
STATISTICS = CLASSES + 7


@cache
def _class_table() -> np.ndarray:
    table = np.full(0x110000, 5, np.uint8)
    for code in range(0x3000):
        kind = unicodedata.category(chr(code))
        table[code] = {"Ll": 0, "Lu": 1}.get(kind, {"L": 2, "N": 3, "P": 4}.get(kind[0], 5))
    table[0x3000:0x30000] = 2
    for number, char in enumerate(OWN_CLASSES):
        table[ord(char)] = 6 + number
    return table


def passage_statistics(text: str) -> np.ndarray:
    """Statistics of the passages of a text, one row each; one row of zeros for a text without words."""
    codes = code_points(text)
    inside = ~np.isin(codes, np.array(SPACES, np.uint32))
    begins = inside & ~np.concatenate([[False], inside[:-1]])
    word_of = np.cumsum(begins)[inside] - 1
    if not len(word_of):
        return np.zeros((1, STATISTICS), np.float32)
    chars = codes[inside]
    first = np.flatnonzero(np.concatenate([[True], np.diff(word_of) > 0]))
    lengths = np.diff(np.concatenate([first, [len(chars)]]))
    words = len(first)
    passages = (words - 1) // PASSAGE_WORDS + 1
    owner = np.arange(words) // PASSAGE_WORDS
    sizes = np.bincount(owner, minlength=passages)
    shares = np.bincount(owner[word_of] * CLASSES + _class_table()[chars], minlength=passages * CLASSES).reshape(passages, CLASSES)
    total = shares.sum(axis=1, keepdims=True)
    place = np.arange(len(chars)) - np.repeat(first, lengths)
    hashes = np.add.reduceat(_mixed(chars.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32))), first)

    def fresh_share(values: np.ndarray) -> np.ndarray:
        new = np.zeros(len(values))
        new[np.unique(values, return_index=True)[1]] = 1
        return np.bincount(owner[:len(values)], new, minlength=passages) / np.maximum(np.bincount(owner[:len(values)], minlength=passages), 1)

    same = np.zeros(words)
    same[1:] = hashes[1:] == hashes[:-1]
    triples = _mixed(hashes[:-2] + _mixed(hashes[1:-1] + _mixed(hashes[2:]))) if words > 2 else np.empty(0, np.uint64)
    mean = np.bincount(owner, lengths, minlength=passages) / sizes
    spread = np.sqrt(np.maximum(np.bincount(owner, lengths.astype(float) ** 2, minlength=passages) / sizes - mean ** 2, 0))
    return np.column_stack([
        shares / total, mean / 10, spread / 10, fresh_share(hashes), fresh_share(triples),
        np.bincount(owner, same, minlength=passages) / sizes, np.log1p(sizes) / 4, np.full(passages, np.log1p(passages) / 4),
    ]).astype(np.float32)


class AttentionModel:
    """Encoder, gated attention and classifier over standardised passage statistics."""

    SHAPES = {
        "encode": (STATISTICS, ENCODED), "encode_bias": (ENCODED,), "turn": (ENCODED, ATTENTION), "gate": (ENCODED, ATTENTION),
        "attend": (ATTENTION,), "score": (ENCODED,), "bias": (1,), "mean": (STATISTICS,), "spread": (STATISTICS,),
    }
    TRAINED = tuple(SHAPES)[:7]

    def __init__(self, values: dict[str, np.ndarray]):
        self.values = values

    @classmethod
    def begin(cls, passages: np.ndarray, share: float) -> AttentionModel:
        random = np.random.default_rng(2018)
        values = {n: random.normal(0, 1 / np.sqrt(s[0]), s) for n, s in cls.SHAPES.items()}
        values |= {"encode_bias": np.zeros(ENCODED), "bias": np.array([np.log(share / (1 - share))])}
        values |= {"mean": passages.mean(axis=0, dtype=np.float64), "spread": passages.std(axis=0, dtype=np.float64) + 0.05}
        return cls(values)

    @classmethod
    def unpacked(cls, flat: list[float]) -> AttentionModel:
        values, at = {}, 0
        for name, shape in cls.SHAPES.items():
            size = int(np.prod(shape))
            values[name] = np.array(flat[at:at + size]).reshape(shape)
            at += size
        return cls(values)

    def packed(self) -> list[float]:
        return np.concatenate([self.values[n].ravel() for n in self.SHAPES]).tolist()

    def forward(self, passages: np.ndarray, starts: np.ndarray) -> tuple:
        """Probabilities of bags, whose passages begin at `starts`, and what the backward pass needs."""
        v = self.values
        x = np.clip((passages - v["mean"]) / v["spread"], -6, 6)
        h = np.tanh(x @ v["encode"] + v["encode_bias"])
        t, g = np.tanh(h @ v["turn"]), 1 / (1 + np.exp(-(h @ v["gate"])))
        e = (t * g) @ v["attend"]
        sizes = np.diff(np.append(starts, len(passages)))
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a /= np.repeat(np.add.reduceat(a, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ v["score"] + v["bias"][0], -30, 30)))
        return p, (x, h, t, g, a, z, sizes)

    def slopes(self, passages: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        v = self.values
        p, (x, h, t, g, a, z, sizes) = self.forward(passages, starts)
        dm = (p - labels) / len(labels)
        dz = np.repeat(dm[:, None] * v["score"], sizes, axis=0)
        da = (dz * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
        dt, dg = de[:, None] * v["attend"] * g * (1 - t * t), de[:, None] * v["attend"] * t * g * (1 - g)
        dh = (dz * a[:, None] + dt @ v["turn"].T + dg @ v["gate"].T) * (1 - h * h)
        return {
            "encode": x.T @ dh, "encode_bias": dh.sum(axis=0), "turn": h.T @ dt, "gate": h.T @ dg, "attend": (t * g).T @ de,
            "score": z.T @ dm, "bias": np.array([dm.sum()]),
        }

    def step_slopes(self, bags: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Slopes over some bags, added up over parts of them, so that what is held does not grow with long bags beside others."""
        ends = np.cumsum([len(b) for b in bags])
        total = {n: np.zeros(self.SHAPES[n]) for n in self.TRAINED}
        for part in np.split(np.arange(len(bags)), np.flatnonzero(np.diff(ends // PART_PASSAGES)) + 1):
            sizes = [len(bags[i]) for i in part]
            passages = np.concatenate([bags[i] for i in part]).astype(np.float64)
            for name, slope in self.slopes(passages, np.cumsum([0, *sizes[:-1]]), labels[part]).items():
                total[name] += slope * (len(part) / len(bags))
        return total

    def train(self, bags: list[np.ndarray], labels: np.ndarray, rounds: int = ROUNDS) -> None:
        """Steps over all bags in drawn order, with slopes averaged and rates falling; the same for the same bags."""
        first = {n: 0.0 for n in self.TRAINED}
        second = {n: 0.0 for n in self.TRAINED}
        draw = np.random.default_rng(2018)
        per_round = -(-len(bags) // STEP_BAGS)
        for step in range(1, rounds * per_round + 1):
            if (step - 1) % per_round == 0:
                turns = np.array_split(draw.permutation(len(bags)), per_round)
            rate = RATE * (1 - (step - 1) / (rounds * per_round))
            chosen = turns[(step - 1) % per_round]
            for name, slope in self.step_slopes([bags[i] for i in chosen], labels[chosen]).items():
                slope = slope + (PENALTY * self.values[name] if name != "bias" else 0)
                first[name] = 0.9 * first[name] + 0.1 * slope
                second[name] = 0.99 * second[name] + 0.01 * slope * slope
                move = first[name] / (1 - 0.9 ** step) / (np.sqrt(second[name] / (1 - 0.99 ** step)) + 1e-8)
                self.values[name] = self.values[name] - rate * move


def fit_quality(
    docs: DataFrame, labels: DataFrame, learn: Column, size: int = SAMPLE,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> AttentionModel | None:
    """The network trained on at most `size` labelled rows; none if there are no examples of both labels."""
    ship_package(docs.sparkSession)
    sample = labelled_sample(docs, labels, label_col, learn, size, id_col, text_col)

    @F.pandas_udf("binary")
    def statistics(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: passage_statistics(decoded(text)).tobytes())

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        truth = group["label"].to_numpy(np.float64)
        if len(truth) == 0 or truth.min() == truth.max():
            return pd.DataFrame({"flat": pd.Series([], dtype=object)})
        bags = [np.frombuffer(b, np.float32).reshape(-1, STATISTICS) for b in group["bag"]]
        model = AttentionModel.begin(np.concatenate(bags), truth.mean())
        model.train(bags, truth)
        return pd.DataFrame({"flat": [model.packed()]})

    bags = sample.select("id", "label", statistics("bytes").alias("bag"))
    fitted = bags.groupBy(F.lit(0).alias("all")).applyInPandas(train, "flat array<double>").first()
    return AttentionModel.unpacked(fitted["flat"]) if fitted else None


def with_quality(docs: DataFrame, model: AttentionModel | None, text_col: str = "text", result: str = "quality_score") -> DataFrame:
    """`docs` with a double column `result` from 0 to 1, higher for texts more likely good; one half without a model.

    A null text and one without words are a bag of one blank passage; of a very long text all passages count. Rows are judged
    one by one, so equal texts agree; an empty table stays empty. A column named `result` is replaced.
    """
    if model is None:
        return docs.withColumn(result, F.lit(0.5))
    ship_package(docs.sparkSession)
    flat = model.packed()

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        network = AttentionModel.unpacked(flat)
        for texts in batches:
            scores = np.zeros(len(texts))
            for begin in range(0, len(texts), 256):
                bags = [passage_statistics(decoded(t)) for t in texts.iloc[begin:begin + 256]]
                starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]])
                scores[begin:begin + 256] = network.forward(np.concatenate(bags).astype(np.float64), starts)[0]
            yield pd.Series(scores)

    return docs.withColumn(result, score(utf8(F.col(text_col))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id, 5) == 0, F.lit(False))


def scored_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `held_out`, `score`, `predicted` of every row; learned from the labelled rows that are not held out.

    Repeated rows are each returned; a null id is not held out and teaches nothing; an empty table gives none. Texts as in `with_quality`.
    """
    model = fit_quality(docs, labels, ~held_out(F.col(id_col)), id_col=id_col, text_col=text_col)
    result = fresh(docs.columns, "_quality")
    return with_quality(docs, model, text_col, result).select(
        F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(result).alias("score"),
        (F.col(result) >= THRESHOLD).cast("int").alias("predicted"),
    )
