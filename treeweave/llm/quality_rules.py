"""Quality rules: a learned decision list over document statistics, as one ordered conditional expression.

Sequential covering in the manner of Cohen's RIPPER (1995), simplified. A rule is a conjunction of thresholds on readable ratios.
It grows condition by condition by information gain on two thirds of the examples, is pruned from its end on the rest, and is
kept if it is right often enough there; the examples it covers are set aside and the next rule is sought. The rules become
`CASE WHEN ... THEN` branches in their order, so Spark judges every row where it is read.

The rules are learned from statistics of a bounded sample of labelled rows, a dozen numbers each, on the driver. The
statistics of whole texts are counted in one pass without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from treeweave.llm.support import fold, fresh, labelled_sample, utf8
from treeweave.session import ship_package

# Labelled documents that rules are learned from, at most.
SAMPLE = 8_000
LEAST_WORDS = 50
MOST_REPEAT_PERCENT = 50
# Share of the documents covered by a rule, held back from growing it, that must be bad.
LEAST_RIGHT = 0.9
# Examples of bad quality that a rule must cover.
LEAST_COVERED = 5
MOST_CONDITIONS = 4
CUTS = 64

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_distinct", "n_bare_symbols",
)
# Readable ratio -> (count, per count).
RATIOS = {
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "bare_symbol_share": ("n_bare_symbols", "n_words"),
}
_SPACE = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"


def text_counts(text: bytes | None) -> tuple[int, ...]:
    """The `COUNTS` of a text; all 0 for null."""
    text = text or b""
    words = text.split()
    # Code points in words: bytes that neither continue a character nor are white space.
    chars = len(text.translate(None, _SPACE + bytes(range(0x80, 0xC0))))
    lines = [line for line in text.split(b"\n") if line.strip(_SPACE)]
    counted = Counter(words)
    repeated = 0
    if len(words) > 2:
        numbers = {word: i for i, word in enumerate(counted)}
        codes = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        # Two steps, so that codes stay small whatever the number of words.
        _, pairs = np.unique(codes[:-1] * len(numbers) + codes[1:], return_inverse=True)
        _, triples, times = np.unique(pairs[:-1] * len(numbers) + codes[2:], return_inverse=True, return_counts=True)
        again = np.flatnonzero(times[triples] > 1)
        marks = np.zeros(len(words), bool)
        for place in range(3):
            marks[again + place] = True
        repeated = int(marks.sum())
    return (
        len(words), chars, len(text) - len(text.translate(None, _SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated,
        len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")), len(text) - len(text.translate(None, b"!?")),
        len(counted), sum(n for word, n in counted.items() if not word.strip(_SYMBOLS)),
    )


def with_counts(docs: DataFrame, text_col: str = "text", result: str = "counts") -> DataFrame:
    """`docs` with a struct column `result` of the `COUNTS` of each text; a column of that name is replaced."""
    ship_package(docs.sparkSession)

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([text_counts(t) for t in texts], columns=list(COUNTS)).astype("int64")

    return docs.withColumn(result, count(utf8(F.col(text_col))))


@dataclass(frozen=True)
class Condition:
    ratio: str
    above: bool
    cut: float

    def holds(self, ratios: dict[str, np.ndarray]) -> np.ndarray:
        return ratios[self.ratio] > self.cut if self.above else ratios[self.ratio] <= self.cut

    def column(self, counts: str) -> Column:
        value = ratio_column(counts, self.ratio)
        return value > F.lit(self.cut) if self.above else value <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.ratio} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def ratio_column(counts: str, ratio: str) -> Column:
    count, per = RATIOS[ratio]
    return F.col(f"{counts}.{count}").cast("double") / F.greatest(F.col(f"{counts}.{per}"), F.lit(1)).cast("double")


def _ratios(examples: pd.DataFrame) -> dict[str, np.ndarray]:
    return {r: examples[c].to_numpy(float) / np.maximum(examples[per].to_numpy(float), 1) for r, (c, per) in RATIOS.items()}


def _covered(rule: Rule, ratios: dict[str, np.ndarray], size: int) -> np.ndarray:
    held = np.ones(size, bool)
    for condition in rule:
        held &= condition.holds(ratios)
    return held


def _grown(ratios: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule: Rule = ()
    held = np.ones(len(bad), bool)
    while len(rule) < MOST_CONDITIONS and bad[held].any() and not bad[held].all():
        share = np.log2(bad[held].mean())
        best, gain = None, 1e-9
        for name, values in ratios.items():
            cuts = np.unique(np.quantile(values[held], np.linspace(0, 1, CUTS + 1), method="lower"))
            # Half way to the next value seen, so that a cut does not hang on one example.
            ordered = np.unique(values[held])
            following = ordered[np.minimum(np.searchsorted(ordered, cuts, side="right"), len(ordered) - 1)]
            for cut in np.unique((cuts + following) / 2):
                for above in (True, False):
                    condition = Condition(name, above, float(cut))
                    inside = held & condition.holds(ratios)
                    good_hits = bad[inside].sum()
                    if good_hits and (found := good_hits * (np.log2(bad[inside].mean()) - share)) > gain:
                        best, gain = condition, found
        if best is None:
            break
        rule += (best,)
        held &= best.holds(ratios)
    return rule


def learn_rules(examples: pd.DataFrame) -> list[Rule]:
    """Rules that find examples with label 0, in order, from rows of `COUNTS`, `label` and `held_back` (bool)."""
    rules: list[Rule] = []
    left = examples
    while (left["label"] == 0).sum() >= LEAST_COVERED:
        grow, prune = left[~left["held_back"]], left[left["held_back"]]
        rule = _grown(_ratios(grow), (grow["label"] == 0).to_numpy())
        ratios, bad = _ratios(prune), (prune["label"] == 0).to_numpy()

        def worth(length: int) -> float:
            inside = bad[_covered(rule[:length], ratios, len(bad))]
            return (inside.sum() + 1) / (len(inside) + 2)

        if not rule:
            break
        rule = rule[:max(range(1, len(rule) + 1), key=lambda n: (worth(n), -n))]
        inside = _covered(rule, _ratios(left), len(left))
        covered = left["label"].to_numpy()[inside]
        if worth(len(rule)) < LEAST_RIGHT or (covered == 0).sum() < LEAST_COVERED:
            break
        rules.append(rule)
        left = left[~inside]
    return rules


def base_failed(counts: str) -> Column:
    words, repeated = F.col(f"{counts}.n_words"), F.col(f"{counts}.n_repeat_words")
    return (words < LEAST_WORDS) | (100 * repeated > MOST_REPEAT_PERCENT * words)


def fit_rules(
    docs: DataFrame, labels: DataFrame, learn: Column, size: int = SAMPLE,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> list[Rule]:
    """Rules from at most `size` labelled rows that pass the base rules; no rules if there are no examples of bad quality."""
    sample = labelled_sample(docs, labels, label_col, learn, size, id_col, text_col)
    counted = with_counts(sample, "bytes", "counts").where(~base_failed("counts"))
    rows = counted.select("id", "label", (F.pmod(F.xxhash64("id", F.lit("prune")), F.lit(3)) == 0).alias("held_back"), "counts.*")
    examples = rows.toPandas().sort_values(["id", *COUNTS]).reset_index(drop=True)
    examples["held_back"] = examples["held_back"].astype(bool)
    return learn_rules(examples)


def verdict(rules: list[Rule], counts: str) -> Column:
    """Text of the first rule that holds, in order; null if none does."""
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for rule in rules:
        holds = rule[0].column(counts)
        for condition in rule[1:]:
            holds = holds & condition.column(counts)
        chain = chain.when(holds, F.lit(" AND ".join(map(str, rule))))
    return chain


def judged_quality(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `doc_id`, the `COUNTS`, `base_failed`, `rule` (the one that rejects, else null), `kept`.

    Base rules come first: too few words, or too many in repeated windows. A null or empty text has no words and fails them.
    Rows are judged one by one, so equal texts agree. Columns other than id and text are not read.
    """
    counts = fresh(docs.columns, "_counts")
    counted = with_counts(docs.select(F.col(id_col), F.col(text_col)), text_col, counts)
    rule = F.when(~base_failed(counts), verdict(rules, counts))
    return counted.select(
        F.col(id_col).alias("doc_id"), *[F.col(f"{counts}.{c}").alias(c) for c in COUNTS],
        base_failed(counts).alias("base_failed"), rule.alias("rule"), (~base_failed(counts) & rule.isNull()).alias("kept"),
    )


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id, 4) == 2, F.lit(False))
