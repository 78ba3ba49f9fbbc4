"""Language of documents from hyperdimensional profiles of letter n-grams.

After Joshi, Halseth and Kanerva (2016). Every letter has a random vector of +1 and -1. An n-gram is its letters' vectors,
each permuted (rotated) by its place and bound (multiplied) together; a text is the bundle (sum) of its n-grams, and
a language the bundle of its texts. A document gets the language whose prototype has the greatest cosine.

A bundle is linear in the n-gram counts, so a batch of documents counts n-grams first and multiplies the counts with the vectors of
the n-grams that occur in it: the same sums, one matrix product per batch instead of one vector per letter.
Prototypes are learned from a bounded sample per language; whole texts are counted. Scoring reads each row once and shuffles nothing.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from treeweave.llm.support import code_points, decoded, fold, fresh, one_text, utf8
from treeweave.session import ship_package

DIMENSIONS = 1024
ORDER = 3
# Letters with vectors of their own: the gap between words is 0, a-z and the accented Latin letters follow, others share the rest.
OWN_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
SHARED_LETTERS = 37
SYMBOLS = 1 + len(OWN_LETTERS) + SHARED_LETTERS
# Documents per language that the prototypes are learned from.
SAMPLE_PER_LANGUAGE = 1_000
# Ids are ranked by a hash below this number.
RANKS = 1 << 40
# Letters counted in one matrix product, about; a longer text is counted on its own, as a whole.
BATCH_LETTERS = 400_000
UNKNOWN = "und"


@cache
def _symbol_table() -> np.ndarray:
    """Symbol of every code point; 0 for all that is no letter."""
    table = np.zeros(0x110000, np.uint8)
    first_shared = 1 + len(OWN_LETTERS)
    for code in range(0x80, 0x30000):
        if unicodedata.category(chr(code))[0] == "L":
            table[code] = first_shared + code % SHARED_LETTERS
    table[0x30000:0x40000] = first_shared + np.arange(0x10000) % SHARED_LETTERS
    for number, letter in enumerate(OWN_LETTERS, 1):
        table[ord(letter)] = number
    return table


@cache
def _letter_vectors(dimensions: int) -> np.ndarray:
    return np.random.default_rng(2016).integers(0, 2, (SYMBOLS, dimensions), dtype=np.int8) * np.int8(2) - np.int8(1)


def _gram_vectors(grams: np.ndarray, dimensions: int) -> np.ndarray:
    vectors = _letter_vectors(dimensions)
    bound = np.ones((len(grams), dimensions), np.int8)
    for place in range(ORDER):
        letters = grams // SYMBOLS ** (ORDER - 1 - place) % SYMBOLS
        bound *= np.roll(vectors, ORDER - 1 - place, axis=1)[letters]
    return bound


def _grams(text: str) -> np.ndarray:
    """Codes of the letter n-grams of a text with one gap around and between words; empty if it has no letter."""
    symbols = _symbol_table()[code_points(text.lower())]
    symbols = np.concatenate([[0], symbols, [0]]).astype(np.int64)
    symbols = symbols[np.concatenate([[True], (symbols[1:] > 0) | (symbols[:-1] > 0)])]
    if not symbols.any():
        return np.empty(0, np.int64)
    codes = np.zeros(max(len(symbols) - ORDER + 1, 0), np.int64)
    for place in range(ORDER):
        codes = codes * SYMBOLS + symbols[place:place + len(codes)]
    return codes


def bundles(texts: list[str], dimensions: int) -> np.ndarray:
    """Vectors of texts, one row each; zero for a text without letters."""
    out = np.zeros((len(texts), dimensions), np.float32)
    begin, held, letters = 0, [], 0

    def flush(end: int) -> None:
        if letters:
            codes = np.concatenate(held)
            seen = np.bincount(codes, minlength=SYMBOLS ** ORDER)
            used = np.flatnonzero(seen)
            place = np.zeros(SYMBOLS ** ORDER, np.int64)
            place[used] = np.arange(len(used))
            owner = np.repeat(np.arange(end - begin), [len(h) for h in held])
            counts = np.bincount(owner * len(used) + place[codes], minlength=(end - begin) * len(used))
            out[begin:end] = counts.reshape(end - begin, -1).astype(np.float32) @ _gram_vectors(used, dimensions).astype(np.float32)

    for number, text in enumerate(texts):
        codes = _grams(text)
        if held and (letters + len(codes) > BATCH_LETTERS or len(held) >= 512):
            flush(number)
            begin, held, letters = number, [], 0
        held.append(codes)
        letters += len(codes)
    flush(len(texts))
    return out


def language_prototypes(
    docs: DataFrame, learn: Column, per_language: int = SAMPLE_PER_LANGUAGE, dimensions: int = DIMENSIONS,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes, from at most `per_language` rows each for which `learn` holds.

    The ids of a language with the smallest hashes are taken, one text of each. Languages are counted first, so that only hashes
    below a bound that holds twice the wanted number are ranked; the ranks, bounded in number, are broadcast to the texts. Every
    text counts with length one, so long ones do not outweigh the rest. What reaches the driver is one vector per language.
    Rows without language, text or id teach nothing; without any row there is no language.
    """
    ship_package(docs.sparkSession)
    known = docs.where(learn & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    narrow = known.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.pmod(F.xxhash64(id_col), F.lit(RANKS)).alias("rank"))
    sizes = {r["lang"]: r["ids"] for r in narrow.groupBy("lang").agg(F.approx_count_distinct("id").alias("ids")).collect()}
    if not sizes:
        return [], np.zeros((0, dimensions))
    bounds = {lang: RANKS * 2 * per_language // max(ids, 2 * per_language) for lang, ids in sizes.items()}
    bound = F.element_at(F.create_map(*(F.lit(v) for pair in sorted(bounds.items()) for v in pair)), F.col("lang"))
    turn = F.row_number().over(W.partitionBy("lang").orderBy("rank", "id"))
    chosen = narrow.where(F.col("rank") < bound).distinct().withColumn("turn", turn).where(F.col("turn") <= per_language).select("id", "lang")
    texts = known.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), utf8(F.col(text_col)).alias("bytes"))

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = bundles([decoded(t) for t in batch["bytes"]], dimensions).astype(np.float64)
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
            for lang, rows in batch.groupby("lang").indices.items():
                yield pd.DataFrame({"lang": lang, "place": np.arange(dimensions), "value": vectors[rows].sum(axis=0)})

    sums = (
        one_text(texts.join(F.broadcast(chosen), ["id", "lang"]), "id", "lang").select("lang", "bytes").mapInPandas(bundle, "lang string, place int, value double")
        .groupBy("lang", "place").agg(F.sum("value").alias("value"))
        .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("parts"))
    )
    rows = sums.select("lang", F.transform("parts", lambda p: p["value"]).alias("values")).orderBy("lang").collect()
    prototypes = np.array([r["values"] for r in rows], np.float64).reshape(len(rows), dimensions)
    return [r["lang"] for r in rows], prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-9)


def with_language(
    docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", result: str = "language"
) -> DataFrame:
    """`docs` with a struct column `result`: `lang` and `score`, the cosine with its prototype, not below 0.

    A null or empty text and one without letters have language `und` and score 0; so has every text if no language was learned.
    Of equal cosines the first language by name counts. Very long texts are counted whole. Rows are judged one by one; an empty
    table stays empty. A column named `result` is replaced.
    """
    ship_package(docs.sparkSession)
    names, prototypes = model
    shared = docs.sparkSession.sparkContext.broadcast(prototypes.astype(np.float32))

    @F.pandas_udf("lang string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            vectors = bundles([decoded(t) for t in texts], shared.value.shape[1])
            norms = np.linalg.norm(vectors, axis=1)
            if not names:
                yield pd.DataFrame({"lang": [UNKNOWN] * len(texts), "score": 0.0})
                continue
            cosines = vectors @ shared.value.T / np.maximum(norms, 1e-9)[:, None]
            best = cosines.argmax(axis=1)
            found = norms > 0
            yield pd.DataFrame({
                "lang": [names[b] if f else UNKNOWN for b, f in zip(best, found)],
                "score": np.where(found, np.clip(cosines.max(axis=1), 0, 1), 0).astype(np.float64),
            })

    return docs.withColumn(result, judge(utf8(F.col(text_col))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id, 4) == 2, F.lit(False))


def predicted_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """`doc_id`, `held_out`, `lang_pred`, `score` of every row; learned from the rows that are not held out.

    Repeated rows are each returned; a null id is not held out and teaches nothing; an empty table gives none. Texts as in `with_language`.
    """
    model = language_prototypes(docs, ~held_out(F.col(id_col)), id_col=id_col, text_col=text_col, lang_col=lang_col)
    result = fresh(docs.columns, "_language")
    return with_language(docs, model, text_col, result).select(
        F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
        F.col(f"{result}.lang").alias("lang_pred"), F.col(f"{result}.score").alias("score"),
    )
