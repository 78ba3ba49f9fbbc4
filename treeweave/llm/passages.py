"""Remove passages that repeat from document to document, by repeated-phrase automata.

1. Phrases. Every window of words picks its least phrase (a few words, by hash), so equal windows pick the same one. Phrases
   picked in two documents or more, found by a pre-aggregated grouping, leave few windows that can recur at all.
2. Passages. These windows are grouped by hash: one that occurs in a later document too is owned by its first document. Owners'
   passages, runs of windows they own, are what the automata look for.
3. Automata. Documents are dealt into shards of bounded size. A shard gets the runs of windows that one of its documents holds,
   compiles an Aho-Corasick automaton of the runs' tiles and streams its documents through it. A tile is half a window, and
   every window of a run holds a whole one, so every occurrence is met; words around the tile are then compared one by one.

Runs of one shard occur in its documents, so an automaton grows with its shard and not with the corpus, and each document is
streamed once. Copies of a whole text are one class; only its first document takes part. Nothing is gathered by phrase or passage,
so one that a third of all documents hold costs a row per task and a piece per shard.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from treeweave.llm.near_duplicates import WordHashes, _mixed
from treeweave.llm.support import stored, utf8
from treeweave.session import ship_package

WINDOW = 50
PHRASE = 8
# Windows of a run that travel in one row; the next row overlaps by all but one word of a window.
RUN = 400
# Bytes of text per shard.
SHARD_BYTES = 4 << 20

_EMPTY = hashlib.sha256(b"").hexdigest()


def _codes(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def _chained(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` words."""
    total = np.full(len(codes) - size + 1, size, np.uint64)
    for place in range(size):
        total = _mixed(total + codes[place:place + len(total)])
    return total


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every run of `span` values."""
    reach = 1
    while reach * 2 <= span:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = span - reach
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def _window_hashes(codes: np.ndarray, window: int) -> np.ndarray:
    """Hash of every window, from running sums of powers modulo 2**64, mixed at the end."""
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    powers = np.cumprod(np.full(len(codes), base, np.uint64))
    back = np.cumprod(np.full(len(codes), inverse, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(codes) * powers)])
    return _mixed((sums[window:] - sums[:-window]) * back[:len(codes) - window + 1])


def _symbols(codes: np.ndarray) -> str:
    """A text with one character per word, for the automata; equal words have equal characters."""
    return ((codes % np.uint64(0x100000)) + np.uint64(0x10000)).astype("<u4").tobytes().decode("utf-32-le")


def _phrases(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """`id`, `row`, `n_words`, `sha` (digest of the words) and `phrases` (those that the windows pick)."""

    @F.pandas_udf("n_words long, sha string, phrases array<long>")
    def pick(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for texts in batches:
            counts, digests, picked = [], [], []
            for text in texts:
                words = text.split() if text else []
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest() if words else _EMPTY)
                if len(words) < window:
                    picked.append(None)
                    continue
                least = _least(_chained(_codes(words, hashes), phrase), window - phrase + 1)
                picked.append(np.unique(least).view(np.int64))
            yield pd.DataFrame({"n_words": counts, "sha": digests, "phrases": picked})

    return docs.select("id", "row", pick("bytes").alias("made")).select("id", "row", "made.*")


def _windows(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """`hash`, `id` of the windows whose phrase is among `shared`, once per document."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            for doc, text, shared in zip(batch["id"], batch["bytes"], batch["shared"]):
                words = text.split()
                if len(words) < window:
                    continue
                codes = _codes(words, hashes)
                least = _least(_chained(codes, phrase), window - phrase + 1)
                at = np.flatnonzero(np.isin(least, np.asarray(shared, np.int64).view(np.uint64)))
                if len(at):
                    yield pd.DataFrame({"hash": np.unique(_window_hashes(codes, window)[at]).view(np.int64), "id": doc})

    return docs.select("id", "bytes", "shared").mapInPandas(find, "hash long, id long")


def _owned_runs(owners: DataFrame, window: int) -> DataFrame:
    """`shard`, `id`, `codes`: the runs of owned windows of documents (`id`, `bytes`, `shards`), words as hashes.

    `shards` has for every shard the hashes of the windows that it needs of the document.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            for doc, text, shards in zip(batch["id"], batch["bytes"], batch["shards"]):
                codes = _codes(text.split(), hashes)
                if len(codes) < window:
                    continue
                found = _window_hashes(codes, window).view(np.int64)
                for part in shards:
                    # Of a window that repeats in the document its first place will do.
                    at = np.flatnonzero(np.isin(found, np.asarray(part["hashes"], np.int64)))
                    at = at[np.sort(np.unique(found[at], return_index=True)[1])]
                    # None in a row that shares its id with the one that holds them.
                    if len(at):
                        found_runs = [r.view(np.int64) for r in runs(codes, at, window)]
                        yield pd.DataFrame({"shard": part["shard"], "id": doc, "codes": found_runs})

    return owners.select("id", "bytes", "shards").mapInPandas(cut, "shard int, id long, codes array<long>")


def runs(codes: np.ndarray, starts: np.ndarray, window: int) -> list[np.ndarray]:
    """The words that windows at `starts` cover, one part for each run of at most `RUN` neighbouring windows."""
    starts = np.sort(starts)
    parts = np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1)
    return [codes[p[0]:p[-1] + window] for whole in parts for p in np.split(whole, range(RUN, len(whole), RUN))]


class PieceAutomaton:
    """Aho-Corasick automaton of the tiles of runs; marks the words of a document that lie in a common window."""

    def __init__(self, owners: list[int], pieces: list[np.ndarray], window: int):
        self.owners, self.pieces, self.window, self.tile = owners, pieces, window, window // 2
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for number, codes in enumerate(pieces):
            symbols = _symbols(codes)
            for start in range(0, len(symbols) - self.tile + 1, self.tile):
                places[symbols[start:start + self.tile]].append((number, start))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_STRING)
        for symbols, found in places.items():
            self.automaton.add_word(symbols, found)
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def covered(self, doc: int, codes: np.ndarray) -> np.ndarray:
        """Marks of the words covered by a window that a piece of a document with a smaller id holds as well."""
        marks = np.zeros(len(codes), bool)
        if self.empty or len(codes) < self.window:
            return marks
        compared: dict[tuple[int, int], int] = {}
        for end, found in self.automaton.iter(_symbols(codes)):
            start = end - self.tile + 1
            for number, place in found:
                if self.owners[number] >= doc:
                    continue
                shift = start - place
                if start < compared.get((number, shift), 0):
                    continue
                piece = self.pieces[number]
                begin, stop = max(shift, 0), min(shift + len(piece), len(codes))
                compared[number, shift] = stop
                equal = codes[begin:stop] == piece[begin - shift:stop - shift]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]]).astype(np.int8)))
                for first, last in zip(edges[::2], edges[1::2]):
                    if last - first >= self.window:
                        marks[begin + first:begin + last] = True
        return marks


def repeated_passages(
    docs: DataFrame,
    window: int = WINDOW,
    phrase: int = PHRASE,
    shard_bytes: int = SHARD_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: `doc_id`, `n_words`, `n_removed`, `kept_sha256` and `removed`, the (start, end) spans of words.

    Words are parted by ASCII white space and taken as they are. A word is removed if a window of `window` consecutive words
    that covers it also starts in a document with a smaller id, judged on the input. `removed` is null for a copy of
    a whole earlier text of at least one window, which goes as a whole. Null texts have no words; texts shorter than a window lose none.
    Ids are whole numbers; rows with a null id are neither judged nor compared with. Rows that repeat an id do not
    count against each other. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), utf8(F.col(text_col)).alias("bytes"))
    texts = texts.withColumn("row", F.hash("bytes"))
    every = stored(_phrases(texts, window, phrase), "phrases")
    classes = every.where("id IS NOT NULL").groupBy("sha").agg(F.min("id").alias("rep"))
    members = every.join(classes, "sha", "left")

    picked = members.where((F.col("id") == F.col("rep")) & (F.col("n_words") >= window)).select("id", F.explode("phrases").alias("phrase"))
    recurring = picked.groupBy("phrase").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    shared = picked.join(recurring.select("phrase"), "phrase").groupBy("id").agg(F.collect_set("phrase").alias("shared"))
    some = stored(texts.join(shared, "id"), "candidates")
    size = some.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shard = F.pmod(F.xxhash64("id"), F.lit(size // shard_bytes + 1)).cast("int")

    # A window that a later document holds as well: its owner's run goes to the shards of all documents that hold it.
    owned = (
        _windows(some, window, phrase).withColumn("shard", shard).groupBy("hash")
        .agg(F.min("id").alias("id"), F.max("id").alias("last"), F.collect_set("shard").alias("shards")).where("id < last")
    )
    needed = owned.select("id", "hash", F.explode("shards").alias("shard")).groupBy("id", "shard").agg(F.collect_list("hash").alias("hashes"))
    owners = some.join(needed.groupBy("id").agg(F.collect_list(F.struct("shard", "hashes")).alias("shards")), "id")
    pieces = _owned_runs(owners, window)

    def search(held: pd.DataFrame, sought: pd.DataFrame) -> pd.DataFrame:
        hashes = WordHashes()
        automaton = PieceAutomaton(sought["id"].tolist(), [np.asarray(c, np.int64).view(np.uint64) for c in sought["codes"]], window)
        out = []
        for doc, row, text in zip(held["id"], held["row"], held["bytes"]):
            words = text.split()
            marks = automaton.covered(doc, _codes(words, hashes))
            if marks.any():
                kept = b" ".join(w for w, gone in zip(words, marks.tolist()) if not gone)
                edges = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
                out.append((doc, row, int(marks.sum()), hashlib.sha256(kept).hexdigest(), edges[::2], edges[1::2]))
        return pd.DataFrame(out, columns=["id", "row", "n_removed", "kept_sha256", "starts", "ends"])

    searched = (
        some.select("id", "row", "bytes", shard.alias("shard")).groupBy("shard").cogroup(pieces.groupBy("shard"))
        .applyInPandas(search, "id long, row int, n_removed long, kept_sha256 string, starts array<long>, ends array<long>")
        .dropDuplicates(["id", "row"])
    )
    whole = (F.col("id") > F.col("rep")) & (F.col("n_words") >= window)
    spans = F.coalesce(F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")), F.array().cast("array<struct<start:long,end:long>>"))
    return members.join(searched, ["id", "row"], "left").select(
        F.col("id").alias("doc_id"), "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(~F.coalesce(whole, F.lit(False)), spans).alias("removed"),
    )
