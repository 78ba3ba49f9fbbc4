"""Find benchmark text in documents with the multi-pattern search of Wu and Manber, on words instead of letters.

A pattern is a window of consecutive words of a benchmark item. For patterns of length m, a table gives for every pair
of neighbouring words that occurs in some pattern how far the search may move on when it reads that pair at the end of
its window; any other pair moves it m - 1 words. A pair that ends a pattern selects the patterns filed under it, and
those whose first pair agrees too are compared word by word.

The benchmark is the stated query set. It goes through the driver in bounded blocks of windows, each broadcast on its own;
every task scans its documents against one block after the other and holds the tables of one block at a time. Documents
are read once, are not shuffled, and no group of equal texts exists anywhere, so copies and hot sources cost their share.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, functions as F

from treeweave.llm.support import fresh, utf8
from treeweave.session import ship_package

WINDOW = 10
# Windows of one block of the benchmark: its tables take about 100 MB in a task.
BLOCK_WINDOWS = 100_000
# Longer items are cut into pieces that overlap by all but one word of a window.
PIECE_WORDS = 2_000

_LETTERS = {ord("A") + i: ord("a") + i for i in range(26)}
# Letters, digits and all bytes of non-ASCII characters stay, A-Z is lower-cased, every other byte parts words.
WORD_BYTES = bytes(
    _LETTERS.get(b, b) if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)
)

Window = tuple[bytes, ...]


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class PatternTables:
    """Shift table and buckets of the patterns of one length."""

    def __init__(self, length: int, patterns: dict[Window, list[str]]):
        self.length = length
        self.block = min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[Window, int] = {}
        self.buckets: dict[Window, dict[Window, list[tuple[Window, list[str]]]]] = defaultdict(lambda: defaultdict(list))
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                pair = pattern[end - self.block:end]
                self.shift[pair] = min(self.shift.get(pair, self.far), length - end)
            self.buckets[pattern[-self.block:]][pattern[:self.block]].append((pattern, items))

    def search(self, words: list[bytes], hit: bytearray, found: set[str]) -> None:
        """Mark the words of every occurrence in `hit` and add the items to `found`."""
        length, block, far, shift = self.length, self.block, self.far, self.shift
        end, stop = length, len(words)
        while end <= stop:
            pair = tuple(words[end - block:end])
            step = shift.get(pair, far)
            if step:
                end += step
                continue
            start = end - length
            for pattern, items in self.buckets[pair].get(tuple(words[start:start + block]), ()):
                if tuple(words[start:end]) == pattern:
                    hit[start:end] = b"\x01" * length
                    found.update(items)
            end += 1


def build_tables(items: list[tuple[str | None, bytes, bool]], window: int) -> list[PatternTables]:
    """Tables by pattern length from (item id, words joined by spaces, whole item) pieces."""
    by_length: dict[int, dict[Window, list[str]]] = defaultdict(lambda: defaultdict(list))
    for item, joined, _ in items:
        words = joined.split()
        length = min(window, len(words))
        for start in range(len(words) - length + 1):
            owners = by_length[length][tuple(words[start:start + length])]
            if item is not None and item not in owners:
                owners.append(item)
    return [PatternTables(length, patterns) for length, patterns in by_length.items()]


def _blocks(benchmark: DataFrame, window: int, block_windows: int) -> Iterator[list[tuple[str | None, bytes, bool]]]:
    block: list[tuple[str | None, bytes, bool]] = []
    held = 0
    for item, text in benchmark.toLocalIterator():
        words = words_of(bytes(text) if text is not None else None)
        step = max(PIECE_WORDS - window + 1, 1)
        for start in range(0, max(len(words) - window + 1, min(len(words), 1)), step):
            piece = words[start:start + step + window - 1]
            block.append((item, b" ".join(piece), start == 0))
            held += max(len(piece) - window + 1, 1)
            if held >= block_windows:
                yield block
                block, held = [], 0
    if block:
        yield block


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    result: str = "hits",
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """`docs` with a struct column `result`: `n_words`, `n_hit` (words inside any occurrence), `item_ids` (sorted as strings).

    Words are runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased. An item of fewer words than the
    window, but not none, is one window. Null and empty texts, documents and items alike, have no words: they hit nothing.
    An item without an id marks words but is not listed; items of the same id count once. An empty benchmark hits nothing.
    Every row is judged on its own, so equal rows agree. A column of `docs` named `result` is replaced.
    """
    spark = docs.sparkSession
    ship_package(spark)
    items = benchmark.select(F.col(item_col).cast("string"), utf8(F.col(item_text_col)))
    blocks: list[Broadcast] = [spark.sparkContext.broadcast(b) for b in _blocks(items, window, block_windows)]

    @F.pandas_udf("n_words long, n_hit long, item_ids array<string>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        only = build_tables(blocks[0].value, window) if len(blocks) == 1 else None
        for texts in batches:
            words = [words_of(t) for t in texts] if len(blocks) != 1 else None
            hits = [None] * len(texts)
            found: list[set[str]] = [set() for _ in range(len(texts))]
            counts = [0] * len(texts)
            for tables in ([only] if only is not None else (build_tables(b.value, window) for b in blocks)):
                for i, text in enumerate(texts):
                    own = words[i] if words is not None else words_of(text)
                    counts[i] = len(own)
                    if hits[i] is None:
                        hits[i] = bytearray(len(own))
                    for table in tables:
                        table.search(own, hits[i], found[i])
                    if words is None:
                        hits[i] = hits[i].count(1)
            if not blocks:
                counts = [len(w) for w in words]
            yield pd.DataFrame({
                "n_words": counts,
                "n_hit": [h if isinstance(h, int) else h.count(1) if h else 0 for h in hits],
                "item_ids": [sorted(f, key=str.encode) for f in found],
            })

    return docs.withColumn(result, scan(utf8(F.col(text_col))))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that hold no benchmark window, with their columns; rows without words stay."""
    mark = fresh(docs.columns, "_hits")
    marked = benchmark_hits(docs, benchmark, result=mark, **options)
    return marked.where(F.col(f"{mark}.n_hit") == 0).drop(mark)
