"""Find stretches of words that repeat with a period, on grammar-compressed documents.

1. Re-Pair. The pair of neighbouring symbols that a document has most often becomes a symbol of its own, again and again, until no
   pair is there twice. Documents of a batch advance together, in rounds that replace every pair that is more frequent than the
   pairs it overlaps, so the most frequent pair of each document is replaced in each round. What is left is halved into a balanced tree.
2. Runs of a symbol. Each symbol is worked on once, at the boundary of its two parts. A run across a boundary has half of its words
   on one side, and that is more than a period: the words next to the boundary come again one period away. Only such
   distances are compared, word by word. Where a run was found, periods that would overlap it by both periods are no periods
   (Fine and Wilf), which leaves few distances in long runs.
3. Positions. The runs of a symbol are carried to all places where the document derives it. Every run of a document lies across
   the boundary of the smallest symbol that holds it, so it is found whole there; shorter pieces of it are merged into it.

A document is one row and never leaves its task; nothing is shuffled. Batches are cut by words, so memory follows the longest document.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from treeweave.session import ship_package

LEAST = 24
TIMES = 3
# Words that are worked on together; a longer document is worked on alone.
BATCH_WORDS = 1 << 19


def probe_size(least: int, times: int) -> int:
    """Words next to a boundary that must come again one period away, for every run that the boundary cuts."""
    return min(-(-max(least, times * q) // 2) - q for q in range(1, least + 1))


class Grammar:
    """Rules over the words of several documents; document `d` has the words from `bounds[d]` to `bounds[d + 1]`.

    Rule `r` writes symbol `first + r` as `left[r]`, `right[r]`; it stands for the words from `start[r]` to `end[r]`, cut at
    `mid[r]`. The last symbol left of a document is in `roots`.
    """

    def __init__(self, words: np.ndarray, bounds: np.ndarray):
        self.first = int(words.max()) + 1 if len(words) else 0
        self.length = np.ones(self.first, np.int64)
        self._parts: list[tuple[np.ndarray, ...]] = []
        docs = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self.bits = (self.first + len(words)).bit_length()
        if 2 * self.bits + len(bounds).bit_length() > 63:
            raise ValueError("too many words in one batch")
        symbols, places, docs = self._pairs(words, np.arange(len(words)), docs)
        symbols, _, docs = self._halves(symbols, places, docs)
        self.roots = dict(zip(docs.tolist(), symbols.tolist()))
        columns = zip(*self._parts) if self._parts else [[np.empty(0, np.int64)]] * 5
        self.left, self.right, self.start, self.mid, self.end = map(np.concatenate, columns)

    def _add(self, left, right, start, mid) -> np.ndarray:
        """Numbers of new symbols, one for each row."""
        self._parts.append((left, right, start, mid, mid + self.length[right]))
        begin = len(self.length)
        self.length = np.concatenate([self.length, self.length[left] + self.length[right]])
        return np.arange(begin, begin + len(left))

    def _pairs(self, symbols, places, docs):
        # Pairs that may be there twice: one that was there once stays alone until one of its symbols changes.
        live = docs[1:] == docs[:-1]
        while True:
            at = np.flatnonzero(live)
            keys = (docs[at] << 2 * self.bits) | (symbols[at] << self.bits) | symbols[at + 1]
            _, pair, count = np.unique(keys, return_inverse=True, return_counts=True)
            twice = count[pair] >= 2
            live[at[~twice]] = False
            at, pair = at[twice], pair[twice]
            if not len(at):
                return symbols, places, docs
            # Of equal pairs that overlap each other every second one counts.
            begins = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(pair) != 0)])
            stretch = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
            even = (np.arange(len(at)) - stretch) % 2 == 0
            at, pair = at[even], pair[even]
            count = np.bincount(pair, minlength=len(count))
            often = count[pair] >= 2
            at, pair = at[often], pair[often]
            # Equally frequent pairs take turns in an order that does not follow the text.
            rank = np.zeros(len(symbols) + 1, np.uint64)
            rank[at + 1] = (count[pair].astype(np.uint64) << np.uint64(32)) | ((pair.astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF))
            best = (rank[at + 1] > rank[at]) & (rank[at + 1] > rank[np.minimum(at + 2, len(symbols))])
            at, pair = at[best], pair[best]
            again = np.bincount(pair, minlength=len(count))[pair] >= 2
            at, pair = at[again], pair[again]
            if not len(at):
                return symbols, places, docs
            _, found, number = np.unique(pair, return_index=True, return_inverse=True)
            one = at[found]
            new = self._add(symbols[one], symbols[one + 1], places[one], places[one + 1])
            symbols = symbols.copy()
            symbols[at] = new[number]
            kept = np.ones(len(symbols), bool)
            kept[at + 1] = False
            # A pair lives on if it did before, and if one of its symbols is new.
            alive = np.append(live, False)
            alive[at] = True
            alive[at[at > 0] - 1] = True
            alive[at] |= alive[at + 1]
            symbols, places, docs, alive = symbols[kept], places[kept], docs[kept], alive[kept]
            fresh = symbols >= new[0]
            alive = alive[:-1] | fresh[:-1] | fresh[1:]
            live = alive & (docs[1:] == docs[:-1])

    def _halves(self, symbols, places, docs):
        while len(docs) and (docs[1:] == docs[:-1]).any():
            begins = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
            order = np.arange(len(docs)) - np.repeat(begins, np.diff(np.append(begins, len(docs))))
            at = np.flatnonzero((order[:-1] % 2 == 0) & (docs[1:] == docs[:-1]))
            new = self._add(symbols[at], symbols[at + 1], places[at], places[at + 1])
            symbols = symbols.copy()
            symbols[at] = new
            kept = np.ones(len(symbols), bool)
            kept[at + 1] = False
            symbols, places, docs = symbols[kept], places[kept], docs[kept]
        return symbols, places, docs

    def derived(self, wanted: set[int], starts: np.ndarray) -> dict[int, np.ndarray]:
        """For each of the `wanted` symbols all places where the documents, which begin at `starts`, derive it."""
        by_left, by_right = np.argsort(self.left, kind="stable"), np.argsort(self.right, kind="stable")
        lefts, rights = self.left[by_left], self.right[by_right]
        users: dict[int, list[tuple[int, int]]] = {}
        todo = list(wanted)
        while todo:
            symbol = todo.pop()
            if symbol in users:
                continue
            begin, stop = np.searchsorted(lefts, [symbol, symbol + 1])
            above = [(int(r) + self.first, 0) for r in by_left[begin:stop]]
            begin, stop = np.searchsorted(rights, [symbol, symbol + 1])
            above += [(int(r) + self.first, int(self.mid[r] - self.start[r])) for r in by_right[begin:stop]]
            users[symbol] = above
            todo += [user for user, _ in above]
        roots = {symbol: starts[doc] for doc, symbol in self.roots.items()}
        places: dict[int, np.ndarray] = {}
        # A rule is younger than its parts.
        for symbol in sorted(users, reverse=True):
            found = [places[user] + shift for user, shift in users[symbol]]
            if symbol in roots:
                found.append(np.array([roots[symbol]]))
            places[symbol] = np.concatenate(found)
        return places


def _equal_ahead(words: np.ndarray, a: int, b: int, most: int) -> int:
    """How many words from `a` on equal those from `b` on, at most `most`."""
    done, size = 0, 32
    while done < most:
        size = min(size, most - done)
        differ = words[a + done:a + done + size] != words[b + done:b + done + size]
        if differ.any():
            return done + int(differ.argmax())
        done, size = done + size, size * 2
    return done


def _equal_behind(words: np.ndarray, a: int, b: int, most: int) -> int:
    """The same for the words before `a` and before `b`."""
    done, size = 0, 32
    while done < most:
        size = min(size, most - done)
        differ = (words[a - done - size:a - done] != words[b - done - size:b - done])[::-1]
        if differ.any():
            return done + int(differ.argmax())
        done, size = done + size, size * 2
    return done


def _is_primitive(words: np.ndarray, start: int, period: int) -> bool:
    rest, prime = period, 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime == 0:
            shift = period // prime
            if _equal_ahead(words, start, start + shift, period - shift) == period - shift:
                return False
            while rest % prime == 0:
                rest //= prime
        prime += 1
    return True


class Repeats:
    """Places where the same few words come again within a document."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray, size: int):
        self.words, self.size = words, size
        count = max(len(words) - size + 1, 0)
        docs = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))[:count]
        mixed = docs
        for place in range(size):
            mixed = (mixed + words[place:place + count].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        # Hashes only suggest; every distance is compared on the words.
        self.order = np.argsort(mixed, kind="stable")
        self.rank = np.empty(count, np.int64)
        self.rank[self.order] = np.arange(count)
        sorted_ = mixed[self.order]
        edges = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1], [True]])) if count else np.array([0])
        group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        self.begin, self.stop = edges[:-1][group], edges[1:][group]

    def somewhere(self, at: np.ndarray, low: np.ndarray, high: np.ndarray, ahead: bool) -> np.ndarray:
        """Whether the next (or last) place with the words of `at` lies between `low` and `high`."""
        inside = (at >= 0) & (at < len(self.rank))
        rank = self.rank[np.where(inside, at, 0)]
        other = rank + (1 if ahead else -1)
        inside &= (other < self.stop[rank]) & (other >= self.begin[rank])
        there = self.order[np.where(inside, other, 0)]
        return inside & (there >= low) & (there + self.size <= high)

    def distances(self, at: int, low: int, high: int, ahead: bool) -> np.ndarray:
        """Distances, rising, to the places with the words of `at` that lie between `low` and `high`."""
        rank = self.rank[at]
        if ahead:
            there = self.order[rank + 1:self.stop[rank]]
            return there[:np.searchsorted(there, high - self.size, "right")] - at
        there = self.order[self.begin[rank]:rank]
        return (at - there[np.searchsorted(there, low):])[::-1]


def _runs_across(repeats: Repeats, start: int, mid: int, end: int, least: int, times: int, ahead: bool) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of runs in the words from `start` to `end` with at least half of their words on one side of `mid`."""
    words, size = repeats.words, repeats.size
    at = mid if ahead else mid - size
    distances = repeats.distances(at, start, end, ahead)
    found: list[tuple[int, int]] = []
    place = 0
    while place < len(distances):
        period = int(distances[place])
        # Period and overlap of a run found before that leave no room for this one, nor for any up to the bound.
        bound = max((reach - q for q, reach in found if period >= 2 * q and reach >= period + q), default=None)
        if bound is not None:
            place = int(np.searchsorted(distances, bound, "right"))
            continue
        place += 1
        if any(period % q == 0 and reach >= period for q, reach in found):
            continue
        low = at if ahead else at - period
        stop = low + period + _equal_ahead(words, low, low + period, end - low - period)
        begin = low - _equal_behind(words, low, low + period, low - start)
        if stop - begin >= max(least, times * period) and _is_primitive(words, begin, period):
            found.append((period, stop - mid if ahead else mid - begin))
            yield begin, stop, period


def batch_runs(words: np.ndarray, bounds: np.ndarray, least: int = LEAST, times: int = TIMES) -> dict[int, list[tuple[int, int, int]]]:
    """(start, length, period) of all runs, by number of the document, in order of start and period."""
    if len(words) < least:
        return {}
    grammar = Grammar(words, bounds)
    repeats = Repeats(words, bounds, probe_size(least, times))
    size = repeats.size
    large = grammar.end - grammar.start >= least
    right = large & repeats.somewhere(grammar.mid, grammar.mid, grammar.end, True)
    left = large & (grammar.mid - size >= grammar.start) & repeats.somewhere(grammar.mid - size, grammar.start, grammar.end, False)
    by_symbol: dict[int, set[tuple[int, int, int]]] = {}
    for rule in np.flatnonzero(left | right).tolist():
        start, mid, end = int(grammar.start[rule]), int(grammar.mid[rule]), int(grammar.end[rule])
        found: set[tuple[int, int, int]] = set()
        for ahead in (True, False):
            if (right if ahead else left)[rule]:
                found.update((b - start, s - start, q) for b, s, q in _runs_across(repeats, start, mid, end, least, times, ahead))
        if found:
            by_symbol[grammar.first + rule] = found
    places = grammar.derived(set(by_symbol), bounds[:-1])
    pieces: dict[int, set[tuple[int, int, int]]] = defaultdict(set)
    for symbol, found in by_symbol.items():
        owners = np.searchsorted(bounds, places[symbol], "right") - 1
        for place, doc in zip(places[symbol].tolist(), owners.tolist()):
            pieces[doc].update((q, place + b, -(place + s)) for b, s, q in found)
    return {doc: _maximal(found, int(bounds[doc])) for doc, found in pieces.items()}


def _maximal(pieces: set[tuple[int, int, int]], begin: int) -> list[tuple[int, int, int]]:
    """Pieces (period, start, -end) that lie in no other piece of their period, counted from `begin`."""
    kept, last = [], (0, 0)
    for period, start, end in sorted(pieces):
        if last[0] == period and -end <= last[1]:
            continue
        last = (period, -end)
        kept.append((start - begin, -end - start, period))
    return sorted(kept, key=lambda run: (run[0], run[2]))


def _batches(texts: pd.Series) -> Iterator[tuple[list[list[bytes]], np.ndarray, np.ndarray]]:
    """Documents as lists of words, all their words as numbers, and the bounds of documents."""

    def made(docs):
        numbers: dict[bytes, int] = defaultdict(itertools.count().__next__)
        bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        words = np.fromiter(map(numbers.__getitem__, itertools.chain.from_iterable(docs)), np.int64, int(bounds[-1]))
        return docs, words, bounds

    held: list[list[bytes]] = []
    total = 0
    for text in texts:
        words = text.split() if text else []
        if held and total + len(words) > BATCH_WORDS:
            yield made(held)
            held, total = [], 0
        held.append(words)
        total += len(words)
    if held:
        yield made(held)


def periodic_runs(
    docs: DataFrame, least: int = LEAST, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: `doc_id`, `n_words`, `runs` (`start`, `length`, `period`) and `collapsed`, the text without repeats.

    Words are parted by ASCII white space and numbered from 0. A run is a stretch of at least `least` words and `times` (3 or more)
    smallest periods that no neighbouring word continues; runs come in order of start, then period. `collapsed` (bytes) has the words that no
    run contains after its first period, joined by one space. Null and empty texts have no words, no runs and an empty `collapsed`.
    Rows stand for themselves, so null ids, repeated ids and repeated rows change nothing. Texts of any length are taken whole. Other
    columns are not read; an empty table gives no rows.
    """
    if times < 3 or probe_size(least, times) < 1:
        raise ValueError("a run has three periods or more")
    ship_package(docs.sparkSession)

    @F.pandas_udf("n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    def find(texts: pd.Series) -> pd.DataFrame:
        counts, runs, collapsed = [], [], []
        for held, words, bounds in _batches(texts):
            found = batch_runs(words, bounds, least, times)
            for number, doc in enumerate(held):
                here = found.get(number, [])
                counts.append(len(doc))
                runs.append([{"start": b, "length": n, "period": q} for b, n, q in here])
                if here:
                    gone = np.zeros(len(doc), bool)
                    for b, n, q in here:
                        gone[b + q:b + n] = True
                    doc = itertools.compress(doc, (~gone).tolist())
                collapsed.append(b" ".join(doc))
        return pd.DataFrame({"n_words": counts, "runs": runs, "collapsed": collapsed})

    made = docs.select(F.col(id_col).alias("doc_id"), find(F.col(text_col).cast("binary")).alias("made"))
    return made.select("doc_id", "made.*")
