"""Mine phrases by SETM: set-oriented mining on sorted relations of occurrences.

R1 holds the places of words, R2 those of pairs, and so on: sorted rows (place, group), where the words of a piece have neighbouring
places and pieces lie at least one place apart, so place + 1 is the next word of the same piece or nothing. Each length is made from
the one before:

1. group-count: occurrences are counted where they lie, and these counts are summed by group;
2. semi-join: groups that are frequent go back to the relations, occurrences of all others leave them;
3. merge-join: the relation meets itself on place and place + 1; two neighbouring groups of k words, which share all but one
   word, are an occurrence of a group of k + 1 words. Its words are those of R1 at its place and the k after it.

R1 is kept in shards of some megabytes of text, one row each with compressed columns, bucketed by shard, and so are the numbers of its
words. Of a longer relation only the places are written, one bit per place of R1, as its groups are found again by a merge-join with R1.
Joins run where a shard is and no occurrence is ever shuffled: what crosses the network is one row per shard and bucket of groups,
compressed, once per length, and a bit per group on the way back. A group that all documents share is sent once per shard. Frequent words
have numbers, and longer groups are told apart by the numbers of their words, never by a hash.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from treeweave.llm.support import UPPER, stored, stored_by, utf8
from treeweave.operators.ordering import with_running
from treeweave.session import ship_package

LEAST = 30
LONGEST = 4
TOP = 2_000
# A phrase goes if a longer one around it has this share of its occurrences, in percent.
ABSORBED = 80
SCALE = 2_000_000
# Bytes of text of one shard.
SHARD_BYTES = 8 << 20
# Rows of groups, one per shard and group, of one bucket on average, and shards that one task merges at most.
BUCKET_GROUPS = 1_000_000
MERGED_SHARDS = 16_384
# Columns that describe a word.
WORD = ["lang", "word"]

_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_LOWER = bytes.maketrans(_BREAKS + UPPER.encode(), b"." * len(_BREAKS) + UPPER.lower().encode())


class _Shard:
    """Words of some documents as numbers, and where they stand."""

    def __init__(self):
        self.numbers: dict[str, _Numbers] = {}
        self.langs: list[str] = []
        self.words: list[bytes] = []
        self.parts: list[np.ndarray] = []
        self.bytes = 0

    def add(self, lang: str, text: bytes) -> None:
        tokens = text.translate(_LOWER).replace(b".", b" . ").split()
        numbers = self.numbers.get(lang)
        if numbers is None:
            numbers = self.numbers[lang] = _Numbers(self, lang)
        tokens.append(b".")
        self.parts.append(np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens)))
        self.bytes += len(text)

    def row(self) -> pd.DataFrame:
        row = np.concatenate(self.parts)
        places = np.flatnonzero(row >= 0)
        items = row[places]
        counts = np.bincount(items, minlength=len(self.words))
        tags = {lang: b" " + lang.encode().hex().encode() for lang in self.numbers}
        words = pd.DataFrame({"key": [word + tags[lang] for word, lang in zip(self.words, self.langs)], "n": counts})
        totals = words["n"].groupby(np.array(self.langs, object)).sum()
        return pd.DataFrame({
            **_packed(places, items), **{c: [v] for c, v in _sent(words, WORD).items()}, "groups": len(words),
            "langs": [totals.index.tolist()], "totals": [totals.to_numpy(np.int64)],
        })


class _Numbers(dict):
    """Number of each word of a language in a shard; the break between pieces is -1."""

    def __init__(self, shard: _Shard, lang: str):
        super().__init__({b".": -1})
        self.shard, self.lang = shard, lang

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.shard.words)
        self.shard.words.append(word)
        self.shard.langs.append(self.lang)
        return number


def _packed(places: np.ndarray, items: np.ndarray) -> dict[str, list[bytes]]:
    """A sorted relation as two compressed columns; places are distances from the one before, mostly 1, and take little room."""
    packer = zstandard.ZstdCompressor()
    return {
        "gaps": [packer.compress(np.diff(places, prepend=-1).astype(np.int32).tobytes())],
        "items": [packer.compress(items.astype(np.int32).tobytes())],
    }


def _unpacked(gaps: bytes, items: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and groups of a relation."""
    opener = zstandard.ZstdDecompressor()
    places = np.cumsum(np.frombuffer(opener.decompress(gaps), np.int32), dtype=np.int64) - 1
    return places, np.frombuffer(opener.decompress(items), np.int32)


def _word_relation(docs: DataFrame, shard_bytes: int) -> DataFrame:
    """R1 by shard, with keys and counts of its `groups` in order of their number, and the words of each language."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = _Shard()
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["bytes"]):
                shard.add(lang, text)
                if shard.bytes >= shard_bytes:
                    yield shard.row()
                    shard = _Shard()
        if shard.parts:
            yield shard.row()

    columns = "gaps binary, items binary, keys binary, n binary, groups long, langs array<string>, totals array<long>"
    made = docs.mapInPandas(cut, columns)
    return made.select(F.monotonically_increasing_id().alias("shard"), "*")


def _words(size: int, first: int = 1) -> list[str]:
    """Columns with the numbers of the words of a group."""
    return [f"w{place}" for place in range(first, first + size)]


def _dealt(groups: pd.DataFrame, names: list[str], buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Bucket and numbers of the groups that fall into it, by their first word, for each bucket that has any."""
    if names == WORD:
        drawn = np.fromiter(map(zlib.crc32, groups["key"]), np.int64, len(groups)) % buckets
        order = np.argsort(drawn, kind="stable")
    else:
        mixed = np.zeros(len(groups), np.uint64)
        for name in names:
            mixed = (mixed ^ groups[name].to_numpy().astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(32)
        drawn = (mixed % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((groups["w1"].to_numpy(), drawn))
    found, first = np.unique(drawn[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, first[1:]) if len(found) else [])


def _shrunk(numbers: np.ndarray) -> bytes:
    """Numbers compressed, in 32 bits where these do: the first byte tells. Bytes of one weight lie together, so high ones take no room."""
    numbers = numbers.astype(np.int32 if np.abs(numbers).max(initial=0) < 1 << 31 else np.int64).ravel()
    weights = numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()
    return zstandard.ZstdCompressor().compress(bytes([numbers.itemsize]) + weights)


def _grown(data: bytes) -> np.ndarray:
    """What `_shrunk` has compressed."""
    data = zstandard.ZstdDecompressor().decompress(data)
    weights = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1).T
    return np.ascontiguousarray(weights).view(np.int32 if data[0] == 4 else np.int64).ravel().astype(np.int64)


def _sent(frame: pd.DataFrame, names: list[str]) -> dict[str, bytes]:
    """Keys and counts of some groups, compressed. The key of a word is the word, a blank and its language in hexadecimal digits."""
    if names == WORD:
        keys = zstandard.ZstdCompressor().compress(b"\n".join(frame["key"]))
    else:
        # The first words come in runs or in order: their distances are small.
        columns = frame[names].to_numpy(np.int64).T.copy()
        columns[0] = np.diff(columns[0], prepend=0)
        keys = _shrunk(columns)
    return {"keys": keys, "n": _shrunk(frame["n"].to_numpy(np.int64))}


def _received(keys: bytes, n: bytes, names: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of the keys of what `_sent` has packed, and the counts."""
    counts = _grown(n)
    if names == WORD:
        words = zstandard.ZstdDecompressor().decompress(keys).split(b"\n")
        return [np.fromiter(words if len(counts) else [], object, len(counts))], counts
    columns = _grown(keys).reshape(len(names), -1)
    columns[0] = np.cumsum(columns[0])
    return list(columns), counts


def _summed(rows: pd.DataFrame, names: list[str]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Groups of one bucket with their counts summed, in order of their keys; which of them each one received is; where rows end."""
    if names == WORD:
        # Words are held once each, not once per shard.
        each: dict[bytes, int] = defaultdict()
        each.default_factory = each.__len__
    columns, counts = [], []
    for keys, n in zip(rows["keys"], rows["n"]):
        received, n = _received(keys, n, names)
        columns.append([np.fromiter(map(each.__getitem__, received[0]), np.int64, len(n))] if names == WORD else received)
        counts.append(n)
    ends, n = np.cumsum([len(c) for c in counts]), np.concatenate(counts)
    columns = [np.concatenate(column) for column in zip(*columns)]
    if names == WORD:
        found = sorted(each)
        rank = np.empty(len(found), np.int64)
        rank[[each[key] for key in found]] = np.arange(len(found))
        of, keys = rank[columns[0]], {"key": found}
    else:
        order = np.lexsort(columns[::-1])
        columns = [column[order] for column in columns]
        new = np.ones(len(n), bool)
        new[1:] = np.any([column[1:] != column[:-1] for column in columns], axis=0)
        of = np.empty(len(n), np.int64)
        of[order] = np.cumsum(new) - 1
        keys = {name: column[new] for name, column in zip(names, columns)}
    summed = pd.DataFrame(keys)
    sums = np.zeros(len(summed), np.int64)
    np.add.at(sums, of, n)
    return summed.assign(n=sums), of, ends


class _Counts:
    """Groups of a relation counted over all shards, and the way back to the shards.

    `groups` tells for a row of the relation its groups, always in the same order; `rows` and `shards` are the number of rows of
    groups, or a bound of it, and of shards. Groups are dealt into buckets by hash. A shard sends one row per bucket, with the keys and
    counts of its groups compressed, and each shard is told which of its groups are frequent by one bit each, in the order in which it
    sent them, by the task that counts the bucket. Where there are more shards than one task should merge, some shards are merged
    first, and groups are sent once more for the answers.
    """

    def __init__(
        self, relation: DataFrame, groups: Callable[..., pd.DataFrame], names: list[str], rows: int, shards: int, least: int, label: str,
        bucket_groups: int, merged_shards: int,
    ):
        self.names, self.relation, self.groups = names, relation, groups
        self.buckets = buckets = 1 + rows // bucket_groups
        self.parts = 1 + shards // merged_shards
        sent = self._rows()
        if self.parts > 1:

            def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
                return pd.DataFrame([{"bucket": key[0], "shard": -1, **_sent(_summed(rows, names)[0], names)}])

            sent = sent.groupBy("bucket", "part").applyInPandas(merge, "bucket long, shard long, keys binary, n binary")
        keys = ["key", "w1"] if names == WORD else names

        def often(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            summed, of, ends = _summed(rows, names)
            often = summed["n"].to_numpy() >= least
            frequent = summed[often].rename(columns={"n": "f"})
            number = np.zeros(len(summed), np.int64)
            if names == WORD:
                # Frequent words have small numbers. Numbers differ between buckets, and a task that runs again gives the same ones.
                frequent = frequent.sort_values("f", ascending=False, kind="stable")
                frequent["w1"] = np.arange(len(frequent)) * buckets + key[0]
                number[frequent.index] = frequent["w1"]
            told = []
            for shard, at in zip(rows["shard"], np.split(of, ends[:-1])):
                if shard >= 0:
                    bits = often[at]
                    numbers = _shrunk(number[at[bits]]) if names == WORD else None
                    told.append({"shard": shard, "bits": np.packbits(bits).tobytes(), "numbers": numbers})
            answers = pd.DataFrame(told, columns=["shard", "bits", "numbers"], dtype=object).assign(**{c: None if c == "key" else 0 for c in keys}, f=0)
            frequent = frequent.assign(shard=-1, bits=None, numbers=None)
            return (pd.concat([frequent, answers]) if told else frequent).assign(bucket=key[0])

        columns = ", ".join(f"{c} {'binary' if c == 'key' else 'long'}" for c in keys)
        made = stored(sent.groupBy("bucket").applyInPandas(often, f"bucket long, {columns}, f long, shard long, bits binary, numbers binary"), label)
        # Rows of a shard are answers, the others frequent groups.
        self.frequent, self.answers = made.where("shard < 0").select("bucket", *keys, "f"), made.where("shard >= 0")

    def _rows(self) -> DataFrame:
        """(bucket, part, shard, keys, n), one row per shard and bucket."""
        names, buckets, parts, groups_of = self.names, self.buckets, self.parts, self.groups

        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    groups = groups_of(row)
                    rows = [
                        {"bucket": bucket, "part": row.shard % parts, "shard": row.shard, **_sent(groups.take(at), names)}
                        for bucket, at in _dealt(groups, names, buckets)
                    ]
                    if rows:
                        yield pd.DataFrame(rows)

        return self.relation.mapInPandas(send, "bucket long, part long, shard long, keys binary, n binary")

    def told(self) -> DataFrame:
        """(shard, told): per bucket of the shard a bit per group, and for words the numbers of the frequent ones."""
        names, answers = self.names, self.answers
        by, number = (["key"], "w1") if names == WORD else (names, "f")

        def tell(key: tuple, rows: pd.DataFrame, frequent: pd.DataFrame) -> pd.DataFrame:
            told = []
            for shard, keys, n in zip(rows["shard"], rows["keys"], rows["n"]):
                met = pd.DataFrame(dict(zip(by, _received(keys, n, names)[0]))).merge(frequent[[*by, number]], on=by, how="left")[number]
                bits = met.notna().to_numpy()
                numbers = _shrunk(met[bits].to_numpy(np.int64)) if names == WORD else None
                told.append({"shard": shard, "bucket": key[0], "bits": np.packbits(bits).tobytes(), "numbers": numbers})
            return pd.DataFrame(told, columns=["shard", "bucket", "bits", "numbers"])

        if self.parts > 1:
            frequent = self.frequent.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.parts - 1).cast("long"))))
            answers = self._rows().groupBy("bucket", "part").cogroup(frequent.groupBy("bucket", "part")).applyInPandas(
                tell, "shard long, bucket long, bits binary, numbers binary"
            )
        return answers.groupBy("shard").agg(F.collect_list(F.struct("bucket", "bits", "numbers")).alias("told"))


def _answers(groups: pd.DataFrame, told: list[dict], names: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Which groups of a shard are frequent, and for words their numbers."""
    of_bucket = {t["bucket"]: t for t in told}
    frequent, numbers = np.zeros(len(groups), bool), np.full(len(groups), -1)
    for bucket, at in _dealt(groups, names, buckets):
        answer = of_bucket[bucket]
        bits = np.unpackbits(np.frombuffer(answer["bits"], np.uint8), count=len(at)).astype(bool)
        frequent[at] = bits
        if names == WORD:
            numbers[at[bits]] = _grown(answer["numbers"])
    return frequent, numbers


def _small(rows: DataFrame) -> DataFrame:
    """Rows that a join by shard holds a bucket of at a time: the texts of the shards are neither sorted for it, nor `rows` sent through the driver."""
    return rows.hint("shuffle_hash")


def _known_words(row: tuple) -> pd.DataFrame:
    """Words of a shard of R1 with their counts."""
    (key,), n = _received(row.keys, row.n, WORD)
    return pd.DataFrame({"key": key, "n": n})


def _frequent_words(row: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of frequent words in a shard, these words as the shard numbers them, and the numbers that the words of the shard have."""
    places, items = _unpacked(row.gaps, row.items)
    numbers = _grown(row.numbers)
    kept = numbers[items] >= 0
    return places[kept], items[kept], numbers


def _neighbours(places: np.ndarray, kept: np.ndarray | None = None) -> np.ndarray:
    """Merge-join of a relation with itself: which of its rows, all or those `kept`, have one at the next place."""
    at = np.arange(len(places)) if kept is None else kept
    return at[:-1][places[at[1:]] == places[at[:-1]] + 1]


def _grouped(columns: list[np.ndarray], below: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of equal numbers, which are less than `below`: one row of each group, the group of each row, and the sizes of the groups."""
    bits = max(1, (below - 1).bit_length())
    keys, used = columns[0].astype(np.int64), bits
    for column in columns[1:]:
        if used + bits > 63:
            keys = np.unique(keys, return_inverse=True)[1].astype(np.int64)
            used = len(keys).bit_length()
        keys, used = (keys << bits) | column, used + bits
    found, of, n = np.unique(keys, return_inverse=True, return_counts=True)
    row = np.zeros(len(found), np.int64)
    row[of] = np.arange(len(of))
    return row, of, n


def _met(row: tuple, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pd.DataFrame]:
    """Places of the frequent words of a shard; those rows at which an occurrence of `size` words starts; their groups, and these."""
    places, items, numbers = _frequent_words(row)
    if size == 2:
        at = _neighbours(places)
    else:
        at = np.flatnonzero(np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(row.starts), np.uint8), count=len(places)))
    columns = [items[at + shift] for shift in range(size)]
    one, of, n = _grouped(columns, len(numbers))
    found = {name: numbers[column[one]] for name, column in zip(_words(size), columns)}
    return places, at, of, pd.DataFrame(found).assign(n=n)


def _groups(row: tuple, size: int) -> pd.DataFrame:
    """Groups of `size` words of a shard with their counts."""
    return _met(row, size)[-1]


def _numbered(relation: DataFrame, counts: _Counts) -> DataFrame:
    """(shard, numbers, rows): the numbers of the words of a shard, -1 for those that are not frequent, and its pairs of frequent words."""
    buckets = counts.buckets
    joined = relation.select("shard", "gaps", "items", "keys", "n").join(_small(counts.told()), "shard")

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                frequent, numbers = _answers(_known_words(row), row.told, WORD, buckets)
                places, items = _unpacked(row.gaps, row.items)
                yield pd.DataFrame([{"shard": row.shard, "numbers": _shrunk(numbers), "rows": len(_neighbours(places[frequent[items]]))}])

    return joined.mapInPandas(number, "shard long, numbers binary, rows long")


def _longer(relation: DataFrame, counts: _Counts, size: int) -> DataFrame:
    """(shard, starts, rows): where groups of `size` words start, a bit per frequent word, from the relation before it and its counts."""
    names, buckets = counts.names, counts.buckets

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                places, at, of, groups = _met(row, size - 1)
                frequent, _ = _answers(groups, row.told, names, buckets)
                at = _neighbours(places, at[frequent[of]])
                starts = np.zeros(len(places), bool)
                starts[at] = True
                yield pd.DataFrame([{"shard": row.shard, "starts": zstandard.ZstdCompressor().compress(np.packbits(starts).tobytes()), "rows": len(at)}])

    return relation.join(_small(counts.told()), "shard").mapInPandas(extend, "shard long, starts binary, rows long")


def _described(frequent: DataFrame, parts: DataFrame, size: int) -> DataFrame:
    """Groups (`w1`, ..., `f`) with `lang`, `phrase`, `last` word, and `heads` and `tails`: counts of their first and last 1, 2, ... words."""
    shorter = _words(size - 1)
    left = parts.select(*shorter, "lang", "phrase", "heads")
    right = parts.select(*[F.col(w).alias(to) for w, to in zip(shorter, _words(size - 1, 2))], "last", "tails")
    # Sorted and merged: frequent groups become more with the input and do not pass through the driver.
    return frequent.join(left.hint("merge"), shorter).join(right.hint("merge"), _words(size - 1, 2)).select(
        *_words(size), "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", F.col("f").alias("a"),
        F.concat("heads", F.array("f")).alias("heads"), F.concat("tails", F.array("f")).alias("tails"),
    )


def _lowest_cut(size: int, scale: int) -> Column:
    """`score`, `k`, `l` and `r` of the cut of a phrase of `size` words that scores lowest; the first of equal ones."""

    def cut(k: int) -> Column:
        head, tail = f"heads[{k - 1}]", f"tails[{size - k - 1}]"
        # Decimals of 128 bits: the products may pass 64 bits.
        wide = [f"CAST({c} AS DECIMAL(20, 0))" for c in (scale, "a", head, tail)]
        score = F.expr("{} * {} DIV ({} + {})".format(*wide))
        return F.struct(score.alias("score"), F.lit(k).alias("k"), F.expr(head).alias("l"), F.expr(tail).alias("r"))

    return F.array_min(F.array(*[cut(k) for k in range(1, size)]))


def collocations(
    docs: DataFrame,
    least: int = LEAST,
    longest: int = LONGEST,
    top: int = TOP,
    absorbed: int = ABSORBED,
    scale: int = SCALE,
    shard_bytes: int = SHARD_BYTES,
    bucket_groups: int = BUCKET_GROUPS,
    merged_shards: int = MERGED_SHARDS,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """The `top` phrases of each language: `lang`, `rank`, `phrase`, `a`, `l`, `r`, `n`, `score`, and `k`, the words before the cut.

    A-Z are lowered, texts fall into pieces at `.,;:!?` and line ends, pieces into words at blanks and tabs. A candidate has 2 to
    `longest` words and occurs `a >= least` times within pieces. Cut after `k` words, with `l` and `r` occurrences of its two parts, it scores
    floor(scale * a / (l + r)); the lowest cut counts, the first of equal ones. A candidate inside a longer one with at least
    `absorbed` percent of its occurrences goes. Order: score, then `a`, both falling, then phrase by bytes. `n` counts the words of the language.

    Texts are taken whole and a document that repeats counts as often as it is there. A null language is `und`; null and empty
    texts have no words. Other columns are not read. An empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), utf8(F.col(text_col)).alias("bytes"))
    words = stored_by(_word_relation(texts.where("octet_length(bytes) > 0"), shard_bytes), "occurrences1", "shard")
    per_lang = F.explode(F.arrays_zip("langs", "totals")).alias("word")
    totals = words.select(per_lang).groupBy(F.col("word.langs").alias("lang")).agg(F.sum("word.totals").alias("n"))
    rows, shards = words.agg(F.coalesce(F.sum("groups"), F.lit(0)), F.count(F.lit(1))).first()
    counts = _Counts(words.select("shard", "keys", "n"), _known_words, WORD, rows, shards, least, "words", bucket_groups, merged_shards)
    word = F.substring_index(F.decode("key", "ISO-8859-1"), " ", 1)
    lang = F.unhex(F.substring_index(F.decode("key", "ISO-8859-1"), " ", -1)).cast("string")
    phrase = F.encode(word, "ISO-8859-1").cast("string")
    parts = counts.frequent.select(
        "w1", lang.alias("lang"), phrase.alias("phrase"), phrase.alias("last"), F.col("f").alias("a"), F.array("f").alias("heads"), F.array("f").alias("tails")
    )
    found: list[DataFrame] = []
    for size in range(2, longest + 1):
        keys = _words(size)
        if size == 2:
            places = stored_by(_numbered(words, counts), "numbers", "shard")
            numbered = relation = words.select("shard", "gaps", "items").join(_small(places.select("shard", "numbers")), "shard")
        else:
            places = stored_by(_longer(relation, counts, size), f"occurrences{size}", "shard")
            relation = numbered.join(_small(places.select("shard", "starts")), "shard")
        # No shard has more groups than occurrences.
        rows = places.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        counts = _Counts(relation, partial(_groups, size=size), keys, rows, shards, least, f"known{size}", bucket_groups, merged_shards)
        parts = stored(_described(counts.frequent.select(*keys, "f"), parts, size), f"phrases{size}")
        if found:
            # Within a longer phrase of any length is within one of one word more, which occurs at least as often.
            shorter = _words(size - 1)
            inside = [parts.select(*[F.col(f"w{n + shift}").alias(f"w{n}") for n in range(1, size)], "a") for shift in (0, 1)]
            around = inside[0].union(inside[1]).groupBy(*shorter).agg(F.max("a").alias("around"))
            found[-1] = found[-1].join(around.hint("merge"), shorter, "left").where(f"around IS NULL OR 100 * around < {absorbed} * a")
        found.append(parts.withColumn("cut", _lowest_cut(size, scale)))
    found = [f.select("lang", "phrase", "a", "cut.*") for f in found]
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    ranked = with_running(every, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], number="rank")
    return ranked.where(F.col("rank") <= top).join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "k"
    )
