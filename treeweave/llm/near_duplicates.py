"""Near-duplicate documents by chosen-path set similarity join.

After Christiani, Pagh and Sivertsen (2018). A document is the set of its word shingles. In a tree, a node holds documents;
it selects coordinates of the min-wise sketch, 1 / threshold of them on average, and passes every document on to one child
per selected coordinate and token. A pair as similar as the threshold stays together in one child on average, a less similar
pair gets lost on the way down. Small nodes are compared exhaustively; independent trees repeat this until the wanted
share of links is reached.

How it runs on Spark:

* Documents with equal shingle sets are one class with one representative, found by a pre-aggregated grouping.
* Which children a document goes to depends on its own sketch only, so the first levels of all trees are made where the
  sketch is, and single-document nodes, nearly all, go by counting narrow rows (node, id).
* All documents of a node are compared with one pivot first. Confirmed links make components, and a node whose documents are
  all of one component is done, whatever its size: thousands of copies are one star and never pairs among themselves.
* Small nodes with several components are compared exhaustively across components: on the sketches first, and where these leave
  candidates, on the full sets. Only links that join components leave the comparison, never pairs.
* Large nodes branch on with one coordinate more, so a pair at the threshold multiplies on the way down and is found as surely as
  at the first levels (`chance_missed`). A node still large after `DEPTH` levels is compared in blocks, so nothing is capped.
* Full shingle sets are made again from the texts of candidates alone. Partners of one pivot are dealt into parts of bounded
  size, each with a copy of its text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from treeweave.llm.support import fresh, stored, utf8
from treeweave.session import pin, ship_package

SHINGLE = 5
PERCENT = 80
SKETCH = 128
TREES = 12
# Levels made at once: enough that a line or passage which many documents share does not bring them together.
FIRST_LEVELS = 3
# Documents of a node that is compared whole, and of two blocks of a larger one.
SMALL = 4_096
DEPTH = 6
# Partners of one document that are confirmed in one group.
PART = 200
# A sketch estimate may be this many standard deviations below the threshold before a pair is taken to be no candidate.
SIGMAS = 4.8

_MULTIPLIERS = np.random.default_rng(20180402).integers(1, 1 << 62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_COORDINATES = np.random.default_rng(20180403).integers(0, 1 << 32, (2, SKETCH), dtype=np.uint32) | np.uint32(1)


class WordHashes(dict):
    """64-bit hashes of words, kept while a vocabulary is small enough."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < 500_000:
            self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: bytes | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, one without words has none."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    count = len(words) - size + 1
    total = np.full(count, size, np.uint64)
    for place in range(size):
        total = _mixed(total + codes[place:place + count]) * _MULTIPLIERS[place % 16]
    return np.unique(_mixed(total))


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    """Min-wise tokens of a non-empty set, one per coordinate; the low bits of a token are its coordinate's number."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    tokens = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    for begin in range(0, len(low), 1024):
        part = (low[begin:begin + 1024, None] ^ _COORDINATES[0]) * _COORDINATES[1]
        np.minimum(tokens, part.min(axis=0), out=tokens)
    return ((tokens << np.uint32(7)) | np.arange(SKETCH, dtype=np.uint32)).view(np.int32)


def shingle_sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """`id`, `n_shingles`, `set_key` (digest of the shingle set) and `sketch`; the last two null for an empty set."""

    @F.pandas_udf("n_shingles long, set_key binary, sketch array<int>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for texts in batches:
            sizes, keys, sketches = [], [], []
            for text in texts:
                found = shingle_hashes(text, shingle, hashes)
                sizes.append(len(found))
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                sketches.append(sketch_of(found) if len(found) else None)
            yield pd.DataFrame({"n_shingles": sizes, "set_key": keys, "sketch": sketches})

    return docs.select("id", sketch("bytes").alias("made")).select("id", "made.*")


def branches(rows: DataFrame, percent: int, more: int = 0) -> DataFrame:
    """Children (`node`, other columns) of rows (`node`, `sketch`, ...): 100 / percent + `more` selected coordinates on average."""
    sure = 100 // percent + more
    extra = F.pmod(F.xxhash64("node", F.lit("extra")), F.lit(1_000_000)) < int(1_000_000 * (100 / percent - 100 // percent))

    def children(count: int) -> Column:
        picked = [F.pmod(F.xxhash64("node", F.lit(f"pick {i}")), F.lit(SKETCH)).cast("int") for i in range(count)]
        return F.array_distinct(F.array(*[F.xxhash64("node", c, F.get("sketch", c)) for c in picked]))

    others = [c for c in rows.columns if c != "node"]
    return rows.select(F.explode(F.when(extra, children(sure + 1)).otherwise(children(sure))).alias("node"), *others)


def chance_missed(percent: int, trees: int, depth: int) -> float:
    """How likely no tree keeps a pair of exactly the threshold together down to `depth`, over all sketches the pair may have."""
    share, sure, total = percent / 100, 100 // percent, 0.0
    for agreed in range(SKETCH + 1):
        lost = 0.0
        for level in range(depth, 0, -1):
            one = 1 - agreed / SKETCH * (1 - lost)
            picks = sure + (level > FIRST_LEVELS)
            lost = one ** picks * (1 - (100 / percent - sure) * (1 - one))
        total += math.comb(SKETCH, agreed) * share ** agreed * (1 - share) ** (SKETCH - agreed) * lost ** trees
    return total


def least_agreement(percent: int) -> int:
    share = percent / 100
    return max(1, math.floor(SKETCH * share - SIGMAS * math.sqrt(SKETCH * share * (1 - share))))


def confirmed(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The distinct pairs (`a`, `b`) whose full sets are similar enough; `docs` has the texts (`id`, `bytes`)."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(PART)).cast("int").alias("parts"))
    partners = pairs.join(parts, "a").select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"))
    centres = parts.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    texts = docs.join(partners.union(centres), "id").select("a", "part", "id", "bytes")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        hashes = WordHashes()
        centre = group["a"].iloc[0]
        sets = [shingle_hashes(text, shingle, hashes) for text in group["bytes"]]
        own = [s for s, i in zip(sets, group["id"]) if i == centre]
        linked = set()
        for other, i in zip(sets, group["id"]):
            for mine in own if i != centre else ():
                shared = len(np.intersect1d(mine, other, assume_unique=True))
                if shared and 100 * shared >= percent * (len(mine) + len(other) - shared):
                    linked.add(i)
        return pd.DataFrame({"a": np.full(len(linked), centre, np.int64), "b": np.array(sorted(linked), np.int64)})

    return texts.groupBy("a", "part").applyInPandas(compare, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """`id`, `component` (its smallest id) for every id in `links` (`a`, `b`), by alternating star steps.

    After Kiveris and others (2014). Each step pins its edges in the shared folder. A centre's neighbours are never gathered:
    only the smallest is, by a pre-aggregated minimum, and the edges meet it in a join.
    """
    edges = pin(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        # Large star: every larger neighbour of a node meets the smallest of the node and its neighbours.
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: smaller neighbours of a node, and the node itself, meet the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = pin(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        # Done when every node has one edge and no centre has an edge of its own.
        ends = edges.select("u", F.lit(1).alias("n")).union(edges.select(F.col("v").alias("u"), F.lit(0).alias("n")).distinct())
        if ends.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("own")).where("own > 1 OR (own = 1 AND n > 1)").isEmpty():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )


def candidate_clusters(rows: DataFrame, least: int) -> DataFrame:
    """Distinct (`cluster`, `id`): within small groups, the documents that candidates of different components connect.

    `rows`: `group`, `id`, `component`, `side`, `sketch`; rows of one group with sides from 0 on pair across sides only. A cluster is
    named by its ids, so one that several trees find counts once. Documents without any candidate are in none.
    """
    grouped = rows.groupBy("group").agg(F.collect_list(F.struct("id", "component", "side", "sketch")).alias("members"))

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("members")
            offsets = members.offsets.to_numpy()
            flat = members.flatten()
            ids, parts, sides = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("id", "component", "side"))
            tokens = flat.field("sketch").flatten().to_numpy(zero_copy_only=False).reshape(-1, SKETCH)
            names, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for begin, end in zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0]):
                own, part, side = tokens[begin:end], parts[begin:end], sides[begin:end]
                left, right = candidates(own, part, side, least)
                labels = np.arange(len(own))
                while True:
                    lower = np.minimum(labels[left], labels[right])
                    if (labels[left] == labels[right]).all():
                        break
                    np.minimum.at(labels, left, lower)
                    np.minimum.at(labels, right, lower)
                used = np.union1d(left, right)
                for label in np.unique(labels[used]):
                    cluster = np.unique(ids[begin + used[labels[used] == label]])
                    names.append(np.full(len(cluster), xxhash.xxh64_intdigest(cluster.tobytes()) >> 1, np.int64))
                    found.append(cluster)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), pa.array(np.concatenate(found))], ["cluster", "id"])

    return grouped.select("members").mapInArrow(connect, "cluster long, id long").distinct()


def candidates(tokens: np.ndarray, parts: np.ndarray, sides: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of different components whose sketches agree enough; sides from 0 on pair across sides only.

    Two documents of the largest component are never compared, so the work follows the pairs across components.
    """
    names, counts = np.unique(parts, return_counts=True)
    rest = np.flatnonzero(parts != names[counts.argmax()])
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    columns = np.ascontiguousarray(tokens.T)
    for begin in range(0, len(rest), 32):
        own = rest[begin:begin + 32]
        agreed = np.zeros((len(own), len(tokens)), np.uint8)
        for column in columns:
            agreed += column[own, None] == column[None, :]
        fit = agreed >= least
        fit &= (parts[own, None] != parts[None, :]) & ((sides[own, None] != sides[None, :]) | (sides[own, None] < 0))
        i, k = np.nonzero(fit)
        left.append(own[i])
        right.append(k)
    return np.concatenate(left), np.concatenate(right)


def compared_clusters(clusters: DataFrame, docs: DataFrame, shingle: int, percent: int, least: int) -> DataFrame:
    """Links (`a`, `b`) that join components within clusters (`cluster`, `id`, `component`), on the full sets.

    Every two documents of different components are compared unless links found before connect them already.
    """

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        hashes = WordHashes()
        ids = group["id"].to_numpy()
        sets = [shingle_hashes(text, shingle, hashes) for text in group["bytes"]]
        _, labels = np.unique(group["component"].to_numpy(), return_inverse=True)
        links = []
        for i, j in zip(*candidates(np.stack([sketch_of(s) for s in sets]), labels, np.full(len(ids), -1), least)):
            if labels[i] != labels[j]:
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if shared and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                    links.append((ids[i], ids[j]))
                    labels[labels == labels[j]] = labels[i]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return clusters.join(docs, "id").groupBy("cluster").applyInPandas(compare, "a long, b long")


def near_duplicate_components(
    docs: DataFrame, sketches: DataFrame, shingle: int, percent: int, trees: int, same: DataFrame
) -> DataFrame:
    """`id`, `component` for every representative that has a link; `docs` and `sketches` hold representatives.

    `same` has links (`a`, `b`) that are known without a comparison.
    """
    least = least_agreement(percent)
    rows = sketches.select("id", "sketch", F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("tree"))
    rows = rows.select(F.xxhash64(F.lit("tree"), "tree").alias("node"), "id", "sketch")
    for _ in range(FIRST_LEVELS):
        rows = branches(rows, percent)
    rows = rows.select("node", "id")
    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("pivot")).where("size > 1")
    rows = pin(rows.join(sizes, "node").select("node", "id", "pivot"))
    # Only texts that share a node can be needed from here on.
    docs = stored(docs.join(rows.select("id").distinct(), "id", "left_semi"), "candidates")

    # Every document with one pivot: the smallest that looks similar enough, or else the one that looks most similar.
    stars = rows.where("id <> pivot").select("id", "pivot").distinct()
    stars = stars.join(sketches.select("id", "sketch"), "id")
    stars = stars.join(sketches.select(F.col("id").alias("pivot"), F.col("sketch").alias("other")), "pivot")
    stars = stars.select("id", "pivot", F.size(F.array_intersect("sketch", "other")).alias("agreed")).where(F.col("agreed") >= least)
    good = F.col("agreed") >= math.ceil(SKETCH * percent / 100)
    rank = F.struct(F.when(good, 0).otherwise(1), F.when(good, F.col("pivot")).otherwise(-F.col("agreed")), "pivot")
    pairs = pin(stars.groupBy("id").agg(F.min_by("pivot", rank).alias("a")).select("a", F.col("id").alias("b")))
    links = pin(confirmed(pairs, docs, shingle, percent))
    found = components(links)

    rows = rows.select("node", "id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    small = None
    for depth in range(FIRST_LEVELS, DEPTH + 1):
        # Pairs across components, from the sizes of a node's components; a node without any is done.
        own = rows.groupBy("node", "component").agg(F.count(F.lit(1)).cast("double").alias("n"))
        sizes = own.groupBy("node").agg(F.sum("n").alias("size"), F.sum(F.col("n") * F.col("n")).alias("squares"))
        sizes = sizes.select("node", "size", ((F.col("size") * F.col("size") - F.col("squares")) / 2).alias("across")).where("across > 0")
        rows = pin(rows.join(sizes, "node"))
        fits = F.col("size") <= SMALL
        here = rows.where(fits).select("node", "id", "component")
        small = here if small is None else small.union(here)
        rows = rows.where(~fits)
        if depth == DEPTH or rows.isEmpty():
            break
        rows = branches(rows.drop("size", "across").join(sketches.select("id", "sketch"), "id"), percent, 1).drop("sketch")

    # What is still large: blocks of about half as many documents, every block with itself and with every other.
    blocks = F.ceil(F.col("size") / F.lit(SMALL / 2)).cast("int")
    large = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id", "node"), "blocks").cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"), F.lit("block")).alias("node"), "id", "component",
        F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("side"),
    )
    groups = pin(small.withColumn("side", F.lit(-1)).union(large))
    # Nodes of several trees that hold the same documents are compared once.
    once = groups.groupBy("node").agg(F.bit_xor(F.xxhash64("id", "side")).alias("mark"), F.count(F.lit(1)).alias("size"))
    once = once.groupBy("mark", "size").agg(F.min("node").alias("node")).select("node")
    groups = groups.join(once, "node", "left_semi").withColumnRenamed("node", "group").join(sketches.select("id", "sketch"), "id")
    clusters = candidate_clusters(groups, least).join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    more = compared_clusters(clusters, docs, shingle, percent, least)
    return components(links.union(more).union(same))


def near_duplicates(
    docs: DataFrame,
    percent: int = PERCENT,
    shingle: int = SHINGLE,
    trees: int = TREES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: `doc_id`, `n_shingles`, `component_id` (smallest id reachable over links), `kept`.

    Two documents are linked if their sets of `shingle`-word shingles (A-Z lower-cased, words parted by ASCII white space)
    have 100 * intersection >= `percent` * union. A text of fewer words is one shingle. Null texts and texts without words
    have no shingle and are linked with nothing. Ids are whole numbers. Rows that repeat an id are one document with
    several sets: a link of any counts for all of them, and every row comes back, kept or not like its id. Rows with a null id
    are no documents: they come back with a null component, not kept. Other columns are not read. An empty table gives none.
    """
    ship_package(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), utf8(F.col(text_col)).alias("bytes"))
    every = stored(shingle_sketches(narrow, shingle), "sketches")
    members = every.select("id", "n_shingles", "set_key")
    # Equal sets have equal sketches, so any of a class will do.
    known = every.where("set_key IS NOT NULL AND id IS NOT NULL")
    classes = stored(known.groupBy("set_key").agg(F.min("id").alias("rep"), F.first("sketch").alias("sketch")), "classes")
    classed = members.join(classes.select("set_key", "rep"), "set_key", "left")
    # The sets of one id belong together: the classes they fall into are linked.
    sets = classed.where("id IS NOT NULL AND rep IS NOT NULL").select("id", "rep")
    several = sets.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a < last")
    same = pin(sets.join(several, "id").where("rep > a").select("a", F.col("rep").alias("b")).distinct())
    found = near_duplicate_components(narrow, classes.select(F.col("rep").alias("id"), "sketch"), shingle, percent, trees, same)
    # A row without words goes with the other rows of its id.
    wordless = classed.where("rep IS NULL AND id IS NOT NULL").select("id").distinct()
    own = sets.join(wordless, "id", "left_semi").groupBy("id").agg(F.min("rep").alias("own"))
    classed = classed.join(own, "id", "left").withColumn("rep", F.coalesce("rep", "own"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    return (
        classed.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
        .select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs`, with their columns: one of each group of linked texts, whatever the ids.

    Rows count as documents of their own, so no text is lost because its id is there with another text, and rows without an id
    are compared like all others. The row with the smallest id stays, null ids last; of several the one whose text has the
    smallest hash. Texts without words are linked with nothing and all stay. An empty table gives no rows.
    """
    key, text_hash = fresh(docs.columns, "_key"), fresh(docs.columns, "_text_hash")
    # Written, so that a row keeps its number.
    keyed = stored(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    found = near_duplicates(keyed, id_col=key, text_col=text_col, **options).select(F.col("doc_id").alias(key), "component_id")
    rank = F.struct(F.col(id_col).isNull(), F.col(id_col).cast("long"), text_hash, key)
    order = keyed.select(key, id_col, F.xxhash64(F.col(text_col)).alias(text_hash)).join(found, key)
    staying = order.groupBy("component_id").agg(F.min_by(key, rank).alias(key)).select(key)
    return keyed.join(staying, key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
