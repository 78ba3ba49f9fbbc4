"""Main text of web pages: boosted trees over page nodes, decoded from the root down.

A page is parsed into block elements and runs of text. Boosted trees say from a node's subtree density, links, place,
depth, siblings and attribute tokens how likely it holds main text. Decoding picks the most likely set of nodes in which
no node holds main text unless the elements around it do, so ancestors and descendants never contradict each other; the
runs of text picked are the blocks of the result.

No page comes labelled. The model learns from a bounded sample of the pages themselves: where a page marks its article, its text and
the text around it are known, and they are laid out anew in varied page structures (`page_layouts`), so that the trees see main
text and menus, notices, adverts, forms, sidebars and comments in other surroundings than those of the sample.
Pages that mark none lend their long runs of prose to such layouts, whose labels are known as they are made. Both kinds are always sampled.

Fitting is one task on the bounded sample and yields one row. Extraction reads every page once, whole, and shuffles nothing.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from treeweave.llm.boosting import BoostedTrees
from treeweave.llm.page_layouts import layouts
from treeweave.llm.page_tree import FEATURES, TEXT, PageTree, node_features
from treeweave.llm.support import bounded_sample, decoded, fresh, one_text, utf8
from treeweave.session import ship_package

# Pages of each kind, with and without a marked article, that the model learns from, at most, and layouts made of each.
SAMPLE = 240
LAYOUTS = 5
# Least size of a run of text that may stand for main text where a page marks none.
PROSE_CHARS, PROSE_WORDS = 80, 12
# Markup that may hold such a run: scripts and styles rarely go so long without these characters.
PROSE_RUN = rf"[^<>{{}};=]{{{PROSE_CHARS},}}"
TREES = 60
DEPTH = 5
LEAST_CHANCE = 1e-4


def token_odds(trees: list[PageTree]) -> dict[str, float]:
    """How much each tag and attribute token speaks for main text: smoothed log ratio over pages' blocks."""
    good, bad = Counter(), Counter()
    for tree in trees:
        labels = tree_labels(tree)
        for node, label in enumerate(labels):
            if tree.tag[node] != TEXT:
                (good if label else bad).update({f"<{tree.tag[node]}>", *tree.tokens[node]})
    total_good, total_bad = sum(good.values()) + 1, sum(bad.values()) + 1
    return {
        token: float(np.log((good[token] + 0.5) / total_good) - np.log((bad[token] + 0.5) / total_bad))
        for token in sorted(good.keys() | bad.keys()) if good[token] + bad[token] >= 3
    }


def tree_labels(tree: PageTree) -> np.ndarray:
    """Whether a node is main text (runs) or holds some (elements)."""
    labels = np.array([bool(t) and tag == TEXT for t, tag in zip(tree.truth, tree.tag)])
    for node in range(len(labels) - 1, 0, -1):
        labels[tree.parent[node]] |= labels[node]
    return labels


def decode(parent: list[int], is_text: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """The most likely set of nodes that is closed towards the root, and in which every element holds a picked run of text.

    The cost of a node's subtree is found from the leaves up, once for leaving it out whole and once for taking the node;
    choices are then read from the root down.
    """
    size = len(parent)
    chance = np.clip(chance, LEAST_CHANCE, 1 - LEAST_CHANCE)
    out, taken = -np.log(1 - chance), -np.log(chance)
    # Below a taken element: the sum of its children's cheaper choices, and what opening at least one costs over that.
    extra = np.where(is_text, 0.0, np.inf)
    for node in range(size - 1, 0, -1):
        over = parent[node]
        open_cost = taken[node] + extra[node]
        extra[over] = min(extra[over], max(open_cost - out[node], 0.0))
        taken[over] += min(open_cost, out[node])
        out[over] += out[node]
    picked = np.zeros(size, bool)
    picked[0] = taken[0] + extra[0] < out[0]
    children: dict[int, list[int]] = {}
    for node in range(1, size):
        children.setdefault(parent[node], []).append(node)
    for node in range(size):
        if picked[node] and node in children:
            costs = {c: taken[c] + extra[c] - out[c] for c in children[node]}
            for child, cost in costs.items():
                picked[child] = cost < 0
            if not any(picked[c] for c in costs):
                picked[min(costs, key=costs.get)] = True
    return picked


class TextModel:
    """Token odds and boosted trees; packs into one row."""

    def __init__(self, odds: dict[str, float], trees: BoostedTrees):
        self.odds, self.trees = odds, trees

    def texts(self, pages: list[str]) -> list[list[str]]:
        """Main text blocks of pages."""
        parsed = [PageTree(p) for p in pages]
        chances = self.trees.probabilities(np.concatenate([node_features(t, self.odds) for t in parsed])) if pages else np.empty(0)
        blocks, at = [], 0
        for tree in parsed:
            is_text = np.array([t == TEXT for t in tree.tag])
            picked = decode(tree.parent, is_text, chances[at:at + len(is_text)])
            at += len(is_text)
            blocks.append([tree.text[node] for node in np.flatnonzero(picked & is_text)])
        return blocks


def marked(html: str) -> PageTree | None:
    """The tree of a page that marks its article with the element made for it; None if it does not."""
    tree = PageTree(html)
    tree.truth = [None] * len(tree.parent)
    for node in range(1, len(tree.parent)):
        tree.truth[node] = tree.tag[node] in ("article", "main") or bool(tree.truth[tree.parent[node]])
        if tree.tag[node] in ("nav", "aside", "footer", "form"):
            tree.truth[node] = False
    good = sum(len(t) for t, truth in zip(tree.text, tree.truth) if truth)
    return tree if good else None


def guessed(html: str) -> PageTree | None:
    """The tree of a page whose long runs of prose, and blocks beside them, may stand for main text; None without any."""
    tree = PageTree(html)
    apart = [False] * len(tree.parent)
    for node in range(1, len(apart)):
        apart[node] = tree.tag[node] in ("nav", "aside", "footer", "header", "form") or apart[tree.parent[node]]
    prose = [
        # Scripts without spaces show as prose by their marks.
        not out and len(t) >= PROSE_CHARS and linked <= 0.3 * len(t) and (len(t.split()) >= PROSE_WORDS or sum(map(t.count, "。，、！？")) >= 3)
        for out, t, linked in zip(apart, tree.text, tree.link_chars)
    ]
    around = {tree.parent[tree.parent[n]] for n, long in enumerate(prose) if long} - {-1}
    tree.truth = [
        long or bool(t) and not out and tree.tag[over] in ("p", "h1", "h2", "h3", "blockquote") and tree.parent[over] in around
        for long, t, out, over in zip(prose, tree.text, apart, tree.parent)
    ]
    return tree if any(prose) else None


def learn(pages: list[str]) -> TextModel | None:
    """A model from pages that mark their article, and from layouts of their text and of the prose of other pages."""
    known, lent = [], []
    for page in pages:
        tree = marked(page)
        if tree is not None:
            known.append(tree)
        elif (tree := guessed(page)) is not None:
            lent.append(tree)
    if not known and not lent:
        return None
    stock = [
        ([(tree.tag[tree.parent[n]], tree.text[n]) for n in range(len(tree.parent)) if tree.text[n] and tree.truth[n]],
         [tree.text[n] for n in range(len(tree.parent)) if tree.text[n] and not tree.truth[n]])
        for tree in known + lent
    ]
    # What is main text in the other pages themselves is not known.
    trees = list(known)
    draw = random.Random(10)
    for number in range(len(stock)):
        trees += [PageTree(html) for html in layouts(draw, stock, number, LAYOUTS)]
    odds = token_odds(trees)
    rows, labels, weights = [], [], []
    for tree in trees:
        rows.append(node_features(tree, odds))
        labels.append(tree_labels(tree))
        weights.append(np.full(len(tree.parent), 1.0))
    return TextModel(odds, BoostedTrees.fit(np.concatenate(rows), np.concatenate(labels).astype(float), np.concatenate(weights), TREES, DEPTH))


def fit_text_model(pages: DataFrame, size: int = SAMPLE, id_col: str = "page_id", html_col: str = "html") -> TextModel | None:
    """The model of at most `size` pages that have an element for their article and as many others that may hold prose.

    Of both kinds those with the smallest id hashes are taken, whatever the number of the other kind. A page without id or markup
    teaches nothing, an id counts once. None if no page holds an article or prose.
    """
    ship_package(pages.sparkSession)
    present = pages.where(F.col(id_col).isNotNull() & F.col(html_col).isNotNull())
    tagged = F.col(html_col).rlike(r"(?i)<(article|main)[\s/>]")
    chosen = [
        bounded_sample(present.where(kind).select(F.col(id_col).alias("id")).distinct(), size, "id")
        for kind in (tagged, ~tagged & F.col(html_col).rlike(PROSE_RUN))
    ]
    narrow = present.select(F.col(id_col).alias("id"), utf8(F.col(html_col)).alias("bytes"))
    sample = one_text(narrow.join(F.broadcast(chosen[0].union(chosen[1]).distinct()), "id"), "id")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        model = learn([decoded(b) for b in group.sort_values("id")["bytes"]])
        if model is None:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("names", "odds", "cuts", "features", "bins", "leaves", "base")})
        t = model.trees
        return pd.DataFrame({
            "names": [list(model.odds)], "odds": [list(model.odds.values())], "cuts": [t.cuts.ravel()],
            "features": [t.features.ravel()], "bins": [t.bins.ravel()], "leaves": [t.leaves.ravel()], "base": [t.base],
        })

    kinds = "names array<string>, odds array<double>, cuts array<double>, features array<long>, bins array<long>, leaves array<double>, base double"
    row = sample.groupBy(F.lit(0).alias("all")).applyInPandas(fit, kinds).first()
    if row is None:
        return None
    trees = BoostedTrees(
        np.array(row["cuts"]).reshape(FEATURES, -1), np.array(row["features"]).reshape(TREES, -1), np.array(row["bins"]).reshape(TREES, -1),
        np.array(row["leaves"]).reshape(TREES, -1), row["base"],
    )
    return TextModel(dict(zip(row["names"], row["odds"])), trees)


def with_main_text(pages: DataFrame, model: TextModel | None, html_col: str = "html", result: str = "main_text") -> DataFrame:
    """`pages` with a string column `result`: blocks in page order, white space inside a block one space, two line feeds between.

    Character references are decoded. A null or empty page, a page without main text, and every page if there is no model, give an
    empty text. Pages are judged one by one, so equal pages agree. A column named `result` is replaced.
    """
    if model is None:
        return pages.withColumn(result, F.lit(""))
    spark = pages.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for htmls in batches:
            found: list[str] = []
            for begin in range(0, len(htmls), 200):
                blocks = shared.value.texts([decoded(h) for h in htmls.iloc[begin:begin + 200]])
                found += ["\n\n".join(b) for b in blocks]
            yield pd.Series(found, dtype=object)

    return pages.withColumn(result, extract(utf8(F.col(html_col))))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """`page_id`, `url`, `text`, `n_chars` (code points) of every row."""
    model = fit_text_model(pages, id_col=id_col, html_col=html_col)
    result = fresh(pages.columns, "_main_text")
    return with_main_text(pages, model, html_col, result).select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(result).alias("text"),
        F.char_length(F.col(result)).cast("long").alias("n_chars"),
    )
