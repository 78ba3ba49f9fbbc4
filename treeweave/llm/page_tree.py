"""Pages as trees of block elements and runs of text, with the features that the extraction model looks at."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np

# Fixed values of the HTML standard: elements inside a line of text, and elements whose content is no text of the page.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike"
    " strong sub sup time tt u var wbr".split()
)
SILENT = frozenset(
    "head script style noscript template svg math iframe object select option button textarea audio video canvas map".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# An element of the first name that is open ends where one of the second begins, up to an element named third.
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
}
TRUTH = "data-truth"
_TOKENS = re.compile(r"[a-z]+|[A-Z][a-z]*")
TEXT = "#text"


class PageTree(HTMLParser):
    """Nodes in page order: block elements and runs of text. `parent`, `tag`, `tokens`, `text` and counts are parallel lists."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.tokens, self.text = [-1], ["#page"], [()], [""]
        self.link_chars, self.links, self.inputs, self.breaks = [0], [0], [0], [0]
        self.truth: list[bool | None] = [None]
        # Open elements: (tag, node of the block they are in or are).
        self.open: list[tuple[str, int]] = [("#page", 0)]
        self.silent = 0
        self.in_link = 0
        self.pieces: list[str] = []
        self.piece_links = [0, 0, 0]
        self.feed(html)
        self.close()
        self._end_run()

    def _node(self, tag: str, tokens: tuple[str, ...], text: str, truth: bool | None) -> int:
        self.parent.append(self.open[-1][1])
        self.tag.append(tag)
        self.tokens.append(tokens)
        self.text.append(text)
        self.link_chars.append(0)
        self.links.append(0)
        self.inputs.append(0)
        self.breaks.append(0)
        self.truth.append(self.truth[self.open[-1][1]] if truth is None else truth)
        return len(self.parent) - 1

    def _end_run(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            node = self._node(TEXT, (), text, None)
            self.link_chars[node], self.links[node], self.breaks[node] = self.piece_links
        self.pieces, self.piece_links = [], [0, 0, 0]

    def _pop(self, depth: int) -> None:
        """Close all open elements beyond the first `depth`."""
        while len(self.open) > depth:
            tag, _ = self.open.pop()
            if tag in SILENT:
                self.silent -= 1
            elif tag == "a":
                self.in_link -= 1
            if tag not in INLINE and not self.silent:
                self._end_run()

    def _pop_within(self, tags: set[str], border: set[str]) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.open[depth][0]
            if tag in border:
                return
            if tag in tags:
                self._pop(depth)
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.pieces.append(" ")
            self.piece_links[2] += 1
            return
        if tag == "body" and self.silent:
            # A head that was left open ends here.
            self._pop(next((d for d, (t, _) in enumerate(self.open) if t in SILENT), len(self.open)))
        if tag in ("html", "body") and any(t == tag for t, _ in self.open):
            return
        inline = tag in INLINE
        if not inline and tag not in SILENT and tag not in EMPTY:
            self._pop_within({"p"}, {"table", "td", "th", "button"})
        if tag in CLOSED_BY:
            self._pop_within(*CLOSED_BY[tag])
        if tag in EMPTY:
            if tag in ("input", "embed"):
                self.inputs[self.open[-1][1]] += 1
            elif tag == "hr":
                self._end_run()
            return
        if tag == "a":
            self._pop_within({"a"}, {"td", "th", "table"})
            self.in_link += 1
            self.piece_links[1] += 1
        block = self.open[-1][1]
        if tag in SILENT:
            self.silent += 1
            if tag in ("select", "textarea", "button"):
                self.inputs[block] += 1
        elif not inline and not self.silent:
            self._end_run()
            found = dict(attrs)
            named = " ".join(found.get(a) or "" for a in ("class", "id", "role", "itemprop", "aria-label"))
            truth = found.get(TRUTH)
            block = self._node(tag, tuple(t.lower() for t in _TOKENS.findall(named)), "", None if truth is None else truth == "1")
        self.open.append((tag, block))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in EMPTY and tag in ("svg", "iframe", "object", "script", "canvas"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "p" and not any(t == "p" for t, _ in self.open):
            self._end_run()
            return
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth][0] == tag:
                self._pop(depth)
                return
            # An inline end tag does not reach out of its block.
            if tag in INLINE and self.open[depth][0] not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.pieces.append(data)
            if self.in_link:
                self.piece_links[0] += len(data)


CONTEXT_TAGS = ("p", "li", "ul", "div", "section", "article", "main", "nav", "aside", "header", "footer", "form", "td", "h1", "h2", TEXT)
FEATURES = 34 + len(CONTEXT_TAGS)


def node_features(tree: PageTree, odds: dict[str, float]) -> np.ndarray:
    """One row per node: subtree size and density, links, place, depth, siblings, and what tag and attribute tokens suggest.

    `odds` gives for tags and tokens how much they speak for main text.
    """
    size = len(tree.parent)
    parent = np.array(tree.parent)
    parent[0] = 0
    own_chars = np.array([len(t) for t in tree.text], float)
    stops = np.array([sum(map(t.count, ".!?,;")) for t in tree.text], float)
    is_text = own_chars > 0
    sums = np.column_stack([
        own_chars, np.array(tree.link_chars, float), np.array(tree.links, float), np.array(tree.inputs, float), stops,
        np.ones(size), is_text, [t == "p" for t in tree.tag], [t == "li" for t in tree.tag], is_text & (own_chars >= 80),
        [t in ("h1", "h2", "h3") for t in tree.tag],
    ]).astype(float)
    before = np.concatenate([[0.0], np.cumsum(own_chars)[:-1]])
    depth = np.zeros(size)
    for node in range(1, size):
        depth[node] = depth[parent[node]] + 1
    for node in range(size - 1, 0, -1):
        sums[parent[node]] += sums[node]
    chars, link_chars, links, inputs, marks, nodes, texts, paragraphs, items, long_texts, heads = sums.T
    whole = max(chars[0], 1.0)

    hint = np.array([odds.get(f"<{t}>", 0.0) + sum(odds.get(k, 0.0) for k in ks) for t, ks in zip(tree.tag, tree.tokens)])
    low = np.array([min([0.0, *(odds.get(k, 0.0) for k in ks)]) for ks in tree.tokens])
    worst, best, path = hint.copy(), hint.copy(), hint.copy()
    for node in range(1, size):
        worst[node] = min(worst[node], worst[parent[node]])
        best[node] = max(best[node], best[parent[node]])
        path[node] += path[parent[node]]

    siblings = np.bincount(parent[1:], minlength=size)
    place, previous, following, last = np.zeros(size), np.zeros(size), np.zeros(size), {}
    previous_links, following_links = np.zeros(size), np.zeros(size)
    seen = np.zeros(size)
    density = link_chars / np.maximum(chars, 1)
    for node in range(1, size):
        over = parent[node]
        place[node] = seen[over]
        seen[over] += 1
        if over in last:
            other = last[over]
            previous[node], following[other] = chars[other], chars[node]
            previous_links[node], following_links[other] = density[other], density[node]
        last[over] = node
    alike = Counter(zip(tree.parent, tree.tag))
    same = np.array([alike[p, t] for p, t in zip(tree.parent, tree.tag)], float)
    most = np.zeros(size)
    np.maximum.at(most, parent[1:], chars[1:])
    tags = np.array([[t == c for c in CONTEXT_TAGS] for t in tree.tag], float)
    logs = np.log1p(np.column_stack([chars, chars / nodes, links, previous, following, chars[parent]]))
    return np.column_stack([
        logs, density, density[parent], previous_links, following_links, inputs / nodes, inputs[parent] > 0, marks / np.maximum(chars, 1),
        paragraphs / nodes, items / nodes, long_texts, long_texts[parent], heads, texts,
        chars / whole, chars / np.maximum(chars[parent], 1), chars / np.maximum(most[parent], 1),
        before / whole, (before + chars) / whole, depth, siblings[parent], place / np.maximum(siblings[parent], 1), same / np.maximum(siblings[parent], 1),
        hint, low, worst, best, path, hint[parent], tags,
    ])
