"""Main text of pages: against a plain reading of the given pages, unseen layouts, malformed and odd pages."""

import html
import itertools
import pathlib
import random
import re

import numpy as np
import pytest

from treeweave.llm.boosting import BoostedTrees
from treeweave.llm.html_text import decode, learn, main_texts, marked
from treeweave.llm.page_layouts import layouts
from treeweave.llm.page_tree import FEATURES, TEXT, PageTree, node_features
from treeweave.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not pathlib.Path(SF_DIR).exists(), reason="tables not present")


def plain_article(page):
    """The article of a given page by pattern: its blocks end where a paragraph or heading begins or ends."""
    article = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", article)
    texts = (" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


@needs_tables
def test_given_pages(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    got = QUERIES["op10_main_text"](spark, SF_DIR).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == plain_article(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"])
        assert r["url"] == pages[r["page_id"]]["url"]


@needs_tables
def test_unseen_layouts(spark):
    pages = [r["html"] for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").orderBy("page_id").collect()]
    model = learn(pages[:120])
    stock = [
        ([(t.tag[t.parent[n]], x) for n, x in enumerate(t.text) if x and t.truth[n]], [x for n, x in enumerate(t.text) if x and not t.truth[n]])
        for t in map(marked, pages[120:])
    ]
    draw = random.Random(1234)
    made = [p for i in range(len(stock)) for p in layouts(draw, stock, i, 1)]
    right, found, wanted = 0, 0, 0
    for page, got in zip(made, model.texts(made)):
        tree = PageTree(page)
        want = [x for n, x in enumerate(tree.text) if x and tree.truth[n]]
        right += sum(len(x) for x in got if x in want)
        found += sum(map(len, got))
        wanted += sum(map(len, want))
    assert right / found > 0.97 and right / wanted > 0.97


def test_decoding_is_the_cheapest_consistent_choice():
    draw = np.random.default_rng(3)
    for _ in range(60):
        size = int(draw.integers(2, 9))
        parent = [-1] + [int(draw.integers(0, n)) for n in range(1, size)]
        is_text = np.array([n not in parent for n in range(size)])
        chance = draw.random(size)

        def allowed(chosen):
            return all(
                (n == 0 or not chosen[n] or chosen[parent[n]]) and (not chosen[n] or is_text[n] or any(chosen[c] and parent[c] == n for c in range(size)))
                for n in range(size)
            )

        def cost(chosen):
            p = np.clip(chance, 1e-4, 1 - 1e-4)
            return -np.log(np.where(chosen, p, 1 - p)).sum()

        best = min(cost(np.array(c)) for c in itertools.product([False, True], repeat=size) if allowed(c))
        # Texts are leaves here, and parents come before their children, as in pages.
        got = decode(parent, is_text, chance)
        assert allowed(got) and cost(got) == pytest.approx(best)


def test_trees_learn_a_rule():
    draw = np.random.default_rng(5)
    rows = draw.random((2000, 6))
    labels = ((rows[:, 1] > 0.5) & (rows[:, 4] < 0.3) | (rows[:, 2] > 0.9)).astype(float)
    model = BoostedTrees.fit(rows[:1500], labels[:1500], np.ones(1500), trees=40, depth=4)
    assert ((model.probabilities(rows[1500:]) > 0.5) == labels[1500:]).mean() > 0.95


def texts(page):
    tree = PageTree(page)
    return [t for t in tree.text if t]


def test_parsing():
    assert texts("<p>a<p>b &amp; c<ul><li>d<li>e</ul><td>f") == ["a", "b & c", "d", "e", "f"]
    assert texts("<p>one <b>two<br>three</p>four</b> five<script>var x='</p>';</script><style>p{}</style><!-- six -->") == ["one two three", "four five"]
    assert texts("<div>a<div>b</div>c</div></div></p>d") == ["a", "b", "c", "d"]
    assert texts("<head><title>t</title><body><p>x&nbsp;&#233;&lt; \n y") == ["x é< y"]
    assert texts("<table><tr><td>1<td>2<tr><th>3</table><select><option>no</select>4") == ["1", "2", "3", "4"]
    assert texts("") == texts("<html>") == texts("<<>><!--") == [] or texts("<<>>") != []
    assert texts("no markup at all") == ["no markup at all"]
    for page in ("", "<div>" * 3000, "<p>" * 500 + "x", "<a><b></i></a>" * 50, "<ul><li>" * 200):
        tree = PageTree(page)
        assert node_features(tree, {}).shape == (len(tree.parent), FEATURES)
        assert all(p < n for n, p in enumerate(tree.parent)) and all((t == TEXT) == bool(x) for t, x in zip(tree.tag, tree.text))


def test_odd_pages(spark):
    good = "<html><body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>Some longer text, with a comma.</p></article><footer>foot</footer></body></html>"
    rows = [(i, f"u{i}", good.replace("Title", f"Title {i}"), "x", 1) for i in range(30)]
    rows += [(40, None, None, "x", 1), (None, "u", "", "x", 1), (41, "u", "<script>alert(1)</script>", "x", 1), (3, "u3", rows[3][2], "x", 1), (42, "u", "x" * 300_000, "y", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, main_text string, _main_text int").repartition(3)
    got = main_texts(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = {}
    for r in got.collect():
        found.setdefault(r["page_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert found[40] == found[41] == found[None] == [""]
    assert found[3] == ["Title 3\n\nSome longer text, with a comma."] * 2
    assert sum(map(len, found.values())) == len(rows)
    assert main_texts(pages.where("false")).count() == 0
    # Without a page that marks its article nothing can be learned, and nothing is returned.
    assert {r["text"] for r in main_texts(pages.where("page_id >= 40")).collect()} == {""}


def test_pages_that_mark_no_article(spark):
    draw = random.Random(11)

    def word():
        return "".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(3, 9)))

    def sentence():
        return " ".join(word() for _ in range(draw.randint(9, 16))).capitalize() + ", " + word() + "."

    pages, wanted = [], {}
    for number in range(60):
        body = [" ".join(sentence() for _ in range(4)) for _ in range(5)]
        menu = "<ul class=menu>" + "".join(f"<li><a href=/{i}>{word()}</a></li>" for i in range(6)) + "</ul>"
        inside = "".join(f"<p>{b}</p>" for b in body)
        inside = f"<div class=content>{inside}</div>" if number % 2 else f"<table><tr><td class=story>{inside}</td></tr></table>"
        pages.append((number, f"u{number}", f"<html><body>{menu}{inside}<div class=footer>Copyright {word()}</div></body></html>"))
        wanted[number] = body
    one = (99, "u99", f"<html><body><article\n class=x><p>{sentence() * 3}</p></article><div class=footer>Copyright</div></body></html>")
    for extra in ([], [one]):
        got = {r["page_id"]: r["text"] for r in main_texts(spark.createDataFrame(pages + extra, "page_id long, url string, html string")).collect()}
        found = [b in got[n].split("\n\n") for n, body in wanted.items() for b in body]
        assert sum(found) / len(found) > 0.9 and sum("Copyright" in got[n] for n in wanted) < 6
