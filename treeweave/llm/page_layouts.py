"""Page structures for training: known main text and known other text in varied surroundings.

Blocks carry the attribute `data-truth` (1 main text, 0 not), which the parser keeps apart from the features.
"""

from __future__ import annotations

from html import escape
from random import Random

Stock = list[tuple[list[tuple[str, str]], list[str]]]

# Names that pages give to the parts of a page.
NAMES = {
    "main": ["content", "post", "entry-content", "article-body", "story", "main-content", "post-body", "text", "body-copy", "articleText", "page-content"],
    "head": ["header", "site-header", "masthead", "topbar", "banner", "branding"],
    "menu": ["menu", "nav", "navbar", "navigation", "main-menu", "breadcrumbs", "links", "tabs", "toc"],
    "side": ["sidebar", "aside", "widget", "related", "rail", "secondary", "more-stories", "popular", "trending", "recommended"],
    "foot": ["footer", "site-footer", "copyright", "legal", "bottom", "colophon"],
    "notice": ["cookie-notice", "notice", "alert", "consent", "gdpr-banner", "cookies", "message", "disclaimer"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "adsbygoogle", "ad-slot", "banner-ad"],
    "comments": ["comments", "comment-list", "comment", "replies", "discussion", "responses", "reader-comments", "reply"],
    "form": ["newsletter", "subscribe", "search-form", "signup", "login", "contact-form", "share", "social"],
}
PLAIN = ["box", "row", "col", "inner", "wrap", "block", "c1", "module", "container", "panel"]
OWN_TAGS = {
    "main": ["article", "main", "div", "section", "td"], "head": ["header", "div"], "menu": ["nav", "div", "ul"], "side": ["aside", "div", "section"],
    "foot": ["footer", "div"], "notice": ["div", "section", "p"], "advert": ["div", "aside", "section"], "comments": ["section", "div", "ol"],
    "form": ["form", "div"],
}


class Layout:
    """One page made of drawn parts."""

    def __init__(self, draw: Random, paragraphs: list[tuple[str, str]], other: list[str], prose: list[str]):
        self.draw, self.paragraphs, self.other, self.prose = draw, paragraphs, other or ["Home"], prose or ["Text"]
        # Some pages name their parts, some use elements made for them, some do neither for a part.
        self.named, self.tagged = draw.choice([0.95, 0.8, 0.5]), draw.choice([0.9, 0.5, 0.1])

    def wrapped(self, part: str, truth: int, inside: str) -> str:
        draw = self.draw
        own = draw.random() < self.tagged
        tag = draw.choice(OWN_TAGS[part][:2] if own else [t for t in OWN_TAGS[part] if t in ("div", "section", "ul", "ol", "td")] or ["div"])
        # An element made for its part may do without a telling name; any other mostly has one.
        clear = own and tag not in ("div", "section", "ul", "ol", "td", "p")
        telling = draw.random() < (self.named if clear else max(self.named, 0.9))
        name = draw.choice(NAMES[part] if telling else PLAIN)
        where = draw.choice(["class", "class", "id"])
        if tag in ("ul", "ol") and "<li" not in inside:
            tag = "div"
        if tag == "p" and "<" in inside:
            tag = "div"
        text = f'<{tag} {where}="{name}" data-truth="{truth}">{inside}</{tag}>'
        if tag == "td":
            text = f"<table><tr>{text}</tr></table>"
        for _ in range(draw.choice([0, 0, 1, 2])):
            text = f'<div class="{draw.choice(PLAIN)}">{text}</div>'
        return text

    def words(self, least: int, most: int) -> str:
        text = self.draw.choice(self.other if self.draw.random() < 0.5 else self.prose).split() or ["Text"]
        start = self.draw.randrange(len(text))
        return escape(" ".join((text[start:] + text)[: self.draw.randint(least, most)]))

    def link(self, least: int = 1, most: int = 3) -> str:
        return f'<a href="/{self.draw.randrange(1000)}">{self.words(least, most)}</a>'

    def links(self) -> str:
        items = [self.link(1, self.draw.choice([2, 8])) for _ in range(self.draw.randint(2, 9))]
        shape = self.draw.random()
        return f"<ul>{''.join(f'<li>{i}</li>' for i in items)}</ul>" if shape < 0.7 else " | ".join(items) if shape < 0.85 else "".join(f"<div>{i}</div>" for i in items)

    def passage(self) -> str:
        """Prose that is no main text."""
        return f"<p>{self.words(4, 60)}</p>" if self.draw.random() < 0.7 else self.words(4, 40)

    def side(self) -> str:
        kind = self.draw.random()
        if kind < 0.5:
            return f"<h3>{self.words(1, 4)}</h3>{self.links()}"
        return f"<h3>{self.words(1, 4)}</h3>{self.passage()}" + (self.link(2, 6) if kind < 0.8 else "")

    def comments(self) -> str:
        def one() -> str:
            author = f'<span class="author">{self.words(1, 2)}</span>' if self.draw.random() < 0.5 else f"<b>{self.words(1, 2)}</b>"
            return f'<div class="{self.draw.choice(["comment", "reply", "c", "item"])}">{author} <p>{self.words(3, 90)}</p></div>'
        return (f"<h3>{self.words(1, 3)}</h3>" if self.draw.random() < 0.7 else "") + "".join(one() for _ in range(self.draw.randint(1, 5)))

    def form(self) -> str:
        return f'{self.passage()}<input type="text" name="q">{self.draw.choice(["<button>", "<button type=submit>"])}{self.words(1, 2)}</button>'

    def other_part(self, part: str) -> str:
        inside = {
            "head": lambda: f"<a href='/'>{self.words(1, 3)}</a>" + (self.links() if self.draw.random() < 0.5 else self.passage()),
            "menu": self.links, "side": self.side, "foot": lambda: self.passage() + (self.links() if self.draw.random() < 0.5 else ""),
            "notice": lambda: self.passage() + (f"<button>{self.words(1, 1)}</button>" if self.draw.random() < 0.6 else ""),
            "advert": lambda: self.words(3, 40) if self.draw.random() < 0.6 else self.passage() + self.link(1, 4),
            "comments": self.comments, "form": self.form,
        }[part]()
        return self.wrapped(part, 0, inside)

    def main_blocks(self) -> list[str]:
        blocks, draw = [], self.draw
        loose = draw.random() < 0.1
        for tag, text in self.paragraphs:
            text = escape(text, quote=False)
            words = text.split()
            if len(words) > 6 and draw.random() < 0.2:
                words[3:5] = [f'<a href="/x">{words[3]}</a>', f"<em>{words[4]}</em>"]
            text = " ".join(words)
            if tag in ("h1", "h2", "h3"):
                blocks.append(f"<{tag}>{text}</{tag}>")
            elif loose:
                blocks.append(f"<div>{text}</div>")
            else:
                kind = draw.random()
                blocks.append(
                    f"<p>{text}</p>" if kind < 0.8 else f"<blockquote><p>{text}</p></blockquote>" if kind < 0.85
                    else f"<ul>{''.join(f'<li>{t}</li>' for t in text.split('. ') if t.strip())}</ul>" if kind < 0.93
                    else f"<h2>{text}</h2>" if len(words) < 12 else f"<p>{text}"
                )
        return blocks

    def page(self) -> str:
        draw = self.draw
        blocks = self.main_blocks()
        for part in ("advert", "side", "form", "notice", "menu"):
            if draw.random() < 0.2:
                blocks.insert(draw.randint(0, len(blocks)), self.other_part(part))
        if draw.random() < 0.25:
            blocks.append(self.other_part("comments"))
        parts = [p for p in ("notice", "head", "menu", "advert") if draw.random() < 0.6]
        after = [p for p in ("side", "comments", "advert", "form", "notice", "foot", "side") if draw.random() < 0.5]
        if draw.random() < 0.2:
            parts.append("side")
        body = "".join(map(self.other_part, parts)) + self.wrapped("main", 1, "".join(blocks)) + "".join(map(self.other_part, after))
        if draw.random() < 0.4:
            body = f'<div id="{draw.choice(["page", "wrapper", "container", "root", "app"])}">{body}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 6)}</title></head><body>{body}</body></html>"


def layouts(draw: Random, stock: Stock, number: int, count: int) -> list[str]:
    """`count` pages around the main text of the page `number`, whole or a drawn run of it, with other text and prose of the stock around it."""
    paragraphs, other = stock[number]
    pages = []
    for _ in range(count):
        lent = stock[draw.randrange(len(stock))]
        size = min(draw.choice([3, 12, len(paragraphs)]), len(paragraphs))
        start = draw.randint(0, len(paragraphs) - size)
        pages.append(Layout(draw, paragraphs[start:start + size], other + lent[1], [t for _, t in lent[0]]).page())
    return pages
