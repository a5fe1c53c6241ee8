"""Main text of web pages by a maximum-scoring subsequence (operator 4).

A page is a row of words and tags. Words score positive and tags negative,
with weights from labelled pages: a word by its place (``PLACES``), a tag by
its name. A linear scan finds the contiguous region with the largest sum; the
words in it whose place scores negative (an advert or a comment list between
two paragraphs) are left out.

Places come from the elements that a word stands in. An element is a hint of
the page's frame by its name or by its marks (class, id, role, aria-label). A
hint counts for the words inside, but not where the element holds nearly all
of the page's words: then it is a wrapper, whatever its name. Where article or
main elements hold most words, other words are outside of them. Words of a row
of blocks that are links are a menu.

The labelled pages are written here by :func:`labelled_pages`: layouts with
the parts that pages have, each word marked as content or not. The weights are
the log odds of those marks.

Inside a block, white space becomes one space; character references are
decoded; blocks are joined by an empty line. Nothing else is dropped and no
page is cut. The time is linear in the page's length.

Defined results: a null or empty page, or one without content words, gives the
empty text; unclosed and misnested tags end with the element around them, and
an end tag ends no block around its own element; a tag that the page's end cuts
off is markup; repeated rows are extracted one by one; columns of the input
that are not kept play no part, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

# Elements that begin and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
# Elements whose text is not text of the page.
RAW = ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "title", "math")
# Elements of a page's frame.
FRAME = frozenset("aside button dialog footer form head header menu nav select option label input".split())
# Words in class, id, role or aria-label that mark the frame.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert menu menubar nav navbar navigation breadcrumb breadcrumbs sidebar footer header masthead topbar toolbar comment comments respond reply disqus share sharing social related recommended newsletter subscribe subscription signup login search popup modal overlay widget pagination pager copyright disclaimer complementary contentinfo".split()
)
# Those of them that mark an article as a comment.
ARTICLE_HINTS = frozenset("comment comments reply".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# An opening tag of the second kind ends an open element of the first.
CLOSES = {
    "p": BLOCKS,
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "option": frozenset(["option"]),
    "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
}

_RAW = "|".join(RAW)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    rf"|<(?!(?:svg|math)\b[^>]*/>)({_RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<[/!?][^>]*(?:>|\Z)"
    r"|[^<]+|<",
    re.S | re.I,
)
_MARK = re.compile(r"""(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:\s|^)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Parts of a name by which it tells of something that is elsewhere, or absent.
ABOUT = frozenset("has no with without free less hide hidden show enabled disabled closed is not".split())
#: Share of a page's words from which on an element that holds them is a wrapper.
WRAPPER = 0.8
#: Blocks of links in a row that are a menu, and words of each at most.
MENU_BLOCKS, MENU_WORDS = 3, 12
#: Words of a short block at most.
FEW = 4
#: Where words stand.
PLACES = ("text", "few", "link", "menu", "outside", "frame")


def is_hint(name: str, attributes: str) -> bool:
    """Whether an element's name or marks say that it is part of the page's frame."""
    if name in FRAME:
        return True
    if not attributes or name in ("html", "body", "main", "p", "h1", "b", "i", "em", "strong"):
        return False
    if name != "article" and _HIDDEN.search(attributes):
        return True
    hints = HINTS if name != "article" else ARTICLE_HINTS
    for value in _MARK.findall(attributes):
        for token in value.strip("\"'").split():
            parts = [p.lower() for p in _PART.findall(token)]
            if any(p in hints for p in parts) and not any(p in ABOUT for p in parts):
                return True
    return False


class Block:
    """A block of text: the tags before it, and its pieces as (text, number of its element, whether it is in a link)."""

    __slots__ = ("pieces", "tags")

    def __init__(self, tags: list[str]):
        self.tags, self.pieces = tags, []


class Page:
    """The blocks of a page, and its elements: number of the one around, whether a hint, an article, and own words."""

    def __init__(self, html: str):
        self.parent, self.hint, self.article, self.words = [0], [False], [False], [0]
        self.blocks: list[Block] = []
        self._parse(html)

    def _parse(self, html: str) -> None:
        stack: list[tuple[str, int]] = []  # open elements by name and number
        at: dict[str, list[int]] = {}  # where in the stack the open elements of a name are
        walls: list[int] = []  # where in the stack the open blocks are
        articles = links = 0
        tags: list[str] = []
        block: Block | None = None

        def close(upto: int) -> None:
            nonlocal articles, links
            while len(stack) > upto:
                name, _ = stack.pop()
                at[name].pop()
                if name in BLOCKS:
                    walls.pop()
                links -= name == "a"
                articles -= name in ("article", "main")

        for m in _TOKEN.finditer(html):
            raw, slash, name, attributes = m.groups()
            if name is None:
                text = m.group()
                if raw is not None or (text[0] == "<" and len(text) > 1):
                    continue
                if text.isspace() and block is None:
                    continue
                if block is None:
                    block = Block(tags)
                    tags = []
                    self.blocks.append(block)
                own = stack[-1][1] if stack else 0
                block.pieces.append((text, own, links > 0))
                self.words[own] += len(text.split())
                continue
            name = name.lower()
            tags.append(name)
            if name in BLOCKS:
                block = None
            elif name == "br" and block is not None:
                block.pieces.append((" ", stack[-1][1] if stack else 0, False))
            if slash:
                own = at.get(name)
                # an end tag without its element ends nothing, and that of an element in a line no block
                if own and (name in BLOCKS or not walls or own[-1] > walls[-1]):
                    close(own[-1])
            elif name not in VOID and not attributes.endswith("/"):
                # an element whose end tag is left out ends here, but only inside its own parent
                if walls:
                    last = stack[walls[-1]][0]
                    if name in CLOSES.get(last, ()):
                        close(walls[-1])
                self.parent.append(stack[-1][1] if stack else 0)
                # a header inside an article holds its title
                self.hint.append(is_hint(name, attributes) and not (name == "header" and articles))
                self.article.append(name in ("article", "main"))
                self.words.append(0)
                at.setdefault(name, []).append(len(stack))
                if name in BLOCKS:
                    walls.append(len(stack))
                stack.append((name, len(self.parent) - 1))
                links += name == "a"
                articles += name in ("article", "main")

    def places(self) -> list[list[str]]:
        """The place of each piece of each block."""
        inside = list(self.words)
        for e in range(len(inside) - 1, 0, -1):
            inside[self.parent[e]] += inside[e]
        total = inside[0]
        #: the outermost element of the frame around each element, 0 where there is none
        self.framed = framed = [0]
        homed = [False]
        for e in range(1, len(inside)):
            up = self.parent[e]
            framed.append(framed[up] or (e if self.hint[e] and inside[e] < WRAPPER * total else 0))
            homed.append(homed[up] or (self.article[e] and not framed[-1]))
        left = sum(n for n, f in zip(self.words, framed) if not f)
        home = sum(n for n, f, h in zip(self.words, framed, homed) if h and not f)
        has_home = 2 * home >= left and home > 0

        out, run = [], []
        for block in self.blocks:
            size = [0 if framed[e] else len(text.split()) for text, e, _ in block.pieces]
            linked = sum(n for n, p in zip(size, block.pieces) if p[2])
            n = sum(size)
            kind = "link" if linked and 2 * linked > n else "few" if n <= FEW else "text"
            out.append(["frame" if framed[e] else "outside" if has_home and not homed[e] and text != " " else kind for text, e, _ in block.pieces])
            if kind == "link" and n <= MENU_WORDS:
                run.append(len(out) - 1)
            elif n:
                self._menu(out, run)
                run = []
        self._menu(out, run)
        return out

    @staticmethod
    def _menu(places: list[list[str]], run: list[int]) -> None:
        if len(run) >= MENU_BLOCKS:
            for i in run:
                places[i] = ["menu" if p == "link" else p for p in places[i]]


def labelled_pages() -> Iterator[tuple[str, set[str]]]:
    """Pages, and the words of each that are content; every word occurs once."""
    number = iter(range(10**6))
    some = lambda kind, n: " ".join(f"{kind}{next(number)}" for _ in range(n))
    frames = {
        "menu": lambda: "<nav><ul>" + "".join(f'<li><a href="/x">{some("n", 1)}</a></li>' for _ in range(6)) + "</ul></nav>",
        "tabs": lambda: "<div><ul>" + "".join(f'<li><a href="/x">{some("n", 2)}</a></li>' for _ in range(5)) + "</ul></div>",
        "head": lambda: f'<header><a href="/">{some("n", 2)}</a><form><input name="q"><button>{some("n", 1)}</button></form></header>',
        "advert": lambda: f'<div class="ad">{some("n", 8)}</div>',
        "side": lambda: f'<aside><h2>{some("n", 2)}</h2><ul><li><a href="/y">{some("n", 4)}</a></li><li><a href="/z">{some("n", 5)}</a></li></ul></aside>',
        "notice": lambda: f'<div id="cookie-notice"><p>{some("n", 12)}</p><button>{some("n", 1)}</button></div>',
        "comments": lambda: '<section class="comments">' + "".join(f"<div><p>{some('n', 9)}</p></div>" for _ in range(3)) + "</section>",
        "foot": lambda: f'<footer><p>&copy; {some("n", 4)} <a href="/imprint">{some("n", 1)}</a></p></footer>',
        "line": lambda: f"<div>{some('n', 3)}</div>",
    }
    layouts = (("article", "p", 30), ("div", "p", 25), ("main", "p", 12), ("section", "div", 20), ("article", "li", 6), ("div", "blockquote", 15), ("article", "linked", 24))
    for outer, inner, size in layouts:
        for middle in ("advert", "comments", "side"):
            text = lambda: f"{some('c', size)} <b>{some('c', 2)}</b> <a href='/w'>{some('c', 1)}</a>"  # noqa: B023, E731
            body = [f"<h1>{some('c', 5)}</h1>", *(f"<p><a href='/w'>{some('c', size)}</a></p>" if inner == "linked" else f"<{inner}>{text()}</{inner}>" for _ in range(4)), f"<p>{some('c', 3)}</p>"]
            outside = frames["line"]() if outer in ("article", "main") else ""
            page = "".join([frames["head"](), frames["menu"](), frames["notice"](), outside, f"<{outer}>", *body[:3], frames[middle](), *body[3:], f"</{outer}>", frames["tabs"](), frames["side"](), frames["comments"](), frames["foot"]()])
            yield f"<html><body><div class='page has-sidebar'>{page}</div></body></html>", set(re.findall(r"\bc\d+", page))


@cache
def weights() -> tuple[dict[str, float], dict[str, float]]:
    """Weights of words by place and of tags by name; tags cost something even where content is the rule, but less than a word is worth."""
    words = {place: Counter() for place in PLACES}
    names: dict[str, Counter] = {}
    for html, content in labelled_pages():
        page = Page(html)
        for block, places in zip(page.blocks, page.places()):
            good = 0
            for (text, _, _), place in zip(block.pieces, places):
                marks = [w in content for w in re.findall(r"\b[cn]\d+", text)]
                words[place].update(marks)
                good += sum(marks)
            for t in block.tags:
                names.setdefault(t, Counter()).update([good > 0])
    odds = lambda c: math.log((c[True] + 1) / (c[False] + 1))
    word = {place: max(-2.0, min(1.0, odds(c) / 3)) for place, c in words.items()}
    tag = {t: max(-1.5, min(-0.05, odds(c) / 4)) for t, c in names.items()}
    return word, tag


#: Weight of a tag that no labelled page has.
_OTHER_TAG = -0.1
#: What an element of the frame, or a block of no value, costs at most, so that a long advert inside an article doesn't cut it in two.
MOST_COST = -3.0


def best_region(scores: list[tuple[float, float]]) -> tuple[int, int]:
    """First and last (exclusive) of the blocks with the largest sum, from (tags before, words) of each; the longest of equals."""
    best, found, run, first = 0.0, (0, 0), 0.0, 0
    for i, (tags, words) in enumerate(scores):
        if run + tags <= 0:  # the scan starts anew at this block's words
            run, first = 0.0, i
        else:
            run += tags
        run += words
        if run > best or (run == best and best > 0):
            best, found = run, (first, i + 1)
    return found


def extract(html: str | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    word, tag = weights()
    page = Page(html)
    scores, kept, last = [], [], 0
    for block, places in zip(page.blocks, page.places()):
        own = sum(word[p] * len(text.split()) for (text, _, _), p in zip(block.pieces, places))
        tags = sum(tag.get(t, _OTHER_TAG) for t in block.tags)
        frame = min(page.framed[e] for _, e, _ in block.pieces)
        if frame:  # an element of the frame is counted once
            scores.append((0.0 if frame == last else max(own + tags, MOST_COST), 0.0))
        else:
            scores.append((tags, max(own, MOST_COST)))
        last = frame
        kept.append("".join(text for (text, _, _), p in zip(block.pieces, places) if word[p] > 0 or text == " "))
    first, last = best_region(scores)
    texts = (" ".join(unescape(t).split()) for t in kept[first:last])
    return "\n\n".join(t for t in texts if t)


def extract_pages(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, text and n_chars of every page."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [extract(h) for h in batch]
            yield pd.DataFrame({"text": texts, "n_chars": pd.Series(map(len, texts), dtype="int64")})

    return pages.select(*keep, F.pandas_udf(run, "text string, n_chars long")(F.col(html)).alias("_x")).select(*keep, "_x.*")
