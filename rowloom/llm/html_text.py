"""HTML extraction: flat text blocks, classified by a decision tree over words and link density of neighbours.

A page is read once, in time linear in its size, into a flat list of text blocks (Kohlschuetter et al., 2010). A block has
its number of words and its link density, those of the blocks before and after it, and weak hints of where it stands:

* kind: of a heading, of a paragraph or list item, or of anything else;
* share: of the text that the nearest element which looks like furniture holds (menus, footers, adverts, notices, forms,
  by element name or by whole words of class, id and role). A part of the page holds little, a wrapper nearly all, so a
  wrapper with a name of furniture doesn't make furniture of what it wraps;
* inner: whether that element stands inside the main text's element, or the other way round;
* comments: whether that element is for reader comments;
* main: whether the block stands in an element for the main text, and whether the page has one at all;
* plain: whether the page has neither links nor anything that looks like furniture.

A decision tree trained on the blocks of a few hand-labelled layouts (LAYOUTS) tells text from furniture.
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
UNSEEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
#: Elements whose content is no markup: it ends at their own end tag only, or with the page.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in "script style title textarea xmp iframe noembed noframes".split()}
#: Elements that flow within a block; any other tag starts a new one.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Void elements that start a new block.
BREAKS = frozenset(["hr"])
#: Elements of page furniture (a header inside the main text isn't), and of main text.
FURNITURE = frozenset("nav footer aside form menu dialog button fieldset datalist select noscript template svg math object audio video canvas".split())
MAIN = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p li blockquote pre dd dt figcaption summary".split())
#: End tags that may be left out: a new element of the same kind ends the open one.
IMPLIED = frozenset("p li dt dd tr td th option".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond replies reply".split())
#: Words of class, id and role that mark furniture: the names in use on the web for each kind.
FURNITURE_WORDS = COMMENT_WORDS | frozenset(
    "ad ads advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs byline consent contentinfo cookie cookies copyright discussion disclaimer "
    "footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promotion related recommended "
    "search share sharing sidebar signup skyscraper social sponsor sponsored subscribe subscription toc toolbar topbar widget widgets complementary alert".split()
)
#: Words that only say where or what kind of part it is: "site-footer" is a footer, "has-sidebar" isn't a sidebar.
PLACE_WORDS = frozenset("area bar block body bottom box button buttons container form global icon icons inner item left link links list main message overlay page panel post posts primary right secondary section site text top wrap wrapper user".split())
CAMEL = re.compile(r"([a-z])([A-Z])")
#: What a mark of an element says.
PLAIN, SIDE, TEXT, REPLIES = range(4)


def _named(token: str) -> int:
    """SIDE or REPLIES if a class, id or role as a whole names furniture: a word for it, alone or with words of place."""
    words = [w for w in CAMEL.sub(r"\1-\2", token).lower().replace("_", "-").split("-") if w]
    if not words or not all(w in FURNITURE_WORDS or w in PLACE_WORDS for w in words):
        return PLAIN
    return REPLIES if any(w in COMMENT_WORDS for w in words) else SIDE if any(w in FURNITURE_WORDS for w in words) else PLAIN


def _mark(tag: str, attributes: str, in_main: bool) -> int:
    """PLAIN, SIDE (furniture), TEXT (main text) or REPLIES (reader comments), by element name, then by attributes."""
    mark = TEXT if tag in MAIN else SIDE if tag in FURNITURE or tag == "header" and not in_main else PLAIN
    if not attributes or tag in ("body", "html"):
        return mark
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and UNSEEN.search(value):
            mark = SIDE
        elif name in ("class", "id", "role", "aria-label"):
            found = max(map(_named, value.split()), default=PLAIN)
            if found == REPLIES:
                return REPLIES
            if tag not in MAIN:
                mark = SIDE if found else TEXT if name == "role" and value.strip().lower() == "main" and not mark else mark
        elif name == "itemprop" and value.strip().lower() == "articlebody" and not mark:
            mark = TEXT
    return mark


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name in lower case, whether an end tag, attributes) of each tag; name is empty for what is no text.

    Every step moves forward or remembers that what it looked for doesn't occur any more, so the whole is linear.
    """
    at, size, lost, quotes = 0, len(page), set(), True
    find = page.find

    def close_of(start: int) -> int:
        """The place of the ">" of a tag, stepping over quoted values; -1 if there is none."""
        here = start
        while m := STOP.search(page, here):
            here = m.end()
            if m[0] == ">":
                return m.start()
            k = m.start() - 1
            while k > start and page[k].isspace():
                k -= 1
            if page[k] == "=" and quotes and m[0] not in lost:
                over = find(m[0], here)
                if over < 0:
                    lost.add(m[0])
                else:
                    here = over + 1
        return -1

    while (i := find("<", at)) >= 0:
        if page.startswith("<!--", i):
            end = find("-->", i + 4)
            end = size if end < 0 else end + 3
            yield i, end, "", False, ""
        elif page.startswith("<![CDATA[", i) and "]]>" not in lost and (end := find("]]>", i)) >= 0:
            end += 3
            yield i, end, "", False, ""
        elif page.startswith(("<!", "<?"), i):
            lost.add("]]>")
            end = find(">", i)
            end = size if end < 0 else end + 1
            yield i, end, "", False, ""
        else:
            closing = page.startswith("</", i)
            m = NAME.match(page, i + 1 + closing)
            if not m:
                at = i + 1
                yield i, i, "<", False, ""
                continue
            end = close_of(m.end())
            if end < 0 and quotes:  # a quote swallowed the rest of the page
                quotes = False
                end = close_of(m.end())
            name = m[0].lower()
            if end < 0:
                yield i, size, "", False, ""
                return
            attributes, end = page[m.end() : end], end + 1
            if name in RAW and not closing:
                over = RAW[name].search(page, end)
                end = size if not over else over.start()
                yield i, end, "", False, ""
            else:
                yield i, end, name, closing, attributes
        at = end


class Block(NamedTuple):
    text: str
    words: int
    density: float  # share of the words that are links
    kind: int  # 2 of a heading, 1 of a paragraph, 0
    holder: int  # the nearest element of furniture, -1
    inner: bool  # whether that stands inside the main text's element
    comments: bool
    main: bool


def blocks(page: str) -> tuple[list[Block], list[list[int]]]:
    """The text blocks in page order, and for each element of furniture its first block and the one after its last."""
    out: list[Block] = []
    holders: list[list[int]] = []
    stack: list[tuple] = []  # open elements: (tag, mark, and what held before: holder, inner, comments)
    block_at: list[int] = []  # places of block elements in the stack
    depths: dict[str, list[int]] = defaultdict(list)  # for each open tag, how many block elements were open
    text: list[str] = []
    linked = main = anchors = mains = 0
    holder, inner, comments = -1, False, 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = "".join(text)
            words = (html_lib.unescape(joined) if "&" in joined else joined).split()
            if words:
                n, tag = len(words), stack[block_at[-1]][0] if block_at else ""
                kind = 2 if tag in HEADINGS else 1 if tag in PARAGRAPHS else 0
                out.append(Block(" ".join(words), n, min(1.0, linked / n), kind, holder, inner, comments > 0, main > 0))
            text.clear()
        linked = 0

    def push(tag: str, mark: int, link: bool) -> None:
        nonlocal holder, inner, comments, main, anchors, mains
        depths[tag].append(len(block_at))
        if tag not in INLINE:
            block_at.append(len(stack))
        stack.append((tag, mark, link, holder, inner, comments))
        anchors += link
        if mark == TEXT:
            main, mains, inner, comments = main + 1, mains + 1, False, 0
        elif mark:
            holder, inner, comments = len(holders), main > 0, int(mark == REPLIES or comments > 0)
            holders.append([len(out), -1])

    def pop() -> str:
        nonlocal holder, inner, comments, main, anchors
        tag, mark, link, before, inside, replies = stack.pop()
        depths[tag].pop()
        if tag not in INLINE:
            block_at.pop()
        anchors -= link
        if mark == TEXT:
            main -= 1
        elif mark:
            holders[holder][1] = len(out)
        holder, inner, comments = before, inside, replies
        return tag

    at = 0
    for start, end, tag, closing, attributes in _tags(page):
        if start > at:
            piece = page[at:start]
            text.append(piece)
            if anchors:
                linked += len((html_lib.unescape(piece) if "&" in piece else piece).split())
        at = end
        if not tag or tag == "<":
            continue
        if tag in VOID:
            if tag == "br":
                text.append(" ")
            elif tag in BREAKS:
                flush()
        elif tag in INLINE:
            if closing:
                if depths[tag] and depths[tag][-1] == len(block_at):  # opened in this block
                    k = len(stack) - 1
                    while stack[k][0] != tag:
                        k -= 1
                    if any(e[1] for e in stack[k:]):
                        flush()
                    while pop() != tag:
                        pass
            elif not attributes.endswith("/"):
                mark = _mark(tag, attributes, main > 0)
                if mark:
                    flush()
                push(tag, mark, tag == "a" and "href" in attributes.lower())
        else:
            flush()
            if closing:
                if depths[tag]:
                    while pop() != tag:
                        pass
            elif not (attributes.endswith("/") and tag not in ("p", "div")):
                top = stack[block_at[-1]][0] if block_at else ""
                if top == "p" or top == tag and tag in IMPLIED:  # an end tag left out
                    while pop() != top:
                        pass
                mark = _mark(tag, attributes, main > 0)
                # an article among comments, or that is one, is no main text, unless it is the page's first
                push(tag, REPLIES if mark == TEXT and comments and mains else mark, False)
    text.append(page[at:])
    flush()
    for h in holders:
        h[1] = len(out) if h[1] < 0 else h[1]
    return out, holders


#: Names of the features, in their order.
FEATURES = ("words", "density", "words before", "density before", "words after", "density after", "kind", "share", "inner", "comments", "main", "page has main", "plain page")


def features(found: list[Block], holders: list[list[int]]) -> np.ndarray:
    """A row a block of FEATURES; share is 2 outside of any furniture.

    A share is of the words in main text, where the page has any, else of all words.
    """
    own = np.array([(b.words, b.density, b.kind, b.holder, b.inner, b.comments, b.main) for b in found], np.float64).reshape(-1, 7)
    has_main, plain = bool(own[:, 6].any()), not holders and not own[:, 1].any()
    counted = np.concatenate([[0], np.cumsum(own[:, 0] * own[:, 6] if has_main else own[:, 0])])
    held = np.array([counted[b] - counted[a] for a, b in holders] + [2 * counted[-1]]) / max(1.0, counted[-1])
    edge = np.zeros((1, 2))
    around = np.vstack([edge, own[:, :2], edge])
    rest = np.column_stack([own[:, 2], held[own[:, 3].astype(int)], own[:, 4:], np.full(len(own), has_main), np.full(len(own), plain)])
    return np.hstack([own[:, :2], around[:-2], around[2:], rest]).astype(np.float32)


#: The labelled table, by hand: blocks of common layouts of web pages. A block is written as its label, + for main text and
#: - for anything else, and its number of words.
LAYOUTS = [
    # a news page with its article in an element of its own; paragraphs of one word
    "<nav><ul><li><a href=x>-1</a><li><a href=x>-2</a><li><a href=x>-1</a></ul></nav><div class=ad>-9</div><article><h1>+7</h1><p>+60<p>+1<p>+25<p>+80<p>+2</article><footer>-6</footer>",
    "<nav><a href=x>-1</a></nav><div class=ad>-14</div><article><h1>+1</h1><p>+1</article><footer>-9</footer>",
    # a blog: the title in the article's header, a byline, sharing, comments as articles, a sidebar
    "<header><div><a href=x>-3</a></div><p>-6</p></header><main><article><header><h1>+8</h1><div class=byline>-4</div></header><div class=entry-content><p>+55</p><h2>+3</h2><p>+40</p><ul><li>+4<li>+6</ul>"
    "<div class=share><a href=x>-2</a></div><p>+12</p></div></article><section id=comments class=comments-area><h2>-2</h2><ol class=comment-list><li><article class=comment><p>-45</p></article><li><article><p>-70</p></article></ol>"
    "<form>-3<button>-2</button></form></section></main><aside class=sidebar><h3>-2</h3><ul><li><a href=x>-5</a><li><a href=x>-7</a></ul><p>-30</p></aside><footer><p>-12</p></footer>",
    # one form around all of the page, no element for main text
    "<form id=aspnetForm><div class=header>-3<a href=x>-2</a></div><div id=menu><a href=x>-1</a><a href=x>-1</a></div><div id=content><h1>+3</h1><p>+50</p><p>+35</p><p>+4</p></div><div class=footer>-8</div></form>",
    # the same with an article
    "<form id=form1><div id=menu><a href=x>-1</a></div><article><h1>+5</h1><p>+40</p><p>+3</p></article><div class=footer>-12</div></form>",
    # wrappers with a name of furniture around the article
    "<div class='widget'><div class=header>-4</div><article><h1>+2</h1><p>+33</p><div class=ad>-15</div><p>+9</p></article></div>",
    "<div aria-hidden=true><main><p>+20</p><p>+2</p></main><p>-5</p></div><div class=cookie-banner>-60</div>",
    "<div class=banner><h1>+4</h1><p>+60</p><p>+45</p><div>-3</div></div><div class=sidebar><p>-20</p><a href=x>-3</a></div>",
    # an old page in a table
    "<table><tr><td><a href=x>-1</a><br><a href=x>-2</a><td>+90<td>-3</table><table><tr><td>-5</table>",
    "<table><tr><td>-2<td><a href=x>-4</a><tr><td><a href=x>-6</a><td><h1>+3</h1><p>+44<p>+6<p>+31<br></table><div>-7</div>",
    # a page without any names: a short title, a short last paragraph
    "<div><a href=x>-1</a> <a href=x>-1</a></div><h1>+1</h1><p>+30</p><p>+55</p><p>+3</p><div>-4</div>",
    "<div>-2</div><h1>+6</h1><div>+70</div><div>+25</div><h2>+2</h2><div>+40</div><div>-5</div><ul><li><a href=x>-3</a><li><a href=x>-4</a></ul>",
    "<div><a href=x>-1</a></div><h1>+2</h1><p>+40</p><p>+35</p><p>+3</p>",
    "<div><a href=x>-4</a></div><h2>+3</h2><p>+25</p><p>+9</p>",
    "<p><a href=x>-2</a><h1>+4</h1><p>+18</p><p>+5</p><p>+40</p><p><a href=x>-3</a></p>",
    # a recipe: lists of short items
    "<div class=navbar><a href=x>-1</a><a href=x>-1</a></div><div class=content><h2>+3</h2><p>+28</p><ul><li>+3<li>+2<li>+4</ul><ol><li>+14<li>+9</ol></div><div class=related><h3>-2</h3><a href=x>-6</a></div><div class=newsletter><p>-18</p></div>",
    # documentation with a table of contents and code
    "<div role=banner>-3</div><div class=toc><a href=x>-2</a><a href=x>-3</a></div><div role=main><h1>+2</h1><p>+22</p><pre>+15</pre><p>+3</p><div class=notice>-12</div><div>+5</div><h2><a href=x>+2</a></h2><p>+7</p></div>",
    # news without an element for main text, adverts between paragraphs
    "<div class=masthead>-4</div><div class=story><h1>+9</h1><p>+42</p><div class=advert>-20</div><p>+38</p><p>+11</p></div><div class=social><a href=x>-1</a></div><div class=comments><p>-60</p><p>-35</p><p>-90</p></div><div id=footer><p>-9</p></div>",
    # a short text with many comments, and one with a long notice
    "<div class=post><h1>+3</h1><p>+12</p></div><div id=comments><p>-80</p><p>-50</p><p>-120</p></div>",
    "<main><p>+6</p><div id=comments><p>-80</p><p>-50</p></div></main>",
    "<div id=cookie-notice>-55</div><main><h1>+2</h1><p>+9</p><div class=newsletter>-45<form>-3</form></div></main>",
    # teasers of other articles
    "<article><h1>+5</h1><p>+66</p></article><aside><article><h3><a href=x>-7</a></h3><p>-20</p></article><article><p>-15</p></article></aside><div>-25</div><p>-30</p><h2>-3</h2>",
    # a page builder whose main text is all in parts named widgets
    "<main><div class=widget><h1>+4</h1><p>+70</p><p>+30</p><p>+2</p></div></main><footer>-9<p>-20</p></footer>",
    "<main><p>+2</p><div class=promo><p>-6</p></div><div class=site-footer>-2</div><aside><p>-40</p></aside><p>+8</p></main>",
    # pages of links or furniture only
    "<ul><li><a href=x>-2</a><li><a href=x>-4</a><li><a href=x>-3</a></ul><div><a href=x>-9</a></div><div>-3</div>",
    "<nav><a href=x>-3</a></nav><div class=login><form>-2</form></div><footer><p>-15</p><a href=x>-2</a></footer>",
    "<p><a href=x>-12</a></p><p><a href=x>-15</a></p><h2><a href=x>-5</a></h2><p><a href=x>-20</a></p><div><a href=x>-30</a></div>",
    # main text with many links: a list of references in an article
    "<article><h1>+3</h1><p>+40</p><h2>+1</h2><ol><li><a href=x>+8</a><li><a href=x>+6</a></ol><p><a href=x>+1</a></p></article><div><a href=x>-5</a></div><p>-4</p>",
    # bare and short pages: nothing around a few words, with or without elements
    "+3",
    "<body>+5</body>",
    "<div>+4</div>",
    "<div>+2</div><div>+9</div>",
    "<body>+1<br>+6</body>",
    "<div><div>+12</div></div>",
    "<html><head></head><body>+20</body></html>",
    "<div>+6</div><div>+3</div><div>+8</div>",
    "<p>+2",
    "<h1>+2</h1><div>+4</div>",
    "<td>+5",
    "<body><div>+7</div>+3</body>",
    "<span>+2</span>",
    "<article>+5</article>",
    "<div>+3</div><div>+3</div>",
    "<div>+4</div><div>+4</div>",
    "<div>+8</div><div>+8</div>",
]
_WRITTEN = re.compile(r"([+-])(\d+)")
#: How often each layout is read with other numbers of words, and how far they vary: where an element names the main text,
#: from a word to many; elsewhere about as written, as there they tell text from furniture.
VARIANTS, FREE, NEAR = 12, 3.0, 0.4


def labelled_table(layouts: list[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features of the blocks of the labelled layouts, and whether each is main text."""
    draw = random.Random(11)
    rows, wanted = [], []
    for layout in LAYOUTS if layouts is None else layouts:
        spread = FREE if re.search("<article|<main|role=main", layout) else NEAR
        for k in range(VARIANTS + 1):
            words = lambda m: f" {m[1]}" * max(1, round(int(m[2]) * math.exp(draw.uniform(-spread, 0.4)))) if k else f" {m[1]}" * int(m[2])  # noqa: B023, E731
            found, holders = blocks(_WRITTEN.sub(lambda m: words(m) + " ", layout))
            labels = [set(b.text.split()) for b in found]
            if any(len(x) != 1 for x in labels):
                raise ValueError(f"a block of two labels in {layout}")
            rows.append(features(found, holders))
            wanted += ["+" in x for x in labels]
    return np.vstack(rows), np.array(wanted, bool)


def train_tree(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 5):
    """A decision tree by Gini impurity: (feature, threshold, below, above), or the share of wanted rows at a leaf."""
    share, n = float(y.mean()), len(y)
    if not depth or n < 2 * least or share in (0.0, 1.0):
        return share
    best = (2 * share * (1 - share) * n - 1e-9, -1, 0.0)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        values, low = x[order, j].astype(float), np.cumsum(y[order])[:-1].astype(float)
        below = np.arange(1.0, n)
        loss = 2 * low * (1 - low / below) + 2 * (low[-1] + y[order[-1]] - low) * (1 - (low[-1] + y[order[-1]] - low) / (n - below))
        loss[(values[1:] == values[:-1]) | (np.minimum(below, n - below) < least)] = np.inf
        k = int(loss.argmin())
        if loss[k] < best[0] - 1e-9:
            best = (float(loss[k]), j, float(values[k] + values[k + 1]) / 2)
    if best[1] < 0:
        return share
    under = x[:, best[1]] <= best[2]
    return (best[1], best[2], train_tree(x[under], y[under], depth - 1, least), train_tree(x[~under], y[~under], depth - 1, least))


def classify(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree > 0.5)
    j, cut, low, high = tree
    out, below = np.empty(len(x), bool), x[:, j] <= cut
    out[below], out[~below] = classify(low, x[below]), classify(high, x[~below])
    return out


def main_text(page: str, tree) -> str:
    found, holders = blocks(page)
    if not found:
        return ""
    wanted = classify(tree, features(found, holders))
    return "\n\n".join(b.text for b, w in zip(found, wanted, strict=True) if w)


def extract(pages: DataFrame, labelled: tuple[np.ndarray, np.ndarray] | None = None, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep, text and n_chars (code points) of every page; text is empty where a page is null, empty or all furniture.

    No shuffle and no state between pages: repeated rows get the same text. Extra columns are ignored unless kept, kept
    ones may have any names but text and n_chars; an empty table gives an empty result. Pages are taken whole, a few MB at
    a time or one alone, in time linear in their size whatever their markup.
    """
    tree = train_tree(*(labelled or labelled_table()))
    out = map_texts(pages, list(keep), html, [("text", pa.string(), "string")], lambda texts: [[main_text(t, tree) for t in texts]])
    return out.withColumn("n_chars", F.length("text").cast("long"))
