"""HTML extraction on pages of many layouts, against texts that are known by construction."""

import random
import time

import numpy as np
import pytest

from rowloom.llm import html_text


@pytest.fixture(scope="module")
def tree():
    return html_text.train_tree(*html_text.labelled_table())


def say(n, draw):
    return " ".join(draw.choice(["word", "text", "a", "line", "thing"]) for _ in range(n))


SITE = {
    "top": ["<header><a href=/>Home</a><p>The slogan of the site</p></header>", "<div id=masthead>The Site</div>", "<nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav>", "<div class='cookie-banner'>We use cookies and you agree to all of them by reading on</div>"],
    "end": ["<footer><p>All rights reserved by the site</p></footer>", "<div class=sidebar><h3>More</h3><ul><li><a href=x>Another page</a></ul></div>", "<aside><p>About this author, who writes many things here</p></aside>", "<form><label>Mail</label><input><button>Go</button></form>", "<script>var x = '<p>no</p>';</script>"],
    "inner": ["<div class=ad>Buy this thing now, it is cheap</div>", "<div class=share><a href=x>Share</a></div>", "<aside>See also</aside>", "<style>p { margin: 0 }</style>", "<!-- <p>no</p> -->"],
    "comments": ["", "<section id=comments class=comments-area><h2>Comments</h2><ol><li><article class=comment><p>" + "I think so too and say it at length " * 9 + "</p></article></ol></section>"],
}
#: Wrappers of the whole page and of the article; names of furniture among them.
OUTER = [("<body>", "</body>"), ("<body><form id=aspnetForm>", "</form></body>"), ("<div class=overflow-hidden>", "</div>"), ("<div class='content has-sidebar'>", "</div>"), ("<div aria-hidden=false>", "</div>"), ("<div class='page widget'>", "</div>"), ("<section class=header-fixed>", "</section>")]
INNER = [("<article>", "</article>"), ("<main>", "</main>"), ("<main class=market-share-report><article title='hidden gems'>", "</article></main>"), ("<div role=main>", "</div>"), ("<article class='post comments-open'><div class=entry>", "</div></article>"), ("<div itemprop=articleBody>", "</div>")]


@pytest.mark.parametrize("seed", range(40))
def test_marked_articles_are_whole(tree, seed):
    """Every text of the article, whatever its length, and nothing else."""
    draw = random.Random(seed)
    wanted, body = [], []
    title = say(draw.choice([1, 6]), draw)
    wanted.append(title)
    body.append(draw.choice(["<h1>{}</h1>", "<header><h1>{}</h1></header>"]).format(title))
    for _ in range(draw.randint(1, 12)):
        text = say(draw.choice([1, 2, 8, 30, 90]), draw)
        wanted.append(text)
        first, _, rest = text.partition(" ")
        body.append(draw.choice(["<p>{0} {1}</p>", "<p><a href=x>{0}</a> {1}", "<p><b>{0}<br>{1}", "<blockquote>{0}\n {1}</blockquote>", "<ul><li>{0} <i>{1}</i></ul>"]).format(first, rest))
        if draw.random() < 0.3:
            body.append(draw.choice(SITE["inner"]))
    (a, b), (c, d) = draw.choice(OUTER), draw.choice(INNER)
    some = lambda kind: "".join(draw.sample(SITE[kind], 2))
    page = f"<html><head><title>t</title></head>{a}{some('top')}{c}{''.join(body)}{d}{draw.choice(SITE['comments'])}{some('end')}{b}</html>"
    assert html_text.main_text(page, tree) == "\n\n".join(" ".join(x.split()) for x in wanted)


@pytest.mark.parametrize("seed", range(20))
def test_pages_without_an_element_for_the_text(tree, seed):
    """Headings, paragraphs and short last lines are told from menus and footers by words, links and neighbours."""
    draw = random.Random(seed)
    wanted = [say(draw.choice([1, 5]), draw)] + [say(draw.randint(20, 90), draw) for _ in range(draw.randint(2, 6))] + [say(3, draw)]
    body = f"<h1>{wanted[0]}</h1>" + "".join(f"<p>{x}</p>" for x in wanted[1:])
    menu = "<div><a href=x>Home</a> <a href=y>News</a></div>"
    end = draw.choice(["", "<div>Imprint</div>", "<div class=footer>All rights reserved</div>", "<div><a href=x>Back to the top</a></div>"])
    a, b = draw.choice(OUTER)
    assert html_text.main_text(f"{a}{menu}{body}{end}{b}", tree) == "\n\n".join(wanted)


@pytest.mark.parametrize(
    "page, wanted",
    [
        ("<aside class=related><article><h3>Other</h3></article></aside><article><h1>T</h1><p>" + "a " * 60 + "</article>", "T\n\n" + " ".join("a" * 60)),
        ("<form id=f><div class=menu><a href=x>m</a></div><article><p>a</p></article></form>", "a"),
        ("<article><header><h1>T</h1><div class=byline>By A</div></header><p>a</p></article>", "T\n\na"),
        ("<article><p>a</p><form><p>b</p></form><p>c</p></article>", "a\n\nc"),
        ("<article>1 < 2 &amp;&amp; 3 > 2 <p>x<br/>y&nbsp;z</article>", "1 < 2 && 3 > 2\n\nx y z"),
        ("<article><p title=\"a > b\">c</p><p title='>'>d</p></article>", "c\n\nd"),
        ("<article><p>a</p><a href=\"x>b</a><p>c</p>", "a\n\nb\n\nc"),
        ("<article><p>a</p><textarea><p>b</textarea><noscript><p>c</p></noscript><p>d</article>", "a\n\nd"),
    ],
)
def test_pages(tree, page, wanted):
    assert html_text.main_text(page, tree) == wanted


@pytest.mark.parametrize("part", ["<a ", "<div class=ad><b>x", "<i>", "<p class='", "<div></span></b>x", "<![CDATA[x", "<b><div><i>x</b>", "<!x", '<a b="x\' ', "</p", "<svg>a", "<li><i>x", "<a href=\"x>y</a> '"])
def test_time_is_linear_in_malformed_pages(tree, part):
    """Pages of 1 MB of unclosed tags, quotes and stray ends take seconds, not hours."""
    began = time.process_time()
    html_text.main_text(part * ((1 << 20) // len(part)), tree)
    assert time.process_time() - began < 30


def test_tree_is_learnt_from_labels():
    """The tree gives the labels of layouts that it hasn't seen, mostly, and of those that it has, nearly always."""
    x, y = html_text.labelled_table()
    assert (html_text.classify(html_text.train_tree(x, y), x) == y).mean() > 0.99
    right = []
    for k in range(5):
        tree = html_text.train_tree(*html_text.labelled_table([p for i, p in enumerate(html_text.LAYOUTS) if i % 5 != k]))
        unseen, labels = html_text.labelled_table([p for i, p in enumerate(html_text.LAYOUTS) if i % 5 == k])
        right.append((html_text.classify(tree, unseen) == labels).mean())
    assert np.mean(right) > 0.85


BARE = ["{}", "<body>{}</body>", "<div>{}</div>", "<p>{}</p>", "<html><body><div><div>{}</div></div></body></html>", "<table><tr><td>{}</table>", "<span>{}</span>", "<section>{}</section>", "<ul><li>{}</ul>", "{}<br>{}",
        "<div>{}</div><div>{}</div>", "<h1>Title here</h1><div>{}</div>", "<div>{}</div><p>second one</p>", "<p>{}</p><p>two words</p>"]


def test_bare_and_short_pages_keep_their_text():
    tree = html_text.train_tree(*html_text.labelled_table())
    lost = [(n, f) for n in range(1, 31) for f in BARE for page in [f.replace("{}", " ".join(["word"] * n))] if html_text.main_text(page, tree).count("word") != page.count("word")]
    assert lost == []
