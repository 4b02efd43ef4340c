"""Main text of page layouts that the given pages don't have."""

import re
from html.parser import HTMLParser

import pytest

from tidelog.llm import html_text
from tidelog.llm.html_text import main_text

TEXT = "The first block of the text is here, and it goes on with the rest of it."
MORE = "And the end of the text that is in the page is here as well."
ASIDE = "Buy the best of all the things that we have for you and the others."
ARTICLE = f"<article><h1>Head</h1><p>{TEXT}</p><p>{MORE}</p><div class='ad'>{ASIDE}</div></article>"
PLAIN = f"<p>{TEXT}</p><p>{MORE}</p>"
FURNITURE = f"<header>{ASIDE}</header><nav><a href=/>Home</a></nav>{{}}<div class='sidebar'><p>{ASIDE}</p></div><footer>{ASIDE}</footer>"
WRAPPERS = ["<div id='content-sidebar-wrap'>{}</div>", "<div class='no-sidebar'>{}</div>", "<div class='page has-header'>{}</div>", "<form action=x>{}</form>", "<form><div id='no-sidebar'>{}</div></form>"]


@pytest.mark.parametrize("wrap", WRAPPERS)
@pytest.mark.parametrize("order", ["inside", "around"])
def test_wrapped_article(wrap, order):
    page = FURNITURE.format(wrap.format(ARTICLE)) if order == "inside" else wrap.format(FURNITURE.format(ARTICLE))
    assert main_text(f"<body>{page}</body>") == f"Head\n{TEXT}\n{MORE}"


@pytest.mark.parametrize("wrap", WRAPPERS)
def test_wrapped_text_without_article(wrap):
    assert main_text(FURNITURE.format(wrap.format(PLAIN))) == f"{TEXT}\n{MORE}"
    assert main_text(wrap.format(FURNITURE.format(PLAIN + f"<div class='footer-links'>{ASIDE}</div>"))) == f"{TEXT}\n{MORE}"


@pytest.mark.parametrize("role", ['role="main"', "role=main", "role='main' class='no-sidebar'"])
def test_main_in_a_wrapper(role):
    assert main_text(f"<p>{ASIDE}</p><div class='header'><div {role}>{PLAIN}</div></div>") == f"{TEXT}\n{MORE}"


def test_articles_that_are_comments_or_teasers_stay_off():
    comment = f"<div class='comments'><article>{ASIDE}</article></div>"
    assert main_text(f"<div class='no-sidebar'>{ARTICLE}{comment}</div>") == f"Head\n{TEXT}\n{MORE}"
    assert main_text(ARTICLE + comment) == f"Head\n{TEXT}\n{MORE}"
    assert main_text(f"<div>{PLAIN}</div><div class='related'><article>{ASIDE}</article></div>") == f"{TEXT}\n{MORE}"
    assert main_text(f"<main><div class='no-sidebar'>{ARTICLE}</div></main>") == f"Head\n{TEXT}\n{MORE}"


def test_pages_of_off_parts_alone_stay_empty():
    assert main_text(f"<nav>{ASIDE}</nav><div class='ad'>{ASIDE}</div><div id='cookie-banner'>{ASIDE}</div>") == ""


def test_short_blocks_inherit_from_the_nearer_neighbour():
    ad = f"<div class='ad'>{ASIDE}</div>"
    assert main_text(f"<nav>{ASIDE}</nav><p>First.</p>{PLAIN}<p>Last.</p><footer>{ASIDE}</footer>") == f"First.\n{TEXT}\n{MORE}\nLast."
    assert main_text(f"<p>{TEXT}</p><p>Short.</p>{ad}<p>Too.</p><p>{MORE}</p>") == f"{TEXT}\nShort.\nToo.\n{MORE}"
    links = "<div><a href=/>one of the links that are here on the page</a></div>"
    assert main_text(f"{links}<p>Far.</p><p>Near.</p><p>At.</p><p>{TEXT}</p>") == f"Near.\nAt.\n{TEXT}"
    assert main_text(f"{links}<p>Far.</p><p>Half.</p><p>Near.</p><p>At.</p><p>{TEXT}</p><h2>Links</h2>{links}") == f"Near.\nAt.\n{TEXT}"


def test_short_blocks_alone():
    assert main_text(f"<nav>{ASIDE}</nav><h1>Head</h1><p>One.</p><p>Two.</p>") == "Head\nOne.\nTwo."


def test_languages_without_known_stop_words():
    polish = "Wczoraj wieczorem mieszkańcy miasta zebrali się przed ratuszem, żeby wspólnie obejrzeć pokaz sztucznych ogni."
    chinese = "昨天晚上，市民们聚集在市政厅前，一起观看了盛大的烟花表演。" * 4
    for text in (polish, chinese):
        assert main_text(f"<nav>{ASIDE}</nav><p>{text}</p><p>{text}</p><div><a href=/>menu</a></div><footer>{ASIDE}</footer>") == f"{text}\n{text}"
    assert main_text(f"<p>{TEXT}</p><p>{polish}</p><p>{MORE}</p>") == f"{TEXT}\n{polish}\n{MORE}"


def test_links_in_an_article():
    cited = "<a href=x>Smith and Jones (2020), The history of the town and its hall</a>"
    menu = "<ul><li><a href=/>Home</a><li><a href=/a>About us</a></ul>"
    own = "Smith and Jones (2020), The history of the town and its hall"
    assert main_text(f"<article><p>{TEXT}</p>{menu}<ul><li>{cited}</ul><ol><li><a href=x>Smith</a></ol><p><a href=x>The report.</a></p></article>") == f"{TEXT}\n{own}\nSmith\nThe report."


def test_text_elements_with_telling_names_and_formulas():
    assert main_text(f"<article><p class='notice-board'>{TEXT}</p><p>{MORE} <math><mi>x</mi>=<mn>5</mn></math> end.</p><div class='notice-board'><p>{ASIDE}</p></div></article>") == f"{TEXT}\n{MORE} x=5 end."
    assert main_text(f"<article><p class='ad'>{ASIDE}</p><p>{TEXT}</p></article>") == TEXT


@pytest.mark.parametrize("name", ["has-sidebar", "no-comments", "search-results", "menu-open", "with-comments"])
def test_everyday_wrapper_names(name):
    assert main_text(f"<div class='layout {name}'>{ARTICLE}</div>") == f"Head\n{TEXT}\n{MORE}"


class Plain(HTMLParser):
    """The text of the article of a page of the given kind, from Python's own parser: blocks of h1 to h6, p, li, td and the like, without parts of class ad."""

    BLOCKS = ("h1", "h2", "h3", "p", "li", "td", "th", "div", "ul", "ol", "table", "tr", "blockquote", "section", "figcaption", "figure", "pre", "article", "aside", "nav", "footer", "header", "form", "dl", "dt", "dd")
    OFF = ("aside", "nav", "footer", "form", "script", "style", "template", "noscript")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.parts, self.inside, self.off, self.stack = [], [], False, 0, []

    def cut(self):
        text = " ".join("".join(self.parts).split())
        if text and self.inside and not self.off:
            self.blocks.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS or tag in self.OFF:
            self.cut()
            off = tag in self.OFF or bool({"ad", "comments", "comment", "notice", "sidebar", "related", "share"} & set((dict(attrs).get("class") or "").split()))
            if tag == "article":
                self.inside = True
            if tag == "p" and self.stack and self.stack[-1][0] == "p":
                self.off -= self.stack.pop()[1]
            self.stack.append((tag, off))
            self.off += off
        elif tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in self.BLOCKS or tag in self.OFF:
            self.cut()
            names = [t for t, _ in self.stack]
            if tag in names:
                while True:
                    t, off = self.stack.pop()
                    self.off -= off
                    if t == tag:
                        break
            if tag == "article":
                self.inside = False

    def handle_data(self, data):
        self.parts.append(data)


def test_given_pages_against_another_parser(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.report(pages).collect()}
    with_article = 0
    for r in pages.collect():
        if not re.search("<article", r["html"] or ""):
            continue
        p = Plain()
        p.feed(r["html"])
        p.close()
        p.cut()
        with_article += 1
        assert got[r["page_id"]] == "\n".join(p.blocks), r["page_id"]
    assert with_article > 10


def test_pages_with_odd_names(spark):
    d = spark.createDataFrame([(1, 2, "u", f"<p>{TEXT}</p>")], "`a.b` int, text int, url string, html string")
    assert tuple(html_text.extracted(d).first()) == (1, "u", TEXT)
