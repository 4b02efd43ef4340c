"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass classifies blocks by length, link density and stop-word
density, and by where they stand (menus, headers, footers, sidebars, notices, adverts, forms and comments are never
main text); blocks too short to tell, and long ones in a language without known stop words, stay undecided. In the second
pass an undecided block inherits the label of its nearest decided neighbour. Forms and parts named by class or id words may also be wrappers around the page; these are
judged by what they hold (see `outside`). Pages are independent of each other, so the plan is a scan and one Arrow map: no shuffle,
and a task holds one batch of pages.

Stop words are known for four languages; long blocks without links of any other are judged by their neighbours, or count as
text where nothing on the page is decided.

Defined results: null and empty pages give an empty text; tags that are never closed end with the page; repeated rows
are rows of their own; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import STOP_WORDS

_STOP = frozenset(STOP_WORDS)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|aria-label|itemprop|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_PART = re.compile(r"[a-z]+|[0-9]+")
#: Elements whose content is no text of the page, read up to their end tag.
_RAW = frozenset("script style noscript template textarea title iframe svg object canvas audio video xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OFF = frozenset("nav footer aside form button select dialog menu head".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_INLINE_BREAK = frozenset(("br", "wbr"))
_CLOSES_P = _BLOCK - {"td", "th", "tr", "option", "legend", "caption", "tbody", "thead", "tfoot"}
_SAME = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Words of class and id names that mark parts beside the main text.
_BESIDE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion promotions sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs footer foot header masthead topbar toolbar comment comments commentlist disqus respond reply replies notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets pagination pager copyright legal disclaimer search form alert skip".split()
)
#: How sure it is that a part is beside the main text. A class or id word alone ("no-sidebar", "ad-slot"), and a form, are
#: WEAK; a name of such words only ("sidebar", "cookie-banner", "ad2") is STRONG; elements, roles and hidden parts are HARD.
_NONE, _WEAK, _STRONG, _HARD = range(4)
#: Elements that hold text themselves: a class like "notice-board" doesn't make a paragraph a part beside the text.
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption caption summary".split())
_OFF_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())


@dataclass
class Rules:
    min_words: int = 8
    max_link_density: float = 0.4
    low_stop: float = 0.02
    high_stop: float = 0.12
    long_chars: int = 80


@dataclass(frozen=True)
class Place:
    """Where a block stands: in a HARD part, in an article or main, in a main; how many WEAK and STRONG parts it is in, those outside its article or main being counted as `around`."""

    hard: bool = False
    main: bool = False
    root: bool = False
    around: int = 0
    weak: int = 0
    strong: int = 0


_TOP = Place()


@dataclass
class Block:
    text: str
    link: int
    heading: bool
    place: Place
    #: Number of the list without order that the block is directly in; 0 if in none.
    items: int = 0


def _attrs(attrs: str) -> list[tuple[str, str]]:
    return [(m.group(1).lower(), (m.group(2) or "").strip("\"'").lower()) for m in _ATTR.finditer(attrs)]


def _off(tag: str, attrs: str, inside_main: bool) -> int:
    if tag in _OFF and tag != "form":
        return _HARD
    if tag == "header":
        return _NONE if inside_main else _HARD
    sure = _WEAK if tag == "form" else _NONE
    if not attrs:
        return sure
    for name, value in _attrs(attrs):
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return _HARD
        if name == "role" and value in _OFF_ROLES:
            return _HARD
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            for token in value.split():
                words = [w in _BESIDE for w in _PART.findall(token) if not w.isdigit()]
                if any(words) and (all(words) or tag not in _TEXT):
                    sure = max(sure, _STRONG if all(words) else _WEAK)
    return sure


def _inside(was: Place, tag: str, attrs: str) -> Place:
    root = tag == "main" or (bool(attrs) and ("role", "main") in _attrs(attrs))
    sure = _off("main" if root else tag, attrs, was.main)
    if not (sure or root or tag == "article"):
        return was
    hard, weak, strong, around = was.hard or sure == _HARD, was.weak, was.strong, was.around
    if (root and not was.root) or (tag == "article" and not was.main):
        around, weak, strong = around + weak + strong, 0, 0
    return Place(hard, was.main or root or tag == "article", was.root or root, around, weak + (sure == _WEAK), strong + (sure == _STRONG))


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    parts: list[str] = []
    links: list[str] = []
    stack: list[tuple[str, Place]] = []
    state = {"link": 0, "heading": False, "lists": 0}
    lists: list[tuple[int, int]] = []  # depth of the stack, number; 0 for a list with order

    def close() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, len(" ".join(html.unescape("".join(links)).split())), state["heading"], stack[-1][1] if stack else _TOP, lists[-1][1] if lists else 0))
        parts.clear()
        links.clear()

    def pop(k: int) -> None:
        del stack[k:]
        while lists and lists[-1][0] > k:
            lists.pop()

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start() if m else end]
        if piece:
            parts.append(piece)
            if state["link"]:
                links.append(piece)
        if not m:
            break
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        closing, attrs = bool(m.group(1)), m.group(3) or ""
        if tag in _RAW and not closing:
            if not attrs.endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if tag in _INLINE_BREAK:
            parts.append(" ")
            continue
        if tag == "a":
            state["link"] = 0 if closing else 1
            continue
        if tag in _BLOCK:
            close()
            if closing:
                k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
                if k >= 0:
                    pop(k)
                state["heading"] = False
                state["link"] = 0
            elif tag not in _VOID:
                if tag in _SAME or tag in _CLOSES_P:
                    same = _SAME.get(tag, ()) + (("p",) if tag in _CLOSES_P else ())
                    while stack and stack[-1][0] in same:
                        stack.pop()
                stack.append((tag, _inside(stack[-1][1] if stack else _TOP, tag, attrs)))
                if tag in ("ul", "ol"):
                    state["lists"] += 1
                    lists.append((len(stack), state["lists"] if tag == "ul" else 0))
                state["heading"] = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        elif not closing and attrs and tag not in _VOID and tag in ("span", "section", "ins") and _off(tag, attrs, True):
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = stop.end() if stop else at
    close()
    return out


def outside(found: list[Block], rules: Rules) -> list[bool]:
    """Whether each block is in a part beside the main text.

    A main is part of the page whatever WEAK or STRONG parts are around it. An article is if no article has fewer around it
    and, where there are some, it holds at least the words of the prose that is in no such part (else it is a teaser or a
    comment). In what is left, WEAK parts that all prose is in are wrappers and not beside it.
    """
    words = [len(b.text.split()) for b in found]
    prose = [n >= rules.min_words and b.link <= rules.max_link_density * len(b.text) for b, n in zip(found, words, strict=True)]
    at = [b.place for b in found]
    mains = [i for i, p in enumerate(at) if p.main and not p.hard]
    rooted = any(at[i].root for i in mains)
    least = min((at[i].around for i in mains), default=0)
    if rooted:
        inside = [p.root or (p.main and p.around == 0) for p in at]
    else:
        held = sum(words[i] for i in mains if at[i].around == least and prose[i] and not at[i].strong)
        loose = sum(n for p, n, good in zip(at, words, prose, strict=True) if good and not (p.main or p.hard or p.weak or p.strong))
        inside = [p.main and p.around == least and (least == 0 or held >= loose) for p in at]
    off = [p.hard or p.strong > 0 or (p.main and not kept) for p, kept in zip(at, inside, strict=True)]
    for main in (True, False):
        own = [i for i, p in enumerate(at) if p.main == main and not off[i]]
        level = min((at[i].weak for i in own if prose[i]), default=0)
        for i in own:
            off[i] = at[i].weak > level
    return off


def _menus(found: list[Block], rules: Rules) -> set[int]:
    """Lists without order whose items are all links of a few words."""
    lists = {b.items for b in found if b.items}
    return lists - {b.items for b in found if b.link <= 0.9 * len(b.text) or len(b.text.split()) >= rules.min_words}


def _ahead(first: list[bool | None], off: list[bool]) -> list[tuple[int, bool] | None]:
    """For each block the nearest decided one before it: distance and label. Blocks that are off are no neighbours."""
    out: list[tuple[int, bool] | None] = []
    last: tuple[int, bool] | None = None
    for v, beside in zip(first, off, strict=True):
        last = (last[0] + 1, last[1]) if last and not beside else last
        out.append(last)
        if v is not None and not beside:
            last = (0, v)
    return out


def labelled(found: list[Block], rules: Rules) -> list[bool]:
    """Whether each block is main text."""
    first: list[bool | None] = []
    off, menus = outside(found, rules), _menus(found, rules)
    has_main = any(b.place.main and not x for b, x in zip(found, off, strict=True))
    for b, beside in zip(found, off, strict=True):
        words = b.text.lower().split()
        if beside or (has_main and not b.place.main):
            first.append(False)
        elif b.place.main:  # in the article only a menu in it says otherwise
            first.append(b.items not in menus)
        elif b.link > rules.max_link_density * len(b.text):
            first.append(False)
        elif len(words) < rules.min_words:
            first.append(None)
        else:
            stop = sum(w.strip(".,;:!?\"'()") in _STOP for w in words) / len(words)
            # Long text with few stop words may be in a language that isn't listed.
            foreign = not b.link and len(b.text) >= rules.long_chars
            first.append(True if stop >= rules.high_stop else None if stop >= rules.low_stop or foreign else False)
    # Without any decided text there is nothing to inherit: long blocks without links count as text, or else all undecided ones.
    for least in (rules.long_chars, 0):
        if not any(first):
            first = [True if v is None and len(b.text) >= least and (least == 0 or not b.link) else v for b, v in zip(found, first, strict=True)]
    before, after = _ahead(first, off), _ahead(first[::-1], off[::-1])[::-1]
    out = []
    for b, v, x, y in zip(found, first, before, after, strict=True):
        if v is not None:
            out.append(v)
        elif b.heading or x is None or y is None:  # a heading belongs to what follows it
            out.append(y is not None and y[1] if b.heading or x is None else x[1])
        else:
            out.append(x[1] if x[0] < y[0] else y[1] if y[0] < x[0] else x[1] or y[1])
    return out


def main_text(page: str | None, rules: Rules | None = None) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, good in zip(found, labelled(found, rules or Rules()), strict=True) if good)


def extracted(pages: DataFrame, html_col: str = "html", out: str = "text", rules: Rules | None = None) -> DataFrame:
    """The rows of `pages` with `out` in place of `html_col`."""
    others = [f for f in pages.schema.fields if f.name not in (html_col, out)]
    names = [f"_{i}" for i in range(len(others))]  # whatever the columns are called
    slim = "".join(f"{n} {f.dataType.simpleString()}, " for n, f in zip(names, others, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py(), rules) for x in b.column(b.num_columns - 1)]
            yield pa.record_batch([*b.columns[:-1], pa.array(texts, pa.string())], names=[*names, "text"])

    rows = pages.select(*[F.col(f"`{f.name}`").alias(n) for n, f in zip(names, others, strict=True)], F.col(f"`{html_col}`").cast("string").alias("html"))
    return rows.mapInArrow(run, f"{slim}text string").toDF(*[f.name for f in others], out)


def report(pages: DataFrame) -> DataFrame:
    """The contract's columns for a table with page_id, url and html."""
    return extracted(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
