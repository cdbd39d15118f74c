"""Main text of web pages by the line-block distribution.

Markup is stripped into lines, one per block element. Lines of elements that are page furniture by
their tag, role or class (where that is ambiguous, by their links and short lines too) never count as text: menus, page headers and footers are lines of length 0,
and so are lines that are mostly links; sidebars, notices, adverts, forms and comments, which also
stand within articles, are left out of the count of lines. Over the lengths slide windows of BLOCK
lines; text surges where a window's sum reaches a threshold, and dives where a window is empty. A
stretch reaches from dive to dive, whether it surges early or late, and all text from the first stretch
that surges to the last one is kept, but for a closing copyright notice. Where the page marks its article
(article, or else main), that is a hint: if at least half of the text in stretches stands in it, or nothing
on the page surges, the text is what is marked, with its short lines; otherwise the mark counts for nothing.

Defined results: null or empty html gives an empty text. A page cut off anywhere is read as far as it
goes. Character references are decoded once; white space within a block becomes one space.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import prepare

BLOCK, SURGE, LINK_SHARE = 3, 80, 0.6
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?!svg(?=[\s/])(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+(?<=/)>)(script|style|noscript|template|textarea|iframe|svg|title|select)(?=[\s/>])(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z:_-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
FURNITURE_TAGS = set("nav header footer aside form button menu dialog head search".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words that articles have no use for, and words that also name parts of articles.
SURE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsored sidebar cookie cookies gdpr newsletter popup modal comments disqus breadcrumb breadcrumbs "
    "nav navbar navigation masthead toolbar pagination pager outbrain taboola".split()
)
FURNITURE_WORDS = SURE_WORDS | set(
    "banner promo promotion sponsor side widget related recommended recommendations share sharing social consent notice notices subscribe signup overlay comment reply replies "
    "respond responds discussion menu footer header skip login legal copyright disclaimer feedback teaser".split()
)
#: Furniture around an article; the rest also stands within one.
AROUND = set("nav header footer menu navbar navigation breadcrumb breadcrumbs masthead toolbar banner contentinfo menubar pagination pager legal copyright".split())
#: What an article may be one of, and the sections that hold them.
COMMENTS, THREADS = {"comment", "comments"}, {"comments", "disqus"}
EXEMPT = {"html", "body", "article", "main"}
#: A tag that opens closes an open element of these, up to the nearest of the limits.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: A closing notice of an unmarked page, and how long it is at most.
CLOSING = re.compile(r"©|(?:copyright:? *)?\(c\) *\d{4}\b|copyright:? *(?:©|\d{4}\b)|(?:copyright\b.*\b)?all rights reserved\W*\Z", re.I)
NOTICE = 120
#: Lines of so many characters, or with the end of a sentence, are no labels.
PROSE, SENTENCE = 40, re.compile(r"[.!?…][\"'”’»)]*\Z")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def _is_furniture(tag: str, raw: str, in_article: int) -> tuple[int, int]:
    """0 for text, 1 for furniture within articles, 2 for furniture around them; and the same for what is in doubt.

    Furniture is named by a sure word, or by a class of nothing but furniture words. Other classes and ids with such
    words leave a doubt, as they may name a part of the text: social-history, #discussion. The ids of headings are
    made from their texts, and those of sections often are, so they tell nothing and little."""
    if tag in FURNITURE_TAGS and not (tag == "header" and in_article):
        return 2 if tag in AROUND else 1, 0
    doubt = 0
    section = tag == "section" or "section" in raw and re.search(r"""class\s*=\s*["']?(?:[^"'>]*\s)?section["'\s]""", raw)
    for m in ATTRIBUTE.finditer(raw):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if name == "class" and (tag not in EXEMPT or tag == "article") or name == "id" and tag not in EXEMPT | HEADINGS:
            for token in value.split():
                words = set(re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", token).lower())) - ({"", "header"} if in_article else {""})  # as the tag
                if words.isdisjoint(FURNITURE_WORDS if tag != "article" else COMMENTS):
                    continue
                mine = 1 if AROUND.isdisjoint(words) else 2
                if name == "class" and words <= FURNITURE_WORDS or not words.isdisjoint(THREADS if section and name == "id" else SURE_WORDS):
                    return mine, 0
                doubt = max(doubt, mine)
        elif name == "role" and value.lower() in FURNITURE_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return 2 if value.lower() in AROUND else 1, 0
    return 0, doubt


class Line:
    __slots__ = ("text", "linked", "marked", "furniture", "heading", "doubt")

    def __init__(self, text, linked, marked, furniture, heading, doubt):
        self.text, self.linked, self.marked, self.furniture, self.heading, self.doubt = text, linked, marked, furniture, heading, doubt


class Doubt:
    """An element that may be furniture, and what is in it."""

    __slots__ = ("within", "mine", "least", "chars", "linked", "longest", "prose")

    def __init__(self, within, mine, marked):
        self.within, self.mine, self.least = within, mine, SURGE if mine == 2 and not marked else PROSE
        self.chars = self.linked = self.longest = 0
        self.prose = [False, False]

    def add(self, chars, linked, longest, heading, sentence):
        self.chars, self.linked, self.longest = self.chars + chars, self.linked + linked, max(self.longest, longest)
        self.prose = [self.prose[0] or heading, self.prose[1] or sentence]

    def is_text(self) -> bool:
        heading, sentence = self.prose
        return self.linked <= LINK_SHARE * self.chars and (heading or self.longest >= self.least or sentence and self.least == PROSE)


def settle(lines: list[Line], doubts: list[Doubt]) -> None:
    """Doubtful elements are text if most of it is not linked, and not all of it is short, without a heading or a
    sentence; those around articles, where none is marked, need a long line or a heading."""
    for x in lines:
        if x.doubt >= 0 and not x.furniture:
            doubts[x.doubt].add(len(x.text), x.linked, len(x.text), x.heading, bool(SENTENCE.search(x.text)))
    for d in reversed(doubts):  # those within others come after them
        if d.is_text():
            d.mine = 0
            if d.within >= 0:
                doubts[d.within].add(d.chars, d.linked, d.longest, *d.prose)
    for d in doubts:
        if d.within >= 0:
            d.mine = max(d.mine, doubts[d.within].mine)
    for x in lines:
        if x.doubt >= 0:
            x.furniture = max(x.furniture, doubts[x.doubt].mine)


def lines_of(page: str) -> list[Line]:
    """The page's blocks in order; empty ones are left out."""
    out: list[Line] = []
    stack: list[tuple[str, int, int, bool, int]] = []  # tag, furniture, marked (1 in main, 2 in an article), article header, innermost doubt
    doubts: list[Doubt] = []
    parts: list[str] = []
    linked, links = 0, 0
    furniture = marked = 0
    titled, doubt = False, -1

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                heading = any(s[0] in HEADINGS for s in stack)
                out.append(Line(text, linked, marked, furniture or int(titled and not heading), heading, doubt))
        linked = 0

    def pop_to(n: int):
        nonlocal furniture, marked, titled, links, doubt
        flush()
        del stack[n:]
        _, furniture, marked, titled, doubt = stack[-1] if stack else ("", 0, 0, False, -1)
        links = sum(s[0] == "a" for s in stack)

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            if "&" in piece:
                piece = _html.unescape(piece)
            parts.append(piece)
            if links:
                linked += len(piece)
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            if m[1]:
                parts.append(" ")
            continue
        closing, raw = m[2] or m[5], m[4] or m[7] or ""
        block = tag in BLOCKS
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if block or not any(s[0] in BLOCKS for s in stack[i:]):
                        if block:
                            pop_to(i)
                        else:
                            if stack[i][1] != (stack[i - 1][1] if i else 0):
                                flush()
                            del stack[i:]
                            _, furniture, marked, titled, doubt = stack[-1] if stack else ("", 0, 0, False, -1)
                            links = sum(s[0] == "a" for s in stack)
                    break
            if block:
                flush()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if block:
            flush()
            if any(s[0] == "p" for s in stack[-6:]):
                i = max(i for i, s in enumerate(stack) if s[0] == "p")
                if not any(s[0] in ("table", "td", "button", "object") for s in stack[i:]):
                    pop_to(i)
            if tag in CLOSES:
                shut, limits = CLOSES[tag]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in limits:
                        break
                    if stack[i][0] in shut:
                        pop_to(i)
                        break
        if tag in VOID or raw.endswith("/") and not block:
            continue
        mine, perhaps = _is_furniture(tag, raw, marked)
        if perhaps and block and not furniture:
            doubts.append(Doubt(doubt, perhaps, marked))
            doubt = len(doubts) - 1
        if mine > furniture:
            flush()
        furniture = max(furniture, mine)
        if not furniture:
            marked = max(marked, 2 if tag == "article" or 'itemprop="articleBody"' in raw else 1 if tag == "main" or 'role="main"' in raw else 0)
        titled = titled or tag == "header" and marked > 0
        links += tag == "a"
        stack.append((tag, furniture, marked, titled, doubt))
    if at < len(page):
        tail = page[at:]
        parts.append(_html.unescape(tail) if "&" in tail else tail)
    flush()
    settle(out, doubts)
    return out


def stretches(lengths: list[int], surge: int) -> list[tuple[int, int]]:
    """(first, past last) line of each run between dives, windows of BLOCK empty lines, in which a window surges."""
    full = [i for i, n in enumerate(lengths) if n]
    out, at = [], 0
    for k, i in enumerate(full):
        if k + 1 < len(full) and full[k + 1] - i <= BLOCK:
            continue
        first, last = full[at], i
        if any(sum(lengths[j : j + BLOCK]) >= surge for j in range(first, last + 1)):
            out.append((first, last + 1))
        at = k + 1
    return out


def hinted(lines: list[Line]) -> list[int] | None:
    """The lines of what the page marks as its article, or else as its main part, if at least half of the found
    text stands in it. Where nothing surges, what is marked counts as found."""
    counted = [0 if x.furniture or not x.marked and x.linked > LINK_SHARE * len(x.text) else len(x.text) for x in lines]
    surged = stretches(counted, SURGE)
    found = {i for a, b in surged for i in range(a, b)} if surged else {i for i, x in enumerate(lines) if x.marked}
    for level in (2, 1):
        own = [i for i, x in enumerate(lines) if x.marked >= level and counted[i]]
        if own and 2 * sum(counted[i] for i in own if i in found) >= sum(counted[i] for i in found):
            return own
    return None


def main_text(page: str | None) -> str:
    """The kept blocks, joined by empty lines."""
    lines = [x for x in lines_of(page or "") if x.furniture != 1]
    marked = hinted(lines)
    if marked is not None:
        return "\n\n".join(lines[i].text for i in marked)
    lengths = [0 if x.furniture or x.linked > LINK_SHARE * len(x.text) else len(x.text) for x in lines]
    kept = stretches(lengths, SURGE) or stretches(lengths, 1)
    inside = {i for a, b in kept for i in range(a, b)}
    first, last = (min(inside), max(inside)) if inside else (0, -1)
    # between the stretches lie empty lines, and text too short to surge
    body = [x.text for i, x in enumerate(lines[first : last + 1], first) if not x.furniture and (i in inside or lengths[i])]
    while body and len(body[-1]) <= NOTICE and CLOSING.match(body[-1]):
        body.pop()
    return "\n\n".join(body)


def extract(df: DataFrame, page: str = "html", out: str = "text", chars_out: str = "n_chars") -> DataFrame:
    """df without the page's column, with its main text and the text's code points."""
    prepare(df.sparkSession)
    at = df.columns.index(page)
    rest = [f for i, f in enumerate(df.schema.fields) if i != at]
    if {out, chars_out} & {f.name for f in rest}:
        raise ValueError(f"{out} or {chars_out} is already a column")

    def run(batches):
        for batch in batches:
            texts = [main_text(p) for p in batch.column(at).to_pylist()]
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*(f.name for f in rest), out, chars_out])

    return df.mapInArrow(run, T.StructType([*rest, T.StructField(out, T.StringType()), T.StructField(chars_out, T.LongType())]))


def pages_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    return extract(pages.select("page_id", "url", "html"))
