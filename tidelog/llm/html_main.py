"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags.  Words score by their context (the nearest block element
and whether they are in a link) and by the nearest mark around them, tags score negative.  A mark is
a tag, role, class or id name that tells against content (navigation, forms, comments, ...).
Weights are learned from labelled pages: pages whose markup names their content
(``article``, ``main``) say which words and tags are inside.  Those names are labels only; every
page is scored alike.  A linear scan finds the contiguous region of the greatest sum; its
blocks are the text, without words whose mark weighs ``DROPPED`` or less or was never seen.

A class or id name on an element with more than half of the page's words, and its ``h1`` if it has
one, is that of a wrapper and no mark; so is a form around the whole page.  Scripts, styles and hidden elements are not text.

Null html gives empty text and 0 characters, as does a page without words.  Unclosed and
misnested markup is read as far as it goes, in time in proportion to its length; an element ends with the one around it.  Repeated rows are
extracted alike, an empty table gives an empty result; other columns pass, but for those named like new ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import name, slices, with_text_columns

#: Element names by their part in a page.
RAW = {"script", "style", "template", "noscript", "iframe", "svg", "math", "object", "canvas", "textarea", "xmp", "noembed", "noframes"}
NEVER = RAW | {"head", "title", "nav", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "label", "fieldset", "input", "audio", "video", "map", "embed"}
CONTENT = {"article", "main"}
SECTIONS = CONTENT | {"section"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "tt", "u", "var", "time", "data", "ruby", "rt", "rp", "wbr", "br", "picture", "source"}
#: Elements whose tags do not score: a content element's name is a label, no evidence.
SILENT = INLINE | CONTENT
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that a new one of their kind ends: p by any block, li by li, and so on.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of class and id names of parts that are not content.
BOILERPLATE = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "byline-share", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr",
    "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "outbrain", "pagination", "pager", "popup", "promo", "promoted", "promotion", "recommended", "related", "replies", "respond", "rss", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored",
    "subscribe", "taboola", "toolbar", "topbar", "widget", "widgets",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}

#: Score of a word under a mark that no labelled page has, and what a mark weighs for its words to be passed over.
UNSEEN, DROPPED = -0.2, -1.0

_BEGIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=\s|/|$)", re.I)
_NAME = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_CLOSE = {t: re.compile(rf"</{t}\s*/?>", re.I) for t in RAW | {"title"}}


def mark_of(tag: str, attributes: str, sectioned: bool) -> str | None:
    """The name that tells against content, ``hidden``, or None."""
    mark = f"tag:{tag}" if tag in NEVER or tag == "header" and not sectioned else None
    if not attributes or tag in ("html", "body"):
        return mark
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return "hidden"
        if mark is None and key == "role" and value.lower() in ROLES:
            mark = f"role:{value.lower()}"
        if mark is None and key in ("class", "id"):
            mark = next((f"class:{w.lower()}" for w in _NAME.findall(_CAMEL.sub(r"\1 \2", value)) if w.lower() in BOILERPLATE), None)
    return mark


def tokens(html: str) -> Iterator[tuple[str | None, bool, str, int]]:
    """(tag, whether it closes, its attributes, where it ends) of each tag; (None, False, text, end) of text between.

    One pass: each character is looked at a bounded number of times, also where quotes or tags never end.  After a quote that
    never ends, tags end at the next ``>``, quoted or not; a tag without any is left out with all after it.
    The receiver may send a position to go on from."""
    at, n = 0, len(html)
    quoted = True  # whether quotes still come in pairs
    while at < n:
        if html[at] != "<":
            end = html.find("<", at)
            end = n if end < 0 else end
            at = (yield None, False, html[at:end], end) or end
            continue
        if html.startswith(("<!", "<?"), at):
            for begin, close in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")):
                if html.startswith(begin, at):
                    end = html.find(close, at + len(begin))
                    at = n if end < 0 else end + len(close)
                    break
            continue
        m = _BEGIN.match(html, at)
        if m is None:
            at = (yield None, False, "<", at + 1) or at + 1
            continue
        end = m.end()
        while quoted:
            end = _PLAIN.match(html, end).end()
            if end >= n or html[end] == ">":
                break
            after = html.find(html[end], end + 1)
            if after < 0:
                quoted = False
                break
            end = after + 1
        if not quoted:
            end = html.find(">", m.end())
        if end < 0 or end >= n:
            return
        at = (yield m[2].lower(), bool(m[1]), html[m.end() : end], end + 1) or end + 1


@dataclass
class Page:
    """kinds: for each event its token; words: how many (0: a tag); texts by event; block numbers; marks (or None).

    inside: whether a content element holds the event; None where a mark within that element does."""

    kinds: list[str] = field(default_factory=list)
    words: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)
    marks: list[str | None] = field(default_factory=list)
    inside: list[bool | None] = field(default_factory=list)
    labelled: bool = False


def parse(html: str) -> Page:
    """The events of a page outside of hidden elements, their marks, and which lie in a content element."""
    page = Page()
    # tag, hidden, content, marked element and context around, the nearest element up to here that is not inline, whether a link lies after it
    stack: list[tuple[str, bool, bool, int, str, int, bool]] = []
    opened: Counter = Counter()
    marked: list[list] = []  # name, marked element around, words, content elements around, whether it holds the h1
    owners: list[int] = []  # by event: its marked element
    hidden = content = links = block = sections = headings = 0
    nearest = -1
    context = "body"

    def pop() -> None:
        nonlocal hidden, content, links, context, block, nearest, sections
        tag, was_hidden, was_content, nearest, context, _, _ = stack.pop()
        opened[tag] -= 1
        hidden -= was_hidden
        content -= was_content
        links -= tag == "a"
        sections -= tag in SECTIONS
        if tag not in INLINE:
            block += 1

    def event(kind: str, words: int, text: str) -> None:
        page.kinds.append(kind)
        page.words.append(words)
        page.texts.append(text)
        page.blocks.append(block)
        page.inside.append(None if content and nearest >= 0 and marked[nearest][3] else content > 0)
        owners.append(nearest)

    parts = tokens(html)
    goto: int | None = None
    while True:
        try:
            tag, closes, text, at = parts.send(goto)
        except StopIteration:
            break
        goto = None
        if tag is None:
            if not hidden:
                text = unescape(text)
                if words := len(text.split()):
                    event(("link:" if links else "word:") + context, words, text)
                elif text:
                    event("", 0, " ")
            continue
        if closes:
            if opened[tag]:
                while stack[-1][0] != tag:
                    pop()
                if not hidden:
                    event(f"/{tag}" if tag not in SILENT else "", 0, "")
                pop()
            continue
        if tag not in INLINE:
            ends = ENDS.get(tag, set()) | ({"p"} if tag not in VOID or tag == "hr" else set())
            while stack and stack[-1][5] >= 0 and not stack[-1][6] and stack[stack[-1][5]][0] in ends:
                for _ in range(len(stack) - stack[-1][5]):
                    pop()
            block += 1
        if tag in RAW or tag == "title":
            end = _CLOSE[tag].search(html, at)
            goto = end.end() if end else len(html)
            continue
        if tag in VOID or text.endswith("/") and tag in INLINE:
            if not hidden:
                event(tag if tag not in INLINE else "", 0, " " if tag == "br" else "")
            continue
        mark = mark_of(tag, text, sections > 0)
        own = not hidden and mark is None and (tag in CONTENT or 'role="main"' in text)
        block_at, linked = (len(stack), False) if tag not in INLINE else (stack[-1][5], stack[-1][6] or tag == "a") if stack else (-1, False)
        stack.append((tag, mark == "hidden", own, nearest, context, block_at, linked))
        opened[tag] += 1
        hidden += mark == "hidden"
        content += own
        links += tag == "a"
        sections += tag in SECTIONS
        page.labelled |= own
        if mark is not None and not hidden:
            marked.append([mark, nearest, 0, content, False])
            nearest = len(marked) - 1
        if not hidden:
            event(tag if tag not in SILENT else "", 0, "")
        if tag == "h1" and not hidden:
            headings += 1
            around = nearest
            while around >= 0 and not marked[around][4]:
                marked[around][4] = True
                around = marked[around][1]
        if tag not in INLINE:
            context = tag
    for owner, words in zip(owners, page.words):
        if owner >= 0:
            marked[owner][2] += words
    for i in range(len(marked) - 1, -1, -1):  # a marked element comes after the one around it
        if marked[i][1] >= 0:
            marked[marked[i][1]][2] += marked[i][2]
    total = sum(page.words)
    names: list[str | None] = []
    for mark, around, words, _, heading in marked:
        wrapper = mark.startswith(("class:", "tag:form")) and 2 * words > total and (heading or not headings)
        names.append((names[around] if around >= 0 else None) if wrapper else mark)
    page.marks = [names[i] if i >= 0 else None for i in owners]
    return page


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and last+1 event of the greatest sum, by one linear scan; the longest of equals."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total < 0 or i == 0:
            total, start = 0.0, i
        total += s
        if total >= best and total > 0:
            best, region = total, (start, i + 1)
    return region


def scores_of(page: Page, weight: dict[str, float]) -> list[float]:
    out = []
    for kind, words, mark in zip(page.kinds, page.words, page.marks):
        if not kind:
            out.append(0.0)
        elif words:
            w = weight.get(kind, -0.5 if kind.startswith("link:") else 0.5)
            out.append((w if not mark else w + weight[mark] if mark in weight else UNSEEN) * words)
        else:  # under a mark the words tell, not the tags
            out.append(0.0 if mark else weight.get(kind, -0.2))
    return out


def main_text(html: str | None, weight: dict[str, float]) -> str:
    if not html:
        return ""
    page = parse(html)
    start, end = best_region(scores_of(page, weight))
    blocks: dict[int, list[str]] = {}
    for i in range(start, end):
        if page.texts[i] and (page.marks[i] is None or weight.get(page.marks[i], DROPPED) > DROPPED):
            blocks.setdefault(page.blocks[i], []).append(page.texts[i])
    lines = (" ".join("".join(b).split()) for b in blocks.values())
    return "\n".join(line for line in lines if line)


def learn(df: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weights from all labelled pages of ``df``: log-odds of each kind of word, at most 0 for tags and marks.

    Kinds are known element names, so there are a few hundred at most."""
    known = INLINE | NEVER | CONTENT | VOID | set(ENDS) | {"body", "html", "div", "p", "section", "ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "blockquote", "pre", "figure", "figcaption", "header", "address", "details", "summary", "center", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "caption"}

    def run(batches):
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for part in slices(batch):
                for html in part.column(0).to_pylist():
                    page = parse(html) if html else None
                    if page is None or not page.labelled:
                        continue
                    for kind, words, mark, inside in zip(page.kinds, page.words, page.marks, page.inside):
                        if inside is None:
                            continue
                        if mark and words:
                            counts.setdefault(mark, [0, 0])[inside] += words
                        tag = kind.rpartition(":")[2].lstrip("/")
                        if kind and not (mark and words):  # a marked word tells of its mark alone
                            own = counts.setdefault(kind if tag in known else kind.replace(tag, "other"), [0, 0])
                            own[inside] += max(words, 1)
        yield pa.RecordBatch.from_arrays([pa.array([*counts], pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], ["kind", "inside", "outside"])

    rows = df.select(name(html_col)).mapInArrow(run, "kind string, inside long, outside long").groupBy("kind").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).collect()
    total_in = sum(r.i for r in rows) + 1
    total_out = sum(r.o for r in rows) + 1
    prior = total_in / (total_in + total_out)  # a kind never seen has even odds
    marks = ("tag:", "role:", "class:")
    weight = {}
    for r in rows:
        raw = np.log((r.i + prior) / total_in) - np.log((r.o + 1 - prior) / total_out)
        odds = float(np.clip(raw, -2, 2))
        if r.kind.startswith(marks):
            weight[r.kind] = float(np.clip(raw, -4, 0))
        elif ":" in r.kind:  # words score positive in content; link words never do
            weight[r.kind] = min(odds, -0.2) if r.kind.startswith("link:") else (odds if r.o > r.i else max(odds, 0.2))
        else:
            weight[r.kind] = min(odds, 0.0) - 0.1
    return weight


def extract(df: DataFrame, html_col: str = "html", keep: list[str] | None = None, weight: dict[str, float] | None = None) -> DataFrame:
    """Adds text and n_chars (code points).  Weights are learned from ``df`` unless given."""
    shared = df.sparkSession.sparkContext.broadcast(learn(df, html_col) if weight is None else weight)

    def make():
        def run(pages):
            texts = [main_text(p, shared.value) for p in pages]
            return texts, [len(t) for t in texts]

        return run

    return with_text_columns(df, html_col, make, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], keep)
