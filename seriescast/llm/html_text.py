"""Operator 13, HTML extraction: two-pass block rules over the blocks of a page.

A page is cut into blocks (text between block-level tags).  The first pass judges
each block by itself: link density, length and stop-word density make it good,
nearly good, ambiguous or bad; blocks inside a navigation, header, footer,
sidebar, advert, notice, form or comment element are bad whatever they say.  The
second pass lets what is not decided inherit from the nearest decided blocks before and
after it; a heading looks ahead.  An ``article`` (or, without one, ``main``)
element counts as a decided good neighbour at both of its ends, and where one holds
text, blocks outside of it are bad.  A page's own ends count as bad neighbours; on a page
of ambiguous blocks alone those without links are kept.

One pass over the rows without a shuffle; a page is read in time linear in its length.

Defined cases: null, empty or tag-only html gives an empty text and 0 characters;
unclosed elements have no effect on what follows, unclosed scripts and comments end at
their own tag; bytes that are not UTF-8 become U+FFFD; repeated rows and null
ids stay as they are, one row each; an empty table gives an empty result; columns
besides id, url and html are neither read nor returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriescast.llm.text import pieces

SHORT, LONG = 70, 200                # characters below which length tells nothing, above which it is enough
FEW_STOPS, MANY_STOPS = 0.15, 0.30   # share of stop words of nearly good and of good blocks
MOST_LINKS = 0.5                     # share of characters inside links

# Function words of four languages.
STOP = {
    "en": "the of and to in is that it for on with was by are be at from or an as this have not but they his her you".split(),
    "fr": "le la les de des du et que qui dans en un une est pour sur pas plus par au ce il elle ne se sont avec".split(),
    "de": "der die das und in den von zu mit sich ist im nicht ein eine als auch es an auf für dem des er sie".split(),
    "es": "de la que el en y los del se las por un para con no una su al es lo como más pero sus".split(),
}
# Elements that end a block, whose content is no text, and that frame a page.
BLOCKS = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option
p pre section summary table tbody td tfoot th thead title tr ul""".split())
OPAQUE = "script style noscript template textarea iframe svg math object select button canvas audio video title".split()
FRAMES = set("nav header footer aside form menu dialog".split())
ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
#: Words of class names and ids that name something other than the article.
HINTS = set("""ad ads advert advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar
navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice popup modal newsletter
subscribe subscription signup login share sharing social related recommended recommendations comment comments
disqus respond replies widget toolbar pagination pager skip copyright""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
TRACKED = BLOCKS - VOID - set("p li dd dt option optgroup tr td th thead tbody tfoot h1 h2 h3 h4 h5 h6 html body".split())

_SKIP = re.compile(r"<!--|<(" + "|".join(OPAQUE) + r")(?=[\s/>])", re.I)
_TAG = re.compile(
    r"<(/?)([a-zA-Z][^\s/<>\"']*)((?:[^<>\"']++|\"[^\"<]*\"|'[^'<]*')*+>|[^<>]*>?)|<[!?/][^<>]*>?")
_ATTR = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"[^\W\d_]+")


class Block(NamedTuple):
    text: str
    links: int        # characters inside links
    heading: bool
    framed: bool      # inside a navigation, footer, advert ... element
    inside: int       # number of the article or main element around it, -1 for none


def visible(html: str) -> str:
    """The page without comments and without elements whose content is no text."""
    out, at, none_after = [], 0, set()
    low = html.lower()
    if len(low) != len(html):  # a few letters change length; offsets must agree
        low = html
    for m in iter(lambda: _SKIP.search(html, at), None):
        out.append(html[at: m.start()])
        if m[1] is None:
            end = -1 if "--" in none_after else html.find("-->", m.end())
            at = end + 3 if end >= 0 else m.end()
            if end < 0:
                none_after.add("--")
                out.append("<!")  # an unclosed comment is a bogus tag
            continue
        name = m[1].lower()
        end = -1 if name in none_after else low.find(f"</{name}", m.end())
        if end < 0:
            none_after.add(name)
            out.append(html[m.start(): m.end()])
            at = m.end()
        else:
            out.append(" <hr>" if name in BLOCKS else " ")
            at = end
    out.append(html[at:])
    return "".join(out)


def _names_other(attrs: str, tag: str) -> bool:
    """Class names, id, role or style say that the element is not part of the article."""
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), a or b or c
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "style":
            if "display:none" in value.replace(" ", "").lower():
                return True
        elif key == "role":
            if value.lower() in ROLES:
                return True
        elif key in ("class", "id"):
            for name in value.split():
                parts = [x.lower() for x in _NAME.findall(name)]
                if parts and parts[0] not in ("has", "with", "no") and not HINTS.isdisjoint(parts):
                    return True
    return False


def _extents(tags: list[re.Match]) -> tuple[dict[int, int], set[int]]:
    """Closing tag number of every closed container, and the containers that frame the page."""
    close: dict[int, int] = {}
    framing: set[int] = set()
    open_: dict[str, list[int]] = {}
    stack: list[tuple[str, int]] = []
    for i, m in enumerate(tags):
        name = (m[2] or "").lower()
        if name not in TRACKED:
            continue
        if not m[1]:
            stack.append((name, i))
            open_.setdefault(name, []).append(i)
            if name in FRAMES or _names_other(m[3], name):
                framing.add(i)
        elif open_.get(name):
            start = open_[name].pop()
            close[start] = i
            while stack:  # what was opened inside and not closed ends nowhere
                n, k = stack.pop()
                if k == start:
                    break
                open_[n].pop()
    return close, framing


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in order, white space folded and references decoded."""
    html = visible(html)
    tags = list(_TAG.finditer(html))
    close, framing = _extents(tags)
    main = "article" if any((m[2] or "").lower() == "article" and i in close and i not in framing
                            for i, m in enumerate(tags)) else "main"
    ends: dict[int, list[tuple[str, int]]] = {}
    out: list[Block] = []
    text: list[str] = []
    links = frames = anchors = breaks = 0
    heading = False
    inside: list[int] = []

    def flush() -> None:
        nonlocal links, heading
        t = " ".join("".join(text).split())
        if t:
            out.append(Block(t, min(links, len(t)), heading, frames > 0, inside[-1] if inside else -1))
        text.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links, breaks
        if raw:
            raw = unescape(raw) if "&" in raw else raw
            text.append(raw)
            if not raw.isspace():
                breaks = 0
                if anchors:
                    links += len(" ".join(raw.split()))

    at = 0
    for i, m in enumerate(tags):
        add(html[at: m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if name == "br":
            breaks += 1
            text.append(" ")
            if breaks > 1:
                flush()
        elif name == "a":
            anchors = 0 if m[1] else 1
        elif name in BLOCKS:
            flush()
            breaks = anchors = 0
            heading = not m[1] and len(name) == 2 and name[0] == "h" and name != "hr"
        for kind, start in ends.pop(i, ()):
            if kind == "frame":
                frames -= 1
            elif start in inside:
                inside.remove(start)
        if i in close:
            if i in framing and not (name == "header" and inside and not _names_other(m[3], name)):
                frames += 1
                ends.setdefault(close[i], []).append(("frame", i))
            elif name == main:
                inside.append(i)
                ends.setdefault(close[i], []).append(("main", i))
    add(html[at:])
    flush()
    return out


_STOPS = [frozenset(x) for x in STOP.values()]


def stop_density(text: str) -> float:
    """Share of stop words, of the language that has most of them."""
    ws = _WORD.findall(text.lower())
    return max(sum(map(s.__contains__, ws)) for s in _STOPS) / len(ws) if ws else 0.0


def first_pass(b: Block) -> str:
    """``good``, ``near`` (nearly good), ``short`` (ambiguous) or ``bad``, from the block alone."""
    n = len(b.text)
    if b.framed or b.links > MOST_LINKS * n or (b.inside < 0 and n < LONG and "©" in b.text):
        return "bad"
    if n < SHORT:
        return "short"
    stops = stop_density(b.text)
    if stops >= MANY_STOPS and n > LONG:
        return "good"
    if stops >= FEW_STOPS:
        return "near"
    return "short" if b.inside >= 0 else "bad"


def second_pass(page: list[Block], first: list[str]) -> list[bool]:
    """True for the blocks of the main text."""
    n = len(page)
    if not {"good", "near", "bad"} & set(first):
        return [b.links == 0 for b in page]
    if any(b.inside >= 0 and f != "bad" for b, f in zip(page, first)):
        first = [f if b.inside >= 0 else "bad" for b, f in zip(page, first)]

    def decided(labels: list[str], order: range) -> list[tuple[str, int]]:
        """For each block the nearest decided block before it in ``order``: label and distance."""
        out, last, seen, inside = [("bad", n + 1)] * n, "bad", None, -1
        for i in order:
            if page[i].inside != inside:  # an end of the article is a good neighbour
                inside, seen = page[i].inside, (i - order.step)
                last = "good" if inside >= 0 else "bad"
            out[i] = (last, abs(i - seen) if seen is not None else n + 1)
            if labels[i] in ("good", "bad") and not (page[i].framed and inside >= 0):
                last, seen = labels[i], i  # an advert inside the article tells nothing of its neighbours
        return out

    before, after = decided(first, range(n)), decided(first, range(n - 1, -1, -1))
    labels = [("good" if "good" in (p[0], q[0]) else "bad") if f == "near" else f
              for f, p, q in zip(first, before, after)]
    before, after = decided(labels, range(n)), decided(labels, range(n - 1, -1, -1))
    keep = []
    for b, f, p, q in zip(page, labels, before, after):
        if f != "short":
            keep.append(f == "good")
        elif p[0] == q[0]:
            keep.append(p[0] == "good")
        elif b.heading:
            keep.append(q[0] == "good")
        else:
            keep.append(min(p, q, key=lambda x: (x[1], x[0] == "good"))[0] == "good")
    return keep


def main_text(html: str) -> str:
    page = blocks(html)
    keep = second_pass(page, [first_pass(b) for b in page])
    return "\n".join(b.text for b, k in zip(page, keep) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    read = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                texts = [main_text(v.as_py().decode("utf-8", "replace")) for v in piece["raw"]]
                yield pa.RecordBatch.from_arrays(
                    [piece["page_id"], piece["url"], pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = {c: pages.schema[o].dataType.simpleString() for c, o in (("page_id", id_col), ("url", url_col))}
    return read.mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
