"""Main text of web pages by the distribution of text over lines.

Markup is stripped: comments, scripts, styles and the like go, and block-level
elements break lines. Elements that are no part of an article by their name or
role (menus, headers, footers, sidebars, forms) leave lines without weight, as
do menus, which are runs of ``MENU`` lines that are links alone, with a short
heading before them. Other lines weigh as many characters as they have.

Weights are summed over sliding windows of ``WINDOW`` lines. Text surges where
a window's sum leaves zero and dives where it is zero again. Empty lines stand
for the edges of containers: so many that text dives where a container of
several lines ends, but not between containers of one line each, nor inside an
article or main part, whose edges are always a dive. A surge is kept if its
highest window reaches ``SURGE`` characters and ``SHARE`` of the page's highest
one; if none reaches ``SURGE``, the highest is kept. Where an article or main
part holds ``TRUST`` of the page's weight, its surges are kept and no others.

Whole words of a class or id (advert, sidebar, comments) take an element's
weight as its name does, but only where what is left still surges: a name alone
can't empty a page.

A null or empty page, and one without such lines, has the empty string.
Repeated rows are extracted each; other columns are ignored. Each page is read
once from its beginning to its end, whatever its markup is like.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import slices

WINDOW, SURGE, SHARE, TRUST, MENU = 3, 80, 0.3, 0.3, 3
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile("[\"'>]")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
# Fixed names of HTML elements.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "object", "svg", "math", "canvas", "title", "select", "audio", "video", "xmp", "noframes", "head"}
OUTSIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol"
    " option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar"}
CONTAINERS = BLOCKS - set("p h1 h2 h3 h4 h5 h6 li option summary tr td th tbody thead tfoot caption hr pre dd dt legend html body figcaption address".split())
#: Words that, in a class or id, name what is no part of an article, with what may stand before or after them.
HINTS = (
    "ad ads advert advertisement adverts advertising adsense sponsor sponsored sponsors promo promotion promotions banner sidebar widget widgets menu navbar navigation breadcrumb breadcrumbs footer masthead"
    " topbar toolbar cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations"
    " comment comments commentlist disqus respond replies pagination pager copyright disclaimer"
).split()
AROUND = "top bottom left right main site page user reader list box bar block area section container wrapper wrap slot unit links buttons form posts post articles stories story items item media icons primary secondary global mobile header footer text content post".split()
HINT = re.compile(rf"(?:(?:{'|'.join(AROUND)})[-_])?(?:{'|'.join(HINTS)})(?:[-_](?:{'|'.join([*AROUND, *HINTS])}|\d+))?\Z")
#: What a class with a hint says of the page's layout or of an article.
LAYOUT = re.compile(r"(?:\A|[-_])(?:with|has|no|by|layout|article|entry|story)(?:[-_]|\Z)|[-_](?:content|text|post)\Z")


@dataclass
class Line:
    text: str
    inside: bool  # an article or main part
    hinted: bool  # in an element that its class or id alone speaks against
    linked: bool  # links alone
    box: int  # the container that holds it
    edges: int  # of containers, between it and the line before
    wall: bool  # an article's edge, or an element that was left out, lies before it


def hinted(value: str) -> bool:
    return any(HINT.match(w) and not LAYOUT.search(w) for w in value.split())


def _outside(name: str, attributes: str, in_article: bool) -> str:
    """Why an element is no part of an article: "name", "hint" or nothing."""
    if name in OUTSIDE and not (name == "header" and in_article):
        return "name"
    if not attributes or name in ("html", "body", "article", "main"):
        return ""
    found = ""
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key == "role" and value in ROLES or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "name"
        if key in ("class", "id") and hinted(value):
            found = "hint"
    return "name" if re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes) else found


def tokens(page: str) -> Iterator[tuple[str, str, bool, str, int]]:
    """kind (text or tag), name or text, whether it closes, attributes, end; in one pass.

    A quoted value may hold a >. Where a quote is never closed, this and all
    later tags end at their first >.
    """
    at, n, last, broken = 0, len(page), page.rfind(">"), False
    while at < n:
        begin = page.find("<", at)
        if begin < 0 or begin > last:
            yield "text", page[at:], False, "", n
            return
        if begin > at:
            yield "text", page[at:begin], False, "", begin
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = n if end < 0 else end + 3
            continue
        closes = page.startswith("/", begin + 1)
        name = NAME.match(page, begin + 1 + closes)
        if not name:
            if page[begin + 1 : begin + 2] in ("!", "?", "/"):
                at = page.find(">", begin) + 1
            else:
                yield "text", "<", False, "", begin + 1
                at = begin + 1
            continue
        place = name.end()
        while not broken:
            stop = STOP.search(page, place)
            if stop and stop.group() == ">":
                place = stop.start()
                break
            place = page.find(stop.group(), stop.end()) + 1 if stop else 0
            broken = place == 0
        if broken:
            place = page.find(">", name.end())
        yield "tag", name.group().lower(), closes, page[name.end() : place], place + 1
        at = place + 1


def lines_of(page: str) -> list[Line]:
    lines: list[Line] = []
    pieces: list[str] = []
    boxes, next_box = [0], 1  # open containers
    left_out: list[list] = []  # elements being left out: name, how many of it are open, why
    linked = edges = 0  # characters of this line inside links; edges of containers since the last line
    in_link = in_article = 0
    wall = False
    skip, resume, never_closed = "", 0, set()

    def end_line() -> None:
        nonlocal linked, edges, wall
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            lines.append(Line(text, in_article > 0, bool(left_out), linked > 0 and linked >= len(text.replace(" ", "")), boxes[-1], edges, wall))
            edges, wall = 0, False
        linked = 0

    for kind, name, closing, attributes, end in tokens(page):
        if end <= resume:
            continue
        dead = bool(left_out) and left_out[-1][2] == "name"
        if kind == "text":
            if not dead:
                text = html.unescape(name)
                pieces.append(text)
                if in_link:
                    linked += len("".join(text.split()))
            continue
        if not closing and name in RAW:
            # One that is never closed loses only its tag, and so does the head, whose parts are left out each.
            if not attributes.endswith("/") and name != "head" and name not in never_closed:
                closed = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.IGNORECASE).search(page, end)
                if closed:
                    resume = closed.end()
                else:
                    never_closed.add(name)
            continue
        if name in ("article", "main"):
            end_line()
            if not closing and left_out and left_out[-1][0] not in ("article", "main"):
                left_out.clear()  # what was left open can't hold the article
            if not left_out:
                in_article = in_article + 1 if not closing else max(0, in_article - 1)
            wall = True
        elif left_out:
            own = left_out[-1]
            if name == own[0]:
                own[1] += -1 if closing else name not in VOID
            elif own[0] in ("p", "li") and name in BLOCKS:
                own[1] = 0  # closed by what follows
            elif closing and any(x[0] == name for x in left_out):
                end_line()
                while left_out[-1][0] != name:
                    left_out.pop()
                left_out[-1][1] -= 1
                own = left_out[-1]
            if own[1] <= 0:
                end_line()
                left_out.pop()
                wall = True
                if closing:
                    continue
            elif own[2] == "name":
                continue
        if name in BLOCKS:
            end_line()
        elif name == "br":
            pieces.append(" ")
        if name in CONTAINERS:
            edges += 1
            if not closing:
                boxes.append(next_box)
                next_box += 1
            elif len(boxes) > 1:
                boxes.pop()
        if name == "a":
            in_link = 0 if closing else 1
        if not closing and name not in VOID and not attributes.endswith("/") and (why := _outside(name, attributes, in_article > 0)):
            end_line()
            left_out.append([name, 1, why])
            wall = True
    end_line()
    return lines


def weighed(lines: list[Line], hints: bool) -> list[int]:
    """Characters of each line; none in menus, nor, if ``hints`` count, where a hint speaks against it."""
    weights = [0 if hints and x.hinted else len(x.text) for x in lines]
    i = 0
    while i < len(lines):
        end = i
        while end < len(lines) and lines[end].linked and lines[end].hinted == lines[i].hinted:
            end += 1
        if end - i >= MENU:
            first = i - 1 if i and not lines[i - 1].linked and len(lines[i - 1].text) <= 40 and not re.search(r"[.!?:;]\Z", lines[i - 1].text) and lines[i - 1].inside == lines[i].inside else i
            weights[first:end] = [0] * (end - first)
        i = max(end, i + 1)
    return weights


def surges(lines: list[Line], weights: list[int]) -> list[tuple[int, list[int]]]:
    """Of each stretch of text between a surge and its dive: its highest window, and its lines with weight."""
    held: dict[int, int] = {}
    for x in lines:
        held[x.box] = held.get(x.box, 0) + 1
    series: list[tuple[int, int]] = []  # weight and line
    before = None
    for i, (x, w) in enumerate(zip(lines, weights, strict=True)):
        empty = 0
        if before is not None and x.edges:
            several = x.box != before.box and (held[x.box] > 1 or held[before.box] > 1) and x.edges > 1
            empty = 0 if x.inside and before.inside else WINDOW if several else min(x.edges, WINDOW - 1)
        if x.wall and not (x.inside and before is not None and before.inside):
            empty = WINDOW
        series += [(0, -1)] * empty
        series.append((w, i))
        before = x
    sums = [sum(w for w, _ in series[k : k + WINDOW]) for k in range(len(series))]
    found, k = [], 0
    while k < len(series):
        if not sums[k]:
            k += 1
            continue
        surge = k
        while k < len(series) and sums[k]:
            k += 1
        found.append((max(sums[surge:k]), [i for w, i in series[surge:k] if w]))
    return found


def main_text(page: str | None) -> str:
    """The text between surges and dives of one page, a line for each block."""
    lines = lines_of(page or "")
    weights = weighed(lines, hints=True)
    total = sum(weights)
    inside = sum(w for x, w in zip(lines, weights, strict=True) if x.inside)
    if inside and inside >= TRUST * total:
        weights = [w if x.inside else 0 for x, w in zip(lines, weights, strict=True)]
        found, least = surges(lines, weights), 0.0
    else:
        found = surges(lines, weights)
        if max((top for top, _ in found), default=0) < SURGE and any(x.hinted for x in lines):
            other = surges(lines, weighed(lines, hints=False))
            if max(top for top, _ in [(0, []), *other]) >= SURGE:
                found = other
        least = max(SURGE, SHARE * max((top for top, _ in found), default=0))
        if found and all(top < least for top, _ in found):
            found, least = [max(found, key=lambda x: x[0])], 0.0
    return "\n".join(lines[i].text for top, own in found if top >= least for i in own)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "html", 8_000_000):
        texts = [main_text(x) for x in part.column("html").to_pylist()]
        yield pa.RecordBatch.from_pydict({"page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(texts, pa.string())})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
