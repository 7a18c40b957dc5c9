"""HTML main-text extraction by line-block distribution.

A page becomes a sequence of lines (one per block-level element or <br>), each
weighing its text's length; a line that is mostly links weighs nothing, one in a
declared <article> or <main> several times as much, and lines that markup gives to
boilerplate (nav, footer, class="ad", ...) are no lines at all.  Lengths are summed
over sliding windows of lines, which do not reach over the edge of an element that
holds lines: where the sum surges over a threshold a region of text begins, where it
dives to nothing (or the element ends) the region ends.  A page that never reaches
the threshold surges at its own peak.

The regions locate the article: its element is the innermost one that holds MOST of
the text between surges and dives.  Everything in it is kept, short lines too, but
for lists of links.  If that is only the page's body, whatever lies between the first
surge and the last dive is kept, and of the rest the paragraphs and headings that
stand directly in the body.

Defined results: null or empty html gives the empty text; a page without any
text line, or of links only, gives the empty text; unclosed elements, quotes and
comments end with the page; a very long page costs time in proportion to its length,
whatever its nesting; regions of equal weight are all kept; rows are independent, so
repeated rows give repeated results; further columns of the table are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import only, table

#: Elements by their role in HTML.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math object canvas select datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
BOILERPLATE = frozenset("head nav footer aside form menu dialog button fieldset label".split())
#: Words of class, id or role that name boilerplate.
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner sidebar side sidenav nav navbar navigation "
    "menu menubar breadcrumb breadcrumbs footer header masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "comment comments commentlist disqus respond reply replies related recommended recommendations share sharing social newsletter subscribe subscription signup "
    "login form search pagination pager widget widgets hidden contentinfo complementary search banner alertdialog dialog toc skip legal copyright".split()
)
MAIN_WORDS = frozenset("main article articlebody".split())
#: Regions whose own <article> elements are not the page's article.
DEEP = frozenset("comment comments commentlist disqus respond replies related recommended recommendations sidebar complementary".split())

#: Elements that hold lines rather than being one: no window of lines reaches over their edges.
BOXES = frozenset("article aside blockquote body center dd details dialog div dl fieldset figure footer form header html main menu nav ol section table tbody td tfoot th thead tr ul".split())
#: Elements that are lines of running text.
PROSE = frozenset("blockquote dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre".split())

WINDOW = 3
SURGE = 86
#: How many times a line counts in an <article> or <main> that the page declares.
DECLARED = 4.0
#: Share of the text between surges and dives that the article's element holds.
MOST = 0.9

_TAG_END = re.compile(r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>""")
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPLIT = re.compile(r"[^a-z]+")


def _roles(attrs: str) -> tuple[set[str], bool]:
    """Words of class, id, role and itemprop; whether the element is hidden."""
    words: set[str] = set()
    hidden = False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c)
        if name in ("class", "id", "role", "itemprop"):
            words.update(_SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()))
            if value.lower() == "articlebody":
                words.add("articlebody")
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            hidden = True
    words.discard("")
    return words, hidden


class Line:
    """A line of text: where it stands, and how much of it lies in links."""

    __slots__ = ("box", "linked", "main", "prose", "run", "size", "text")

    def __init__(self, text: str, box: int, run: int, main: bool, linked: float, prose: bool):
        self.text, self.box, self.run, self.main, self.linked, self.prose = text, box, run, main, linked, prose
        self.size = len(text)


class Page:
    """The lines of a page that boilerplate markup does not own, and the tree of the boxes that hold them.

    One pass over the markup; each open element is found by its name's own list of
    places, so that neither deep nesting nor stray closing tags are ever scanned for.
    """

    def __init__(self, html: str):
        self.lines: list[Line] = []
        self.parent, self.top = [0], [True]  # of each box; top: html and body, which hold whatever a page has
        self._stack: list[tuple[str, str, int]] = []  # (element, role, box)
        self._places: dict[str, list[int]] = {}
        self._blocks: list[int] = []
        self._skips: list[int] = []
        self._open = {"skip": 0, "deep": 0, "main": 0, "link": 0}
        self._held: list[str] = []
        self._total = self._linked = self._run = 0
        self._prose = False
        self._read(html)
        self._end_line()

    def _box(self) -> int:
        return self._stack[-1][2] if self._stack else 0

    def _text(self, raw: str) -> None:
        if raw and not self._open["skip"]:
            self._held.append(raw)
            size = len(raw.strip())
            self._total += size
            if self._open["link"]:
                self._linked += size

    def _end_line(self) -> None:
        if self._held:
            joined = "".join(self._held)
            line = " ".join((unescape(joined) if "&" in joined else joined).split())
            if line:
                self.lines.append(Line(line, self._box(), self._run, self._open["main"] > 0, self._linked / self._total if self._total else 0.0, self._prose))
            self._held.clear()
        self._total = self._linked = 0

    def _count(self, role: str, by: int) -> None:
        if role:
            self._open[role] += by
            if role == "deep":
                self._open["skip"] += by

    def _push(self, name: str, role: str) -> None:
        box = self._box()
        if name in BOXES:
            self.parent.append(box)
            self.top.append(name in ("html", "body"))
            box = len(self.parent) - 1
            self._run += 1
        at = len(self._stack)
        self._stack.append((name, role, box))
        self._places.setdefault(name, []).append(at)
        if name in BLOCK:
            self._blocks.append(at)
        if role in ("skip", "deep"):
            self._skips.append(at)
        self._count(role, 1)
        self._prose = name in PROSE or (self._prose and name not in BLOCK)

    def _close(self, index: int) -> None:
        while len(self._stack) > index:
            name, role, _ = self._stack.pop()
            self._places[name].pop()
            if name in BLOCK:
                self._blocks.pop()
            if role in ("skip", "deep"):
                self._skips.pop()
            self._count(role, -1)
            if name in BOXES:
                self._run += 1
        self._prose = bool(self._blocks) and self._stack[self._blocks[-1]][0] in PROSE

    def _role(self, name: str, attrs: str) -> str:
        words, hidden = _roles(attrs) if attrs.strip(" /") else (set(), False)
        if name == "article" and words & DEEP:
            return "deep"
        if name == "body" or (name == "article" and not words & BOILER_WORDS) or name == "main":
            if self._open["skip"] and not self._open["deep"]:  # a region that was never closed does not swallow the page
                self._close(self._skips[0])
            return "" if name == "body" else "main"
        if words & DEEP and name != "html":
            return "deep"
        if hidden or name in BOILERPLATE or (name == "header" and not self._open["main"]) or (words & BOILER_WORDS and not words & MAIN_WORDS and name != "html"):
            return "skip"
        if words & MAIN_WORDS:
            return "main"
        return "link" if name == "a" else ""

    def _read(self, html: str) -> None:
        at, n, quotes, unclosed = 0, len(html), True, set()
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                self._text(html[at:])
                return
            if lt > at:
                self._text(html[at:lt])
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            named = _NAME.match(html, lt + 1)
            if not named:
                if html[lt + 1 : lt + 2] in ("!", "?", "/"):
                    end = html.find(">", lt)
                    at = n if end < 0 else end + 1
                else:
                    self._text("<")
                    at = lt + 1
                continue
            name = named.group().lower()
            end = _TAG_END.match(html, named.end()) if quotes else None
            if end:
                stop = end.end()
            else:
                quotes = False  # an unclosed quote: from here on tags end at the next ">", which keeps the scan linear
                stop = html.find(">", named.end()) + 1 or n
            attrs = html[named.end() : stop - 1]
            at = stop
            if name[0] == "/":
                self._end_tag(name[1:])
            elif name in RAW:
                if not attrs.endswith("/") and name not in unclosed:
                    closing = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
                    if closing:
                        gt = html.find(">", closing.end())
                        at = n if gt < 0 else gt + 1
                    elif name in ("script", "style", "textarea", "title", "template", "xmp"):
                        at = n
                    else:
                        unclosed.add(name)  # none is left further on either
            else:
                self._start_tag(name, attrs)

    def _end_tag(self, name: str) -> None:
        block = name in BLOCK
        if block:
            self._end_line()
        places = self._places.get(name)
        if places and (block or not self._blocks or self._blocks[-1] < places[-1]):
            self._close(places[-1])

    def _start_tag(self, name: str, attrs: str) -> None:
        block = name in BLOCK
        if block:
            self._end_line()
            if name != "br" and self._blocks and self._stack[self._blocks[-1]][0] == "p":
                self._close(self._blocks[-1])
        if name in VOID:
            if name in ("img", "input"):
                self._text(" ")
            return
        role = self._role(name, attrs)
        if block or (role and not attrs.endswith("/")):
            self._push(name, role)


def line_blocks(weights: list[float], window: int = WINDOW, surge: float = SURGE) -> list[tuple[int, int]]:
    """Regions [first, last] between a surge and a dive of the windowed sums of weights."""
    n = len(weights)
    sums = _sums(weights, window)
    out, k = [], 0
    while k < n:
        if sums[k] >= surge and weights[k] > 0:
            first = k
            while k < n and sums[k] > 0:
                k += 1
            out.append((first, min(k, n) - 1))
        else:
            k += 1
    return out


def _sums(weights: list[float], window: int) -> list[float]:
    """Of each line, the weights from it on over a window of lines."""
    n, run = len(weights), 0.0
    sums = [0.0] * n
    for k in range(n - 1, -1, -1):
        run += weights[k] - (weights[k + window] if k + window < n else 0.0)
        sums[k] = run if run > 1e-9 else 0.0
    return sums


def core_lines(page: Page, window: int = WINDOW, surge: float = SURGE) -> list[float]:
    """The weight of each line that lies between a surge and a dive of its run, 0 of the others."""
    weights = [0.0 if x.linked > 0.5 else float(x.size) * (DECLARED if x.main else 1.0) for x in page.lines]
    runs: list[tuple[int, int]] = []
    for k, x in enumerate(page.lines):
        if runs and page.lines[runs[-1][0]].run == x.run:
            runs[-1] = (runs[-1][0], k + 1)
        else:
            runs.append((k, k + 1))
    peak = max((max(_sums(weights[a:b], window)) for a, b in runs), default=0.0)
    least = min(float(surge), peak)  # a page shorter than the threshold is its own peak
    core = [0.0] * len(weights)
    if peak:
        for a, b in runs:
            for first, last in line_blocks(weights[a:b], window, least):
                core[a + first : a + last + 1] = weights[a + first : a + last + 1]
    return core


def main_text(html: str | None, window: int = WINDOW, surge: float = SURGE) -> str:
    """The article's text; see the module's rules."""
    if not html:
        return ""
    page = Page(html)
    core = core_lines(page, window, surge)
    whole = sum(core)
    if not whole:
        return ""
    boxes, lines = len(page.parent), page.lines
    mass, inside = [0.0] * boxes, [False] * boxes
    size, linked, dense = [0] * boxes, [0.0] * boxes, [False] * boxes
    for x, w in zip(lines, core, strict=True):
        mass[x.box] += w
        dense[x.box] |= w > 0
        size[x.box] += x.size
        linked[x.box] += x.linked * x.size
    for b in range(boxes - 1, 0, -1):  # a box comes after the one that holds it
        mass[page.parent[b]] += mass[b]
    host = max(b for b in range(boxes) if mass[b] >= MOST * whole)  # such boxes are nested, for MOST is over a half
    for b in range(host, boxes):
        inside[b] = b == host or (b > 0 and inside[page.parent[b]])
    at = [k for k, x in enumerate(lines) if core[k] and inside[x.box]]
    first, last, loose = at[0], at[-1], page.top[host]
    kept = []
    for k, x in enumerate(lines):
        if not inside[x.box]:
            continue
        if x.box != host and not dense[x.box] and linked[x.box] > 0.5 * size[x.box]:
            continue  # a list of links
        if first <= k <= last or not loose or (x.box == host and x.prose and x.linked <= 0.5):
            kept.append(x.text)
    return " ".join(kept)


def extract(pages: DataFrame, window: int = WINDOW, surge: float = SURGE) -> DataFrame:
    """page_id, url, text, n_chars of every page; one pass, no shuffle."""

    def run(batches):
        for batch in batches:
            texts = [main_text(h, window, surge) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    slim = only(pages, "page_id", "url", "html")
    kinds = dict(slim.dtypes)
    return slim.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
