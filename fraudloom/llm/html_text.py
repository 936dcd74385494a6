"""HTML main text (operator 10).

The standard library's parser streams events; each block of text is a line
with a text-to-tag ratio. Ratios are smoothed with a Gaussian and clustered by
a threshold: lines at or over the mean less one deviation are content. Where
articles or main hold most of the content they are the main text. Else the
containers are descended as long as one child leaves no content outside it
(content lines, headings, paragraphs), and lines of few characters a tag
before the first and after the last content line are left out, as are
containers of links alone.

Elements that never hold the article (menus, footers, scripts and so on) are
skipped. Names (class, id) only decide about containers of a known kind:
one whose name says nothing else ("comments", "cookie-notice") is left out
unless it wraps every article of the page; one that says more
("share-prices") only if its text looks like a menu. Forms are left out
unless they wrap the page's content.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
SKIP = frozenset("script style template noscript head title nav footer aside button select option textarea iframe object svg math canvas audio video dialog menu search label legend input".split())
CONTAINER = frozenset("article main section div td body html blockquote center form".split())
NAMEABLE = frozenset("aside div dl fieldset figure form header ol section table td ul".split())
HEADING, PROSE = ("h1", "h2", "h3", "h4", "h5", "h6"), ("p", "blockquote", "pre")
CLOSES_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr title legend summary dt dd".split())
# Words in class and id that name boilerplate, the first ones also beside other words; words that add nothing, parts of an article (whose header isn't boilerplate), and words that turn a name round.
FIRM = frozenset("ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist cookie cookies disqus footer gdpr nav navbar navigation newsletter pagination sidebar".split())
NAMES = FIRM | frozenset("alert alerts aside banner consent copyright disclaimer legal login menu modal notice notices overlay pager popup promo promotion recommendations recommended related replies reply respond responses share sharing signup skip social sponsor sponsored sponsors subscribe toolbar widget widgets".split())
HEADER_NAMES = frozenset("header masthead".split())
PLAIN = frozenset("a area bar block bottom box btn button buttons container fixed float form global group holder icons inner item items left links list main message module new news outer panel posts primary reader readers right row section site slot small space stories sub text thread title top unit user wrap wrapper".split())
OWNERS = frozenset("article body content entry page post story".split())
TURNS = frozenset("has layout no with without".split())
BOILER_ROLE = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar".split())
SPACE = re.compile(r"\s+")
_CUT = re.compile(r"<[!/?a-zA-Z][^<>]*\Z")  # a tag that the page's end cuts off
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SIGMA, SHARE, DEPTH = 1.0, 0.6, 128
LOW = 10  # characters a tag; menus have fewer


@lru_cache(maxsize=10_000)
def named(value: str, header: bool = True, container: bool = True) -> str:
    """What a class or id says: "strong" if a word of it names boilerplate and nothing else, "weak" if it says more, else "".

    header: whether header names count, which they don't inside an article.
    container: whether the FIRM names of a container are strong whatever else is said.
    """
    found = ""
    known = NAMES | HEADER_NAMES if header else NAMES
    for word in value.split():
        parts = [x.lower() for x in _PARTS.findall(word)]
        hit = [x for x in parts if x in known]
        if not hit:
            continue
        rest = [x for x in parts if x not in known and x not in PLAIN]
        if any(x in TURNS for x in rest) or (OWNERS.intersection(rest) and HEADER_NAMES.issuperset(hit)):
            continue
        if OWNERS.issuperset(rest) or (container and FIRM.intersection(hit)):
            return "strong"
        found = "weak"
    return found


@dataclass
class Line:
    text: str
    tags: int
    path: tuple[int, ...] = ()  # its containers
    kind: str = ""  # "1" to "6" in a heading, "p" in a paragraph, quote or listing, "l" if mostly links, else ""
    groups: tuple[int, ...] = ()  # named containers and forms it is in
    whole: bool = False  # inside article or main


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool, bool]] = []  # tag, skipped from here, container, group
        self.open: Counter[str] = Counter()
        self.path: tuple[int, ...] = ()  # containers beyond DEPTH levels count as their ancestor
        self.n = 0
        self.skip = 0
        self.text: list[str] = []
        self.linked = 0
        self.tags = 0
        self.lines: list[Line] = []
        self.groups: tuple[int, ...] = ()
        self.kinds: list[str] = []  # of each group: "strong", "weak" or "form"
        self.holds: list[int] = []  # articles and mains inside each group
        self.wholes = 0

    def flush(self) -> None:
        if self.text:
            t = SPACE.sub(" ", "".join(self.text)).strip()
            if t:
                level = next((x[1] for x in HEADING if self.open[x]), "")
                kind = level or ("l" if 2 * self.linked >= len(t) else "p" if any(self.open[x] for x in PROSE) else "")
                self.lines.append(Line(t, self.tags, self.path, kind, self.groups, bool(self.open["article"] or self.open["main"])))
                self.tags = 0
            self.text, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            elif tag == "hr":
                self.flush()
            return
        if tag in BLOCK:
            self.flush()
            if tag in CLOSES_P and self.open["p"]:
                self._close("p")
            elif tag == "li" and self._open_above("li", ("ul", "ol", "menu", "dir")):
                self._close("li")
            elif tag in ("td", "th") and (o := self._open_above("td", ("table",)) or self._open_above("th", ("table",))):
                self._close(o)
            elif tag == "tr" and self._open_above("tr", ("table",)):
                self._close("tr")
            elif tag in ("dt", "dd") and (o := self._open_above("dt", ("dl",)) or self._open_above("dd", ("dl",))):
                self._close(o)
        inside = self.open["article"] or self.open["main"]
        name = ""
        skipped = tag in SKIP or (tag == "header" and not inside)
        if tag not in ("html", "body", "main"):
            for k, v in attrs:
                if k in ("class", "id") and v and name != "strong":
                    name = named(v, not inside, tag in NAMEABLE) or name
                elif (k == "role" and v and v.lower() in BOILER_ROLE) or k == "hidden" or (k == "aria-hidden" and v == "true"):
                    skipped = True
        if skipped:
            if not self.skip:
                self.flush()
            self.skip += 1
        kind = "strong" if name == "strong" else "form" if tag == "form" else "weak" if name and tag in NAMEABLE else ""
        if kind:
            self.flush()
            self.groups = (*self.groups, len(self.kinds))
            self.kinds.append(kind)
            self.holds.append(0)
        elif tag in ("article", "main"):
            self.wholes += 1
            for g in self.groups:
                self.holds[g] += 1
        held = tag in CONTAINER and len(self.path) < DEPTH
        if held:
            self.n += 1
            self.path = (*self.path, self.n)
        self.stack.append((tag, skipped, held, bool(kind)))
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # HTML ignores the slash

    def _open_above(self, tag: str, stop: tuple) -> str | None:
        if not self.open[tag]:
            return None
        for t, *_ in reversed(self.stack):
            if t == tag:
                return tag
            if t in stop:
                return None
        return None

    def _close(self, tag: str) -> None:
        self.flush()
        while self.stack:
            t, skipped, held, group = self.stack.pop()
            self.open[t] -= 1
            self.skip -= skipped
            if group:
                self.groups = self.groups[:-1]
            if held:
                self.path = self.path[:-1]
            if t == tag:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if not self.open[tag]:
            return
        if tag in BLOCK or tag in SKIP:
            self._close(tag)
            return
        for k in range(len(self.stack) - 1, -1, -1):  # an inline element ends alone, blocks opened inside it stay
            if self.stack[k][0] == tag:
                if self.stack[k][3]:  # the line so far belongs to the named element
                    self.flush()
                    self.groups = self.groups[:-1]
                _, skipped, _, _ = self.stack.pop(k)
                self.open[tag] -= 1
                self.skip -= skipped
                return
            if self.stack[k][0] in BLOCK:
                return

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.text.append(data)
            if self.open["a"]:
                self.linked += len(data.strip())


def ratios(lines: list[Line]) -> list[float]:
    """Code points of text for each tag of the line (one at least)."""
    return [len(x.text) / max(1, x.tags) for x in lines]


def smooth(x: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing, the kernel cut at 3 sigma and renormalised at the ends."""
    r = math.ceil(3 * sigma)
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-r, r + 1)]
    out = []
    for i in range(len(x)):
        a, b = max(0, i - r), min(len(x), i + r + 1)
        w = kernel[a - i + r : b - i + r]
        out.append(sum(p * q for p, q in zip(w, x[a:b])) / sum(w))
    return out


def left_in(p: _Blocks) -> list[Line]:
    """The lines without those of boilerplate containers and forms."""
    wraps = lambda g: p.wholes > 0 and p.holds[g] == p.wholes
    out = {g for g, k in enumerate(p.kinds) if k == "strong" and not wraps(g)}
    lines = [x for x in p.lines if out.isdisjoint(x.groups)] or p.lines
    size: Counter[int] = Counter()
    tags: Counter[int] = Counter()
    links: Counter[int] = Counter()
    for x in lines:
        for g in x.groups:
            size[g] += len(x.text)
            tags[g] += x.tags
            links[g] += len(x.text) * (x.kind == "l")
    every = sum(len(x.text) for x in lines)
    for g, k in enumerate(p.kinds):
        if k == "form" and not wraps(g) and (p.wholes or 2 * size[g] < every):
            out.add(g)
        elif k == "weak" and not wraps(g) and (2 * links[g] >= size[g] or size[g] < LOW * tags[g]):
            out.add(g)
    return [x for x in lines if out.isdisjoint(x.groups)] or lines


def content(lines: list[Line]) -> list[bool]:
    """Whether each line is in a cluster: its smoothed ratio reaches the mean less one deviation, and it isn't links."""
    s = smooth(ratios(lines))
    mean = sum(s) / len(s)
    spread = math.sqrt(sum((v - mean) ** 2 for v in s) / len(s))
    return [v >= mean - spread and x.kind != "l" for x, v in zip(lines, s)]


def region(lines: list[Line], held: list[bool]) -> tuple[int, ...]:
    """Path of the smallest container that leaves no held line outside; of children the one with most held text is tried."""
    rows = [(x.path, len(x.text)) for x, h in zip(lines, held) if h]
    path: tuple[int, ...] = ()
    while rows:
        by: Counter[int] = Counter()
        for q, n in rows:
            if len(q) == len(path):
                return path
            by[q[len(path)]] += n
        if len(by) > 1:
            return path
        path = (*path, next(iter(by)))
    return path


def select(lines: list[Line]) -> list[Line]:
    """The lines of the main text."""
    good = content(lines)
    inside = sum(len(x.text) for x, g in zip(lines, good) if g and x.whole)
    if any(x.whole for x in lines) and inside >= SHARE * sum(len(x.text) for x, g in zip(lines, good) if g):
        first = next(k for k, x in enumerate(lines) if x.whole)
        above = [k for k in range(first) if lines[k].kind == "1"] if not any(x.whole and x.kind == "1" for x in lines) else []
        return [x for k, x in enumerate(lines) if x.whole or k in above[-1:]]
    solid = [x.kind == "p" or (g and x.kind == "" and r >= LOW) for x, g, r in zip(lines, good, ratios(lines))]
    held = [s or x.kind.isdigit() for x, s in zip(lines, solid)]
    if not any(solid):
        return lines
    at = region(lines, held)
    rows = [(x, s) for x, s in zip(lines, solid) if x.path[: len(at)] == at]
    start, end = (next(k for k in order if rows[k][1]) for order in (range(len(rows)), range(len(rows) - 1, -1, -1)))
    mixed = {x.path for x, _ in rows if x.kind != "l"}
    # Headings before it: the last one of the first level, others only if no links stand in between.
    after = max((k for k in range(start) if rows[k][0].kind == "l"), default=-1)
    title = max((k for k in range(start) if rows[k][0].kind == "1"), default=-1)
    return [x for k, (x, _) in enumerate(rows) if (k < start and x.kind.isdigit() and (k == title or k > after)) or (start <= k <= end and x.path in mixed)]


def main_text(html: str | None) -> str:
    p = _Blocks()
    p.feed(_CUT.sub("", html or ""))
    p.close()
    p.flush()
    return "\n\n".join(x.text for x in select(left_in(p))) if p.lines else ""


_TEXT = "page_id long, url string, text string, n_chars long"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        t = [main_text(h) for h in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(t, pa.string()), pa.array(map(len, t), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> a row each with text and n_chars.

    Null or empty html, and html without text, give the empty text. Null ids
    and urls and repeated rows come back as they are; an empty table gives no
    rows; further columns are ignored.
    """
    common.prepare(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(_extract, _TEXT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
