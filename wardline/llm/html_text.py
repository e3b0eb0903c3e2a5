"""Main text of HTML pages by text-to-tag ratios over the events of the standard library's parser.

The parser's events become *lines*: a line ends wherever a block element opens or closes, since pages often
have no newlines.  Each line has the length of its text, the share of it inside links, and the tags seen since
the line before; its ratio is text outside links per tag.  Ratios are smoothed with a Gaussian over neighbouring
lines and cut at a threshold from their spread; the lines above it form clusters.  A cluster says *where* the
content is, not which of its lines are long enough: the region is the page's articles if any
holds a cluster, or else the innermost container around all clusters, so a short section beside long ones stays.
Subtrees that the markup names as something else (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, comments) take no part at all.  An element says so by its kind or role; a class or id only by a whole name, such
as "ad", "site-footer" or "commentList" (but not "has-sidebar" or "notice-board"), and not where the rest of the page
shows that the element is the content.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Width of the smoothing in lines, and the threshold in standard deviations of the smoothed ratios.
SIGMA, THRESHOLD = 1.0, 0.5

_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul button iframe object svg".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose lines belong to them as containers; other blocks belong to the container around them.
_CONTAINERS = frozenset("article aside body center div main section td".split())
_DROPPED = frozenset("aside button dialog footer form head iframe menu nav noscript object option script select style svg template textarea title".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar tooltip".split())
#: Words of a class or id that name something else than content; a name counts whose other words are all of _AROUND.
_COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
_NAMES = _COMMENTS | frozenset("ad adbox ads adsense advert advertisement adverts banner breadcrumb breadcrumbs consent cookie cookies copyright footer gdpr login masthead menu modal nav navbar navigation newsletter newsletters notice notices notification notifications pager pagination popup promo promotion related share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split())
_AROUND = frozenset("aside area article bar blog bottom box block body button buttons card center col column container content count desktop entry first fixed floating form global group heading horizontal icons inline inner item items js large latest left link links list lower main mini mobile mod module news outer page panel popular post posts primary reader region right row second secondary section site slot small sticky story strip text thread title to top unit upper user vertical wrap wrapper zone".split())
_HEADERS = frozenset(("header",))
#: Text outside links of a container that is named so, from which on it may be the content of a page without any other.
CONTENT_CHARS = 250
#: What an opening tag ends if it is still open: an element and the ancestors at which the search stops.
_CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dd", ("dl",)), "dd": ("dt", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr", "table")), "th": ("td", ("tr", "table")), "option": ("option", ("select",))}
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_TAG = re.compile(r"<[A-Za-z/!?]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _noise(value: str, names: frozenset) -> str | None:
    """The word of ``names`` in a class or id (of one token or several) that makes it the name of something else, or null."""
    for token in value.split():
        words = [w.lower() for w in _SPLIT.findall(token)]
        own = [w for w in words if w in names]
        if own and all(w in names or w in _AROUND or w.isdigit() for w in words):
            return own[0]
    return None


class _Dropped:
    """A subtree dropped for its class or id: its tag's number, its text's length in and outside links, and whether it holds an article."""

    def __init__(self, number: int, word: str):
        self.number, self.word, self.size, self.links, self.article = number, word, 0, 0, False


class _Lines(HTMLParser):
    """Lines of a page: [text parts, length, length in links, tags, container]; dropped subtrees leave none.

    Tags whose numbers are in ``excused`` are not dropped for their class or id.
    """

    def __init__(self, excused: set[int]):
        super().__init__(convert_charrefs=True)
        self.excused = excused
        self.lines: list[list] = []
        self.stack: list[tuple[str, int, bool]] = []  # tag, container, whether it began a dropped subtree
        self.parents = [-1]
        self.outer = [-1]  # the outermost article or main around each container
        self.named: list[_Dropped] = []
        self.container = self.dropped = self.links = self.tags = self.articles = self.opened = self.number = 0
        self.by_name = False
        self.line: list | None = None

    def _end_line(self) -> None:
        if self.line is not None:
            self.lines.append(self.line)
            self.line = None

    def _drops(self, tag: str, attrs: list) -> bool:
        if tag in _DROPPED:
            return True
        if tag == "header":
            return not self.articles
        word = None
        for key, value in attrs:
            if key in ("class", "id") and value and tag not in ("body", "html", "main"):
                names = _COMMENTS if tag == "article" else _NAMES if self.articles else _NAMES | _HEADERS
                word = word or _noise(value, names)
            elif key == "role":
                if (value or "").lower() in _ROLES:
                    return True
            elif key == "hidden" or key == "aria-hidden" and (value or "").lower() == "true" or key == "style" and value and _HIDDEN.search(value):
                return True
        if word is None or self.number in self.excused:
            return False
        if not self.dropped:
            self.named.append(_Dropped(self.number, word))
        return True

    def _holder(self) -> _Dropped | None:
        """The dropped subtree around, if it is one for its name and nothing in it is dropped besides."""
        return self.named[-1] if self.dropped == 1 and self.by_name else None

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        self.number += 1
        if tag == "br":
            if self.line is not None:
                self.line[0].append(" ")
            return
        if tag in _BLOCKS:
            self._end_line()
            if self.stack and self.stack[-1][0] == "p":
                self._pop()
            if tag in _CLOSES:
                self._close(*_CLOSES[tag])
        if tag in _VOID:
            return
        before = len(self.named)
        drop = bool(attrs or tag in _DROPPED or tag == "header") and self._drops(tag, attrs)
        self.stack.append((tag, self.container, drop))
        if drop:
            if not self.dropped:
                self.by_name = len(self.named) > before
            self.dropped += 1
        if tag == "a":
            self.links += 1
        elif tag in _CONTAINERS:
            new = len(self.parents)
            article = tag in ("article", "main")
            self.parents.append(self.container)
            self.outer.append(o if (o := self.outer[self.container]) >= 0 else new if article else -1)
            self.container = new
            if article:
                self.articles += 1
                if not self.dropped:
                    self.opened += 1
                elif holder := self._holder():
                    holder.article = True

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def _pop(self) -> None:
        tag, self.container, drop = self.stack.pop()
        if drop:
            self.dropped -= 1
        if tag == "a":
            self.links -= 1
        elif tag in ("article", "main"):
            self.articles -= 1

    def _close(self, tag: str, stops: tuple) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            own = self.stack[k][0]
            if own == tag:
                while len(self.stack) > k:
                    self._pop()
                return
            if own in stops:
                return

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in _BLOCKS:
            self._end_line()
        for k in range(len(self.stack) - 1, -1, -1):
            own = self.stack[k][0]
            if own == tag:
                while len(self.stack) > k:
                    self._pop()
                return
            if own in _BLOCKS and tag not in _BLOCKS:  # a stray inline end
                return

    def handle_data(self, data):
        size = len(data)
        if self.dropped:
            if holder := self._holder():
                holder.size += size
                holder.links += size if self.links else 0
            return
        if self.line is None:
            if data.isspace():
                return
            self.line = [[], 0, 0, self.tags, self.container]
            self.tags = 0
        else:
            self.line[3] += self.tags
            self.tags = 0
        self.line[0].append(data)
        self.line[1] += size
        if self.links:
            self.line[2] += size


def smoothed(ratios: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing; the kernel is cut at three sigma and renormalised at the ends."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(reach + 1)]
    out = []
    for i in range(len(ratios)):
        total = weight = 0.0
        for j in range(max(0, i - reach), min(len(ratios), i + reach + 1)):
            w = kernel[abs(i - j)]
            total += w * ratios[j]
            weight += w
        out.append(total / weight)
    return out


def _parsed(html: str) -> tuple[_Lines, list[tuple[str, list]]]:
    """The page's lines, with whatever a class or id has named wrongly put back.

    A subtree that is dropped for its name is the content after all if it holds an article, the rest of the page has
    none, and less text; or if it holds a text of its own and the rest of the page none.  Comments are never that.
    """
    excused: set[int] = set()
    while True:
        parser = _Lines(excused)
        parser.feed(html)
        parser.close()
        parser._end_line()
        lines = [(text, line) for line in parser.lines if (text := " ".join("".join(line[0]).split()))]
        size = sum(line[1] for _, line in lines)
        named = [d for d in parser.named if d.word not in _COMMENTS]
        back = [d for d in named if d.article and d.size > size] if not parser.opened else []
        if not back and not lines:
            back = [d for d in named if d.size - d.links >= max(CONTENT_CHARS, d.size / 2)]
        if not back:
            return parser, lines
        excused.update(d.number for d in back)


def main_text(html: str | None) -> str:
    """The page's main text: its blocks in page order, joined by an empty line; empty if there is none.

    Character references are decoded and white space inside a block is one space.  Of a page that breaks off
    inside a tag, the open tag goes and its text stays.
    """
    if not html:
        return ""
    open_tag = _TAG.search(html, html.rfind(">") + 1)
    parser, lines = _parsed(html[: open_tag.start()] if open_tag else html)
    if not lines:
        return ""
    ratios = [max(0, line[1] - line[2]) / max(1, line[3]) for _, line in lines]
    smooth = smoothed(ratios)
    mean = sum(smooth) / len(smooth)
    cut = min(mean, THRESHOLD * math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth)))
    outer = parser.outer
    held = {line[4] for (_, line), ratio in zip(lines, smooth) if ratio >= cut}
    if any(outer[c] >= 0 for c in held):
        return "\n\n".join([text for text, line in lines if outer[line[4]] >= 0])
    region = _around(held, parser.parents)
    inside = [False] * len(parser.parents)
    for c, parent in enumerate(parser.parents):
        # A container's number is above that of the one around it.
        inside[c] = c == region or parent >= 0 and inside[parent]
    return "\n\n".join([text for text, line in lines if inside[line[4]]])


def _around(held: set[int], parents: list[int]) -> int:
    """The innermost container around all of ``held``."""
    c, *others = sorted(held)
    for other in others:
        while c != other:
            if c > other:
                c = parents[c]
            else:
                other = parents[other]
    return c


def extract(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row's whole html.

    A null or empty html, or one without content, has an empty text.  Null ids and urls stay; repeated rows
    stay; other columns of the input are not read.
    """
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("binary").alias("_html"))
    kinds = dict(pages.dtypes)

    def run(batches):
        for batch in slices(batches, 64):
            texts = [main_text(raw.decode("utf-8", "replace")) if raw else "" for raw in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
