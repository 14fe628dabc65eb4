"""Visible text of web pages, laid out as a reader would see it.

Tags open and close elements on a stack: start tags imply the end of open paragraphs, list items, rows
and cells, cells imply a row, and what can not stand in a head ends it. Visibility rules drop what a browser does not show. What is left is
laid out: blocks on lines of their own with a blank line around paragraphs and headings, list items
with markers and indents, and table cells in aligned columns. Cells wider than ``WIDEST`` are wrapped
between words, but for those of a table's last column, so that the columns right of them stay aligned.

Cases: null or empty pages give an empty text; a comment that is not closed ends with the page; what looks
like a tag but has no ``>`` after it is text; a tag with a quote that is not closed ends at its
first ``>``, one with any number of quoted values at the first that is in none; nesting of any depth is handled without recursion, and the time grows with the length of a page, malformed
ones too; repeated pages give equal texts; extra columns are carried whatever their names, but a column named as the
result is replaced by it; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .carrying import with_kept

# HTML's element categories.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes object svg math canvas audio video datalist".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table hr fieldset figure".split())
BLOCK = SPACED | frozenset("html body address article aside caption center dd details dialog dir div dt figcaption footer form header li main menu nav option section summary tr".split())
ENDS_P = BLOCK - frozenset("html body caption dd dt li option tr".split()) | frozenset(["li", "dd", "dt"])
#: A start tag ends these open elements, looking no further down than those.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th", "caption"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th", "caption"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "caption"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
} | dict.fromkeys(["thead", "tbody", "tfoot"], (frozenset(["thead", "tbody", "tfoot", "tr", "caption", "colgroup"]), frozenset(["table"])))
#: What a head can hold; any other start tag or text ends it.
IN_HEAD = frozenset("title meta link base basefont bgsound script style template noscript noframes head html".split())
P_SCOPE = frozenset("button td th table caption li ul ol dl dd".split())
CELL_SCOPE = frozenset(["td", "th", "caption"])
TABLE_TAGS = frozenset("table thead tbody tfoot tr td th caption".split())

TOKEN = re.compile(r"""<!--|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'){0,400}+(?=>)|([^>]*+))>|<[!?/][^>]*+>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
BLANKS = re.compile(r"[ \t\n\r\f]+")
WIDEST = 60
SPECIAL = re.compile("[>\"']")


class Quotes:
    """Where tags of very many quoted values end, in time linear in the page.

    A scan that does not find the end notes the quotes it opened; a later one that comes to open one of them would go the
    same way, and stops there. So each quote is opened once by scans that fail, and what others read is consumed.
    """

    def __init__(self, html: str):
        self.html, self.places, self.failed = html, [m.start() for m in SPECIAL.finditer(html)], set()

    def end(self, at: int) -> int | None:
        """The first ``>`` from ``at`` on that is in no quotes; None if a quote does not end before."""
        opened, i = [], bisect_left(self.places, at)
        while i < len(self.places):
            place = self.places[i]
            if self.html[place] == ">":
                return place
            opened.append(place)
            close = -1 if place in self.failed else self.html.find(self.html[place], place + 1)
            if close < 0:
                break
            i = bisect_right(self.places, close)
        self.failed.update(opened)
        return None


class Lines:
    """Lines of text under way: runs of blanks are one, blank lines wait for the next text."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.now: list[str] = []
        self.seen, self.gap, self.indent, self.marker = False, 0, 0, ""

    def add(self, text: str) -> None:
        text = BLANKS.sub(" ", text)
        if not self.now or self.now[-1][-1] in " \n":
            text = text.lstrip(" ")
        self.put(text)

    def put(self, text: str) -> None:
        if text:
            self.now.append(text)
            self.seen = self.seen or not text.isspace()

    def verbatim(self, text: str) -> None:
        self.put(text.replace("\r\n", "\n"))

    def end_line(self, gap: int = 0, verbatim: bool = False) -> None:
        text = "".join(self.now)
        self.now, self.seen = [], False
        text = text.rstrip() if verbatim else text.strip(" ")
        if text.strip():
            if self.done:
                self.done += [""] * self.gap
            self.gap = 0
            for line in text.split("\n"):
                self.done.append((" " * self.indent + self.marker + line).rstrip())
                if self.marker:
                    self.indent, self.marker = self.indent + len(self.marker), ""
        self.gap = max(self.gap, gap)

    def blank(self) -> None:
        """A second line break in a row."""
        if self.seen:
            self.end_line()
        else:
            self.gap = max(self.gap, 1)

    def place(self, lines: list[str], gap: int) -> None:
        self.end_line(gap)
        for line in lines:
            self.now = [line]
            self.end_line(0, True)
        self.end_line(gap)


def wrapped(line: str, width: int) -> list[str]:
    """A line cut between words, no part longer than ``width`` unless a word is."""
    if len(line) <= width:
        return [line]
    out = [""]
    for word in line.split(" "):
        if out[-1] and len(out[-1]) + 1 + len(word) > width:
            out.append(word)
        else:
            out[-1] += " " + word if out[-1] else word
    return out


def number(attrs: dict[str, str], name: str, most: int) -> int:
    value = attrs.get(name, "")
    return max(1, min(most, int(value))) if value.isascii() and value.isdigit() else 1


class Table:
    """Cells of a table under way; a cell is (column, lines)."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, list[str]]]] = []
        self.hanging: dict[int, tuple[int, int]] = {}  # first column: the column after, and the last row that a cell from above covers
        self.at = 0

    def row(self) -> None:
        self.rows.append([])
        self.at = 0

    def cell(self, lines: list[str], spans: tuple[int, int]) -> None:
        here = len(self.rows) - 1
        while self.at in self.hanging:
            after, last = self.hanging[self.at]
            if last < here:
                del self.hanging[self.at]
            else:
                self.at = after
        self.rows[-1].append((self.at, lines))
        after = self.at + spans[0]
        if spans[1] > 1:
            self.hanging[self.at] = (after, here + spans[1] - 1)
        self.at = after

    def lines(self) -> list[str]:
        """The rows with their columns aligned; a column is as wide as its widest cell, or word of a wrapped cell."""
        end = max([0, *(c for row in self.rows for c, cell in row if any(cell))])
        width: dict[int, int] = {}
        rows = []
        for row in self.rows:
            cells = [(c, cell if c == end else [part for line in cell for part in wrapped(line, WIDEST)]) for c, cell in row]
            rows.append(cells)
            for c, cell in cells:
                width[c] = max([width.get(c, 0), *map(len, cell)])
        begin, at = {}, 0
        for c in sorted(width):
            begin[c] = at
            at += width[c] + 2 if width[c] else 0
        out = []
        for cells in rows:
            for k in range(max([0, *(len(cell) for _, cell in cells)])):
                line = ""
                for c, cell in cells:
                    if k < len(cell) and cell[k]:
                        line = line.ljust(begin[c]) + cell[k]
                out.append(line.rstrip())
        return out


class Page:
    """Elements that are open, and the text that they have given so far."""

    def __init__(self) -> None:
        self.open: list[tuple[str, bool, tuple]] = []  # tag, whether it hides its content, what to restore
        self.places: dict[str, list[int]] = {}  # where in ``open`` each tag is
        self.hidden = self.pre = 0
        self.out, self.tables, self.counters = Lines(), [], []

    def start(self, tag: str, given: str) -> None:
        if tag not in IN_HEAD and self.open and self.open[-1][0] == "head":
            self.pop()
        if tag in ENDS_P:
            self.end_one("p", P_SCOPE)
        if tag in IMPLIED:
            ended, stop = IMPLIED[tag]
            while self.end_one(ended, stop):
                pass
        if tag in ("td", "th") and self.tables and self.nearest(("tr",)) <= self.nearest(("table",)):
            self.start("tr", "")
        attrs = {m[1].lower(): unescape(m[2].strip("\"'")) if m[2] else "" for m in ATTRIBUTE.finditer(given)} if given.strip(" /\n") else {}
        if tag in VOID:
            if not self.hidden and tag == "br":
                self.out.end_line(0, True) if self.out.seen else self.out.blank()
            elif not self.hidden and tag == "hr":
                self.out.end_line(1)
            return
        unseen = tag in HIDDEN or "hidden" in attrs or (tag == "dialog" and "open" not in attrs) or bool(UNSEEN.search(attrs.get("style", "")))
        if self.open and self.open[-1][0] == "details" and tag != "summary":
            unseen = True
        if tag == "details" and "open" in attrs:
            tag = "section"
        self.hidden += unseen
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, unseen, self.enter(tag, attrs) if not self.hidden else ()))

    def nearest(self, tags: Iterable[str]) -> int:
        """The place of the last open element of ``tags``, or -1."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def end_one(self, tags: str | frozenset, stop: frozenset) -> bool:
        """Close the nearest open element of ``tags`` that is not below a ``stop`` element."""
        at = self.nearest([tags] if isinstance(tags, str) else tags)
        if at < 0 or self.nearest(stop) > at:
            return False
        while len(self.open) > at:
            self.pop()
        return True

    def end(self, tag: str) -> None:
        if tag == "details" and not self.places.get(tag):
            tag = "section"  # an open one is laid out as a section
        if tag == "br":
            self.start("br", "")
        else:
            self.end_one(tag, frozenset(["table"]) if tag in TABLE_TAGS - {"table"} else frozenset() if tag == "table" else CELL_SCOPE)

    def pop(self) -> None:
        tag, unseen, saved = self.open.pop()
        self.places[tag].pop()
        if saved:
            self.leave(tag, saved)
        self.hidden -= unseen

    def enter(self, tag: str, attrs: dict[str, str]) -> tuple:
        """Begin a visible element; the result is not empty and undone by leave()."""
        before = self.out
        if tag in ("td", "th") and self.tables:
            if not self.tables[-1].rows:
                self.tables[-1].row()
            self.out = Lines()
            return (before, (number(attrs, "colspan", 1000), number(attrs, "rowspan", 65534)))
        if tag in BLOCK:
            self.out.end_line(1 if tag in SPACED and not (tag in ("ul", "ol") and self.counters) else 0, bool(self.pre))
        if tag == "table":
            self.tables.append(Table())
            self.out = Lines()
        elif tag == "tr" and self.tables:
            self.tables[-1].row()
        elif tag == "caption" and self.tables:
            self.out = Lines()
        elif tag in ("ul", "ol", "menu", "dir"):
            start = attrs.get("start", "1")
            self.counters.append(int(start) - 1 if tag == "ol" and re.fullmatch(r"-?\d{1,9}", start) else 0 if tag == "ol" else None)
        saved = (before, (self.out.indent, self.out.marker))
        if tag == "li":
            mark = "- "
            if self.counters and self.counters[-1] is not None:
                self.counters[-1] += 1
                mark = f"{self.counters[-1]}. "
            self.out.indent, self.out.marker = self.out.indent + len(self.out.marker), mark
        elif tag in ("blockquote", "dd"):
            self.out.indent += 2
        elif tag == "pre":
            self.pre += 1
        return saved

    def leave(self, tag: str, saved: tuple) -> None:
        before, kept = saved
        if tag in ("td", "th") and before is not self.out:
            self.out.end_line()
            self.tables[-1].cell(self.out.done, kept)
            self.out = before
            return
        if tag in BLOCK:
            self.out.end_line(1 if tag in SPACED and not (tag in ("ul", "ol") and len(self.counters) > 1) else 0, bool(self.pre))
        if tag == "table" and self.tables:
            table, inner = self.tables.pop(), self.out
            self.out = before
            self.out.place(inner.done + table.lines(), 1)
        elif tag == "caption" and before is not self.out:
            lines, self.out = self.out.done, before
            self.out.place(lines, 0)
        elif tag in ("ul", "ol", "menu", "dir"):
            self.counters.pop()
        elif tag == "pre":
            self.pre -= 1
        if tag in ("li", "blockquote", "dd"):
            self.out.indent, self.out.marker = kept[0], ""

    def text(self, raw: str) -> None:
        if self.open and self.open[-1][0] == "head" and raw.strip():
            self.pop()
        if self.hidden or self.open and self.open[-1][0] == "details":
            return
        if self.pre:
            self.out.verbatim(unescape(raw))
        elif self.tables and self.open[-1][0] in ("table", "tr", "thead", "tbody", "tfoot") and not raw.strip():
            return
        else:
            self.out.add(unescape(raw))


def render(html: str) -> str:
    """The visible text of a page."""
    page, at, n = Page(), 0, len(html)
    quotes = None
    last, lowered = html.rfind(">") + 1, None  # nothing after ``last`` can be a tag
    while at < n:
        m = TOKEN.search(html, at, last) if at < last else None
        if not m:
            cut = html.find("<!--", at)
            page.text(html[at : cut if cut >= 0 else n])
            break
        if m.start() > at:
            page.text(html[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            at = html.find("-->", at - 2) + 3
            if at == 2:
                break
        elif m[2]:
            tag = m[2].lower()
            if m[1]:
                page.end(tag)
                continue
            attributes = m[3]
            if m[4] and SPECIAL.search(m[4]):  # more quoted values than the pattern takes, or a quote that does not end
                quotes = quotes or Quotes(html)
                if (end := quotes.end(m.start(3))) is not None:
                    attributes, at = html[m.start(3) : end], end + 1
            page.start(tag, attributes)
            if tag in RAW:
                lowered = lowered or html.lower()
                close = lowered.find("</" + tag, at) if len(lowered) == n else html.find("</" + m[2], at)
                close = n if close < 0 else close
                if tag in ("textarea", "xmp"):
                    page.text(html[at:close])
                page.end(tag)
                at = n if close == n else html.find(">", close) + 1 or n
    while page.open:
        page.pop()
    page.out.end_line()
    return "\n".join(page.out.done)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with ``html_col`` replaced by ``text_col``, the visible text."""
    others = [c for c in pages.columns if c not in (html_col, text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([render(x.as_py() or "") for x in batch.column("html")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("kept"), texts], names=["kept", "text"])

    return with_kept(pages, others, {"html": F.col(html_col)}, run, "text string", {"text": text_col})
