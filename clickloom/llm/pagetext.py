"""Visible text of web pages, laid out: blocks on lines of their own, lists with markers, tables with aligned cells.

A page is read once from front to back. A stack of open elements supplies the end tags that HTML
lets authors leave out, carries visibility down, and drives the layout. Nothing is recursive, so depth is no limit.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Cells with longer lines do not widen their column, which keeps padding in proportion to the text.
WIDEST_CELL = 80

# Element names and their roles in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style template noscript iframe object audio video canvas datalist svg math".split())
RAW = frozenset("script style template noscript iframe title textarea svg math".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset hr".split())
BLOCKS = SPACED | frozenset(
    "html body div section article aside header footer nav main form address li dt dd tr thead tbody tfoot caption figcaption details summary legend center dialog menu option optgroup".split()
)
CLOSES_P = BLOCKS - frozenset("html body li dt dd tr thead tbody tfoot caption option optgroup".split())
TABLE_PARTS = frozenset("table thead tbody tfoot tr td th caption".split())
SCOPES = frozenset("table td th caption".split())
#: For a start tag: the open elements it ends, and those the search stops at.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?|[\"'])*+)>")
_OTHER = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?/][^>]*(?:>|\Z)", re.S)
_SPACE = re.compile(r"[ \t\n\r\f]+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|style\s*=\s*[\"']?[^\"'>]*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_SPAN = re.compile(r"colspan\s*=\s*[\"']?(\d{1,3})", re.I)
_START = re.compile(r"(?:^|\s)start\s*=\s*[\"']?(-?\d{1,9})", re.I)


class Flow:
    """Lines of text under construction."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.gap = False
        self.indent: list[str] = []
        self.marker = ""

    def _begin(self) -> None:
        if not self.line:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.line.append(self.marker or "".join(self.indent))
            self.marker = ""
        elif self.space:
            self.line.append(" ")
        self.space = False

    def text(self, text: str) -> None:
        words = _SPACE.sub(" ", text)
        body = words.strip(" ")
        if not body:
            self.space |= bool(words) and bool(self.line)
            return
        self.space |= words[0] == " " and bool(self.line)
        self._begin()
        self.line.append(body)
        self.space = words[-1] == " "

    def kept(self, text: str) -> None:
        """Text whose spaces and line ends count."""
        for k, part in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if k:
                self.broken()
            if part:
                self._begin()
                self.line.append(part)

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False

    def broken(self) -> None:
        self.end_line() if self.line else self.lines.append("")
        self.space = False

    def apart(self) -> None:
        self.end_line()
        self.gap = True

    def block(self, lines: list[str]) -> None:
        for line in lines:
            self._begin()
            self.line.append(line)
            self.end_line()

    def done(self) -> list[str]:
        self.end_line()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        return lines


def aligned(rows: list[list[tuple[list[str], int]]]) -> list[str]:
    """Lines of a table from the lines and the column span of each cell; columns are two spaces apart."""
    widths: dict[int, int] = {}
    for row in rows:
        at = 0
        for lines, span in row:
            longest = max(map(len, lines), default=0)
            if span == 1 and longest <= WIDEST_CELL:
                widths[at] = max(widths.get(at, 0), longest)
            at += span
    out = []
    for row in rows:
        for k in range(max((len(lines) for lines, _ in row), default=0)):
            parts, at = [], 0
            for lines, span in row:
                width = sum(widths.get(c, 0) for c in range(at, at + span)) + 2 * (span - 1)
                parts.append((lines[k] if k < len(lines) else "").ljust(width))
                at += span
            out.append("  ".join(parts).rstrip(" "))
    return out


class Page:
    """Open elements, each with its tag, whether it is seen, and whether its spaces count; and the flows of open cells."""

    def __init__(self):
        self.open: list[tuple[str, bool, bool]] = []
        self.count: dict[str, int] = {}
        self.flow = Flow()
        self.outer: list[Flow] = []
        self.tables: list[list[list[tuple[list[str], int]]]] = []
        self.lists: list[list] = []
        self.spans: list[int] = []

    @property
    def seen(self) -> bool:
        return not self.open or self.open[-1][1]

    def within(self, wanted: set[str], stop: set[str] | frozenset[str]) -> int:
        """Place of the innermost open element of ``wanted`` that is not outside one of ``stop``; -1 if there is none."""
        if any(self.count.get(tag) for tag in wanted):
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] in wanted:
                    return k
                if self.open[k][0] in stop:
                    break
        return -1

    def close_to(self, place: int) -> None:
        while place >= 0 and len(self.open) > place:
            tag, seen, _ = self.open.pop()
            self.count[tag] -= 1
            if seen:
                self.leave(tag)

    def start(self, tag: str, attributes: str) -> None:
        if tag in CLOSES_P:
            self.close_to(self.within({"p"}, SCOPES | {"button"}))
        if tag in IMPLIED:
            self.close_to(self.within(*IMPLIED[tag]))
        if tag in ("td", "th") and self.within({"tr"}, {"table"}) < 0 and self.within({"table"}, set()) >= 0:
            self.start("tr", "")
        seen = self.seen and tag not in UNSEEN and not (attributes and _HIDDEN.search(attributes))
        if tag in VOID:
            if seen and tag == "br":
                self.flow.broken()
            elif seen and tag == "hr":
                self.flow.apart()
            return
        self.open.append((tag, seen, tag in ("pre", "textarea") or bool(self.open and self.open[-1][2] and tag not in SCOPES)))
        self.count[tag] = self.count.get(tag, 0) + 1
        if seen:
            self.enter(tag, attributes)

    def end(self, tag: str) -> None:
        if tag == "br":
            return self.start("br", "")
        place = self.within({tag}, {"table"} if tag in TABLE_PARTS else SCOPES)
        if tag not in ("html", "body"):
            self.close_to(place)

    def enter(self, tag: str, attributes: str) -> None:
        flow = self.flow
        if tag in ("td", "th"):
            if self.tables:
                span = _SPAN.search(attributes)
                self.spans.append(min(max(1, int(span[1])), 100) if span else 1)
                self.outer.append(flow)
                self.flow = Flow()
            else:
                flow.space = True
            return
        if tag in SPACED and not (tag in ("ul", "ol") and self.lists):
            flow.apart()
        elif tag in BLOCKS:
            flow.end_line()
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("ul", "ol", "menu"):
            first = _START.search(attributes) if tag == "ol" else None
            self.lists.append([tag, int(first[1]) if first else 1, len(flow.indent)])
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 1, 0]
            marker = f"{kind[1]}. " if kind[0] == "ol" else "- "
            kind[1] += 1
            flow.marker = "".join(flow.indent) + marker
            flow.indent.append(" " * len(marker))
        elif tag in ("dd", "blockquote"):
            flow.indent.append("  ")

    def leave(self, tag: str) -> None:
        if tag in ("td", "th"):
            if self.outer:
                lines, self.flow = self.flow.done(), self.outer.pop()
                span = self.spans.pop()
                if not self.tables[-1]:
                    self.tables[-1].append([])
                self.tables[-1][-1].append((lines, span))
            return
        flow = self.flow
        if tag == "table" and self.tables:
            flow.block(aligned(self.tables.pop()))
        if tag in SPACED and not (tag in ("ul", "ol") and len(self.lists) > 1):
            flow.apart()
        elif tag in BLOCKS:
            flow.end_line()
        if tag in ("ul", "ol", "menu") and self.lists:
            self.lists.pop()
        elif tag in ("li", "dd", "blockquote"):
            if flow.indent:
                flow.indent.pop()
            flow.marker = ""

    def text(self, text: str) -> None:
        if self.seen and text:
            text = unescape(text) if "&" in text else text
            self.flow.kept(text) if self.open and self.open[-1][2] else self.flow.text(text)


def visible_text(html: str) -> str:
    """All visible text of a page, laid out; an empty page has none. What is no valid tag is text."""
    page, at, size = Page(), 0, len(html)
    while at < size:
        opened = html.find("<", at)
        if opened < 0:
            page.text(html[at:])
            break
        tag = _TAG.match(html, opened)
        other = None if tag else _OTHER.match(html, opened)
        if not tag and not other:
            # a bare sign: the text goes on behind it
            next_at = html.find("<", opened + 1)
            next_at = size if next_at < 0 else next_at
            page.text(html[at:next_at])
            at = next_at
            continue
        if opened > at:
            page.text(html[at:opened])
        at = (tag or other).end()
        if not tag:
            continue
        name = tag[2].lower()
        if tag[1]:
            page.end(name)
            continue
        page.start(name, tag[3])
        if name in RAW and not tag[3].endswith("/"):
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            inside = html[at : close.start() if close else size]
            at = close.start() if close else size
            if name == "textarea":
                page.text(inside)
            page.end(name)
    page.close_to(0)
    return "\n".join(page.flow.done()).strip("\n")


def rendered(html: str = "html") -> Column:
    """The visible text of each whole page; null counts as empty."""
    return arrow_udf(lambda pages: pa.array([visible_text(h.as_py() or "") for h in pages], pa.string()), "string").asNondeterministic()(F.col(html).cast("string"))


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", rendered().alias("text"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
