"""Operator 4: the visible text of an HTML page, laid out.

A tree builder reads the tags: void elements, end tags that the standard implies (a new paragraph, list item, row, cell
or option closes the one before; a block closes an open paragraph), and end tags out of order. Visibility rules drop
what a browser does not show: the head, scripts, styles, templates, hidden elements, closed details and dialogs; of svg,
all but its text elements and foreign objects; of math, annotations and phantoms. All
visible text is written, boilerplate too: paragraphs and headings stand apart, list items get markers and
indentation, and the cells of a table are aligned in columns.

Null or empty html gives an empty text. Broken markup never fails: what cannot be read as markup is text. Every row
gives one row, so repeated rows and null ids stay. Extra columns are dropped. Depth of nesting is not limited; indent is.
Time is in proportion to the page: the places of the open elements are known by name, so no tag walks the path, and
of markup that has no end before the page ends, at most ``UNFINISHED`` pieces are tried as markup; then tags are cut.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from featurewatch.llm.arrow_text import binary_parts, importable

# Element groups of the HTML standard; fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript title iframe object audio video canvas datalist".split())
#: What math does not show, and elements of svg whose text is never drawn in place.
MATH_HIDDEN = frozenset("annotation annotation-xml mphantom".split())
SVG_HIDDEN = frozenset("defs symbol clippath mask marker pattern metadata desc".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure form fieldset article section".split())
BLOCKS = SPACED | frozenset("address aside body center details dialog dd dir div dt figcaption footer header hgroup html legend li main "
                            "menu nav optgroup option search summary caption".split())
#: Start tags that end an open element of these names, up to the nearest of the last group.
IMPLIED_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr", "td", "th", "caption"), ("table",)),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "body": (("head",), ("html",)),
}
SCOPES = frozenset("table td th caption button html".split())

_INVISIBLE_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
_BLANKS = re.compile(r"[ \t\n\r\f]+")
_TAG = re.compile(r"<[^<>]*>")
MAX_INDENT, PADDED, UNFINISHED = 20, 80, 64


class Layout:
    """Lines of one flow of text; a table cell has a flow of its own."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap, self.blank = 0, False
        self.indent, self.marker = 0, ""

    def text(self, data: str, exact: bool) -> None:
        if exact:
            first, *rest = data.split("\n")
            self._put(first)
            for line in rest:
                self.line()
                self._put(line)
            return
        data = _BLANKS.sub(" ", data)
        if data[:1] == " ":
            self.blank = True
            data = data[1:]
        if not data:
            return
        end = data[-1] == " "
        if self.blank and self.now:
            self.now.append(" ")
        self._put(data[:-1] if end else data)
        self.blank = end

    def _put(self, data: str) -> None:
        if data:
            if not self.now:
                self._open(not data.isspace())
            self.now.append(data)
            self.blank = False

    def _open(self, marked: bool = True) -> None:
        """Begins a line; the marker of a list item waits for one with text."""
        if self.lines and self.gap == 2 and self.lines[-1]:
            self.lines.append("")
        self.gap = 0
        pad = " " * min(self.indent, MAX_INDENT)
        if self.marker and marked:
            pad, self.marker = pad[:max(0, len(pad) - len(self.marker))] + self.marker, ""
        self.now.append(pad)

    def line(self) -> None:
        """Ends the line; an empty one counts."""
        self.lines.append("".join(self.now).rstrip())
        self.now, self.blank = [], False

    def block(self, gap: int) -> None:
        if self.now:
            self.line()
        self.gap, self.blank = max(self.gap, gap), False

    def rows(self, lines: list[str]) -> None:
        for line in lines:
            self._open()
            self.now.append(line)
            self.line()

    def result(self) -> list[str]:
        self.block(0)
        lines = self.lines
        while lines and not lines[0]:
            lines = lines[1:]
        while lines and not lines[-1]:
            lines = lines[:-1]
        return lines


def align(rows: list[list[tuple[list[str], int]]]) -> list[str]:
    """Lines of a table: cells (lines, columns spanned) padded to the width of their column, up to ``PADDED``."""
    widths: dict[int, int] = {}
    for row in rows:
        at = 0
        for lines, span in row:
            if span == 1:
                widths[at] = max(widths.get(at, 0), min(PADDED, max(map(len, lines), default=0)))
            at += span
    out = []
    for row in rows:
        for k in range(max((len(lines) for lines, _ in row), default=0)):
            parts, at = [], 0
            for lines, span in row:
                width = sum(widths.get(c, 0) for c in range(at, at + span)) + 2 * (span - 1)
                parts.append((lines[k] if k < len(lines) else "").ljust(width))
                at += span
            out.append("  ".join(parts).rstrip())
    return out


class Page(HTMLParser):
    """Tree builder and renderer: ``open`` is the path of open elements, each (name, hidden, exact, list counter)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[list] = []
        self.places: dict[str, list[int]] = {}            # of the open elements of each name, in the path
        self.flows = [Layout()]
        self.tables: list[list] = []
        self.inside = {"svg": 0, "math": 0}

    # the tree
    def handle_starttag(self, tag, attrs):
        ends = IMPLIED_ENDS.get(tag)
        if ends:
            self._close_to(*ends)
        if tag in BLOCKS and tag not in ("html", "body", "option", "optgroup"):
            self._close_to(("p",), SCOPES)
        if tag not in ("html", "head", *HIDDEN, "meta", "link", "base") and self.open and self.open[-1][0] == "head":
            self._pop()                                   # the body begins unannounced
        self._enter(tag, dict(attrs))
        if tag in VOID:
            self._pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)                  # the slash means nothing but on void elements

    def handle_endtag(self, tag):
        if tag == "br":
            self.handle_starttag("br", [])
        elif tag == "p" and not self.places.get("p"):
            self._enter("p", {})
            self._pop()
        elif tag not in VOID:
            stops = () if tag in ("table", "html", "body") else ("table",) if tag not in ("td", "th", "tr", "thead", "tbody", "tfoot", "caption") else ("table",)
            self._close_to((tag,), stops)

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "head" and data.strip(" \t\n\r\f"):
            self._pop()                                   # text cannot stand in the head
        if not (self.open and self.open[-1][1]):
            if self.tables and self.open and self.open[-1][0] in ("table", "tr", "thead", "tbody", "tfoot") and data.strip():
                self._enter("caption" if self.open[-1][0] != "tr" else "td", {})     # text astray in a table
            self.flows[-1].text(data, bool(self.open and self.open[-1][2]))

    def _close_to(self, names, stops) -> None:
        """Closes up to the open element of ``names`` (the outermost, if there are several names) that is not beyond one of
        ``stops``."""
        bar = max((self.places[s][-1] for s in stops if self.places.get(s)), default=-1)
        if len(names) == 1:
            last = [p[-1] for p in (self.places.get(names[0]),) if p and p[-1] > bar]
        else:
            last = [p[bisect_right(p, bar)] for p in map(self.places.get, names) if p and p[-1] > bar]
        if last:
            while len(self.open) > min(last):
                self._pop()

    # the rendering
    def _enter(self, tag, attrs) -> None:
        above = self.open[-1] if self.open else [None, False, False, 0]
        hidden = above[1] is True or tag in HIDDEN or "hidden" in attrs or bool(_INVISIBLE_STYLE.search(attrs.get("style") or ""))
        hidden = hidden or (tag == "dialog" and "open" not in attrs) or (above[0] == "details" and not above[3] and tag != "summary")
        hidden = hidden or (tag in MATH_HIDDEN and self.inside["math"] > 0)
        hidden = hidden or (self.inside["svg"] > 0 and (tag in SVG_HIDDEN or attrs.get("display") == "none" or attrs.get("visibility") in ("hidden", "collapse")))
        drawn = not hidden and above[1] == "svg" and tag in ("text", "foreignobject")
        if not hidden and (tag == "svg" or (above[1] == "svg" and not drawn)):
            hidden = "svg"                                # what is not drawn there; text in it is
        if tag in self.inside:
            self.inside[tag] += 1
        exact = above[2] or tag in ("pre", "textarea", "listing")
        state = 1 if tag == "details" and "open" in attrs else 0
        if tag == "ol" and (attrs.get("start") or "").strip().lstrip("-").isdigit():
            state = int(attrs["start"]) - 1
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append([tag, hidden, exact, state])
        if hidden:
            return
        flow = self.flows[-1]
        if drawn:
            flow.text(" ", False)                         # placed apart from other text
        elif tag == "table":
            flow.block(2)
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th", "caption") and self.tables:
            if not self.tables[-1] or tag == "caption":
                self.tables[-1].append([])
            span = attrs.get("colspan") or ""
            self.open[-1][3] = min(1000, max(1, int(span))) if span.isascii() and span.isdigit() else 1
            self.flows.append(Layout())
        elif tag == "br":
            if flow.now:
                flow.line()
            else:
                flow.block(2)
        elif tag == "hr":
            flow.block(1)
        elif tag in BLOCKS:
            flow.block(2 if tag in SPACED and not (tag in ("ul", "ol", "dl") and above[0] in ("li", "dd")) else 1)
            if tag in ("ul", "ol", "menu", "dir"):
                flow.indent += 3 if tag == "ol" else 2
            elif tag in ("blockquote", "dd"):
                flow.indent += 2
            elif tag == "li":
                above[3] += 1
                flow.marker = f"{above[3]}. " if above[0] == "ol" else "- "

    def _pop(self) -> None:
        tag, hidden, _, state = self.open.pop()
        self.places[tag].pop()
        if tag in self.inside:
            self.inside[tag] -= 1
        if hidden:
            return
        if self.open and self.open[-1][1] == "svg":
            self.flows[-1].text(" ", False)
        elif tag in ("td", "th", "caption") and self.tables:
            lines = self.flows.pop().result()
            self.tables[-1][-1].append((lines, max(1, state)))
            if tag == "caption":
                self.tables[-1].append([])
        elif tag == "table" and self.tables:
            rows = [r for r in self.tables.pop() if r]
            self.flows[-1].rows(align(rows))
            self.flows[-1].block(2)
        elif tag in BLOCKS:
            flow = self.flows[-1]
            flow.block(2 if tag in SPACED and not (tag in ("ul", "ol", "dl") and self.open and self.open[-1][0] in ("li", "dd")) else 1)
            if tag in ("ul", "ol", "menu", "dir"):
                flow.indent -= 3 if tag == "ol" else 2
            elif tag in ("blockquote", "dd"):
                flow.indent -= 2
            elif tag == "li":
                flow.marker = ""

    def finish(self) -> str:
        while self.open:
            self._pop()
        return "\n".join(self.flows[0].result())


def visible_text(html: str) -> str:
    page = Page()
    try:
        page.feed(html)
        for tried in range(UNFINISHED + 1):
            rest = page.rawdata
            if rest[:1] != "<" or page.cdata_elem:
                break
            page.rawdata = ""                             # markup without an end is text, up to the next sign of a tag
            if tried == UNFINISHED:
                page.handle_data(unescape(_TAG.sub(" ", rest)))
                break
            end = rest.find(">", 1) + 1 or max(rest.find("<", 1), 1)
            page.handle_data(unescape(rest[:end]))
            page.feed(rest[end:])
        page.close()
    except (AssertionError, ValueError):                  # a declaration that the tokeniser refuses
        rest, page.rawdata = page.rawdata, ""
        page.handle_data(re.sub(r"<[^>]*>", " ", rest))
    return page.finish()


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id`` and ``text`` of every page."""
    def run(batches):
        for batch in batches:
            offsets, raw = binary_parts(batch.column(1))
            ends = offsets.tolist()
            texts = [visible_text(raw[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["page_id", "text"])

    pages = importable(df).select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return pages.mapInArrow(run, "page_id long, text string")
