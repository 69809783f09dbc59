"""Layout-aware rendering of HTML: all visible text, with block spacing, lists and aligned tables.

A small tree builder keeps the stack of open elements, closes the ones whose end tags are
implied, and knows which are hidden. Text flows into the innermost box (page, list item or
table cell); a box becomes lines when its element closes. Paragraphs and headings are set off
by a blank line, other blocks by a line break; list items get their marker and hang under it;
table cells are padded to their column. Elements count at any depth: the stack is searched by
the places of each tag, so an end tag costs the same however deep it is. Everything is linear in
the page.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.quality_rules import _ddl
from quire.llm.text import row, slices

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title".split())
HIDDEN = frozenset("head script style title template noscript iframe noembed noframes datalist area".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr menu".split())
BLOCKS = SPACED | frozenset(
    "html body div section article header footer nav main aside address form fieldset details summary dialog li dt dd "
    "caption figcaption legend center hgroup search tr thead tbody tfoot option optgroup".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
#: Start tag -> open elements that it closes, and where the search for them ends.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "td", "th", "table")),
    "dt": (("dt", "dd"), ("dl", "td", "th", "table")),
    "dd": (("dt", "dd"), ("dl", "td", "th", "table")),
    "option": (("option",), ("select", "table")),
    "optgroup": (("option", "optgroup"), ("select", "table")),
    "tr": (("tr", "caption", "colgroup"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
}
#: Boxes inside each other; deeper list items and tables flow into the box around them, with their marks and line breaks.
MAX_BOXES = 256
MAX_INDENT = 16
MAX_PAD = 40
MAX_TABLES = 4
#: Columns of a table that cells of earlier rows may cover at a time; cells that would cover more count for their own row.
MAX_COVERED = 64

#: An attribute as the HTML standard reads it: only a quote right after the equals sign opens a quoted value.
_ONE = r"""(=?[^ \t\n\r\f/>=]++|=)(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:"([^"]*+)"|'([^']*+)'|([^ \t\n\r\f>"'][^ \t\n\r\f>]*+)|(?=>|\Z)))?+"""
_ATTR = re.compile(r"[ \t\n\r\f/]*+" + _ONE)
_NAME = re.compile(r"<(/?)([a-zA-Z][^ \t\n\r\f/>]*+)")
_TAG = re.compile(_NAME.pattern + r"((?:[ \t\n\r\f/]++|" + _ONE + r")*+)>")
_LAST = re.compile(r"[ \t\n\r\f/]*+>")
_OPEN = re.compile(r"</?[a-zA-Z]|<[!?]|</")
_BLANK = re.compile(r"[ \t\n\r\f]+")
#: What can hold a semicolon or colon of no declaration: comments, strings, arguments; all end with the style at the latest.
_INERT = re.compile(r"""/\*.*?(?:\*/|\Z)|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|\([^)]*(?:\)|\Z)""", re.DOTALL)
_MAY_HIDE = re.compile("hidden|style", re.IGNORECASE)
_WHOLE = re.compile(r"[ \t\n\r\f]*([+-]?)0*(\d{1,9})")


def attributes(raw: str) -> dict[str, str]:
    """Values by lower-case name of a tag's attributes; the first of a name counts, and names without a value have the empty one."""
    out: dict[str, str] = {}
    for name, *values in _ATTR.findall(raw):
        name = name.lower()
        if name not in out:
            value = "".join(values)
            out[name] = html.unescape(value) if "&" in value else value
    return out


def unseen(raw: str) -> bool:
    """Whether a tag's attributes hide its element: the attribute hidden, or display or visibility in its style."""
    if not _MAY_HIDE.search(raw):
        return False
    found = attributes(raw)
    if "hidden" in found:
        return True
    style: dict[str, tuple[bool, str]] = {}
    for part in _INERT.sub(" ", found.get("style", "")).split(";"):
        name, _, value = part.partition(":")
        value, _, important = value.lower().partition("!")
        rule = (important.strip() == "important", value.strip())
        name = name.strip().lower()
        if rule[1] and rule[0] >= style.get(name, rule)[0]:  # a later rule counts, unless the earlier one is important
            style[name] = rule
    value = {name: v for name, (_, v) in style.items()}
    return value.get("display") == "none" or value.get("visibility") == "hidden"


def whole(raw: str, name: str, default: int) -> int:
    """A whole number among a tag's attributes."""
    found = _WHOLE.match(attributes(raw).get(name, "")) if raw else None
    return int(found[1] + found[2]) if found else default


def _tag_end(page: str, at: int, dead: set[int]) -> int:
    """Place of the '>' behind the attributes at ``at``, -1 if there is none; ``dead`` are places known to have none."""
    tried = []
    while at not in dead:
        tried.append(at)
        found = _ATTR.match(page, at)
        if not found:
            last = _LAST.match(page, at)
            if last:
                return last.end() - 1
            break
        at = found.end()
    dead.update(tried)
    return -1


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) with kind 'text', 'raw', 'start' or 'end'; comments and declarations are left out."""
    at, n, whole_tags = 0, len(page), True
    dead: set[int] = set()
    while at < n:
        m = _OPEN.search(page, at)
        if not m:
            yield "text", page[at:], ""
            return
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.start()
        if page.startswith("<!--", at):
            if page.startswith(("<!-->", "<!--->"), at):
                end = page.index(">", at) + 1
            else:
                end = page.find("-->", at + 4)
                end = n if end < 0 else end + 3
            at = end
            continue
        end = page.find(">", at)
        if end < 0:
            return  # a tag that never ends
        if len(m.group()) > 1 and m.group()[-1].isalpha():
            tag = _TAG.match(page, at) if whole_tags else None
            if tag:
                close, name, attrs, end = tag[1], tag[2], tag[3], tag.end() - 1
            else:  # a tag whose quoted values swallow the rest of the page ends at its first '>', and only that tag
                whole_tags = False  # from here on with a record of what was tried, to stay linear
                head = _NAME.match(page, at)
                found = _tag_end(page, head.end(), dead)
                end = found if found >= 0 else page.index(">", head.end())
                close, name, attrs = head[1], head[2], page[head.end() : end]
            name = name.lower()
            yield ("end" if close else "start"), name, attrs
            if not close and name in RAW:
                stop = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.IGNORECASE).search(page, end + 1)
                yield "raw", page[end + 1 : stop.start() if stop else n], ""
                if not stop:
                    return
                at = stop.start()
                continue
        at = end + 1


class Box:
    """Lines of text of the page, a list item or a cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0
        self.blank = False
        self.mark = ""  # of a list item without a box, until its first line

    def _begin(self) -> None:
        if self.gap == 2 and self.lines:
            self.lines.append("")
        self.gap = 0
        if self.mark:
            self.now.append(self.mark)
            self.mark = ""

    def flow(self, text: str) -> None:
        text = _BLANK.sub(" ", text)
        core = text.strip(" ")
        if core:
            if not self.now:
                self._begin()
            elif self.blank or text[0] == " ":
                self.now.append(" ")
            self.now.append(core)
            self.blank = text[-1] == " "
        elif text:
            self.blank = True

    def keep(self, text: str) -> None:
        """Preformatted text: line breaks and blanks stay."""
        first, *rest = text.replace("\r\n", "\n").split("\n")
        for k, line in enumerate([first, *rest]):
            if k:
                self.turn()
            if line:
                if not self.now:
                    self._begin()
                self.now.append(line)

    def end(self) -> None:
        if self.now:
            self.lines.append("".join(self.now))
        self.now, self.blank = [], False

    def turn(self) -> None:
        """A forced line break."""
        if self.now:
            self.end()
        elif self.lines and not self.gap:
            self.lines.append("")

    def margin(self, gap: int) -> None:
        self.end()
        self.gap = max(self.gap, gap)

    def add(self, lines: list[str], gap: int) -> None:
        self.margin(gap)
        if lines:
            self._begin()
            self.lines += ["".join(self.now) + lines[0], *lines[1:]]
            self.now = []

    def done(self) -> list[str]:
        self.end()
        lines = self.lines
        while lines and not lines[-1].strip():
            lines.pop()
        return lines


class Element:
    __slots__ = ("tag", "hidden", "box", "rows", "count", "down", "gone")

    def __init__(self, tag: str, hidden: bool):
        self.tag, self.hidden = tag, hidden
        self.box: Box | None = None
        self.rows: list[list[tuple[list[str], int, int]] | None] | None = None
        self.count: int | None = None
        self.down = 1
        self.gone = False  # ended while others above it were open


def placed(rows: list[list[tuple[list[str], int, int]] | None]) -> list[list[tuple[int, list[str], int]]]:
    """(column, lines, colspan) of the cells of each row; None starts a row group, where cells from above end."""
    out, below = [], {}
    for r in rows:
        if r is None:
            below = {}
            continue
        covered, below = below, {c: n - 1 for c, n in below.items() if n > 1}
        column, cells = 0, []
        for lines, span, down in r:
            while column in covered:
                column += 1
            cells.append((column, lines, span))
            if down > 1 and len(below) + span <= MAX_COVERED:
                below.update(dict.fromkeys(range(column, column + span), down - 1))
            column += span
        out.append(cells)
    return out


def table_lines(rows: list[list[tuple[list[str], int, int]] | None]) -> list[str]:
    """Rows of (lines, colspan, rowspan) cells as aligned text; columns are two blanks apart, very wide cells are not padded for."""
    width: dict[int, int] = {}
    cells = placed(rows)
    for r in cells:
        for column, lines, span in r:
            if span == 1:
                width[column] = max(width.get(column, 0), min(MAX_PAD, max(map(len, lines), default=0)))
    out = []
    for r in cells:
        for k in range(max((len(lines) for _, lines, _ in r), default=0)):
            parts, at = [], 0
            for column, lines, span in r:
                parts += [" " * width.get(c, 0) for c in range(at, column)]
                room = sum(width.get(c, 0) for c in range(column, column + span)) + 2 * (span - 1)
                parts.append((lines[k] if k < len(lines) else "").ljust(room))
                at = column + span
            out.append("  ".join(parts).rstrip())
    return out


class Page:
    """Tree builder and renderer of one page."""

    def __init__(self):
        root = Element("", False)
        root.box = Box()
        self.stack = [root]
        self.boxes = [root.box]
        self.open: defaultdict[str, list[int]] = defaultdict(list)  # places in the stack by tag
        self.hidden = 0

    def start(self, tag: str, attrs: str) -> None:
        if self.open["head"] and tag not in HEAD_ONLY and tag != "head":
            self._close_to("head")
        if tag in ("html", "body", "head") and self.open[tag]:
            return
        if tag in IMPLIED:
            self._imply(*IMPLIED[tag])
        elif tag in BLOCKS and self.open["p"]:
            self._imply(("p",), ("td", "th", "caption", "table", "button"))
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self._pop()
        if tag in ("td", "th") and self.open["table"] and not self._row():
            self.start("tr", "")
        if tag == "br":
            if not self.hidden:
                self.boxes[-1].turn()
        elif tag in BLOCKS and not self.hidden:
            self.boxes[-1].margin(self._gap(tag))
        if tag in VOID:
            return
        element = Element(tag, tag in HIDDEN or bool(attrs and unseen(attrs)))
        if not self.hidden and not element.hidden:
            if tag == "li" and len(self.boxes) >= MAX_BOXES:
                self.boxes[-1].mark = self._mark(self._number())
            elif tag == "li" or tag in ("td", "th") and self._row():
                element.box = Box()
                self.boxes.append(element.box)
                element.count = self._number() if tag == "li" else self._span(attrs)
                element.down = self._down(attrs) if tag != "li" else 1
            elif tag == "table" and len(self.open["table"]) < MAX_TABLES and len(self.boxes) < MAX_BOXES:
                element.rows = []
            elif tag == "tr" and (table := self._table()) is not None:
                table.append([])
                element.rows = table
            elif tag in ("thead", "tbody", "tfoot") and (table := self._table()) is not None and self._row() is None:
                table.append(None)
            elif tag == "ol":
                element.count = whole(attrs, "start", 1)
        self.open[tag].append(len(self.stack))
        self.stack.append(element)
        self.hidden += element.hidden

    def end(self, tag: str) -> None:
        if tag == "p" and not self.open["p"]:
            self.start("p", "")
        elif tag == "br":
            self.start("br", "")
        if not self.open[tag]:
            return
        if tag in BLOCKS or tag in ("td", "th", "head") or tag in RAW:
            limit = ("table",) if tag in ("tr", "td", "th", "thead", "tbody", "tfoot", "caption") else () if tag == "table" else ("td", "th", "caption")
            if self._last(tag) > self._last(*limit):
                self._close_to(tag)
            return
        e = self.stack[self.open[tag][-1]]  # an inline element ends without its blocks
        self._forget(e)
        e.gone = True
        self._trim()

    def text(self, text: str) -> None:
        if not text:
            return
        if self.open["head"] and not self.open["title"] and text.strip():
            if not any(self.open[t] for t in HEAD_ONLY):
                self._close_to("head")
        if self.hidden:
            return
        text = html.unescape(text) if "&" in text else text
        if self.open["pre"] or self.open["textarea"]:
            self.boxes[-1].keep(text)
        else:
            self.boxes[-1].flow(text)

    def lines(self) -> list[str]:
        while len(self.stack) > 1:
            self._pop()
        return self.boxes[0].done()

    def _gap(self, tag: str) -> int:
        if tag in ("ul", "ol", "menu") and self.open["li"]:
            return 1
        return 2 if tag in SPACED else 1

    def _last(self, *tags: str) -> int:
        """Place of the innermost open element with one of the tags, -1 if there is none."""
        return max((self.open[t][-1] for t in tags if self.open[t]), default=-1)

    def _inner(self, *tags: str) -> Element | None:
        place = self._last(*tags)
        return self.stack[place] if place >= 0 else None

    def _number(self) -> int | None:
        e = self._inner("ol", "ul", "menu")
        if e is None or e.tag != "ol" or e.count is None:
            return None
        e.count += 1
        return e.count - 1

    @staticmethod
    def _mark(number: int | None) -> str:
        return "- " if number is None else f"{number}. "

    @staticmethod
    def _span(attrs: str) -> int:
        return min(1000, max(1, whole(attrs, "colspan", 1)))  # the standard's bound

    @staticmethod
    def _down(attrs: str) -> int:
        rows = whole(attrs, "rowspan", 1)
        return min(65534, rows) if rows > 0 else 65534 if rows == 0 else 1  # 0: to the end of the row group

    def _table(self):
        """Rows of the innermost open table, if it is laid out as one."""
        e = self._inner("table", "td", "th", "caption")
        return e.rows if e and e.tag == "table" else None

    def _row(self):
        """The open row of the innermost table."""
        e = self._inner("tr", "table", "td", "th")
        return e.rows if e and e.tag == "tr" else None

    def _imply(self, closes: tuple[str, ...], limits: tuple[str, ...]) -> None:
        place = self._last(*closes)
        if place > self._last(*limits):
            self._close_to(self.stack[place].tag)

    def _close_to(self, tag: str) -> None:
        while len(self.stack) > 1 and self._pop() != tag:
            pass

    def _forget(self, e: Element) -> None:
        self.open[e.tag].pop()
        self.hidden -= e.hidden

    def _trim(self) -> None:
        while self.stack[-1].gone:
            self.stack.pop()

    def _pop(self) -> str:
        e = self.stack.pop()
        self._forget(e)
        self._trim()
        if e.box is not None:
            self.boxes.pop()
            lines = e.box.done()
            if e.tag == "li":
                if lines:
                    mark = self._mark(e.count)
                    pad = " " * len(mark) if len(self.open["li"]) < MAX_INDENT else ""
                    lines = [mark + lines[0], *((pad + x if x else x) for x in lines[1:])]
                self.boxes[-1].add(lines, 1)
                self.boxes[-1].margin(1)
            elif (rows := self._row()) is not None:
                rows[-1].append((lines, e.count or 1, e.down))
            else:
                self.boxes[-1].add(lines, 1)
        elif e.tag == "table" and e.rows is not None:
            self.boxes[-1].add(table_lines(e.rows), 2)
            self.boxes[-1].margin(2)
        elif e.tag in ("td", "th") and not self.hidden:
            self.boxes[-1].flow(" ")
        elif e.tag in BLOCKS and not self.hidden and not e.hidden:
            self.boxes[-1].margin(self._gap(e.tag))
            if e.tag == "li":
                self.boxes[-1].mark = ""
        return e.tag


def render(page: str | None) -> str:
    """Visible text of a page; null and empty pages give the empty text."""
    builder = Page()
    for kind, value, attrs in tokens(page or ""):
        if kind == "start":
            builder.start(value, attrs)
        elif kind == "end":
            builder.end(value)
        else:
            builder.text(value)
    return "\n".join(builder.lines())


def extract_text(pages: DataFrame, carry: list[str], column: str = "html") -> DataFrame:
    """(row, text) for every row of ``pages``.

    Elements are hidden and end at any depth. List items inside ``MAX_BOXES`` boxes keep their marks
    but do not hang under them; tables there, or inside ``MAX_TABLES`` others, are not aligned.
    """
    chosen = pages.select(row(pages, carry).alias("row"), pages[f"`{column}`"].cast("string").alias("html"))
    out = chosen.drop("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = pa.array([render(x) for x in part.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("row"), texts], ["row", "text"])

    return chosen.mapInArrow(run, f"{_ddl(out)}, text string")
