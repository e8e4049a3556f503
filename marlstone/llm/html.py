"""Layout-aware text of web pages.

A tokenizer and a tree builder with implied tags make a tree of a page; visibility rules leave parts of it out; a renderer walks the rest and writes
all visible text: blocks apart from each other, lists with marks and indents, preformatted text as it stands, and tables with aligned columns.

Tree: p, li, dt, dd, option, tr, td, th, thead, tbody and so on are closed when what follows implies their end; a block closes an open p;
cells without a row get one; an end tag closes up to its element if that is open within the same table cell, and is left out
otherwise; formatting elements may stay open across blocks; void elements have no content; script, style, textarea and title hold raw text;
comments and declarations are left out. Elements may nest as deep as a page has them.

Visibility: head, script, style, noscript, template, iframe, object, svg, canvas, audio, video, select, textarea, dialog without open, and elements with the
attribute hidden, or a style of display: none or visibility: hidden, give no text; nor do the contents of a closed details beyond its
summary. Everything else does, navigation and footers too.

Defined cases: a null page gives a null text, an empty one an empty text; a tag cut off at the end is left out; unknown entities stand as they are;
repeated rows give equal texts; an empty table gives no rows; columns other than page_id and html are ignored.
"""

from __future__ import annotations

import html as entities
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bound_batches, table

VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
UNSEEN = frozenset("head title script style noscript template iframe object svg canvas audio video select datalist textarea noembed noframes meta link base param".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul xmp".split())
#: Blocks with an empty line before and after them.
SPACED = frozenset("article blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre section table ul listing xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag closes, looking up to one of the elements after it.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "caption": ({"caption", "colgroup"}, {"table"}), "body": ({"head"}, {"html"}), "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}),
}
CLOSES_P = (BLOCK - {"body", "html", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}) | {"table"}
#: Elements that an end tag or an implied end does not reach beyond.
WALLS = frozenset({"table", "td", "th", "caption", "html", "template", "button", "object"})
TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|<([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACES = re.compile("[ \t\n\f\r]+")
HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []


def attributes_of(text: str) -> dict[str, str]:
    if not text or text.isspace() or text == "/":
        return {}
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), entities.unescape(a or b or c))
    return out


#: Most columns and rows that a cell spans, by the standard.
MOST_ACROSS, MOST_DOWN = 1000, 65534


@contextmanager
def deep_calls(most: int) -> Iterator[None]:
    """Calls may nest most deep for a while: they follow the page's own depth, and calls of Python by Python take no machine stack."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, most))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


class TreeBuilder:
    def __init__(self):
        self.root = Node("#root")
        self.open = [self.root]
        self.opened: Counter[str] = Counter()  # how many elements of each name are open
        self.deepest = 1

    def _close_to(self, at: int) -> None:
        for node in self.open[at:]:
            self.opened[node.tag] -= 1
        del self.open[at:]

    def _any(self, tags) -> bool:
        return any(self.opened[t] > 0 for t in tags)

    def _find(self, tags, walls) -> int:
        """The place of the nearest open element of tags, not looking past a wall; 0 where there is none."""
        for k in range(len(self.open) - 1, 0, -1) if self._any(tags) else ():
            if self.open[k].tag in tags:
                return k
            if self.open[k].tag in walls:
                return 0
        return 0

    def _imply(self, tag: str) -> None:
        if tag in CLOSES_P and (k := self._find({"p"}, WALLS)):
            self._close_to(k)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self._close_to(len(self.open) - 1)
        if tag in IMPLIED:
            ends, walls = IMPLIED[tag]
            lowest = 0
            for k in range(len(self.open) - 1, 0, -1) if self._any(ends) else ():
                if self.open[k].tag in ends:
                    lowest = k
                elif self.open[k].tag in walls:
                    break
            if lowest:
                self._close_to(lowest)
        if tag in ("td", "th") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._push(Node("tr"))

    def _push(self, node: Node) -> None:
        self.open[-1].children.append(node)
        self.open.append(node)
        self.opened[node.tag] += 1
        self.deepest = max(self.deepest, len(self.open))

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        self._imply(tag)
        node = Node(tag, attributes)
        if tag in VOID:
            self.open[-1].children.append(node)
        else:
            self._push(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {})
        elif tag == "p" and not self._find({"p"}, WALLS):
            self.open[-1].children.append(Node("p"))
        else:
            walls = WALLS - {tag} if tag not in ("tr", "thead", "tbody", "tfoot") else {"table", "html"}
            if tag in ("table", "html", "body", "td", "th", "caption", "button", "object", "template"):
                walls = {"table"} - {tag}
            k = self._find({tag}, walls)
            if k:
                self._close_to(k)

    def text(self, text: str) -> None:
        self.open[-1].children.append(text)


def parse(page: str) -> TreeBuilder:
    """The tree of a page, in its builder."""
    builder, at, n = TreeBuilder(), 0, len(page)
    while at < n:
        found = TOKEN.search(page, at)
        begin = found.start() if found else n
        if begin > at:
            builder.text(entities.unescape(page[at:begin]))
        if not found:
            break
        at = found.end()
        if found[1]:
            builder.end(found[1].lower())
        elif found[2] and found[4]:
            tag, rest = found[2].lower(), found[3]
            builder.start(tag, attributes_of(rest))
            if tag in RAW:
                close = re.compile(f"</{tag}[\\s/>]", re.I).search(page, at)
                stop = close.start() if close else n
                if stop > at:
                    builder.text(entities.unescape(page[at:stop]) if tag in ("title", "textarea") else page[at:stop])
                if close:
                    end = page.find(">", stop)
                    at = n if end < 0 else end + 1
                    builder.end(tag)
                else:
                    at = n
            elif rest.endswith("/") and tag not in VOID and tag in ("svg", "path", "g", "use", "circle", "rect"):
                builder.end(tag)
    return builder


def unseen(node: Node) -> bool:
    a = node.attributes
    if node.tag in UNSEEN or "hidden" in a and a["hidden"].lower() != "until-found":
        return True
    if node.tag == "dialog" and "open" not in a or node.tag == "input":
        return True
    return "style" in a and bool(HIDING.search(a["style"]))


def width(text: str) -> int:
    """Columns of a text: wide characters count 2, combining ones 0."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Page:
    """Lines written so far. A gap is the number of line ends due before the next text."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap, self.space, self.prefix = 0, False, ""

    def break_line(self, lines: int) -> None:
        if self.now:
            self.lines.append((self.prefix + "".join(self.now)).rstrip(" "))
            self.now = []
        self.space = False
        self.gap = max(self.gap, lines)

    def line_end(self) -> None:
        """A forced line end, as of br."""
        if self.now:
            self.break_line(1)
        elif self.lines and self.gap < 2:
            self.gap = 2

    def write(self, text: str) -> None:
        words = SPACES.split(text)
        if len(words) > 1 and not words[0]:
            self.space = True
        body = " ".join(w for w in words if w)
        if not body:
            return
        self._open()
        self.now.append(" " + body if self.space and self.now else body)
        self.space = not words[-1]

    def write_raw(self, text: str) -> None:
        for k, line in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if k:
                if self.now:
                    self.break_line(1)
                else:
                    self._open()
                    self.lines.append("")
            if line:
                self._open()
                self.now.append(line)

    def _open(self) -> None:
        if not self.now and self.gap:
            if self.lines:
                self.lines += [""] * (self.gap - 1)
            self.gap = 0

    def text(self) -> str:
        self.break_line(0)
        return "\n".join(self.lines)


def rendered(node: Node, page: Page, raw: bool = False) -> None:
    """Write a node's visible text."""
    numbers = 0
    if node.tag == "ol":
        start = node.attributes.get("start", "1")
        numbers = int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1
    closed = node.tag == "details" and "open" not in node.attributes
    for child in node.children:
        if isinstance(child, str):
            if node.tag in ("table", "thead", "tbody", "tfoot", "tr", "ul", "ol") and not child.strip():
                continue
            if not closed:
                page.write_raw(child) if raw else page.write(child)
            continue
        tag = child.tag
        if unseen(child) or closed and tag != "summary":
            continue
        if tag == "br":
            page.line_end()
        elif tag == "hr":
            page.break_line(2)
        elif tag == "img":
            continue
        elif tag == "table":
            page.break_line(2)
            for line in table_lines(child):
                page.write_raw(line)
                page.break_line(1)
            page.break_line(2)
        elif tag == "li":
            page.break_line(1)
            mark = f"{numbers}. " if node.tag == "ol" else "- "
            numbers += 1
            rendered_item(child, page, raw, mark)
        elif tag in BLOCK:
            lines = 2 if tag in SPACED and not (tag in ("ul", "ol") and node.tag in ("li", "ul", "ol")) else 1
            page.break_line(lines)
            outer = page.prefix
            if tag in ("blockquote", "dd"):
                page.prefix += "  "
            rendered(child, page, raw or tag in ("pre", "listing", "xmp"))
            page.break_line(lines)
            page.prefix = outer
        elif tag == "wbr":
            continue
        else:
            rendered(child, page, raw)


def rendered_item(item: Node, page: Page, raw: bool, mark: str) -> None:
    """A list item: its first line has the mark, the others stand under its text."""
    own = Page()
    rendered(item, own, raw)
    own.break_line(0)
    for k, line in enumerate(own.lines):
        page._open()
        lead = mark if k == 0 else " " * len(mark)
        page.lines.append((page.prefix + lead + line if line else "").rstrip(" "))
    if own.lines:
        page.gap = max(page.gap, 1)


def rows_of(node: Node) -> Iterator[tuple[str, Node]]:
    """The caption and the rows of a table, or other content in it, in order."""
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                other = Node("#text")
                other.children.append(child)
                yield "other", other
        elif unseen(child):
            continue
        elif child.tag in ("thead", "tbody", "tfoot"):
            yield from rows_of(child)
        elif child.tag == "tr":
            yield "row", child
        elif child.tag not in ("colgroup", "col"):
            yield "other", child


def inside(node: Node) -> list[str]:
    page = Page()
    rendered(node, page)
    return page.text().split("\n") if page.lines or page.now else []


def table_lines(node: Node) -> list[str]:
    """A table's lines: columns padded to their widest cell and parted by " | "; cells that span columns take their widths together."""
    out: list[str] = []
    rows: list[list[tuple[int, int, list[str]]]] = []
    below: dict[int, int] = {}  # columns that a cell above still takes
    for kind, part in rows_of(node):
        if kind == "other":
            out += inside(part)
            continue
        cells, at = [], 0
        taken = dict(below)
        below = {c: n - 1 for c, n in below.items() if n > 1}
        for cell in part.children:
            if isinstance(cell, str) and not cell.strip() or not isinstance(cell, str) and unseen(cell):
                continue
            while at in taken:
                at += 1
            holder = cell
            if isinstance(cell, str):
                holder = Node("#text")
                holder.children.append(cell)
            span = [int(holder.attributes[k]) if re.fullmatch("[0-9]{1,9}", holder.attributes.get(k, "")) else 1 for k in ("colspan", "rowspan")]
            # a rowspan of 0 reaches to the end
            across, down = max(1, min(span[0], MOST_ACROSS)), min(span[1], MOST_DOWN) or MOST_DOWN
            cells.append((at, across, inside(holder)))
            for c in range(at, at + across):
                if down > 1:
                    below[c] = down - 1
            at += across
        rows.append(cells)
    widths: dict[int, int] = {}
    for cells in rows:
        for at, across, lines in cells:
            if across == 1:
                widths[at] = max(widths.get(at, 0), max(map(width, lines), default=0))
    for cells in rows:
        for at, across, lines in cells:
            if across > 1:
                have = sum(widths.get(c, 0) for c in range(at, at + across)) + 3 * (across - 1)
                short = max(map(width, lines), default=0) - have
                if short > 0:
                    widths[at + across - 1] = widths.get(at + across - 1, 0) + short
    for cells in rows:
        tall = max((len(lines) for _, _, lines in cells), default=0)
        for k in range(tall):
            parts, column = [], 0
            for at, across, lines in cells:
                while column < at:
                    parts.append(" " * widths.get(column, 0))
                    column += 1
                room = sum(widths.get(c, 0) for c in range(at, at + across)) + 3 * (across - 1)
                text = lines[k] if k < len(lines) else ""
                parts.append(text + " " * (room - width(text)))
                column += across
            out.append(" | ".join(parts).rstrip(" "))
    return out


def page_text(page: str | None) -> str | None:
    """The visible text of a page."""
    if page is None:
        return None
    out, built = Page(), parse(page)
    with deep_calls(1000 + 8 * built.deepest):
        rendered(built.root, out)
    return out.text()


def extracted(pages: DataFrame) -> DataFrame:
    """page_id and text of every row of pages."""
    bound_batches(pages.sparkSession, 500)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text(h) for h in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), pa.array(texts, pa.string())], names=["page_id", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "html").mapInArrow(read, f"page_id {kind}, text string")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of all pages."""
    return extracted(table(spark, sf_dir, "pages"))
