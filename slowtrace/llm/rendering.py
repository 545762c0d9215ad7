"""Visible text of HTML pages, laid out by block.

A page is read into a tree (closing tags that authors may leave out are implied), hidden parts are cut off, and the
rest is rendered: blocks on lines of their own with their spacing, list items with their marks, table cells in
columns. All visible text is kept, navigation and footers too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: elements by what they do, as the HTML standard has them
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
UNSEEN = frozenset("script style head title template noscript iframe noembed noframes object audio video canvas "
                   "datalist select meta link base xmp area param source track".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p "
                  "pre search section summary table ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre figure table fieldset form menu dir".split())
SECTIONS = frozenset("thead tbody tfoot".split())
FOREIGN = frozenset("svg math".split())
# not drawn inside them; definitions of a drawing may be, and stay
UNDRAWN = frozenset("desc metadata annotation annotation-xml".split())
# an open element that ends where one of these begins
IMPLIED_END = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", *SECTIONS), "td": ("td", "th", "tr", *SECTIONS),
    "th": ("td", "th", "tr", *SECTIONS), "thead": tuple(SECTIONS), "tbody": tuple(SECTIONS), "tfoot": tuple(SECTIONS),
    "option": ("option", "optgroup"), "optgroup": ("optgroup",), "head": ("body",), "rt": ("rt", "rp"), "rp": ("rt", "rp"),
    "caption": ("tr", "td", "th", *SECTIONS), "colgroup": ("tr", "td", "th", "caption", "colgroup", *SECTIONS),
}
ENDS_P = BLOCK - {"html", "body", "legend", "summary", "option", "optgroup", "caption", "li", "dd", "dt"} | {"li", "dd", "dt"}
# how far up an implied end may look
SCOPE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",)}
# --- end of fixed values

_SPANNED = ("td", "th", "tr", "caption", "colgroup")
# by tag that begins: what it ends, and what keeps it from looking further up
_ENDS = {tag: frozenset(mine for mine, tags in IMPLIED_END.items() if tag in tags)
         for tag in {t for tags in IMPLIED_END.values() for t in tags}}
_STOPS = {tag: frozenset({"table", *SCOPE.get(tag, ()), *(BLOCK - {"p", "div", "address"} if tag in SCOPE else ())}) - ends
          for tag, ends in _ENDS.items()}

_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
_HIDDEN_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\s*(?:!\s*important\s*)?(?:;|$)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []

    def hidden(self) -> bool:
        a = self.attributes
        return (self.tag in UNSEEN or "hidden" in a and a["hidden"].lower() != "until-found"
                or self.tag == "input" and a.get("type", "").lower() == "hidden"
                or self.tag == "dialog" and "open" not in a
                or "style" in a and _HIDDEN_STYLE.search(a["style"]) is not None)


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), unescape(next(filter(None, values), "")))
    return found


def tree(html: str) -> Node:
    """The element tree of a page; never fails, whatever is missing or left open."""
    root = Node("#root")
    open_: list[Node] = [root]
    places: dict[str, list[int]] = {}  # depths of the open elements of each tag: no scan of what is open

    def push(node: Node) -> None:
        places.setdefault(node.tag, []).append(len(open_))
        open_.append(node)

    def close_to(depth: int) -> None:
        while len(open_) > depth:
            places[open_.pop().tag].pop()

    def last(*tags: str) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close_implied(tag: str) -> None:
        if tag in ENDS_P and last("p") > last("td", "th", "table", "caption", "button"):
            close_to(last("p"))
        while tag in _ENDS and (depth := last(*_ENDS[tag])) > last(*_STOPS[tag]):
            mine = open_[depth].tag
            close_to(depth)
            if mine not in _SPANNED:
                break

    def open_row() -> None:
        """A cell in a table or section without a row opens one; what is open between ends."""
        depth = last("table", *SECTIONS)
        if depth > last("tr", "td", "th", "caption") and places.get("table") and places["table"][0] <= depth:
            close_to(depth + 1)
            row = Node("tr")
            open_[-1].children.append(row)
            push(row)

    at = 0
    while at < len(html):
        begin = html.find("<", at)
        found = _TAG.match(html, begin) if begin >= 0 else None
        if begin < 0 or found is None:
            end = len(html) if begin < 0 else begin + 1
            open_[-1].children.append(unescape(html[at:end]))
            at = end
            continue
        if begin > at:
            open_[-1].children.append(unescape(html[at:begin]))
        at = found.end()
        closing, tag = found.group(1), found.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if depth := last(tag):
                # a cell's content does not close what lies around its table
                if tag in ("table", "body", "html") or last("table") <= depth:
                    close_to(depth)
            elif tag == "p":
                open_[-1].children.append(Node("p"))
            elif tag == "br":
                open_[-1].children.append(Node("br"))
            continue
        close_implied(tag)
        if tag in ("td", "th"):
            open_row()
        foreign = tag in FOREIGN or last(*FOREIGN) > 0
        node = Node(tag, _attributes(found.group(3)) if found.group(3).strip(" \t\r\n\f/") else None)
        if foreign and tag in UNDRAWN:
            node.attributes["hidden"] = ""
        open_[-1].children.append(node)
        if foreign and found.group(3).endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at) if tag != "plaintext" else None
            raw = html[at:end.start() if end else len(html)]
            node.children.append(unescape(raw) if tag in ("textarea", "title") else raw)
            at = end.end() if end else len(html)
        elif tag not in VOID:
            push(node)
    return root


class _Page:
    """Lines so far. ``gap`` is the number of line ends that must come before the next text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap, self.space = 0, False

    def text(self, text: str) -> None:
        words = _SPACE.sub(" ", text)
        if words != " " and words:
            self._open()
            if words[0] == " " or self.space:
                if self.line and not self.line[-1].endswith((" ", "\n")):
                    self.line.append(" ")
            self.line.append(words.strip(" "))
            self.space = words[-1] == " "
        elif words:
            self.space = self.space or bool(self.line)

    def kept(self, text: str) -> None:
        """Preformatted text."""
        first, *rest = text.split("\n")
        if first:
            self._open()
            self.line.append(first)
        for line in rest:
            self.end()
            if line:
                self.line.append(line)

    def _open(self) -> None:
        if self.gap and (self.lines or self.line):
            if self.line:
                self.end()
            self.lines += [""] * (self.gap - 1)
        self.gap = 0

    def end(self) -> None:
        self.lines.append("".join(self.line).rstrip(" "))
        self.line, self.space = [], False

    def block(self, gap: int) -> None:
        if self.line:
            self.end()
        self.space = False
        self.gap = max(self.gap, gap)

    def done(self) -> list[str]:
        if self.line:
            self.end()
        return self.lines


def _parts(table: Node, into: tuple[str, ...]) -> Iterator[Node | str]:
    """What lies in a table and, in its place, what lies in its elements ``into``, however deep; nothing hidden."""
    work = [iter(table.children)]
    while work:
        child = next(work[-1], None)
        if child is None:
            work.pop()
        elif isinstance(child, str):
            yield child
        elif not child.hidden():
            if child.tag in into:
                work.append(iter(child.children))
            else:
                yield child


def _rows(table: Node) -> Iterator[Node]:
    return (n for n in _parts(table, tuple(SECTIONS)) if isinstance(n, Node) and n.tag == "tr")


def _loose(table: Node) -> Iterator[Node | str]:
    """What lies in a table or its sections outside of rows."""
    return (n for n in _parts(table, (*SECTIONS, "colgroup"))
            if (n.strip() if isinstance(n, str) else n.tag not in ("tr", "col")))


def _number(text: str, default: int) -> int:
    digits = re.match(r"\s*(-?\d{1,6})", text)
    return int(digits.group(1)) if digits else default


def _table(page: _Page, table: Node, cap: int) -> Iterator[Iterator]:
    """Lay a table out in columns; yields what must be rendered first. Columns without any text take no room."""
    grid: list[dict[int, list[str]]] = []
    held: list[list[int]] = []  # [first column, column behind, rows left] of cells that reach down
    for child in _loose(table):
        yield _render(page, child)
        page.block(1)
    for row in _rows(table):
        cells: dict[int, list[str]] = {}
        taken, reaching, x = sorted(h[:2] for h in held), [], 0
        for cell in row.children:
            if isinstance(cell, str) and not cell.strip() or isinstance(cell, Node) and cell.hidden():
                continue
            while taken and taken[0][0] <= x:
                x = max(x, taken.pop(0)[1])
            inner = _Page()
            is_cell = isinstance(cell, Node) and cell.tag in ("td", "th")
            for child in cell.children if is_cell else [cell]:
                yield _render(inner, child)
            cells[x] = inner.done() or [""]
            wide = min(max(_number(cell.attributes.get("colspan", ""), 1), 1), 1000) if is_cell else 1
            high = min(max(_number(cell.attributes.get("rowspan", ""), 1), 1), 1000) if is_cell else 1
            if high > 1:
                reaching.append([x, x + wide, high - 1])
            x += wide
        held = [[a, b, rows - 1] for a, b, rows in held if rows > 1] + reaching
        grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        for x, lines in cells.items():
            widths[x] = max(widths.get(x, 0), min(cap, max(map(len, lines), default=0)))
    columns = sorted(x for x, width in widths.items() if width)
    offsets = dict(zip(columns, accumulate((widths[x] + 2 for x in columns), initial=0), strict=False))
    for cells in grid:
        shown = [(offsets[x], lines) for x, lines in sorted(cells.items()) if x in offsets]
        for i in range(max((len(lines) for _, lines in shown), default=0)):
            line = ""
            for at, lines in shown:
                if i < len(lines) and lines[i].rstrip(" "):
                    line += " " * max(at - len(line), 2 if line else 0) + lines[i]
            if line := line.rstrip():
                page._open()
                page.line.append(line)
                page.end()
    page.block(1)


def _render(page: _Page, node: Node | str, pre: bool = False, list_: list | None = None) -> Iterator[Iterator]:
    # a stack of its own instead of recursion, and tables are yielded: pages may nest without bound
    work: list = [(node, pre, list_)]
    while work:
        item = work.pop()
        if callable(item):
            item()
            continue
        node, pre, list_ = item
        if isinstance(node, str):
            page.kept(node) if pre else page.text(node)
            continue
        if node.hidden():
            continue
        tag = node.tag
        if tag == "br":
            page._open()
            page.end()
            continue
        if tag == "hr":
            page.block(1)
            continue
        if tag == "img":
            if alt := node.attributes.get("alt", "").strip():
                page.text(alt)
            continue
        if tag == "input":
            if node.attributes.get("type", "text").lower() in ("submit", "button", "reset"):
                page.text(node.attributes.get("value", ""))
            continue
        if tag == "table":
            page.block(2)
            yield _table(page, node, cap=60)
            page.block(2)
            continue
        if tag in BLOCK:
            gap = 1 if list_ is not None and tag in ("ul", "ol") else 2 if tag in SPACED else 1
            page.block(gap)
            if tag == "li":
                depth, ordered, number = (list_ or [0, False, 0])
                if list_ is not None and ordered:
                    list_[2] = _number(node.attributes.get("value", ""), number)
                    mark = f"{list_[2]}. "
                    list_[2] += 1
                else:
                    mark = "- "
                page._open()
                page.line.append("  " * min(max(depth - 1, 0), 20) + mark)  # bounded, so that long lists in lists stay linear
            work.append(lambda gap=gap: page.block(gap))
        elif tag in ("td", "th", "text"):  # cells outside of tables, texts of drawings
            work.append(lambda: page.text(" "))
        if tag in ("ul", "ol", "menu", "dir"):
            list_ = [(list_[0] if list_ else 0) + 1, tag == "ol", _number(node.attributes.get("start", ""), 1)]
        closed = tag == "details" and "open" not in node.attributes
        for child in reversed(node.children):
            if not closed or isinstance(child, Node) and child.tag == "summary":
                work.append((child, pre or tag in ("pre", "textarea"), list_))


def render(html: str) -> str:
    """Visible text of one page."""
    page = _Page()
    work = [_render(page, tree(html))]
    while work:
        inner = next(work[-1], None)
        if inner is None:
            work.pop()
        else:
            work.append(inner)
    return "\n".join(page.done()).strip("\n")


def extract_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the visible text in ``out``; a null page stays null, an empty one gives an empty text.

    Each row stands for itself: repeated rows give repeated results, other columns stay as they are. Long and deeply
    nested pages take time in proportion to their length.
    """
    @F.arrow_udf("string")
    def rendered(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if h is None else render(h) for h in batch.to_pylist()], pa.string())

    return pages.withColumn(out, rendered(F.col(html)))
