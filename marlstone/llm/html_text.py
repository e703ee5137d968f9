"""Layout-aware text of HTML pages.

A tree builder adds implied tags and ends; visibility rules leave out what a browser does not show; the renderer
emits all other text: white space collapsed within lines, a blank line between blocks with margins, list items
with bullets or numbers and indentation, table cells padded to aligned columns, preformatted text as it is.

Defined cases: a null or empty page has an empty text; text outside any element is kept; unclosed elements end
with the page, and a tag that never closes is none, as are the characters after its `<`; a drawing's labels stand on
lines of their own, a formula's text stands in its line, without its annotations; an object's fallback is shown, as
it does not load; buttons show their value; cells that span columns or rows leave the places that they cover empty,
columns without any text are left out, and cells wider than WIDEST_CELL are not padded to; elements nested deeper than
DEPTH are flattened, their text kept where it is visible;
repeated rows are rendered each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import common

DEPTH = 150
#: Columns wider than this are not padded.
WIDEST_CELL = 60

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style title template noscript iframe noembed noframes canvas audio video datalist".split())
#: Elements of drawings and formulas that are not shown, or start a line or a cell; elsewhere their names mean nothing.
FOREIGN = {
    "svg": dict.fromkeys("desc defs metadata symbol clippath mask pattern marker".split(), "hidden") | {"text": "block"},
    "math": dict.fromkeys("annotation annotation-xml mphantom".split(), "hidden") | {"mtr": "block", "mlabeledtr": "block", "mtd": "cell"},
    "foreignobject": {},
}
FOREIGN_NAMES = frozenset(name for roles in FOREIGN.values() for name in roles)
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr".split())
BLOCK = MARGIN | frozenset("html body div article section nav header footer main aside address form li dt dd figcaption details summary dialog legend caption tr thead tbody tfoot td th center menu option optgroup select".split())
#: Elements whose start ends an open element of the second set, unless one of the third set lies between.
ENDS = {
    **dict.fromkeys(MARGIN | frozenset("div article section nav header footer main aside address form details center menu dialog".split()), (frozenset(["p"]), frozenset("button table td th caption".split()))),
    "li": (frozenset(["li"]), frozenset("ul ol menu table".split())),
    **dict.fromkeys(("dt", "dd"), (frozenset(["dt", "dd"]), frozenset(["dl", "table"]))),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    **dict.fromkeys(("td", "th"), (frozenset(["td", "th"]), frozenset(["table", "tr"]))),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (frozenset("thead tbody tfoot tr td th caption".split()), frozenset(["table"]))),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "body": (frozenset(["head"]), frozenset()),
}
#: What may stand in a head; any other element or text implies its end.
HEAD = frozenset("head title meta link base script style noscript template".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"[\s/]*(=?[^\s=/>]+)(?:\s*(=)\s*)?")
_SKIP = re.compile(r"[\s/]*")
_UNQUOTED = re.compile(r"[^\s>]*")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "role")

    def __init__(self, tag: str, attrs: dict, role: str = ""):
        self.tag, self.attrs, self.children, self.role = tag, attrs, [], role


def attributes(html: str, at: int) -> tuple[dict[str, str], int, bool]:
    """A tag's attributes, the place after its end (-1 if it has none), and whether it closes itself; it only moves forward."""
    found: dict[str, str] = {}
    while True:
        skipped = _SKIP.match(html, at)
        at = skipped.end()
        if at >= len(html):
            return found, -1, False
        if html[at] == ">":
            return found, at + 1, skipped[0].endswith("/")
        m = _ATTRIBUTE.match(html, at)
        if not m:  # a lone =
            at += 1
            continue
        name, at, value = m[1].lower(), m.end(), ""
        if m[2] and html[at : at + 1] in ('"', "'"):
            end = html.find(html[at], at + 1)
            if end < 0:
                return found, -1, False
            value, at = html[at + 1 : end], end + 1
        elif m[2]:
            bare = _UNQUOTED.match(html, at)
            value, at = bare[0], bare.end()
        found.setdefault(name, unescape(value))


def markup(html: str):
    """(text, tag, attributes, closes itself) for each tag, comment or declaration, and the text after the last.

    tag: its name, with / in front for an end tag; empty for what is no element. The caller may send a place to go on from.
    """
    at = start = 0
    while True:
        at = html.find("<", at)
        if at < 0:
            yield html[start:], "", {}, False
            return
        if html.startswith("<!--", at):
            end = html.find("-->", at + 2)
            end = len(html) if end < 0 else end + 3
            tag, attrs, closed = "", {}, False
        elif html[at + 1 : at + 2] in ("!", "?"):
            end = html.find(">", at)
            end = len(html) if end < 0 else end + 1
            tag, attrs, closed = "", {}, False
        elif m := _TAG.match(html, at):
            attrs, end, closed = attributes(html, m.end())
            if end < 0:
                yield html[start:at], "", {}, False
                return
            tag = m[1] + m[2].lower()
        else:
            at += 1
            continue
        sent = yield html[start:at], tag, attrs, closed
        at = start = end
        if sent:
            # The content of an element whose text is raw: up to its end tag.
            found = re.compile(rf"</{re.escape(sent)}(?=[\s/>])", re.I).search(html, at)
            stop = found.start() if found else len(html)
            yield html[at:stop]
            at = start = stop


def build(html: str) -> Node:
    """The page's tree; strings are text. Implied: the ends of ENDS and of a head, rows around lone cells."""
    root = Node("html", {})
    stack = [root]
    #: Elements below the deepest that are open, yet not on the stack, by tag.
    flat: Counter[str] = Counter()

    def text(source: str) -> None:
        if source:
            if stack[-1].tag == "head" and not source.isspace():
                stack.pop()
            stack[-1].children.append(source)

    parts = markup(html)
    for before, tag, attrs, closed in parts:
        text(unescape(before))
        if tag[:1] == "/":
            tag = tag[1:]
            if flat[tag]:
                flat[tag] -= 1
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    flat.clear()
                    break
                # A cell's content does not end what is around the table.
                if stack[i].tag in ("table", "td", "th") and tag not in ("table", "tr", "thead", "tbody", "tfoot", "body", "html"):
                    break
        elif tag:
            if tag == "html":
                root.attrs |= attrs
                continue
            if stack[-1].tag == "head" and tag not in HEAD:
                stack.pop()
            ended, bound = ENDS.get(tag, ((), ()))
            for i in range(len(stack) - 1, 0, -1) if ended else ():
                if stack[i].tag in ended:
                    cut = i
                    while tag in ("tr", "thead", "tbody", "tfoot") and cut > 1 and stack[cut - 1].tag in ended:
                        cut -= 1
                    del stack[cut:]
                    flat.clear()
                    break
                if stack[i].tag in bound:
                    break
            if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
                row = Node("tr", {})
                stack[-1].children.append(row)
                stack.append(row)
            around = next((n.tag for n in reversed(stack) if n.tag in FOREIGN), "") if tag in FOREIGN_NAMES else ""
            node = Node(tag, attrs, FOREIGN[around].get(tag, "") if around else "")
            stack[-1].children.append(node)
            if tag in VOID or closed and tag not in BLOCK and tag not in RAW:
                continue
            # One hidden element may lie deeper; all in it is hidden with it.
            if len(stack) < DEPTH or len(stack) == DEPTH and not visible(node):
                stack.append(node)
            else:
                flat[tag] += 1
            if tag in RAW:
                source = parts.send(tag)
                text(unescape(source) if tag in ("textarea", "title") else source)
    return root


def button(node: Node) -> str:
    """What an input of the kind of a button shows."""
    kind = node.attrs.get("type", "").lower()
    return node.attrs.get("value", "") if kind in ("button", "submit", "reset") else node.attrs.get("alt", "") if kind == "image" else ""


def visible(node: Node) -> bool:
    attrs = node.attrs
    return node.tag not in HIDDEN and node.role != "hidden" and not ("hidden" in attrs or _UNSEEN.search(attrs.get("style", "")) or node.tag == "input" and not button(node) or node.tag == "dialog" and "open" not in attrs)


def width(text: str) -> int:
    """Columns that a text takes: wide characters take two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Lines:
    """Lines of text with collapsed white space and at most one blank line between blocks."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.blank = False

    def text(self, source: str) -> None:
        if source := _SPACES.sub(" ", source):
            self.parts.append(source)

    def end_line(self, margin: bool = False, forced: bool = False) -> None:
        line = _SPACES.sub(" ", "".join(self.parts)).strip(" ")
        self.parts.clear()
        if line or forced:
            self.add([line])
        self.blank |= margin

    def add(self, lines: list[str]) -> None:
        if self.blank and self.lines and self.lines[-1]:
            self.lines.append("")
        self.blank = False
        self.lines += lines


def render(node: Node, stats: dict[str, int]) -> list[str]:
    """Lines of a block's content."""
    out = Lines()
    _content(node, out, stats)
    out.end_line()
    return out.lines


def _content(node: Node, out: Lines, stats: dict[str, int]) -> None:
    number = 0
    for child in node.children:
        if isinstance(child, str):
            out.text(child)
            continue
        tag = child.tag
        if not visible(child):
            continue
        if tag == "br":
            out.end_line(forced=True)
        elif tag == "input":
            out.text(f" {button(child)} ")
        elif tag == "table":
            out.end_line(margin=True)
            stats["n_tables"] += 1
            out.add(_table(child, stats))
            out.blank = True
        elif tag == "pre":
            out.end_line(margin=True)
            out.add(_flat(child).strip("\n").split("\n"))
            out.blank = True
        elif tag == "li":
            number = int(child.attrs.get("value", "")) if re.fullmatch(r"\d{1,9}", child.attrs.get("value", "")) else number + 1
            mark = f"{number}. " if node.tag == "ol" else "- "
            out.end_line()
            stats["n_items"] += 1
            lines = [x for x in render(child, stats)] or [""]
            out.add([(mark if i == 0 else " " * len(mark)) + x if x or i == 0 else "" for i, x in enumerate(lines)])
        elif child.role == "block":
            out.end_line()
            _content(child, out, stats)
            out.end_line()
        elif child.role == "cell":
            out.text(" ")
            _content(child, out, stats)
            out.text(" ")
        elif tag in BLOCK:
            out.end_line(margin=tag in MARGIN)
            if tag in ("ul", "ol", "blockquote", "dd") and node.tag != "li":
                indent = "" if tag in ("ul", "ol") else "  "
                lines = render(child, stats)
                if lines:
                    out.add([indent + x if x else x for x in lines])
            elif tag in ("ul", "ol"):
                out.blank = False
                out.add(render(child, stats))
            else:
                _content(child, out, stats)
                out.end_line()
            out.blank |= tag in MARGIN and not (tag in ("ul", "ol") and node.tag == "li")
        else:
            _content(child, out, stats)


def _flat(node: Node) -> str:
    return "".join(c if isinstance(c, str) else "\n" if c.tag == "br" else _flat(c) if visible(c) else "" for c in node.children)


def _table(table: Node, stats: dict[str, int]) -> list[str]:
    """The table's rows, cells one above the other; captions and stray text come first."""
    lines, rows, todo = [], [], [iter(table.children)]
    covered: list[tuple[int, int, int]] = []  # columns from and to that a cell from above still covers, and for how many rows
    while todo:
        child = next(todo[-1], None)
        if child is None:
            todo.pop()
        elif isinstance(child, str):
            if text := _SPACES.sub(" ", child).strip():
                lines.append(text)
        elif not visible(child):
            continue
        elif child.tag in ("thead", "tbody", "tfoot", "colgroup"):
            todo.append(iter(child.children))
        elif child.tag == "tr":
            cells, covered = _row(child, covered, stats)
            if cells:
                rows.append(cells)
        else:
            lines += render(_wrap(child), stats)
    # Of the columns that spans make, those count that hold text.
    place = {column: i for i, column in enumerate(sorted({c for cells in rows for c in cells}))}
    widest = [0] * len(place)
    for cells in rows:
        for column, cell in cells.items():
            widest[place[column]] = max(widest[place[column]], *(width(x) for x in cell if width(x) <= WIDEST_CELL), 0)
    for cells in rows:
        own = [[]] * (place[max(cells)] + 1)
        for column, cell in cells.items():
            own[place[column]] = cell
        for k in range(max(map(len, own))):
            line = [c[k] if k < len(c) else "" for c in own]
            lines.append(" | ".join(x + " " * (widest[i] - width(x)) for i, x in enumerate(line)).rstrip(" |" if not line[-1] else " "))
    return lines


def _span(node: Node, name: str, most: int) -> int:
    """1000 columns and 65534 rows are the most that a cell may span."""
    value = node.attrs.get(name, "")
    return min(int(value), most) if re.fullmatch(r"0*[1-9]\d{0,8}", value) else 1


def _row(row: Node, covered: list[tuple[int, int, int]], stats: dict[str, int]) -> tuple[dict[int, list[str]], list[tuple[int, int, int]]]:
    """The lines of each column's cell that has any, and what is covered below; columns that are covered stay empty."""
    cells: dict[int, list[str]] = {}
    at, nearest, below = 0, 0, []
    for cell in row.children:
        across = down = 1
        if isinstance(cell, str):
            if not (text := _SPACES.sub(" ", cell).strip()):
                continue
            lines = [text]
        elif visible(cell):
            own = cell.tag in ("td", "th")
            lines = render(cell if own else _wrap(cell), stats)
            if own:
                across, down = _span(cell, "colspan", 1000), _span(cell, "rowspan", 65534)
        else:
            continue
        while nearest < len(covered) and covered[nearest][0] <= at:
            at = max(at, covered[nearest][1])
            nearest += 1
        if lines:
            cells[at] = lines
        if down > 1:
            below.append((at, at + across, down - 1))
        at += across
    left = [(start, end, rows - 1) for start, end, rows in covered if rows > 1]
    return cells, sorted(left + below) if below else left


def _wrap(node: Node) -> Node:
    around = Node("div", {})
    around.children.append(node)
    return around


def page_text(html: str | None) -> tuple[str, dict[str, int]]:
    """The page's visible text, and how many tables and list items it has."""
    stats = {"n_tables": 0, "n_items": 0}
    lines = render(build(html or ""), stats)
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines).lstrip("\n"), stats


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id_col, text, n_chars, n_lines, n_tables, n_items of every row."""

    def run(batches):
        for batch in common.slices(batches, 128):
            done = [page_text(h) for h in batch.column(1).to_pylist()]
            counts = ([len(t) for t, _ in done], [t.count("\n") + bool(t) for t, _ in done], [s["n_tables"] for _, s in done], [s["n_items"] for _, s in done])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in done], pa.string()), *(pa.array(c, pa.int64()) for c in counts)], names=["id", "text", "n_chars", "n_lines", "n_tables", "n_items"])

    plain = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(run, f"id {kind}, text string, n_chars long, n_lines long, n_tables long, n_items long").withColumnRenamed("id", id_col)


def op3_layout_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
