"""Layout-aware rendering of HTML to text.

A tokenizer cuts the page into tags, comments and character data; a builder keeps the stack of open elements, with
implied ends (a paragraph ends where a block begins, a list item where the next one does, table parts likewise, a head
at the first text or tag that may not stand in it) and ignores ends that match nothing. What is never shown is left out:
heads, scripts, styles, templates, ``hidden`` elements, and inline styles that hide (what ``visibility`` hides may be shown
again within; ``aria-hidden`` hides nothing from sight); of a list of choices all but the one that it shows, but all where it shows
several; of a drawing (``svg``) all but ``text`` and ``foreignObject`` elements, and these in definitions; of a
formula (``math``) annotations and phantoms. All other text is emitted, so none that a reader would see is lost: white space
collapses outside ``pre``, blocks are set apart by line ends, paragraphs, headings, lists and tables by an empty line, line
breaks after the first in a row each give one, list items are marked and indented by depth, and cells of a table are aligned
in columns, those that span several columns or rows included (empty lines within cells are left out). A column is as wide
as its widest cell, at any width; only where blanks would be more than ``PADDING`` times a table's text do cells of over
``WIDE`` characters not widen theirs.

A null page gives null, an empty one "". Pages may be broken anywhere, and of any length. Rows stand for themselves;
columns are kept, whatever their names, but for ``text``, which is added.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript iframe object datalist canvas audio video title".split())
RAW = frozenset("script style textarea title iframe noscript xmp".split())
#: Parts that aren't shown of a drawing, whose other text stands in the elements SHOWN, and of a formula.
IN_SVG = frozenset("defs symbol clippath mask pattern marker desc metadata".split())
SHOWN = frozenset("text foreignobject".split())
IN_MATH = frozenset("annotation annotation-xml mphantom".split())
#: Tags that end a drawing.
ENDS_SVG = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Tags that may stand in a head; any other, and text, ends it.
IN_HEAD = frozenset("base link meta title style script template noscript".split())
#: Blocks that are set apart by an empty line, and by a line end.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr".split())
BLOCK = SPACED | frozenset("address article aside body center details dialog dd div dt fieldset figcaption footer form header hgroup html legend li main menu nav optgroup option search section summary tbody tfoot thead tr caption".split())
LISTS = frozenset("ul ol menu".split())
#: Ends that a tag implies: the open elements that it closes, and those beyond which it doesn't look.
IMPLIED = {
    "li": (frozenset({"li"}), LISTS | {"table"}),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl", "table"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl", "table"})),
    "tr": (frozenset({"tr", "td", "th", "caption"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "thead": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}), frozenset({"table"})),
    "tbody": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}), frozenset({"table"})),
    "tfoot": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
    "body": (frozenset({"head", "title"}), frozenset()),
}
ENDS_P = BLOCK - {"html", "body", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"}
P_SCOPE = frozenset("table td th button caption foreignobject".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
BEGUN = re.compile(r"</?[a-zA-Z]")
HIDING = re.compile(r"(?<![\w-])display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*(visible|hidden|collapse)", re.I)
MAY_HIDE = re.compile(r"hidden|style", re.I)
ENDS_SELECT = re.compile(r"</?select(?=[\s/>])[^>]*>|(?=<(?:input|textarea|button)[\s/>])|\Z", re.I)
OPTION = re.compile(r"<option(?=[\s/>])((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>((?:(?!</?(?:option|optgroup|select)[\s/>]).)*)", re.I | re.S)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|</?[a-zA-Z][^>]*>", re.S)
#: Blanks that a table may have for each character of its text, and the width of columns where it would have more.
PADDING, WIDE = 16, 60
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
START = re.compile(r"\s*(-?\d{1,9})")
SPACE = re.compile(r"[ \t\n\r\f]+")


def attributes(rest: str) -> dict[str, str]:
    """Names, in lower case, and values of a tag's attributes; of those named alike the first."""
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(rest):
        out.setdefault(name.lower(), html.unescape("".join(values)))
    return out


def _hides(rest: str) -> tuple[bool, str]:
    """Whether a tag's attributes hide its element, and what they set its visibility to (``type=hidden`` is of inputs alone, which hold no text)."""
    if not MAY_HIDE.search(rest):
        return False, ""
    given = attributes(rest)
    style = given.get("style", "")
    set_to = VISIBILITY.findall(style)
    return "hidden" in given or bool(HIDING.search(style)), set_to[-1].lower() if set_to else ""


def _chosen(rest: str, inside: str) -> str:
    """What a list of choices shows: the last selected one, else the first; all of a list that shows several."""
    options = [(attributes(x) if x.strip() else {}, html.unescape(TAG.sub("", text)).strip()) for x, text in OPTION.findall(inside)]
    given = attributes(rest) if rest.strip() else {}
    size = START.match(given.get("size", ""))
    options = [(own, own["label"] if own.get("label") else text) for own, text in options if "hidden" not in own]
    if "multiple" in given or size and int(size[1]) > 1:
        return " ".join(text for _, text in options)
    selected = [text for own, text in options if "selected" in own] or [text for own, text in options if "disabled" not in own][:1] or [text for _, text in options][:1]
    return selected[-1] if selected else ""


def _span(given: dict[str, str], name: str, most: int) -> int:
    found = START.match(given.get(name, ""))
    return min(most, int(found[1])) if found and int(found[1]) >= 0 else 1


class Text:
    """Lines of one flow of text: the page's, or a cell's."""

    __slots__ = ("lines", "line", "blank", "breaks", "gap", "mark")

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank, self.breaks, self.gap, self.mark = False, 0, False, ""

    def add(self, text: str, pre: bool, indent: str) -> None:
        if not text:
            return
        if pre:
            first, *rest = text.split("\n")
            self._put(first, indent)
            for part in rest:
                if self.line:
                    self.end()
                elif self.lines:
                    self.lines.append("")
                self._put(part, indent)
            return
        text = SPACE.sub(" ", text)
        if text[0] == " ":
            self.gap = self.gap or bool(self.line)
            text = text[1:]
        if text:
            tail = text[-1] == " "
            self._put(text[:-1] if tail else text, indent)
            self.gap = tail

    def _put(self, text: str, indent: str) -> None:
        if not text:
            return
        if not self.line:
            if self.lines:
                self.lines += [""] * max(self.blank, self.breaks)
            self.blank, self.breaks = False, 0
            self.line.append(indent + self.mark)
            self.mark = ""
        elif self.gap:
            self.line.append(" ")
        self.gap = False
        self.line.append(text)

    def end(self, blank: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.gap = False
        self.blank = self.blank or blank

    def wrap(self) -> None:
        """A line break: ends the line, or makes an empty one."""
        if self.line:
            self.end()
        else:
            self.breaks += 1

    def all(self) -> list[str]:
        self.end()
        return self.lines


class Grid:
    """A table: rows of cells, each a flow with how many columns and rows it spans."""

    __slots__ = ("rows", "flow")

    def __init__(self, flow: Text):
        self.rows: list[list[tuple[Text, int, int]]] = []
        self.flow = flow

    def placed(self) -> list[list[tuple[int, int, list[str]]]]:
        """First column, column after the last, and lines of the cells of each row; of columns those count in which a cell begins."""
        rows, starts = [], set()
        below: list[tuple[int, int, int]] = []  # columns that cells of rows above still take, and the row after their last
        for n, row in enumerate(self.rows):
            taken: list[tuple[int, int, int]] = []
            for a, b, end in sorted(x for x in below if x[2] > n):
                if taken and taken[-1][1:] == (a, end):
                    taken[-1] = (taken[-1][0], b, end)
                else:
                    taken.append((a, b, end))
            below, at, out, k = list(taken), 0, [], 0
            for cell, columns, span in row:
                while k < len(taken) and taken[k][0] <= at:
                    at = max(at, taken[k][1])
                    k += 1
                out.append((at, at + columns, [line for line in cell.all() if line]))
                starts.add(at)
                if span != 1:
                    below.append((at, at + columns, min(n + span, len(self.rows)) if span else len(self.rows)))
                at += columns
            rows.append(out)
        order = sorted(starts)
        return [[(bisect.bisect_left(order, a), bisect.bisect_left(order, b), lines) for a, b, lines in row] for row in rows]

    def lines(self) -> list[str]:
        rows = self.placed()
        size = sum(len(x) + 1 for row in rows for _, _, cell in row for x in cell)
        out = self._aligned(rows, None, PADDING * size + 4096)
        return self._aligned(rows, WIDE, None) if out is None else out

    def _aligned(self, rows: list[list[tuple[int, int, list[str]]]], wide: int | None, most: int | None) -> list[str] | None:
        """Lines of the table; none if they would have more than ``most`` characters."""
        width = [0] * max((b for row in rows for _, b, _ in row), default=0)
        fits = lambda cell: max((len(x) for x in cell if wide is None or len(x) <= wide), default=0)
        last = [max((k for k, (*_, cell) in enumerate(row) if cell), default=0) for row in rows]
        cells = sorted((b - a, a, fits(cell)) for row, end in zip(rows, last) for a, b, cell in row[:end])
        for n, a, need in cells:
            over = need - sum(width[a : a + n]) - 2 * (n - 1)
            if over > 0:
                width[a + n - 1] += over
        begins = [0]
        for w in width:
            begins.append(begins[-1] + w + 2)
        out, total = [], 0
        for row in rows:
            for n in range(max((len(cell) for *_, cell in row), default=0)):
                line, length = [], 0
                for a, _, cell in row:
                    if n < len(cell):
                        gap = max(begins[a] - length, 2 if length else 0)
                        line.append(" " * gap if most is None or total + gap <= most else "")
                        line.append(cell[n])
                        length += gap + len(cell[n])
                total += length
                if most is not None and total > most:
                    return None
                out.append("".join(line).rstrip())
        return out


def render(page: str) -> str:
    """All visible text of a page."""
    # open elements, whether each began to hide, and whether it began in a drawing and out of sight
    stack: list[tuple[str, bool, bool, bool]] = []
    unseen = 0
    invisible = False
    drawing = False  # in a drawing, outside its texts
    pre = 0
    flows, grids, lists = [Text()], [], []
    indents = [""]
    at, n = 0, len(page)

    opened: Counter[str] = Counter()

    def leave() -> None:
        nonlocal unseen, pre, drawing, invisible
        name, hides, drawn, invisible = stack.pop()
        opened[name] -= 1
        unseen -= hides
        inside, drawing = drawing, drawn
        if unseen or hides or inside:
            return
        if drawn:
            flows[-1].add(" ", False, indents[-1])
        if name == "pre":
            pre -= 1
        if name in LISTS and lists:
            lists.pop()
        if name in ("td", "th") and grids and len(flows) > 1:
            flows.pop().end()
            indents.pop()
        elif name == "table" and grids:
            grid = grids.pop()
            flow = flows[-1]
            for line in grid.lines():
                flow.end()
                flow._put(line, indents[-1])
            flow.end(True)
        elif name in BLOCK:
            flows[-1].end(name in SPACED and not (name in LISTS and lists))
            if name == "li":
                flows[-1].mark = ""  # of an item without text

    def close(names: frozenset[str], within: frozenset[str]) -> None:
        """Ends the open elements named, as far as the nearest of those within which they must be."""
        if not any(opened[x] for x in names):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in within:
                k += 1
                break
        else:
            k = 0
        for j in range(k, len(stack)):
            if stack[j][0] in names:
                while len(stack) > j:
                    leave()
                return

    def close_nearest(name: str, within: frozenset[str]) -> None:
        if opened[name]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    while len(stack) > k:
                        leave()
                    return
                if stack[k][0] in within:
                    return

    def end_head() -> None:
        while stack and stack[-1][0] == "head":
            leave()

    while at < n:
        found = TOKEN.match(page, at)
        name, text = found[2], found[4]
        if text == "<" and BEGUN.match(page, at):
            # a tag with an open quote goes on to the next >; one that never ends is no text
            at = page.find(">", at) + 1 or n
            continue
        at = found.end()
        if name is None:
            if text and opened["head"] and not SPACE.fullmatch(text):
                end_head()
            if text and not unseen and not drawing and not invisible:
                # text right in a table but outside its cells stands in the flow around it
                flows[-1].add(html.unescape(text), pre > 0, indents[-1])
            continue
        name = name.lower()
        if opened["head"] and (name in ("body", "html", "br") if found[1] else name not in IN_HEAD):
            end_head()
        if found[1]:
            if name == "p" and not opened["p"]:
                if not unseen:
                    flows[-1].end(True)
            elif name == "br":
                if not unseen:
                    flows[-1].wrap()
            else:
                scope = frozenset() if name in ("table", "html", "body") else frozenset({"table"}) if name in ("td", "th", "tr", "thead", "tbody", "tfoot", "caption") else P_SCOPE
                close_nearest(name, scope)
            continue
        rest = found[3]
        if drawing and name in ENDS_SVG:
            close_nearest("svg", frozenset())
        if name in IMPLIED:
            close(*IMPLIED[name])
        if name in ENDS_P and opened["p"]:
            close(frozenset({"p"}), P_SCOPE)
        closed = rest.rstrip().endswith("/")
        if name not in VOID and not closed or name in RAW and not (closed and drawing):
            hidden, set_to = _hides(rest) if rest else (False, "")
            hides = name in UNSEEN or hidden or name in IN_SVG and opened["svg"] > 0 or name in IN_MATH and opened["math"] > 0
            out_of_sight = set_to != "visible" if set_to else invisible
            if name == "select":
                end = ENDS_SELECT.search(page, at)
                if not (hides or unseen or drawing or out_of_sight):
                    flows[-1].add(f"{_chosen(rest, page[at : end.start()])} ", False, indents[-1])
                at = end.end()
                continue
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
                if not hides and not unseen and not drawing and not out_of_sight:
                    held = page[at : end.start()] or " "
                    flows[-1].add(html.unescape(held) if name == "textarea" else held, True, indents[-1])
                at = end.end()
                continue
            stack.append((name, hides, drawing, invisible))
            invisible = out_of_sight
            opened[name] += 1
            unseen += hides
            drawing = name == "svg" or drawing and name not in SHOWN
            if unseen or drawing:
                continue
            flow = flows[-1]
            if stack[-1][2]:
                flow.add(" ", False, indents[-1])
            if name in BLOCK:
                flow.end(name in SPACED and not (name in LISTS and lists))
            if name in LISTS:
                lists.append([name == "ol", int(start[1]) if name == "ol" and (start := START.match(attributes(rest).get("start", ""))) else 1])
            elif name == "li":
                indent = "  " * max(0, len(lists) - 1)
                if lists and lists[-1][0]:
                    flow.mark = f"{indent}{lists[-1][1]}. "
                    lists[-1][1] += 1
                else:
                    flow.mark = f"{indent}- "
            elif name == "pre":
                pre += 1
                if page.startswith("\n", at):
                    at += 1
            elif name == "table":
                grids.append(Grid(flow))
            elif name == "tr" and grids:
                grids[-1].rows.append([])
            elif name in ("td", "th") and grids:
                if not grids[-1].rows:
                    grids[-1].rows.append([])
                given = attributes(rest) if rest else {}
                grids[-1].rows[-1].append((cell := Text(), max(1, _span(given, "colspan", 1000)), _span(given, "rowspan", 65534)))
                flows.append(cell)
                indents.append("")
        elif unseen or drawing:
            continue
        elif name == "br":
            flows[-1].wrap()
        elif name == "hr":
            flows[-1].end(True)
    while stack:
        leave()
    lines = flows[0].all()
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``text``, all visible text of each page."""
    pages = pages.drop("text") if column != "text" else pages

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([None if not page.is_valid else render(page.as_py()) for page in batch.column(column)], pa.string())
            yield pa.RecordBatch.from_arrays([*(c for c, name in zip(batch.columns, batch.schema.names) if name != "text"), text], [*(name for name in batch.schema.names if name != "text"), "text"])

    return pages.mapInArrow(part, pages.drop("text").withColumn("text", F.lit(None).cast("string")).schema)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
