"""Layout-aware rendering of HTML to text.

A tokenizer and a tree builder with implied tags (an opening block ends a
paragraph, a row ends a cell, and so on) feed a renderer as they go: only the
stack of open elements and the tables being laid out are kept. Visibility rules
over parsed attributes drop what a browser wouldn't show. Blocks are set apart by line ends, paragraphs by
an empty line, list items get markers and indents, and cells of a table are
aligned in columns; preformatted text stays as it is.
"""

from __future__ import annotations

import html
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("head script style template noscript noframes noembed iframe object math canvas audio video datalist title desc defs metadata symbol".split())
PARAGRAPH = frozenset("p blockquote dl fieldset figure form h1 h2 h3 h4 h5 h6 hr ol pre table ul".split())
BLOCK = PARAGRAPH | frozenset("address article aside body caption center dd details dialog dir div dt figcaption footer header hgroup html legend li main menu nav section summary tbody td tfoot th thead tr".split())
#: An opening tag ends these open elements, up to a barrier.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr", "td", "th", "caption"), ("table",)),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)), "thead": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)), "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "option": (("option",), ("select",)), "optgroup": (("option", "optgroup"), ("select",)), "body": (("head",), ()),
}
P_ENDERS = (BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "li", "dt", "dd"}) | {"li", "dt", "dd"}
IN_HEAD = frozenset("base link meta title style script template noscript head html".split())
SCOPE = frozenset("td th table caption html template button object".split())
#: An attribute: a quote opens a value only after =, and one that isn't closed is a
#: part of a name, so that the tag ends at the next >.
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*))?)?")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|--!>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*+)?)?)*+)(?:>|\Z)|</[^>]*>",
    re.S,
)
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Layout:
    """Text of one flow: lines, with pending space and pending line ends."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.breaks, self.space, self.fresh, self.indent, self.marker = 0, False, True, 0, ""

    def block(self, lines: int) -> None:
        if not self.fresh:
            self.breaks = max(self.breaks, lines)
        self.space = False

    def line(self) -> None:
        """A forced line end."""
        self.breaks = min(self.breaks + 1, 2) if not self.fresh else 0
        self.space = False

    def _start(self) -> None:
        if self.breaks:
            self.parts.append("\n" * self.breaks)
        if self.breaks or self.fresh:
            self.parts.append("  " * max(0, self.indent - bool(self.marker)) + self.marker)
            self.marker, self.space = "", False
        self.breaks, self.fresh = 0, False

    def text(self, value: str) -> None:
        words = _SPACE.sub(" ", value)
        if words == " " or not words:
            self.space |= bool(words)
            return
        lead, trail = words[0] == " ", words[-1] == " "
        begins = self.fresh or self.breaks
        self._start()
        if not begins and (lead or self.space):
            self.parts.append(" ")
        self.parts.append(words.strip(" "))
        self.space = trail

    def raw(self, value: str) -> None:
        self._start()
        if self.space:
            self.parts.append(" ")
            self.space = False
        self.parts.append(value)

    def value(self) -> str:
        return "".join(self.parts)


class Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[str, int, int]]] = []  # cells: text, columns, rows
        self.captions: list[str] = []

    def placed(self) -> list[list[tuple[int, str, int]]]:
        """Cells by row as (column, text, columns); a cell of several rows keeps its
        columns in the rows below."""
        taken: dict[int, int] = {}  # column: rows below that it is still taken in
        out = []
        for r in self.rows:
            at, row = 0, []
            held = dict(taken)
            for text, columns, rows in r:
                while held.get(at, 0) > 0:
                    at += 1
                row.append((at, text, columns))
                if rows > 1:
                    taken.update((at + i, rows) for i in range(columns))
                at += columns
            taken = {c: n - 1 for c, n in taken.items() if n > 1}
            out.append(row)
        return out

    def render(self) -> str:
        """Rows with columns of one width; cells of one line are padded, and a row
        with cells of several lines is set one under another."""
        rows = [r for r in self.placed() if any(c for _, c, _ in r)]
        widths: dict[int, int] = {}
        for r in rows:
            for at, c, s in r:
                if s == 1 and "\n" not in c:
                    widths[at] = max(widths.get(at, 0), len(c))
        lines = list(self.captions)
        for r in rows:
            if any("\n" in c for _, c, _ in r) or (len(r) == 1 and len(rows) == 1):
                lines += [c for _, c, _ in r if c]
                continue
            at, out = 0, []
            for column, c, s in r:
                out += [" " * widths.get(i, 0) for i in range(at, column)]
                width = sum(widths.get(column + i, 0) for i in range(s)) + 2 * (s - 1)
                out.append(c.ljust(width))
                at = column + s
            lines.append("  ".join(out).rstrip())
        return "\n".join(lines)


def _count(attributes: dict[str, str], name: str, most: int = 1000) -> int:
    """A count of columns or rows, within the standard's bounds."""
    m = re.match(r"\s*\+?(\d{1,9})", attributes.get(name, ""))
    return min(most, max(1, int(m[1]))) if m else 1


def _attributes(source: str) -> dict[str, str]:
    """Values by name in lower case; of a repeated name the first counts."""
    out: dict[str, str] = {}
    if source and not source.isspace():
        for m in _ATTRIBUTE.finditer(source):
            out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def _styles(a: dict[str, str]) -> dict[str, str]:
    """display and visibility of a style attribute; the last counts."""
    return {m[1].lower(): m[2].lower() for m in _STYLE.finditer(a["style"])} if "style" in a else {}


def _hides(name: str, a: dict[str, str], assistive: bool) -> bool:
    """Whether an element is left out with all that is in it."""
    if name in HIDDEN or "hidden" in a:
        return True
    if assistive and (name == "textarea" or (name == "option" and "selected" not in a) or a.get("aria-hidden", "").lower() == "true"):
        return True
    return _styles(a).get("display") == "none"


_SELECT = re.compile(r"</?select(?=[\s/>])", re.I)


def _chosen(source: str, at: int) -> bool:
    """Whether one of the options of the select that begins at a place is marked as
    selected."""
    end = _SELECT.search(source, at)
    stop = end.start() if end else len(source)
    return any(m[2] and not m[1] and m[2].lower() == "option" and "selected" in _attributes(m[3]) for m in _TOKEN.finditer(source, at, stop))


def render(source: str, assistive: bool = True) -> str:
    """The visible text of an HTML document or fragment.

    With assistive, as a screen reader has it: without what aria-hidden=true takes
    away, without what stands in text areas, and of options only those marked as
    selected. Otherwise as on the screen: aria-hidden takes nothing away, text areas
    show their text, a list of several lines all its options, and a drop-down list
    the selected option or else the first. Text behind a closed <details> counts as
    visible.
    """
    top = Layout()
    flows = [top]
    stack: list[list] = []  # name, hidden, closing action, visibility outside
    tables: list[Table] = []
    lists: list[list] = []  # ordered, number
    hidden = pre = 0
    visible = True  # by the inherited property visibility
    options = ""  # of the open select: all, selected, first
    opened: Counter[str] = Counter()

    def close(entry: list) -> None:
        nonlocal hidden, pre, visible
        name, hid, cell, visible = entry
        opened[name] -= 1
        hidden -= hid
        flow = flows[-1]
        if name in ("td", "th", "caption") and cell is not None:
            done = flows.pop().value()
            if name == "caption":
                tables[-1].captions += [done] if done else []
            else:
                if not tables[-1].rows:
                    tables[-1].rows.append([])
                tables[-1].rows[-1].append((done, *cell))
            return
        if name == "table" and cell is not None:
            text = tables.pop().render()
            flow = flows[-1]
            flow.block(2)
            for i, row in enumerate(text.split("\n") if text else ()):
                if i:
                    flow.block(1)
                flow.raw(row)
            flow.block(2)
            return
        if name == "pre":
            pre -= 1
        if name in ("ul", "ol", "menu", "dir") and lists:
            lists.pop()
            flow.indent -= 1
        elif name in ("blockquote", "dd"):
            flow.indent -= 1
        if name == "li":
            flow.marker = ""
        if name in BLOCK:
            flow.block(2 if name in PARAGRAPH and not (name in ("ul", "ol", "menu", "dir") and lists) else 1)

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            close(stack.pop())

    def find(names: tuple | frozenset, barrier: tuple | frozenset) -> int:
        if not any(opened[n] for n in names):
            return -1
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in barrier:
                return -1
        return -1

    def say(value: str) -> None:
        if hidden or not value or not visible:
            return
        if stack and stack[-1][0] in ("table", "tr", "tbody", "thead", "tfoot", "colgroup") and not value.strip():
            return
        if "&" in value:
            value = html.unescape(value)
        if pre:
            for i, row in enumerate(value.replace("\r\n", "\n").split("\n")):
                if i:
                    flows[-1].breaks = flows[-1].breaks + 1 if not flows[-1].fresh else 0
                if row:
                    flows[-1].raw(row)
        else:
            flows[-1].text(value)

    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            say(source[at:])
            break
        if m.start() > at:
            text = source[at : m.start()]
            if text.strip() and stack and stack[-1][0] == "head":
                pop_to(len(stack) - 1)
            say(text)
        at = m.end()
        name = m[2]
        if not name:
            if m[0].startswith("<![CDATA["):
                say(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        name = name.lower()
        if m[1]:  # an end tag
            if name == "br":
                flows[-1].line()
            elif name == "p" and find(("p",), SCOPE) < 0:
                if not hidden:
                    flows[-1].block(2)
            else:
                barrier = ("table",) if name in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else () if name in ("table", "body", "html") else ("td", "th", "table", "caption")
                same = ("h1", "h2", "h3", "h4", "h5", "h6") if re.fullmatch("h[1-6]", name) else (name,)
                i = find(same, barrier)
                if i >= 0:
                    if name not in BLOCK and any(e[0] in BLOCK for e in stack[i + 1 :]):
                        # an inline element's end doesn't close the blocks within it
                        entry = stack.pop(i)
                        opened[entry[0]] -= 1
                        hidden -= entry[1]
                        visible = entry[3]
                    else:
                        pop_to(i)
            continue
        a = _attributes(m[3])
        if name not in IN_HEAD and stack and stack[-1][0] == "head":
            pop_to(len(stack) - 1)
        if name in P_ENDERS and (i := find(("p",), SCOPE)) >= 0:
            pop_to(i)
        if name in ENDS:
            names, barrier = ENDS[name]
            while (i := find(names, barrier)) >= 0:
                pop_to(i)
        flow = flows[-1]
        hides = _hides(name, a, assistive)
        shown = {"hidden": False, "collapse": False, "visible": True}.get(_styles(a).get("visibility", ""), visible)
        if name == "select":
            options = "all" if "multiple" in a or _count(a, "size") > 1 else "selected" if _chosen(source, at) else "first"
        elif name == "option" and not assistive and opened["select"]:
            hides = hides or options == "none" or (options == "selected" and "selected" not in a)
            options = "none" if options == "first" else options
        if name in VOID:
            if not hidden and not hides:
                if name == "br":
                    flow.line()
                elif name == "hr":
                    flow.block(2)
                elif name == "img" and shown:
                    flow.text(a.get("alt", ""))
            continue
        if m[3].endswith("/") and (name in ("svg", "math") or opened["svg"]):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>|\Z", re.I).search(source, at)
            if name in ("xmp", "textarea") and not hidden and not hides and shown:
                inner = source[at : end.start()].replace("\r\n", "\n")
                flow.block(2)
                for i, row in enumerate((html.unescape(inner) if name == "textarea" else inner).removeprefix("\n").split("\n")):
                    if i:
                        flow.breaks = flow.breaks + 1 if not flow.fresh else 0
                    if row:
                        flow.raw(row)
                flow.block(2)
            at = end.end()
            continue
        if name in ("text", "option"):
            flow.space = True
        entry = [name, 0, None, visible]
        visible = shown
        if hides:
            entry[1] = 1
            hidden += 1
        if not hidden:
            if name == "table":
                flow.block(2)
                tables.append(Table())
                entry[2] = 1
            elif name == "tr" and tables:
                tables[-1].rows.append([])
            elif name in ("td", "th", "caption") and tables:
                flows.append(Layout())
                entry[2] = _count(a, "colspan"), _count(a, "rowspan", 65534)
            elif name in BLOCK:
                flow.block(2 if name in PARAGRAPH and not (name in ("ul", "ol", "menu", "dir") and lists) else 1)
        if name == "pre":
            pre += 1
            if source.startswith("\n", at):
                at += 1
        elif name in ("ul", "ol", "menu", "dir"):
            s = re.match(r"\s*(-?\d{1,9})", a.get("start", ""))
            lists.append([name == "ol", int(s[1]) if s else 1])
            flow.indent += 1
        elif name in ("blockquote", "dd"):
            flow.indent += 1
        elif name == "li" and not hidden:
            flow.marker = "- "
            if lists and lists[-1][0]:
                flow.marker = f"{lists[-1][1]}. "
                lists[-1][1] += 1
        opened[name] += 1
        stack.append(entry)
    pop_to(0)
    return re.sub(r"[ \t]+(?=\n)", "", top.value()).rstrip()


def extract(pages: DataFrame, assistive: bool = False) -> DataFrame:
    """page_id, text, n_chars, n_lines of every row of pages (page_id, html).

    Null html is an empty text, and so is one without visible text; a page of any
    length is rendered whole. A null page_id is carried; repeated rows give repeated
    rows; other columns are ignored; an empty table gives an empty result. Unclosed
    elements end with the page. assistive is as in render().
    """
    kind = dict(pages.dtypes)["page_id"]
    rows = pages.select("page_id", F.col("html").cast("string").alias("html"))

    def run(c: dict[str, list]) -> dict[str, list]:
        text = [render(x or "", assistive) for x in c["html"]]
        return {"page_id": c["page_id"], "text": text, "n_chars": [len(t) for t in text], "n_lines": [t.count("\n") + 1 if t else 0 for t in text]}

    return common.map_rows(rows, f"page_id {kind}, text string, n_chars long, n_lines long", run)
