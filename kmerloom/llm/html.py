"""HTML extraction by layout: a tree builder with implied tags and visibility rules, and a renderer of all visible text.

The builder turns any byte soup into well-nested opens, texts and closes (void elements, implied ends of paragraphs, list
items, table rows and cells, raw text of scripts and styles, closes that match nothing dropped). The renderer walks these
events: blocks stand on lines of their own, paragraphs, headings, lists and tables have a blank line around them, list
items carry a bullet or number and their depth's indent, preformatted text keeps its spaces, and the cells of a table are
padded to their column. Both keep explicit stacks, so depth costs no recursion.
"""

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without content, raw-text elements, and elements whose opening ends a paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul caption".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure menu dir".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes object datalist audio video canvas defs desc metadata symbol annotation annotation-xml".split())
#: An opening tag closes these open elements, up to the nearest of the scope.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
_SCOPE = frozenset("table td th caption button object li dd dt ul ol dl div article section body html".split())
_TAG = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([!?/][^>]*>?))")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_HIDDEN = re.compile(r"(?:^|;)\s*display\s*:\s*none\s*(?:!important\s*)?(?:;|$)", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)\s*(?:!important\s*)?(?=;|$)", re.I)
_SPACE = re.compile(r"[ \t\r\n\f]+")


def _attrs(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        value = m[2] or ""
        out.setdefault(m[1].lower(), html.unescape(value[1:-1] if value[:1] in "\"'" else value))
    return out


def _shown(tag: str, attrs: dict[str, str]) -> bool:
    return not (tag in UNSEEN or "hidden" in attrs or (tag == "dialog" and "open" not in attrs) or _HIDDEN.search(attrs.get("style", "")))


def _visible(attrs: dict[str, str], inherited: bool) -> bool:
    """Whether an element's own text shows: its last visibility, else what it inherits; unlike display it may be set back below."""
    found = _VISIBILITY.findall(attrs.get("style", ""))
    return found[-1].lower() == "visible" if found else inherited


def events(source: str) -> Iterator[tuple[str, str, dict | None]]:
    """("open", tag, attributes), ("text", text, None) and ("close", tag, None), well nested."""
    stack: list[str] = []
    at, n = 0, len(source)

    def close_to(depth: int) -> Iterator[tuple]:
        while len(stack) > depth:
            yield "close", stack.pop(), None

    while at < n:
        found = _TAG.search(source, at)
        end = found.start() if found else n
        if end > at:
            yield "text", html.unescape(source[at:end]) if "&" in source[at:end] else source[at:end], None
        if not found:
            break
        at = found.end()
        if found[1]:
            stop = source.find("-->", at)
            at = n if stop < 0 else stop + 3
            continue
        if found[5]:
            continue
        tag = found[3].lower()
        if found[2]:
            if tag == "p" and "p" not in stack:
                yield "open", "p", {}
                yield "close", "p", None
            elif tag == "br":
                yield "open", "br", {}
                yield "close", "br", None
            elif tag in stack:
                depth = len(stack) - 1 - stack[::-1].index(tag)
                fence = max((i for i, x in enumerate(stack) if x in ("td", "th", "table")), default=-1)
                if depth >= fence or tag in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "body", "html"):
                    yield from close_to(depth)
            continue
        attrs = _attrs(found[4]) if found[4] else {}
        if tag in BLOCK and "p" in stack:
            depth = len(stack) - 1 - stack[::-1].index("p")
            if not any(x in _SCOPE for x in stack[depth + 1 :]):
                yield from close_to(depth)
        if tag in IMPLIED:
            ended, scope = IMPLIED[tag]
            depth = len(stack)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] in scope:
                    break
                if stack[i] in ended:
                    depth = i
            yield from close_to(depth)
        if tag in ("td", "th") and "table" in stack and "tr" not in stack[len(stack) - 1 - stack[::-1].index("table") :]:
            stack.append("tr")
            yield "open", "tr", {}
        if tag in ("html", "body") and tag in stack:
            continue
        yield "open", tag, attrs
        if tag in VOID or found[4].rstrip().endswith("/") and tag not in BLOCK and tag not in RAW:
            yield "close", tag, None
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
            body = source[at : stop.start() if stop else n]
            if body:
                yield "text", html.unescape(body) if tag in ("textarea", "title") else body, None
            yield "close", tag, None
            close = source.find(">", stop.end()) if stop else -1
            at = close + 1 if close >= 0 else n
            continue
        stack.append(tag)
    yield from close_to(0)


def width(text: str) -> int:
    """Columns of a monospaced line: wide characters take two, combining marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Flow:
    """Lines of one block context: white space collapses, breaks asked for twice count once."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.blank = False
        self.indent: list[str] = []
        self.mark = ""

    def text(self, text: str) -> None:
        if not text:
            return
        folded = _SPACE.sub(" ", text)
        if folded == " ":
            self.space = bool(self.line)
            return
        if (self.space or folded[0] == " ") and self.line:
            self.line.append(" ")
        self.space = folded[-1] == " "
        self.line.append(folded.strip(" "))

    def verbatim(self, text: str) -> None:
        for i, x in enumerate(text.split("\n")):
            if i:
                self.end(True)
            if x:
                self.line.append(x)

    def end(self, empty: bool = False) -> None:
        """End the line; empty lines are kept only if asked for (a line break)."""
        if self.line or empty or self.mark:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.lines.append(("".join(self.indent) + self.mark + "".join(self.line)).rstrip())
            if self.mark:
                self.indent.append(" " * width(self.mark))
                self.mark = ""
        self.line, self.space = [], False

    def gap(self) -> None:
        self.end()
        self.blank = True

    def done(self) -> list[str]:
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _grid(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Cells (lines, columns, rows spanned) padded to their columns, two spaces between; a cell that reaches into the rows below
    holds its columns there."""
    placed: list[list[tuple[int, list[str], int]]] = []
    widths: list[int] = []
    held: list[int] = []  # for each column, rows that a cell above still reaches into
    for row in rows:
        line, at = [], 0
        below = [max(0, x - 1) for x in held]
        for lines, span, deep in row:
            while at < len(held) and held[at]:
                at += 1
            widths += [0] * (at + span - len(widths))
            below += [0] * (at + span - len(below))
            for i in range(at, at + span):
                below[i] = max(below[i], deep - 1)
            if span == 1:
                widths[at] = max(widths[at], max(map(width, lines), default=0))
            line.append((at, lines, span))
            at += span
        placed.append(line)
        held = below
    for at, lines, span in (cell for line in placed for cell in line if cell[2] > 1):
        room = sum(widths[at : at + span]) + 2 * (span - 1)
        widths[at + span - 1] += max(0, max(map(width, lines), default=0) - room)
    starts = [0]
    for x in widths:
        starts.append(starts[-1] + x + 2)
    out = []
    for row in placed:
        for k in range(max((len(lines) for _, lines, _ in row), default=0)):
            line = ""
            for at, lines, _ in row:
                if k < len(lines):
                    line += " " * (max(starts[at] - width(line), 2 if line else 0)) + lines[k]
            out.append(line.rstrip())
    return out


def _span(attrs: dict[str, str], name: str) -> int:
    found = attrs.get(name, "1").strip()
    return min(int(found), 1000) if found.isascii() and found.isdigit() and int(found) else 1


def render(source: str | None) -> str:
    """All visible text of a page."""
    flow, stack = Flow(), []
    hidden, pre = 0, 0
    lists: list[list] = []
    tables: list[dict] = []
    for kind, name, attrs in events(source or ""):
        if kind == "text":
            if hidden or stack and not stack[-1]["visible"]:
                continue
            if tables and tables[-1]["flow"] is None and not name.strip():
                continue
            flow.verbatim(name) if pre else flow.text(name)
            continue
        if kind == "open":
            shown = _shown(name, attrs)
            visible = _visible(attrs, stack[-1]["visible"] if stack else True)
            state = {"tag": name, "hidden": not shown, "visible": visible, "indent": len(flow.indent), "flow": flow}
            stack.append(state)
            hidden += not shown
            if hidden:
                continue
            if name == "br":
                flow.end(True)
            elif name == "hr":
                flow.gap()
                flow.text("---" if visible else "")
                flow.gap()
            elif name == "img":
                flow.text(attrs.get("alt", "") if visible else "")
            elif name == "input":
                if visible and attrs.get("type", "text").lower() in ("submit", "button", "reset", "text"):
                    flow.text(attrs.get("value", ""))
            elif name in ("td", "th") and tables:
                table = tables[-1]
                if not table["rows"]:
                    table["rows"].append([])
                table["rows"][-1].append([None, _span(attrs, "colspan"), _span(attrs, "rowspan")])
                flow = table["flow"] = Flow()
            elif name == "tr" and tables:
                tables[-1]["rows"].append([])
            elif name in BLOCK:
                flow.gap() if name in SPACED and not (name in ("ul", "ol") and lists) else flow.end()
                if name in ("ul", "ol", "menu", "dir"):
                    start = attrs.get("start", "1")
                    lists.append([name == "ol", int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
                    if len(lists) > 1 and not flow.indent:
                        flow.indent.append("  ")
                elif name == "li":
                    ordered = lists[-1] if lists else [False, 0]
                    flow.mark = "" if not visible else f"{ordered[1]}. " if ordered[0] else "- "
                    ordered[1] += 1
                elif name == "optgroup":
                    flow.text(attrs.get("label", "") if visible else "")
                    flow.end()
                elif name in ("blockquote", "dd"):
                    flow.indent.append("  ")
                elif name == "table":
                    tables.append({"rows": [], "flow": None, "outer": flow})
                elif name == "pre":
                    pre += 1
            continue
        state = stack.pop()
        if state["hidden"]:
            hidden -= 1
            continue
        if hidden:
            continue
        if name in ("td", "th") and tables and tables[-1]["flow"] is flow:
            tables[-1]["rows"][-1][-1][0] = flow.done()
            flow, tables[-1]["flow"] = tables[-1]["outer"], None
        elif name == "table" and tables:
            table = tables.pop()
            flow = table["outer"]
            flow.gap()
            for line in _grid([[(c[0] or [], c[1], c[2]) for c in row] for row in table["rows"]]):
                flow.verbatim(line)
                flow.end(True)
            flow.gap()
        elif name in BLOCK and name != "tr":
            if name == "li":
                flow.end()
                flow.mark = ""
            if name in ("ul", "ol", "menu", "dir") and lists:
                lists.pop()
            pre -= name == "pre"
            flow.gap() if name in SPACED and not (name in ("ul", "ol") and lists) else flow.end()
        if flow is state["flow"]:
            del flow.indent[state["indent"] :]
    return "\n".join(flow.done())


def _kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            texts = [render(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], names=["id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text.

    Seen are all options of a select, labels of drawings and signs of formulas; not seen are scripts and what stands in their stead,
    fallbacks of objects and media, and elements hidden by display; visibility counts element by element. Ids are whole
    numbers. Null and empty pages, and pages with nothing visible, have an empty text. Ids and urls pass through, null or not; repeated
    rows repeat; an empty table gives no rows; other columns are not read. Whole pages are rendered, whatever their length.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_kernel, "id long, url string, text string").withColumnsRenamed({"id": id_col, "url": url_col})
