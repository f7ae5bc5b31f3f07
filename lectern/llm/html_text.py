"""Text of web pages as a reader sees it.

A tree builder reads the markup: raw-text elements, void elements, end tags that other tags imply (paragraphs, list items, table
rows and cells, options, definition terms), unknown or stray end tags. Text and tags that no head may have end an open head. Visibility rules drop what is not shown: head, scripts, styles,
templates, comments, frames and media, choices of data lists, descriptions and definitions of drawings, annotations of formulas, and elements that the hidden attribute
or their inline style's display takes out, with all that is in them; a display that is set shows a hidden element. An inline style's visibility is inherited, and what sets it to visible inside is
shown. Labels of drawings, formulas and the fallback of objects are shown. Layout rules emit the rest: blocks on lines of their
own with their spacing, items with bullets or numbers and indentation, preformatted text as it is, and table cells aligned in columns, over spans of columns and rows; a cell of
several lines, as one that holds a table, takes several. Columns are aligned exactly as long as that takes no
more blanks than PADDING allows, or whatever it takes if the caller sets no bound. Dialogs that are not open and what a closed details element holds beside its summary are not shown, style sheets are not read.

Nothing recurses, so depth is bounded by memory alone, and time is linear in the page but for tables in tables, whose lines are copied once for each level. Results: a null or empty page has
the empty text. Rows with equal ids are pages of their own; very long pages are read whole; ties do not arise; an empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from bisect import insort

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_schema, prepare

# Element names of HTML, by the role they play here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style title template noscript iframe audio video canvas datalist noembed noframes rp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul xmp".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu dir xmp".split())
CLOSES_P = BLOCK - frozenset("body html caption dd dt legend li optgroup option summary tbody td tfoot th thead tr".split()) | {"hr"}
LISTS = frozenset("ul ol menu dir".split())
STAYS_IN_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())

#: By a drawing or formula: what inside it is never shown. The title of a drawing is hidden as every title.
UNSEEN_IN = {"svg": frozenset("desc defs metadata".split()), "math": frozenset("annotation annotation-xml".split())}

#: By a start tag: the open elements it ends, and the elements beyond which it looks no further.
ENDS = {
    "li": ({"li"}, LISTS),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
SCOPES = frozenset({"html", "table", "td", "th", "caption", "template", "button", "object"})

#: Quotes count after an equals sign alone; a tag that the page's end cuts off is dropped, so no start is scanned twice.
_token = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?|["'])*+)(?:(>)|\Z)|</[^>]*(?:>|\Z)""", re.S)
_attribute = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_blank = re.compile(r"[ \t\n\r\f]+")
_declaration = re.compile(r"""\s*([-\w]+)\s*:\s*((?:[^;"'(]++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|\([^)]*+(?:\)|\Z))*+)(?:;|\Z)|[^;]*(?:;|\Z)""")
_remark = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)

#: Blanks and tabs of preformatted text while lines are built; pages keep no such characters.
KEPT = str.maketrans({" ": "\0", "\t": "\x01"})
GIVEN = str.maketrans({"\0": " ", "\x01": "\t"})

#: Blanks that aligning a table may take, beside so many for each character of its cells. A table that needs more, as one with a very wide cell in very many rows, has its columns widened up to
#: WIDE and begun at LINE at most, so that a page of a megabyte does not become gigabytes; without this bound (None) every table is aligned.
PADDING, TIMES = 1 << 22, 16
WIDE, LINE = 160, 1000

#: Runs of columns that cells from above hold at once, for different numbers of rows; further ones hold none.
REACHING = 4096


def declared(style: str) -> dict[str, str]:
    """The properties of an inline style: the last one of a name stands, unless an earlier one is important."""
    out: dict[str, str] = {}
    for name, value in _declaration.findall(_remark.sub(" ", style)):
        name, value = name.lower(), " ".join(value.lower().split())
        important = value.endswith("important") and "!" in value
        if name and (important or not out.get(name, "").endswith("!")):
            out[name] = value.partition("!")[0].strip() + "!" * important
    return {name: value.rstrip("!") for name, value in out.items()}


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []

    def get(self, name: str) -> str | None:
        if self.attributes:
            for key, a, b, c in _attribute.findall(self.attributes):
                if key.lower() == name:
                    return html.unescape(a or b or c)
        return None

    def shown(self) -> tuple[bool, bool | None]:
        """Whether the element is laid out at all, and whether it is visible (None: as its parent)."""
        if self.tag in HIDDEN:
            return False, None
        low = self.attributes.lower()
        closed = self.tag == "dialog" and self.get("open") is None
        if not closed and "hidden" not in low and "style" not in low:
            return True, None
        style = declared(self.get("style") or "") if "style" in low else {}
        display = style.get("display")
        if display == "none" or self.tag == "input" and (self.get("type") or "").lower() == "hidden":
            return False, None
        hidden = "" if closed else self.get("hidden") if "hidden" in low else None
        if hidden is not None and (display in (None, "", "initial", "inherit", "unset", "revert") or hidden.lower() == "until-found"):
            return False, None
        return True, {"hidden": False, "collapse": False, "visible": True, "initial": True}.get(style.get("visibility", ""))


def parse(page: str) -> Node:
    """The tree of a page; text children are unescaped."""
    page = page.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "").replace("\x01", "")
    root = Node("#root")
    stack = [root]
    open_tags: dict[str, int] = {}
    at, match = 0, _token.search

    def text(raw: str) -> None:
        if raw:
            if stack[-1].tag == "head" and _blank.sub("", raw):
                pop_to(len(stack) - 1)
            stack[-1].children.append(html.unescape(raw).translate({0: None, 1: None}) if "&" in raw else raw)

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            open_tags[stack.pop().tag] -= 1

    def ends(tags, bounds) -> None:
        """Closes the open elements up to the outermost of tags before a bound."""
        cut = 0
        for k in range(len(stack) - 1, 0, -1):
            tag = stack[k].tag
            if tag in tags:
                cut = k
            elif tag in bounds:
                break
        if cut:
            pop_to(cut)

    while (m := match(page, at)) is not None:
        text(page[at : m.start()])
        at = m.end()
        closing, name, attributes = m.group(1), m.group(2), m.group(3)
        if name is None or m.group(4) is None:
            continue
        tag = name.lower()
        if closing:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif open_tags.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        if tag == "text" and open_tags.get("svg"):
                            stack[k].children.append(" ")
                        pop_to(k)
                        break
                    if stack[k].tag in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                        break  # an end tag inside a cell ends nothing outside it
            elif tag == "p":
                stack[-1].children.append(Node("p"))
            continue
        if tag in ENDS and any(open_tags.get(t) for t in ENDS[tag][0]):
            ends(*ENDS[tag])
        if tag in CLOSES_P and open_tags.get("p"):
            ends({"p"}, SCOPES)
        if stack[-1].tag == "head" and tag not in STAYS_IN_HEAD:
            pop_to(len(stack) - 1)
        foreign = [x for x in UNSEEN_IN if open_tags.get(x)]
        node = Node(tag, "hidden=until-found" if any(tag in UNSEEN_IN[x] for x in foreign) else attributes)
        if tag == "text" and "svg" in foreign:
            node.children.append(" ")  # labels stand apart
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            body = page[at : end.start() if end else len(page)]
            at = end.end() if end else len(page)
            if tag in ("textarea", "xmp"):
                node.children.append(html.unescape(body) if tag == "textarea" else body)
            continue
        if attributes.endswith("/") and (foreign or tag in UNSEEN_IN or tag in ("path", "circle", "rect", "use", "g")):
            continue
        stack.append(node)
        open_tags[tag] = open_tags.get(tag, 0) + 1
    text(page[at:])
    return root


def width(s: str) -> int:
    """Columns that a text takes: wide characters two, combining ones none."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Flow:
    """Lines under construction."""

    def __init__(self):
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = 0  # blank lines that the next line needs before it
        self.prefix: list[str] = []  # one for each list level
        self.bullet: str | None = None

    def write(self, raw: str) -> None:
        self.inline.append(raw)

    def end_line(self, gap: int = 0) -> None:
        line = _blank.sub(" ", "".join(self.inline)).strip(" ").translate(GIVEN)
        self.inline = []
        if line:
            self.put(line)
        self.gap = max(self.gap, gap)

    def end_kept(self) -> None:
        """Ends a line of preformatted text, also an empty one."""
        line = "".join(self.inline).translate(GIVEN)
        self.inline = []
        self.put(line)

    def put(self, line: str) -> None:
        if self.lines and self.gap:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        indent = "".join(self.prefix)
        if self.bullet is not None:
            indent = "".join(self.prefix[:-1]) + self.bullet
            self.bullet = None
        self.lines.append((indent + line).rstrip() if line else "")

    def text(self) -> str:
        self.end_line()
        return "\n".join(self.lines)


class Grid:
    """A table's rows; a cell is its lines and its spans of columns and rows."""

    def __init__(self):
        self.rows: list[list[tuple[list[str], int, int]]] = []

    def placed(self) -> list[list[tuple[int, int, list[str]]]]:
        """For each row its own cells, each as the columns it begins and ends before; columns that cells from above reach into are passed over."""
        below: list[tuple[int, int, int]] = []  # first column, column after the last, last row taken; by column
        soonest = math.inf
        out = []
        for n, r in enumerate(self.rows):
            if soonest < n:
                below = [x for x in below if x[2] >= n]
                soonest = min((x[2] for x in below), default=math.inf)
            k, j, row, reach = 0, 0, [], []
            for lines, across, down in r:
                while j < len(below) and below[j][0] <= k:
                    k, j = max(k, below[j][1]), j + 1
                row.append((k, k + across, lines))
                if down > 1:
                    last = n + down - 1
                    if reach and reach[-1][1] == k and reach[-1][2] == last:
                        reach[-1] = (reach[-1][0], k + across, last)
                    else:
                        reach.append((k, k + across, last))
                k += across
            out.append(row)
            for x in reach[: REACHING - len(below)]:
                insort(below, x)
                soonest = min(soonest, x[2])
        return out

    def lines(self, padding: int | None = PADDING) -> list[str]:
        rows = [r for r in self.placed() if any(x for _, _, x in r)]
        column = {c: n for n, c in enumerate(sorted({c for r in rows for a, b, _ in r for c in (a, b)}))}  # only where cells begin or end
        cells = [[(column[a], column[b], lines, [width(x) for x in lines]) for a, b, lines in r] for r in rows]
        starts = self._starts(cells, len(column), math.inf, math.inf)
        if padding is not None:
            needed = sum(starts[a] * max(map(len, (x for _, _, x, _ in r))) for r in cells for a in (max(a for a, _, x, _ in r if x),))
            if needed > padding + TIMES * sum(sum(w) for r in cells for *_, w in r):
                starts = self._starts(cells, len(column), WIDE, LINE)
        out = []
        for r in cells:
            for n in range(max(len(x) for _, _, x, _ in r)):
                line, at = [], 0
                for a, _, lines, wide in r:
                    if n < len(lines) and lines[n]:
                        gap = max(2 if at else 0, starts[a] - at)
                        line += (" " * gap, lines[n])
                        at += gap + wide[n]
                out.append("".join(line).rstrip())
        return out

    @staticmethod
    def _starts(cells: list, columns: int, widest: float, latest: float) -> list[int]:
        """Where columns begin, two blanks apart, with room for all cells of at most the widest."""
        widths = [0] * columns
        spans = []
        for r in cells:
            for a, b, _, wide in r:
                wide = max((w for w in wide if w <= widest), default=0)
                if b == a + 1:
                    widths[a] = max(widths[a], wide)
                elif wide:
                    spans.append((a, b, wide))
        for a, b, wide in spans:  # what spans columns widens the last of them
            widths[b - 1] += max(0, wide - sum(widths[a:b]) - 2 * (b - a - 1))
        starts = [0]
        for w in widths:
            starts.append(min(latest, starts[-1] + w + 2))
        return starts


def number(raw: str | None, least: int, most: int) -> int:
    """A span as an attribute gives it; 1 if it gives none."""
    return min(most, max(least, int(raw))) if raw and raw.strip().isdecimal() and len(raw) < 8 else 1


def whole(raw: str | None) -> int | None:
    """A whole number as an attribute gives it."""
    return int(raw) if raw and re.fullmatch(r"\s*-?\d{1,9}\s*", raw) else None


def render(root: Node, padding: int | None = PADDING) -> str:
    flows, grids, counters = [Flow()], [], []
    pre = 0
    todo: list = [(root, False, True)]
    while todo:
        node, leaving, visible = todo.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if not visible:
                continue
            if pre:
                parts = node.translate(KEPT).split("\n")
                for part in parts[:-1]:
                    flow.write(part)
                    flow.end_kept()
                flow.write(parts[-1])
            else:
                flow.write(node)
            continue
        tag = node.tag
        if not leaving:
            laid_out, own = node.shown()
            if not laid_out:
                continue
            visible = visible if own is None else own
            if tag in ("hr", "img", "input") and not visible:
                continue
            if tag == "br":
                if pre:
                    flow.end_kept()
                elif not _blank.sub("", "".join(flow.inline)):
                    flow.inline = []
                    if flow.lines:
                        flow.gap = max(flow.gap, 1)
                else:
                    flow.end_line()
                continue
            if tag == "hr":
                flow.end_line()
                flow.put("---")
                continue
            if tag == "img":
                flow.write((node.get("alt") or "").translate({0: None, 1: None}))
                continue
            if tag == "input":
                flow.write((node.get("value") or "").translate({0: None, 1: None}) if (node.get("type") or "text").lower() not in ("hidden", "password", "checkbox", "radio", "file") else "")
                continue
            if tag in ("td", "th") and grids:
                flows.append(Flow())
            elif tag == "table":
                flow.end_line(1)
                grids.append(Grid())
            elif tag == "tr" and grids:
                grids[-1].rows.append([])
            elif tag == "caption" and grids:
                flow.end_line(1)
            elif tag in BLOCK:
                flow.end_line(1 if tag in SPACED and not (tag in LISTS and counters) else 0)
                if tag in LISTS:
                    step = -1 if tag == "ol" and node.get("reversed") is not None else 1
                    first = whole(node.get("start"))
                    if first is None:
                        first = 1 if step > 0 else sum(isinstance(c, Node) and c.tag == "li" for c in node.children)
                    counters.append([first - step, tag == "ol", step])
                elif tag == "li":
                    if counters:
                        value = whole(node.get("value"))
                        counters[-1][0] = counters[-1][0] + counters[-1][2] if value is None else value
                    flow.bullet = f"{counters[-1][0]}. " if counters and counters[-1][1] else "- "
                    flow.prefix.append(" " * len(flow.bullet))
                elif tag in ("blockquote", "dd"):
                    flow.prefix.append("    " if tag == "dd" else "> ")
                elif tag in ("pre", "xmp"):
                    pre += 1
                    if node.children and isinstance(node.children[0], str):
                        node.children[0] = node.children[0].removeprefix("\n")
            elif tag == "q" and visible:
                flow.write("\u201c")
            children = node.children
            if tag == "details" and node.get("open") is None:  # closed: its first summary alone
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            todo.append((node, True, visible))
            todo.extend((c, False, visible) for c in reversed(children))
            continue
        if tag == "q" and visible:
            flow.write("\u201d")
        if tag in ("td", "th") and grids and len(flows) > 1:
            lines = [x for x in flows.pop().text().split("\n") if x.strip()]
            if not grids[-1].rows:
                grids[-1].rows.append([])
            spans = (number(node.get("colspan"), 1, 1000), number(node.get("rowspan"), 0, 65534) or 65534) if "span" in node.attributes.lower() else (1, 1)
            grids[-1].rows[-1].append((lines, *spans))
        elif tag == "table":
            flow.end_line()
            for line in grids.pop().lines(padding):
                flow.put(line)
            flow.gap = max(flow.gap, 1)
        elif tag in BLOCK and not (tag == "tr" and grids):
            if pre and tag in ("pre", "xmp"):
                pre -= 1
                if flow.inline and any(flow.inline):
                    flow.end_kept()
            flow.end_line(1 if tag in SPACED and not (tag in LISTS and len(counters) > 1) else 0)
            if tag in LISTS and counters:
                counters.pop()
            elif tag in ("li", "blockquote", "dd") and flow.prefix:
                flow.prefix.pop()
                flow.bullet = None
    return flows[0].text()


def visible_text(page: str | None, padding: int | None = PADDING) -> str:
    return render(parse(page), padding) if page else ""


EXTRACTED = "page_id long, text string, n_lines long"


def extract(pages: DataFrame, padding: int | None = PADDING) -> DataFrame:
    """page_id, the visible text, and its number of lines (none for the empty text)."""
    prepare(pages.sparkSession)

    def run(batches):
        schema = arrow_schema(EXTRACTED)
        for batch in batches:
            texts = [visible_text(x, padding) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())], schema=schema)

    return pages.selectExpr("cast(page_id as long) page_id", "html").mapInArrow(run, EXTRACTED)
