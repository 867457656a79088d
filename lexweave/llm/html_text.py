"""Text of HTML pages by layout-aware rendering.

The markup becomes a tree, with the tags that HTML implies: an open paragraph ends at the
next block, an item at the next item, a cell at the next cell or row.  What a browser does
not show is left out: head, scripts, styles, comments, ``hidden``, ``display:none`` (in the
element or as a simple rule of a style sheet for screens), ``visibility:hidden`` with its visible
parts, closed details and dialogs, options that are not chosen.  All other text is kept,
that of formulas, drawings and text fields as well; text between cells goes before its table: blocks are separated by a line
end or a blank line, items carry bullets or numbers and are indented by their depth, cells
of a table are aligned in columns, preformatted text keeps its spaces.

Trees are walked with stacks, never by recursion, so that nesting may be as deep as it
likes.  A null page has a null text, an empty one an empty text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML by their rendering.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_SHOWN = frozenset(
    "head script style template noscript title meta link base datalist iframe object audio "
    "video canvas input area param source track annotation annotation-xml".split()
)
SPACED = frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol menu dl table pre blockquote figure hr article section".split()
)
BLOCK = SPACED | frozenset(
    "html body div address aside footer header main nav hgroup search li dt dd fieldset form "
    "legend caption details summary dialog figcaption center optgroup option textarea".split()
)
ENDS_PARAGRAPH = (BLOCK - {"html", "body", "caption", "legend", "option", "optgroup", "textarea"}) | {"xmp"}
# A start tag ends the open elements of these names, up to one that bounds the search.
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
}
PARAGRAPH_SCOPE = {"table", "td", "th", "caption", "button", "body", "html"}
CELLS = {"td", "th"}
TABLE_PARTS = CELLS | {"table", "tr", "tbody", "thead", "tfoot"}
TABLE_CONTEXT = (TABLE_PARTS - CELLS) | {"colgroup"}
# Drawings show the text of these, formulas put these signs between their parts.
SVG_TEXT = ("text", "foreignobject")
SVG_HIDDEN = frozenset("defs desc metadata symbol clippath mask pattern marker".split())
SIGNS = {"mfrac": "/", "msup": "^", "msub": "_"}
ALIGNED_WIDTH = 60
GAP = "  "

SPACES = re.compile(r"[ \t\n\r\f]+")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none", re.IGNORECASE)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.IGNORECASE)
CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.DOTALL)
CSS_MARK = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[{};]", re.DOTALL)
# A screen in CSS pixels, by which rules for some widths only are judged.
SCREEN = {"width": 1280.0, "height": 800.0}
MEDIA_SIZE = re.compile(r"\(\s*(min|max)-(width|height)\s*:\s*([\d.]+)(px|em|rem)\s*\)")
SIMPLE = re.compile(r"^([a-z][a-z0-9]*)?(?:\.([\w-]+)|#([\w-]+))?$", re.IGNORECASE)


class Element:
    __slots__ = ("attributes", "children", "tag", "text")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes = tag, attributes
        self.children: list[Element | str] = []
        self.text: str | None = None  # of a rendered table


class TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("html", {})
        self.open = [self.root]
        self.counts = Counter(["html"])  # of open elements by name
        self.rules: list[tuple[str, str, str]] = []
        self.styles: list[tuple[Element, list[str]]] = []

    def handle_starttag(self, tag, attrs):
        attributes = {k: v or "" for k, v in attrs}
        if tag in ("html", "body"):
            self._leave("head")
            if tag == "html":
                self.root.attributes = attributes | self.root.attributes
                return
            if self.counts["body"]:
                return
        if tag in BLOCK:
            self._leave("head")
        if tag in ENDS_PARAGRAPH:
            self._close({"p"}, PARAGRAPH_SCOPE)
        if tag in IMPLIED_ENDS:
            self._close(*IMPLIED_ENDS[tag])
        if tag == "a":
            self._close({"a"}, BLOCK)
        if self.counts["svg"]:
            if tag in SVG_HIDDEN:
                attributes["hidden"] = ""
            elif tag == "text":
                self.open[-1].children.append(" ")
        element = Element(tag, attributes)
        self.open[-1].children.append(element)
        if tag not in VOID:
            self.open.append(element)
            self.counts[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        # Only drawings and formulas have elements that end at once.
        if (self.counts["svg"] or self.counts["math"]) and self.open[-1].tag == tag:
            self.counts[self.open.pop().tag] -= 1

    def handle_endtag(self, tag):
        if tag == "br":
            self.open[-1].children.append(Element("br", {}))
        elif tag == "p" and not self.counts["p"]:
            self.open[-1].children.append(Element("p", {}))
        elif tag not in ("html", "body"):
            self._close({tag}, set() if tag in TABLE_PARTS else {"td", "th", "table"})
            if tag == "text" and self.counts["svg"]:
                self.open[-1].children.append(" ")

    def handle_data(self, data):
        if self.open[-1].tag == "style":
            if not self.styles or self.styles[-1][0] is not self.open[-1]:
                self.styles.append((self.open[-1], []))
            self.styles[-1][1].append(data)
        elif self.counts["svg"] and not any(self.counts[t] for t in SVG_TEXT):
            return
        elif self.open[-1].tag in TABLE_CONTEXT and self.counts["table"] and data.strip():
            # Text between cells stands before the table, which is the last child so far.
            at = len(self.open) - 1
            while self.open[at].tag != "table":
                at -= 1
            self.open[at - 1].children.insert(-1, data)
        elif data:
            if self.open[-1].tag == "head" and data.strip():
                self._leave("head")
            self.open[-1].children.append(data)

    def _leave(self, tag: str) -> None:
        while self.counts[tag]:
            self.counts[self.open.pop().tag] -= 1

    def _close(self, names: set[str], bounds: set[str]) -> None:
        """Close the nearest open element of ``names``, with what is open inside it."""
        if not any(self.counts[n] for n in names):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in names:
                self.counts.subtract(e.tag for e in self.open[i:])
                del self.open[i:]
                return
            if self.open[i].tag in bounds:
                return


def _on_screen(media: str) -> bool:
    """Whether a list of media queries holds for a screen; conditions not known here do not."""

    def holds(part: str) -> bool:
        if part in ("", "all", "screen", "only screen", "only all"):
            return True
        if part.startswith("not ") and "(" not in part:
            return part.split()[1] not in ("all", "screen")
        if not (m := MEDIA_SIZE.fullmatch(part)) or m[3].count(".") > 1 or m[3] == ".":
            return False
        size = float(m[3]) * (1 if m[4] == "px" else 16)
        return SCREEN[m[2]] >= size if m[1] == "min" else SCREEN[m[2]] <= size

    queries = media.lower().split(",")
    return any(all(map(holds, re.split(r"\s+and\s+", " ".join(q.split())))) for q in queries)


def _applies(prelude: str) -> bool:
    """Whether the rules inside a block count, by what stands before it."""
    name, _, condition = prelude.lower().replace("(", " (", 1).partition(" ")
    if name == "@media":
        return _on_screen(condition)
    return name == "@layer" or (name == "@supports" and not condition.strip().startswith("not"))


def hiding_rules(css: str) -> list[tuple[str, str, str]]:
    """(name, class, id) of the simple selectors that are not displayed on a screen."""
    css = CSS_COMMENT.sub(" ", css)
    css += "}" * css.count("{")
    rules, start = [], 0
    blocks: list[tuple[str, list[str]]] = []  # open ones: what stands before, own declarations
    for m in CSS_MARK.finditer(css):
        if (mark := m.group()) not in "{};":
            continue
        piece, start = css[start : m.start()], m.end()
        if mark == "{":
            blocks.append((piece.strip(), []))
        elif blocks:
            blocks[-1][1].append(piece)
            if mark == "}":
                selectors, body = blocks.pop()
                if HIDDEN_STYLE.search(";".join(body)) and all(_applies(p) for p, _ in blocks):
                    for selector in selectors.split(","):
                        if (found := SIMPLE.match(selector.strip())) and found.group():
                            rules.append(tuple((g or "") for g in found.groups()))
    return rules


def parse(html: str) -> TreeBuilder:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    for style, css in builder.styles:
        if _on_screen(style.attributes.get("media", "")):
            builder.rules += hiding_rules("".join(css))
    return builder


def _shown(e: Element, rules: list[tuple[str, str, str]]) -> bool:
    if e.tag in NOT_SHOWN or "hidden" in e.attributes:
        return False
    if HIDDEN_STYLE.search(e.attributes.get("style", "")):
        return False
    if e.tag == "dialog" and "open" not in e.attributes:
        return False
    classes = e.attributes.get("class", "").split()
    for tag, name, identity in rules:
        if (
            (not tag or tag.lower() == e.tag)
            and (not name or name in classes)
            and (not identity or identity == e.attributes.get("id"))
        ):
            return False
    return True


class Page:
    """Collects lines: collapses spaces, separates blocks, indents lists."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.blank = False  # a blank line is due before the next text
        self.space = False
        self.indents: list[str] = []
        self.bullet = ""

    def text(self, data: str, keep_spaces: bool) -> None:
        if keep_spaces:
            first, *rest = data.split("\n")
            self._add(first)
            for line in rest:
                self.end_line(True)
                self._add(line)
            return
        words = SPACES.sub(" ", data)
        if words.startswith(" "):
            self.space = True
        core = words.strip(" ")
        if core:
            if self.space and self.parts:
                core = " " + core
            self.space = False
            self._add(core)
            self.space = words.endswith(" ")

    def _add(self, text: str) -> None:
        if text:
            self.parts.append(text)

    def end_line(self, even_if_empty: bool = False) -> None:
        if self.parts or even_if_empty:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            lead = "".join(self.indents)
            if self.bullet:
                lead, self.bullet = lead[: len(lead) - len(self.bullet)] + self.bullet, ""
            self.lines.append((lead + "".join(self.parts)).rstrip(" "))
            self.parts = []
        self.space = False

    def block(self, spaced: bool) -> None:
        self.end_line()
        if spaced and self.lines:
            self.blank = True

    def rendered(self) -> str:
        self.end_line()
        return "\n".join(self.lines).strip("\n")


def _list_items(e: Element) -> list[Element]:
    return [c for c in e.children if isinstance(c, Element) and c.tag == "li"]


def _options(select: Element, rules) -> list[str]:
    """What a closed list shows, its chosen option, or all lines of an open one."""
    size = select.attributes.get("size", "")
    is_open = "multiple" in select.attributes or (size.isdigit() and size.lstrip("0") not in ("", "1"))
    lines, chosen, usable = [], [], []
    stack = list(reversed(select.children))
    while stack:
        e = stack.pop()
        if isinstance(e, str) or not _shown(e, rules):
            continue
        if e.tag != "option":
            if e.tag == "optgroup":
                lines.append(e.attributes.get("label", ""))
            stack += reversed(e.children)
            continue
        parts, inside = [], list(reversed(e.children))
        while inside:
            c = inside.pop()
            if isinstance(c, str):
                parts.append(c)
            else:
                inside += reversed(c.children)
        lines.append(e.attributes.get("label") or "".join(parts))
        if "selected" in e.attributes:
            chosen.append(lines[-1])
        elif "disabled" not in e.attributes:
            usable.append(lines[-1])
    return lines if is_open else (chosen[-1:] or usable[:1])


def _render(root: Element, rules, hidden: bool = False) -> str:
    """Text of an element whose inner tables are rendered already."""
    page = Page()
    # (element or text, entering, hidden, preformatted)
    stack: list[tuple] = [(root, True, hidden, False)]
    numbers: dict[int, str] = {}
    while stack:
        item, entering, hidden, keep = stack.pop()
        if isinstance(item, str):
            if not hidden:
                page.text(item, keep)
            continue
        e, inner = item, item is not root
        if not entering:
            if e.tag == "li":
                page.end_line()
                page.indents.pop()
                page.bullet = ""
            if e.tag in BLOCK:
                page.block(e.tag in SPACED and not (page.indents and e.tag in ("ul", "ol", "menu")))
            if e.tag == "blockquote" or e.tag == "dd":
                page.indents.pop()
            continue
        if inner and not _shown(e, rules):
            continue
        if m := VISIBILITY.search(e.attributes.get("style", "")):
            hidden = m.group(1).lower() != "visible"
        if e.tag == "br":
            if not hidden:
                page.end_line(True)
            continue
        if e.tag == "hr":
            page.block(True)
            if not hidden:
                page.text("----", False)
            page.block(True)
            continue
        if e.tag == "table" and inner:
            page.block(True)
            if e.text:
                for line in e.text.split("\n"):
                    page.text(line, True)
                    page.end_line(True)
            page.block(True)
            continue
        if e.tag == "select":
            for k, line in enumerate([] if hidden else _options(e, rules)):
                if k:
                    page.end_line()
                page.text(f" {line} ", False)
            continue
        if e.tag in BLOCK:
            page.block(e.tag in SPACED and not (page.indents and e.tag in ("ul", "ol", "menu")))
        if e.tag in ("ul", "ol", "menu"):
            start = e.attributes.get("start", "")
            first = int(start) if start.lstrip("-").isdigit() and len(start) < 10 else 1
            for k, li in enumerate(_list_items(e)):
                numbers[id(li)] = f"{first + k}. " if e.tag == "ol" else "- "
        if e.tag == "li":
            bullet = numbers.get(id(e), "- ")
            page.indents.append(" " * len(bullet))
            page.bullet = "" if hidden else bullet
        elif e.tag == "blockquote":
            page.indents.append("> ")
        elif e.tag == "dd":
            page.indents.append("    ")
        keep = keep or e.tag in ("pre", "listing", "xmp", "textarea")
        stack.append((e, False, hidden, keep))
        sign, parts_left = SIGNS.get(e.tag), 0
        closed = e.tag == "details" and "open" not in e.attributes
        for i in range(len(e.children) - 1, -1, -1):
            child = e.children[i]
            if closed and not (isinstance(child, Element) and child.tag == "summary"):
                continue
            if keep and i == 0 and isinstance(child, str) and e.tag in ("pre", "textarea"):
                child = child.removeprefix("\n")
            stack.append((child, True, hidden, keep))
            if sign and isinstance(child, Element):
                if parts_left:
                    stack.insert(-1, (sign, True, hidden, keep))
                parts_left += 1
    return page.rendered()


def _rows_of(table: Element, rules) -> tuple[list[Element], list[list[Element]]]:
    """(captions, rows of cells) that are shown; text outside of cells stands before the table."""
    captions, rows = [], []
    stack: list[Element] = [c for c in reversed(table.children) if isinstance(c, Element)]
    while stack:
        e = stack.pop()
        if not _shown(e, rules):
            continue
        if e.tag in ("thead", "tbody", "tfoot", "colgroup"):
            stack += [c for c in reversed(e.children) if isinstance(c, Element)]
        elif e.tag == "tr":
            rows.append(
                [c for c in e.children if isinstance(c, Element) and _shown(c, rules)]
            )
        elif e.tag in CELLS:
            rows.append([e])
        elif e.tag != "col":
            captions.append(e)
    return captions, rows


def _span(cell: Element) -> int:
    span = cell.attributes.get("colspan", "")
    return min(max(int(span), 1), 1000) if span.isdigit() and len(span) < 6 else 1


def _render_table(table: Element, rules, hidden: bool) -> str:
    """Cells side by side, columns aligned up to ``ALIGNED_WIDTH``."""
    captions, rows = _rows_of(table, rules)
    out = [t for c in captions if (t := _render(c, rules, hidden))]
    grid, widths = [], {}
    for row in rows:
        cells, column = [], 0
        for cell in row:
            lines = _render(cell, rules, hidden).split("\n")
            cells.append((column, lines))
            if _span(cell) == 1:
                width = max(map(len, lines))
                widths[column] = max(widths.get(column, 0), min(width, ALIGNED_WIDTH))
            column += _span(cell)
        grid.append(cells)
    at, offsets = 0, {}
    for column in range(max(widths, default=-1) + 2):
        offsets[column] = at
        at += widths.get(column, 0) + (len(GAP) if column in widths else 0)
    for cells in grid:
        height = max((len(lines) for _, lines in cells), default=0)
        for k in range(height):
            line = ""
            for column, lines in cells:
                if k < len(lines) and lines[k]:
                    line = line.ljust(offsets.get(column, at))
                    line += (GAP if line and not line.endswith(GAP) else "") + lines[k]
            if line.strip():
                out.append(line.rstrip(" "))
    return "\n".join(out)


def _hidden_tables(root: Element) -> list[tuple[Element, bool]]:
    """Tables in document order, each with whether visibility hides it."""
    found, stack = [], [(root, False)]
    while stack:
        e, hidden = stack.pop()
        if m := VISIBILITY.search(e.attributes.get("style", "")):
            hidden = m.group(1).lower() != "visible"
        if e.tag == "table":
            found.append((e, hidden))
        stack += [(c, hidden) for c in reversed(e.children) if isinstance(c, Element)]
    return found


def visible_text(html: str) -> str:
    builder = parse(html)
    for table, hidden in reversed(_hidden_tables(builder.root)):
        table.text = _render_table(table, builder.rules, hidden)
    return _render(builder.root, builder.rules)


def _extracted(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = batch.column("html").to_pylist()
        texts = [None if p is None else visible_text(p) for p in pages]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("page_id"),
                pa.array(texts, pa.string()),
                pa.array([len(t or "") for t in texts], pa.int64()),
                pa.array([len(t.split("\n")) if t else 0 for t in texts], pa.int64()),
            ],
            names=["page_id", "text", "n_chars", "n_lines"],
        )


def extract_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text, n_chars and n_lines of every row."""
    extracted = _extracted
    return df.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")
    ).mapInArrow(
        lambda b: extracted(b), "page_id long, text string, n_chars long, n_lines long"
    )
