"""HTML extraction by layout-aware rendering.

A page is read into a tree: start tags close what they imply (a paragraph, a list item, a
table cell), missing tags of tables are put in, and end tags close up to their element.
Rendering walks the tree the way a page is laid out: hidden elements are left out, blocks
stand on lines of their own, paragraphs and the like are set apart by a blank line, list
items get bullets or numbers and are indented by depth, preformatted text keeps its spaces,
and the cells of a table are padded to common column widths. Formulas, labels of inline
drawings, choices and the content of text areas stand in the line; what a drawing or formula
holds but does not show itself (titles, definitions, annotations) is left out, and so is text
that only a reference to a definition would show.
"""

from __future__ import annotations

import html
import re
import sys
from collections import Counter
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# Executors get these functions by value, so they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# What the HTML standard says of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset(
    "head script style template noscript noembed noframes iframe object audio video canvas datalist "
    "title meta link base".split()
)
#: What stands in a drawing or formula but is not shown: descriptions, definitions, other notations.
HIDDEN_IN = {
    "svg": frozenset("title desc metadata defs symbol clippath mask marker pattern lineargradient radialgradient filter".split()),
    "math": frozenset("annotation annotation-xml mphantom".split()),
}
#: Text of these stands apart from what is beside it on the line: labels and choices.
SPACED = frozenset("svg text foreignobject mtd select optgroup option textarea".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr fieldset".split())
BLOCK = APART | frozenset(
    "html body address article aside div dd dt details dialog figcaption footer form header hgroup legend li main "
    "nav section summary caption menu dir center search tr".split()
)
#: A start tag closes an open element of these, unless one of the barriers comes first.
CLOSES = (
    {
        "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("optgroup", "option"),
        "tr": ("tr", "td", "th", "caption", "colgroup"), "td": ("td", "th"), "th": ("td", "th"),
        "thead": ("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"),
        "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"),
        "tfoot": ("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"),
        "body": ("head",), "rt": ("rt", "rp"), "rp": ("rt", "rp"), "a": ("a",), "button": ("button",),
    }
    | {tag: ("p",) for tag in BLOCK - {"li", "dt", "dd", "tr", "html", "body", "caption", "legend", "summary"}}
)
BARRIERS = {
    "li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "a": ("table", "td", "th"), "button": ("form",),
}
TABLE_BARRIER = ("table",)
#: What may stand in a table but outside its cells; all else is moved before the table.
TABLE_PARTS = frozenset("caption colgroup col thead tbody tfoot tr td th script style template".split())
TABLE_OPEN = frozenset("table thead tbody tfoot tr".split())
PARAGRAPH_BARRIER = ("table", "td", "th", "caption", "button", "object")

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.DOTALL
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_BARE_VALUE_END = re.compile(r"=\s*[^\s\"'=<>`]*/\Z")
_INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.IGNORECASE)


@dataclass(slots=True)
class Element:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)
    unseen: bool = False

    def hidden(self) -> bool:
        if self.unseen or self.tag in HIDDEN or "hidden" in self.attributes:
            return True
        if self.tag == "input" or (self.tag == "dialog" and "open" not in self.attributes):
            return True
        if self.attributes.get("aria-hidden", "").lower() == "true":
            return True
        style = self.attributes.get("style")
        return bool(style and _INVISIBLE.search(style))


def parse(source: str) -> Element:
    """The tree of a page. Any text gives a tree; what is no tag is text."""
    root = Element("#root")
    stack = [root]
    is_open: Counter[str] = Counter()

    def cut(at: int) -> None:
        is_open.subtract(e.tag for e in stack[at:])
        del stack[at:]

    def close(tags: tuple[str, ...], barriers: tuple[str, ...]) -> None:
        """Closes up to the outermost open element of these tags on this side of a barrier."""
        if not any(is_open[t] for t in tags):
            return
        for at in range(len(stack) - 1, 0, -1):
            if stack[at].tag in barriers:
                return
            if stack[at].tag in tags:
                deepest = at
                for upper in range(at - 1, 0, -1):
                    if stack[upper].tag in barriers:
                        break
                    if stack[upper].tag in tags:
                        deepest = upper
                cut(deepest)
                return

    def place(node: Element | str) -> None:
        """Puts a node into the open element, or before the table whose cells it is not in."""
        inside = stack[-1].tag in TABLE_OPEN and (
            bool(node.strip()) if isinstance(node, str) else node.tag not in TABLE_PARTS
        )
        if not inside:
            stack[-1].children.append(node)
            return
        at = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == "table"), 0)
        siblings = stack[at - 1].children if at else stack[-1].children
        siblings.insert(len(siblings) - 1 if at else len(siblings), node)

    def foreign() -> bool:
        return bool(is_open["svg"] or is_open["math"]) and not is_open["foreignobject"]

    def made(tag: str, attributes: dict[str, str]) -> Element:
        unseen = foreign() and any(is_open[kind] and tag in tags for kind, tags in HIDDEN_IN.items())
        element = Element(tag, attributes, unseen=unseen)
        place(element)
        return element

    def open_element(tag: str, attributes: dict[str, str]) -> Element:
        element = made(tag, attributes)
        stack.append(element)
        is_open[tag] += 1
        return element

    at, n = 0, len(source)
    while at < n:
        match = _TAG.search(source, at)
        if match is None:
            place(html.unescape(source[at:]))
            break
        if match.start() > at:
            place(html.unescape(source[at : match.start()]))
        at = match.end()
        if match[2] is None:
            if foreign() and source.startswith("<![CDATA[", match.start()):
                stop = source.find("]]>", match.start())
                stop = n if stop < 0 else stop
                place(source[match.start() + 9 : stop])
                at = min(n, stop + 3)
            continue
        tag = match[2].lower()
        if match[1]:
            if tag == "p" and not is_open["p"]:
                place(Element("p"))
            elif tag == "br":
                place(Element("br"))
            elif is_open[tag]:
                for up in range(len(stack) - 1, 0, -1):
                    if stack[up].tag == tag:
                        cut(up)
                        break
                    if stack[up].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                        break
            continue
        attributes = {}
        if match[3].strip(" /\n\t"):
            for name, double, single, bare in _ATTRIBUTE.findall(match[3]):
                attributes.setdefault(name.lower(), html.unescape(double or single or bare))
        if tag in ("html", "body") and is_open[tag]:
            continue
        if tag == "table" and stack[-1].tag in TABLE_OPEN and is_open["table"]:
            # A table cannot stand between the cells of another; it ends that one.
            cut(max(k for k in range(1, len(stack)) if stack[k].tag == "table"))
        closed = CLOSES.get(tag)
        if closed:
            if tag in BARRIERS:
                barrier = BARRIERS[tag]
            elif closed == ("p",):
                barrier = PARAGRAPH_BARRIER
            else:
                barrier = TABLE_BARRIER
            close(closed, barrier)
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            open_element("tr", {})
        # Elements of drawings and formulas may end in their start tag.
        rest = match[3].rstrip()
        if tag in VOID or (rest.endswith("/") and not _BARE_VALUE_END.search(rest) and (foreign() or tag in HIDDEN_IN)):
            made(tag, attributes)
            continue
        element = open_element(tag, attributes)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(source, at)
            stop, after = (end.start(), end.end()) if end else (n, n)
            text = source[at:stop]
            element.children.append(html.unescape(text) if tag in ("textarea", "title") else text)
            at = after
            cut(len(stack) - 1)
    return root


class _Lines:
    """Text laid out in lines: runs of spaces collapse, blank lines are kept between blocks only."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = False
        self.space = False
        self.indent = ""
        self.mark = ""

    def text(self, text: str) -> None:
        words = _SPACE.sub(" ", text)
        if words == " " or not words:
            self.space = self.space or bool(words and self.line)
            return
        if (self.space or words[0] == " ") and self.line:
            self.line.append(" ")
        self.line.append(words.strip(" "))
        self.space = words[-1] == " "

    def newline(self) -> None:
        """Ends the line, if there is any text on it."""
        self.space = False
        text = "".join(self.line)
        self.line = []
        if text:
            self._put(text)

    def _put(self, text: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        self.lines.append((self.indent + self.mark + text).rstrip())
        if self.mark:
            self.indent += " " * len(self.mark)
            self.mark = ""

    def apart(self) -> None:
        self.newline()
        # What opens a list item goes on the line of its mark.
        self.blank = self.blank or not self.mark

    def verbatim(self, lines: list[str]) -> None:
        self.newline()
        for line in lines:
            self._put(line)

    def result(self) -> str:
        self.newline()
        return "\n".join(self.lines)


def _rows(table: Element) -> tuple[list[Element], list[list[Element]]]:
    """Captions, and the rows of cells in their order (head, body, foot)."""
    captions, parts = [], {"thead": [], "": [], "tfoot": []}
    for child in table.children:
        if isinstance(child, str) or child.hidden():
            continue
        if child.tag == "caption":
            captions.append(child)
        elif child.tag == "tr":
            parts[""].append(child)
        elif child.tag in ("thead", "tbody", "tfoot"):
            rows = [c for c in child.children if not isinstance(c, str) and c.tag == "tr" and not c.hidden()]
            parts[child.tag if child.tag != "tbody" else ""].extend(rows)
    rows = parts["thead"] + parts[""] + parts["tfoot"]
    return captions, [
        [c for c in row.children if not isinstance(c, str) and c.tag in ("td", "th") and not c.hidden()] for row in rows
    ]


def _span(cell: Element, name: str) -> int:
    value = cell.attributes.get(name, "1")
    return min(max(1, int(value)), 1000) if value.isdigit() and len(value) < 6 else 1


def _table(table: Element) -> Generator[Element, str, list[str]]:
    """The lines of a table, its columns aligned; a spanning cell stands in its first place.

    Asks for the text of every cell and is sent it.
    """
    _, rows = _rows(table)
    grid: list[dict[int, list[str]]] = []
    taken: dict[tuple[int, int], bool] = {}
    for r, row in enumerate(rows):
        line: dict[int, list[str]] = {}
        column = 0
        for cell in row:
            while taken.get((r, column)):
                column += 1
            line[column] = (yield cell).split("\n")
            width = _span(cell, "colspan")
            for below in range(1, min(_span(cell, "rowspan"), len(rows) - r)):
                for c in range(column, column + width):
                    taken[(r + below, c)] = True
            column += width
        grid.append(line)
    widths: dict[int, int] = {}
    for line in grid:
        for column, texts in line.items():
            widths[column] = max(widths.get(column, 0), *map(len, texts))
    columns = sorted(widths)
    out = []
    for line in grid:
        for k in range(max((len(t) for t in line.values()), default=0)):
            cells = [(line[c][k] if c in line and k < len(line[c]) else "").ljust(widths[c]) for c in columns]
            out.append("  ".join(cells).rstrip())
    return out


def render(root: Element) -> str:
    """The visible text of an element, laid out; tables are aligned however deep they nest."""
    # Layouts that wait for the text of a cell within them, innermost last: no recursion.
    waiting = [_layout(root)]
    text = None
    while waiting:
        try:
            waiting.append(_layout(waiting[-1].send(text)))
            text = None
        except StopIteration as finished:
            waiting.pop()
            text = finished.value
    return text


def _layout(root: Element) -> Generator[Element, str, str]:
    """Lays out an element; asks for the text of captions and cells of tables and is sent it."""
    out = _Lines()
    # Explicit stack: pages may nest deeper than Python's recursion goes.
    todo: list[tuple] = [("walk", child, 0) for child in reversed(root.children)]
    while todo:
        action, node, depth = todo.pop()
        if action == "end":
            node()
            continue
        if isinstance(node, str):
            out.text(node)
            continue
        if node.hidden():
            continue
        tag = node.tag
        if tag == "br":
            if out.line:
                out.newline()
            else:
                out.blank = True
            continue
        if tag == "hr":
            out.apart()
            continue
        if tag == "img":
            out.text(f" {node.attributes.get('alt', '').strip()} " if node.attributes.get("alt", "").strip() else "")
            continue
        if tag == "pre":
            out.apart()
            text = "".join(_strings(node)).replace("\r\n", "\n").replace("\r", "\n")
            out.verbatim([line.rstrip() for line in text.removeprefix("\n").rstrip("\n").split("\n")])
            out.apart()
            continue
        if tag == "table":
            out.apart()
            for caption in _rows(node)[0]:
                out.verbatim((yield caption).split("\n"))
            out.verbatim((yield from _table(node)))
            out.apart()
            continue
        if tag in ("ul", "ol", "menu", "dir"):
            edge = out.newline if depth else out.apart
            edge()
            number = int(node.attributes["start"]) if node.attributes.get("start", "").lstrip("-").isdigit() else 1
            steps: list[tuple] = []
            for child in node.children:
                if not isinstance(child, str) and child.tag == "li" and not child.hidden():
                    steps.extend(_item(out, child, f"{number}. " if tag == "ol" else "- ", depth))
                    number += 1
                else:
                    steps.append(("walk", child, depth))
            steps.append(("end", edge, depth))
            todo.extend(reversed(steps))
            continue
        edge = out.apart if tag in APART else out.newline if tag in BLOCK else None
        if edge:
            edge()
            todo.append(("end", edge, depth))
        if tag in SPACED or (tag == "tspan" and not node.attributes.keys().isdisjoint(("x", "y", "dy"))):
            out.text(" ")
            todo.append(("end", lambda: out.text(" "), depth))
            label = node.attributes.get("label", "") if tag in ("optgroup", "option") else ""
            if label and (tag == "optgroup" or not any(c.strip() for c in _strings(node))):
                out.text(f" {label} ")
        if tag == "mfrac":
            parts = [c for c in node.children if not isinstance(c, str)]
            apart = [x for part in parts for x in (" ", part)][1:]
            todo.extend(("walk", x, depth) for x in reversed(apart))
            continue
        if tag in ("td", "th"):
            todo.append(("end", lambda: out.text(" "), depth))
        todo.extend(("walk", child, depth) for child in reversed(node.children))
    return out.result()


def _item(out: _Lines, item: Element, mark: str, depth: int) -> list[tuple]:
    """The steps that lay out one list item behind its mark."""
    kept: list[str] = []

    def begin() -> None:
        out.newline()
        kept.append(out.indent)
        out.mark = mark

    def finish() -> None:
        out.newline()
        out.mark, out.indent = "", kept.pop()
        out.blank = False

    inside = [("walk", child, depth + 1) for child in item.children]
    return [("end", begin, depth), *inside, ("end", finish, depth)]


def _strings(element: Element) -> Iterator[str]:
    todo = list(reversed(element.children))
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            yield node
        elif node.tag == "br":
            yield "\n"
        elif not node.hidden():
            todo.extend(reversed(node.children))


def title(root: Element) -> str | None:
    """The text of the first title element."""
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag == "title":
            return _SPACE.sub(" ", "".join(c for c in node.children if isinstance(c, str))).strip()
        todo.extend(c for c in reversed(node.children) if not isinstance(c, str))
    return None


OUTPUT = "page_id long, url string, title string, text string, n_chars long, n_lines long"


def _render_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in OUTPUT.split(", ")]
    for batch in batches:
        rows = []
        for page_id, url, source in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
            root = parse(source or "")
            text = render(root)
            rows.append((page_id, url, title(root), text, len(text), text.count("\n") + 1 if text else 0))
        out = pd.DataFrame(rows, columns=names)
        out["page_id"] = out["page_id"].astype("Int64")
        yield out


def extract_text(pages: DataFrame) -> DataFrame:
    """The visible text of every page.

    Returns page_id, url, title (null without a title element), text, n_chars (code points)
    and n_lines. Null and empty pages give an empty text. Every input row gives a result row,
    repeated ones and null page_ids included; pages of any length, depth or malformation are
    read to their end. Further columns are ignored; no input gives no rows.
    """
    return pages.select("page_id", "url", "html").mapInPandas(_render_batches, OUTPUT)
