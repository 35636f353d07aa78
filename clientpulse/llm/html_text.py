"""HTML to text by layout.

A tokenizer over one regular expression feeds a tree builder that closes what HTML
lets pages leave open (``IMPLIED_END``), ignores end tags without a start, and closes
everything at the end. A renderer walks the tree and writes all visible text:

* what a browser does not render shows nothing: ``head``, ``title``, ``script``, ``style``,
  ``template``, ``noscript``, ``iframe``, ``noembed``, ``noframes``, ``datalist``, what stands
  in for ``object``, ``canvas``, ``audio`` and ``video``, comments, ``hidden`` attributes and the
  inline styles ``display:none`` and ``visibility:hidden``; images show their alt text;
* formulas (``math``) show their text without annotations, fractions and cells set apart;
  drawings (``svg``) the text and HTML drawn in place, not what ``use`` repeats;
* a drop-down list shows its selected, else its first enabled option, a list box all options;
* white space is one space, and kept in ``pre`` and ``textarea``;
* blocks start on lines of their own, paragraphs and headings with a blank line around;
* list items are indented by depth and marked with ``-`` or their number;
* table rows are lines, their cells padded to the width of their column; a cell takes
  ``colspan`` columns and keeps them for ``rowspan`` rows of its part of the table, and
  lines of a cell are joined by spaces.

Defined cases: null and empty pages give an empty text, as do pages without visible
text; broken markup is text or ignored, never an error; nesting beyond ``MOST_DEPTH``
shows its text at that depth, hidden or not as its own elements say. Each page is rendered alone, so equal pages give equal texts.
Extra columns are not read; an empty table gives an empty result."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientpulse.llm.common import quoted, slices, text_of
from clientpulse.session import ship_package

MOST_DEPTH = 200
#: Levels more for what a drawing, formula or list holds; open elements that a tag looks back over.
MORE_DEPTH, FAR = 60, 1000
COMMENT = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))", re.DOTALL)
NAME_END = re.compile(r"[\s/>]")
TAG_MARK = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
UNQUOTED_END = re.compile(r"=\s*[^\s\"'>]*/\Z")
SPACE = re.compile(r"[ \t\n\r\f]+")
NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes object canvas audio video datalist".split())
FOREIGN = frozenset("svg math".split())
UNDRAWN = frozenset("defs symbol desc metadata clippath mask pattern marker lineargradient radialgradient filter".split())
UNWRITTEN = frozenset("annotation annotation-xml mphantom".split())
#: Elements of drawings and formulas that may hold HTML, and HTML tags that end a drawing or formula elsewhere.
HOLDS_HTML = frozenset("foreignobject desc mi mo mn ms mtext annotation-xml".split())
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure fieldset hr".split())
BLOCK = SPACED | frozenset(
    "address article aside body center dd details dialog dir div dt fieldset figcaption footer form header html legend li main menu nav optgroup option section summary tbody tfoot thead tr caption".split()
)
CLOSES_P = BLOCK - frozenset("body html li dd dt tr tbody thead tfoot caption legend option optgroup summary".split())
#: Start tag -> open elements it ends, and the elements beyond which it does not look.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table", "template"}),
    "td": ({"td", "th"}, {"tr", "table", "template"}),
    "th": ({"td", "th"}, {"tr", "table", "template"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table", "template"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table", "template"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table", "template"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: What an open head or colgroup may hold; anything else, and text that is not blank, ends it.
HOLDS = {
    "head": frozenset("base basefont bgsound link meta title style script template noscript noframes head".split()),
    "colgroup": frozenset({"col", "template"}),
}
SCOPE = frozenset("table td th caption html button object template".split()) | HOLDS_HTML
#: Start tag inside a table -> elements it may stand in; whatever is open within those ends.
GROUPS = frozenset("thead tbody tfoot".split())
PLACE = (
    dict.fromkeys(("thead", "tbody", "tfoot", "caption", "colgroup"), frozenset({"table"}))
    | dict.fromkeys(("td", "th"), GROUPS | {"table", "tr"})
    | {"tr": GROUPS | {"table"}, "col": frozenset({"table", "colgroup"})}
)


class Element:
    __slots__ = ("attributes", "children", "depth", "most", "tag")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []
        self.depth, self.most = 0, MOST_DEPTH

    def get(self, name: str) -> str | None:
        """An attribute's value, empty without one; None without the attribute."""
        for key, *values in ATTRIBUTE.findall(self.attributes):
            if key.lower() == name:
                return html.unescape(next((v for v in values if v), ""))
        return None


class Ahead:
    """The next place of a pattern from a position on; asked in any order within one gap, it
    is searched for once."""

    def __init__(self, page: str, pattern: re.Pattern):
        self.page, self.pattern, self.first, self.found = page, pattern, 1, 0

    def __call__(self, at: int) -> int:
        if not self.first <= at <= self.found:
            match = self.pattern.search(self.page, at)
            self.first, self.found = at, match.start() if match else len(self.page)
        return self.found


class Tokens:
    """The tags, comments and declarations of a page, in one pass forward. A tag ends at the
    first ``>`` outside of quotes; what has none, or a quote without its partner, is text.
    Quotes from which no end is reached are remembered, so broken pages take linear time."""

    def __init__(self, page: str):
        self.page = page
        self.name_end, self.mark = Ahead(page, NAME_END), Ahead(page, TAG_MARK)
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.dead: set[int] = set()

    def tag_end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag whose attributes start at ``at``, or -1."""
        page, seen = self.page, []
        while at <= self.last[">"]:
            at = self.mark(at)
            sign = page[at : at + 1]
            if sign == ">":
                return at
            if not sign or at in self.dead or self.last[sign] <= at:
                break
            seen.append(at)
            at = page.find(sign, at + 1) + 1
        self.dead.update(seen)
        return -1

    def following(self, at: int) -> tuple[int, int, bool, str | None, str] | None:
        """(start, end, is it an end tag, name, attributes) of the next token; no name for
        what is no tag."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            sign = page[start + 1 : start + 2]
            if sign and sign in "!?":
                if page.startswith("<!--", start):
                    return start, COMMENT.match(page, start).end(), False, None, ""
                end = page.find(">", start + 2)
                return start, len(page) if end < 0 else end + 1, False, None, ""
            first = start + 2 if sign == "/" else start + 1
            letter = page[first : first + 1]
            if letter.isascii() and letter.isalpha() and first <= self.last[">"]:
                stop = self.name_end(first)
                end = self.tag_end(stop)
                if end < 0 and self.mark(first) < stop:
                    # a quote in the name may open the attributes
                    stop, end = self.mark(first), self.tag_end(first)
                if end >= 0:
                    return start, end + 1, sign == "/", page[first:stop], page[stop:end]
            at = start + 1
        return None


def build(page: str) -> Element:
    """The tree of a page."""
    root = Element("html")
    stack, at, n, drawn = [root], 0, len(page), False
    opened: Counter[str] = Counter()

    def push(element: Element) -> None:
        """Open an element that the tree has. Beyond the depth it stays empty there: what is
        in it goes to its parent, or nowhere if it is hidden."""
        parent = stack[-1]
        most = MOST_DEPTH + MORE_DEPTH if element.tag in FOREIGN or element.tag == "select" else parent.most
        if parent.depth + 1 < most:
            element.depth = parent.depth + 1
        else:
            if element.tag in ("td", "th"):
                parent.children.append(" ")
            element = Element(element.tag, element.attributes)
            element.depth = parent.depth
            if not hidden(element):
                element.children = parent.children
        element.most = most
        stack.append(element)
        opened[element.tag] += 1

    def cut(i: int) -> None:
        for outer, e in zip(stack[i - 1 :], stack[i:]):
            opened[e.tag] -= 1
            if e.depth == outer.depth and e.tag in BLOCK:
                e.children.append(Element("div"))  # beyond the depth, a block still ends its line
        del stack[i:]

    def back() -> range:
        return range(len(stack) - 1, max(0, len(stack) - FAR), -1)

    def close(ends, until) -> None:
        if not any(opened[tag] > 0 for tag in ends):
            return
        for i in back():
            if stack[i].tag in until:
                return
            if stack[i].tag in ends:
                cut(i)
                if not ends & {"tr", "tbody", "option"}:
                    return
                close(ends, until)
                return

    def place(tag: str) -> bool:
        """Make room in the innermost table; False if there is none."""
        if opened["table"] <= 0:
            return False
        for i in back():
            if stack[i].tag == "template":
                return False
            if stack[i].tag in PLACE[tag]:
                cut(i + 1)
                return True
            if stack[i].tag == "table":
                return False
        return False

    def foreign() -> int:
        """The place of the drawing or formula whose own content comes next, or 0."""
        for i in back() if drawn else ():
            if stack[i].tag in HOLDS_HTML:
                return 0
            if stack[i].tag in FOREIGN:
                return i
        return 0

    def write(text: str) -> None:
        if stack[-1].tag in HOLDS and text.strip(" \t\n\r\f"):
            cut(len(stack) - 1)
        stack[-1].children.append(html.unescape(text))

    tokens = Tokens(page)
    while at < n:
        token = tokens.following(at)
        if token is None:
            write(page[at:])
            break
        start, end, is_end, name, attributes = token
        if start > at:
            write(page[at:start])
        at = end
        if name is None:
            if page.startswith("<![CDATA[", start) and foreign():
                end = page.find("]]>", start)
                at = n if end < 0 else end + 3
                stack[-1].children.append(page[start + 9 : n if end < 0 else end])
            continue
        tag = name.lower()
        if is_end:
            if tag == "p" and not opened["p"]:
                stack[-1].children.append(Element("p"))
            for i in back() if opened[tag] else ():
                if stack[i].tag == tag:
                    cut(i)
                    break
                if stack[i].tag in ("table", "td", "th") and tag not in ("table", "tr", "td", "th", "thead", "tbody", "tfoot", "body", "template"):
                    break
            continue
        if tag == "html":
            continue
        while drawn and tag in BREAKS_OUT and (i := foreign()):
            cut(i)
        while stack[-1].tag in HOLDS and tag not in HOLDS[stack[-1].tag]:
            cut(len(stack) - 1)
        if tag == "head" and len(stack) > 1:
            continue
        if tag == "form" and (stack[-1].tag in GROUPS or stack[-1].tag in ("table", "tr")):
            continue  # as in browsers, such a form holds nothing
        if tag in PLACE and place(tag):
            if tag in ("td", "th") and stack[-1].tag != "tr":
                row = Element("tr")
                stack[-1].children.append(row)
                push(row)
        elif tag in IMPLIED_END:
            close(*IMPLIED_END[tag])
        elif tag in CLOSES_P:
            close({"p"}, SCOPE)
        if tag == "li" or tag in ("dd", "dt"):
            close({"p"}, SCOPE | {"ul", "ol", "dl"})
        element = Element(tag, attributes)
        stack[-1].children.append(element)
        if tag in VOID:
            continue
        drawn = drawn or tag in FOREIGN
        if drawn and attributes.endswith("/") and not UNQUOTED_END.search(attributes) and (tag in FOREIGN or foreign()):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.IGNORECASE).search(page, at)
            raw = page[at : end.start()]
            element.children.append(html.unescape(raw) if tag in ("textarea", "title") else raw)
            at = end.end()
        else:
            push(element)
    return root


class Lines:
    """Lines of text under construction."""

    def __init__(self):
        self.lines: list[str] = []
        self.open, self.space, self.gap = "", False, False
        self.indent, self.mark = "", ""

    def text(self, text: str) -> None:
        inner = SPACE.sub(" ", text)
        if inner == " " or not inner:
            self.space = self.space or bool(inner)
            return
        if inner[0] == " " or self.space:
            inner = (" " if self.open else "") + inner.lstrip(" ")
        self.space = inner[-1] == " "
        self.open += inner.rstrip(" ")

    def kept(self, text: str) -> None:
        first, *more = text.split("\n")
        self.open += first
        for line in more:
            self.end(True)
            self.open = line
        self.space = False

    def end(self, always: bool = False) -> None:
        """End the line, if there is one."""
        if self.open.strip() or always:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            mark = self.mark or self.indent
            self.lines.append((mark + self.open).rstrip())
            self.mark = ""
        self.open, self.space = "", False

    def block(self, spaced: bool) -> None:
        self.end()
        self.gap = self.gap or spaced

    def done(self) -> list[str]:
        self.end()
        return self.lines


def hidden(element: Element) -> bool:
    if element.tag in UNSEEN:
        return True
    own = element.attributes
    if not own.strip():
        return False
    if element.tag == "input" and (element.get("type") or "").lower() == "hidden":
        return True
    lower = own.lower()
    return ("hidden" in lower and element.get("hidden") is not None) or (
        "style" in lower and bool(NOT_SHOWN.search(element.get("style") or ""))
    )


def show(element: Element, out: Lines, kept: bool = False, depth: int = 0) -> None:
    number = None
    for child in element.children:
        if isinstance(child, str):
            out.kept(child) if kept else out.text(child)
            continue
        if hidden(child):
            continue
        tag = child.tag
        if tag == "br":
            out.end(True)
        elif tag == "img":
            out.text(child.get("alt") or "")
        elif tag == "svg":
            drawing(child, out)
        elif tag == "math":
            apart = (child.get("display") or "").lower() == "block"
            out.block(False) if apart else None
            formula(child, out)
            out.block(False) if apart else None
        elif tag == "select":
            choice(child, out)
        elif tag == "table":
            out.block(True)
            for line in table_lines(child):
                out.open = line
                out.end(True)
            out.block(True)
        elif tag == "li":
            out.block(False)
            if element.tag == "ol":
                start = element.get("start") if number is None else None
                number = (int(start) if start and re.fullmatch(r"-?\d{1,9}", start) else 1) if number is None else number + 1
            mark = f"{number}. " if element.tag == "ol" else "- "
            outer = out.indent
            out.mark, out.indent = outer + mark, outer + " " * len(mark)
            show(child, out, kept, depth + 1)
            out.block(False)
            out.mark, out.indent = "", outer
        elif tag in BLOCK:
            inside_list = tag in ("ul", "ol") and depth
            out.block(tag in SPACED and not inside_list)
            outer = out.indent
            if tag in ("blockquote", "dd"):
                out.indent = outer + "  "
            show(child, out, kept or tag == "pre", depth)
            out.block(tag in SPACED and not inside_list)
            out.indent = outer
        else:
            show(child, out, kept or tag == "textarea", depth)


def drawing(element: Element, out: Lines) -> None:
    """The text of a drawing, each label set apart."""
    if element.tag in UNDRAWN or element.get("display") == "none" or element.get("visibility") in ("hidden", "collapse"):
        return
    if element.tag == "svg" and "0" in (element.get("width"), element.get("height")):
        return
    if element.tag == "text":
        out.text(" ")
        label(element, out)
        out.text(" ")
        return
    if element.tag == "foreignobject":
        out.block(False)
        show(element, out)
        out.block(False)
        return
    parts = [c for c in element.children if isinstance(c, Element)]
    if element.tag == "switch":  # the first that fits; languages are not known
        parts = ([c for c in parts if c.get("systemlanguage") is None] or parts)[:1]
    for child in parts:
        if not hidden(child):
            drawing(child, out)


def label(text: Element, out: Lines) -> None:
    for child in text.children:
        if isinstance(child, str):
            out.text(child)
        elif not hidden(child) and child.tag not in UNDRAWN and child.get("display") != "none":
            if any(child.get(k) is not None for k in ("x", "y", "dy")):
                out.text(" ")
            label(child, out)


def formula(element: Element, out: Lines) -> None:
    parts = element.children
    if element.tag in ("semantics", "maction"):
        parts = [c for c in parts if isinstance(c, Element)][:1]
    for child in parts:
        if isinstance(child, str):
            out.text(child)
        elif not hidden(child) and child.tag not in UNWRITTEN:
            if element.tag == "mfrac" or child.tag in ("mtr", "mtd"):
                out.text(" ")
            (show if child.tag in HOLDS_HTML else formula)(child, out)
    if element.tag in ("mfrac", "mtable"):
        out.text(" ")


def option_text(option: Element) -> str:
    return SPACE.sub(" ", option.get("label") or "").strip() or cell_text(option)


def choice(select: Element, out: Lines) -> None:
    """The options that a list shows while it is closed."""
    size = select.get("size") or ""
    box = select.get("multiple") is not None or (re.fullmatch(r"\d{1,9}", size) is not None and int(size) > 1)
    options: list[tuple[Element, bool]] = []

    def collect(element: Element, off: bool) -> None:
        for child in element.children:
            if isinstance(child, str) or box and hidden(child) or child.tag in UNSEEN:
                continue
            if child.tag in ("option", "optgroup"):
                options.append((child, off or child.get("disabled") is not None))
            if child.tag != "option":
                collect(child, off or child.tag == "optgroup" and child.get("disabled") is not None)

    collect(select, False)
    if box:
        for option, _ in options:
            out.block(False)
            out.text(option_text(option) if option.tag == "option" else option.get("label") or "")
        out.block(False)
        return
    options = [(o, off) for o, off in options if o.tag == "option"]
    shown = [o for o, _ in options if o.get("selected") is not None][-1:] or [o for o, off in options if not off][:1]
    for option in shown:
        out.text(f" {option_text(option)} ")


def cell_text(cell: Element) -> str:
    out = Lines()
    show(cell, out)
    return " ".join(line.strip() for line in out.done() if line.strip())


def parts_of(table: Element, rows: list[tuple[Element, Element]], loose: list[Element | str]) -> None:
    """Split what a table shows into its rows, each with the part it stands in, and all else."""
    for child in table.children:
        if isinstance(child, str):
            loose.append(child)
        elif child.tag in ("col", "colgroup") or hidden(child):
            continue
        elif child.tag == "tr":
            rows.append((child, table))
        elif child.tag in GROUPS:
            parts_of(child, rows, loose)
        else:
            loose.append(child)


def table_lines(table: Element) -> list[str]:
    """Rows with aligned cells; what is in a table but in no row comes first."""
    rows: list[tuple[Element, Element]] = []
    loose = Element("div")
    parts_of(table, rows, loose.children)
    out = Lines()
    show(loose, out)
    grid: list[list[tuple[int, str, int]]] = []
    #: column -> last row that a cell above takes it in
    taken: dict[int, int] = {}
    group = None
    for y, (row, part) in enumerate(rows):
        if part is not group:
            group, taken = part, {}
        cells, at = [], 0
        for cell in row.children:
            span, height = 1, 1
            if isinstance(cell, str):
                text = SPACE.sub(" ", cell).strip()
                if not text:
                    continue
            elif hidden(cell):
                continue
            else:
                text = cell_text(cell)
                if not text and cell.tag not in ("td", "th"):
                    continue
                span = whole(cell.get("colspan"), 1000) or 1
                height = whole(cell.get("rowspan"), 65534)
            while taken.get(at, -1) >= y:
                at += 1
            cells.append((at, text, span))
            if height != 1:  # 0 reaches to the end of the part
                taken.update(dict.fromkeys(range(at, at + span), y + height - 1 if height else len(rows)))
            at += span
        grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        for at, text, span in cells:
            if span == 1:
                widths[at] = max(widths.get(at, 0), len(text))
    lines = out.done()
    for cells in grid:
        reached, parts = 0, []
        for at, text, span in cells:
            parts += (" " * widths.get(i, 0) for i in range(reached, at))
            room = sum(widths.get(at + i, 0) for i in range(span)) + 2 * (span - 1)
            parts.append(text.ljust(room))
            reached = at + span
        line = "  ".join(parts).rstrip()
        if line.strip():
            lines.append(line)
    return lines


def whole(value: str | None, most: int) -> int:
    """A span as written, 1 if it is missing or no number."""
    return min(int(value), most) if value and re.fullmatch(r"[0-9]{1,9}", value) else 1


def render(page: str) -> str:
    """The visible text of a page."""
    out = Lines()
    show(build(page), out)
    return "\n".join(out.done())


def render_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [render(p) for p in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
        )


def page_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text."""
    ship_package(pages.sparkSession)
    rows = pages.select(quoted(id_col).alias("page_id"), quoted(url_col).alias("url"), text_of(html_col).alias("html"))
    id_type = pages.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(render_batches, f"page_id {id_type}, url string, text string")


def page_table(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, n_chars, n_lines, text_sha256."""
    found = page_texts(pages)
    lines = F.when(F.length("text") == 0, 0).otherwise(F.size(F.split("text", "\n")))
    return found.select(
        "page_id",
        F.length("text").cast("long").alias("n_chars"),
        lines.cast("long").alias("n_lines"),
        F.sha2("text", 256).alias("text_sha256"),
    )
