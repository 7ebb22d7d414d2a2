"""Layout-aware HTML rendering.

A tree builder inserts the tags that HTML lets authors leave out, visibility rules drop what a
browser would not show, and a renderer emits all visible text with block spacing, list marks
and indentation, preformatted text as it is, and table cells aligned in columns.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from rankframe.llm.common import map_texts

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template title noscript iframe noembed noframes datalist audio video canvas object param source track meta link base".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr caption ul xmp".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr menu dir fieldset".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre search section table ul xmp".split()
)
#: What is not rendered below svg and math, by their tags in lower case.
UNSEEN = {
    "svg": frozenset("defs desc metadata symbol clippath mask marker pattern lineargradient radialgradient filter".split()),
    "math": frozenset(("annotation", "annotation-xml")),
}
#: A start tag ends these open elements, looking no further up than the tags of the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
}
#: An end tag does not reach beyond these.
SCOPE = frozenset("table td th caption html template".split())
#: Widest cell that the others of its column are padded to, longest indentation, and most columns that a cell spans (the last fixed by the standard).
PAD, INDENT, SPAN = 160, 80, 1000

TAG = re.compile(r"<(?:!--|[!?]|/?[A-Za-z])")
REST = re.compile(r"""[^\s/>]*(?:[^"'>]|"[^"]*"|'[^']*')*?(?=>)""")
ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
AT_RULE = re.compile(r"[{};]")
DECLARED = re.compile(r"(?:^|[;{\s])(display|visibility)\s*:\s*([\w-]+)[^;}]*?(!\s*important)?\s*(?=[;}]|$)")
FEATURE = re.compile(r"\(([^()]*)\)")
#: The screen by which media queries are decided, in pixels.
SCREEN = {"width": 1280, "height": 800}
SPACE = re.compile(r"[ \t\n\r\f]+")
#: By property: whether important, the place in the style sheets, the value.
Style = dict[str, tuple[bool, int, str]]


class Node:
    """An element; children are elements and strings. own_line is for text of drawings."""

    __slots__ = ("attrs", "children", "depth", "own_line", "tag", "unseen")

    def __init__(self, tag: str, attrs: dict[str, str], depth: int):
        self.tag, self.attrs, self.depth, self.children = tag, attrs, depth, []
        self.own_line = self.unseen = False


def on_screen(query: str) -> bool:
    """Whether a list of media queries, in lower case, holds on SCREEN; features that are not known do not hold."""

    def feature(f: str) -> bool:
        name, _, value = (x.strip() for x in f.partition(":"))
        size = re.fullmatch(r"(\d*\.?\d+)(px|em|rem)?", value)
        for side, have in SCREEN.items():
            if name in (f"min-{side}", f"max-{side}") and size:
                want = float(size[1]) * (1 if size[2] in (None, "px") else 16)
                return have >= want if name.startswith("min") else have <= want
        return (name, value) in {
            ("orientation", "landscape"), ("prefers-color-scheme", "light"), ("hover", "hover"), ("pointer", "fine"), ("scripting", "none"),
            ("color", ""), ("hover", ""), ("pointer", ""), ("any-hover", "hover"), ("any-pointer", "fine"), ("prefers-reduced-motion", "no-preference"),
        }

    def one(q: str) -> bool:
        words = FEATURE.sub(" ", q).split()
        kinds = [w for w in words if w not in ("and", "not", "only", "or")]
        if any("(" in w or ")" in w for w in kinds):
            return False
        held = [feature(f) for f in FEATURE.findall(q)]
        fine = all(k in ("all", "screen") for k in kinds) and (any(held) if "or" in words else all(held))
        return not fine if "not" in words else fine

    return not query.strip() or any(one(q) for q in query.split(","))


def rules(css: str):
    """(selectors, declarations) of the rules of a style sheet, in lower case, that apply on a screen."""
    # Of each open block: whether what it holds counts, and the selectors if it is a rule.
    blocks: list[tuple[bool, str | None]] = []
    at = 0
    for m in AT_RULE.finditer(css):
        live = not blocks or blocks[-1][0]
        if m[0] == "{":
            head = css[at : m.start()].strip()
            if head.startswith("@"):
                name, _, query = head.replace("(", " (", 1).partition(" ")
                fine = name == "@layer" or (name == "@media" and on_screen(query)) or (name == "@supports" and not query.strip().startswith("not"))
                blocks.append((live and fine, None))
            else:
                blocks.append((live, head))
            at = m.end()
        elif m[0] == "}":
            if blocks:
                fine, head = blocks.pop()
                if fine and head is not None:
                    yield head, css[at : m.start()]
            at = m.end()
        elif not blocks or blocks[-1][1] is None:
            at = m.end()  # @import and the like
    if blocks and blocks[-1][0] and blocks[-1][1] is not None:
        yield blocks[-1][1], css[at:]  # the end of the sheet closes what is open


def declared(body: str, order: int) -> Style:
    """The display and visibility that hold of a rule's declarations."""
    own: Style = {}
    for name, value, important in DECLARED.findall(body):
        if important or not own.get(name, (False,))[0]:
            own[name] = (bool(important), order, value)
    return own


def parse(source: str) -> tuple[Node, dict[str, Style]]:
    """The tree, and declarations of style sheets by simple selector (tag, .class, #id)."""
    root = Node("html", {}, 0)
    stack, styles = [root], {}
    #: Places of the open elements by tag, so that no tag has to search the stack, however deep it is.
    places: dict[str, list[int]] = {"html": [0]}
    at, n, order = 0, len(source), 0
    drawn = re.search(r"<(?:svg|math)\b", source, re.IGNORECASE) is not None

    def last(tags) -> int:
        """The place of the innermost open element of these tags."""
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def push(node: Node) -> None:
        places.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def cut(i: int) -> None:
        while len(stack) > i:
            places[stack.pop().tag].pop()

    def close(tags, stop) -> None:
        i = last(tags)
        if i > 0 and i >= last(stop):
            cut(i)

    while at < n:
        m = TAG.search(source, at)
        if m is None:
            stack[-1].children.append(source[at:])
            break
        if m.start() > at:
            stack[-1].children.append(source[at : m.start()])
        if m[0] == "<!--":
            end = source.find("-->", m.end())
            at = n if end < 0 else end + 3
            continue
        if m[0] in ("<!", "<?"):
            end = source.find(">", m.end())
            at = n if end < 0 else end + 1
            continue
        closing = m[0][1] == "/"
        begin = m.end() - 1
        end = source.find(">", begin)
        if end < 0:
            break  # a tag that never ends shows nothing
        if '"' in source[begin:end] or "'" in source[begin:end]:
            rest = REST.match(source, begin)
            end = rest.end() if rest else end
        inside = source[begin:end]
        at = end + 1
        tag = re.split(r"[\s/]", inside, maxsplit=1)[0].lower()
        if closing:
            if tag == "p" and last(("p",)) < 0:
                stack[-1].children.append(Node("p", {}, 0))
            elif tag == "br":
                stack[-1].children.append(Node("br", {}, 0))
            else:
                close({tag}, SCOPE - {tag} if tag not in ("table", "tr", "thead", "tbody", "tfoot") else {"html"} | ({"table"} - {tag}))
            continue
        attrs = {}
        if len(inside) > len(tag) + 1:
            for k, a, b, c in ATTR.findall(inside[len(tag) :]):
                attrs.setdefault(k.lower(), a or b or c)
        if tag in ENDS_P:
            close({"p"}, SCOPE | {"button"})
        if tag in ("html", "body"):  # implied already, or repeated: only their attributes count
            stack[-1].attrs = {**attrs, **stack[-1].attrs} if len(stack) == 1 else stack[-1].attrs
            if tag == "body":
                close({"head"}, {"body"})
            continue
        if len(stack) == 2 and stack[1].tag == "head" and tag not in HIDDEN:
            cut(1)  # the head ends where the body's first element starts
        if tag in IMPLIED:
            tags, stop = IMPLIED[tag]
            for _ in range(4):  # a row ends its cell, then itself
                size = len(stack)
                close(tags, stop)
                if len(stack) == size:
                    break
        if tag in ("td", "th") and stack[-1].tag != "tr" and last(("table",)) >= 0:
            row = Node("tr", {}, len(stack))
            stack[-1].children.append(row)
            push(row)
        node = Node(tag, attrs, len(stack))
        stack[-1].children.append(node)
        around = stack[last(UNSEEN)].tag if drawn and last(UNSEEN) >= 0 else None
        if around:
            node.unseen = tag in UNSEEN[around]
            node.own_line = around == "svg" and tag == "text"
        if (around or tag in UNSEEN) and inside.endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(source, at)
            inner = source[at : end.start() if end else n]
            at = n if end is None else source.find(">", end.end()) + 1 or n
            node.children.append(inner)
            low = inner.lower() if tag == "style" else ""
            if ("display" in low or "visibility" in low) and on_screen(attrs.get("media", "").lower()):
                for selectors, body in rules(re.sub(r"/\*.*?(?:\*/|$)|<!--|-->", "", low, flags=re.DOTALL)):
                    order += 1
                    own = declared(body, order)
                    for sel in selectors.split(",") if own else ():
                        if re.fullmatch(r"[.#]?[\w-]+", sel := sel.strip()):
                            known = styles.setdefault(sel, {})
                            for name, what in own.items():
                                known[name] = max(known.get(name, what), what)
        elif tag not in VOID:
            push(node)
    return root, styles


class Page:
    """Lines of text. Text waits in ``words`` until its line ends."""

    def __init__(self):
        self.lines: list[str] = []
        self.words: list[str] = []
        self.gap = 0
        self.prefix: list[str] = []
        self.mark = ""

    def text(self, s: str) -> None:
        s = SPACE.sub(" ", s)
        if not self.words or self.words[-1].endswith(" "):
            s = s.lstrip(" ")
        if s:
            self.words.append(s)

    def flush(self) -> None:
        line = "".join(self.words).rstrip(" ")
        self.words.clear()
        if line:
            self.put(line)

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = 0
        indent = "".join(self.prefix[-INDENT:])[-INDENT:]
        if self.mark:
            indent, self.mark = indent[: max(0, len(indent) - len(self.mark))] + self.mark, ""
        self.lines.append((indent + line).rstrip())

    def block(self, spaced: bool) -> None:
        self.flush()
        if spaced and self.lines:
            self.gap = 1


def _hidden(node: Node, styles: dict[str, Style], visible: bool) -> tuple[bool, bool]:
    """(not rendered at all, visible by the visibility property).

    Of several declarations the important one wins, then that of the style attribute, an id, a class,
    a tag, then the last one. The standard hides by default what an author's display shows again.
    """
    a = node.attrs
    if node.tag in HIDDEN or node.unseen or (a and node.tag == "input" and a.get("type", "").lower() == "hidden"):
        return True, visible
    gone = "hidden" in a or (node.tag == "dialog" and "open" not in a)
    if not a and not styles:
        return gone, visible
    found = []
    if styles:
        found.append((0, styles.get(node.tag)))
        if a:
            found += [(1, styles.get("." + c)) for c in a.get("class", "").lower().split()]
            found.append((2, styles.get("#" + a.get("id", "").lower())))
    if a and ("style" in a):
        found.append((3, declared(entities.unescape(a["style"]).lower(), 0)))
    best: dict[str, tuple] = {}
    for rank, own in found:
        for name, (important, order, value) in (own or {}).items():
            best[name] = max(best.get(name, (False, -1, 0, "")), (important, rank, order, value), key=lambda x: x[:3])
    if "display" in best:
        gone = best["display"][3] == "none"
    if "visibility" in best and best["visibility"][3] in ("hidden", "collapse", "visible"):
        visible = best["visibility"][3] == "visible"
    return gone, visible


def _run(walk: Iterator) -> None:
    """Run a walk that yields the walks below it, without recursion: pages may be nested to any depth."""
    open_ = [walk]
    while open_:
        below = next(open_[-1], None)
        if below is None:
            open_.pop()
        else:
            open_.append(below)


def _walk(node: Node, page: Page, styles: dict[str, Style], visible: bool, pre: bool, lists: int) -> Iterator:
    gone, visible = _hidden(node, styles, visible)
    if gone:
        return
    tag = node.tag
    if tag == "br":
        page.flush() if page.words else page.put("") if pre else None
        return
    if tag == "input":
        if visible and node.attrs.get("type", "").lower() in ("button", "submit", "reset"):
            page.text(entities.unescape(node.attrs.get("value", "")))
        return
    if tag == "table":
        page.block(True)
        yield _table(node, page, styles, visible)
        page.block(True)
        return
    block = tag in BLOCK or node.own_line
    spaced = tag in SPACED and not (lists and tag in ("ul", "ol", "menu", "dir"))
    if block:
        page.block(spaced)
    pre = pre or tag in ("pre", "textarea", "xmp")
    number = None
    depth = len(page.prefix)
    if tag in ("ul", "ol", "menu", "dir"):
        lists += 1
        start = node.attrs.get("start", "1")
        number = int(start) if tag == "ol" and re.fullmatch(r"-?\d{1,9}", start) else 1 if tag == "ol" else None
    elif tag == "dd":
        page.prefix.append("    ")
    elif tag == "blockquote":
        page.prefix.append("> ")
    closed = tag == "details" and "open" not in node.attrs
    shown = False
    for child in node.children:
        if isinstance(child, str):
            if not visible or closed:
                continue
            s = entities.unescape(child) if "&" in child else child
            if pre:
                first, *more = s.split("\n")
                page.words.append(first)
                for line in more:
                    page.put("".join(page.words))
                    page.words[:] = [line]
            else:
                page.text(s)
        elif closed and (child.tag != "summary" or shown):
            continue
        elif child.tag == "li":
            shown = True
            mark = "- " if number is None else f"{number}. "
            item, _ = _hidden(child, styles, visible)
            if item:
                continue
            page.block(False)
            page.prefix.append(" " * len(mark))
            page.mark = mark
            yield _walk(child, page, styles, visible, pre, lists)
            page.block(False)
            page.mark = ""
            page.prefix.pop()
            number = None if number is None else number + 1
        else:
            shown = shown or child.tag == "summary"
            yield _walk(child, page, styles, visible, pre, lists)
    if pre and tag in ("pre", "textarea", "xmp") and page.words:
        page.put("".join(page.words))
        page.words.clear()
    if block:
        page.block(spaced)
    del page.prefix[depth:]


def _rows(node: Node, styles: dict[str, Style], visible: bool):
    """(row or caption or stray, visibility, the table or its part) below a table, in order."""
    for child in node.children:
        if isinstance(child, str):
            if child.strip() and visible:
                yield child, visible, node
            continue
        gone, seen = _hidden(child, styles, visible)
        if gone:
            continue
        if child.tag in ("thead", "tbody", "tfoot"):
            yield from _rows(child, styles, seen)
        else:
            yield child, visible, node


def _span(cell: Node | str, name: str, most: int) -> int:
    """How many columns or rows a cell spans; 0 rows are all that follow."""
    text = "1" if isinstance(cell, str) else cell.attrs.get(name, "1").strip()
    if not re.fullmatch(r"[0-9]+", text):
        return 1
    return min(int(text[-12:]) if len(text.lstrip("0")) <= 12 else most, most) or (most if name == "rowspan" else 1)


def _table(node: Node, page: Page, styles: dict[str, Style], visible: bool) -> Iterator:
    """Rows of aligned cells. A cell wider than PAD does not widen its column, so what is added to a page's text is bounded by its cells.

    Columns that hold nothing in any row count as one beside each other.
    """
    grid: list[dict[int, list[str]] | None] = []
    other: list[list[str]] = []

    def render(child, seen, into: list[str]) -> Iterator:
        sub = Page()
        if isinstance(child, str):
            sub.text(entities.unescape(child))
        else:
            yield _walk(child, sub, styles, seen, False, 0)
        sub.flush()
        into += sub.lines

    # By first column, the last one and in how many more rows of the part of the table a cell from above goes on.
    above: dict[int, tuple[int, int]] = {}
    part = node
    for row, seen, own in _rows(node, styles, visible):
        if own is not part:
            above, part = {}, own
        if isinstance(row, str) or row.tag != "tr":
            grid.append(None)
            other.append([])
            yield render(row, seen, other[-1])
            continue
        gone, seen = _hidden(row, styles, seen)
        cells: dict[int, list[str]] = {}
        below: dict[int, tuple[int, int]] = {}
        held, at = sorted((c, end) for c, (end, _) in above.items()), 0
        for cell in row.children:
            if isinstance(cell, str) and not cell.strip():
                continue
            if not isinstance(cell, str) and _hidden(cell, styles, seen)[0]:
                continue
            if isinstance(cell, str) and not seen:
                continue
            while held and held[0][0] <= at:
                at = max(at, held.pop(0)[1])
            span = _span(cell, "colspan", SPAN)
            cells[at] = []
            yield render(cell, seen, cells[at])
            if (rows := _span(cell, "rowspan", 65534)) > 1:
                below[at] = (at + span, rows - 1)
            at += span
        above = {c: (end, k - 1) for c, (end, k) in above.items() if k > 1} | below
        grid.append(cells)
    width: dict[int, int] = {}
    for cells in grid:
        for i, cell in (cells or {}).items():
            width[i] = max([width.get(i, 0), *(len(x) for x in cell if len(x) <= PAD)])
    full = {i for cells in grid for i, cell in (cells or {}).items() if cell}
    order: list[int | None] = []  # columns from left to right; None for one or more that hold nothing
    for i in sorted(full):
        if i - (before := order[-1] if order and order[-1] is not None else -1) > 1:
            order.append(None)
        order.append(i)
    strays = iter(other)
    for cells in grid:
        if cells is None:
            for line in next(strays):
                page.put(line)
            continue
        for k in range(max(map(len, cells.values()), default=0)):
            line, todo = [], {i for i, c in cells.items() if k < len(c) and c[k]}
            for i in order:
                if not todo:
                    break
                todo.discard(i)
                text = "" if i is None or k >= len(cells.get(i, ())) else cells[i][k]
                line.append(text.ljust(width[i]) if todo and i is not None else text)
            if line:
                page.put("  ".join(line))


def render(source: str | None) -> str:
    """All visible text of a page; null is empty."""
    if not source:
        return ""
    root, styles = parse(source.replace("\r\n", "\n").replace("\0", ""))
    page = Page()
    _run(_walk(root, page, styles, True, False, 0))
    page.flush()
    return "\n".join(page.lines).strip("\n")


OUT = "text string, n_chars long, n_lines long"


def extract_html(df: DataFrame, html: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """A row for each row of df: the columns carry, text, n_chars, n_lines.

    A null or empty page has an empty text of no lines. Broken markup never fails: what no rule
    covers is text. Elements may be nested to any depth. Repeated rows come out repeated; an empty table gives no
    rows; other columns are ignored, whatever their names. Nothing is shuffled.
    """

    def run(pages: list) -> dict[str, list]:
        texts = [render(p) for p in pages]
        return {"text": texts, "n_chars": [len(t) for t in texts], "n_lines": [t.count("\n") + 1 if t else 0 for t in texts]}

    return map_texts(df, carry, html, run, OUT)
