"""HTML extraction by layout: a tree with implied tags, visibility rules, and a renderer.

build() makes the tree: void elements, tags that end others by starting (li, p,
td, option and so on), end tags that close what is open inside, raw text of
scripts and styles. render() emits all visible text: blocks on their own lines
with the blank lines that browsers give them, list markers with indents, cells
aligned in columns, preformatted text as it stands.

Hidden are head matter, scripts, styles, templates, data lists, what stands in
for frames and media, drawing definitions, annotations of formulas, values of
inputs that show none, elements with the hidden attribute (unless they have a
display), aria-hidden="true" or a display: none, and closed details but for their
summary. visibility: hidden hides what doesn't say visible itself. Both are read
from the element and from the page's style elements, where simple selectors (an
element, .class, #id, or an element with one of these) tell them. Form fields give what they show: their value, or else their placeholder.
The parts of a formula that stand over, under or beside each other get a blank
between them, and so do the texts of a drawing.

Defined results
* Null and empty pages, and pages without visible text, give ''.
* Broken markup never fails: unknown tags are inline, stray end tags are ignored,
  what is open at the end is closed. Depth isn't limited (no recursion).
* One row per input row; columns besides page_id and html are ignored.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes noscript iframe template".split())
HIDDEN = frozenset("head title script style template noscript iframe noframes datalist canvas audio video meta link base annotation annotation-xml".split())
#: Of drawings: what isn't drawn where it stands. Of formulas: elements whose parts stand apart.
UNDRAWN = frozenset("defs desc metadata symbol clippath mask".split())
APART = frozenset("mfrac msub msup msubsup munder mover munderover mroot mmultiscripts mtr mtd mtable".split())
#: Types of input that show no text.
NO_TEXT = frozenset("hidden checkbox radio password file color range".split())
BLOCK = frozenset(
    "address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hgroup hr html legend li main menu nav ol p pre search section summary table ul caption tr".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure menu hr".split())
CELLS, ROWS = frozenset(("td", "th")), frozenset(("thead", "tbody", "tfoot"))
#: A start tag of the key ends an open element of the first set, unless one of the second set stands between.
ENDS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "tr": (frozenset(("tr", "td", "th", "caption", "colgroup")), frozenset(("table",))),
    "td": (CELLS, frozenset(("table", "tr"))),
    "th": (CELLS, frozenset(("table", "tr"))),
    **{k: (ROWS | CELLS | {"tr", "caption", "colgroup"}, frozenset(("table",))) for k in ("thead", "tbody", "tfoot")},
    "body": (frozenset(("head",)), frozenset()),
}
BOUNDS = frozenset("table td th caption html body button object".split())
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?")
_BLANK = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for k, v in _ATTR.findall(text):
        out.setdefault(k.lower(), entities.unescape(v[1:-1] if v[:1] in ("'", '"') and v else v))
    return out


class Markup:
    """The tags of a page, one after the other. Every search goes on from where the last one of its kind ended, and is not tried
    again once it has found nothing, so a page is read in linear time however its markup is broken."""

    def __init__(self, page: str):
        self.page = page
        self.found: dict[str, int] = {}

    def find(self, what: str, at: int) -> int:
        """page.find(what, at), remembered: at never goes back."""
        known = self.found.get(what, -2)
        if known == -1 or known >= at:
            return known
        self.found[what] = known = self.page.find(what, at)
        return known

    def tag_end(self, at: int) -> int:
        """The place of the '>' that ends a tag whose attributes start at at: not one in quotes that are closed. -1 if none does."""
        page = self.page
        while True:
            end = self.find(">", at)
            if end < 0:
                return -1
            quotes = [q for q in (self.find('"', at), self.find("'", at)) if 0 <= q < end]
            if not quotes:
                return end
            q = min(quotes)
            if page[at:q].rstrip().endswith("="):
                close = page.find(page[q], q + 1) if self.closes(page[q], q) else -1
                if close < 0:
                    return end
                at = close + 1
            else:
                at = q + 1

    def closes(self, quote: str, at: int) -> bool:
        """Is there another such quote after at? The last one of the page is found once."""
        last = self.found.get(f"last {quote}")
        if last is None:
            last = self.found[f"last {quote}"] = self.page.rfind(quote)
        return last > at

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """Start, end, name (empty for comments and declarations), whether it is an end tag, and attributes of the next tag from at."""
        page = self.page
        while True:
            start = self.find("<", at)
            if start < 0:
                return None
            if page.startswith("<!--", start):
                end = self.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(page), "", False, ""
            if page.startswith(("<!", "<?"), start):
                end = self.find(">", start)
                return start, end + 1 if end >= 0 else len(page), "", False, ""
            m = _NAME.match(page, start)
            if m:
                end = self.tag_end(m.end())
                if end < 0:
                    return None  # no tag ends from here on: the rest is text
                return start, end + 1, m[1].lower(), page[start + 1] == "/", page[m.end() : end]
            at = start + 1


#: What of a page is laid out: so many levels of indented blocks, tables in tables, and columns of a table. What goes beyond is shown
#: without; the text is the same.
DEEP, DEEP_TABLES, COLUMNS = 64, 16, 200
CLOSES_CELLS = frozenset({"table", "tr", "td", "th", "body", "html", *ROWS})


def build(page: str) -> Node:
    root = Node("#root")
    open_: list[Node] = [root]
    places: dict[str, list[int]] = {}  # of the open elements, by tag: none is searched for
    at = 0

    def last(tag: str) -> int:
        """The place of the innermost open element of that tag, 0 if there is none."""
        found = places.get(tag)
        return found[-1] if found else 0

    def close(i: int) -> None:
        for node in open_[i:]:
            places[node.tag].pop()
        del open_[i:]

    def text(s: str) -> None:
        if s:
            open_[-1].children.append(entities.unescape(s))

    markup = Markup(page)
    raw_ends: dict[str, re.Pattern] = {}
    unclosed: set[str] = set()
    while at < len(page):
        found = markup.next(at)
        if found is None:
            text(page[at:])
            break
        start, end, tag, closing, rest = found
        text(page[at:start])
        at = end
        if not tag:
            continue
        if closing:
            i = last(tag)
            # an end tag doesn't close a cell that it doesn't name
            if i and (tag in CLOSES_CELLS or i > max(last("td"), last("th"), last("table"))):
                close(i)
            continue
        ended, barrier = ENDS.get(tag, (frozenset(), frozenset()))
        if tag in BLOCK and tag not in ("html", "body") and (i := last("p")) and i > max(map(last, BOUNDS)):
            close(i)  # a block ends an open paragraph of the same cell
        if any(places.get(t) for t in ended):
            bound = max(map(last, barrier), default=0)
            after = [p[j] for t in ended if (p := places.get(t)) and (j := bisect_right(p, bound)) < len(p)]
            if after:
                close(min(after))
        node = Node(tag, _attributes(rest) if rest.strip(" /") else None)
        open_[-1].children.append(node)
        if tag in VOID or rest.endswith("/") and (tag in ("svg", "math", "path", "use") or last("svg") or last("math")):
            continue
        if tag in RAW:
            ending = raw_ends.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I))
            done = None if tag in unclosed else ending.search(page, at)
            if done is None:
                unclosed.add(tag)
            raw = page[at : done.start() if done else len(page)]
            node.children.append(entities.unescape(raw) if tag == "textarea" else raw)
            at = done.end() if done else len(page)
            continue
        places.setdefault(tag, []).append(len(open_))
        open_.append(node)
    return root


_CSS_MARK, _AT_RULE = re.compile(r"[{};@]"), re.compile(r"\s*@")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_SIMPLE = re.compile(r"([A-Za-z][\w-]*)?(?:([.#])([\w-]+))?\Z")
_DISPLAY, _VISIBILITY = re.compile(r"(?:^|;)\s*display\s*:\s*([\w-]+)", re.I), re.compile(r"(?:^|;)\s*visibility\s*:\s*([\w-]+)", re.I)


def declared(style: str) -> dict[str, str]:
    """display and visibility of a style; of several declarations the last."""
    found = {"display": _DISPLAY.findall(style), "visibility": _VISIBILITY.findall(style)}
    return {k: v[-1].lower() for k, v in found.items() if v}


def plain_rules(css: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of a sheet's rules. An at-rule, with its block, is passed over."""
    start, body, passed, depth, seen = 0, -1, False, 0, -1
    for m in _CSS_MARK.finditer(css):
        c = m[0]
        if passed:
            depth += (c == "{") - (c == "}")
            if depth <= 0 and c in "};":
                passed, depth, start = False, 0, m.end()
        elif body >= 0:
            if c == "}":
                yield css[start : body - 1], css[body : m.start()]
                body, start = -1, m.end()
        elif c == "@":
            if seen < start:  # looked at once a rule
                seen, passed = start + 1, _AT_RULE.match(css, start) is not None
        elif c == "{":
            body = m.end()
        else:
            start = m.end()
    if body >= 0:
        yield css[start : body - 1], css[body:]


def style_rules(root: Node) -> dict[tuple[str, str, str], dict[str, str]]:
    """(element or '', '.' or '#' or '', name) -> display and visibility, of the page's style elements: rules of simple selectors,
    later ones over earlier. Selectors of other kinds, and rules for media, aren't read."""
    rules: dict[tuple[str, str, str], dict[str, str]] = {}
    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag == "style":
            css = _COMMENT.sub(" ", "".join(node.children))
            for selectors, body in plain_rules(css):
                if found := declared(body):
                    for one in selectors.split(","):
                        m = _SIMPLE.match(one.strip())
                        if m and m[0]:
                            rules.setdefault(((m[1] or "").lower(), m[2] or "", m[3] or ""), {}).update(found)
        else:
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    return rules


def styled(node: Node, rules: dict[tuple[str, str, str], dict[str, str]]) -> dict[str, str]:
    """display and visibility that rules and the element's own style give it: by element, class, id, then its own."""
    a, out = node.attrs, {}
    if rules:
        names = [("", ""), *((".", c) for c in a.get("class", "").split()), *([("#", a["id"])] if "id" in a else [])]
        for kind, name in names:
            for tag in ("", node.tag):
                if (tag or kind) and (found := rules.get((tag, kind, name))):
                    out.update(found)
    if "style" in a:
        out.update(declared(a["style"]))
    return out


def gone(node: Node, style: dict[str, str]) -> bool:
    """The element and all in it show nothing, whatever they say themselves."""
    if node.tag in HIDDEN or style.get("display") == "none":
        return True
    a = node.attrs
    if node.tag == "dialog" and "open" not in a and "display" not in style:
        return True
    return bool(a) and (("hidden" in a and "display" not in style) or a.get("aria-hidden", "").lower() == "true")


def shown(field: Node) -> str:
    """The text that an input or a textarea shows."""
    a = field.attrs
    if field.tag == "textarea":
        return "".join(field.children).replace("\r\n", "\n").removeprefix("\n") or a.get("placeholder", "")
    kind = a.get("type", "").strip().lower()
    if kind == "image":
        return a.get("alt", "")
    return "" if kind in NO_TEXT else a.get("value") or a.get("placeholder", "")


def width(text: str) -> int:
    """Columns that a text takes: wide characters two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Lines:
    """Output of one block: lines, with a gap of blank lines that is due before the next text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = 0
        self.prefix: list[str] = []  # of the lines of open lists and quotes
        self.marker: str | None = None

    def inline(self, text: str) -> None:
        for i, part in enumerate(_BLANK.split(text)):
            self.space |= i > 0 and bool(self.now)
            if part:
                if self.space and self.now:
                    self.now.append(" ")
                self.space = False
                self.now.append(part)

    def end_line(self) -> None:
        if self.now:
            if self.lines:
                self.lines.extend([""] * self.gap)
            self.gap = 0
            lead = "".join(self.prefix[:DEEP])
            if self.marker is not None and self.prefix:
                lead = "".join(self.prefix[: min(len(self.prefix) - 1, DEEP)]) + self.marker
                self.marker = None
            self.lines.append(lead + "".join(self.now))
            self.now = []
        self.space = False

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def whole(self, lines: list[str]) -> None:
        self.end_line()
        for line in lines:
            self.now = [line] if line else [" "]
            self.end_line()


def table_lines(rows: list[list[tuple[str, int, int]] | None]) -> list[str]:
    """Cells (text of one or more lines, columns and rows spanned) aligned by column, two blanks between. None parts groups of rows, which
    no cell spans. Cells beyond the last of COLUMNS follow each other without being aligned."""
    grid: list[list[tuple[list[str], int, int]]] = []
    widths = [0] * COLUMNS
    until = [0] * COLUMNS  # the last row that a spanning cell takes of each column
    for n, row in enumerate(rows):
        if row is None:
            until = [0] * COLUMNS
            continue
        cells, col = [], 0
        for text, span, down in row:
            while col < COLUMNS and until[col] > n:
                col += 1
            parts, end = text.split("\n") if text else [""], min(col + span, COLUMNS)
            cells.append((parts, col, end))
            if span == 1 and col < COLUMNS:
                widths[col] = max(widths[col], max(map(width, parts)))
            if down > 1:
                until[col:end] = [n + down] * (end - col)
            col = end
        grid.append(cells)
    left = [0, *accumulate(w + 2 for w in widths)]
    out = []
    for cells in grid:
        for k in range(max((len(p) for p, _, _ in cells), default=0)):
            line, due, at = [], 0, 0
            for parts, col, end in cells:
                due += left[col] - left[at]
                at = end
                piece = parts[k] if k < len(parts) else ""
                line.append(" " * due + piece)
                due = max(left[end] - left[col] - width(piece), 2)
            out.append("".join(line).rstrip())
    return [x for x in out if x.strip()]


def seen_style(root: Node) -> bool:
    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag == "style":
            return True
        stack += [c for c in node.children if isinstance(c, Node)]
    return False


def render(root: Node) -> str:
    """The visible text. An explicit stack holds what is still to do: nodes, texts and closing actions."""
    out = Lines()
    # tables under way: rows of cells, and the output that the table interrupts
    stack: list = [root]
    counters: list[int] = []
    outer: list[tuple[Lines, list[list[tuple[str, int, int]] | None]]] = []
    drawings = flat = 0  # open svg elements, and tables too deep to be laid out
    rules = style_rules(root) if seen_style(root) else {}
    unseen = False  # visibility: hidden, of the element under way
    while stack:
        item = stack.pop()
        if callable(item):
            item()
            continue
        if isinstance(item, str):
            if not unseen:
                out.inline(item)
            continue
        style = styled(item, rules) if rules or item.attrs else {}
        if gone(item, style):
            continue
        if "visibility" in style and (hide := style["visibility"] in ("hidden", "collapse")) != unseen:

            def back(before=unseen) -> None:
                nonlocal unseen
                unseen = before

            stack.append(back)
            unseen = hide
        tag = item.tag
        later: list = list(reversed(item.children))
        if tag == "br":
            if out.now:
                out.end_line()
            else:
                out.gap = max(out.gap, 1)
            continue
        if tag == "svg":
            drawings += 1

            def drawn() -> None:
                nonlocal drawings
                drawings -= 1

            stack += [drawn, *later]
            continue
        if drawings and tag in UNDRAWN:
            continue
        if tag in APART or drawings and tag == "text":
            out.inline(" ")
            for c in later if tag in APART else (later,):
                stack += [" ", *(c if isinstance(c, list) else [c])]
            continue
        if unseen and tag in ("input", "textarea", "img"):
            continue
        if tag in ("input", "textarea"):
            lines = shown(item).split("\n")
            if len(lines) > 1:
                out.block(0)
                out.whole(lines)
            elif lines[0]:
                for part in (" ", lines[0], " "):
                    out.inline(part)
            continue
        if tag in ("option", "optgroup"):
            out.block(0)
            if item.attrs.get("label"):
                if not unseen:
                    out.inline(item.attrs["label"])
                if tag == "option":
                    later = []
                else:
                    out.block(0)
            stack += [lambda: out.block(0), *later]
            continue
        if tag == "img":
            if item.attrs.get("alt"):
                out.inline(item.attrs["alt"])
            continue
        if tag == "details" and "open" not in item.attrs:
            later = [c for c in later if isinstance(c, Node) and c.tag == "summary"]
        if tag == "pre":
            out.block(1)
            out.whole(_plain(item, rules, unseen).strip("\n").split("\n"))
            out.block(1)
            continue
        if tag == "table" and len(outer) >= DEEP_TABLES:
            flat += 1
            out.block(0)

            def flat_done() -> None:
                nonlocal flat
                flat -= 1
                out.block(0)

            stack += [flat_done, *later]
            continue
        if flat and (tag == "tr" or tag in ROWS or tag in CELLS):
            if tag in CELLS:
                stack += [" ", *later]
            else:
                out.block(0)
                stack += [lambda: out.block(0), *later]
            continue
        if tag == "table":
            out.block(1)
            held, rows = out, []
            outer.append((held, rows))
            out = Lines()

            def table_done() -> None:
                nonlocal out
                out.end_line()
                loose = out.lines
                out, done = outer.pop()
                out.whole(loose + table_lines(done))
                out.block(1)

            stack += [table_done, *later]
            continue
        if tag == "tr" and outer:
            outer[-1][1].append([])
            stack += later
            continue
        if tag in ROWS and outer:
            outer[-1][1].append(None)
            stack += [lambda rows=outer[-1][1]: rows.append(None), *later]
            continue
        if tag in CELLS and outer:
            rows = outer[-1][1]
            if not rows or rows[-1] is None:
                rows.append([])
            before, out = out, Lines()
            span, down = item.attrs.get("colspan", "1"), item.attrs.get("rowspan", "1")

            def cell_done(before=before, row=rows[-1], span=span, down=down) -> None:
                nonlocal out
                out.end_line()
                n = min(int(down), 65534) if down.isascii() and down.isdigit() else 1
                row.append(("\n".join(out.lines), min(max(int(span), 1), 1000) if span.isascii() and span.isdigit() else 1, n or 65534))
                out = before

            stack += [cell_done, *later]
            continue
        if tag in ("ul", "ol", "menu"):
            start = item.attrs.get("start", "1")
            nested = bool(counters)
            out.block(0 if nested else 1)
            counters.append(int(start) - 1 if tag == "ol" and start.lstrip("-").isdigit() and start.isascii() else 0 if tag == "ol" else -1)

            def list_done(gap=0 if nested else 1) -> None:
                counters.pop()
                out.block(gap)

            stack += [list_done, *later]
            continue
        if tag == "li":
            out.block(0)
            ordered = bool(counters) and item_counts(counters, item)
            mark = f"{counters[-1]}. " if ordered else "- "
            out.prefix.append(" " * len(mark))
            out.marker = mark

            def item_done() -> None:
                out.end_line()
                out.prefix.pop()
                out.marker = None

            stack += [item_done, *later]
            continue
        if tag in ("blockquote", "dd"):
            out.block(1 if tag == "blockquote" else 0)
            out.prefix.append("  ")

            def quote_done(gap=1 if tag == "blockquote" else 0) -> None:
                out.block(gap)
                out.prefix.pop()

            stack += [quote_done, *later]
            continue
        if tag in BLOCK:
            gap = 1 if tag in SPACED and not (tag == "p" and out.prefix) else 0
            out.block(gap)
            stack += [lambda gap=gap: out.block(gap), *later]
            continue
        stack += later
    out.end_line()
    return "\n".join(out.lines)


def item_counts(counters: list[int], item: Node) -> bool:
    """Whether the list is numbered; counts the item if so."""
    if counters[-1] < 0:
        return False
    value = item.attrs.get("value", "")
    counters[-1] = int(value) if value.isascii() and value.isdigit() else counters[-1] + 1
    return True


def _plain(node: Node, rules: dict[tuple[str, str, str], dict[str, str]], unseen: bool) -> str:
    out: list[str] = []
    stack: list[tuple[Node | str, bool]] = [(c, unseen) for c in reversed(node.children)]
    while stack:
        x, hide = stack.pop()
        if isinstance(x, str):
            out.append("" if hide else x)
            continue
        style = styled(x, rules) if rules or x.attrs else {}
        if gone(x, style):
            continue
        if "visibility" in style:
            hide = style["visibility"] in ("hidden", "collapse")
        if x.tag == "br":
            out.append("\n")
        elif x.tag in ("input", "textarea"):
            out.append("" if hide else shown(x))
        else:
            stack += [(c, hide) for c in reversed(x.children)]
    return "".join(out)


def extract(page: str | None) -> str:
    return render(build(page)) if page else ""


def extraction(pages: DataFrame) -> DataFrame:
    """page_id, text, n_lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [extract(h) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "text": texts, "n_lines": [t.count("\n") + 1 if t else 0 for t in texts]})

    return pages.select(F.col("page_id").cast("long"), "html").mapInPandas(run, "page_id long, text string, n_lines int")
