"""Layout-aware text of HTML pages.

Tags drive a stack of open elements with the implied starts and ends of the HTML tree rules (paragraphs, list items,
definitions, options, headings, rows and cells, the head before the body); what an element shows is laid out as it closes.
All visible text is kept: hidden are the head, scripts, styles, templates, embedded fallbacks, elements with the hidden
attribute or display:none, closed details but for their summary, closed dialogs, and visibility:hidden as far as no
descendant is visible again. Style sheets in the page count by rules with simple selectors (a tag, an id, classes, or
these together), whatever the medium's conditions but print; other selectors are not followed. Scripts are not run, so noscript is shown.
Form fields show their value, or else their placeholder, buttons their label. Of formulas the annotations, phantoms and later alternatives
are hidden; rows start lines and cells are set apart. Of inline drawings the labels are shown, each set apart.

Layout: blocks start lines, paragraphs, headings, lists, quotes, tables and preformatted text have a blank line around;
white space collapses but in pre and textarea; list items have bullets or numbers and hang, nested lists and quotes are
indented; a table row is a line (or several) with cells padded to their column, spans included. Text that stands in a
table outside cells comes before the table. Columns are padded to at most ``MAX_PAD``; longer cells push their row, so a
page's text grows with its html alone. Spans are cut at what html allows (``MAX_SPAN`` columns, 65,534 rows).

Definitions: null html gives null text, empty html an empty text. Tags cut off at the end of a page are dropped, other
stray "<" are text, and a quote that is never closed is an ordinary character. Nesting beyond ``MAX_DEPTH`` layouts is laid out in the last one. Each input row gives a row.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

MAX_PAD = 60
MAX_DEPTH = 60
MAX_SPAN = 1000

#: A quote opens a value only directly after "=" behind a name; elsewhere, and in unquoted values, it is an ordinary character.
_QUOTABLE = r"[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:\"{0}\"|'{1}'|{2})"
_VALUE = _QUOTABLE.format(r"[^\"]*+", r"[^']*+", r"(?![\"'])[^ \t\n\r\f>]++")
_TAG = re.compile(rf"<(?:!--.*?(?:--!?>|\Z)|[!?/][^a-zA-Z>][^>]*>|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*+)((?:[ \t\n\r\f/]++|[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+(?:{_VALUE})?+)*+)(>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^ \t\n\r\f/>][^ \t\n\r\f/>=]*+)(?:" + _QUOTABLE.format(r"([^\"]*+)", r"([^']*+)", r"((?![\"'])[^ \t\n\r\f>]++)") + r")?+")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_BLANK = " \t\n\r\f"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text ends only at their own end tag.
RAW = frozenset("script style iframe noframes noembed xmp title textarea".split())
HEAD = frozenset("title meta link script style base template noscript bgsound basefont".split())
NEVER = frozenset("head script style template iframe noframes noembed object canvas audio video datalist title meter progress".split())
#: Text inside these parts of a formula is html again.
MATH_TEXT = frozenset("mi mo mn ms mtext annotation-xml".split())
#: Unseen parts of a drawing; of all others only what stands in a text element is seen.
SVG_NEVER = frozenset("defs symbol metadata desc title clippath mask pattern marker lineargradient radialgradient filter style script".split())
#: Inside these, drawings and formulas hold html again.
TO_HTML = MATH_TEXT | {"foreignobject", "desc"}
#: Kinds of input that show no text.
SILENT = frozenset("hidden password checkbox radio file image range color".split())
LABELLED = frozenset("submit reset button".split())
#: Html elements that end a formula or drawing they stand in.
ENDS_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Blank lines around each block.
BLOCKS = {
    **dict.fromkeys("address article aside body center details dialog dir div dd dt fieldset figcaption footer form header hgroup html legend li main nav optgroup option search section summary caption tr".split(), 0),
    **dict.fromkeys("p h1 h2 h3 h4 h5 h6 ul ol dl menu pre blockquote figure table xmp".split(), 1),
}
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dt dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS = frozenset(("td", "th"))
SCOPE = frozenset("table td th caption html object template".split())
LISTS = frozenset("ul ol menu dir".split())
TABLE_PARTS = frozenset("tbody thead tfoot tr td th caption colgroup col".split())


class Flow:
    """Lines laid out so far: text of the current line, white space and blank lines still to come."""

    __slots__ = ("lines", "line", "space", "gap")

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0

    def text(self, s: str) -> None:
        words = _SPACE.sub(" ", s)
        if self.line and (self.space or words[0] == " ") and words != " ":
            self.line.append(" ")
        if words == " ":
            self.space = True
            return
        self.space = words[-1] == " "
        self.line.append(words.strip(" "))

    def raw(self, s: str) -> None:
        first, *rest = s.replace("\r\n", "\n").split("\n")
        if first:
            self.line.append(first)
        for x in rest:
            self.end_line(True)
            if x:
                self.line.append(x)

    def end_line(self, even_empty: bool = False) -> None:
        if self.line or even_empty:
            self.put("".join(self.line).rstrip(" ") if not even_empty else "".join(self.line))
        self.line, self.space = [], False

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        self.lines.append(line)

    def block(self, margin: int) -> None:
        self.end_line()
        self.gap = max(self.gap, margin)

    def finish(self) -> list[str]:
        self.end_line()
        return self.lines


class Element:
    __slots__ = ("name", "flow", "shown", "visible", "own", "count", "rows", "span", "marker")

    def __init__(self, name: str, flow: Flow, shown: bool, visible: bool) -> None:
        self.name, self.flow, self.shown, self.visible = name, flow, shown, visible
        self.own: Flow | None = None  # laid out apart and set into the parent's flow at the end
        self.count = 0
        self.rows: list[list[tuple]] | None = None
        self.span = (1, 1)
        self.marker = ""


def _attributes(s: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(s):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


_SELECTOR = re.compile(r"([a-z][a-z0-9]*|\*)?((?:[.#][\w-]+)*)")
_STYLE = re.compile(r"<style(?=[\s/>])[^>]*>(.*?)</style", re.I | re.S)


def style_rules(html: str) -> list[tuple]:
    """(tag or "", ids, classes, property, value, rank) of the simple rules for display and visibility in a page's style sheets."""
    out: list[tuple] = []
    for css in _STYLE.findall(html):
        css, medium, open_at = re.sub(r"/\*.*?(?:\*/|\Z)", " ", css, flags=re.S).replace("<!--", " ").replace("-->", " "), [], 0
        for m in re.finditer(r"([^{};]*)([{};])", css):
            head, mark = m[1].strip().lower(), m[2]
            if mark == "}":
                if open_at:
                    open_at = 0
                elif medium:
                    medium.pop()
            elif mark == "{" and head.startswith("@"):
                medium.append(head.startswith("@media") and "print" not in head)
            elif mark == "{":
                open_at = m.end()
                body = css[open_at : css.find("}", open_at) if "}" in css[open_at:] else len(css)]
                if not all(medium):
                    continue
                for name, value in re.findall(r"(display|visibility)\s*:\s*([^;]+)", body, re.I):
                    important = "!important" in value.lower().replace(" ", "")
                    for one in m[1].split(","):
                        if (found := _SELECTOR.fullmatch(one.strip())) and one.strip():
                            marks = re.findall(r"([.#])([\w-]+)", found[2])
                            ids, classes = frozenset(x for k, x in marks if k == "#"), frozenset(x for k, x in marks if k == ".")
                            tag = "" if found[1] in (None, "*") else found[1]
                            out.append((tag, ids, classes, name.lower(), value.lower().split("!")[0].strip(), (important, len(ids), len(classes), bool(tag), len(out))))
    return out


def _number(s: str | None, default: int, most: int) -> int:
    m = re.match(r"\s*(\d{1,6})", s or "")
    return min(max(int(m[1]), 1), most) if m else default


def lay_out_table(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of (lines, colspan, rowspan) as lines with aligned columns."""
    taken: dict[int, int] = {}  # column: rows it is still held for
    placed = []
    for row in rows:
        at, cells, fresh = 0, [], {}
        for lines, across, down in row:
            while taken.get(at, 0):
                at += 1
            cells.append((at, across, lines))
            if down > 1:
                fresh.update(dict.fromkeys(range(at, at + across), down))
            at += across
        taken = {c: n - 1 for c, n in {**{c: n for c, n in taken.items() if c not in fresh}, **fresh}.items() if n > 1}
        placed.append(cells)
    width: dict[int, int] = {}
    for cells in placed:
        for at, across, lines in cells:
            if across == 1:
                width[at] = max([width.get(at, 0), *(len(x) for x in lines if len(x) <= MAX_PAD)])
    begin, edge = {}, 0
    for c in range(max((at + across for cells in placed for at, across, _ in cells), default=0)):
        begin[c] = edge
        if width.get(c):
            edge += width[c] + 2
    out = []
    for cells in placed:
        for i in range(max((len(lines) for _, _, lines in cells), default=0)):
            line = ""
            for at, _, lines in cells:
                if i < len(lines) and lines[i]:
                    line = line + "  " if len(line) > begin[at] - 2 and line else line
                    line = line.ljust(begin[at]) + lines[i]
            out.append(line.rstrip(" "))
    return out


class Renderer:
    """One page."""

    def __init__(self, rules: list[tuple] = ()) -> None:
        # of equal selectors the strongest rule counts; rules are looked up by a class, id or tag that they ask for
        best: dict[tuple, tuple] = {}
        for rule in rules:
            if rule[:4] not in best or rule[5] > best[rule[:4]][5]:
                best[rule[:4]] = rule
        self.rules: dict[str, list[tuple]] = {}
        for rule in best.values():
            tag, ids, classes = rule[:3]
            self.rules.setdefault("." + min(classes) if classes else "#" + min(ids) if ids else tag, []).append(rule)
        self.flow = Flow()
        self.root = Element("#root", self.flow, True, True)
        self.stack = [self.root]
        self.open: dict[str, list[int]] = {}  # places in the stack of open elements by name
        self.layouts = 0
        self.head_done = False
        self.pre = 0
        self.foreign = 0

    # --- the stack of open elements

    def find(self, names, stop) -> int:
        """Index of the nearest open element among names, none of stop in between; 0 if there is none. The work does not
        depend on how many elements are open."""
        i = self.last(names)
        return i if i and i >= self.last(stop) else 0

    def last(self, names) -> int:
        """Index of the nearest open element among names; 0 if there is none."""
        top = 0
        for name in names:
            if (places := self.open.get(name)) and places[-1] > top:
                top = places[-1]
        return top

    def pop_to(self, i: int) -> None:
        while i and len(self.stack) > i:
            self.close()

    def push(self, name: str, shown: bool, visible: bool) -> Element:
        parent = self.stack[-1]
        e = Element(name, parent.own or parent.flow, parent.shown and shown, visible)
        self.open.setdefault(name, []).append(len(self.stack))
        self.stack.append(e)
        self.foreign += name in ("math", "svg")
        return e

    def lay_apart(self, e: Element) -> None:
        if self.layouts < MAX_DEPTH:
            e.own = Flow()
            self.layouts += 1

    def close(self) -> None:
        e = self.stack.pop()
        name = e.name
        self.open[name].pop()
        if name in ("pre", "textarea", "xmp"):
            self.pre -= 1
        self.foreign -= name in ("math", "svg")
        if e.own is not None:
            self.layouts -= 1
            lines = e.own.finish()
            if name in CELLS:
                table = self.last(("table",))
                if e.shown and table and self.stack[table].rows:
                    self.stack[table].rows[-1].append((lines, *e.span))
                return
            if lines:
                pad = " " * len(e.marker) if e.marker.strip() else e.marker
                e.flow.put(e.marker + lines[0])
                for x in lines[1:]:
                    e.flow.put(pad + x if x else "")
        if e.rows:
            e.flow.block(1)
            for line in lay_out_table(e.rows):
                e.flow.put(line)
        if name in BLOCKS and e.shown:
            nested = name in LISTS and self.last(("li",)) > 0
            e.flow.block(0 if nested else BLOCKS[name])

    # --- tokens

    def text(self, s: str) -> None:
        top = self.stack[-1]
        if self.foreign and (i := self.in_foreign()) and self.stack[i].name == "svg" and self.last(("text",)) < i:
            return
        if top.name == "head" and s.strip(_BLANK):
            self.pop_to(len(self.stack) - 1)
            self.head_done = True
            top = self.stack[-1]
        if not (top.shown and top.visible) or top.name == "details" and top.marker == "closed":
            return
        flow = top.own or top.flow
        s = unescape(s) if "&" in s else s
        if top.name in ("table", "tbody", "thead", "tfoot", "tr", "colgroup"):
            if not s.strip(_BLANK):
                return
        if s:
            (flow.raw if self.pre else flow.text)(s)

    def in_foreign(self) -> int:
        """Index of the formula or drawing whose own markup comes next; 0 if it is html."""
        return self.find(("math", "svg"), TO_HTML) if self.foreign else 0

    def start(self, name: str, attributes: str) -> None:
        if (i := self.in_foreign()) and name in ENDS_FOREIGN:
            self.pop_to(i)
        if name not in ("math", "svg") and not self.in_foreign():
            self.start_html(name, attributes)
            return
        parent = self.stack[-1]
        if parent.name in ("semantics", "maction"):
            parent.count += 1
        flow = parent.own or parent.flow
        drawing = self.stack[i].name == "svg" if (i := self.in_foreign()) else name == "svg"
        self.start_html(name, attributes)
        e = self.stack[-1]
        if e is parent or e.name != name:
            return
        if drawing:
            if name in SVG_NEVER:
                e.shown = False
            elif name == "text":
                flow.space = True
        elif name in ("annotation", "annotation-xml") or parent.name in ("semantics", "maction") and parent.count > 1:
            e.shown = False
        elif name == "mphantom":
            e.visible = False
        elif e.shown and e.visible:
            if name == "mtr":
                flow.block(0)
            flow.space = flow.space or name == "mtd"
        if attributes.endswith("/") and all(m.end() < len(attributes) for m in _ATTRIBUTE.finditer(attributes)):
            self.close()

    def styled(self, name: str, a: dict[str, str]) -> dict[str, str]:
        """display and visibility that the page's rules give an element."""
        out: dict[str, tuple] = {}
        classes = frozenset(a["class"].split()) if "class" in a else frozenset()
        near = [name, "", *(["#" + a["id"]] if "id" in a else []), *("." + c for c in classes)]
        for tag, ids, wanted, prop, value, rank in (rule for place in near for rule in self.rules.get(place, ())):
            if (not tag or tag == name) and wanted <= classes and (not ids or ids == {a.get("id")}) and (prop not in out or rank > out[prop][0]):
                out[prop] = (rank, value)
        return {prop: value for prop, (_, value) in out.items()}

    def start_html(self, name: str, attributes: str) -> None:
        stack = self.stack
        if name == "body" or name == "html":
            self.pop_to(self.find(("head",), ()))
            self.head_done = self.head_done or name == "body"
            return
        if stack[-1].name == "head" and name not in HEAD:
            self.close()
            self.head_done = True
        if name == "head":
            if not self.head_done:
                self.push("head", False, True)
            return
        if name == "image":
            name = "img"
        if name in CLOSES_P and (i := self.find(("p",), SCOPE | {"button"})):
            if name not in ("li", "dt", "dd") or stack[-1].name == "p":
                self.pop_to(i)
        if name == "li":
            self.pop_to(self.find(("li",), SCOPE | LISTS))
        elif name in ("dt", "dd"):
            self.pop_to(self.find(("dt", "dd"), SCOPE | {"dl"}))
        elif name in HEADINGS and stack[-1].name in HEADINGS:
            self.close()
        elif name in ("option", "optgroup"):
            if stack[-1].name == "option":
                self.close()
            if name == "optgroup" and stack[-1].name == "optgroup":
                self.close()
        elif name in TABLE_PARTS:
            table = self.find(("table",), ("template",))
            if not table:
                return
            if name in CELLS:
                self.pop_to(self.find(("td", "th", "caption"), ("table",)))
                if not self.find(("tr",), ("table",)):
                    self.start("tr", "")
            elif name == "tr":
                self.pop_to(self.find(("tr", "caption", "colgroup"), ("table",)))
            else:
                self.pop_to(self.find(("tbody", "thead", "tfoot", "tr", "caption", "colgroup"), ("table",)))
            stack = self.stack
        parent, a = stack[-1], {}
        if attributes and (name not in VOID or name == "input" or self.rules):
            a = _attributes(attributes)
        shown, visible = name not in NEVER, parent.visible
        if "hidden" in a and a["hidden"].lower() != "until-found":
            shown = False
        if self.rules:
            given = self.styled(name, a)
            shown = shown and given.get("display") != "none"
            if "visibility" in given:
                visible = given["visibility"] not in ("hidden", "collapse")
        if "style" in a:
            style = re.sub(r"\s+|!important", "", a["style"].lower())
            if found := re.findall(r"(?:^|;)display:([\w-]+)", style):
                shown = name not in NEVER and "hidden" not in a and found[-1] != "none" if self.rules else shown and found[-1] != "none"
            if found := re.findall(r"(?:^|;)visibility:(\w+)", style):
                visible = found[-1] not in ("hidden", "collapse")
        if parent.name == "details" and name != "summary" and parent.marker == "closed" or name == "dialog" and "open" not in a:
            shown = False
        flow = parent.own or parent.flow
        if name in VOID:
            if parent.shown and parent.visible and shown and visible:
                if name == "input" and (kind := a.get("type", "text").lower()) not in SILENT:
                    label = a.get("value", "") or ("" if kind in LABELLED else a.get("placeholder", ""))
                    if label.strip(_BLANK):
                        flow.space = True
                        flow.text(label + " ")
                if name == "br":
                    flow.end_line(True)
                elif name == "hr":
                    flow.block(0)
            return
        e = self.push(name, shown, visible)
        if name in ("pre", "textarea", "xmp"):
            self.pre += 1
        if name == "details" and "open" not in a:
            e.marker = "closed"
        if not e.shown:
            return
        if name in BLOCKS and name != "table":  # text that strays into a table still belongs to the line before it
            nested = name in LISTS and self.last(("li",)) > 0
            flow.block(0 if nested else BLOCKS[name])
        if name == "table":
            e.rows = []
        elif name == "tr":
            table = self.last(("table",))
            if table and self.stack[table].rows is not None:
                self.stack[table].rows.append([])
        elif name in CELLS:
            e.span = (_number(a.get("colspan"), 1, MAX_SPAN), _number(a.get("rowspan"), 1, 65_534))
            self.lay_apart(e)
            if e.own is None:
                flow.block(0)
        elif name in ("ol", "ul", "menu", "dir"):
            e.count = _number(a.get("start"), 1, 999_999) - 1 if name == "ol" else 0
        elif name == "li":
            holder = self.stack[self.last(LISTS)]  # the root if there is none
            if holder.name == "ol":
                holder.count = _number(a.get("value"), holder.count + 1, 999_999)
                e.marker = f"{holder.count}. "
            else:
                e.marker = "* "
            self.lay_apart(e)
        elif name in ("blockquote", "dd"):
            e.marker = "    "
            self.lay_apart(e)

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", "")
        elif name == "p" and not self.find(("p",), SCOPE | {"button"}):
            self.start("p", "")
            self.close()
        elif name in HEADINGS:
            self.pop_to(self.find(HEADINGS, SCOPE))
        elif name == "head":
            self.pop_to(self.find(("head",), ()))
            self.head_done = True
        elif name in ("body", "html"):
            pass
        elif name == "table":
            self.pop_to(self.find(("table",), ("template",)))
        elif name in TABLE_PARTS:
            self.pop_to(self.find((name,), ("table",)))
        else:
            stop = SCOPE - {name} | (LISTS if name == "li" else frozenset())
            self.pop_to(self.find((name,), stop - {name}))

    def render(self, html: str) -> str:
        at, n = 0, len(html)
        while at < n:
            lt = html.find("<", at)
            m = None
            while lt >= 0 and (m := _TAG.match(html, lt)) is None:
                lt = html.find("<", lt + 1)
            if m is None:
                self.text(html[at:])
                break
            if m.start() > at:
                self.text(html[at : m.start()])
            at = m.end()
            name = m[2]
            if name is None or not m[4]:
                continue
            name = name.lower()
            if m[1]:
                self.end(name)
                continue
            self.start(name, m[3])
            if name in RAW and self.stack[-1].name == name:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at)
                body = html[at : close.start()] if close else html[at:]
                if name in ("textarea", "xmp"):
                    body = body[1:] if body[:1] == "\n" else body
                    self.text(body if name == "textarea" else body.replace("&", "&amp;"))
                self.close()
                at = close.end() if close else n
            elif name == "pre" and html[at : at + 1] == "\n":
                at += 1
        self.pop_to(1)
        return "\n".join(self.flow.finish())


def render(html: str) -> str:
    """Text of one page."""
    return Renderer(style_rules(html) if "<style" in html.lower() else ()).render(html)


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, text, n_lines, n_chars) of every page; parsing is local to a page, nothing is shuffled."""
    rows = pages.select("page_id", "html")

    def run(batch: pa.RecordBatch):
        texts = [None if h is None else render(h) for h in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string())], ["page_id", "text"])

    out = map_arrow(rows, run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, text string")
    n_lines = F.when(F.length("text") > 0, F.size(F.split("text", "\n"))).otherwise(F.when(F.col("text").isNotNull(), 0))
    return out.select("page_id", "text", n_lines.cast("long").alias("n_lines"), F.length("text").cast("long").alias("n_chars"))


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
