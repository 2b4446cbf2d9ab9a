"""Pages resolved while they are parsed: fields with labels and flags, texts with what stands around them.

One page is one row, so nothing about its tree needs a shuffle: the parser's nodes
are walked once, inherited marks (hidden, restricted, form, label, cell) go down
with the walk, contents and headings come up, and one row a page leaves the task.
Values of secret and sign-in fields are dropped here; they are in no other column.

The rules are those of :mod:`redactlake.operators.pages`, which states them for
tables of nodes, cells and siblings.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactlake.functions import rules as R
from redactlake.operators import pages as P
from redactlake.sources.html import parsed

_TEXT = (
    "node_ord int, text string, restricted boolean, is_header boolean, heading string, preceding_label string, sibling_label string, reads_like_label boolean"
)
_FIELD = "node_ord int, field_id string, label string, value string, type string, locked boolean, authentication boolean"

# white space as the column expressions have it
_WORDS = re.compile(rf"[^{R.SPACE}]+", re.ASCII)
_EDGES = re.compile(rf"^[{R.SPACE}]+|[{R.SPACE}]+\Z", re.ASCII)
_DELIMITED = re.compile(rf"[:\-][{R.SPACE}]*\Z", re.ASCII)
_HEADER_WORDS = re.compile(R.whole_words(P.HEADER_WORDS))
_OFFSCREEN = re.compile(R.whole_words(P.RESTRICTED_CLASSES))
_HIDDEN_STYLE = re.compile(r"(^|;)(display:none|visibility:hidden|opacity:0(\.0+)?(;|!|\Z))")
_SECRET_AUTOCOMPLETE = re.compile(P.SECRET_AUTOCOMPLETE)
_SECRET_HINTS = [re.compile(x) for x in P.SECRET_HINTS]
_USER = re.compile(P.USER_AUTOCOMPLETE.replace(r"\z", r"\Z")), re.compile(R.whole_words(P.USER_WORDS))
_IDENTITY = re.compile(P.IDENTITY_HINT)
_LOGIN = re.compile(R.whole_words(P.LOGIN_WORDS))


def trim(text: str) -> str:
    return _EDGES.sub("", text)


def few_words(trimmed: str) -> bool:
    return len(_WORDS.findall(trimmed)) <= R.MAX_LABEL_WORDS


def _lower(text: str) -> str:
    return re.sub(r"\s", "", text.lower())


class Node:
    """A node of the parse with its nearest ancestors of each sort, and whether it is hidden or bears no labels."""

    __slots__ = ("attrs", "blocked", "cell", "doc", "end", "form", "hidden", "box", "kind", "label", "ord", "parent", "row", "table", "tag", "text", "thead")

    def __init__(self, row: list, parent: Node | None):
        self.doc, self.ord, _, _, self.end, _, self.kind, self.tag, self.attrs, self.text = row
        self.parent = parent
        for mark in _IS:
            setattr(self, mark, None if parent is None else parent._below(mark))
        above = parent is not None and parent.hidden
        self.hidden = above or (self.kind == "element" and self._hides())
        above = parent is not None and parent.blocked and parent.doc == self.doc
        self.blocked = above or (self.kind == "element" and self._blocks())

    def get(self, name: str) -> str:
        return self.attrs.get(name) or ""

    def _below(self, mark: str) -> Node | None:
        """The nearest node of that sort, itself included."""
        return self if self.kind == "element" and _IS[mark](self) else getattr(self, mark)

    def _hides(self) -> bool:
        return (
            self.tag in ("head", "title", "datalist") or "hidden" in self.attrs or self.get("aria-hidden") == "true"
            or self.get("type").lower() == "hidden" or bool(_HIDDEN_STYLE.search(_lower(self.get("style"))))
        )

    def _blocks(self) -> bool:
        style = _lower(self.get("style"))
        clipped = "position:absolute" in style and re.search("clip|overflow:hidden", style) and re.search(r"(^|;)(width|height):[01]px", style)
        return (
            self.tag in P.RESTRICTED_TAGS or self.get("role").lower() in P.RESTRICTED_ROLES or self.get("aria-hidden") == "true"
            or bool(_OFFSCREEN.search(self.get("class"))) or bool(clipped)
        )


_CELL_ROLES = ("cell", "gridcell", "columnheader", "rowheader")
_IS: dict[str, Callable[[Node], bool]] = {
    "cell": lambda n: n.tag in ("td", "th") or n.get("role") in _CELL_ROLES,
    "form": lambda n: n.tag == "form",
    "box": lambda n: n.get("role") in ("form", "dialog"),
    "label": lambda n: n.tag == "label",
    "row": lambda n: n.tag == "tr" or n.get("role") == "row",
    "table": lambda n: n.tag == "table" or n.get("role") in ("table", "grid"),
    "thead": lambda n: n.tag == "thead",
}


def _span(value: str) -> int:
    return int(value) if re.fullmatch(r"[0-9]{1,3}", value) else 1


class Page:
    """Answers about the nodes of one page."""

    def __init__(self, key, rows: list[list]):
        self.key = key
        self.nodes: list[Node] = []
        for row in rows:
            self.nodes.append(Node(row, None if row[2] is None else self.nodes[row[2]]))
        self.elements = [n for n in self.nodes if n.kind == "element"]
        self.controls = [n for n in self.elements if n.tag in P.CONTROLS]
        self.before: dict[int, Node] = {}  # element before each element
        self.preceding: dict[int, Node] = {}  # what stands before each text, blanks left out
        self._neighbours()

    def _neighbours(self) -> None:
        last_element: dict[int | None, Node] = {}
        last: dict[int | None, Node] = {}
        for n in self.nodes:
            at = None if n.parent is None else n.parent.ord
            if n.kind == "element":
                if at in last_element:
                    self.before[n.ord] = last_element[at]
                last_element[at] = last[at] = n
            elif trim(n.text):
                if at in last:
                    self.preceding[n.ord] = last[at]
                last[at] = n

    def content(self, node: Node | None) -> str:
        """All text below an element, or a text itself."""
        if node is None:
            return ""
        if node.kind != "element":
            return node.text
        return "".join(self.nodes[i].text for i in range(node.ord + 1, node.end + 1) if self.nodes[i].kind == "text")

    @cached_property
    def holders(self) -> set[int]:
        """Elements with a control somewhere below."""
        out: set[int] = set()
        for c in self.controls:
            up = c.parent
            while up is not None and up.ord not in out:
                out.add(up.ord)
                up = up.parent
        return out

    @cached_property
    def headings(self) -> dict[int, tuple[bool, str]]:
        """For every table cell: is it a heading, and which heading stands over it."""
        with_control = {c.cell.ord for c in self.controls if c.cell is not None}
        tables: dict[int, dict[int, list[Node]]] = defaultdict(lambda: defaultdict(list))
        for n in self.elements:
            if _IS["cell"](n) and n.row is not None and n.table is not None:
                tables[n.table.ord][n.row.ord].append(n)
        out = {}
        for table, rows in tables.items():
            above: dict[str, str] | None = None
            head_merged = False
            for at, row in enumerate(sorted(rows)):
                cells = rows[row]
                texts = [trim(self.content(c)) for c in cells]
                column = [(c.tag == "th" and c.get("scope") != "row") or c.get("role") == "columnheader" for c in cells]
                plain = all(t and not re.search("[0-9]", t) and few_words(t) and c.ord not in with_control for c, t in zip(cells, texts, strict=True))
                known = sum(bool(_HEADER_WORDS.search(t)) for t in texts)
                in_thead = any(c.thead is not None and c.thead.ord > table for c in cells)
                is_head = in_thead or all(column) or (at == 0 and len(cells) >= 2 and plain and known >= 2)
                merged = any(_span(c.get("colspan")) > 1 or _span(c.get("rowspan")) > 1 for c in cells)
                if is_head:
                    above, head_merged = {}, merged
                    for place, (c, t) in enumerate(zip(cells, texts, strict=True)):
                        for key in self._keys(c, place):
                            above.setdefault(key, t)
                for place, c in enumerate(cells):
                    explicit = c.tag == "th" or c.get("role") in ("columnheader", "rowheader")
                    header = is_head or c.get("role") == "columnheader"
                    heading = "" if header or above is None or merged or head_merged else above.get(self._keys(c, place)[0], "")
                    out[c.ord] = (True if header else explicit if above is None else False, heading)
        return out

    @staticmethod
    def _keys(cell: Node, place: int) -> list[str]:
        return [f"a{cell.get('aria-colindex')}"] * bool(cell.get("aria-colindex")) + [f"p{place}"]

    # --- texts -------------------------------------------------------------------
    def texts(self) -> list[tuple]:
        """Visible texts that are not blank, in document order."""
        out = []
        for n in self.nodes:
            if n.kind != "text" or n.hidden or not trim(n.text):
                continue
            is_header, heading = self.headings.get(n.cell.ord, (False, "")) if n.cell is not None else (False, "")
            beside = None if n.parent is None else self.before.get(n.parent.ord)
            sibling = "" if beside is None or beside.ord in self.holders else self.content(beside)
            label = trim(sibling)
            semantic = beside is not None and (beside.tag in ("label", "dt", "th") or (n.parent.tag == "td" and beside.tag == "td"))
            reads = few_words(label) and (semantic or bool(_DELIMITED.search(label)))
            out.append((n.ord, n.text, n.blocked, is_header, heading, self.content(self.preceding.get(n.ord)), sibling, reads))
        return out

    # --- fields ------------------------------------------------------------------
    @cached_property
    def _by_for(self) -> dict[tuple[int, str], Node]:
        out: dict[tuple[int, str], Node] = {}
        for n in self.elements:
            if n.tag == "label" and n.get("for"):
                out.setdefault((n.doc, n.get("for")), n)
        return out

    @cached_property
    def _by_id(self) -> dict[tuple[int, str], Node]:
        out: dict[tuple[int, str], Node] = {}
        for n in self.elements:
            if n.get("id"):
                out.setdefault((n.doc, n.get("id")), n)
        return out

    def label(self, n: Node) -> str:
        """The first candidate that is not blank and has few words."""
        own = self._by_for.get((n.doc, n.get("id"))) if n.get("id") else None
        if own is None or (n.label is not None and n.label.ord < own.ord):
            own = n.label
        refs = [self._by_id[n.doc, r] for r in _WORDS.findall(n.get("aria-labelledby")) if (n.doc, r) in self._by_id]
        heading = self.headings.get(n.cell.ord, (False, ""))[1] if n.cell is not None else ""
        candidates = [
            self.content(own), self.content(n.label), n.get("aria-label") or " ".join(map(self.content, refs)), heading, n.get("placeholder"), self._adjacent(n),
        ]
        return next((t for t in map(trim, candidates) if t and few_words(t)), P.NO_LABEL)

    def _adjacent(self, n: Node) -> str:
        up = n.parent
        sibling = self.before.get(n.ord) or (up and self.before.get(up.ord))
        if sibling is not None:
            text = trim(self.content(sibling))
            semantic = sibling.tag in ("label", "dt", "th") or (up is not None and up.tag == "td" and sibling.tag == "td")
            if semantic or (few_words(text) and _DELIMITED.search(text)):
                return text
        cell = up and up.parent and self.before.get(up.parent.ord)
        text = trim(self.content(cell)) if cell is not None else ""
        return text if cell is not None and few_words(text) and (_DELIMITED.search(text) or cell.tag in ("dt", "th")) else ""

    @staticmethod
    def type_of(n: Node) -> str:
        return (n.get("type").lower() or "text") if n.tag == "input" else "select-one" if n.tag == "select" else n.tag

    def is_secret_control(self, n: Node) -> bool:
        return self.type_of(n) == "password" or bool(set(_WORDS.findall(n.get("autocomplete").lower())) & set(P.SECRET_CONTROL.split("|")))

    def is_never_read(self, n: Node, label: str) -> bool:
        auto = n.get("autocomplete").lower()
        hint = " ".join((label, n.get("name"), n.get("id"), auto))
        return self.type_of(n) == "password" or bool(_SECRET_AUTOCOMPLETE.search(auto)) or any(x.search(hint) for x in _SECRET_HINTS)

    def _says_login(self, form: Node) -> bool:
        inner = [self.nodes[i] for i in range(form.ord + 1, form.end + 1)]
        inner = [n for n in inner if n.kind == "element"]
        heading = next((n for n in inner if n.tag in ("h1", "h2", "h3") or n.get("role") == "heading"), None)
        submit = next((n for n in inner if n.tag in ("button", "input") and n.get("type").lower() == "submit"), None)
        shown = (self.content(submit) or submit.get("value")) if submit is not None else ""
        return bool(_LOGIN.search(" ".join((*(form.get(a) for a in ("action", "id", "name", "aria-label")), self.content(heading), shown))))

    def fields(self) -> list[tuple]:
        """Visible fields; the values of secrets and sign-in fields are blank."""
        shown = [n for n in self.controls if not n.hidden]
        place = lambda n: n.form or n.box
        secret = [n for n in shown if self.is_secret_control(n)]
        secret_forms = {place(n).ord for n in secret if place(n) is not None}
        login = {f.ord: self._says_login(f) for f in {place(n) for n in shown} - {None}}
        out = []
        for n in shown:
            label, kind, form = self.label(n), self.type_of(n), place(n)
            hint = " ".join((n.get("name"), n.get("id"), label))
            locked = self.is_never_read(n, label)
            user = bool(_USER[0].search(n.get("autocomplete")) or _USER[1].search(hint))
            identity = bool(_IDENTITY.search(hint)) or kind in ("email", "tel")
            signs_in = user or (identity and bool(secret)) or (form is not None and (form.ord in secret_forms or login[form.ord]))
            signs_in = signs_in and not locked
            value = ""
            if not locked and not signs_in:
                given = n.attrs.get("value")
                value = trim(given if given is not None else "on" if kind in ("checkbox", "radio") else "")
            if value or label != P.NO_LABEL or locked or signs_in:
                out.append((n.ord, n.get("id") or f"{self.key}:{n.ord}", label, value, kind, locked, signs_in))
        return out


def drop_secrets(rows: list[list]) -> None:
    """Take the values of secrets out of parsed nodes, whatever tells that they are secrets."""
    page = Page(None, rows)
    for n in page.controls:
        if page.is_never_read(n, page.label(n)):
            n.attrs.pop("value", None)
            if n.tag == "textarea":
                for row in rows[n.ord + 1 : n.end + 1]:
                    row[9] = "" if row[6] == "text" else row[9]


def resolved_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row a page: ``texts`` and ``fields`` in document order."""
    schema = f"{key} {dict(pages.dtypes)[key]}, texts array<struct<{_TEXT.replace(' ', ':').replace(',:', ',')}>>, fields array<struct<{_FIELD.replace(' ', ':').replace(',:', ',')}>>"
    names = [[c.split()[0] for c in columns.split(", ")] for columns in (_TEXT, _FIELD)]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 64):
                out = []
                part = batch.iloc[start : start + 64]
                for page, source in zip(part[key], part[html], strict=True):
                    one = Page(page, parsed(source))
                    out.append((page, [dict(zip(names[0], t, strict=True)) for t in one.texts()], [dict(zip(names[1], f, strict=True)) for f in one.fields()]))
                yield pd.DataFrame(out, columns=[key, "texts", "fields"])

    return pages.select(key, html).mapInPandas(work, schema)


def page_texts(resolved: DataFrame, key: str = "page_id") -> DataFrame:
    """Visible texts of resolved pages with their surroundings."""
    return resolved.select(key, F.inline("texts"))


def page_fields(resolved: DataFrame, key: str = "page_id", cap: int | None = None, cap_value: int | None = None) -> DataFrame:
    """Form fields of resolved pages: label, value, type, flags.  All fields and whole values, unless caps are asked for."""
    fields = F.col("fields") if cap is None else F.slice("fields", 1, cap)
    out = resolved.select(key, F.inline(fields))
    return out if cap_value is None else out.withColumn("value", F.substring("value", 1, cap_value))
