"""HTML tables to node tables.

Spark has no HTML parser, so tags are read with the standard library inside
``mapInPandas``: one page in, its nodes out, nothing kept between pages.  The
tree is encoded by pre-order numbers, so everything after this step is plain
joins and windows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce
from html.entities import html5
from html.parser import HTMLParser
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactlake.functions import rules as R

# --- fixed values -----------------------------------------------------------
SKIPPED = ("script", "style", "noscript", "template", "svg", "canvas")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# ----------------------------------------------------------------------------
# An opening tag ends these open elements, up to the given boundary.
_ITEM = {"li": ({"li"}, {"ul", "ol", "menu"}), "option": ({"option"}, {"select"})}
_ITEM["dt"] = _ITEM["dd"] = ({"dt", "dd"}, {"dl"})
_ITEM["td"] = _ITEM["th"] = ({"td", "th"}, {"tr", "table"})
_ITEM["tr"] = ({"tr"}, {"table"})
_ITEM["tbody"] = _ITEM["thead"] = _ITEM["tfoot"] = ({"tbody", "thead", "tfoot"}, {"table"})
_ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main "
    "menu nav ol p pre section table ul".split()
)
_P_BOUNDARY = {"td", "th", "button", "li", "table", "body", "div", "section", "article"}

NODE_SCHEMA = (
    "doc_ord int, node_ord int, parent_ord int, sib_ord int, subtree_end int, path array<int>, "
    "node_type string, tag string, attrs map<string,string>, text string"
)


class _Tree(HTMLParser):
    """Collects nodes of one document; nested documents continue the numbering."""

    def __init__(self, rows: list, doc: list, parent: int | None, path: list):
        super().__init__(convert_charrefs=True)
        self.rows, self.doc, self.me = rows, doc, doc[0]
        self.open = [(None, parent, path, [0])]  # tag, ord, path, children so far
        self.skip: list[str] = []
        self.pending = ""

    def add(self, kind: str, tag: str | None, attrs: dict, text: str | None) -> list:
        _, parent, path, children = self.open[-1]
        row = [self.me, len(self.rows), parent, children[0], len(self.rows), list(path), kind, tag, attrs, text]
        children[0] += 1
        self.rows.append(row)
        return row

    def flush(self) -> None:
        if self.pending:
            self.add("text", None, {}, self.pending)
            self.pending = ""

    def close_top(self) -> None:
        tag, node, _, _ = self.open.pop()
        last = len(self.rows) - 1
        self.rows[node][4] = last
        if tag == "textarea":
            self.rows[node][8]["value"] = "".join(r[9] for r in self.rows[node + 1 :] if r[6] == "text")
        if tag == "select":
            options = [r for r in self.rows[node + 1 :] if r[7] == "option"]
            chosen = ([o for o in options if "selected" in o[8]] or options)[:1]
            for o in chosen:
                inner = "".join(r[9] for r in self.rows[o[1] + 1 : o[4] + 1] if r[6] == "text")
                self.rows[node][8]["value"] = o[8].get("value", inner)

    def pop_until(self, ends: set, boundary: set) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] in ends:
                while len(self.open) > i:
                    self.close_top()
                return
            if self.open[i][0] in boundary:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        values = {k: (v if v is not None else "") for k, v in attrs}
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.append(tag)
            return
        self.flush()
        if tag in SKIPPED and not (tag == "template" and values.get("shadowrootmode") == "open"):
            self.skip.append(tag)
            return
        if tag in _ENDS_P:
            self.pop_until({"p"}, _P_BOUNDARY)
        if tag in _ITEM:
            self.pop_until(*_ITEM[tag])
        hint = f"{values.get('type', '')} {values.get('autocomplete', '')}".lower()
        if tag == "input" and any(w in hint for w in ("password", "one-time-code", "cc-")):
            values.pop("value", None)  # secrets are not even read
        row = self.add("element", tag, values, None)
        if tag == "template":
            self.doc[0] += 1
            row[7] = "#shadow-root"
        if tag == "iframe" and "srcdoc" in values:
            self.doc[0] += 1
            inner = _Tree(self.rows, self.doc, row[1], row[5] + [row[1]])
            inner.feed(values.pop("srcdoc"))
            inner.finish()
            row[4] = len(self.rows) - 1
        if tag not in VOID:
            self.open.append((tag, row[1], row[5] + [row[1]], [0]))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED:
            return
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
            return
        self.flush()
        if any(t == tag for t, *_ in self.open[1:]):
            self.pop_until({tag}, set())

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.pending += data

    def handle_comment(self, data: str) -> None:
        self.flush()

    def finish(self) -> None:
        self.close()
        self.flush()
        while len(self.open) > 1:
            self.close_top()


def parsed(source: str | None) -> list[list]:
    """Nodes of one page in document order, as ``NODE_SCHEMA`` lists them."""
    rows: list[list] = []
    tree = _Tree(rows, [0], None, [])
    tree.feed(source or "")
    tree.finish()
    return rows


def page_nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per element or text node, in document order.

    ``path`` lists the ancestors' ``node_ord``; ``[node_ord, subtree_end]`` spans the
    subtree.  Frames with ``srcdoc`` and open shadow roots are walked as further
    documents of the page; frames from elsewhere are not.  Values of secrets are
    dropped, be it the type, name, id, autocomplete or label that tells.
    """
    from redactlake.sources.resolve import drop_secrets  # it reads what is parsed here

    key_type = dict(pages.dtypes)[key]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, *[c.split()[0] for c in NODE_SCHEMA.split(", ")]]
        for batch in batches:
            out: list[list] = []
            for page, source in zip(batch[key], batch[html]):
                rows = parsed(source)
                drop_secrets(rows)
                out.extend([page, *r] for r in rows)
                if len(out) > 20000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    return pages.select(key, html).mapInPandas(walk, f"{key} {key_type}, {NODE_SCHEMA}")


# --- text chunks without a tree ----------------------------------------------
_BLOCKS = rf"(?is)<(head|{'|'.join(SKIPPED)})(?=[\s>/]).*?</\1\s*>"
_COMMENTS = r"(?s)<!--.*?-->"
_TAGS = r"(?s)<[!/?A-Za-z][^>]*>"


#: Tried before the dictionary.
_COMMON = ("amp;", "lt;", "gt;", "quot;", "nbsp;", "apos;", "copy;", "mdash;", "ndash;", "hellip;", "rsquo;", "lsquo;")
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{1,31};?)"


_SLOTS = 4096
_LONGEST_BARE = max(len(name) for name in html5 if not name.endswith(";"))


@lru_cache(maxsize=1)
def _slots() -> str:
    """The named references of the HTML standard, filed under the checksum of their names, as one text to split."""
    slots = [""] * _SLOTS
    for name, chars in sorted(html5.items()):
        slots[crc32(name.encode()) % _SLOTS] += f"\x03{name}\x01{chars}"
    return "\x02".join(slots)


def _lookup(name: Column) -> Column:
    """Characters of a named reference, null for other names: one slot of a constant array is looked at."""
    slot = F.get(F.split(F.lit(_slots()), "\x02"), (F.crc32(name) % _SLOTS).cast("int"))
    entry = F.concat(F.lit("\x03"), name, F.lit("\x01"))
    return F.when(F.contains(slot, entry), F.substring_index(F.call_function("substring_index", slot, entry, F.lit(-1)), "\x03", 1))


def _character(code: Column) -> Column:
    """The character of a numeric reference; codes of no character as HTML reads them."""
    old = "".join(bytes([b]).decode("cp1252", "replace") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in range(128, 160))
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return (
        F.when(code.isNull() | (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), F.lit("\ufffd"))
        .when(code.between(128, 159), F.substring(F.lit(old), (code - 127).cast("int"), F.lit(1)))
        .when(code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127), F.lit(""))
        .otherwise(char)
    )


def _decoded(m: Column) -> Column:
    """One reference as text; what is none stays."""
    body = F.rtrim(F.substring(m, 3, 40), F.lit(";"))
    hexadecimal = F.lower(F.substring(body, 1, 1)) == "x"
    digits = F.ltrim(F.when(hexadecimal, F.substring(body, 2, 40)).otherwise(body), F.lit("0"))
    digits = F.when(digits == "", F.lit("0")).otherwise(digits)
    # more digits than any character has would not fit a number
    code = F.when(F.length(digits) <= 10, F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("bigint"))
    word = F.substring(m, 2, 40)
    # a name without its semicolon may be followed by more letters; those names are few and short
    begins = [
        F.concat(_lookup(F.when(F.length(word) > n, F.substring(word, 1, n))), F.substring(word, n + 1, 40)) for n in range(_LONGEST_BARE, 1, -1)
    ]
    common = reduce(lambda c, name: c.when(word == name, F.lit(html5[name])), _COMMON[1:], F.when(word == _COMMON[0], F.lit(html5[_COMMON[0]])))
    return F.when(F.substring(m, 2, 1) == "#", _character(code)).otherwise(F.coalesce(common, _lookup(word), *begins, m))


def _unescape(c: Column) -> Column:
    """Decodes decimal, hexadecimal and named character references."""
    found, pieces = F.regexp_extract_all(c, F.lit(_REFERENCE), 0), F.split(c, _REFERENCE, -1)
    decoded = F.array_append(F.transform(found, _decoded), F.lit(""))
    return F.array_join(F.zip_with(pieces, decoded, lambda p, d: F.concat(p, d)), "")


def chunk_array(html: Column) -> Column:
    """Trimmed, non-empty text chunks between tags."""
    body = F.regexp_replace(F.regexp_replace(html, _COMMENTS, ""), _BLOCKS, "")
    split = F.split(body, _TAGS, -1)
    text = lambda c: F.when(c.contains("&"), _unescape(c)).otherwise(c)
    chunks = F.when(html.contains("&"), F.transform(split, lambda c: R.trim(text(c)))).otherwise(F.transform(split, R.trim))
    return F.filter(chunks, lambda c: c != "")


def page_chunks(pages: DataFrame, keys: Sequence[str] = ("page_id",), html: str = "html") -> DataFrame:
    """Text chunks in order; the whole job stays in the JVM and needs no shuffle."""
    return pages.select(*keys, F.posexplode(chunk_array(F.col(html))).alias("chunk_ord", "text"))


def page_text(pages: DataFrame, keys: Sequence[str] = ("page_id",), html: str = "html", cap: int | None = None) -> DataFrame:
    """Chunks of a page as one text.  Built inside the row, so no ordered aggregation is needed."""
    joined = F.regexp_replace(F.array_join(chunk_array(F.col(html)), "\n"), r"\n{3,}", "\n\n")
    return pages.select(*keys, (joined if cap is None else F.substring(joined, 1, cap)).alias("text"))
