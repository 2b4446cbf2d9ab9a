"""Queries over web pages, and over derived cells, fields and siblings."""

from __future__ import annotations

from pyspark.sql import functions as F

from redactlake.functions import rules as R
from redactlake.operators import pages as P
from redactlake.operators import records as V
from redactlake.operators import redaction as X
from redactlake.plans import duck as D
from redactlake.plans import fixtures as fx
from redactlake.plans.registry import query
from redactlake.plans.tables import derive, table
from redactlake.session import checkpointed
from redactlake.sources import html as H
from redactlake.sources import resolve as pageview

_BODY = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
for _t in ("head", *H.SKIPPED):
    _BODY = f"regexp_replace({_BODY}, '(?is)<{_t}([ \\t\\r\\n/][^>]*)?>.*?</{_t}[ \\t\\r\\n]*>', '', 'g')"
_UNESC = "c"
# The references that the given pages use, the ampersand last; other forms are tested against the standard library.
_USED = {"lt": "<", "gt": ">", "quot": '"', "#39": "'", "nbsp": "\u00a0", "copy": "©", "middot": "·", "hellip": "…", "ndash": "–", "mdash": "—", "euro": "€", "amp": "&"}
for _n, _c in _USED.items():
    _UNESC = f"replace({_UNESC}, '&{_n};', {D.q(_c)})"


def _chunks_of(html: str) -> str:
    body = _BODY.replace("(html,", f"({html},", 1) if html != "html" else _BODY
    return (
        f"list_filter(list_transform(regexp_split_to_array({body}, '(?s)<[!/?A-Za-z][^>]*>'), lambda c: {D.trim(_UNESC)}), lambda c: c <> '')"
    )


_CHUNKS = f"WITH ch AS MATERIALIZED (SELECT page_id, {_chunks_of('html')} cs FROM pages), c AS MATERIALIZED (SELECT page_id, i - 1 AS chunk_ord, cs[i] AS text FROM (SELECT *, unnest(range(1, len(cs) + 1)) i FROM ch))"


def _pages(spark, folder):
    return table(spark, folder, "pages")


@query(f"{_CHUNKS} SELECT page_id, CAST(chunk_ord AS INT) AS chunk_ord, text FROM c")
def page_chunks(spark, folder):
    return H.page_chunks(_pages(spark, folder))


@query(
    f"{_CHUNKS} SELECT page_id, regexp_replace(array_to_string(cs, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g') AS text FROM ch"
)
def page_text(spark, folder):
    return H.page_text(_pages(spark, folder))


@query(
    f"""{_CHUNKS}, src AS (SELECT page_id * 1000000 + chunk_ord id, text t FROM c), {D.pattern_passes('src')}
    SELECT id // 1000000 AS page_id, CAST(id % 1000000 AS INT) AS chunk_ord, phase, pos, kind, raw, norm_key FROM ({D.entity_union()})"""
)
def page_entities(spark, folder):
    return X.find_entities(H.page_chunks(_pages(spark, folder)), ["page_id", "chunk_ord"])


@query(
    f"{_CHUNKS} SELECT page_id, count(*) AS n_texts, string_agg(text, chr(10) ORDER BY chunk_ord) AS text FROM c GROUP BY page_id"
)
def page_nodes(spark, folder):
    """Visible text nodes of the parsed tree; the check reads the same pages with patterns only."""
    nodes = P.visible(H.page_nodes(_pages(spark, folder)))
    texts = nodes.filter((F.col("node_type") == "text") & (R.trim(F.col("text")) != ""))
    piece = F.struct("node_ord", R.trim(F.col("text")).alias("t"))
    return texts.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["t"]), "\n").alias("text"),
    )


_OPEN = "regexp_replace(regexp_replace(html, '(?is)<nav([ ][^>]*)?>.*?</nav>', '', 'g'), '(?is)<a [^>]*>.*?</a>', '', 'g')"


@query(
    f"""WITH x AS (SELECT page_id, len({_chunks_of('html')}) AS n_all, len({_chunks_of(_OPEN)}) AS n_free FROM pages)
    SELECT page_id, n_all - n_free AS n_restricted, n_free FROM x"""
)
def page_restricted_texts(spark, folder):
    """Text nodes inside navigation or links versus all others."""
    nodes = P.label_restricted(P.visible(H.page_nodes(_pages(spark, folder))))
    texts = nodes.filter((F.col("node_type") == "text") & (R.trim(F.col("text")) != ""))
    return texts.groupBy("page_id").agg(
        F.count_if("restricted").alias("n_restricted"), F.count_if(~F.col("restricted")).alias("n_free")
    )


_ANY_HEAD = D.q("(?i)" + chr(92) + "b(" + P.HEADER_WORDS + ")" + chr(92) + "b")


@query(
    f"""WITH cells AS ({fx.CELLS}), r AS (SELECT table_id, row_ord, count(*) n, bool_and((tag = 'th' AND scope <> 'row') OR role = 'columnheader') ah,
      bool_or(in_thead) th, bool_and(trim(text) <> '' AND NOT regexp_matches(text, '[0-9]') AND {D.few_words(D.trim('text'))} AND NOT has_control) pl,
      count(*) FILTER (regexp_matches(text, {_ANY_HEAD})) kn, bool_or(col_span > 1 OR row_span > 1) mg,
      row_ord = min(row_ord) OVER (PARTITION BY table_id) fst FROM cells GROUP BY table_id, row_ord),
    h AS (SELECT *, th OR ah OR (fst AND n >= 2 AND pl AND kn >= 2) hd FROM r),
    a AS (SELECT *, max(CASE WHEN hd THEN row_ord END) OVER (PARTITION BY table_id ORDER BY row_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) up FROM h)
    SELECT c.table_id, c.row_ord, c.col, CASE WHEN a.hd OR c.role = 'columnheader' THEN true WHEN a.up IS NULL THEN c.tag = 'th' OR c.role IN ('columnheader', 'rowheader') ELSE false END AS is_header,
    CASE WHEN a.hd OR a.up IS NULL OR a.mg OR b.mg THEN '' ELSE coalesce(trim(k.text), '') END AS heading
    FROM cells c JOIN a ON a.table_id = c.table_id AND a.row_ord = c.row_ord LEFT JOIN h b ON b.table_id = c.table_id AND b.row_ord = a.up
    LEFT JOIN cells k ON k.table_id = c.table_id AND k.row_ord = a.up AND k.col = c.col"""
)
def table_headers(spark, folder):
    cells = derive(spark, folder, fx.CELLS)
    return P.table_headers(cells).select("table_id", "row_ord", "col", "is_header", "heading")


def _ok(c: str) -> str:
    return f"CASE WHEN {D.trim(c)} <> '' AND {D.few_words(D.trim(c))} THEN {D.trim(c)} END"


_ORDER = ("c_own", "c_wrap", "c_aria", "c_table", "c_placeholder", "c_adjacent")


@query(f"SELECT field_id, coalesce({', '.join(_ok(c) for c in _ORDER)}, 'Unlabelled field') AS label FROM ({fx.CANDIDATES})")
def field_labels(spark, folder):
    return P.pick_label(derive(spark, folder, fx.CANDIDATES), _ORDER).select("field_id", "label")


_FHINT = "(label || ' ' || name || ' ' || lower(autocomplete))"
_LOCKED = f"""(type = 'password' OR regexp_matches(lower(autocomplete), '{P.SECRET_AUTOCOMPLETE}') OR {D.has(_FHINT, '(?i)password|passwd|passcode')}
 OR {D.has(_FHINT, rf'(?i)' + chr(92) + 'b(otp|one[- ]?time (password|code)|verification code|cvv|cvc|security code)' + chr(92) + 'b')}
 OR {D.has(_FHINT, f'(?i)card{D.SP}+pin')} OR {D.has(f"regexp_replace({_FHINT}, {D.q('(?i)' + chr(92) + 'bpin' + D.SP + '*code')}, '', 'g')", '(?i)' + chr(92) + 'bpin' + chr(92) + 'b')})"""


def _fields(spark, folder):
    return derive(spark, folder, fx.FIELDS).withColumn("html_id", F.lit(""))


@query(f"SELECT field_id, {_LOCKED} AS locked FROM ({fx.FIELDS})")
def never_read(spark, folder):
    return P.never_read(_fields(spark, folder)).select("field_id", "locked")


_SECRET = "(type = 'password' OR list_has_any(string_split(lower(autocomplete), ' '), ['current-password', 'new-password', 'one-time-code']))"
_W = chr(92) + "b"
_LOGIN = D.q(f"(?i){_W}(log[-_ ]?in|sign[-_ ]?in|auth(enticate|entication)?|session|register|sign[-_ ]?up)([-_ ]?form)?{_W}")
_AHINT = "(name || ' ' || label)"
_AUTH = f"""WITH f AS (SELECT *, {_SECRET} sec FROM ({fx.FIELDS})), g AS (SELECT * FROM ({fx.FORMS}))"""


@query(
    f"""{_AUTH} SELECT field_id, regexp_matches(autocomplete, '(?i)(^|[ ])username([ ]|$)') OR {D.has(_AHINT, f'(?i){_W}(username|user[-_ ]?(name|id)|login[-_ ]?(name|id)){_W}')}
    OR (({D.has(_AHINT, '(?i)email|e-mail|phone|mobile|customer[-_ ]?id')} OR type IN ('email', 'tel')) AND bool_or(sec) OVER (PARTITION BY page_id))
    OR bool_or(sec) OVER (PARTITION BY form_id)
    OR regexp_matches(action || ' ' || g.name2 || ' ' || heading || ' ' || submit_text, {_LOGIN}) AS authentication
    FROM f JOIN (SELECT form_id, action, name AS name2, heading, submit_text FROM g) g USING (form_id)"""
)
def authentication_fields(spark, folder):
    fields = _fields(spark, folder)
    forms = derive(spark, folder, fx.FORMS)
    of_page = fields.select("page_id", "form_id").distinct()
    return P.authentication_fields(fields, forms.join(of_page, "form_id")).select("field_id", "authentication")


@query(f"{_AUTH} SELECT page_id, form_id, bool_or(sec) AS form_secret FROM f GROUP BY page_id, form_id")
def form_secrets(spark, folder):
    fields = _fields(spark, folder).withColumn("sec", P.is_secret_control())
    return fields.groupBy("page_id", "form_id").agg(F.bool_or("sec").alias("form_secret"))


_DELIM = f"{D.has(D.trim('sl'), f'[:-]{D.SP}*$')}"


@query(
    f"""WITH s AS ({fx.SIBLINGS}), t AS (SELECT page_id, parent_ord, parent_tag, node_ord, content,
      (SELECT max_by(p.content, p.sib_ord) FROM s p WHERE p.page_id = s.page_id AND p.parent_ord = s.parent_ord AND p.sib_ord < s.sib_ord AND (p.node_type = 'element' OR trim(p.content) <> '')) pre
      FROM s WHERE node_type = 'text' AND {D.trim('content')} <> ''),
    b AS (SELECT page_id, node_ord, lag(tag) OVER w bt, lag(CASE WHEN has_control THEN '' ELSE content END) OVER w bc FROM s WHERE node_type = 'element' WINDOW w AS (PARTITION BY page_id, parent_ord ORDER BY sib_ord)),
    j AS (SELECT t.page_id, t.node_ord, t.content, coalesce(pre, '') pl, coalesce(bc, '') sl, bt, t.parent_tag FROM t LEFT JOIN b ON b.page_id = t.page_id AND b.node_ord = t.parent_ord)
    SELECT page_id, node_ord, content AS text, pl AS preceding_label, sl AS sibling_label,
    {D.few_words(D.trim('sl'))} AND (coalesce(bt IN ('label', 'dt', 'th') OR (parent_tag = 'td' AND bt = 'td'), false) OR {_DELIM}) AS reads_like_label FROM j"""
)
def neighbour_labels(spark, folder):
    return P.neighbour_labels(derive(spark, folder, fx.SIBLINGS))


_TRL = f"CASE WHEN {D.few_words(D.trim('label'))} THEN {D.trim('label')} ELSE '' END"


@query(
    f"""WITH fa AS MATERIALIZED (SELECT *, {_TRL} tr, {D.trim('value')} tv, {_LOCKED} locked FROM ({fx.FIELDS})), fb AS MATERIALIZED (SELECT *, {D.label_kind('tr')} bl FROM fa),
    fc AS MATERIALIZED (SELECT *, {D.decide('tr', 'bl', 'value', 'tv', 'type')} k FROM fb),
    fd AS (SELECT *, CASE WHEN locked THEN CASE WHEN k IN ('PASSWORD', 'OTP') THEN k ELSE 'PASSWORD' END ELSE k END kind FROM fc)
    SELECT field_id, label, coalesce(kind, 'Not detected') AS kind, CASE WHEN kind IS NOT NULL THEN 'High' ELSE 'Not detected' END AS confidence,
    kind IS NOT NULL AS is_private, CASE WHEN locked THEN '[HIDDEN]' WHEN kind IS NULL THEN '' ELSE kind || '_0' END AS safe_value FROM fd"""
)
def field_summary(spark, folder):
    fields = P.never_read(_fields(spark, folder)).withColumn("authentication", F.lit(False))
    judged = P.redact_fields(fields)
    return V.field_summary(judged.withColumn("token", F.concat("kind", F.lit("_0"))))


# --- whole pages --------------------------------------------------------------
def _derived_pages(spark, folder):
    return pageview.resolved_pages(derive(spark, folder, fx.HTML_PAGES))


_K = "c_custkey"
_ONE_PAGE = {
    "page_fields": (
        (0, 21, "'Email'", fx.email(_K), "email", False, False), (0, 24, "'Mobile'", fx.phone(_K), "text", False, False),
        (1, 4, "'Email'", "''", "email", False, True), (1, 7, "'Password'", "''", "password", True, False),
        (3, 12, "'Full name'", fx.full_name(f"{_K} + 1"), "text", False, False), (3, 15, "'OTP'", "''", "text", True, False),
    ),
    # what the rules leave of each page of the four sorts, by place of the text
    "texts": {
        0: {7: "Overview", 11: "Customer name", 13: "PERSON_1", 16: "Account No", 18: "ACCOUNT_1", 20: "Email ", 23: "Mobile ", 27: "UPI ID: UPI_1"},
        1: {3: "Email ", 6: "Password ", 9: "Sign in", 11: "Name: PERSON_1", 13: "Call MOBILE_1"},
        2: {3: "Account holder", 5: "A/c no", 7: "Balance", 11: "PERSON_1", 13: "ACCOUNT_1", 15: "90.00", 17: "Hello PERSON_1"},
        3: {2: "Name:", 4: "PERSON_1", 7: "Cell phone:", 9: "MOBILE_1", 11: "Full name ", 14: "OTP ", 17: "PERSON_2 was here"},
    },
    "fields": {0: ["Email: EMAIL_1", "Mobile: MOBILE_1"], 1: ["Password: [HIDDEN]"], 2: [], 3: ["Full name: PERSON_2", "OTP: [HIDDEN]"]},
}


# the field's name is the first one's alias if they have a word in common
_SECOND = f"CASE WHEN len(list_intersect(string_split({fx.full_name(_K)}, ' '), string_split({fx.full_name(_K + ' + 1')}, ' '))) > 0 THEN 'PERSON_1' ELSE 'PERSON_2' END"


def _per_page(rows: list[str]) -> str:
    return " UNION ALL ".join(rows)


def _said(text: str) -> str:
    return f"replace({D.q(text)}, 'PERSON_2', {_SECOND})" if "PERSON_2" in text else D.q(text)


@query(
    _per_page([
        f"SELECT {_K} AS page_id, CAST({n} AS INT) AS node_ord, {_K} || ':{n}' AS field_id, {label} AS label, {value} AS value, '{kind}' AS type, {locked} AS locked,"
        f" {signs} AS authentication FROM customer WHERE {_K} % 4 = {sort}" for sort, n, label, value, kind, locked, signs in _ONE_PAGE["page_fields"]
    ])
)
def page_fields(spark, folder):
    return pageview.page_fields(_derived_pages(spark, folder))


def _whole_pages(spark, folder):
    resolved = checkpointed(_derived_pages(spark, folder))
    return P.redact_nodes(pageview.page_texts(resolved), pageview.page_fields(resolved))


@query()
def page_redacted_nodes(spark, folder):
    """Driver pages: every visible text node with its redacted text."""
    texts, _, _ = P.redact_nodes(pageview.page_texts(pageview.resolved_pages(_pages(spark, folder))))
    return texts.select("page_id", "node_ord", "redacted")


@query(
    _per_page([
        f"SELECT {_K} AS page_id, CAST({n} AS INT) AS node_ord, {_said(text)} AS redacted FROM customer WHERE {_K} % 4 = {sort}"
        for sort, texts in _ONE_PAGE["texts"].items() for n, text in texts.items()
    ])
)
def form_pages_redacted(spark, folder):
    """Derived pages with forms, tables and label pairs."""
    texts, _, _ = _whole_pages(spark, folder)
    return texts.select("page_id", "node_ord", "redacted")


@query(
    _per_page([
        f"SELECT {_K} AS page_id, concat_ws(chr(10), {', '.join(_said(t.strip()) for t in [*texts.values(), *_ONE_PAGE['fields'][sort]])}"
        + f" {', ' + D.q('free: PERSON_1 and MOBILE_') + ' || CASE WHEN ' + _K + ' % 4 IN (0, 1, 3) THEN 2 ELSE 1 END' if sort in (1, 3) else ''}) AS safe_context,"
        f" true AS is_safe FROM customer WHERE {_K} % 4 = {sort}" for sort, texts in _ONE_PAGE["texts"].items()
    ])
)
def safe_contexts(spark, folder):
    """Outgoing contexts; pages of two sorts have a further field whose value no rule knows, with a known name and a new number in it."""
    texts, fields, tokens = _whole_pages(spark, folder)
    lone = derive(spark, folder, f"SELECT {_K} AS page_id, {fx.full_name(_K)} || ' and ' || {fx.phone(_K + ' + 5')} AS value FROM customer WHERE {_K} % 4 IN (1, 3)")
    lone = lone.select(
        "page_id", F.lit(10_000).alias("node_ord"), F.lit("free").alias("field_id"), F.lit("free").alias("label"), "value", F.lit("text").alias("type"),
        F.lit(False).alias("locked"), F.lit(False).alias("authentication"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("token"),
    )
    return P.page_contexts(texts, fields.select(lone.columns).unionByName(lone), tokens)
