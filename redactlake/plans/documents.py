"""Queries over free text: entities, tokens, redaction, audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from redactlake.functions import rules as R
from redactlake.operators import leaks as L
from redactlake.operators import redaction as X
from redactlake.operators import tokens as T
from redactlake.operators.ordered import LOAD
from redactlake.plans import duck as D
from redactlake.plans import fixtures as fx
from redactlake.plans.registry import query
from redactlake.plans.tables import derive, table
from redactlake.session import checkpointed

_DOCS = "WITH src AS (SELECT doc_id id, text t FROM documents),"
_NUMBERED = _DOCS + D.pattern_passes("src")
_KIND_ONLY = _DOCS + D.pattern_passes("src", "kind_only")
_ENTITIES = D.entity_union()


def _docs(spark, folder):
    return table(spark, folder, "documents")


@query(f"{_NUMBERED} SELECT id AS doc_id, phase, pos, kind, raw, norm_key FROM ({_ENTITIES})")
def doc_entities(spark, folder):
    return X.find_entities(_docs(spark, folder), ["doc_id"])


@query(
    f"""{_NUMBERED} SELECT lang, kind, CAST(count(*) AS BIGINT) AS mentions,
    count(DISTINCT (id, norm_key)) AS distinct_values FROM ({_ENTITIES}) e JOIN documents d ON d.doc_id = e.id GROUP BY lang, kind"""
)
def doc_entity_counts(spark, folder):
    found = X.find_entities(_docs(spark, folder), ["doc_id", "lang"])
    return T.entity_counts(found, ["lang", "kind"], ["doc_id"])


@query(f"{_NUMBERED} SELECT id AS doc_id, t AS redacted FROM t_DOB")
def doc_redacted_numbered(spark, folder):
    return X.redact_rows(_docs(spark, folder)).select("doc_id", "redacted")


@query(f"{_KIND_ONLY} SELECT id AS doc_id, t AS redacted FROM t_DOB")
def doc_redacted_kind_only(spark, folder):
    return X.redact_rows(_docs(spark, folder), style="kind_only").select("doc_id", "redacted")


@query(
    f"""{_NUMBERED} SELECT id AS doc_id, kind, norm_key, kind || '_' || translate(substr(sha256('demo:' || kind || ':' || norm_key), 1, 32),
    '0123456789abcdef', 'ghijklmnopqrstuv') AS token, count(*) AS mentions FROM ({_ENTITIES}) GROUP BY id, kind, norm_key"""
)
def doc_hash_tokens(spark, folder):
    rows = X.redact_rows(_docs(spark, folder).select("doc_id", "text"), style="hash", salt="demo", own_names=False)
    found = rows.select("doc_id", F.inline_outer("entities")).filter(F.col("kind").isNotNull())
    return found.groupBy("doc_id", "kind", "norm_key", "token").agg(F.count(F.lit(1)).alias("mentions"))


def _numbers(scope: str) -> str:
    part = f"{scope}, kind" if scope else "kind"
    cols = f"{scope}, " if scope else ""
    return f"""SELECT {cols}kind, norm_key, n, kind || '_' || n AS token, mentions FROM (
      SELECT {cols}kind, norm_key, row_number() OVER (PARTITION BY {part} ORDER BY min((item_ord, phase, pos))) n, count(*) mentions
      FROM e GROUP BY {cols}kind, norm_key)"""


@query(f"{_NUMBERED}, e AS (SELECT id AS doc_id, id AS item_ord, * FROM ({_ENTITIES})) {_numbers('doc_id')}")
def doc_tokens(spark, folder):
    found = X.find_entities(_docs(spark, folder), ["doc_id"]).withColumn("item_ord", F.col("doc_id"))
    tokens = T.assign_tokens(found, ["doc_id"], aliases=False)
    return tokens.select("doc_id", "kind", "norm_key", "n", "token", "mentions")


@query(f"{_NUMBERED}, e AS (SELECT id AS item_ord, * FROM ({_ENTITIES})) {_numbers('')}")
def corpus_tokens(spark, folder):
    found = X.find_entities(_docs(spark, folder), ["doc_id"]).withColumnRenamed("doc_id", "item_ord")
    tokens = T.assign_tokens(found, [], aliases=False, radix=LOAD)  # one scope for all; ids may lie anywhere
    return tokens.select("kind", "norm_key", "n", "token", "mentions")


# Outgoing texts of which some are not what they should be: every fourth document goes out as it is.
_OUT = "CASE WHEN d.doc_id % 4 = 0 THEN d.text ELSE r.t END"


def _outgoing(spark, folder):
    rows = X.redact_rows(_docs(spark, folder)).select("doc_id", "text", "redacted", "entities")
    return rows.withColumn("sent", F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(F.col("redacted")))


@query(
    f"""{_NUMBERED} SELECT count(*) AS items, count(*) FILTER (d.doc_id % 4 = 0 AND d.text <> r.t) AS unsafe,
    list_sort(list(d.doc_id) FILTER (d.doc_id % 4 = 0 AND d.text <> r.t)) AS blocked FROM documents d JOIN t_DOB r ON r.id = d.doc_id"""
)
def doc_leak_audit(spark, folder):
    """Redacting a redacted text again changes nothing; what still holds a detail is blocked."""
    audited = X.leak_audit(_outgoing(spark, folder).select("doc_id", "sent"), "sent")
    unsafe = ~F.col("is_safe")
    return audited.agg(
        F.count(F.lit(1)).alias("items"), F.count_if(unsafe).alias("unsafe"), F.sort_array(F.collect_list(F.when(unsafe, F.col("doc_id")))).alias("blocked")
    )


@query(
    f"""{_NUMBERED}, v AS (SELECT id, kind, norm_key, arg_max(trim(raw), (phase, pos)) m FROM ({_ENTITIES}) GROUP BY id, kind, norm_key)
    SELECT DISTINCT d.doc_id, v.m AS value FROM documents d JOIN t_DOB r ON r.id = d.doc_id JOIN v ON v.id = d.doc_id
    WHERE length(v.m) >= 3 AND contains({_OUT}, v.m)"""
)
def doc_known_value_leaks(spark, folder):
    """Stored values of a document that its outgoing text still contains."""
    items = checkpointed(_outgoing(spark, folder).select("doc_id", "sent", "entities"))  # read for values, pieces and texts
    found = items.select("doc_id", F.col("doc_id").alias("item_ord"), F.inline_outer("entities")).filter("kind IS NOT NULL").drop("token")
    tokens = T.assign_tokens(found, ["doc_id"], aliases=False)
    return L.known_value_leaks(items.select("doc_id", "sent"), tokens, ["doc_id"], [], "sent").select("doc_id", "value")


@query(f"{_NUMBERED} SELECT d.doc_id, CASE WHEN d.doc_id % 5 = 0 AND d.text <> r.t THEN r.t || ' edited' ELSE d.text END AS restored FROM documents d JOIN t_DOB r ON r.id = d.doc_id")
def doc_restore_roundtrip(spark, folder):
    """Vault of the changed documents, then restore: gives the original texts, but for those that someone edited since."""
    rows = X.redact_rows(_docs(spark, folder)).select("doc_id", "text", "redacted")
    vault = rows.filter(F.col("redacted") != F.col("text")).select(
        "doc_id", F.col("text").alias("original"), F.col("redacted").alias("shown")
    )
    edited = (F.col("doc_id") % 5 == 0) & (F.col("redacted") != F.col("text"))
    now = rows.select("doc_id", F.when(edited, F.concat("redacted", F.lit(" edited"))).otherwise(F.col("redacted")).alias("redacted"))
    return T.restore(now, vault, ["doc_id"]).select("doc_id", "restored")


# --- line rules on derived texts ---------------------------------------------
_INLINE = rf"^({D.SP}*.*?)([:-]{D.SP}*|{D.SP}+)([0-9](?:[ \t-]*[0-9]){{8,17}})({D.SP}*)$"
_LABEL = rf"^{D.SP}*([\p{{L}}\p{{N}}][\p{{L}}\p{{N}} /#&.'’-]{{0,58}}?){D.SP}*[:-]{D.SP}*(.*?){D.SP}*$"
_CAP = r"\p{Lu}[\p{L}'’-]{2,}"
_GREET = rf"\b(hello|hi|welcome|namaste)({D.SP}*,?{D.SP}+)({_CAP}(?:{D.SP}+{_CAP}){{0,2}})"


def _sec_account(label: str, value: str) -> str:
    """Is this label and value an account number?"""
    t = f"(CASE WHEN {D.few_words(D.trim(label))} THEN {D.trim(label)} ELSE '' END)"
    return (
        f"(NOT {D.secret(t)} AND NOT {D.has(t, D.AMOUNT)} AND coalesce({D.label_kind(t)}, '') = 'ACCOUNT'"
        f" AND {D.valid('ACCOUNT', D.trim(value))})"
    )


def line_phases(source: str, placed: bool = False) -> str:
    """CTEs for account lines, label lines and greetings over (id, t); tokens are KIND_0, if ``placed`` each with its spot."""
    spot = lambda phase, i: f" || {D.spot(phase, i)}" if placed else ""
    bare = f"regexp_replace(v, '{D.ANY_SPOT}', '', 'g')" if placed else "v"
    g = lambda i: f"regexp_extract(x, {D.q(_INLINE)}, {i})"
    la = lambda i: D.trim(f"regexp_extract(x, {D.q(_LABEL)}, {i})")
    common = ", ".join(f"'{w}'" for w in R.COMMON_WORDS)
    return f"""
l0 AS MATERIALIZED (SELECT id, i, ls[i] x FROM (SELECT id, ls, unnest(range(1, len(ls) + 1)) i FROM (SELECT id, string_split(t, chr(10)) ls FROM {source}))),
l1 AS MATERIALIZED (SELECT *, {D.has('x', _INLINE)} AND {_sec_account(g(1), g(3))} fired FROM l0),
l2 AS MATERIALIZED (SELECT *, CASE WHEN fired THEN false ELSE coalesce(NOT lag(fired) OVER w AND {_sec_account('coalesce(lag(x) OVER w, chr(0))', 'x')}, false) END paired
  FROM l1 WINDOW w AS (PARTITION BY id ORDER BY i)),
ea AS MATERIALIZED (SELECT id, i, 'ACCOUNT' kind, CASE WHEN fired THEN {g(3)} ELSE {D.trim('x')} END raw FROM l2 WHERE fired OR paired),
l3 AS MATERIALIZED (SELECT id, i, CASE WHEN fired THEN {g(1)} || {g(2)} || 'ACCOUNT_0'{spot(1, 'i')} || {g(4)}
  WHEN paired THEN replace(x, {D.trim('x')}, 'ACCOUNT_0'{spot(1, 'i')}) ELSE x END x FROM l2),
b1 AS MATERIALIZED (SELECT id, i, x, {la(1)} label, {la(2)} own, {D.trim("coalesce(lead(x) OVER (PARTITION BY id ORDER BY i), '')")} below, {D.has('x', _LABEL)} is_label FROM l3),
b2 AS MATERIALIZED (SELECT *, CASE WHEN own <> '' THEN own ELSE below END v, {D.label_kind('label')} bl FROM b1),
b3 AS MATERIALIZED (SELECT *, CASE WHEN is_label AND {D.few_words('label')} AND NOT {D.prompt_like('v')}
  AND NOT {D.has(bare, f'(?i)^[A-Z]+_[0-9]+({D.SP}+[A-Z]+_[0-9]+)*$')} THEN {D.decide('label', 'bl', 'v', 'v', "''")} END kind FROM b2),
b4 AS MATERIALIZED (SELECT *, kind IS NOT NULL AND own = '' takes FROM b3),
b5 AS MATERIALIZED (SELECT *, sum(CASE WHEN takes THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) run FROM b4),
b6 AS MATERIALIZED (SELECT *, coalesce(lag(takes) OVER w AND (count(*) FILTER (takes) OVER (PARTITION BY id, coalesce(run, 0) ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) % 2 = 1, false) taken
  FROM b5 WINDOW w AS (PARTITION BY id ORDER BY i)),
eb AS MATERIALIZED (SELECT id, i, kind, v raw FROM b6 WHERE kind IS NOT NULL AND NOT taken),
b7 AS MATERIALIZED (SELECT id, i, CASE WHEN taken THEN CASE WHEN lag(kind) OVER w IN ('PASSWORD', 'OTP') THEN '[HIDDEN]' ELSE lag(kind) OVER w || '_0'{spot(2, 'lag(i) OVER w')} END
  WHEN kind IS NOT NULL AND own <> '' THEN regexp_extract(x, '^[^:-]*[:-]', 0) || ' ' || CASE WHEN kind IN ('PASSWORD', 'OTP') THEN '[HIDDEN]' ELSE kind || '_0'{spot(2, 'i')} END
  ELSE x END x FROM b6 WINDOW w AS (PARTITION BY id ORDER BY i)),
tb AS MATERIALIZED (SELECT id, string_agg(x, chr(10) ORDER BY i) t FROM b7 GROUP BY id),
g1 AS MATERIALIZED (SELECT id, t, regexp_split_to_array(t, {D.q(_GREET)}) ps, regexp_extract_all(t, {D.q(_GREET)}) ms FROM tb),
g2 AS MATERIALIZED (SELECT id, i, ps[i] piece, ms[i] m, regexp_extract(ms[i], {D.q(_GREET)}, 1) || regexp_extract(ms[i], {D.q(_GREET)}, 2) pre,
  regexp_extract(ms[i], {D.q(_GREET)}, 3) nm FROM (SELECT *, unnest(range(1, len(ps) + 1)) i FROM g1)),
eg AS MATERIALIZED (SELECT id, i, 'PERSON' kind, nm raw FROM g2 WHERE m IS NOT NULL
  AND len(list_filter(string_split_regex(nm, {D.q(D.SP + '+')}), lambda w: lower(w) NOT IN ({common}))) > 0),
tg AS MATERIALIZED (SELECT g.id, string_agg(piece || CASE WHEN e.raw IS NOT NULL THEN pre || 'PERSON_0'{spot(3, 'g.i')} ELSE coalesce(m, '') END, '' ORDER BY g.i) t
  FROM g2 g LEFT JOIN eg e ON e.id = g.id AND e.i = g.i GROUP BY g.id)"""


_LINES = f"WITH src AS (SELECT item id, text t FROM ({fx.TEXT_LINES})),{line_phases('src')}"
_POS = "CAST(row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS INT) pos"


def _line_texts(spark, folder):
    return derive(spark, folder, fx.TEXT_LINES)


def _phase_rows(cte: str, phase: int) -> str:
    keep = "" if phase != 2 else " WHERE kind NOT IN ('PASSWORD', 'OTP')"
    return f"SELECT id item, {phase} phase, {_POS}, kind, raw, {D.norm_key('kind', 'raw')} norm_key FROM {cte}{keep}"


@query(f"{_LINES} {_phase_rows('ea', 1)}")
def account_lines(spark, folder):
    return X.find_entities(_line_texts(spark, folder), ["item"], phases=(1,))


@query(f"{_LINES} {_phase_rows('eb', 2)}")
def label_lines(spark, folder):
    return X.find_entities(_line_texts(spark, folder), ["item"], phases=(1, 2)).filter("phase = 2")


@query(f"{_LINES} {_phase_rows('eg', 3)}")
def greetings(spark, folder):
    return X.find_entities(_line_texts(spark, folder), ["item"], phases=(1, 2, 3)).filter("phase = 3")


@query(f"{_LINES},{D.pattern_passes('tg', 'kind_only')} SELECT id AS item, t AS redacted FROM t_DOB")
def text_redacted(spark, folder):
    """All phases on derived texts; every token reads KIND_0."""
    rows = X.redact_rows(_line_texts(spark, folder), style="kind_only", own_names=False)
    return rows.select("item", "redacted")


@query(
    f"""{_LINES},{D.pattern_passes('tg', 'kind_only')}, al AS ({' UNION ALL '.join([_phase_rows('ea', 1), _phase_rows('eb', 2), _phase_rows('eg', 3),
    'SELECT id item, phase, pos, kind, raw, norm_key FROM (' + _ENTITIES + ')'])}) SELECT * FROM al"""
)
def text_entities(spark, folder):
    return X.find_entities(_line_texts(spark, folder), ["item"], style="kind_only")
