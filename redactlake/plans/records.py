"""Queries over registrations, requests, origins and recognised lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from redactlake.functions import rules as R
from redactlake.operators import records as V
from redactlake.operators import tokens as T
from redactlake.plans import duck as D
from redactlake.plans import fixtures as fx
from redactlake.plans.registry import query
from redactlake.plans.tables import derive, table

_ANSWERS = ", ".join(f"{D.trim(f'coalesce({c}, {D.q(str())})')} AS {c}" for c in V.ANSWER_COLUMNS)
_CLEAN = f"""SELECT id, lower({D.trim('email')}) AS email, password, {D.trim('name')} AS name, age,
 regexp_replace(bank_account_number, '[ \t-]', '', 'g') AS bank_account_number, {_ANSWERS} FROM ({fx.REGISTRATIONS})"""
_BAD = {
    "email": f"NOT {D.has('email', f'^[^{D.SP_IN}@]+@[^{D.SP_IN}@]+[.][^{D.SP_IN}@]+$')}",
    "password": "NOT length(password) BETWEEN 8 AND 72",
    "name": "NOT length(name) BETWEEN 2 AND 80",
    "age": "age IS NULL OR NOT age BETWEEN 16 AND 100",
    "account": f"NOT {D.has('bank_account_number', '^[0-9]{6,18}$')}",
    "answers": "length(hire_reason) > 500 OR length(strongest_skills) > 500 OR length(challenge_solved) > 500",
}
_FAILED = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _BAD.items()) + "], lambda x: x IS NOT NULL)"


def _registrations(spark, folder):
    return derive(spark, folder, fx.REGISTRATIONS)


@query(f"SELECT id, array_to_string(f, ',') AS failed, f[1] AS first_failure FROM (SELECT *, {_FAILED} f FROM ({_CLEAN}))")
def validate_records(spark, folder):
    checked = V.validate_records(_registrations(spark, folder))
    return checked.select("id", F.array_join("failed", ",").alias("failed"), "first_failure")


@query(
    f"""WITH r AS (SELECT * FROM ({_CLEAN})), old AS (SELECT DISTINCT email FROM r WHERE id % 10 = 3)
    SELECT email AS email_key, min(id) AS id FROM r WHERE id % 10 <> 3 AND email NOT IN (SELECT email FROM old) GROUP BY email"""
)
def reject_duplicates(spark, folder):
    """Registrations ending in 3 are already stored, the others arrive now."""
    rows = _registrations(spark, folder)
    kept = V.reject_duplicates(rows.filter("id % 10 <> 3").select("id", "email"), rows.filter("id % 10 = 3"), "id")
    return kept.select("email_key", "id")


@query(
    f"""SELECT id, name, age, bank_account_number, coalesce(hire_reason, '') AS hire_reason,
    coalesce(strongest_skills, '') AS strongest_skills, coalesce(challenge_solved, '') AS challenge_solved FROM ({fx.REGISTRATIONS})"""
)
def public_projection(spark, folder):
    return V.public_projection(_registrations(spark, folder), ["id"])


_B = f"({D.trim('context')} || chr(10) || {D.trim('question')})"
_GATE = f"""CASE WHEN {D.trim('context')} = '' OR {D.trim('question')} = '' THEN 'blank'
 WHEN length({D.trim('context')}) > 20000 OR length({D.trim('question')}) > 1000 THEN 'oversized'
 WHEN {D.has(_B, rf'\b[^{D.SP_IN}@]+@[^{D.SP_IN}@]+\.[^{D.SP_IN}@]+\b')} THEN 'email'
 WHEN {D.has(_B, r'\b[0-9]{8,24}\b')} THEN 'digits'
 WHEN {D.has(_B, rf'\+?[0-9][0-9{D.SP_IN}().-]{{6,}}[0-9]')} THEN 'phone' END"""


@query(f"SELECT conv_id, turn, reason, reason IS NULL AS accepted FROM (SELECT *, {_GATE} AS reason FROM ({fx.REQUESTS}))")
def raw_pii_gate(spark, folder):
    gated = V.raw_pii_gate(derive(spark, folder, fx.REQUESTS))
    return gated.select("conv_id", "turn", "reason", "accepted")


@query(
    f"""SELECT conv_id, turn, type, field_id, {D.trim('value')} AS value FROM ({fx.ACTIONS}) WHERE type = 'fill_field'
    AND field_id IN ('hireReason', 'strongestSkills', 'challengeSolved') AND length({D.trim('value')}) > 0 AND length(value) <= 500"""
)
def valid_actions(spark, folder):
    return V.valid_actions(derive(spark, folder, fx.ACTIONS))


_AUTHORITY = "regexp_replace(lower(regexp_extract(url, '(?i)^https?://([^/?#]*)', 1)), '^.*@', '')"
_ORIGIN = f"""CASE WHEN regexp_matches(url, '(?i)^https?://[^/?#]+') THEN CASE WHEN url ILIKE 'https%' THEN 'https://' || regexp_replace({_AUTHORITY}, ':(443)?$', '')
 ELSE 'http://' || regexp_replace({_AUTHORITY}, ':(80)?$', '') END ELSE '' END"""


@query(
    f"""WITH p AS (SELECT page_id, url, {_ORIGIN} AS origin FROM pages), g AS (SELECT DISTINCT origin FROM p WHERE page_id % 3 = 0)
    SELECT page_id, url, origin FROM p WHERE origin <> '' AND origin IN (SELECT origin FROM g)"""
)
def eligible_pages(spark, folder):
    """Access was granted to the origins of every third page."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    grants = pages.filter("page_id % 3 = 0").select(V.origin("url").alias("origin"))
    return V.eligible_pages(pages, grants)


_TR = lambda c: f"CASE WHEN {D.few_words(D.trim(c))} THEN {D.trim(c)} ELSE '' END"
_OCR = f"""WITH o AS (SELECT *, CASE WHEN contains(raw, ':') THEN split_part(raw, ':', 1) ELSE raw END lab,
  CASE WHEN contains(raw, ':') THEN {D.trim("substr(raw, strpos(raw, ':') + 1)")} ELSE raw END val FROM ({fx.OCR_LINES})),
 o1 AS MATERIALIZED (SELECT *, {_TR('lab')} tr, {D.trim('val')} tv, {D.trim('raw')} rv FROM o),
 o2 AS MATERIALIZED (SELECT *, {D.label_kind('tr')} bl FROM o1),
 o3 AS MATERIALIZED (SELECT *, coalesce({D.decide('tr', 'bl', 'val', 'tv', "''")}, {D.decide("''", 'NULL', 'raw', 'rv', "''")}) kind FROM o2)"""


def _ocr(spark, folder):
    lines = derive(spark, folder, fx.OCR_LINES)
    return lines.select("image_id", "line_ord", "raw", F.struct("x", "y", "width", "height").alias("bbox"))


@query(
    f"{_OCR} SELECT image_id, line_ord, raw, kind, x * 2 AS x, y * 2 AS y, width * 2 AS width, height * 2 AS height FROM o3 WHERE kind IS NOT NULL"
)
def ocr_candidates(spark, folder):
    return V.ocr_candidates(_ocr(spark, folder), 2.0)


_SHEET = "(image_id - image_id % 20)"
_COMMON = ", ".join(D.q(w) for w in R.COMMON_WORDS)
# people of a sheet folded in order: which earlier person a line's name stands for
_VISUAL = f"""{_OCR.replace("WITH", "WITH RECURSIVE", 1)}, f AS MATERIALIZED (SELECT {_SHEET} sheet, image_id, line_ord, kind, {D.norm_key('kind', 'raw')} k, x, y FROM o3 WHERE kind IS NOT NULL),
 pm AS MATERIALIZED (SELECT sheet, k, row_number() OVER (PARTITION BY sheet ORDER BY image_id, line_ord) s, string_split_regex(k, {D.q(D.SP + '+')}) ws,
  list_distinct(list_filter(list_transform(regexp_extract_all(k, {D.q(chr(92) + "p{L}[" + chr(92) + "p{L}" + "'’-]*")}), lambda p: lower(p)), lambda p: length(p) >= 3 AND p NOT IN ({_COMMON}))) ps
  FROM f WHERE kind = 'PERSON'),
 fold AS (SELECT sheet, CAST(0 AS BIGINT) s, CAST('' AS VARCHAR) k, CAST('' AS VARCHAR) leader, CAST(MAP {{}} AS MAP(VARCHAR, VARCHAR)) names, CAST(MAP {{}} AS MAP(VARCHAR, VARCHAR)) parts
    FROM (SELECT DISTINCT sheet FROM pm)
  UNION ALL SELECT sheet, s, k, lead, map_concat(names, MAP {{k: lead}}), map_concat(parts, map_from_entries(list_transform(ps, lambda p: {{'k': p, 'v': lead}})))
  FROM (SELECT sheet, s, k, ps, names, parts, CASE WHEN names[k] IS NOT NULL THEN names[k] WHEN len(known) = 1 THEN known[1] ELSE k END lead
    FROM (SELECT m.*, names, parts, list_distinct(list_filter(list_transform(ws, lambda w: parts[w]), lambda x: x IS NOT NULL)) known FROM fold o JOIN pm m ON m.sheet = o.sheet AND m.s = o.s + 1))),
 c AS MATERIALIZED (SELECT f.sheet, image_id, line_ord, kind, coalesce(l.leader, f.k) k, x, y FROM f LEFT JOIN (SELECT DISTINCT sheet, k, leader FROM fold WHERE s > 0) l
  ON kind = 'PERSON' AND l.sheet = f.sheet AND l.k = f.k)"""


@query(
    f"""{_VISUAL},
    old AS (SELECT sheet, kind, k, row_number() OVER (PARTITION BY sheet, kind ORDER BY min((image_id, line_ord))) n FROM c WHERE image_id % 20 < 10 GROUP BY sheet, kind, k),
    new AS (SELECT sheet, kind, k, coalesce((SELECT max(n) FROM old o WHERE o.sheet = c.sheet AND o.kind = c.kind), 0)
      + row_number() OVER (PARTITION BY sheet, kind ORDER BY min((image_id, line_ord))) n
      FROM c WHERE image_id % 20 >= 10 AND NOT EXISTS (FROM old o WHERE o.sheet = c.sheet AND o.kind = c.kind AND o.k = c.k) GROUP BY sheet, kind, k)
    SELECT c.sheet, image_id, line_ord, kind, kind || '_' || n AS token, x, y FROM c JOIN (FROM old UNION ALL FROM new) USING (sheet, kind, k) WHERE image_id % 20 >= 10"""
)
def register_visual(spark, folder):
    """Recognised lines of a sheet's later pictures share the token map that its earlier ones made; their text is dropped."""
    found = V.ocr_candidates(_ocr(spark, folder)).withColumn("sheet", F.col("image_id") - F.col("image_id") % 20)
    early = V.with_norm_key(found.filter("image_id % 20 < 10")).select(
        "sheet", F.col("image_id").alias("item_ord"), F.lit(0).alias("phase"), F.col("line_ord").alias("pos"), "kind", "raw", "norm_key"
    )
    tokens = T.assign_tokens(early, ["sheet"])
    named, _ = V.register_visual(found.filter("image_id % 20 >= 10"), tokens, ["sheet"])
    return named.select("sheet", "image_id", "line_ord", "kind", "token", "x", "y")
