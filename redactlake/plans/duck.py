"""SQL building blocks for checking the jobs with DuckDB.

The check is formulated independently of the Spark jobs: matches are unnested
into rows, numbered with windows and put together again with ordered string
aggregation.  RE2 has no look-around, so digit runs are marked with control
characters and patterns match against the marks.
"""

from __future__ import annotations

import re

SP = r"[ \t\n\r\f\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
SP_IN = SP[1:-1]


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(value: str, pattern: str) -> str:
    return f"regexp_matches({value}, {q(pattern)})"


def trim(v: str) -> str:
    return f"regexp_replace(regexp_replace({v}, {q('^' + SP + '+')}, ''), {q(SP + '+$')}, '')"


def digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '', 'g')"


def luhn(v: str) -> str:
    d = digits(v)
    return (
        f"(length({d}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(0, length({d})), "
        f"lambda i: CASE WHEN i % 2 = 1 THEN (CAST(substr({d}, length({d}) - i, 1) AS INT) * 2) // 10"
        f" + (CAST(substr({d}, length({d}) - i, 1) AS INT) * 2) % 10"
        f" ELSE CAST(substr({d}, length({d}) - i, 1) AS INT) END)) % 10 = 0)"
    )


def verhoeff(v: str) -> str:
    """Same checksum by group arithmetic instead of lookup in a product table."""
    d = digits(v)
    perm = "[" + ", ".join(
        "[" + ", ".join(str(x) for x in row) + "]" for row in _powers([1, 5, 7, 6, 2, 8, 3, 0, 9, 4])
    ) + "]"
    p = f"{perm}[i % 8 + 1][CAST(substr({d}, length({d}) - i, 1) AS INT) + 1]"
    # state c and permuted digit x multiply in the symmetry group of the pentagon
    mapped = f"list_transform(range(0, length({d})), lambda i: CAST({p} AS BIGINT))"
    product = (
        "CASE WHEN c < 5 AND x < 5 THEN (c + x) % 5 WHEN c < 5 THEN (c + x - 5) % 5 + 5 "
        "WHEN x < 5 THEN (c - 5 - x + 5) % 5 + 5 ELSE (c - x + 5) % 5 END"
    )
    return f"(list_reduce({mapped}, lambda c, x: CAST({product} AS BIGINT), CAST(0 AS BIGINT)) = 0)"


def _powers(base: list[int]) -> list[list[int]]:
    rows = [list(range(10))]
    while len(rows) < 8:
        rows.append([base[x] for x in rows[-1]])
    return rows


def valid(kind: str, v: str) -> str:
    """Validity of a trimmed value that is not prompt-like."""
    return {
        "MOBILE": has(f"regexp_replace({v}, {q('[' + SP_IN + '().-]')}, '', 'g')", r"^(\+?91|0)?[6-9][0-9]{9}$"),
        "AADHAAR": f"({has(v, '^([2-9][0-9]{11}|[2-9][0-9]{3}[ -][0-9]{4}[ -][0-9]{4})$')} AND {verhoeff(v)})",
        "PAN": has(v, "(?i)^[a-z]{5}[0-9]{4}[a-z]$"),
        "IFSC": has(v, "(?i)^[a-z]{4}0[a-z0-9]{6}$"),
        "EMAIL": has(v, r"(?i)^[a-z0-9._%+-]+@([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}$"),
        "UPI": has(v, r"(?i)^[a-z0-9._-]{2,}@[a-z][a-z0-9.-]+$"),
        "DOB": f"({has(v, '^[0-9]{1,2}[/-][0-9]{1,2}[/-](19|20)[0-9]{2}$')}"
        f" AND try_strptime(replace({v}, '-', '/'), '%d/%m/%Y') IS NOT NULL)",
        "PIN": has(v, "^[0-9]{6}$"),
        "CARD": f"({has(v, '^([0-9][ -]?){13,19}$')} AND {luhn(v)})",
        "ACCOUNT": has(f"regexp_replace({v}, '[ -]', '', 'g')", "^[0-9]{9,18}$"),
        "PERSON": "true",
        "ADDRESS": "true",
    }[kind]


CASCADE = ("MOBILE", "AADHAAR", "PAN", "IFSC", "EMAIL", "UPI", "DOB", "PIN", "CARD")


def prompt_like(v: str) -> str:
    return f"({v} = '' OR {has(v, f'(?i)^(add|enter|type|your|please enter|e[.]g[.]?)[{SP_IN}A-Za-z0-9_' + chr(39) + '-]*$')})"


def cascade(v: str) -> str:
    arms = " ".join(f"WHEN {valid(k, v)} THEN '{k}'" for k in CASCADE)
    return f"CASE WHEN {prompt_like(v)} THEN NULL {arms} END"


def few_words(trimmed: str) -> str:
    return f"(NOT {has(trimmed, f'^([^{SP_IN}]+{SP}+){{5}}[^{SP_IN}]')})"


def label_kind(t: str) -> str:
    words = {
        "PERSON": r"\b(account holder|name)\b",
        "MOBILE": r"\b(mobile|phone|telephone|contact|cell)\b",
        "EMAIL": rf"\b(e-?mail|mail{SP}*id)\b",
        "AADHAAR": r"\b(aadhaar|aadhar|uid)\b",
        "PAN": r"\bpan\b",
        "IFSC": r"\bifsc\b",
        "UPI": r"\b(upi|vpa)\b",
        "DOB": r"\b(dob|date of birth|birth date)\b",
        "PIN": rf"\b(pin|postal|zip){SP}*code\b",
        "ADDRESS": r"\b(address|city)\b",
        "CARD": rf"\b(card{SP}*(number|no|#\b|no\.\b)|debit card|credit card)\b",
        "ACCOUNT": rf"\b(account{SP}*(number|no|a/c)|a/c|iban)\b|\baccount{SP}*(no\.|#)\b"
        rf"|^((savings?|current|salary|bank|sb){SP}+)?(account|a{SP}*/{SP}*c|acct?\.?|iban)"
        rf"({SP}*(number|no\.?|#))?{SP}*[:-]?{SP}*$",
    }
    arms = " ".join(f"WHEN {has(t, '(?i)' + w)} THEN '{k}'" for k, w in words.items())
    return f"CASE {arms} END"


def secret(hint: str) -> str:
    plain = (
        r"(?i)\b(password|passwd|passcode|otp|cvv|cvc|security code|one[- ]?time code|verification code"
        rf"|card{SP}+pin)\b"
    )
    left = f"regexp_replace({hint}, {q(rf'(?i)' + chr(92) + 'bpin' + SP + '*code')}, '', 'g')"
    return f"({has(hint, plain)} OR {has(left, r'(?i)' + chr(92) + 'bpin' + chr(92) + 'b')})"


AMOUNT = "(?i)order|transaction|invoice|reference|tracking|receipt|price|amount"


def decide(trusted: str, by_label: str, value: str, trimmed: str, type_: str) -> str:
    hint = f"({trusted} || ' ' || {type_})"
    arms = " ".join(
        f"WHEN '{k}' THEN {valid(k, trimmed)}" for k in CASCADE + ("ACCOUNT", "PERSON", "ADDRESS")
    )
    return f"""CASE
      WHEN lower({type_}) = 'password' OR {secret(hint)}
        THEN CASE WHEN {has(hint, '(?i)otp|one[- ]?time|verification code')} THEN 'OTP' ELSE 'PASSWORD' END
      WHEN {has(hint, AMOUNT)} OR {has(value, '(?i)₹|' + chr(92) + 'bINR' + chr(92) + 'b')} THEN NULL
      WHEN {by_label} IS NOT NULL
        THEN CASE WHEN NOT {prompt_like(trimmed)} AND CASE {by_label} {arms} END THEN {by_label} END
      ELSE {cascade(trimmed)} END"""


def norm_key(kind: str, raw: str) -> str:
    return (
        f"CASE WHEN {kind} IN ('MOBILE', 'AADHAAR', 'CARD', 'ACCOUNT', 'PIN') THEN {digits(raw)}"
        f" ELSE lower({trim(raw)}) END"
    )


# --- text patterns ----------------------------------------------------------
_SEP = "[" + SP_IN + r"().\x01\x02\x03-]"
SHAPES = {
    "MOBILE": (True, rf"\+?\x01(?:91{_SEP}*|0{_SEP}*)?[6-9](?:{_SEP}*[0-9]){{9}}\x02"),
    "EMAIL": (False, r"(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b"),
    "PAN": (False, r"(?i)\b[a-z]{5}[0-9]{4}[a-z]\b"),
    "AADHAAR": (
        True,
        r"\x01[2-9][0-9]{3}(?:\x02\x03[ -]\x01)?[0-9]{4}(?:\x02\x03[ -]\x01)?[0-9]{4}\x02",
    ),
    "IFSC": (False, r"(?i)\b[a-z]{4}0[a-z0-9]{6}\b"),
    "UPI": (False, r"(?i)\b[a-z0-9._-]{2,}@[a-z][a-z0-9.-]+\b"),
    "CARD": (True, r"\x01(?:[0-9](?:\x02\x03[ -]\x01)?){12,18}[0-9]\x02[ -]?"),
    "DOB": (False, r"\b(?:0?[1-9]|[12][0-9]|3[01])[/-](?:0?[1-9]|1[0-2])[/-](?:19|20)[0-9]{2}\b"),
}
TEXT_KINDS = tuple(SHAPES)


def _unmark(v: str) -> str:
    return f"replace(replace(replace({v}, chr(1), ''), chr(2), ''), chr(3), '')"


def _mark(v: str) -> str:
    """Mark digit runs with 1 and 2, and a separator right before a run with 3."""
    runs = f"regexp_replace({v}, '([0-9]+)', chr(1) || '\\1' || chr(2), 'g')"
    return f"regexp_replace({runs}, '([ -])\\x01', chr(3) || '\\1' || chr(1), 'g')"


def spot(phase: int, i: str) -> str:
    """A private character that tells one token of an item from all others, for texts whose tokens are numbered later."""
    return f"chr(CAST(57344 + {400 * phase} + {i} AS INT))"


ANY_SPOT = r"[\x{e000}-\x{f8ff}]"


def pattern_passes(source: str, style: str = "numbered", kinds: tuple[str, ...] = TEXT_KINDS, prefix: str = "") -> str:
    """CTEs ``e_<kind>`` (accepted matches) and ``t_<kind>`` (text after the pass).

    ``source`` names a relation (id, t).  Each item is its own scope; in style
    ``placed`` tokens are KIND_0 and a :func:`spot`.
    """
    ctes, prev = [], source
    for kind in kinds:
        marked, shape = SHAPES[kind]
        base = _mark("t") if marked else "t"
        ok = f"{valid(kind, 'v')} AND NOT {prompt_like('v')}"
        if kind == "AADHAAR":
            ok += f" AND NOT {valid('MOBILE', 'v')}"
        if kind == "UPI":
            ok += f" AND NOT {valid('EMAIL', 'v')}"
        if kind in ("EMAIL", "UPI"):
            ok += f" AND NOT {has('v', '(?i)' + chr(92) + 'bINR' + chr(92) + 'b')}"
        placed = f"'{kind}_0' || {spot(4 + TEXT_KINDS.index(kind), 'e.i')}"
        token = {"kind_only": f"'{kind}_0'", "placed": placed}.get(style, f"'{kind}_' || n.n")
        step = f"""
x_{kind} AS MATERIALIZED (
  SELECT id, t, regexp_split_to_array({base}, {q(shape)}) ps, regexp_extract_all({base}, {q(shape)}) ms FROM {prev}),
y_{kind} AS MATERIALIZED (
  SELECT id, i, {_unmark('ps[i]')} piece, {_unmark('ms[i]')} m, {_unmark('''array_to_string(list_transform(
    range(greatest(1, i - 9), i + 1), lambda j: ps[j] || CASE WHEN j < i THEN ms[j] ELSE '' END), '')''')} before
  FROM (SELECT id, ps, ms, unnest(range(1, len(ps) + 1)) i FROM x_{kind})),
e_{kind} AS MATERIALIZED (
  SELECT id, i, m, {norm_key(q(kind), 'm')} k FROM (SELECT *, {trim('m')} v, right(before, 45) near FROM y_{kind} WHERE m IS NOT NULL)
  WHERE {ok} AND NOT {has('near', AMOUNT)} AND NOT {has('near', '(₹|' + chr(92) + 'bINR' + SP + '*)' + SP + '*$')}),
n_{kind} AS MATERIALIZED (
  SELECT id, k, row_number() OVER (PARTITION BY id ORDER BY min(i)) n FROM e_{kind} GROUP BY id, k),
t_{kind} AS MATERIALIZED (
  SELECT y.id, string_agg(y.piece || CASE WHEN e.k IS NOT NULL THEN {token} ELSE coalesce(y.m, '') END, '' ORDER BY y.i) t
  FROM y_{kind} y LEFT JOIN e_{kind} e ON y.id = e.id AND y.i = e.i LEFT JOIN n_{kind} n ON e.id = n.id AND e.k = n.k
  GROUP BY y.id)"""
        ctes.append(re.sub(rf"\b([xyent])_{kind}\b", rf"{prefix}\1_{kind}", step))
        prev = f"{prefix}t_{kind}"
    return ",".join(ctes)


def entity_union(kinds: tuple[str, ...] = TEXT_KINDS, first_phase: int = 4) -> str:
    rows = [
        f"SELECT id, {first_phase + TEXT_KINDS.index(k)} phase, "
        f"CAST(row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS INT) pos, '{k}' kind, m raw, k norm_key FROM e_{k}"
        for k in kinds
    ]
    return " UNION ALL ".join(rows)
