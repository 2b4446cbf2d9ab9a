"""Personal data: patterns propose, checksums confirm, context adjusts.  Column expressions only.

A pattern's matches and the pieces between them give the positions: the pieces'
and matches' lengths are summed by doubling steps, so a text with many matches
costs ``n log n``.  Patterns repeat possessively and start only where a run of
their first class starts, so no text makes them backtrack far or scan a run
again.  Account numbers are the exception: the pattern matches their first four
characters and looks ahead at up to 30 more; every length that ends with a token
is tried, and the country's own is preferred, then the longest.  At most 30
characters are looked at again for the next start.

=====  ==============================================  =====================
kind   proposed by                                     confirmed by
=====  ==============================================  =====================
email  local part, ``@``, dotted domain                the pattern
ip     four dotted numbers                             parts of at most 255
card   digits with single blanks or hyphens            12 to 19 digits, Luhn
phone  ``+`` and digits with separators                9 to 15 digits
iban   country, check digits, groups                   mod 97
ssn    three, two and four digits                      context words nearby
=====  ==============================================  =====================

Every span carries a score: that of its kind, raised by a word of its kind among
the 40 characters before or after it.  Spans of the first four kinds always
stay; the other two stay from ``THRESHOLD`` on.

Defined cases: null counts as empty; texts without spans give an empty array;
spans of different kinds may overlap and are all given, as may account numbers;
rows are not looked at together, so ties, repeated rows and null ids pass
through; an input column named like the result is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactlake.llm.tables import replace_columns

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
THRESHOLD = 0.6
_CONTEXT = 40

# What the kinds look like, a cheap test for texts without any, their score and their context words.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
_HINTS = {
    "email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]-[0-9]{2}-[0-9]",
}
_SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
_WORDS = {
    "email": r"e-?mail|contact|write", "ip": r"\bip\b|address|host|server", "card": r"card|visa|credit|debit|payment",
    "phone": r"phone|tel|mobile|call|fax", "iban": r"iban|account|bank|konto", "ssn": r"ssn|social security|tax|\bid\b|insurance",
}
_RAISE = 0.3
# Lengths of account numbers by country.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits is a multiple of ten."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, 1).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """The rearranged account number is one more than a multiple of 97."""
    moved = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(moved, i, 1))
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return m.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return F.length(m) > 0
    return F.lit(True)


def _account(candidate: Column) -> Column:
    """The start of the candidate that is an account number, or an empty string."""
    compact = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    country = F.substring(candidate, 1, 2)
    length = F.coalesce(*[F.when(country.isin(*names.split()), F.lit(n)) for n, names in _IBAN_LENGTHS.items()], F.lit(0))
    ends = F.filter(F.sequence(F.lit(15), F.length(candidate)), lambda k: ~F.substring(candidate, k, 2).rlike("^ |[A-Za-z0-9]{2}"))
    starts = F.transform(ends, lambda k: F.substring(candidate, F.lit(1), k))
    fits = lambda x: F.when(~x.rlike("[a-z]") & F.length(compact(x)).between(15, 34), mod97(compact(x))).otherwise(False)
    ranked = F.transform(F.filter(starts, fits), lambda x: F.struct((F.length(compact(x)) == length).alias("own"), F.length(x).alias("n"), x.alias("x")))
    return F.coalesce(F.array_max(ranked)["x"], F.lit(""))


def _running(lengths: Column) -> Column:
    """Sums of all elements up to each, by doubling steps."""
    steps = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.size(lengths) + 1)).cast("int"), F.lit(0)))

    def double(sums: Column, k: Column) -> Column:
        reach = F.pow(F.lit(2), k).cast("int")
        return F.transform(sums, lambda x, i: x + F.when(i >= reach, F.get(sums, i - reach)).otherwise(F.lit(0)))

    return F.aggregate(steps, lengths, double)


def _ends(matches: Column, pieces: Column) -> Column:
    lengths = F.transform(matches, lambda x, i: F.length(x) + F.length(F.get(pieces, i)))
    return F.when(F.size(matches) > 0, _running(lengths)).otherwise(F.array().cast("array<int>"))


def _spans(number: int, matches: Column, pieces: Column, ends: Column, values: Column) -> Column:
    """The confirmed spans of one kind; ``values`` start where the matches do."""
    kind = KINDS[number]

    def span(m: Column, i: Column) -> Column:
        x = F.get(values, i)
        more = F.length(x) - F.length(m)
        before, after = F.substring(F.get(pieces, i), -_CONTEXT, _CONTEXT), F.substring(F.get(pieces, i + 1), more + 1, F.lit(_CONTEXT))
        raised = F.lower(F.concat(before, F.lit("\n"), after)).rlike(_WORDS[kind])
        score = F.least(F.lit(_SCORES[kind]) + F.when(raised, F.lit(_RAISE)).otherwise(F.lit(0.0)), F.lit(1.0))
        end = F.get(ends, i) + more
        return F.struct(
            (end - F.length(x)).alias("start"), F.lit(number).alias("n"), F.lit(kind).alias("kind"), end.alias("end"), x.alias("value"),
            score.alias("score"),
        )

    def stays(s: Column) -> Column:
        return _confirmed(kind, s["value"]) & (F.lit(kind in BASE) | (s["score"] >= THRESHOLD))

    spans = F.transform(matches, span)
    return F.when(F.size(matches) > 0, F.filter(spans, stays)).otherwise(spans)


def find_spans(df: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """``df`` with an array of spans: kind, start, end (code points, end exclusive), value, score; by start and kind."""
    keep = replace_columns(df, [name])
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    empty = F.array().cast("array<string>")
    for kind in KINDS:
        hinted, pattern = F.col("t").rlike(_HINTS[kind]), _PATTERNS[kind]
        rows = rows.withColumn(f"m_{kind}", F.when(hinted, F.regexp_extract_all("t", F.lit(pattern), 0)).otherwise(empty))
        rows = rows.withColumn(f"p_{kind}", F.when(F.size(f"m_{kind}") > 0, F.split("t", pattern, -1)).otherwise(empty))
    tails = F.when(F.size("m_iban") > 0, F.regexp_extract_all("t", F.lit(_PATTERNS["iban"]), 1)).otherwise(empty)
    rows = rows.withColumn("v_iban", F.transform(tails, lambda x, i: _account(F.concat(F.get("m_iban", i), x)))).drop("t")
    for kind in KINDS:
        rows = rows.withColumn(f"e_{kind}", _ends(F.col(f"m_{kind}"), F.col(f"p_{kind}")))
    found = [_spans(number, *(F.col(f"{x}_{kind}") for x in ("m", "p", "e", "v" if kind == "iban" else "m"))) for number, kind in enumerate(KINDS)]
    ordered = F.array_sort(F.concat(*found))
    named = F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["score"].alias("score")))
    return rows.select("row", named.alias("s")).select(*[F.col("row")[c].alias(c) for c in keep], F.col("s").alias(name))


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
