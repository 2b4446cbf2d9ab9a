"""Detection rules as native column expressions.

Everything here is a ``Column -> Column`` builder, so rules run inside the JVM
and can be used both on plain columns and inside higher-order functions.
Patterns are written for ``java.util.regex``.  White space, word boundaries and
end-of-input are spelled out because Java's ``\\s``, ``\\b`` and ``$`` differ from
the semantics we need (Unicode spaces count as white space, word characters are
ASCII only, end-of-input is strict).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# White space, word characters and the separators allowed inside phone numbers.
SPACE = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WORD = "A-Za-z0-9_"
PHONE_SEP = SPACE + r"().\-"

# Words whose presence near a number means it is not a private detail.
AMOUNT_WORDS = (
    "order", "transaction", "invoice", "reference", "tracking", "receipt", "price", "amount",
)
CURRENCY_SIGN = "₹"
CURRENCY_CODE = "INR"
LOOK_BACK = 45

# Beginnings of prompt texts such as "enter your email".
PROMPT_STARTS = ("add", "enter", "type", "your", "please enter", r"e\.g\.?")

# Words that are never treated as part of a person's name.
COMMON_WORDS = tuple(
    """
    a an and the hello hi welcome namaste account accounts lists list return returns order orders
    cart company expand japan spanish english language menu home sign in out profile security
    settings edit update save cancel help contact search your you this that my our customer user
    name password email mobile phone number pan card address date birth dob pin code postal zip
    payment amazon shopping today with from have will may mark rose hope grace bill page chip apple
    orange target prime books deals gift registry shop store
    """.split()
)

# Kinds whose identity is given by their digits alone.
DIGIT_KINDS = ("MOBILE", "AADHAAR", "CARD", "ACCOUNT", "PIN")
SECRET_KINDS = ("PASSWORD", "OTP")
# Kinds searched for in running text, in this order.
TEXT_KINDS = ("MOBILE", "EMAIL", "PAN", "AADHAAR", "IFSC", "UPI", "CARD", "DOB")
# Kinds tried on a value that carries no telling label, first valid one wins.
CASCADE = ("MOBILE", "AADHAAR", "PAN", "IFSC", "EMAIL", "UPI", "DOB", "PIN", "CARD")
VALUE_KINDS = CASCADE + ("ACCOUNT", "PERSON", "ADDRESS")
GREETING_WORDS = ("hello", "hi", "welcome", "namaste")
HIDDEN = "[HIDDEN]"
MAX_LABEL_WORDS = 5
MIN_NAME_PART = 3

# Label words per kind, tested in this order.
LABEL_WORDS = (
    ("PERSON", r"account holder|name"),
    ("MOBILE", r"mobile|phone|telephone|contact|cell"),
    ("EMAIL", rf"e-?mail|mail[{SPACE}]*id"),
    ("AADHAAR", r"aadhaar|aadhar|uid"),
    ("PAN", r"pan"),
    ("IFSC", r"ifsc"),
    ("UPI", r"upi|vpa"),
    ("DOB", r"dob|date of birth|birth date"),
    ("PIN", rf"(?:pin|postal|zip)[{SPACE}]*code"),
    ("ADDRESS", r"address|city"),
)
SECRET_LABEL_WORDS = (
    r"password|passwd|passcode|otp|cvv|cvc|security code|one[- ]?time code|verification code"
)
# ----------------------------------------------------------------------------

_START = rf"(?<![{WORD}])"
_END = rf"(?![{WORD}])"
_EDGE = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
_NAME_START = r"(?<![\p{L}\p{N}_])"
_NAME_END = r"(?![\p{L}\p{N}_])"


def whole_words(alternatives: str) -> str:
    """Case-insensitive pattern for complete ASCII words."""
    return rf"(?i){_START}(?:{alternatives}){_END}"


SECRET_LABEL = (
    rf"(?i){_START}(?:{SECRET_LABEL_WORDS}|card[{SPACE}]+pin){_END}"
    rf"|{_START}pin{_END}(?![{SPACE}]*code)"
)
OTP_LABEL = r"(?i)otp|one[- ]?time|verification code"
CARD_LABEL = (
    rf"(?i){_START}card[{SPACE}]*(?:number|no){_END}|{_START}card[{SPACE}]*(?:#|no\.)(?=[{WORD}])"
    rf"|{_START}(?:debit card|credit card){_END}"
)
ACCOUNT_LABEL = (
    rf"(?i){_START}(?:account[{SPACE}]*(?:number|no|a/c)|a/c|iban){_END}"
    rf"|{_START}account[{SPACE}]*(?:no\.|#)(?=[{WORD}])"
    rf"|^(?:(?:savings?|current|salary|bank|sb)[{SPACE}]+)?"
    rf"(?:account|a[{SPACE}]*/[{SPACE}]*c|acct?\.?|iban)"
    rf"(?:[{SPACE}]*(?:number|no\.?|#))?[{SPACE}]*[:\-]?[{SPACE}]*\z"
)
AMOUNT = "(?i)" + "|".join(AMOUNT_WORDS)
CURRENCY_VALUE = rf"(?i){CURRENCY_SIGN}|{_START}{CURRENCY_CODE}{_END}"
CURRENCY_BEFORE = rf"(?:{CURRENCY_SIGN}|{_START}{CURRENCY_CODE}[{SPACE}]*)[{SPACE}]*\z"
# The class after the prompt word already covers every ending a prompt can have.
PROMPT = rf"(?i)^(?:{'|'.join(PROMPT_STARTS)})[{SPACE}{WORD}'\-]*\z"
TOKEN_SHAPE = r"[A-Z]+_(?:[0-9]+|[g-v]{32})"
ONLY_TOKENS = rf"(?i)^{TOKEN_SHAPE}(?:[{SPACE}]+{TOKEN_SHAPE})*\z"

# What each kind looks like inside running text.
SHAPES = {
    "MOBILE": rf"(?<![0-9])(?:\+?91[{PHONE_SEP}]*|0[{PHONE_SEP}]*)?[6-9](?:[{PHONE_SEP}]*[0-9]){{9}}(?![0-9])",
    "EMAIL": rf"{_EDGE}[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}{_END}",
    "PAN": rf"{_START}[A-Za-z]{{5}}[0-9]{{4}}[A-Za-z]{_END}",
    "AADHAAR": r"(?<![0-9])[2-9][0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4}(?![0-9])",
    "IFSC": rf"{_START}[A-Za-z]{{4}}0[A-Za-z0-9]{{6}}{_END}",
    "UPI": rf"{_EDGE}[A-Za-z0-9._\-]{{2,}}@[A-Za-z][A-Za-z0-9.\-]+{_EDGE}",
    "CARD": r"(?<![0-9])(?:[0-9][ -]?){13,19}(?![0-9])",
    "DOB": rf"{_START}(?:0?[1-9]|[12][0-9]|3[01])[/\-](?:0?[1-9]|1[0-2])[/\-](?:19|20)[0-9]{{2}}{_END}",
}

# Cheap necessary tests for the shapes above.  They begin with a rare character,
# so the scan skips ordinary prose quickly and most rows stop here.
SHAPE_GUARDS = {
    "MOBILE": rf"[0-9](?:[{PHONE_SEP}]*[0-9]){{9}}",
    "EMAIL": "@",
    "PAN": "[0-9]{4}[A-Za-z]",
    "AADHAAR": "[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}",
    "IFSC": "0[A-Za-z0-9]{6}",
    "UPI": "@",
    "CARD": "[0-9](?:[ -]?[0-9]){12}",
    "DOB": r"[/\-](?:19|20)[0-9]{2}",
}

# What a complete, trimmed value of each kind looks like.
VALUE_FORMS = {
    "AADHAAR": r"^(?:[2-9][0-9]{11}|[2-9][0-9]{3}[ -][0-9]{4}[ -][0-9]{4})\z",
    "EMAIL": r"(?i)^[a-z0-9._%+\-]+@(?:[a-z0-9](?:[a-z0-9\-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}\z",
    "UPI": r"(?i)^[a-z0-9._\-]{2,}@[a-z][a-z0-9.\-]+\z",
    "DOB": r"^[0-9]{1,2}[/\-][0-9]{1,2}[/\-](?:19|20)[0-9]{2}\z",
    "PAN": r"(?i)^[a-z]{5}[0-9]{4}[a-z]\z",
    "IFSC": r"(?i)^[a-z]{4}0[a-z0-9]{6}\z",
    "PIN": r"^[0-9]{6}\z",
    "CARD": r"^(?:[0-9][ -]?){13,19}\z",
}
MOBILE_DIGITS = r"^(?:\+?91|0)?[6-9][0-9]{9}\z"
ACCOUNT_DIGITS = r"^[0-9]{9,18}\z"


def _dihedral_product(j: int, k: int) -> int:
    """Product in the symmetry group of the pentagon (0-4 turns, 5-9 flips)."""
    turn = (j + k) % 5 if j < 5 else (j - k) % 5
    return turn + 5 * ((j >= 5) != (k >= 5))


def _permutation_rows() -> list[list[int]]:
    base = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    rows = [list(range(10))]
    while len(rows) < 8:
        rows.append([base[d] for d in rows[-1]])
    return rows


VERHOEFF_PRODUCT = "".join(str(_dihedral_product(j, k)) for j in range(10) for k in range(10))
VERHOEFF_PERMUTE = "".join(str(d) for row in _permutation_rows() for d in row)
DOUBLED = "".join(str(d * 2 - 9 if d > 4 else d * 2) for d in range(10))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def has_few_words(trimmed: Column) -> Column:
    """At most five words; expects a trimmed text."""
    return ~trimmed.rlike(rf"^(?:[^{SPACE}]+[{SPACE}]+){{{MAX_LABEL_WORDS}}}[^{SPACE}]")


def trusted_label(label: Column) -> Column:
    t = trim(F.coalesce(label, F.lit("")))
    return F.when(has_few_words(t), t).otherwise(F.lit(""))


def is_empty_like(trimmed: Column) -> Column:
    return (trimmed == "") | trimmed.rlike(PROMPT)


def luhn(value: Column) -> Column:
    """Card checksum over the digits of the value, 13 to 19 of them."""
    d = digits_of(value)
    n = F.length(d)
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        F.lit(0),
        lambda acc, i: acc
        + F.when(
            (n - i) % 2 == 1,
            F.substring(F.lit(DOUBLED), F.substring(d, i, F.lit(1)).cast("int") + 1, F.lit(1)).cast("int"),
        ).otherwise(F.substring(d, i, F.lit(1)).cast("int")),
    )
    return F.when(n.between(13, 19), total % 10 == 0).otherwise(F.lit(False))


def verhoeff(value: Column) -> Column:
    d = digits_of(value)
    n = F.length(d)

    def step(c, i):
        digit = F.substring(d, n - i, F.lit(1)).cast("int")
        moved = F.substring(F.lit(VERHOEFF_PERMUTE), (i % 8) * 10 + digit + 1, F.lit(1)).cast("int")
        return F.substring(F.lit(VERHOEFF_PRODUCT), c * 10 + moved + 1, F.lit(1)).cast("int")

    check = F.aggregate(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), F.lit(0), step)
    return F.when(n > 0, check == 0).otherwise(F.lit(True))


def valid_mobile(v: Column) -> Column:
    return F.regexp_replace(v, rf"[{PHONE_SEP}]", "").rlike(MOBILE_DIGITS)


def valid_dob(v: Column) -> Column:
    parsed = F.try_to_timestamp(F.translate(v, "-", "/"), F.lit("d/M/yyyy"))
    return F.when(v.rlike(VALUE_FORMS["DOB"]), parsed.isNotNull()).otherwise(F.lit(False))


def valid_account(v: Column) -> Column:
    return F.regexp_replace(v, "[ -]", "").rlike(ACCOUNT_DIGITS)


def _accepts(kind: str, v: Column) -> Column:
    """Validity for one kind of a trimmed value that is not empty-like."""
    if kind in ("PERSON", "ADDRESS"):
        return F.lit(True)
    if kind == "MOBILE":
        return valid_mobile(v)
    if kind == "ACCOUNT":
        return valid_account(v)
    if kind == "DOB":
        return valid_dob(v)
    form = v.rlike(VALUE_FORMS[kind])
    if kind == "AADHAAR":
        return F.when(form, verhoeff(v)).otherwise(F.lit(False))
    if kind == "CARD":
        return F.when(form, luhn(v)).otherwise(F.lit(False))
    return form


def valid_kind(kind: Column, trimmed: Column) -> Column:
    """Is the trimmed value acceptable for the given kind?"""
    out = F.when(is_empty_like(trimmed), F.lit(False))
    for k in VALUE_KINDS:
        out = out.when(kind == k, _accepts(k, trimmed))
    return out.otherwise(F.lit(False))


def unlabelled_kind(trimmed: Column) -> Column:
    """Kind of a bare value: first valid one of the cascade, else null."""
    out = F.when(is_empty_like(trimmed), F.lit(None).cast("string"))
    for k in CASCADE:
        out = out.when(_accepts(k, trimmed), F.lit(k))
    return out


def label_kind(trusted: Column) -> Column:
    """First kind whose label words occur in an already trusted label."""
    out = None
    for kind, words in LABEL_WORDS:
        test = trusted.rlike(whole_words(words))
        out = F.when(test, F.lit(kind)) if out is None else out.when(test, F.lit(kind))
    return out.when(trusted.rlike(CARD_LABEL), F.lit("CARD")).when(
        trusted.rlike(ACCOUNT_LABEL), F.lit("ACCOUNT")
    )


def is_account_label(trusted: Column) -> Column:
    """Does the label stand for an account number, i.e. is ACCOUNT its first matching kind?"""
    earlier = "|".join(f"{whole_words(words)}" for _, words in LABEL_WORDS) + "|" + CARD_LABEL
    return trusted.rlike(ACCOUNT_LABEL) & ~trusted.rlike(earlier)


def is_secret(trusted: Column, type_: Column) -> Column:
    hint = F.concat(trusted, F.lit(" "), type_)
    return (F.lower(type_) == "password") | hint.rlike(SECRET_LABEL)


def amount_context(trusted: Column, value: Column, type_: Column) -> Column:
    hint = F.concat(trusted, F.lit(" "), type_)
    return hint.rlike(AMOUNT) | value.rlike(CURRENCY_VALUE)


def decide_kind(trusted: Column, by_label: Column, value: Column, trimmed: Column, type_: Column) -> Column:
    """Final kind (or null) from a trusted label, its label kind and a value.

    ``trusted``, ``by_label`` and ``trimmed`` are expected to be materialised
    columns so that the branches below do not recompute them.
    """
    hint = F.concat(trusted, F.lit(" "), type_)
    return (
        F.when(
            is_secret(trusted, type_),
            F.when(hint.rlike(OTP_LABEL), F.lit("OTP")).otherwise(F.lit("PASSWORD")),
        )
        .when(amount_context(trusted, value, type_), F.lit(None).cast("string"))
        .when(by_label.isNotNull(), F.when(valid_kind(by_label, trimmed), by_label))
        .otherwise(unlabelled_kind(trimmed))
    )


def let(value: Column, body) -> Column:
    """Bind a value to a lambda variable, so that it is computed once.

    Unlike an extra projection this survives optimizer rules that move filters:
    whoever copies the expression copies it once, not once per mention.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def classify(label: Column, value: Column, type_: Column) -> Column:
    """Kind of a labelled value, or null."""

    def with_trusted(a: Column) -> Column:
        more = F.struct(
            a["t"].alias("t"), a["v"].alias("v"), a["ty"].alias("ty"),
            label_kind(a["t"]).alias("by_label"), trim(a["v"]).alias("trimmed"),
        )
        return let(more, lambda b: decide_kind(b["t"], b["by_label"], b["v"], b["trimmed"], b["ty"]))

    blank = F.lit("")
    given = F.struct(
        trusted_label(label).alias("t"), F.coalesce(value, blank).alias("v"), F.coalesce(type_, blank).alias("ty")
    )
    return let(given, with_trusted)


def text_match_ok(kind: str, match: Column) -> Column:
    """Does a text match of this shape count, i.e. is it classified as ``kind`` on its own?

    The full cascade is not needed: only the listed earlier kinds can claim a
    string of the given shape.
    """
    v = trim(match)
    ok = _accepts(kind, v)
    if kind == "AADHAAR":
        ok = ok & ~_accepts("MOBILE", v)
    if kind == "UPI":
        ok = ok & ~_accepts("EMAIL", v)
    if kind in ("EMAIL", "UPI"):
        ok = ok & ~v.rlike(CURRENCY_VALUE)
    return ok & ~is_empty_like(v)


def norm_key(kind: Column | str, raw: Column) -> Column:
    """Identity of a value within its kind: digits only, or lower case."""
    v = trim(raw)
    if isinstance(kind, str):
        return digits_of(v) if kind in DIGIT_KINDS else F.lower(v)
    return F.when(kind.isin(*DIGIT_KINDS), digits_of(v)).otherwise(F.lower(v))


def is_common_word(part: Column) -> Column:
    return F.lower(part).isin(*COMMON_WORDS)


def escape_regex(c: Column) -> Column:
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def name_pattern(key: Column) -> Column:
    """Case-insensitive pattern for a known name standing as its own word(s)."""
    return F.concat(F.lit(r"(?iu)" + _NAME_START), escape_regex(key), F.lit(_NAME_END))
