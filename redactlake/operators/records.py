"""Jobs over labelled values, records and requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactlake.functions import rules as R
from redactlake.operators.tokens import token_mentions

# --- fixed values: limits and wording of the record rules --------------------
ANSWER_COLUMNS = ("hire_reason", "strongest_skills", "challenge_solved")
PUBLIC_COLUMNS = ("name", "age", "bank_account_number", *ANSWER_COLUMNS)
MAX_CONTEXT, MAX_QUESTION, MAX_ANSWER = 20000, 1000, 500
ACTION_FIELDS = ("hireReason", "strongestSkills", "challengeSolved")
# ----------------------------------------------------------------------------
_S = R.SPACE
EMAIL_LOOSE = rf"^[^{_S}@]+@[^{_S}@]+\.[^{_S}@]+\z"
RAW_EMAIL = rf"{R._EDGE}[^{_S}@]+@[^{_S}@]+\.[^{_S}@]+{R._EDGE}"
RAW_DIGITS = rf"(?<![{R.WORD}])[0-9]{{8,24}}(?![{R.WORD}])"
RAW_PHONE = rf"\+?[0-9][0-9{_S}().\-]{{6,}}[0-9]"


def classify_values(df: DataFrame, label: str = "label", value: str = "value", type_: str = "type") -> DataFrame:
    """Add ``kind``, ``confidence`` and ``never_read`` for labelled values."""
    kind = R.classify(F.col(label), F.col(value), F.col(type_))
    judged = R.let(
        kind,
        lambda k: F.struct(
            k.alias("kind"),
            F.when(k.isNotNull(), F.lit("High")).alias("confidence"),
            F.coalesce(k.isin(*R.SECRET_KINDS), F.lit(False)).alias("never_read"),
        ),
    )
    return df.withColumn("_judged", judged).select(*df.columns, "_judged.*")


def label_kinds(df: DataFrame, label: str = "label") -> DataFrame:
    """Kind suggested by the label alone (null when no rule matches)."""
    return df.withColumn("label_kind", R.let(R.trusted_label(F.col(label)), R.label_kind))


def validate_values(df: DataFrame, kind: str = "kind", value: str = "value") -> DataFrame:
    """Add ``is_valid``: is the value acceptable for the stated kind?"""
    trimmed = R.trim(F.coalesce(F.col(value), F.lit("")))
    return df.withColumn("is_valid", R.let(trimmed, lambda v: R.valid_kind(F.col(kind), v)))


def with_norm_key(df: DataFrame, kind: str = "kind", raw: str = "raw") -> DataFrame:
    return df.withColumn("norm_key", R.norm_key(F.col(kind), F.col(raw)))


def drop_common_names(parts: DataFrame, part: str = "part") -> DataFrame:
    """Anti join against the fixed list of words that are no names (88 entries, broadcast)."""
    spark = parts.sparkSession
    words = spark.createDataFrame([(w,) for w in sorted(set(R.COMMON_WORDS))], "word string")
    return parts.join(F.broadcast(words), F.lower(F.col(part)) == F.col("word"), "left_anti")


def field_summary(classified: DataFrame) -> DataFrame:
    """Per field: id, label, kind or "Not detected", confidence, is_private, safe value."""
    private = F.col("kind").isNotNull() & (F.col("locked") | F.col("token").isNotNull())
    return classified.select(
        "field_id", "label",
        F.coalesce("kind", F.lit("Not detected")).alias("kind"),
        F.when(private, F.lit("High")).otherwise(F.lit("Not detected")).alias("confidence"),
        private.alias("is_private"),
        F.when(F.col("locked"), F.lit(R.HIDDEN)).otherwise(F.coalesce("token", F.lit(""))).alias("safe_value"),
    )


# --- registrations ----------------------------------------------------------
def clean_registrations(df: DataFrame) -> DataFrame:
    """Trim, lower-case and strip the registration columns; blank answers become ''."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return df.withColumns(
        {
            "email": F.lower(R.trim(text("email"))),
            "password": text("password"),
            "name": R.trim(text("name")),
            "bank_account_number": F.regexp_replace(text("bank_account_number"), rf"[{_S}\-]", ""),
            **{c: R.trim(text(c)) for c in ANSWER_COLUMNS},
        }
    )


def validate_records(df: DataFrame) -> DataFrame:
    """Add ``failed`` (all broken rules in message order) and ``first_failure``."""
    c = clean_registrations(df)
    age = F.col("age").cast("double")
    rules = [
        ("email", ~F.col("email").rlike(EMAIL_LOOSE)),
        ("password", ~F.length("password").between(8, 72)),
        ("name", ~F.length("name").between(2, 80)),
        ("age", age.isNull() | (age != F.floor(age)) | ~age.between(16, 100)),
        ("account", ~F.col("bank_account_number").rlike(r"^[0-9]{6,18}\z")),
        ("answers", F.greatest(*[F.length(a) for a in ANSWER_COLUMNS]) > MAX_ANSWER),
    ]
    failed = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))
    return c.withColumn("failed", failed).withColumn("first_failure", F.get("failed", F.lit(0)))


def reject_duplicates(new: DataFrame, existing: DataFrame, order: str, email: str = "email") -> DataFrame:
    """First registration per e-mail address that is not registered yet.

    The first one is picked by an aggregate, so repeats collapse before the shuffle.
    """
    key = F.lower(R.trim(F.col(email)))
    keyed = new.withColumn("email_key", key)
    others = [c for c in keyed.columns if c != "email_key"]
    first = keyed.groupBy("email_key").agg(F.min_by(F.struct(*others), order).alias("r")).select("email_key", "r.*")
    taken = existing.select(key.alias("email_key")).distinct()
    return first.join(taken, "email_key", "left_anti")


def public_projection(users: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Only the columns that may leave; missing answers become ''."""
    return users.select(
        *keys,
        *[F.coalesce(F.col(c), F.lit("")).alias(c) if c in ANSWER_COLUMNS else F.col(c) for c in PUBLIC_COLUMNS],
    )


# --- gates ------------------------------------------------------------------
def raw_pii_gate(requests: DataFrame, context: str = "context", question: str = "question") -> DataFrame:
    """Add ``accepted`` and ``reason`` for outgoing requests."""
    ctx, ask = R.trim(F.coalesce(F.col(context), F.lit(""))), R.trim(F.coalesce(F.col(question), F.lit("")))
    both = F.concat_ws("\n", ctx, ask)
    reason = (
        F.when((ctx == "") | (ask == ""), F.lit("blank"))
        .when((F.length(ctx) > MAX_CONTEXT) | (F.length(ask) > MAX_QUESTION), F.lit("oversized"))
        .when(both.contains("@") & both.rlike(RAW_EMAIL), F.lit("email"))
        .when(both.rlike(RAW_DIGITS), F.lit("digits"))
        .when(both.rlike(RAW_PHONE), F.lit("phone"))
    )
    return requests.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def valid_actions(actions: DataFrame) -> DataFrame:
    """Keep well-formed fill actions on the allowed fields, value trimmed."""
    value = R.trim(F.col("value"))
    ok = (
        (F.col("type") == "fill_field")
        & F.col("field_id").isin(*ACTION_FIELDS)
        & (F.length(value) > 0)
        & (F.length("value") <= MAX_ANSWER)
    )
    return actions.filter(ok).withColumn("value", value)


def origin(url: str) -> Column:
    """Scheme, host and port of an http(s) address, without user, case and default port; else ''."""
    pattern = r"^(?i)(https?)://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)(?::([0-9]*))?(?=[/?#]|$)"
    scheme, host, port = (F.lower(F.regexp_extract(url, pattern, i)) for i in (1, 2, 3))
    usual = F.when(scheme == "https", F.lit("443")).otherwise(F.lit("80"))
    shown = F.when((port == "") | (port == usual), F.lit("")).otherwise(F.concat(F.lit(":"), port))
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), host, shown)).otherwise(F.lit(""))


def eligible_pages(pages: DataFrame, grants: DataFrame, url: str = "url") -> DataFrame:
    """Pages on http(s) whose origin was granted (semi join on the origin)."""
    parts = pages.withColumn("origin", origin(url))
    return parts.filter(F.col("origin") != "").join(grants.select("origin").distinct(), "origin", "left_semi")


# --- recognised text lines --------------------------------------------------
def ocr_candidates(lines: DataFrame, scale: float = 1.0) -> DataFrame:
    """Private details among recognised text lines, with scaled boxes.

    A line with a colon is read as label and value, one without as both; if that
    gives nothing, the whole line is tried as a bare value.
    """
    blank = F.lit("")
    raw = F.coalesce(F.col("raw"), blank)
    colon = F.instr(raw, ":")
    label = F.when(colon > 0, F.substring(raw, F.lit(1), colon - 1)).otherwise(raw)
    value = F.when(colon > 0, R.trim(F.substring(raw, colon + 1, F.length(raw)))).otherwise(raw)
    kind = F.coalesce(R.classify(label, value, blank), R.classify(blank, raw, blank))
    return lines.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select(
        *[c for c in lines.columns if c != "bbox"], "kind",
        *[(F.col(f"bbox.{c}") * F.lit(scale)).alias(c) for c in ("x", "y", "width", "height")],
    )


def register_visual(candidates: DataFrame, tokens: DataFrame, scope: Sequence[str] = (), order: Sequence[str] = ("image_id", "line_ord")) -> tuple[DataFrame, DataFrame]:
    """Tokens for recognised details from the scope's map, without their text; and the map with the new ones."""
    found = with_norm_key(candidates).withColumns(
        {"item_ord": F.col(order[0]).cast("bigint"), "phase": F.lit(0), "pos": F.col(order[1]).cast("int")}
    )
    named, every = token_mentions(found, tokens, scope)
    return named.drop("raw", "norm_key", "item_ord", "phase", "pos"), every
