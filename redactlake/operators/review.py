"""Review lists, manual overrides, counts and change handling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactlake.functions import rules as R
from redactlake.operators.joins import null_safe_join
from redactlake.operators.redaction import redact_rows
from redactlake.operators.tokens import no_tokens, token_mentions

# --- fixed values: how kinds are shown to people ----------------------------
KIND_NAMES = {
    "PERSON": "Name", "MOBILE": "Phone number", "EMAIL": "Email", "ACCOUNT": "Account number",
    "AADHAAR": "Aadhaar", "PAN": "PAN", "ADDRESS": "Address", "PIN": "PIN code", "DOB": "Date of birth",
    "CARD": "Card number", "UPI": "UPI ID", "IFSC": "IFSC", "PASSWORD": "Password", "OTP": "One-time code",
    "PRIVATE": "Private detail",
}
AUDIT_RING = 40
_TOKEN = rf"(?<![{R.WORD}])[A-Z]+_[0-9]+(?![{R.WORD}])"


def kinds_per_item(redacted: Column) -> Column:
    """Kinds present in a redacted text, in order of appearance; PRIVATE if none."""
    kinds = F.array_distinct(
        F.transform(
            F.regexp_extract_all(redacted, F.lit(_TOKEN), 0), lambda t: F.regexp_replace(t, r"_[0-9]+\z", "")
        )
    )
    return F.when(F.size(kinds) > 0, F.array_join(kinds, ", ")).otherwise(F.lit("PRIVATE"))


def text_detections(
    items: DataFrame, item_id: str, text: str = "text", label: str | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per rewritten text item: id, label, kind list, original and redacted text."""
    kinds = kinds_per_item(F.col("redacted"))
    shown = F.coalesce(F.nullif(F.col(label), F.lit("")), kinds) if label else kinds
    return items.filter(F.col("redacted") != F.col(text)).select(
        *keep, F.col(item_id).alias("item_id"), F.lit("text").alias("source"), shown.alias("label"),
        kinds.alias("kind"), F.col(text).alias("original"), F.col("redacted"), F.lit(False).alias("locked"),
    )


def review(texts: DataFrame, fields: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Union of text and field detections as one review list.

    Both inputs have the columns of :func:`text_detections`; locked rows never
    show a value.  With overrides, ``is_private`` of a text follows the latest one;
    fields from :func:`field_detections` say themselves whether they hide something.
    """
    own = F.lit(None).cast("boolean").alias("has_record")
    states = fields.select("*", *([] if "has_record" in fields.columns else [own]))
    both = texts.select("*", own).unionByName(states)
    if overrides is not None:
        keys = override_keys(both, overrides)
        both = null_safe_join(both, latest_overrides(overrides, keys), keys, "left")
    else:
        both = both.withColumn("is_marked", F.lit(None).cast("boolean"))
    keep = [c for c in texts.columns if c not in ("item_id", "source", "label", "kind", "original", "redacted", "locked")]
    return both.select(
        *keep, "item_id", "source", "label", "kind",
        F.when(F.col("locked"), F.lit("Never read")).otherwise(F.col("original")).alias("value"),
        F.when(F.col("locked"), F.lit(R.HIDDEN)).otherwise(F.col("redacted")).alias("safe_value"),
        F.coalesce("has_record", F.col("locked") | F.coalesce("is_marked", F.lit(True))).alias("is_private"),
        (~F.col("locked")).alias("can_unmark"),
    )


def override_keys(items: DataFrame, overrides: DataFrame) -> list[str]:
    """What names an item: its id, within its scope or page where both tables have one.

    An element id such as ``email`` is on many pages, so overrides should carry their scope.
    """
    return [c for c in ("scope_id", "page_id") if c in items.columns and c in overrides.columns] + ["item_id"]


def latest_overrides(overrides: DataFrame, keys: Sequence[str] = ("item_id",)) -> DataFrame:
    """Latest manual decision per item (``is_private, ts``)."""
    return overrides.groupBy(*keys).agg(F.max_by("is_private", "ts").alias("is_marked"))


def overrides_as_of(overrides: DataFrame, changes: DataFrame, keys: Sequence[str] = ("item_id",), ts: str = "ts") -> DataFrame:
    """The log of manual decisions without those that a later change of their item made void.

    ``changes`` has ``keys`` and ``ts`` of every replacement of an item's text.  Only
    the last change of an item matters, so nothing is compared with a whole history.
    """
    keys = list(keys)
    last = changes.groupBy(*keys).agg(F.max(ts).alias("_changed"))
    known = null_safe_join(overrides, last, keys, "left")
    return known.filter(F.col("_changed").isNull() | (F.col(ts) > F.col("_changed"))).drop("_changed")


def _mark_kind(marked: DataFrame, value: str) -> Column:
    """Kind of something that a person marked: what its label and value say, else PRIVATE."""
    given = lambda c: F.coalesce(F.col(c), F.lit("")) if c in marked.columns else F.lit("")
    kind = R.classify(given("label"), F.col(value), given("type"))
    return F.when(kind.isin(*R.SECRET_KINDS), F.lit("PRIVATE")).otherwise(F.coalesce(kind, F.lit("PRIVATE")))


def apply_overrides(
    detections: DataFrame, overrides: DataFrame, tokens: DataFrame | None = None, scope: Sequence[str] = (), ord_col: str = "item_id"
) -> DataFrame:
    """What each item shows after manual marking and unmarking.

    ``detections``: item_id, kind, original, redacted, current, locked,
    authentication.  Locked and sign-in items refuse; an item whose current text
    is neither its original nor its redacted text has changed, which voids the
    override.  A marked item without a detection gets the kind that its ``label`` and
    ``type`` tell, if it has them, or PRIVATE, and a token of its own from the scope's
    map ``tokens`` (see :func:`mark_tokens`).
    """
    keys = override_keys(detections, overrides)
    d = null_safe_join(detections, latest_overrides(overrides, keys), keys, "left")
    asked = F.col("is_marked").isNotNull()
    refused = F.col("locked") | F.col("authentication")
    changed = ~(F.col("current").eqNullSafe(F.col("original")) | F.col("current").eqNullSafe(F.col("redacted")))
    applied = asked & ~refused & ~changed
    d = d.withColumns({"applied": applied, "why_not": F.when(asked & refused, F.lit("refused")).when(asked & changed, F.lit("changed"))})
    bare = d.filter(F.col("applied") & F.col("is_marked") & F.col("redacted").isNull() & (R.trim(F.coalesce("original", F.lit(""))) != ""))
    marks, _ = mark_tokens(bare, list(scope), ord_col, "original", tokens, keep=keys)
    own = [F.col(k) for k in keys]
    d = null_safe_join(d, marks.select(*own, "mark_kind", "mark_token").dropDuplicates(keys), keys, "left")
    private = F.when(F.col("applied"), F.col("is_marked")).otherwise(F.col("kind").isNotNull() & ~F.col("authentication"))
    # an item without text has nothing to hide
    return d.select(
        *detections.columns, "applied", "why_not", private.alias("is_private"),
        F.when(private & F.col("kind").isNull(), F.coalesce("mark_kind", F.lit("PRIVATE"))).otherwise(F.col("kind")).alias("shown_kind"),
        F.when(F.col("applied") & ~F.col("is_marked"), F.col("original"))
        .when(F.col("applied") & F.col("is_marked"), F.coalesce("redacted", "mark_token", "original"))
        .otherwise(F.col("current"))
        .alias("shown"),
    )


def mark_tokens(
    marked: DataFrame, scope: Sequence[str], ord_col: str = "item_ord", value: str = "value", tokens: DataFrame | None = None,
    keep: Sequence[str] = ("item_id",),
) -> tuple[DataFrame, DataFrame]:
    """Tokens for marked items that carry no detection: ``scope, keep, mark_kind, mark_token``; and the scope's map with them.

    Values that the map ``tokens`` holds keep their token, others go on after its
    highest number in ``ord_col``; equal values of a scope share a token.
    """
    scope = list(scope)
    keyed = marked.filter(R.trim(F.coalesce(F.col(value), F.lit(""))) != "").withColumn("_kind", _mark_kind(marked, value))
    order = F.col(ord_col).cast("bigint") if dict(marked.dtypes)[ord_col] != "string" else F.xxhash64(ord_col)
    kept = [c for c in dict.fromkeys([*scope, *keep])]
    mentions = keyed.select(
        *kept, order.alias("item_ord"), F.lit(0).alias("phase"), F.lit(0).alias("pos"), F.col("_kind").alias("kind"),
        F.col(value).alias("raw"), R.norm_key(F.col("_kind"), F.col(value)).alias("norm_key"),
    )
    named, every = token_mentions(mentions, no_tokens(mentions, scope) if tokens is None else tokens, scope)
    return named.select(*kept, F.col("kind").alias("mark_kind"), F.col("token").alias("mark_token")), every


def field_detections(
    fields: DataFrame, overrides: DataFrame, tokens: DataFrame, scope: str = "page_id", ord_col: str = "node_ord"
) -> tuple[DataFrame, DataFrame]:
    """Fields of the review list as their detections and the decisions about them leave them; and the scope's map.

    ``fields``: scope, item_id, order, label, type, value, kind, token, locked,
    authentication.  Sign-in fields are left out.  A field is listed when it has a
    record (it is locked, detected and not unmarked, or marked and not empty) or when
    someone decided about it; ``has_record`` tells which.
    """
    keys = [scope, "item_id"]
    d = null_safe_join(fields.filter(~F.col("authentication")), latest_overrides(overrides, keys), keys, "left")
    decided = F.col("is_marked").isNotNull() & ~F.col("locked")
    filled = R.trim(F.coalesce("value", F.lit(""))) != ""
    by_hand = d.filter(decided & F.col("is_marked") & F.col("kind").isNull() & filled)
    marks, every = mark_tokens(by_hand, [scope], ord_col, "value", tokens, keep=["item_id"])
    d = null_safe_join(d, marks, keys, "left")
    found = F.col("kind").isNotNull() & filled & ~(decided & ~F.coalesce("is_marked", F.lit(False)))
    record = F.col("locked") | found | F.col("mark_token").isNotNull()
    listed = d.filter(record | decided)
    return listed.select(
        scope, "item_id", F.lit("field").alias("source"), "label",
        F.when(record, F.coalesce("kind", "mark_kind")).otherwise(F.lit("PRIVATE")).alias("kind"),
        F.when(~F.col("locked"), F.col("value")).alias("original"),
        F.when(F.col("locked"), F.lit("")).when(record, F.coalesce("token", "mark_token")).otherwise(F.lit("")).alias("redacted"),
        "locked", record.alias("has_record"),
    ), every


def display_kinds(reviewed: DataFrame, shown: int | None = None) -> DataFrame:
    """Kind names for people; unknown kinds show their label.  ``shown`` cuts long values for a display."""
    names = F.create_map(*[F.lit(x) for pair in KIND_NAMES.items() for x in pair])  # 15 fixed entries
    return reviewed.withColumns(
        {
            "display": F.coalesce(
                F.try_element_at(names, F.col("kind")), F.nullif("label", F.lit("")), F.lit("Private detail")
            ),
            "shown_value": F.when(
                F.coalesce(F.length("value"), F.lit(0)) > 0, F.col("value") if shown is None else F.substring("value", 1, shown)
            )
            .when(F.col("is_private"), F.lit("Hidden on the page"))
            .otherwise(F.lit("Visible on the page")),
            "action": F.when(~F.col("can_unmark"), F.lit("Always hidden"))
            .when(F.col("is_private"), F.lit("Unmark"))
            .otherwise(F.lit("Mark private")),
        }
    )


def protected_count(reviewed: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Protected details per scope: field records, and text records not unmarked."""
    return reviewed.groupBy(*scope).agg(F.count_if(F.col("is_private")).alias("protected"))


def recent_audit(audit: DataFrame, session: Sequence[str], at: str, tie: str, keep: int = AUDIT_RING) -> DataFrame:
    """Latest events per session.  The rank filter is pushed below the shuffle as a group limit."""
    w = Window.partitionBy(*session).orderBy(F.desc(at), F.desc(tie))
    return audit.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= keep)


# --- changes between scans --------------------------------------------------
def changed_items(state: DataFrame, snapshot: DataFrame, item: Sequence[str]) -> DataFrame:
    """Compare what we wrote (``original, redacted``) with what is there now (``current``)."""
    joined = state.join(snapshot, list(item), "full")
    return joined.select(
        *item, "original", "redacted", "current",
        F.when(F.col("current").isNull(), F.lit("removed"))
        .when(F.col("redacted").isNull(), F.lit("new"))
        .when(F.col("current") == F.col("redacted"), F.lit("ours"))
        .when(F.col("current") == F.col("original"), F.lit("restored"))
        .otherwise(F.lit("replaced"))
        .alias("change"),
    )


def rescan(state: DataFrame, snapshot: DataFrame, item: Sequence[str]) -> DataFrame:
    """Redact again only what is new or was replaced; keep what still shows our text."""
    diff = changed_items(state, snapshot, item).filter(F.col("change") != "removed")
    ours = diff.filter(F.col("change") == "ours").select(*item, "current", "redacted")
    again = redact_rows(
        diff.filter(F.col("change") != "ours").select(*item, "current"), "current"
    ).select(*item, "current", "redacted")
    return ours.unionByName(again)


def prune_missing(state: DataFrame, snapshot: DataFrame, item: Sequence[str]) -> DataFrame:
    """Records (or overrides) whose item is still on the page."""
    return state.join(snapshot.select(*item).distinct(), list(item), "left_semi")


def latest_revision(results: DataFrame, key: Sequence[str], rev: str = "rev", request: str = "request") -> DataFrame:
    """The reply that counts per key: highest revision, then highest request.

    An aggregate rather than a window, so stale replies are dropped before the shuffle.
    """
    others = [c for c in results.columns if c not in key]
    best = results.groupBy(*key).agg(
        F.max_by(F.struct(*others), F.struct(F.col(rev), F.col(request))).alias("best")
    )
    return best.select(*key, "best.*")


def role_change(before: DataFrame, now: DataFrame, item: Sequence[str]) -> DataFrame:
    """Fields whose role changed between scans.

    ``before``: original, token.  ``now``: current, locked, authentication.  A field
    that became a sign-in field gets its value back if it still shows our token; one
    that became secret keeps a record without any value.
    """
    j = before.join(now, list(item))
    restored = F.col("authentication") & F.col("token").eqNullSafe(F.col("current"))
    return j.select(
        *item,
        F.when(F.col("locked"), F.lit("locked")).when(F.col("authentication"), F.lit("released"))
        .otherwise(F.lit("kept")).alias("outcome"),
        F.when(F.col("locked"), F.lit(None).cast("string"))
        .when(restored, F.col("original")).otherwise(F.col("current")).alias("shown"),
        F.when(F.col("locked") | F.col("authentication"), F.lit(None).cast("string"))
        .otherwise(F.col("original")).alias("kept_original"),
    )


def debounce(events: DataFrame, key: Sequence[str], ts: str, tie: str, gap: str, span: str = "day") -> DataFrame:
    """Trailing-edge debounce: events followed by silence of at least ``gap``.

    The next event is looked up per (key, day); only the first event of each day
    travels to the day before it, so a key with very many events is spread out.
    """
    key = list(key)
    day = F.date_trunc(span, F.col(ts))
    inside = Window.partitionBy(*key, "_day").orderBy(ts, tie)
    cut = events.withColumn("_day", day)
    heads = cut.groupBy(*key, "_day").agg(F.min(ts).alias("_head"))
    heads = heads.withColumn("_next_head", F.lead("_head").over(Window.partitionBy(*key).orderBy("_day")))
    nxt = F.coalesce(F.col("_in"), F.col("_next_head"))
    return (
        null_safe_join(cut.withColumn("_in", F.lead(ts).over(inside)), heads.select(*key, "_day", "_next_head"), [*key, "_day"])
        .filter(nxt.isNull() | (nxt >= F.col(ts) + F.expr(f"INTERVAL {gap}")))
        .select(*events.columns)
    )
