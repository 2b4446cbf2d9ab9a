"""Labels, table headings, forms and visibility on node tables.

The rules for tables of nodes, cells, siblings and fields.  Whole pages are resolved
row by row in :mod:`redactlake.sources.resolve`, by the same rules.  Ancestor
questions on node tables use the pre-order numbers: subtrees are nested intervals,
so "is some earlier marked node still open here" is a running maximum, not an
interval join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactlake.functions import rules as R
from redactlake.operators.joins import null_safe_join
from redactlake.operators.leaks import known_value_leaks
from redactlake.operators.ordered import carry_last
from redactlake.operators.redaction import redact_rows
from redactlake.operators.records import classify_values
from redactlake.operators.scopes import redact_more, redact_scopes
from redactlake.session import checkpointed

# --- fixed values -----------------------------------------------------------
HEADER_WORDS = (
    "name|number|no|account|type|balance|withdrawable|currency|email|phone|mobile|address|ifsc|date|status"
)
RESTRICTED_TAGS = ("nav", "header", "menu", "button", "a")
RESTRICTED_ROLES = ("button", "menu", "menuitem")
RESTRICTED_CLASSES = "sr-only|visually-hidden|screen-reader-only|a-offscreen|offscreen"
SECRET_AUTOCOMPLETE = "current-password|new-password|one-time-code|cc-csc|cc-number|cc-exp|cc-name"
SECRET_CONTROL = "current-password|new-password|one-time-code"
LOGIN_WORDS = r"(?:log[-_ ]?in|sign[-_ ]?in|auth(?:enticate|entication)?|session|register|sign[-_ ]?up)(?:[-_ ]?form)?"
SECRET_HINTS = (
    "(?i)password|passwd|passcode",
    R.whole_words("otp|one[- ]?time (?:password|code)|verification code|cvv|cvc|security code"),
    rf"(?i)card[{R.SPACE}]+pin|(?<![{R.WORD}])pin(?![{R.WORD}])(?![{R.SPACE}]*code)",
)
USER_AUTOCOMPLETE = rf"(?i)(?:^|[{R.SPACE}])username(?:[{R.SPACE}]|\z)"
USER_WORDS = "username|user[-_ ]?(?:name|id)|login[-_ ]?(?:name|id)"
IDENTITY_HINT = "(?i)email|e-mail|phone|mobile|customer[-_ ]?id"
CONTROLS = ("input", "textarea", "select")
NO_LABEL = "Unlabelled field"
# ----------------------------------------------------------------------------
_DELIMITED = rf"[:\-][{R.SPACE}]*\z"


def _attr(name: str) -> Column:
    return F.coalesce(F.try_element_at(F.col("attrs"), F.lit(name)), F.lit(""))


def _has_attr(name: str) -> Column:
    return F.map_contains_key("attrs", name)


# --- visibility and restriction ---------------------------------------------
def _under(nodes: DataFrame, marked: Column, by: list[str], name: str) -> DataFrame:
    """Flag nodes that are marked or lie below a marked node."""
    w = Window.partitionBy(*by).orderBy("node_ord").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(marked, F.col("subtree_end"))).over(w)
    return nodes.withColumn(name, F.coalesce(reach >= F.col("node_ord"), F.lit(False)))


def visible(nodes: DataFrame) -> DataFrame:
    """Drop hidden elements with everything below them (inline styles and attributes only)."""
    style = F.regexp_replace(F.lower(_attr("style")), r"\s", "")
    hidden = (F.col("node_type") == "element") & (
        F.col("tag").isin("head", "title", "datalist")
        | _has_attr("hidden")
        | (_attr("aria-hidden") == "true")
        | (F.lower(_attr("type")) == "hidden")
        | style.rlike(r"(^|;)(display:none|visibility:hidden|opacity:0(\.0+)?(;|!|\z))")
    )
    return _under(nodes, hidden, ["page_id"], "_hidden").filter(~F.col("_hidden")).drop("_hidden")


def label_restricted(nodes: DataFrame) -> DataFrame:
    """Add ``restricted``: navigation, buttons, links and off-screen texts carry no labels."""
    style = F.regexp_replace(F.lower(_attr("style")), r"\s", "")
    clipped = style.rlike("position:absolute") & style.rlike("clip|overflow:hidden") & style.rlike(r"(^|;)(width|height):[01]px")
    blocking = (F.col("node_type") == "element") & (
        F.col("tag").isin(*RESTRICTED_TAGS)
        | F.lower(_attr("role")).isin(*RESTRICTED_ROLES)
        | (_attr("aria-hidden") == "true")
        | _attr("class").rlike(R.whole_words(RESTRICTED_CLASSES))
        | clipped
    )
    return _under(nodes, blocking, ["page_id", "doc_ord"], "restricted")


# --- table headings ---------------------------------------------------------
def table_headers(cells: DataFrame, table: tuple[str, ...] = ("table_id",)) -> DataFrame:
    """Add ``is_header`` and ``heading`` (label of the cell's column) to table cells.

    ``cells``: table key, row_ord, col, tag, role, scope, in_thead, col_span,
    row_span, aria_colindex, has_control, text.
    """
    t = list(table)
    words = R.trim(F.col("text"))
    column_header = ((F.col("tag") == "th") & (F.col("scope") != "row")) | (F.col("role") == "columnheader")
    plain = (words != "") & ~words.rlike("[0-9]") & R.has_few_words(words) & ~F.col("has_control")
    rows = cells.groupBy(*t, "row_ord").agg(
        F.count(F.lit(1)).alias("_n"),
        F.bool_and(column_header).alias("_all_headers"),
        F.bool_or("in_thead").alias("_thead"),
        F.bool_and(plain).alias("_plain"),
        F.count_if(words.rlike(R.whole_words(HEADER_WORDS))).alias("_known"),
        F.bool_or((F.col("col_span") > 1) | (F.col("row_span") > 1)).alias("_merged"),
    )
    first = cells.groupBy(*t).agg(F.min("row_ord").alias("_first"))
    rows = rows.join(first, t)
    guess = (F.col("row_ord") == F.col("_first")) & (F.col("_n") >= 2) & F.col("_plain") & (F.col("_known") >= 2)
    rows = rows.withColumn("_is_head", F.col("_thead") | F.col("_all_headers") | guess)
    rows = rows.withColumn("_head_row", F.when(F.col("_is_head"), F.col("row_ord")))
    # one small row for each table row, read several times by the numbering and the joins below
    rows = checkpointed(carry_last(checkpointed(rows), t, "row_ord", ["row_ord"], "_head_row", "_above"))
    above = rows.select(*t, F.col("row_ord").alias("_above"), F.col("_merged").alias("_head_merged"))
    rows = rows.select(*t, "row_ord", "_is_head", "_above", "_merged").join(above, [*t, "_above"], "left")
    marked = cells.join(rows, [*t, "row_ord"])
    by_index = F.when(F.col("aria_colindex") != "", F.concat(F.lit("a"), F.col("aria_colindex")))
    by_place = F.concat(F.lit("p"), F.col("col").cast("string"))
    heads = (
        marked.filter("_is_head")
        .select(*t, F.col("row_ord").alias("_above"), "col", words.alias("_label"), F.explode(F.array_compact(F.array(by_index, by_place))).alias("_key"))
        .groupBy(*t, "_above", "_key")
        .agg(F.min_by("_label", "col").alias("_label"))
    )
    explicit = (F.col("tag") == "th") | F.col("role").isin("columnheader", "rowheader")
    is_head = F.col("_is_head") | (F.col("role") == "columnheader")
    merged = F.col("_merged") | F.coalesce("_head_merged", F.lit(False))
    joined = marked.withColumn("_key", F.coalesce(by_index, by_place)).join(heads, [*t, "_above", "_key"], "left")
    return joined.select(
        *cells.columns,
        F.when(is_head, F.lit(True)).when(F.col("_above").isNull(), explicit).otherwise(F.lit(False)).alias("is_header"),
        F.when(is_head | F.col("_above").isNull() | merged, F.lit("")).otherwise(F.coalesce("_label", F.lit(""))).alias("heading"),
    )


# --- neighbours -------------------------------------------------------------
def neighbour_labels(siblings: DataFrame) -> DataFrame:
    """Labels next to values.

    ``siblings``: page_id, parent_ord, parent_tag, sib_ord, node_ord, node_type, tag,
    content, has_control, i.e. the children of every element with their text.  Adds to
    each non-blank text node the preceding text, the text of the element before its
    parent, and whether that element reads like a label.
    """
    full = siblings.filter((F.col("node_type") == "element") | (R.trim(F.col("content")) != ""))
    w = Window.partitionBy("page_id", "parent_ord").orderBy("sib_ord")
    texts = full.withColumn("preceding_label", F.coalesce(F.lag("content").over(w), F.lit(""))).filter(F.col("node_type") == "text")
    elements = siblings.filter(F.col("node_type") == "element")
    before = elements.select(
        "page_id", F.col("node_ord").alias("parent_ord"),
        F.lag(F.struct("tag", "content", "has_control")).over(w).alias("_b"),
    )
    j = texts.join(before, ["page_id", "parent_ord"], "left")
    sibling = F.when(F.col("_b.has_control"), F.lit("")).otherwise(F.coalesce("_b.content", F.lit("")))
    trimmed = R.trim(sibling)
    semantic = F.col("_b.tag").isin("label", "dt", "th") | ((F.col("parent_tag") == "td") & (F.col("_b.tag") == "td"))
    is_label = R.has_few_words(trimmed) & (F.coalesce(semantic, F.lit(False)) | trimmed.rlike(_DELIMITED))
    return j.select(
        "page_id", "node_ord", F.col("content").alias("text"), "preceding_label",
        sibling.alias("sibling_label"), is_label.alias("reads_like_label"),
    )


# --- fields -----------------------------------------------------------------
def pick_label(candidates: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """First candidate column that is not blank and has at most five words."""
    ok = lambda c: F.when((R.trim(F.col(c)) != "") & R.has_few_words(R.trim(F.col(c))), R.trim(F.col(c)))
    return candidates.withColumn("label", F.coalesce(*[ok(c) for c in order], F.lit(NO_LABEL)))


def never_read(fields: DataFrame) -> DataFrame:
    """Add ``locked``: passwords, one-time codes, card security data."""
    auto = F.lower("autocomplete")
    hint = F.concat_ws(" ", "label", "name", "html_id", auto)
    locked = (F.lower("type") == "password") | auto.rlike(SECRET_AUTOCOMPLETE)
    for words in SECRET_HINTS:
        locked = locked | hint.rlike(words)
    return fields.withColumn("locked", locked)


def is_secret_control() -> Column:
    has = F.arrays_overlap(
        F.split(F.lower("autocomplete"), rf"[{R.SPACE}]+"), F.array(*[F.lit(w) for w in SECRET_CONTROL.split("|")])
    )
    return (F.lower("type") == "password") | has


def authentication_fields(fields: DataFrame, forms: DataFrame) -> DataFrame:
    """Add ``authentication``: sign-in identities, which must stay as they are.

    ``fields``: page_id, form_id (nullable), field_id, type, name, html_id,
    autocomplete, label.  ``forms``: page_id, form_id, action, html_id, name,
    aria_label, heading, submit_text.
    """
    hint = F.concat_ws(" ", "name", "html_id", "label")
    user = F.col("autocomplete").rlike(USER_AUTOCOMPLETE) | hint.rlike(R.whole_words(USER_WORDS))
    identity = hint.rlike(IDENTITY_HINT) | F.lower("type").isin("email", "tel")
    secrets = fields.filter(is_secret_control())
    pages = secrets.select("page_id").distinct().withColumn("_page_secret", F.lit(True))
    secret_forms = secrets.filter(F.col("form_id").isNotNull()).select("page_id", "form_id").distinct().withColumn("_form_secret", F.lit(True))
    wording = forms.select(
        "page_id", "form_id",
        F.concat_ws(" ", "action", "html_id", "name", "aria_label", "heading", "submit_text")
        .rlike(R.whole_words(LOGIN_WORDS)).alias("_login_form"),
    )
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return (
        fields.join(pages, "page_id", "left")
        .join(secret_forms, ["page_id", "form_id"], "left")
        .join(wording, ["page_id", "form_id"], "left")
        .withColumn(
            "authentication",
            user | (identity & yes("_page_secret")) | (F.col("form_id").isNotNull() & (yes("_form_secret") | yes("_login_form"))),
        )
        .drop("_page_secret", "_form_secret", "_login_form")
    )


# --- redaction of pages -----------------------------------------------------
def redact_fields(fields: DataFrame) -> DataFrame:
    """Kind per field: sign-in fields are skipped, secrets are recorded without a value."""
    judged = classify_values(fields.filter(~F.col("authentication")))
    secret_kind = F.when(F.col("kind").isin(*R.SECRET_KINDS), F.col("kind")).otherwise(F.lit("PASSWORD"))
    return judged.withColumn("kind", F.when(F.col("locked"), secret_kind).when(F.col("value") != "", F.col("kind"))).drop(
        "confidence", "never_read"
    )


def redact_nodes(texts: DataFrame, fields: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Redact visible texts and fields of pages; the page is the scope.

    ``texts``: page_id, node_ord, text, restricted, is_header, heading, preceding_label,
    sibling_label, reads_like_label (see :mod:`redactlake.sources.resolve`).  Returns
    (texts with ``redacted``, fields with ``kind`` and ``token``, token map).  A value
    below a table heading or beside a label is taken as a whole; other texts go
    through the text rules, without label rules in restricted places.
    """
    blank = F.lit("")
    near = lambda c: R.classify(F.col(c), F.col("text"), blank)
    by_table = F.when(F.col("heading") != "", near("heading"))
    by_account = F.when((near("preceding_label") == "ACCOUNT") | (near("sibling_label") == "ACCOUNT"), F.lit("ACCOUNT"))
    by_side = F.when(~F.col("restricted") & F.col("reads_like_label") & (F.col("heading") == ""), near("sibling_label"))
    judged_texts = texts.select(
        "page_id", "node_ord", "text", "restricted", "is_header", F.coalesce(by_table, by_account).alias("whole_kind"), by_side.alias("side_kind")
    )
    # only texts that the text rules leave unchanged fall back to the label beside them
    probe = redact_rows(judged_texts, "text", allow_labels=~F.col("restricted"), own_names=False, out="_probe")
    side = F.when(~F.col("is_header") & (F.col("_probe") == F.col("text")), F.col("side_kind"))
    texts = checkpointed(probe.withColumn("whole_kind", F.coalesce("whole_kind", side)).drop("_probe", "side_kind"))
    whole = texts.filter(~F.col("is_header") & F.col("whole_kind").isNotNull())

    def mention(df: DataFrame, kind: str, raw: str) -> DataFrame:
        real = df.filter(F.col(kind).isNotNull() & ~F.col(kind).isin(*R.SECRET_KINDS))
        return real.select(
            "page_id", F.col("node_ord").alias("item_ord"), F.lit(0).alias("phase"), F.lit(0).alias("pos"),
            F.col(kind).alias("kind"), R.trim(F.col(raw)).alias("raw"), R.norm_key(F.col(kind), F.col(raw)).alias("norm_key"),
        )

    extra = mention(whole, "whole_kind", "text")
    judged = None
    if fields is not None:
        judged = checkpointed(redact_fields(fields))
        extra = extra.unionByName(mention(judged, "kind", "value"))
    free = texts.filter(~F.col("is_header") & F.col("whole_kind").isNull())
    found = free.select("page_id", F.col("node_ord").alias("item_ord"), F.inline_outer("entities")).filter("kind IS NOT NULL").drop("token")
    items = free.select("page_id", "node_ord", "text", "restricted")
    done, tokens = redact_scopes(
        items, ["page_id"], "node_ord", "text", found=found, extra_entities=extra, allow_labels=~F.col("restricted")
    )
    lookup = tokens.select("page_id", F.col("kind").alias("_k"), F.col("norm_key").alias("_key"), "token")
    with_token = lambda df, kind, raw: df.withColumns(
        {"_k": F.col(kind), "_key": R.norm_key(F.col(kind), F.col(raw))}
    ).join(lookup, ["page_id", "_k", "_key"], "left").drop("_k", "_key")
    whole = with_token(whole, "whole_kind", "text")
    replaced = F.concat(
        F.regexp_extract("text", rf"^[{R.SPACE}]*", 0),
        F.when(F.col("whole_kind").isin(*R.SECRET_KINDS), F.lit(R.HIDDEN)).otherwise(F.col("token")),
        F.regexp_extract("text", rf"[{R.SPACE}]*\z", 0),
    )
    out = (
        done.select("page_id", "node_ord", "text", "redacted")
        .unionByName(whole.select("page_id", "node_ord", "text", replaced.alias("redacted")))
        .unionByName(texts.filter("is_header").select("page_id", "node_ord", "text", F.col("text").alias("redacted")))
    )
    return out, None if judged is None else with_token(judged, "kind", "value"), tokens


def page_contexts(texts: DataFrame, fields: DataFrame, tokens: DataFrame, cap: int | None = None) -> DataFrame:
    """Per page the outgoing text: redacted texts, then ``label: token`` per field, redacted once more.

    The last look knows the page's values and people.  ``is_safe`` tells that no
    stored value of the page is left in the context.  A page's texts come from one
    HTML value, so the ordered aggregation is bounded by that row.
    """
    shown = F.when(F.col("locked"), F.lit(R.HIDDEN)).otherwise(F.coalesce("token", "value"))
    lines = texts.select("page_id", F.lit(0).alias("part"), "node_ord", R.trim(F.col("redacted")).alias("line")).unionByName(
        fields.select("page_id", F.lit(1).alias("part"), "node_ord", F.concat(F.col("label"), F.lit(": "), shown).alias("line"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("part", "node_ord", "line")))
    joined = lines.groupBy("page_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("context"))
    joined = checkpointed(joined.withColumn("item_ord", F.lit(2147483647)))  # behind all texts of the page
    again, every = redact_more(joined, tokens, ["page_id"], "item_ord", "context")
    context = F.col("redacted") if cap is None else F.substring("redacted", 1, cap)
    again = checkpointed(again.select("page_id", context.alias("safe_context")))
    left = known_value_leaks(again, every, ["page_id"], [], "safe_context").select("page_id").distinct().withColumn("_left", F.lit(True))
    return null_safe_join(again, left, ["page_id"], "left").select("page_id", "safe_context", F.col("_left").isNull().alias("is_safe"))


def original_contexts(texts: DataFrame, fields: DataFrame, cap: int | None = None) -> DataFrame:
    """The same with originals, for the vault side only."""
    lines = texts.select("page_id", F.lit(0).alias("part"), "node_ord", F.col("text").alias("line")).unionByName(
        fields.select("page_id", F.lit(1).alias("part"), "node_ord", F.concat_ws(": ", "label", "value").alias("line"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("part", "node_ord", "line")))
    whole = F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")
    return lines.groupBy("page_id").agg((whole if cap is None else F.substring(whole, 1, cap)).alias("original_context"))
