"""Redaction of scopes that span many items (conversations, pages).

Items of one scope share tokens and known names.  No scope is ever gathered in
one place: entities are found per item, numbered with span windows, and the
item is rewritten with the finished tokens.  The look-back of the amount test
sees the final tokens.  Entities that only this look uncovers are numbered after
the scope's highest, and the items that hold them are looked at again, until none
is new.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactlake.operators.joins import null_safe_join
from redactlake.operators.ordered import DENSE, carry_last
from redactlake.operators.redaction import name_parts, redact_rows, replace_names
from redactlake.operators.tokens import assign_tokens, extend_tokens, known_tokens
from redactlake.session import checkpointed

_RUN = r"[\p{L}\p{N}_]+"
_CORE = rf"^[^\p{{L}}\p{{N}}_]*({_RUN}(?:.*{_RUN})?)[^\p{{L}}\p{{N}}_]*\z"


def item_entities(items: DataFrame, scope: Sequence[str], ord_col: str, text: str, **options) -> DataFrame:
    """Entities of every item with the order columns the numbering needs."""
    allow = options.pop("allow_labels", True)
    allow = allow if isinstance(allow, Column) else F.lit(allow)
    rows = items.select(*scope, ord_col, text, allow.alias("_labels_ok"))
    rows = redact_rows(rows, text, own_names=False, allow_labels=F.col("_labels_ok"), **options)
    return (
        rows.select(*scope, F.col(ord_col).alias("item_ord"), F.inline_outer("entities"))
        .filter(F.col("kind").isNotNull())
        .drop("token")
    )


def redact_scopes(
    items: DataFrame,
    scope: Sequence[str],
    ord_col: str = "item_ord",
    text: str = "text",
    *,
    found: DataFrame | None = None,
    extra_entities: DataFrame | None = None,
    two_pass_names: bool = True,
    radix: Sequence[int] = DENSE,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Rewrite all items; returns (items with ``redacted``, token map).

    ``found`` holds the items' entities if they are known already.  ``extra_entities`` adds mentions from elsewhere (form fields, table cells)
    that take part in the numbering and in the known names.
    """
    scope = list(scope)
    if found is None:
        found = item_entities(items, scope, ord_col, text, **options)
    if extra_entities is not None:
        found = found.unionByName(extra_entities.select(found.columns))
    found = checkpointed(found)
    tokens = checkpointed(assign_tokens(found, scope, radix=radix))
    done, found, tokens = _rewritten(items, found, tokens, scope, ord_col, text, radix, options)
    people = found.filter(F.col("kind") == "PERSON")
    if people.isEmpty():
        return done, tokens
    named = substitute_names(done, people, tokens, scope, ord_col, text, two_pass_names, radix)
    return named, tokens


def redact_more(
    items: DataFrame, tokens: DataFrame, scope: Sequence[str], ord_col: str = "item_ord", text: str = "text", *, radix: Sequence[int] = DENSE, **options
) -> tuple[DataFrame, DataFrame]:
    """Rewrite further items of scopes whose token map is there already; returns (items with ``redacted``, whole token map).

    Known values and names keep their tokens, new ones go on after the highest; an
    item sees all names whose first place is not behind its own.
    """
    scope = list(scope)
    found = checkpointed(item_entities(items, scope, ord_col, text, **options))
    tokens = checkpointed(tokens.unionByName(extend_tokens(tokens, found, scope, radix=radix)))
    done, found, tokens = _rewritten(items, found, tokens, scope, ord_col, text, radix, options)
    people = tokens.filter(F.col("kind") == "PERSON").select(*scope, "first_seq.*", "norm_key")
    return substitute_names(done, people, tokens, scope, ord_col, text, False, radix), tokens


def _rewritten(
    items: DataFrame, found: DataFrame, tokens: DataFrame, scope: list[str], ord_col: str, text: str, radix: Sequence[int], options: dict
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items with ``redacted``, and all entities and tokens that this took.

    A round rewrites the items that still hold unnumbered entities, at first all;
    an item's entities grow with each of its rounds, so the rounds end.
    """
    finished, left = None, items
    while True:
        known = known_tokens(found, tokens, scope, ["item_ord"]).withColumnRenamed("item_ord", ord_col)
        joined = null_safe_join(left, known, [*scope, ord_col], "left")
        looked = redact_rows(
            joined.withColumn("known", F.coalesce("known", F.create_map().cast("map<string,string>"))),
            text, known=F.col("known"), own_names=False, **options,
        ).drop("known")
        looked = checkpointed(looked.withColumn("_late", F.filter("entities", lambda e: F.endswith(e["token"], F.lit("_0")))))
        ready = looked.filter(F.size("_late") == 0).drop("entities", "_late")
        finished = ready if finished is None else finished.unionByName(ready)
        late = looked.filter(F.size("_late") > 0)
        if late.isEmpty():
            return finished, found, tokens
        more = late.select(*scope, F.col(ord_col).alias("item_ord"), F.inline("_late")).drop("token")
        found = found.unionByName(more.select(found.columns))
        tokens = checkpointed(tokens.unionByName(extend_tokens(tokens, more, scope, radix=radix)))
        left = late.drop("redacted", "entities", "_late")


def _candidates(items: DataFrame, entries: DataFrame, scope: list[str], ord_col: str) -> DataFrame:
    """Which entries may stand in which items: (scope, order, entry).

    Every entry is filed under its rarest word, by the number of items of its scope
    that hold the word, and meets the items that hold that one.  Only distinct words
    travel, and of those only words of some entry go on; texts stay where they are.
    """
    spelled = entries.withColumn("words", F.array_distinct(F.regexp_extract_all("core", F.lit(_RUN), 0)))
    words = checkpointed(spelled.select(*scope, "entry", F.explode("words").alias("word"), F.size("words").alias("_size")))
    runs = F.array_distinct(F.regexp_extract_all(F.lower(F.col("redacted")), F.lit(_RUN), 0))
    said = items.select(*scope, ord_col, F.explode(runs).alias("word"))
    held = checkpointed(null_safe_join(said, words.select(*scope, "word").distinct(), [*scope, "word"], "left_semi"))
    counts = held.groupBy(*scope, "word").agg(F.count(F.lit(1)).alias("_items"))
    # an entry with a word that no item holds stands nowhere
    rarest = (
        null_safe_join(words, counts, [*scope, "word"])
        .groupBy(*scope, "entry")
        .agg(F.min_by("word", F.struct("_items", "word")).alias("word"), F.count(F.lit(1)).alias("_known"), F.first("_size").alias("_size"))
        .filter("_known = _size")
        .drop("_known", "_size")
    )
    return null_safe_join(held, rarest, [*scope, "word"]).drop("word")


def substitute_names(
    items: DataFrame, people: DataFrame, tokens: DataFrame, scope: Sequence[str], ord_col: str,
    text: str, two_pass: bool = True, radix: Sequence[int] = DENSE,
) -> DataFrame:
    """Replace known full names, then known name parts, in ``redacted``.

    An item sees the names known up to and including itself; items that are then
    still unchanged see all names of the scope.  Items meet the entries whose
    rarest word they hold; the replacement itself tests the whole entry.
    """
    scope = list(scope)
    person_tokens = tokens.filter(F.col("kind") == "PERSON").select(*scope, "norm_key", "token")
    said = null_safe_join(people.select(*scope, "item_ord", "phase", "pos", "norm_key"), person_tokens, [*scope, "norm_key"])
    full = said.groupBy(*scope, "norm_key", "token").agg(F.min(F.struct("item_ord", "phase", "pos")).alias("seq"))
    full = full.select(*scope, F.col("norm_key").alias("entry"), "token", "seq", F.lit(0).alias("rank"))
    part_uses = said.select(
        *scope, "item_ord", "phase", "pos", "token", F.posexplode(name_parts(F.col("norm_key"))).alias("at", "entry")
    )
    first_part = part_uses.groupBy(*scope, "entry").agg(
        F.min(F.struct("item_ord", "phase", "pos", "at")).alias("p"),
        F.max_by("token", F.struct("item_ord", "phase", "pos")).alias("token"),
    )
    parts = first_part.select(
        *scope, "entry", "token", F.struct("p.item_ord", "p.phase", "p.pos").alias("seq"),
        (F.lit(1) + F.col("p.at")).alias("rank"),
    )
    entries = checkpointed(
        full.unionByName(parts).withColumn("core", F.regexp_extract("entry", _CORE, 1)).filter(F.col("core") != "")
    )
    # a part that is also a full name is two entries under one spelling
    hits = null_safe_join(_candidates(items, entries.select(*scope, "entry", "core").distinct(), scope, ord_col), entries, [*scope, "entry"]).drop("core")
    # the token a part had when this item was read: its last use so far
    history = part_uses.select(
        *scope, "entry", F.col("item_ord").alias("_o"), "phase", "pos", F.lit(None).cast("bigint").alias("_item"),
        F.col("token").alias("was"),
    )
    asks = hits.filter(F.col("rank") > 0).select(
        *scope, "entry", F.col(ord_col).cast("bigint").alias("_o"), F.lit(2147483647).alias("phase"),
        F.lit(0).alias("pos"), F.col(ord_col).cast("bigint").alias("_item"), F.lit(None).cast("string").alias("was"),
    )
    then = (
        carry_last(history.unionByName(asks), [*scope, "entry"], "_o", ["_o", "phase", "pos"], "was", "then", radix)
        .filter(F.col("_item").isNotNull())
        .select(*scope, F.col("_item").alias(ord_col), "entry", "then")
    )
    hits = null_safe_join(hits, then, [*scope, ord_col, "entry"], "left")
    early = F.col("seq.item_ord") <= F.col(ord_col)
    token_then = F.when(F.col("rank") > 0, F.col("then")).otherwise(F.col("token"))
    entry = lambda tok: F.struct("seq", "rank", F.col("entry").alias("e"), tok.alias("token"))
    per_item = hits.groupBy(*scope, ord_col).agg(
        F.array_sort(F.collect_list(F.when(early & (F.col("rank") == 0), entry(token_then)))).alias("_n1"),
        F.array_sort(F.collect_list(F.when(early & (F.col("rank") > 0), entry(token_then)))).alias("_p1"),
        F.array_sort(F.collect_list(F.when(F.col("rank") == 0, entry(F.col("token"))))).alias("_n2"),
        F.array_sort(F.collect_list(F.when(F.col("rank") > 0, entry(F.col("token"))))).alias("_p2"),
    )
    shape = lambda c, f: F.coalesce(
        F.transform(c, lambda x: F.struct(x["e"].alias(f), x["token"].alias("token"))),
        F.array().cast(f"array<struct<{f}:string,token:string>>"),
    )
    out = null_safe_join(items, per_item, [*scope, ord_col], "left").withColumn(
        "_pass1", replace_names(F.col("redacted"), shape("_n1", "key"), shape("_p1", "part"))
    )
    final = F.col("_pass1")
    if two_pass:
        final = F.when(
            F.col("_pass1").eqNullSafe(F.col(text)),
            replace_names(F.col("redacted"), shape("_n2", "key"), shape("_p2", "part")),
        ).otherwise(F.col("_pass1"))
    return out.withColumn("redacted", final).drop("_pass1", "_n1", "_p1", "_n2", "_p2")
