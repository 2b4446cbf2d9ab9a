"""Token numbering over entity tables, for scopes that span many rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactlake.functions import rules as R
from redactlake.operators.joins import null_safe_join
from redactlake.operators.ordered import DENSE, carry_last, ordered_rank
from redactlake.operators.redaction import name_parts
from redactlake.session import checkpointed

SEQ = ("item_ord", "phase", "pos")


def _seq():
    return F.struct(*[F.col(c) for c in SEQ])


def first_mentions(entities: DataFrame, scope: Sequence[str]) -> DataFrame:
    """One row per distinct (scope, kind, norm_key): first and last place, last spelling, mentions.

    Aggregated before the shuffle, so a hot scope or value costs one row per task.
    """
    return entities.groupBy(*scope, "kind", "norm_key").agg(
        F.min(_seq()).alias("first_seq"),
        F.max(_seq()).alias("last_seq"),
        F.max_by(R.trim(F.col("raw")), _seq()).alias("value"),
        F.count(F.lit(1)).alias("mentions"),
    )


def assign_tokens(
    entities: DataFrame, scope: Sequence[str] = (), *, aliases: bool = True, radix: Sequence[int] = DENSE
) -> DataFrame:
    """Token map: one numbered token per distinct value and kind of a scope.

    ``entities`` needs ``item_ord, phase, pos, kind, raw, norm_key`` besides the
    scope columns; an empty scope numbers the whole corpus.  Numbers follow the
    first appearance.  Names that are aliases of one earlier person share a token.
    """
    scope = list(scope)
    # Stored once: the ranking reads the distinct values twice, and a second read
    # would repeat the whole detection.
    keys = checkpointed(first_mentions(entities, scope))
    if aliases:
        leaders = resolve_person_aliases(entities.filter(F.col("kind") == "PERSON"), scope)
        keys = null_safe_join(
            keys, leaders.select(*scope, F.lit("PERSON").alias("kind"), "norm_key", "leader"), [*scope, "kind", "norm_key"], "left"
        )
    else:
        keys = keys.withColumn("leader", F.lit(None).cast("string"))
    keys = keys.withColumn("leader", F.coalesce("leader", "norm_key")).withColumn(
        "item_ord", F.col("first_seq.item_ord")
    )
    numbered = ordered_rank(
        keys.filter(F.col("leader") == F.col("norm_key")), [*scope, "kind"], "item_ord", ["first_seq"], radix=radix
    )
    if aliases:
        numbers = numbered.select(*scope, "kind", F.col("norm_key").alias("leader"), "n")
        numbered = null_safe_join(keys, numbers, [*scope, "kind", "leader"])
    return numbered.select(
        *scope, "kind", "norm_key", "n",
        F.concat_ws("_", "kind", F.col("n").cast("string")).alias("token"),
        "value", "first_seq", "last_seq", "mentions",
    )


def extend_tokens(
    tokens: DataFrame, entities: DataFrame, scope: Sequence[str] = (), *, aliases: bool = True, radix: Sequence[int] = DENSE
) -> DataFrame:
    """Rows that ``entities`` add to a token map, in its columns.

    Values that the map holds keep their tokens and give no row.  New ones go on
    after the highest number of their scope and kind, in order of appearance; a new
    name whose known words all belong to one person of the map, or to one new
    person before it, takes that person's token.
    """
    scope = list(scope)
    old = tokens.select(*scope, "kind", "norm_key", F.lit(True).alias("_old"))
    mentions = null_safe_join(first_mentions(entities, scope), old, [*scope, "kind", "norm_key"], "left")
    fresh = checkpointed(mentions.filter(F.col("_old").isNull()).drop("_old").withColumn("item_ord", F.col("first_seq.item_ord")))
    if aliases:
        people = tokens.filter(F.col("kind") == "PERSON")
        # names of one token are one person, who goes by the first of them
        persons = people.groupBy(*scope, "n").agg(F.min_by("norm_key", "first_seq").alias("leader"))
        held = checkpointed(null_safe_join(people, persons, [*scope, "n"]).select(*scope, "norm_key", "leader", "last_seq"))
        words = held.select(*scope, "norm_key", "last_seq", F.explode(name_parts(F.col("norm_key"))).alias("part"))
        last = words.groupBy(*scope, "part").agg(F.max_by("norm_key", "last_seq").alias("norm_key"))
        before = last.select(
            *scope, F.lit(-1).cast("bigint").alias("item_ord"), F.lit(0).alias("phase"), F.lit(0).alias("pos"), "norm_key", "part"
        )
        named = entities.filter(F.col("kind") == "PERSON")
        leaders = resolve_person_aliases(named, scope, radix, before, held.select(*scope, "norm_key", "leader")).select(
            *scope, F.lit("PERSON").alias("kind"), "norm_key", "leader"
        )
        fresh = null_safe_join(fresh, leaders, [*scope, "kind", "norm_key"], "left")
    else:
        fresh = fresh.withColumn("leader", F.lit(None).cast("string"))
    fresh = fresh.withColumn("leader", F.coalesce("leader", "norm_key"))
    # a leader that the map holds brings its token
    known = tokens.select(*scope, "kind", F.col("norm_key").alias("leader"), F.col("n").alias("_n"))
    fresh = null_safe_join(fresh, known, [*scope, "kind", "leader"], "left")
    top = tokens.groupBy(*scope, "kind").agg(F.max("n").alias("_top"))
    ranked = ordered_rank(
        fresh.filter(F.col("_n").isNull() & (F.col("leader") == F.col("norm_key"))), [*scope, "kind"], "item_ord", ["first_seq"], radix=radix
    )
    ranked = null_safe_join(ranked, top, [*scope, "kind"], "left").select(
        *scope, "kind", "leader", (F.col("n") + F.coalesce("_top", F.lit(0))).alias("_new")
    )
    numbered = null_safe_join(fresh, ranked, [*scope, "kind", "leader"], "left").withColumn("n", F.coalesce("_n", "_new"))
    return numbered.select(
        *scope, "kind", "norm_key", "n", F.concat_ws("_", "kind", F.col("n").cast("string")).alias("token"),
        "value", "first_seq", "last_seq", "mentions",
    )


def token_mentions(mentions: DataFrame, tokens: DataFrame, scope: Sequence[str] = (), **options) -> tuple[DataFrame, DataFrame]:
    """``mentions`` with the ``token`` of each, and the token map that holds them all.

    Mentions are entities with any further columns: marks that people set, details
    seen on pictures.  They share the scope's numbers with what the map holds.
    """
    scope = list(scope)
    every = checkpointed(tokens.unionByName(extend_tokens(tokens, mentions, scope, **options)))
    return null_safe_join(mentions, every.select(*scope, "kind", "norm_key", "token"), [*scope, "kind", "norm_key"]), every


def no_tokens(entities: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """An empty token map for the scopes of an entity table."""
    return assign_tokens(entities.limit(0), scope, aliases=False)


def resolve_person_aliases(
    persons: DataFrame, scope: Sequence[str], radix: Sequence[int] = DENSE, before: DataFrame | None = None, held: DataFrame | None = None
) -> DataFrame:
    """Leader of every distinct name: itself, or the earlier person it stands for.

    ``held`` has the names that are settled already (scope, ``norm_key``, ``leader``),
    which get no row, and ``before`` their uses of name parts (scope, order,
    ``norm_key``, ``part``).

    When a name first appears, each of its words points to the name that last
    used that word as a name part.  If all these point to one person, the name is
    an alias of that person.  The pointers are followed by pointer jumping, so a
    chain of aliases takes a logarithmic number of rounds.
    """
    scope = list(scope)
    seen = persons.select(
        *scope, *SEQ, "norm_key",
        F.split("norm_key", rf"[{R.SPACE}]+").alias("words"),
        name_parts(F.col("norm_key")).alias("parts"),
    )
    seen = checkpointed(seen)  # read by both sides below
    firsts = seen.groupBy(*scope, "norm_key").agg(
        F.min(_seq()).alias("s"), F.first("words").alias("words")
    )
    asks = firsts.select(
        *scope, F.col("s.*"), F.explode(F.array_distinct("words")).alias("part"),
        F.col("norm_key").alias("asker"), F.lit(None).cast("string").alias("user"), F.lit(0).alias("turn"),
    )
    uses = seen.select(
        *scope, *SEQ, F.explode("parts").alias("part"),
        F.lit(None).cast("string").alias("asker"), F.col("norm_key").alias("user"), F.lit(1).alias("turn"),
    )
    if before is not None:
        earlier = before.select(*scope, *SEQ, "part", F.lit(None).cast("string").alias("asker"), F.col("norm_key").alias("user"), F.lit(1).alias("turn"))
        uses = uses.unionByName(earlier)
    answered = carry_last(
        asks.unionByName(uses), [*scope, "part"], "item_ord", [*SEQ, "turn"], "user", "points_to", radix
    ).filter(F.col("asker").isNotNull() & F.col("points_to").isNotNull())
    points = answered.groupBy(*scope, F.col("asker").alias("norm_key")).agg(
        F.collect_set("points_to").alias("ptr")  # at most one per word of the name
    )
    nodes = null_safe_join(firsts.select(*scope, "norm_key"), points, [*scope, "norm_key"], "left")
    nodes = nodes.select(
        *scope, "norm_key",
        F.coalesce("ptr", F.array().cast("array<string>")).alias("ptr"),
        F.when(F.col("ptr").isNull(), F.col("norm_key")).alias("leader"), F.lit(False).alias("settled"),
    )
    if held is not None:
        settled = held.select(*scope, "norm_key", F.array().cast("array<string>").alias("ptr"), "leader", F.lit(True).alias("settled"))
        nodes = settled.unionByName(
            null_safe_join(nodes, settled.select(*scope, "norm_key", F.lit(1).alias("_s")), [*scope, "norm_key"], "left").filter("_s IS NULL").drop("_s")
        )
    while True:
        nodes = checkpointed(nodes)
        open_ = nodes.filter(F.col("leader").isNull())
        if open_.isEmpty():
            return nodes.filter(~F.col("settled")).select(*scope, "norm_key", "leader")
        target = nodes.select(
            *scope, F.col("norm_key").alias("p"), F.col("leader").alias("p_leader"),
            F.when(F.col("leader").isNull() & (F.size("ptr") == 1), F.get("ptr", F.lit(0))).alias("p_next"),
        )
        step = (
            null_safe_join(open_.select(*scope, "norm_key", F.explode("ptr").alias("p")), target, [*scope, "p"])
            .groupBy(*scope, "norm_key")
            .agg(
                F.collect_set(F.coalesce("p_leader", "p_next", "p")).alias("ptr"),
                F.bool_and(F.col("p_leader").isNotNull()).alias("_done"),
            )
            .select(
                *scope, "norm_key", "ptr",
                F.when(
                    F.col("_done"),
                    F.when(F.size("ptr") == 1, F.get("ptr", F.lit(0))).otherwise(F.col("norm_key")),
                ).alias("leader"),
                F.lit(False).alias("settled"),
            )
        )
        nodes = nodes.filter(F.col("leader").isNotNull()).unionByName(step)


def known_tokens(entities: DataFrame, tokens: DataFrame, scope: Sequence[str], item: Sequence[str]) -> DataFrame:
    """Per item the map "KIND:key" -> token of everything mentioned in it."""
    scope, item = list(scope), list(item)
    distinct = entities.select(*scope, *item, "kind", "norm_key").distinct()
    pair = F.struct(F.concat_ws(":", "kind", "norm_key").alias("k"), F.col("token").alias("v"))
    return (
        null_safe_join(distinct, tokens.select(*scope, "kind", "norm_key", "token"), [*scope, "kind", "norm_key"])
        .groupBy(*scope, *item)
        .agg(F.map_from_entries(F.collect_set(pair)).alias("known"))
    )


def restore(redacted: DataFrame, vault: DataFrame, item: Sequence[str], text: str = "redacted") -> DataFrame:
    """Give items their original text back where they still show our redacted text.

    ``vault`` holds ``item`` columns, ``original`` and ``shown`` (the text we wrote).
    """
    joined = null_safe_join(redacted, vault.select(*item, "original", "shown"), list(item), "left")
    same = F.col(text).eqNullSafe(F.col("shown")) & F.col("original").isNotNull()
    return joined.withColumn(
        "restored", F.when(same, F.col("original")).otherwise(F.col(text))
    ).drop("original", "shown")


def entity_counts(entities: DataFrame, by: Sequence[str], value_scope: Sequence[str]) -> DataFrame:
    """Mentions and distinct values per group; values are distinct within their scope.

    Two plain aggregations: the first one shrinks the rows to distinct values
    before anything is counted, so no group is ever gathered.
    """
    by, keys = list(by), list(dict.fromkeys([*by, *value_scope, "norm_key"]))
    values = entities.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"))
    return values.groupBy(*by).agg(
        F.sum("m").alias("mentions"), F.count(F.lit(1)).alias("distinct_values")
    )
