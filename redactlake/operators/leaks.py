"""Stored values that a text still holds.

A join of all values of a scope with all its texts would grow with their product.
Here every value is filed under its rarest piece of three characters and meets only
the texts that hold that piece; the whole value is then looked for in those texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactlake.operators.joins import null_safe_join
from redactlake.session import checkpointed

PIECE = 3


def pieces(text: Column) -> Column:
    """Distinct pieces of ``PIECE`` characters; the characters are cut apart once."""

    def joined(chars: Column) -> Column:
        starts = F.when(F.size(chars) >= PIECE, F.sequence(F.lit(0), F.size(chars) - PIECE)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(*[F.get(chars, i + k) for k in range(PIECE)]))

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.array_distinct(F.element_at(F.transform(F.array(chars), joined), 1))


def known_value_leaks(items: DataFrame, values: DataFrame, scope: Sequence[str], item: Sequence[str], text: str = "redacted") -> DataFrame:
    """``scope, item, value`` for every value of the scope that an item's text contains, letter case and all.

    ``values`` has the scope columns and ``value``; values of fewer than three characters are left out.
    """
    scope, item = list(scope), list(item)
    wanted = checkpointed(values.select(*scope, "value").filter(F.length("value") >= PIECE).distinct())
    filed = wanted.select(*scope, "value", F.explode(pieces(F.col("value"))).alias("piece"))
    held = items.select(*scope, *item, F.explode(pieces(F.col(text))).alias("piece"))
    held = checkpointed(null_safe_join(held, filed.select(*scope, "piece").distinct(), [*scope, "piece"], "left_semi"))
    counts = held.groupBy(*scope, "piece").agg(F.count(F.lit(1)).alias("n"))
    # a value with a piece that no text holds is in none
    rarest = null_safe_join(filed, counts, [*scope, "piece"], "left").groupBy(*scope, "value").agg(
        F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("piece")
    )
    maybe = null_safe_join(held, rarest, [*scope, "piece"]).drop("piece")
    return null_safe_join(maybe, items.select(*scope, *item, F.col(text).alias("_text")), [*scope, *item]).filter(F.contains("_text", "value")).drop("_text")
