"""Exact ranks in an order that is spread evenly, such as the order of a hash.

The order is cut into a fixed number of slices of equal range.  A row's rank is
the count of the earlier slices plus its place in its own slice, so a group of
any size is ranked by many tasks, and a lost task repeats only its slices.

Defined cases: rows that agree in the order get different ranks, in any order
among them; an empty table gives an empty result; other columns are carried, those
named like a result replaced; group columns must not hold nulls (see ``group_key``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 4096


def sliced_rank(
    df: DataFrame, slice_: Column, order: Sequence[str | Column], group: Sequence[str] = (), name: str = "rank", total: str | None = None
) -> DataFrame:
    """``df`` with the row number (from 1) in ``order`` within each group, and the group's size as ``total``.

    ``slice_`` is an int that never falls along ``order``; a group has at most
    ``SLICES`` of them.  Group columns hold no nulls.
    """
    group = list(group)
    cut = df.withColumn("_slice", slice_)
    counts = cut.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *group, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_all")
    )
    inside = Window.partitionBy(*group, "_slice").orderBy(*order)
    # joined before the window: both need the rows dealt by group and slice, so rows move once
    ranked = cut.join(offsets, [*group, "_slice"]).withColumn("_at", F.row_number().over(inside))
    ranked = ranked.withColumn(name, (F.col("_at") + F.col("_before")).cast("bigint"))
    if total:
        ranked = ranked.withColumn(total, F.col("_all"))
    return ranked.drop("_slice", "_at", "_before", "_all")


def hash_slice(h: str) -> Column:
    """Slice of a 64-bit hash, rising with the signed hash."""
    return (F.shiftright(h, 52) + 2048).cast("int")
