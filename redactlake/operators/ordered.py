"""Ordered numbering and carrying inside groups of any size.

A plain window partitioned by a group puts the whole group into one task.  Here
every group is cut into spans of its integer order column; the window runs per
(group, span), and the much smaller per-span summaries are carried forward.
Spans follow from the data alone, so a recomputed task gives the same result.

``radix`` lists the bit shifts of the span levels.  ``(16,)`` suits dense orders
(row numbers, turns); ``(16, 32, 48)`` bounds every window to 65,536 summaries
for arbitrary 64-bit orders.  ``LOAD`` cuts at quantiles of the order column
instead: at most ``LOAD_SPANS`` spans of about equal load, however the values lie,
for hashed ids and other sparse orders; it costs a pass over that column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactlake.operators.joins import null_safe_join

DENSE = (16,)
SPARSE = (16, 32, 48)
LOAD = (-1,)
LOAD_SPANS = 1024


def _by_load(df: DataFrame, ord_col: str) -> Column:
    """Number of the quantiles that are not above a row's order; equal orders share it, and it never falls."""
    order = F.col(ord_col).cast("double")
    shares = [i / LOAD_SPANS for i in range(1, LOAD_SPANS)]
    found = df.select(order.alias("o")).approxQuantile("o", shares, 0.5 / LOAD_SPANS)
    bounds = sorted(set(found))
    if not bounds:
        return F.lit(0).cast("bigint")
    listed = F.split(F.lit(",".join(map(repr, bounds))), ",").cast("array<double>")  # folded to one constant

    def halve(span: Column, _: Column) -> Column:
        middle = F.floor((span["lo"] + span["hi"]) / 2).cast("int")
        reached = (span["lo"] < span["hi"]) & F.coalesce(F.get(listed, middle) <= order, F.lit(False))
        return F.struct(F.when(reached, middle + 1).otherwise(span["lo"]).alias("lo"), F.when(reached, span["hi"]).otherwise(middle).alias("hi"))

    steps = F.sequence(F.lit(0), F.lit(len(bounds).bit_length()))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(steps, start, halve, lambda span: span["lo"].cast("bigint"))


def _spans(df: DataFrame, ord_col: str, radix: Sequence[int]) -> DataFrame:
    if tuple(radix) == LOAD:
        return df.withColumn("_span0", _by_load(df, ord_col))
    return df.withColumns(
        {f"_span{i}": F.shiftright(F.col(ord_col).cast("bigint"), b) for i, b in enumerate(radix)}
    )


def _earlier(window_by: list[str], level: str):
    return Window.partitionBy(*window_by).orderBy(level).rowsBetween(Window.unboundedPreceding, -1)


def ordered_rank(
    df: DataFrame, by: Sequence[str], ord_col: str, order: Sequence[Column | str], name: str = "n",
    radix: Sequence[int] = DENSE,
) -> DataFrame:
    """Exact ``row_number`` per group; ``order`` must refine ``ord_col``."""
    by = list(by)
    spans = [f"_span{i}" for i in range(len(radix))]
    cut = _spans(df, ord_col, radix)
    counts = cut.groupBy(*by, *spans).agg(F.count(F.lit(1)).alias("_c"))
    offset = F.lit(0)
    for i in reversed(range(len(radix))):
        # rows before this span among its siblings; siblings are summed up to their level first
        upper = spans[i + 1 :]
        level = counts.groupBy(*by, *spans[i:]).agg(F.sum("_c").alias("_c"))
        level = level.select(
            *by, *spans[i:],
            F.coalesce(F.sum("_c").over(_earlier(by + upper, spans[i])), F.lit(0)).alias(f"_o{i}"),
        )
        counts = null_safe_join(counts, level, by + spans[i:]) if len(radix) > 1 else level
        offset = offset + F.col(f"_o{i}")
    offsets = counts.select(*by, *spans, offset.alias("_before"))
    inside = Window.partitionBy(*by, *spans).orderBy(*order)
    return (
        null_safe_join(cut.withColumn("_rn", F.row_number().over(inside)), offsets, by + spans)
        .withColumn(name, (F.col("_rn") + F.col("_before")).cast("bigint"))
        .drop("_rn", "_before", *spans)
    )


def carry_last(
    df: DataFrame, by: Sequence[str], ord_col: str, order: Sequence[Column | str], value: str, name: str,
    radix: Sequence[int] = DENSE,
) -> DataFrame:
    """Last non-null ``value`` at or before each row in its group."""
    by = list(by)
    spans = [f"_span{i}" for i in range(len(radix))]
    cut = _spans(df, ord_col, radix)
    seq = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    summary = (
        cut.filter(F.col(value).isNotNull())
        .groupBy(*by, *spans)
        .agg(F.max_by(value, seq).alias("_v"))
    )
    carried = null_safe_join(cut.select(*by, *spans).distinct(), summary, by + spans, "left")
    # innermost level first: last value of an earlier sibling span, else of an earlier parent span
    found = None
    for i in range(len(radix)):
        upper = spans[i + 1 :]
        level = carried.groupBy(*by, *spans[i:]).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(spans[0]))).alias("_lv"))
        level = level.select(
            *by, *spans[i:],
            F.last("_lv", ignorenulls=True).over(_earlier(by + upper, spans[i])).alias(f"_c{i}"),
        )
        found = null_safe_join(carried.select(*by, *spans) if found is None else found, level, by + spans[i:])
    before = F.coalesce(*[F.col(f"_c{i}") for i in range(len(radix))])
    inside = Window.partitionBy(*by, *spans).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        null_safe_join(
            cut.withColumn("_in", F.last(value, ignorenulls=True).over(inside)), found.select(*by, *spans, before.alias("_before")), by + spans
        )
        .withColumn(name, F.coalesce("_in", "_before"))
        .drop("_in", "_before", *spans)
    )
