"""Proportional stratified interleaving into shards.

Rows of each source are ranked in a seeded random order; sorting all rows by
their fractional rank ``(rank - 1/2) / rows of the source`` interleaves the
sources in proportion at every scale; cutting that order into equal runs gives
shards whose row counts differ by one at most and whose mixture of sources is
that of the whole.

Both orders are spread evenly by construction, so a source that holds a third of
the rows is ranked by thousands of slices (see :mod:`ranks`).

Defined cases: null sources are a source of their own; null ids and repeated
rows are ranked like any others (rows that agree in everything that the order
sees are interchangeable); fewer rows than shards leave shards empty; an input
column that is named like a result is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactlake.llm.ranks import SLICES, hash_slice, sliced_rank
from redactlake.llm.tables import group_key, replace_columns, staged


def stratified_shards(df: DataFrame, shards: int, key: Column, source: str = "source", seed: int = 42) -> DataFrame:
    """``df`` with ``position`` (from 0), ``shard`` and ``slot`` (from 0 in the shard).

    ``key`` names a row for the shuffle; it should tell rows apart.  The input
    is staged once in the shared folder, because both ranks read it.
    """
    keep = replace_columns(df, ["position", "shard", "slot"])
    packed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), group_key(source).alias("g"), F.xxhash64(F.lit(seed), key).alias("h"),
        F.hash(F.lit(seed), key).alias("h2"),
    )
    ranked = sliced_rank(staged(packed, "rows"), hash_slice("h"), ["h", "h2"], ["g"], "rank", total="of")
    ranked = staged(ranked.withColumn("fraction", (F.col("rank") - 0.5) / F.col("of")), "ranked")
    placed = sliced_rank(ranked, F.floor(F.col("fraction") * SLICES).cast("int"), ["fraction", "g", "rank"], name="place")
    # the number of rows from the files' footers of the staged table
    n = max(ranked.count(), 1)
    position = F.col("place") - 1
    exact = placed.withColumn("position", position).withColumn("shard", F.expr(f"CAST((CAST(position AS DECIMAL(19, 0)) * {shards}) div {n} AS INT)"))
    start = F.expr(f"CAST((CAST(shard AS DECIMAL(19, 0)) * {n} + {shards - 1}) div {shards} AS BIGINT)")
    return exact.select(*[F.col("row")[c].alias(c) for c in keep], "position", "shard", (F.col("position") - start).alias("slot"))
