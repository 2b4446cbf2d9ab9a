"""Text tables in, redacted tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_A_TASK = 20_000  # of rows that are dealt out anew
FEW_ROWS = 2_000  # not worth a shuffle


def spread(df: DataFrame) -> DataFrame:
    """A stored table, dealt out anew where few of its splits hold most rows.

    A file of one row group is one task however many rows it has, and the jobs on
    a row cost far more than reading it.  The rows of each split are counted first,
    which for Parquet takes no column.
    """
    splits = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n"))
    total, most = splits.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if total <= FEW_ROWS or most * cores <= 2 * total:
        return df
    dealt = df.repartition(max(4 * cores, -(-total // ROWS_A_TASK)))
    # always true, and not deterministic: no filter on a costly column may move below the shuffle
    return dealt.filter(F.spark_partition_id() >= 0)


def text_items(df: DataFrame, scope: str, ord_col: str | None, text: str) -> DataFrame:
    """Any text table as ``scope_id, item_ord, text``."""
    item = F.lit(0).cast("bigint") if ord_col is None else F.col(ord_col).cast("bigint")
    return df.select(F.col(scope).alias("scope_id"), item.alias("item_ord"), F.col(text).alias("text"))


#: Columns of the jobs that never hold an original value.
SAFE_COLUMNS = (
    "scope", "scope_id", "item_id", "item_ord", "doc_id", "conv_id", "turn", "page_id", "node_ord", "chunk_ord", "field_id", "lang", "source",
    "redacted", "safe_context", "kind", "kinds", "token", "n", "mentions", "locked", "is_safe",
)


def write_redacted(df: DataFrame, path: str, columns: tuple[str, ...] = SAFE_COLUMNS) -> None:
    """Write a redacted table: of its columns only those that ``columns`` allows."""
    kept = [c for c in df.columns if c in columns]
    if not kept:
        raise ValueError("none of the columns may be written")
    df.select(*kept).write.mode("overwrite").parquet(path)


def write_review(df: DataFrame, path: str) -> None:
    """Write a review list.  It shows original values, so it needs the access rules of the source."""
    df.write.mode("overwrite").parquet(path)


def write_vault(tokens: DataFrame, path: str, *, i_want_raw_values: bool = False) -> None:
    """Write the token map with its raw values, only on explicit request."""
    if not i_want_raw_values:
        raise ValueError("the vault holds raw values; pass i_want_raw_values=True to write it")
    tokens.write.mode("overwrite").parquet(path)
