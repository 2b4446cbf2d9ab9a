"""Joins whose keys may be null."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null equals null; the keys come from the left side."""
    keys = list(keys)
    other = right.select(*[right[k].alias(f"_r{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"_r{i}"]) for i, k in enumerate(keys)])
    return left.join(other, same, how).drop(*[f"_r{i}" for i in range(len(keys))])
