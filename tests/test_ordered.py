"""Numbering and carrying across spans, with one group holding most rows."""

import random

import pytest

from redactlake.operators import ordered
from redactlake.operators.ordered import DENSE, LOAD, SPARSE, carry_last, ordered_rank


def _rows(wide):
    rng = random.Random(5)
    orders = rng.sample(range(-(2**50), 2**50) if wide else range(400000), 300)
    return [("hot" if i % 3 else f"g{i % 7}", o, rng.choice([None, f"v{i}"])) for i, o in enumerate(orders)]


@pytest.mark.parametrize("radix,wide", [(DENSE, False), (SPARSE, True), (LOAD, True), (LOAD, False)])
def test_rank_and_carry(spark, radix, wide):
    rows = _rows(wide)
    df = spark.createDataFrame(rows, "g string, o long, v string").repartition(7)
    rank, carried = {}, {}
    for g in {r[0] for r in rows}:
        last = None
        for n, (_, o, v) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1]), 1):
            last = v or last
            rank[g, o], carried[g, o] = n, last
    got = ordered_rank(df, ["g"], "o", ["o"], radix=radix).collect()
    assert {(r.g, r.o): r.n for r in got} == rank
    got = carry_last(df, ["g"], "o", ["o"], "v", "c", radix=radix).collect()
    assert {(r.g, r.o): r.c for r in got} == carried


def test_hashed_orders_make_few_spans(spark):
    df = spark.range(20_000).selectExpr("xxhash64(id) AS o", "1 AS g")
    assert ordered._spans(df, "o", LOAD).select("_span0").distinct().count() <= ordered.LOAD_SPANS
    sizes = ordered._spans(df, "o", LOAD).groupBy("_span0").count().agg({"count": "max"}).first()[0]
    assert sizes < 5 * 20_000 / ordered.LOAD_SPANS
    assert ordered._spans(df.limit(0), "o", LOAD).count() == 0
