"""Mixing sources to target weights by Pfair scheduling of blocks.

The rows of each source are put into a seeded random order and cut into blocks.
With weight ``w`` the i-th block of a source (from 0) is released at slot
``floor(i / w)`` and due by slot ``ceil((i + 1) / w)``.  Each slot takes the
released block with the earliest deadline.  Weights are not rounded: scaled to
the smallest whole numbers in their proportion, their sum is the period after
which the schedule repeats, and no source is ever a whole block away from its
share.  A float counts as the decimal number that it prints as.

The schedule is made on the driver, from the weights and the sources' row counts
(at most ``MOST_SOURCES``).  Up to ``PERIOD`` slots, one period is scheduled, and
a row finds its slot by arithmetic on its rank and a lookup in that period.  The
slots of a longer period are listed one by one as far as the blocks last, which
is one step of the driver for each block, and rows meet that list in a join.
When a source runs out, the others go on with their weights in the same
proportion as a new *phase*, so every row is placed exactly once.

Defined cases: null is a source of its own; a source without a given weight gets
``other`` (or the mean of the given weights); weight 0 puts a source behind all
others; repeated rows and null ids are placed like any others; an empty table
gives an empty result; an input column named like a result is replaced.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Mapping
from fractions import Fraction
from numbers import Rational

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactlake.llm.ranks import hash_slice, sliced_rank
from redactlake.llm.tables import group_key, replace_columns, staged

PERIOD = 1000
BLOCK_ROWS = 64
MOST_SOURCES = 1_000
_LISTED = 1024  # blocks in a row of the list of a long period


def exact(weight: float) -> Fraction:
    return Fraction(weight) if isinstance(weight, Rational) else Fraction(str(weight))


def shares(weights: Mapping[str, float]) -> dict[str, int]:
    """The smallest whole numbers in the proportion of the weights."""
    given = {s: exact(w) for s, w in weights.items()}
    scale = math.lcm(*(w.denominator for w in given.values()))
    whole = {s: int(w * scale) for s, w in given.items()}
    common = math.gcd(*whole.values())
    return {s: n // common for s, n in whole.items()}


def schedule(parts: Mapping[str, int], blocks: Mapping[str, int]) -> dict[str, array]:
    """Slots of each source's blocks, earliest deadline first, until a source has had its ``blocks``."""
    period = sum(parts.values())
    window = lambda s, i: (-(-(i + 1) * period // parts[s]), s, i)
    slots = {s: array("q") for s in parts}
    waiting = [(0, window(s, 0)) for s in parts]  # the next block of each source, by release
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            heapq.heappush(ready, heapq.heappop(waiting)[1])
        deadline, s, i = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a block is late")
        slots[s].append(slot)
        if i + 1 == blocks[s]:
            return slots
        heapq.heappush(waiting, ((i + 1) * period // parts[s], window(s, i + 1)))
        slot += 1


def one_period(parts: Mapping[str, int]) -> dict[str, list[int]]:
    """Slots of each source's blocks within one period, earliest deadline first."""
    period = sum(parts.values())
    # no source has its first block of the next period before that period
    slots = schedule(parts, {s: a + 1 for s, a in parts.items()})
    return {s: [x for x in slots[s] if x < period] for s in parts}


def phases(blocks: Mapping[str, int], weights: Mapping[str, float], period: int = PERIOD) -> list[tuple]:
    """``source, first block, blocks, shares, period, first slot, slots in a period`` for each source and phase.

    Periods of more than ``period`` slots are listed in full: the phase is then one period.
    """
    left, done, start, plan = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []
    while left:
        heavy = {s: weights[s] for s in left if weights[s] > 0} or {s: 1 for s in left}
        parts = shares(heavy)
        length = sum(parts.values())
        if length <= period:
            table = one_period(parts)
            last = lambda s: (left[s] - 1) // parts[s] * length + table[s][(left[s] - 1) % parts[s]]  # noqa: E731, B023
            end = min(last(s) for s in heavy) + 1
            counts = {s: end // length * parts[s] + sum(x < end % length for x in table[s]) for s in heavy}
        else:
            table = schedule(parts, left)
            counts = parts = {s: len(table[s]) for s in heavy}
            length = end = sum(counts.values())
        for s, n in counts.items():
            plan.append((s, done[s], n, parts[s], length, start, table[s]))
            done[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
        start += end
    return plan


def _listed(plan: list[tuple]) -> list[tuple]:
    """``source, number, slots`` of ``_LISTED`` blocks each, null for the blocks of other phases."""
    rows: dict[tuple[str, int], list] = {}
    for g, b0, nb, _, _, s0, slots in plan:
        for i in range(nb):
            k, at = divmod(b0 + i, _LISTED)
            rows.setdefault((g, k), [None] * _LISTED)[at] = s0 + slots[i]
    return [(g, k, slots) for (g, k), slots in rows.items()]


def _placed(
    df: DataFrame, weights: Mapping[str | None, float], key: Column, source: str, other: float | None, block_rows: int, period: int,
    seed: int, stage_input: bool,
) -> DataFrame:
    """``row`` (a struct of all columns), ``block``, ``slot`` and ``position``."""
    spark = df.sparkSession
    packed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), group_key(source).alias("g"), F.xxhash64(F.lit(seed), key).alias("h"),
        F.hash(F.lit(seed), key).alias("h2"),
    )
    packed = staged(packed, "rows") if stage_input else packed
    sizes = {r["g"]: r["n"] for r in packed.groupBy("g").agg(F.count(F.lit(1)).alias("n")).limit(MOST_SOURCES + 1).collect()}
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; map them to fewer first")
    given = {"-" if s is None else f"+{s}": exact(w) for s, w in weights.items()}
    rest = exact(other) if other is not None else (sum(given.values()) / len(given) if given else Fraction(1))
    plan = phases({g: -(-n // block_rows) for g, n in sizes.items()}, {g: given.get(g, rest) for g in sizes}, period)
    lists = [p for p in plan if p[4] > period]
    # bounded by the sources and the period
    table = spark.createDataFrame(
        [(*p[:6], [] if p[4] > period else list(p[6])) for p in plan], "g string, b0 long, nb long, parts long, length long, s0 long, slots array<long>"
    )
    # rows that short last blocks leave out before a slot
    ends = {}
    for g, b0, nb, parts, length, s0, slots in plan:
        if nb and b0 + nb == -(-sizes[g] // block_rows):
            i = nb - 1
            ends[s0 + i // parts * length + slots[i % parts]] = -sizes[g] % block_rows
    gaps = [(s, e) for s, e in sorted(ends.items()) if e]

    ranked = sliced_rank(packed, hash_slice("h"), ["h", "h2"], ["g"], "rank")
    ranked = ranked.withColumn("block", F.expr(f"(rank - 1) div {block_rows}"))
    fits = (ranked["g"] == table["g"]) & (ranked["block"] >= table["b0"]) & (ranked["block"] < table["b0"] + table["nb"])
    placed = ranked.join(F.broadcast(table), fits).drop(table["g"])
    placed = placed.withColumn("slot", F.expr("s0 + (block - b0) div parts * length + get(slots, CAST((block - b0) % parts AS INT))"))
    if lists:
        long = spark.createDataFrame(_listed(lists), "g string, k long, listed array<long>")
        placed = placed.withColumn("k", F.expr(f"block div {_LISTED}")).join(long, ["g", "k"], "left")
        placed = placed.withColumn("slot", F.coalesce(F.expr(f"listed[CAST(block % {_LISTED} AS INT)]"), "slot"))
    missing = F.lit(0).cast("bigint")
    if gaps:
        listed = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(e).alias("e")) for s, e in gaps])
        before = F.filter(listed, lambda x: x["s"] < F.col("slot"))
        missing = F.aggregate(before, F.lit(0).cast("bigint"), lambda a, x: a + x["e"])
    position = F.col("slot") * block_rows - missing + F.expr(f"(rank - 1) % {block_rows}")
    return placed.select("row", "block", "slot", position.alias("position"))


def mix_to_weights(
    df: DataFrame, weights: Mapping[str | None, float], key: Column, source: str = "source", other: float | None = None,
    block_rows: int = BLOCK_ROWS, period: int = PERIOD, seed: int = 42, stage_input: bool = True,
) -> DataFrame:
    """``df`` with ``block`` (in its source), ``slot`` (of the block) and ``position`` (of the row, from 0).

    Read in order of ``position``, the sources keep their target weights to less
    than one block as long as they last.  ``key`` tells rows apart.  The input is
    read several times; leave ``stage_input`` on unless it is a stored table.
    """
    placed = _placed(df, weights, key, source, other, block_rows, period, seed, stage_input)
    keep = replace_columns(df, ["block", "slot", "position"])
    return placed.select(*[F.col("row")[c].alias(c) for c in keep], "block", "slot", "position")


def in_mixed_order(
    df: DataFrame, weights: Mapping[str | None, float], key: Column, source: str = "source", other: float | None = None,
    block_rows: int = BLOCK_ROWS, period: int = PERIOD, seed: int = 42, stage_input: bool = True,
) -> DataFrame:
    """The rows and columns of ``df``, sorted into the mixture: written files follow it one after another."""
    placed = _placed(df, weights, key, source, other, block_rows, period, seed, stage_input).select("row", "position")
    return placed.orderBy("position").select(*[F.col("row")[c].alias(c) for c in df.columns])
