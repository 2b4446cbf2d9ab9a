"""Hard-negative mining with an inverted multi-index.

For an *anchor*, the positives are its nearest other rows of the same label, and
the hard negatives of a positive are the best rows of other labels whose score
lies in a *window* below the positive's.  The score is the integer inner product
of the floored, scaled vectors; ties go to the smaller id.  Results are exact.

1. A codebook for each half of the space is fitted on at most ``SAMPLE`` rows, the
   first ones by a hash of their ids.  *Every* row is indexed: its cell is the
   pair of its nearest centroids.  The largest distance of any row to its
   centroid is that centroid's radius.
2. The rows of a cell are stored in blocks of about ``BLOCK_ROWS``.  A cell of any
   size, or a vector that a third of all rows share, is many blocks.
3. For an anchor, ``q . c + |q| r`` bounds the half score of every row under a
   centroid.  The multi-sequence heap walks the cells by falling sum of both
   halves' bounds.  A round takes the next stretch of that walk, which grows
   eightfold; blocks and the anchors that visit them meet in a join, in batches.
4. A window is certified once the bound of the next cell is below its last wanted
   score, or below its lower end; an anchor stops when all its windows are.

The first search finds the positives and has one window without ends; the second
one has a window for each positive.  Where vectors are spread evenly the bounds
cut off little and the walk goes to its end: results do not depend on that.

Defined cases: rows with a null id, label or vector, or with a null or non-finite
component take no part, nor do vectors of another length than the commonest (of
equally common ones the longest) and vectors with a component whose products may
leave 64 bits (``component_limit``); rows that agree in id, label and vector count
once; rows that share an id are no partners of each other; an anchor with fewer
positives or negatives gets what there is; an empty table gives an empty result;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactlake.llm.tables import staged

SCALE = 256
SAMPLE, ITERATIONS = 20_000, 8
BLOCK_ROWS, BATCH_ROWS = 2_048, 1_024
MOST_CENTROIDS, ROWS_A_CELL = 256, 256
FIRST_STRETCH, GROWTH = 64, 8
_LEAST, _MOST = -(1 << 62), 1 << 62
_EXACT = 1 << 53  # whole numbers below it are exact in a double


def component_limit(dim: int) -> int:
    return min(math.isqrt(_MOST // max(dim, 1)), (1 << 31) - 1)


# --- rows that take part -------------------------------------------------------------
def usable(df: DataFrame, ident: str, vector: str, label: str | Column) -> tuple[DataFrame, int]:
    """``id, label, v`` (floored components) of the rows that take part, and their dimension."""
    label = F.col(f"`{label}`") if isinstance(label, str) else label
    rows = df.select(F.col(f"`{ident}`").cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(f"`{vector}`").alias("x"))
    infinite = F.lit(float("inf"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite)
    rows = rows.filter("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").filter(~F.exists("x", odd))
    common = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    dim = common[0]["d"] if common else 0
    scaled = rows.filter(F.size("x") == dim).select("id", "label", F.transform("x", lambda x: F.floor(SCALE * x.cast("double"))).alias("v"))
    limit = component_limit(dim)
    return scaled.filter(~F.exists("v", lambda v: (v > limit) | (v < -limit))), dim


# --- codebooks -----------------------------------------------------------------------
def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and its distance."""
    apart = (centroids**2).sum(1) - 2 * (x @ centroids.T)
    at = apart.argmin(1)
    return at, np.sqrt(((x - centroids[at]) ** 2).sum(1))


def codebook(x: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Centroids by Lloyd's rounds from seeded rows; one that loses all its rows stays where it is."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.permutation(len(x))[:size]].copy()
    for _ in range(ITERATIONS):
        at, _ = nearest(x, centroids)
        counts = np.bincount(at, minlength=len(centroids))
        sums = np.array([np.bincount(at, weights=column, minlength=len(centroids)) for column in x.T]).reshape(-1, len(centroids)).T
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


class MultiIndex:
    """Two codebooks with radii, and the cells that hold rows."""

    def __init__(self, books: list[np.ndarray]) -> None:
        self.books = books
        self.half = books[0].shape[1]
        self.size = len(books[0])
        self.radii: list[np.ndarray] = []
        self.filled: set[int] = set()

    def cells(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cell of each vector and its distances to both centroids."""
        x = v.astype(np.float64)
        (i, a), (j, b) = nearest(x[:, : self.half], self.books[0]), nearest(x[:, self.half :], self.books[1])
        return i * self.size + j, a, b

    def bounds(self, q: np.ndarray) -> list[np.ndarray]:
        """For each half, anchor and centroid, a bound of the half scores of all rows under the centroid."""
        out = []
        for x, book, radii in zip((q[:, : self.half], q[:, self.half :]), self.books, self.radii, strict=True):
            x = x.astype(np.float64)
            norms = np.sqrt((x**2).sum(1))[:, None]
            bound = x @ book.T + norms * radii
            out.append(bound + 1e-9 * (np.abs(bound) + norms * (1 + radii)) + 1)  # rounding never loses a row
        return out

    def walk(self, first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int]]:
        """Bound and number of the cells that hold rows, by falling sum of the halves' bounds."""
        a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
        u, w = first[a].tolist(), second[b].tolist()
        a, b = a.tolist(), b.tolist()
        heap, done = [(-(u[0] + w[0]), 0, 0)], set()
        while heap:
            bound, i, j = heapq.heappop(heap)
            done.add((i, j))
            # a pair enters when both pairs that come before it have left
            if i + 1 < len(u) and (j == 0 or (i + 1, j - 1) in done):
                heapq.heappush(heap, (-(u[i + 1] + w[j]), i + 1, j))
            if j + 1 < len(w) and (i == 0 or (i - 1, j + 1) in done):
                heapq.heappush(heap, (-(u[i] + w[j + 1]), i, j + 1))
            cell = a[i] * self.size + b[j]
            if cell in self.filled:
                yield -bound, cell


# --- arrays in rows ------------------------------------------------------------------
def _vectors(batch: pa.RecordBatch | pa.Table, name: str, dim: int) -> np.ndarray:
    column = batch.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _packed(matrix: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in np.ascontiguousarray(matrix)]


def _int64(values: pa.Scalar | pa.Array) -> np.ndarray:
    return np.frombuffer(values.as_buffer(), np.int64)


_STATE = "batch long, ids binary, labels binary, q binary, lo binary, hi binary"
_VISITS = "cell long, part long, batch long, who binary, ids binary, labels binary, q binary, lo binary, hi binary"
_FOUND = "batch long, a long, w long, anchor_id long, score long, id long"


def _packs(rows: DataFrame, keys: list[str], extra: dict[str, int]) -> DataFrame:
    """One row for each group: its ids, labels and vectors by rising id, and constants ``extra`` for each row."""
    names = [*keys, "ids", "labels", "q", *extra]
    schema = ", ".join(f"{n} long" if n in keys else f"{n} binary" for n in names)

    def pack(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        vectors = table["q"].to_pylist()
        order = np.lexsort((np.array(vectors, object), ids)) if len(ids) > 1 else np.zeros(len(ids), np.int64)
        values = [table[k][0].as_py() for k in keys]
        blobs = [ids[order].tobytes(), table["label"].to_numpy()[order].tobytes(), b"".join([vectors[i] for i in order])]
        blobs += [np.full(len(ids), value, np.int64).tobytes() for value in extra.values()]
        return pa.table([pa.array([v]) for v in values] + [pa.array([x], pa.binary()) for x in blobs], names=names)

    return rows.select(*keys, "id", "label", "q").groupBy(*keys).applyInArrow(pack, schema)


def build_index(points: DataFrame, dim: int, centroids: int | None, seed: int) -> tuple[DataFrame, DataFrame, MultiIndex, dict[int, int]]:
    """Distinct rows with their cells, blocks of them, the index, and the number of blocks of each cell."""
    spark = points.sparkSession
    sample = points.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE).select("v").toPandas()["v"]
    fitted = np.array([np.asarray(v) for v in sample], np.float64).reshape(-1, dim)
    size = centroids or min(max(math.isqrt(points.count() // ROWS_A_CELL), 1), MOST_CENTROIDS)
    half = dim // 2
    index = MultiIndex([codebook(fitted[:, :half], size, seed), codebook(fitted[:, half:], size, seed + 1)])
    shared = spark.sparkContext.broadcast(index)  # two codebooks of MOST_CENTROIDS at most

    def assign(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            v = _vectors(batch, "v", dim)
            cell, a, b = shared.value.cells(v)
            columns = [batch.column("id"), batch.column("label"), pa.array(cell), pa.array(a), pa.array(b), pa.array(_packed(v.astype("<i4")), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "cell", "da", "db", "q"])

    assigned = points.mapInArrow(assign, "id long, label long, cell long, da double, db double, q binary")
    assigned = staged(assigned.distinct(), "cells")
    stats = assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("da").alias("a"), F.max("db").alias("b")).collect()  # a row a cell
    index.radii = [np.zeros(len(index.books[0])), np.zeros(len(index.books[1]))]
    for r in stats:
        i, j = divmod(r["cell"], index.size)
        index.radii[0][i] = max(index.radii[0][i], r["a"])
        index.radii[1][j] = max(index.radii[1][j], r["b"])
    index.filled = {r["cell"] for r in stats}
    parts = {r["cell"]: -(-r["n"] // BLOCK_ROWS) for r in stats}
    split = spark.createDataFrame([(c, n) for c, n in parts.items()], "cell long, parts long")  # a row a cell, MOST_CENTROIDS ** 2 at most
    dealt = assigned.join(F.broadcast(split), "cell").withColumn("part", F.pmod(F.xxhash64("id", "q"), F.col("parts")))
    blocks = _packs(dealt, ["cell", "part"], {})
    return assigned, staged(blocks, "blocks"), index, parts


# --- search --------------------------------------------------------------------------
def _top(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` along the last axis, by falling score, then rising id."""
    order = np.lexsort((ids, -score), axis=-1)[..., :k]
    return np.take_along_axis(score, order, -1), np.take_along_axis(ids, order, -1)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    largest = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * q.shape[1]
    if largest < _EXACT:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q.astype(np.int64) @ x.T.astype(np.int64)


def best_in_block(
    anchors: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], block: tuple[np.ndarray, np.ndarray, np.ndarray], same: bool, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the first ``k`` rows of a block for each anchor and window; ``_LEAST`` where there are fewer."""
    (ids, labels, q, lo, hi), (rows, kinds, x) = anchors, block
    score, n, w = products(q, x), len(rows), lo.shape[1]
    fits = (labels[:, None] == kinds) if same else (labels[:, None] != kinds)
    fits &= ids[:, None] != rows
    take = min(k, n)
    scores, found = np.full((len(ids), w, take), _LEAST, np.int64), np.zeros((len(ids), w, take), np.int64)
    small = int(np.abs(score).max(initial=0)) < _MOST // (n + 1)
    places = np.arange(n - 1, -1, -1)
    for j in range(w):
        inside = fits & (score >= lo[:, j, None]) & (score <= hi[:, j, None])
        some = np.flatnonzero(inside.any(1))
        if not len(some):
            continue
        inside, own = inside[some], score[some]
        if small:  # rows stand by rising id, so one number orders them
            key = np.where(inside, own * n + places, _LEAST)
            at = np.argpartition(key, n - take, axis=1)[:, n - take :]
        else:
            at = np.lexsort((np.broadcast_to(rows, own.shape), np.where(inside, -own, _MOST)), axis=-1)[:, :take]
        scores[some, j] = np.where(np.take_along_axis(inside, at, 1), np.take_along_axis(own, at, 1), _LEAST)
        found[some, j] = rows[at]
    return scores, found


def _visits(state: DataFrame, found: DataFrame | None, index: MultiIndex, parts: dict[int, int], dim: int, k: int, begin: int, end: int) -> DataFrame:
    """Which anchors of each batch visit which blocks next, from place ``begin`` to ``end`` of their walks."""
    shared = state.sparkSession.sparkContext.broadcast((index, parts))  # the cells' numbers, MOST_CENTROIDS ** 2 at most

    def plan(states: pa.Table, known: pa.Table | None) -> pa.Table:
        index, parts = shared.value
        out = []
        for row in range(states.num_rows):
            ids, labels = _int64(states["ids"][row]), _int64(states["labels"][row])
            q = np.frombuffer(states["q"][row].as_buffer(), "<i4").reshape(-1, dim)
            lo, hi = (_int64(states[c][row]).reshape(len(ids), -1).copy() for c in ("lo", "hi"))
            if known is not None and known.num_rows:
                # what is found already raises the lower ends: the last wanted score still counts, its ties may have smaller ids
                a, w, score = (known[c].to_numpy() for c in ("a", "w", "score"))
                slot = a * lo.shape[1] + w
                full = np.flatnonzero(np.bincount(slot, minlength=lo.size) >= k)
                least = np.full(lo.size, _MOST, np.int64)
                np.minimum.at(least, slot, score)
                flat = lo.reshape(-1)
                flat[full] = np.maximum(flat[full], least[full])
            need = np.where(lo <= hi, lo, _MOST).min(1)
            bounds = index.bounds(q)
            going: dict[int, list[int]] = {}
            for i in np.flatnonzero(need < _MOST).tolist():
                for place, (bound, cell) in enumerate(index.walk(bounds[0][i], bounds[1][i])):
                    if bound < need[i] or place >= end:
                        break
                    if place >= begin:
                        going.setdefault(cell, []).append(i)
            for cell, who in going.items():
                at = np.array(who, np.int64)
                blobs = [x.tobytes() for x in (at, ids[at], labels[at], q[at], lo[at], hi[at])]
                out += [(cell, p, states["batch"][row].as_py(), *blobs) for p in range(parts[cell])]
        columns = list(zip(*out, strict=True)) or [[]] * 9
        kinds = [pa.int64()] * 3 + [pa.binary()] * 6
        names = [c.split()[0] for c in _VISITS.split(", ")]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    if found is None:
        return state.groupBy("batch").applyInArrow(lambda t: plan(t, None), _VISITS)
    return state.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(plan, _VISITS)


def _scored(visits: DataFrame, blocks: DataFrame, dim: int, same: bool, k: int) -> DataFrame:
    """The first ``k`` rows that each task finds for an anchor and window."""
    rows = blocks.select("cell", "part", F.col("ids").alias("b_ids"), F.col("labels").alias("b_labels"), F.col("q").alias("b_q"))
    met = visits.join(rows, ["cell", "part"]).drop("cell", "part")

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, int]] = {}
        names = [c.split()[0] for c in _FOUND.split(", ")]

        def rows() -> pa.RecordBatch:
            out = [[] for _ in names]
            for (batch, a), (score, ids, anchor) in best.items():
                w, at = np.nonzero(score > _LEAST)
                for column, values in zip(out, (batch, a, w, anchor, score[w, at], ids[w, at]), strict=True):
                    column.append(np.broadcast_to(values, len(w)))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=names)

        for batch in source:
            for i in range(batch.num_rows):
                get = lambda c: batch.column(c)[i]  # noqa: E731, B023
                who, ids, labels = _int64(get("who")), _int64(get("ids")), _int64(get("labels"))
                q = np.frombuffer(get("q").as_buffer(), "<i4").reshape(-1, dim)
                lo, hi = (_int64(get(c)).reshape(len(ids), -1) for c in ("lo", "hi"))
                block = _int64(get("b_ids")), _int64(get("b_labels")), np.frombuffer(get("b_q").as_buffer(), "<i4").reshape(-1, dim)
                number = get("batch").as_py()
                scores, found = best_in_block((ids, labels, q, lo, hi), block, same, k)
                for j in np.flatnonzero((scores > _LEAST).any((1, 2))).tolist():
                    key, one = (number, int(who[j])), (scores[j], found[j])
                    if key in best:
                        one = tuple(np.concatenate((x, y), 1) for x, y in zip(best[key], one, strict=False))
                    best[key] = (*_top(*one, k), int(ids[j]))
                if len(best) > 16 * BATCH_ROWS:
                    yield rows()
                    best.clear()
        if best:
            yield rows()

    return met.mapInArrow(work, _FOUND)


def search(state: DataFrame, blocks: DataFrame, index: MultiIndex, parts: dict[int, int], dim: int, same: bool, k: int) -> DataFrame | None:
    """The first ``k`` rows for each anchor and window of ``state``, with their ``rank``; None if nothing is to be visited."""
    found, begin, end = None, 0, FIRST_STRETCH
    first = Window.partitionBy("batch", "a", "w").orderBy(F.desc("score"), "id")
    while begin < len(parts):
        visits = staged(_visits(state, found, index, parts, dim, k, begin, end), "visits")
        if visits.isEmpty():
            break
        more = _scored(visits, blocks, dim, same, k)
        every = more if found is None else found.select(more.columns).union(more)
        found = staged(every.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k), "found")
        begin, end = end, end * GROWTH
    return found


def _windowed(state: DataFrame, positives: DataFrame, low: int, high: int, wanted: int) -> DataFrame:
    """``state`` with a window for each positive, ``low`` to ``high`` percent of its score."""

    def windows(states: pa.Table, known: pa.Table) -> pa.Table:
        if not states.num_rows:
            return states
        m = len(_int64(states["ids"][0]))
        lo, hi = np.full((m, wanted), _MOST, np.int64), np.full((m, wanted), _LEAST, np.int64)
        a, at, score = (known[c].to_numpy() for c in ("a", "rank", "score"))
        lo[a, at - 1] = [-(-low * s // 100) for s in score.tolist()]
        hi[a, at - 1] = [high * s // 100 for s in score.tolist()]
        blobs = [pa.array([x.tobytes()], pa.binary()) for x in (lo, hi)]
        return pa.table([*(states[c] for c in ("batch", "ids", "labels", "q")), *blobs], names=states.column_names)

    return state.groupBy("batch").cogroup(positives.groupBy("batch")).applyInArrow(windows, _STATE)


def hard_negatives(
    df: DataFrame, is_anchor: Column, ident: str = "vec_id", vector: str = "embedding", label: str | Column = "label", positives: int = 5,
    negatives: int = 10, low: int = 30, high: int = 90, centroids: int | None = None, seed: int = 42,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is a condition on ``id``.  ``label`` may be a column expression.  A
    negative's score lies between ``low`` and ``high`` percent of the positive's.
    """
    spark = df.sparkSession
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    points, dim = usable(df, ident, vector, label)
    points = staged(points, "points")
    if dim == 0 or points.isEmpty():
        return spark.createDataFrame([], result)
    rows, blocks, index, parts = build_index(points, dim, centroids, seed)
    chosen = rows.filter(is_anchor)
    batches = -(-chosen.count() // BATCH_ROWS)
    if not batches:
        return spark.createDataFrame([], result)
    chosen = chosen.withColumn("batch", F.pmod(F.xxhash64("id", "q", F.lit(seed)), F.lit(batches)).cast("bigint"))
    state = staged(_packs(chosen, ["batch"], {"lo": _LEAST + 1, "hi": _MOST}).select(*[c.split()[0] for c in _STATE.split(", ")]), "anchors")
    near = search(state, blocks, index, parts, dim, True, positives)
    if near is None:
        return spark.createDataFrame([], result)
    windowed = staged(_windowed(state, near, low, high, positives), "windows")
    hard = search(windowed, blocks, index, parts, dim, False, negatives)
    if hard is None:
        return spark.createDataFrame([], result)
    pairs = near.select("batch", "a", (F.col("rank") - 1).cast("bigint").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    hard = hard.select("batch", "a", "w", "anchor_id", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return hard.join(pairs, ["batch", "a", "w"]).select(*[c.split()[0] for c in result.split(", ")])
