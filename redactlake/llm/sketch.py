"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line; lines of more than 16 words are cut after words whose
hash says so (one in 8), so that an edit moves few borders, and words of more
than 64 characters are cut into pieces.  A document's set of paragraph digests
goes into three subtables of ``m`` cells; a cell holds a count, the XOR of its
digests and the XOR of their check sums.

``m`` is the smallest power of two from which the sketch gives back its own set
by peeling; on failure it is retried twice as large.  Two sketches are compared
by subtracting and peeling what is left.  A sketch folds to half its size by
adding halves, so the larger of two meets the smaller one; on failure the
recovered sets are entered into sketches twice as large, again and again.  Likeness is the Jaccard similarity of the sets, from their sizes and
the recovered differences.

Defined cases: null text counts as empty; an empty text has no paragraphs; two
empty sets are alike (1.0), an empty and another one are not (0.0); equal texts
have equal fingerprints.  In ``edited_neighbours`` rows are ordered by
descending id, then by a hash of the text, null ids last; a single row is its
own neighbour; repeated rows are neighbours like any others; further columns are
not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

_LONG_LINE, _LONG_WORD, _PIECE = 16, 64, 32
_CHECK = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_LEAST = 4
_HEAD = struct.Struct("<II")


def paragraphs(text: str | None) -> set[int]:
    """Digests of the paragraphs."""
    found: set[int] = set()
    for line in (text or "").split("\n"):
        if not line:
            continue
        words = line.split(" ")
        if len(words) <= _LONG_LINE and len(line) <= 4 * _LONG_WORD:
            found.add(xxh3_64_intdigest(line))
            continue
        part: list[str] = []
        for w in words:
            if len(w) > _LONG_WORD:
                found.update(xxh3_64_intdigest(w[i : i + _PIECE]) for i in range(0, len(w), _PIECE))
                continue
            part.append(w)
            if xxh3_64_intdigest(w) & 7 == 0:
                found.add(xxh3_64_intdigest(" ".join(part)))
                part = []
        if part:
            found.add(xxh3_64_intdigest(" ".join(part)))
    return found


def check_of(digest: int) -> int:
    return (digest * _CHECK & _MASK) >> 32


class Sketch:
    """Three subtables of ``m`` cells, a power of two."""

    __slots__ = ("checks", "counts", "keys", "m", "n", "own")

    def __init__(self, m: int, n: int = 0):
        self.m, self.n, self.own = m, n, None
        self.counts, self.keys, self.checks = [0] * (3 * m), [0] * (3 * m), [0] * (3 * m)

    @classmethod
    def of(cls, digests: set[int], m: int | None = None) -> Sketch:
        """The sketch of a set; of the smallest size that peels, if none is given."""
        least = m or _LEAST
        while m is None and 3 * least < 1.4 * len(digests) + 2:
            least *= 2
        made = cls(least, len(digests))
        for d in digests:
            made._enter(d, 1)
        if m is None:
            while made.peeled() is None:
                least *= 2
                made = cls.of(digests, least)
            made.own = digests
        return made

    def whole(self) -> set[int]:
        """All digests, given back by peeling."""
        if self.own is None:
            found = self.peeled()
            if found is None:
                raise ValueError("a fingerprint does not give back its own set")
            self.own = found[0]
        return self.own

    def _cells(self, d: int) -> tuple[int, int, int]:
        low = self.m - 1
        return d & low, self.m + (d >> 21 & low), 2 * self.m + (d >> 42 & low)

    def _enter(self, d: int, sign: int) -> None:
        check, counts, keys, checks = check_of(d), self.counts, self.keys, self.checks
        for i in self._cells(d):
            counts[i] += sign
            keys[i] ^= d
            checks[i] ^= check

    def folded(self, m: int) -> Sketch:
        now = self
        while now.m > m:
            half = now.m // 2
            less = Sketch(half, self.n)
            for t in range(3):
                for name in ("counts", "keys", "checks"):
                    old, new = getattr(now, name), getattr(less, name)
                    a, b = old[t * now.m : t * now.m + half], old[t * now.m + half : (t + 1) * now.m]
                    new[t * half : (t + 1) * half] = [x + y for x, y in zip(a, b, strict=True)] if name == "counts" else [x ^ y for x, y in zip(a, b, strict=True)]
            now = less
        return now

    def minus(self, other: Sketch) -> Sketch:
        left = Sketch(self.m)
        left.counts = [x - y for x, y in zip(self.counts, other.counts, strict=True)]
        left.keys = [x ^ y for x, y in zip(self.keys, other.keys, strict=True)]
        left.checks = [x ^ y for x, y in zip(self.checks, other.checks, strict=True)]
        return left

    def peeled(self) -> tuple[set[int], set[int]] | None:
        """Digests that count once more, and once less; None if some cells stay."""
        more, less = set(), set()
        left = Sketch(self.m)
        left.counts, left.keys, left.checks = self.counts.copy(), self.keys.copy(), self.checks.copy()
        counts, keys, checks = left.counts, left.keys, left.checks
        todo = [i for i, c in enumerate(counts) if c in (1, -1)]
        while todo:
            i = todo.pop()
            sign, d = counts[i], keys[i]
            if sign not in (1, -1) or checks[i] != check_of(d):
                continue
            cells = left._cells(d)
            if i not in cells:
                continue
            if d in more or d in less:
                return None  # some cell only looked as if it held one digest
            (more if sign == 1 else less).add(d)
            check = checks[i]
            for j in cells:
                counts[j] -= sign
                keys[j] ^= d
                checks[j] ^= check
                if counts[j] in (1, -1):
                    todo.append(j)
        return None if any(counts) or any(keys) or any(checks) else (more, less)

    def to_string(self) -> str:
        cells = [np.array(self.counts, "<i4").astype("<i2").tobytes(), np.array(self.keys, "<u8").tobytes(), np.array(self.checks, "<u4").tobytes()]
        return base64.b64encode(_HEAD.pack(self.n, self.m) + b"".join(cells)).decode()

    @classmethod
    def from_string(cls, text: str) -> Sketch:
        raw = base64.b64decode(text)
        n, m = _HEAD.unpack_from(raw)
        made, at = cls(m, n), _HEAD.size
        made.counts = np.frombuffer(raw, "<i2", 3 * m, at).tolist()
        made.keys = np.frombuffer(raw, "<u8", 3 * m, at + 6 * m).tolist()
        made.checks = np.frombuffer(raw, "<u4", 3 * m, at + 30 * m).tolist()
        return made


def difference(a: Sketch, b: Sketch) -> tuple[set[int], set[int]]:
    """Digests of ``a`` alone and of ``b`` alone."""
    m = min(a.m, b.m)
    if (found := a.folded(m).minus(b.folded(m)).peeled()) is not None:
        return found
    whole_a, whole_b = a.whole(), b.whole()
    while m <= 8 * (a.n + b.n) + 8:
        m *= 2
        if 3 * m < 1.3 * (a.n + b.n):
            continue  # the first try has shown that the sets have little in common
        if (found := Sketch.of(whole_a, m).minus(Sketch.of(whole_b, m)).peeled()) is not None:
            return found
    return whole_a - whole_b, whole_b - whole_a


def likeness(a: Sketch, b: Sketch) -> float:
    if not a.n and not b.n:
        return 1.0
    if not a.n or not b.n:
        return 0.0
    apart = sum(map(len, difference(a, b)))
    return (a.n + b.n - apart) / (a.n + b.n + apart)


# --- tables ------------------------------------------------------------------------
def fingerprints(df: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """``ident, fingerprint`` of every row."""
    rows = df.select(F.col(ident).alias("ident"), F.col(text).alias("t"))
    schema = T.StructType([rows.schema["ident"], T.StructField("fingerprint", T.StringType())])

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            made = [Sketch.of(paragraphs(t)).to_string() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=schema.names)

    return rows.mapInArrow(work, schema).select(F.col("ident").alias(ident), "fingerprint")


_NONE = -(1 << 63)  # stands for a null id, which comes last


def _bounds(rows: DataFrame, parts: int) -> np.ndarray:
    """Ids that cut the rows into about equal parts, rising."""
    cuts = ", ".join(f"{i / parts!r}D" for i in range(1, parts))
    found = rows.agg(F.expr(f"percentile_approx(id, array({cuts}), {max(10_000, 10 * parts)})").alias("b")).collect()[0]["b"]
    return np.unique(np.array(found or [], np.int64))


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows ``part, late, id, h, t``; the first row of each part is in the part before, too, as its late row.

    A part holds consecutive ids, descending.  Bounds and first rows of the
    parts, a few numbers each, pass the driver.
    """
    bounds = _bounds(rows, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def part_of(ids: np.ndarray) -> np.ndarray:
        return len(bounds) - np.searchsorted(bounds, ids, side="right")

    def first(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, int] = {}
        for batch in source:
            ids = batch.column(0).to_numpy()
            for p, i in zip(part_of(ids).tolist(), ids.tolist(), strict=True):
                top[p] = max(top.get(p, _NONE), i)
        yield pa.RecordBatch.from_arrays([pa.array(list(top), pa.int64()), pa.array(list(top.values()), pa.int64())], names=["part", "id"])

    tops = {r["part"]: r["id"] for r in rows.select("id").mapInArrow(first, "part long, id long").groupBy("part").agg(F.max("id").alias("id")).collect()}
    if not tops:
        return rows.select(F.lit(0).cast("bigint").alias("part"), F.lit(0).alias("late"), "id", "h", "t")
    heads = rows.filter(F.col("id").isin(list(tops.values()))).groupBy("id").agg(F.min("h").alias("h")).collect()
    hash_of = {r["id"]: r["h"] for r in heads}
    order = sorted(tops)
    before = {tops[p]: (order[n - 1], hash_of[tops[p]]) for n, p in enumerate(order)}  # the first part follows the last
    lead = np.array(sorted(before), np.int64)

    def deal(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(part_of(ids)), pa.array(np.zeros(n, np.int32)), *batch.columns], names=["part", "late", "id", "h", "t"])
            some = [i for i in np.flatnonzero(np.isin(ids, lead)).tolist() if before[int(ids[i])][1] == hashes[i]]
            if some:
                taken = batch.take(pa.array(some))
                to = pa.array([before[int(ids[i])][0] for i in some], pa.int64())
                yield pa.RecordBatch.from_arrays([to, pa.array(np.ones(len(some), np.int32)), *taken.columns], names=["part", "late", "id", "h", "t"])

    return rows.select("id", "h", "t").mapInArrow(deal, "part long, late int, id long, h long, t string")


def edited_neighbours(df: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Fingerprints of every text, of the text edited with its neighbour's beginning, and their likenesses.

    The neighbour is the next row by descending id (an integer), the first row
    for the last.  The edited text is the text whose last half, rounded down, is
    replaced by as many of the neighbour's first code points, or all it has.
    """
    rows = df.select(
        F.coalesce(F.col(ident).cast("bigint"), F.lit(_NONE)).alias("id"), F.xxhash64(F.col(text)).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("t")
    )
    schema = T.StructType([
        T.StructField("id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
    ])

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple | None = None  # part, id, text, sketch
        for batch in source:
            made: list[tuple] = []
            for part, late, i, t in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if waiting is None and late:
                    continue  # a late row that repeats
                sketch = Sketch.of(paragraphs(t))
                if waiting is not None:
                    if waiting[0] != part:
                        raise ValueError("a row has no neighbour in its part")
                    made.append(result(*waiting[1:], t, sketch))
                waiting = None if late else (part, i, t, sketch)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.from_numpy_dtype(k)) if k else pa.array(c, pa.string()) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=schema.names)
        if waiting is not None:
            raise ValueError("a row has no neighbour in its part")

    kinds = (np.int64, np.int64, None, None, None, np.float64, np.float64)

    def result(i: int, t: str, sketch: Sketch, other: str, others: Sketch) -> tuple:
        half = len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        changed = sketch if edited == t else Sketch.of(paragraphs(edited))
        return (
            i, len(t), hashlib.sha256(edited.encode()).hexdigest(), sketch.to_string(), changed.to_string(),
            likeness(sketch, changed), likeness(sketch, others),
        )

    dealt = _dealt(rows).repartition("part").sortWithinPartitions("part", "late", F.desc("id"), "h")
    found = dealt.select("part", "late", "id", "t").mapInArrow(work, schema)
    null_id = F.when(F.col("id") != _NONE, F.col("id")).cast(df.schema[ident].dataType)
    return found.select(null_id.alias(ident), *schema.names[1:])
