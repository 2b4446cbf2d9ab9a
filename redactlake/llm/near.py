"""Near-duplicate join on word shingles with adaptive multi-match prefixes.

Documents link when the Jaccard similarity of their sets of five-word shingles
is 0.8 or more; the result names each document's component.

1. Documents with equal sets form one *class*; everything below is about
   classes, so copies cost no pairs.
2. A count sketch of fixed size over all shingles of all documents orders the
   shingles of a set from rare to common (ties by hash).  The fewer shingles
   fall to one counter, the fewer lists hold shingles that many classes share.
3. Two sets that overlap enough share at least ``l`` shingles within their
   prefixes of ``n - ceil(0.8 n) + l`` shingles, for every ``l``.  Each class
   lengthens its prefix to the ``l`` of the least estimated cost (lists to read
   plus candidates to verify); a pair must share as many prefix shingles as the
   smaller of its two ``l``.
4. Prefix shingles meet in one shuffle.  Lists of a single class end there.
5. Large groups are not paired out: in some rounds each list compares all its
   members with one pivot, links are verified on complete sets, and lists whose
   members are all in one component are done.  What is left between different
   components is joined in full, so no link between different sets is lost; there
   the places of the shared shingles and the former ones that a pair does not
   share bound the overlap that it can reach, and a run of shared shingles makes
   as many rows as the pair must share.
6. Parities of all classes are kept from the first pass; complete sets are taken
   from the texts anew, for the classes of plausible pairs only.

Shingles are compared as 64-bit hashes of their five words, classes as 128-bit
digests of their sets.

Defined cases: null, empty and all white-space texts have no shingles and stay
alone with their own id as component (null for a null id); a text of fewer than
five words is one shingle; a null id takes the smallest id of its component, or
null when there is none; repeated rows are members of the same class; other
columns are ignored or, where rows are kept, carried.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_digest

from redactlake.llm.components import components
from redactlake.llm.tables import group_key, small_batches, staged, tidied

WORDS, PERCENT = 5, 80
LONGEST = 4  # largest number of shared prefix shingles that a class may ask for
SKETCH_BITS = 22
PIVOT_ROUNDS = 2
BROADCAST_ROWS = 200_000  # rows of a few numbers that may be broadcast; more are joined by shuffles
_SLICES = 64
_MULTIPLIER, _FINISH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and the white space of ASCII only
    if not words:
        return np.empty(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxh3_64_digest, words)), "<u8")
    size = min(WORDS, len(h))
    mixed = h[: len(h) - size + 1] + np.uint64(size)
    for j in range(1, size):
        mixed = mixed * _MULTIPLIER + h[j : len(h) - size + 1 + j]
    mixed ^= mixed >> np.uint64(32)
    mixed *= _FINISH
    mixed ^= mixed >> np.uint64(29)
    mixed.sort()
    return mixed[np.concatenate(([True], mixed[1:] != mixed[:-1]))]


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def place(shingles: np.ndarray) -> np.ndarray:
    """Counters of the sketch."""
    return (shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def parities(shingles: np.ndarray) -> bytes:
    """Bit i tells whether an odd number of shingles falls to i; two to four bits a shingle.

    Sets whose bits differ in d places differ in d shingles at least, and linked
    sets differ in about a ninth of their summed sizes at most.
    """
    bits = 1 << min(max(8, (2 * len(shingles) - 1).bit_length()), 24)
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Places in which parities differ; the longer ones are folded, as places repeat with every half."""
    if len(x) < len(y):
        x, y = y, x
    a, b, size = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * len(x)
    while size > 8 * len(y):
        size //= 2
        a = (a >> size) ^ (a & ((1 << size) - 1))
    return (a ^ b).bit_count()


def owner(sig: bytes) -> int:
    """Short name of a class in the postings."""
    return int.from_bytes(sig[:8], "little", signed=True)


def least_overlap(n: int) -> int:
    """Shingles of a set of ``n`` that any linked set shares."""
    return -(-PERCENT * n // 100)


def linked(common: int, n: int, m: int) -> bool:
    return 100 * common >= PERCENT * (n + m - common)


def prefix(shingles: np.ndarray, sketch: np.ndarray, noise: int) -> tuple[np.ndarray, int]:
    """Prefix shingles from rare to common, and the chosen level."""
    n = len(shingles)
    count = sketch[place(shingles)].astype(np.int64)
    order = np.lexsort((shingles, count))
    least = least_overlap(n)
    levels = min(LONGEST, least)
    length = np.cumsum(np.maximum(count[order[: n - least + levels]] - noise, 1))
    ends = n - least + np.arange(levels)  # last place of each level's prefix
    candidates = (length[ends] - ends - 1) / np.arange(1, levels + 1)
    level = int(np.argmin(length[ends] + n * candidates)) + 1
    return shingles[order[: n - least + level]], level


# --- passes over the texts ---------------------------------------------------------
def _rows(df: DataFrame, text: str, ident: str) -> DataFrame:
    return small_batches(df).select(
        F.col(ident).alias("ident"), F.col(text).alias("t"), F.xxhash64(F.col(text)).alias("k"), group_key(ident).alias("g")
    )


def _slices(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few rows: a task holds no more than their texts as Python objects."""
    for batch in source:
        for start in range(0, batch.num_rows, 200):
            yield batch.slice(start, 200)


def _signatures(rows: DataFrame) -> DataFrame:
    """A row for each document with the parities of its set, and each task's part of the sketch."""
    schema = T.StructType([
        rows.schema["ident"], T.StructField("k", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sig", T.BinaryType()),
        T.StructField("c", T.LongType()), T.StructField("parity", T.BinaryType()), T.StructField("slice", T.IntegerType()), T.StructField("counts", T.BinaryType()),
    ])

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, kind = np.zeros(1 << SKETCH_BITS, np.uint32), None
        for batch in _slices(source):
            kind = batch.schema.field(0).type
            sizes, sigs, marks = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text)
                np.add.at(sketch, place(s), np.uint32(1))
                sizes.append(len(s))
                sigs.append(digest(s) if len(s) else None)
                marks.append(parities(s) if len(s) else None)
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()),
                pa.array([x and owner(x) for x in sigs], pa.int64()), pa.array(marks, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()),
            ], names=schema.names)
        if kind is not None:
            yield pa.RecordBatch.from_arrays([
                pa.nulls(_SLICES, kind), pa.nulls(_SLICES, pa.int64()), pa.nulls(_SLICES, pa.int64()), pa.nulls(_SLICES, pa.binary()), pa.nulls(_SLICES, pa.int64()),
                pa.nulls(_SLICES, pa.binary()), pa.array(range(_SLICES), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sketch.reshape(_SLICES, -1)], pa.binary()),
            ], names=schema.names)

    return rows.select("ident", "t", "k").mapInArrow(tidied(work), schema)


def _sketch(signatures: DataFrame) -> np.ndarray:
    """The summed sketch: a fixed number of counters, added up slice by slice in tasks of their own."""
    parts = small_batches(signatures.filter("slice IS NOT NULL").select("slice", "counts")).repartition(_SLICES, "slice")

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in source:
            for at, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                more = np.frombuffer(zlib.decompress(counts.as_buffer()), np.uint32)
                total[at] = total[at] + more if at in total else more
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "counts"]
        )

    sketch = np.zeros((_SLICES, (1 << SKETCH_BITS) // _SLICES), np.uint32)
    for row in parts.mapInArrow(tidied(work), "slice int, counts binary").collect():
        sketch[row["slice"]] = np.frombuffer(row["counts"], np.uint32)
    return sketch.reshape(-1)


def _postings(rows: DataFrame, sketch: np.ndarray) -> DataFrame:
    """``token, c, meta`` for the prefix of each class; ``meta`` holds the size, the place in the prefix and the level.

    A task sends a class once as long as it remembers it.
    """
    shared = rows.sparkSession.sparkContext.broadcast((sketch, int(np.median(sketch))))

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        counts, noise = shared.value
        for batch in _slices(source):
            tokens, owners, metas = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text)
                if not len(s):
                    continue
                c = owner(digest(s))
                if c in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(c)
                chosen, level = prefix(s, counts, noise)
                tokens.append(chosen.view(np.int64))
                owners.append(np.full(len(chosen), c, np.int64))
                metas.append((len(s) << 34) + (np.arange(len(chosen)) << 4) + level)
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x).astype(np.int64)) for x in (tokens, owners, metas)], names=["token", "c", "meta"]
                )

    return rows.select("ident", "t").mapInArrow(tidied(work), "token long, c long, meta long")


def _small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast, if it has few enough rows; it should be a stored table."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``sig, shingles`` of the classes whose first row ``wanted`` names by ``g, k``.

    A row that repeats may give its class more than once; nothing later depends on that.
    """
    texts = rows.join(wanted, ["g", "k"], "left_semi")

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in _slices(source):
            sets = {digest(s): s for s in map(shingle_set, batch.column(0).to_pylist())}
            sets = {d: s for d, s in sets.items() if d not in seen}
            if len(seen) > 200_000:
                seen.clear()
            seen.update(sets)
            yield pa.RecordBatch.from_arrays([
                pa.array(list(sets), pa.binary()), pa.array([s.tobytes() for s in sets.values()], pa.binary()),
            ], names=["sig", "shingles"])

    return texts.select("t").mapInArrow(tidied(work), "sig binary, shingles binary")


# --- pairs -------------------------------------------------------------------------
def _size(meta: str) -> Column:
    return F.shiftright(meta, 34)


def _at_sql(meta: str) -> str:
    return f"(shiftright({meta}, 4) & {(1 << 30) - 1})"


def _at(meta: str) -> Column:
    return F.expr(_at_sql(meta))


def _asks(meta: str) -> Column:
    return F.col(meta).bitwiseAND(F.lit(15))


def _within(meta: str, level: Column) -> Column:
    """The shingle lies in the prefix of that level."""
    least = F.expr(f"({PERCENT} * shiftright({meta}, 34) + 99) div 100")
    return _at(meta) < _size(meta) - least + level


def _needed(x: str, y: str) -> Column:
    """Shingles that linked sets of these sizes share."""
    return F.expr(f"({PERCENT} * (shiftright({x}, 34) + shiftright({y}, 34)) + {99 + PERCENT}) div {100 + PERCENT}")


def _can_link(x: str, y: str, asked: Column) -> Column:
    """By sizes, and by what is left from a shingle on that is among the first ``asked`` shared ones."""
    n, m = _size(x), _size(y)
    fit = 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)
    return fit & (F.least(n - _at(x), m - _at(y)) + asked - 1 >= _needed(x, y))


def _ends(pairs: DataFrame) -> DataFrame:
    """The digests ``sig`` of a stored table of pairs."""
    return staged(pairs.select(F.col("a").alias("sig")).union(pairs.select(F.col("b").alias("sig"))).distinct(), "ends")


def _plausible(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs ``a, b``, of a stored table of pairs, that their parities do not rule out."""
    marks = marks.join(_small(_ends(pairs)), "sig", "left_semi").dropDuplicates(["sig"])
    side = lambda x: marks.select(F.col("sig").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "pa", "pb")

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            apart = np.fromiter(map(differing, batch.column(4).to_pylist(), batch.column(5).to_pylist()), np.int64, batch.num_rows)
            sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            # a + b - 2i of a linked pair, as 100 i >= PERCENT (a + b - i)
            most = sizes - 2 * -(-PERCENT * sizes // (100 + PERCENT))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(apart <= most))

    return both.mapInArrow(tidied(work), "a binary, b binary")


def _verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of digests that link, of a stored table of pairs."""
    wanted = staged(classes.join(_small(_ends(pairs)), "sig", "left_semi").select("g", "k").distinct(), "wanted")
    whole = staged(_sets(rows, _small(wanted)), "sets")
    pairs = _small(pairs)
    first = whole.join(pairs, F.col("sig") == F.col("a")).select("a", "b", F.col("shingles").alias("sa"))
    ends = _small(staged(pairs.select(F.col("b").alias("sig")).distinct(), "ends"))
    second = whole.join(ends, "sig", "left_semi").select(F.col("sig").alias("b"), F.col("shingles").alias("sb"))

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                keep.append(linked(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return first.join(second, "b").select("a", "b", "sa", "sb").mapInArrow(tidied(work), "a binary, b binary")


def _open_lists(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members of the lists that still hold different components."""
    if labels is None:
        return members.withColumn("label", F.col("sig"))
    named = members.join(_small(labels.withColumnRenamed("node", "sig")), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    return _mixed(named)


def _reach(alone: str) -> Column:
    """The largest partner of a set that has ``alone`` shingles which the partner lacks."""
    return F.expr(f"(shiftright(meta, 34) - ({alone})) * {100 + PERCENT} div {PERCENT} - shiftright(meta, 34)")


def _reachable(lists: DataFrame) -> DataFrame:
    """Without the members that no other size in their list can link with; ``least`` is the smallest size."""
    each = Window.partitionBy("token")
    sized = lists.withColumn("least", F.min(_size("meta")).over(each)).withColumn("_most", F.max(_size("meta")).over(each))
    reach = _reach(f"{_at_sql('meta')} - {LONGEST - 1}")
    return sized.filter((reach >= F.col("least")) & (100 * F.col("_most") >= PERCENT * _size("meta"))).drop("_most")


def _mixed(lists: DataFrame) -> DataFrame:
    each = Window.partitionBy("token")
    spread = lists.withColumn("_lo", F.min("label").over(each)).withColumn("_hi", F.max("label").over(each))
    return spread.filter("_lo <> _hi").drop("_lo", "_hi")


def _pivot_pairs(lists: DataFrame, salt: int) -> DataFrame:
    """Each class with the pivot of other component that it meets in most lists.

    The first round's pivots are the classes in which a list's shingle stands
    foremost: they have least of their own and are most like the rest.
    """
    first = _at("meta") if salt == 0 else F.lit(0).cast("bigint")
    pivot = F.min(F.struct(first.alias("p"), F.xxhash64("sig", F.lit(salt)).alias("h"), "sig", "label", "meta")).over(Window.partitionBy("token"))
    met = lists.withColumn("p", pivot).withColumn("m", F.col("p.meta")).filter(F.col("p.label") != F.col("label"))
    met = met.filter(_can_link("meta", "m", F.lit(LONGEST)))
    often = met.groupBy(F.col("sig").alias("a"), F.col("p.sig").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return often.groupBy("a").agg(F.max(F.struct("n", "b")).alias("best")).select("a", "best.b")


def _with_former(lists: DataFrame) -> DataFrame:
    """``lists`` with ``f1``, ``f2`` ...: the shingles before this one in the class's own lists, as many as its level, null where it has fewer."""
    own = Window.partitionBy("sig").orderBy(_at("meta"))
    return lists.select("*", *[F.when(_asks("meta") >= k, F.lag("token", k).over(own)).alias(f"f{k}") for k in range(1, LONGEST + 1)])


def _with_alone(lists: DataFrame) -> DataFrame:
    """``lists`` with ``alone``, the shingles before this one that are in no list, and ``bits`` of the former ones that are in lists.

    What a linked pair shares before one of its first shared shingles is in
    lists of both, so no partner of this list has any of ``alone``.
    """
    own = Window.partitionBy("sig").orderBy(_at("meta"))
    bit = F.expr("shiftleft(1L, CAST(token & 63 AS INT))")
    former = F.coalesce(F.bit_or(bit).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    return lists.select("*", (_at("meta") - F.row_number().over(own) + 1).alias("alone"), former.alias("bits"))


def _can_share(x: str, y: str) -> Column:
    """By the former shingles that the other side lacks: those in no list, and at least one for each bit that it does not have."""
    left = lambda a, b: _size(f"m{a}") - F.col(f"g{a}") - F.expr(f"bit_count(bits{a} & ~bits{b})")
    return F.least(left(x, y), left(y, x)) >= _needed(f"m{x}", f"m{y}")


def _met_enough(x: str, y: str, asked: Column) -> Column:
    """The last ``asked`` former shingles of both sides are the same ones."""
    same = [F.coalesce(F.col(f"{x}{k}") == F.col(f"{y}{k}"), F.lit(False)) | (asked < k) for k in range(1, LONGEST + 1)]
    return reduce(Column.__and__, same)


def _meetings(lists: DataFrame) -> DataFrame:
    """``a, b, asked``: a row for a shared prefix shingle of a pair, but for the later ones of a run of them.

    All classes order their shingles alike and what fits in a list fits in the
    former ones.  A pair whose last ``asked`` former lists are the same ones has
    met there as often as it must, so it makes no row any more.  Nor does a pair
    whose former shingles tell that too few can be shared: a member whose own
    ones tell so for any size leaves the list before it is joined.
    """
    lists = _with_alone(_with_former(_mixed(_reachable(lists))))
    lists = _mixed(lists.filter(_reach("alone") >= F.col("least")).drop("least"))

    def side(c: str) -> DataFrame:
        former = [F.col(f"f{k}").alias(f"f{c}{k}") for k in range(1, LONGEST + 1)]
        known = [F.col(x).alias(f"{y}{c}") for x, y in (("label", "l"), ("meta", "m"), ("alone", "g"), ("bits", "bits"))]
        return lists.select("token", F.col("sig").alias(c), *known, *former)

    asked = F.least(_asks("ma"), _asks("mb"))
    fits = (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & _within("ma", asked) & _within("mb", asked) & _can_link("ma", "mb", asked)
    fits = fits & _can_share("a", "b") & ~_met_enough("fa", "fb", asked)
    met = side("a").withColumnRenamed("token", "t").join(side("b"), (F.col("t") == F.col("token")) & fits)
    return met.select("a", "b", asked.alias("asked"))


def _all_pairs(lists: DataFrame) -> DataFrame:
    """Pairs of different components that share as many prefix shingles as the smaller of their levels."""
    shared = _meetings(lists).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min("asked").alias("asked"))
    return shared.filter("shared >= asked").select("a", "b")


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row's ``ident, k, n, sig``; and the classes' ``sig, label, first`` and first row ``none, ident, k``."""
    signatures = staged(_signatures(rows), "signatures")
    sketch = _sketch(signatures)
    own = signatures.filter("slice IS NULL").select("ident", "k", "n", "sig", "c")
    marks = signatures.filter("sig IS NOT NULL").select("sig", "n", "parity")
    each = Window.partitionBy("token")
    met = _reachable(_postings(rows, sketch)).withColumn("_lo", F.min("c").over(each)).withColumn("_hi", F.max("c").over(each))
    shared = staged(met.filter("_lo <> _hi").select("token", "c", "meta").distinct(), "postings")
    classes = own.filter("sig IS NOT NULL").groupBy("sig", "c").agg(
        F.min("ident").alias("first"), F.min(F.struct(F.col("ident").isNull().alias("none"), "ident", "k")).alias("row")
    )
    classes = staged(classes.select("sig", "c", "first", "row.*", group_key("row.ident").alias("g")), "classes")
    members = staged(shared.join(classes.select("c", "sig"), "c").select("token", "sig", "meta"), "members")

    links, labels = None, None
    for salt in range(PIVOT_ROUNDS + 1):
        lists = _open_lists(members, labels)
        met = staged(_pivot_pairs(lists, salt) if salt < PIVOT_ROUNDS else _all_pairs(lists), "met")
        pairs = staged(_plausible(met, marks), "pairs")
        if pairs.isEmpty():
            continue
        found = staged(_verified(pairs, rows, classes), "links")
        if found.isEmpty():
            continue
        links = found if links is None else links.union(found)
        labels = components(links)
    if labels is None:
        return own, classes.withColumn("label", F.col("sig"))
    named = classes.join(labels.withColumnRenamed("node", "sig"), "sig", "left")
    return own, named.withColumn("label", F.coalesce("label", "sig"))


def near_groups(df: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Each row's id, n_shingles, component_id, and ``class_id`` (hex digest of its set; null without shingles)."""
    own, classes = _classes(_rows(df, text, ident))
    smallest = classes.groupBy("label").agg(F.min("first").alias("component_id"))
    named = classes.select("sig", "label").join(smallest, "label").select("sig", "component_id")
    return own.join(named, "sig", "left").select(
        F.col("ident").alias(ident), F.col("n").alias("n_shingles"),
        F.when(F.col("sig").isNull(), F.col("ident")).otherwise(F.col("component_id")).alias("component_id"),
        F.hex("sig").alias("class_id"),
    )


def keep_one_each(df: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that stay: of each component the smallest id, of rows without shingles all.

    Rows that repeat both id and text count as one document and stay once.
    """
    columns = df.columns
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), group_key(ident).alias("g"), F.xxhash64(F.col(text)).alias("k"))
    own, classes = _classes(_rows(df, text, ident))
    best = classes.groupBy("label").agg(F.min(F.struct("none", "ident", "k")).alias("b")).select("b.ident", "b.k")
    stays = best.union(own.filter("sig IS NULL").select("ident", "k")).select(group_key("ident").alias("g"), "k").distinct()
    # the join has dealt the rows by both keys, so the texts move once
    kept = packed.join(stays, ["g", "k"]).dropDuplicates(["g", "k"])
    return kept.select(*[F.col("row")[c].alias(c) for c in columns])
