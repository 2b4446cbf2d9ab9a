"""Exact deduplication by Grace hashing.

Texts are equal when they are equal after deleting every white space character
of ``[\\x20\\x09-\\x0D]``.  Of equal texts the row with the most code points in
its original text stays, then the one with the smallest id (null ids last).

Each task first keeps one record per content it has seen (a copy group of any
size leaves a task as one record), the records are dealt by a hash of the
content, and each bucket is resolved by recursive partitioning: records enter an
open-addressing table that compares complete content; when the table outgrows
its memory, everything goes to spill files by further bits of the hash, and each
file is resolved alone.  Spill files are unnamed, belong to one task and vanish
with it; a lost task starts over from its shuffle input.

Defined cases: null text equals empty text; all white-space texts are equal to
it; of wholly repeated rows (same id, same text) exactly one stays; an empty
table gives an empty result; other columns, whatever their names, are carried
by position and never looked at.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactlake.llm.tables import small_batches, tidied

SPACE = b" \t\n\x0b\x0c\r"
_FAN_OUT = 16
_LEVELS = 15  # 4 bits each
_REPEAT = 100_000  # rows alike that are written out at once


class ContentTable:
    """Open addressing with linear probing; equal hashes are told apart by complete content."""

    def __init__(self) -> None:
        self.slots = [-1] * 64
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bests: list[tuple] = []
        self.bytes = 0

    def _place(self, h: int, content: bytes) -> int:
        mask = len(self.slots) - 1
        at = h & mask
        while (i := self.slots[at]) >= 0 and not (self.hashes[i] == h and self.contents[i] == content):
            at = (at + 1) & mask
        return at

    def add(self, h: int, content: bytes, record: tuple) -> None:
        at = self._place(h, content)
        if (i := self.slots[at]) >= 0:
            self.bests[i] = better(self.bests[i], record)
            return
        self.slots[at] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.bests.append(record)
        self.bytes += 2 * len(content) + 200
        if 3 * len(self.hashes) > 2 * len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            mask = len(self.slots) - 1
            for i, h in enumerate(self.hashes):
                at = h & mask
                while self.slots[at] >= 0:
                    at = (at + 1) & mask
                self.slots[at] = i

    def items(self) -> Iterator[tuple[int, bytes, tuple]]:
        yield from zip(self.hashes, self.contents, self.bests, strict=True)


def better(a: tuple, b: tuple) -> tuple:
    """Of two records (n_chars, id, rows, rows tied with the best, row) the one that stays, with the counts of both."""
    key = lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0)
    ka, kb = key(a), key(b)
    best = a if ka <= kb else b
    return (best[0], best[1], a[2] + b[2], a[3] + b[3] if ka == kb else best[3], best[4])


def resolve(records: Iterator[tuple[int, bytes, tuple]], limit: int, level: int = 0) -> Iterator[tuple[int, bytes, tuple]]:
    """One record per content, with at most about ``limit`` bytes of contents in memory."""
    table, files, pickles = ContentTable(), None, None
    for h, content, record in records:
        if files is None:
            table.add(h, content, record)
            if table.bytes > limit and len(table.hashes) > 1 and level < _LEVELS:
                files = [tempfile.TemporaryFile() for _ in range(_FAN_OUT)]  # noqa: SIM115
                pickles = [pickle.Pickler(f, pickle.HIGHEST_PROTOCOL) for f in files]
                spilled, table = table, ContentTable()
                for entry in spilled.items():
                    _spill(pickles, level, entry)
        else:
            _spill(pickles, level, (h, content, record))
    yield from table.items()
    for f in files or ():
        f.seek(0)
        yield from resolve(_read(f), limit, level + 1)
        f.close()


def _spill(pickles: list, level: int, entry: tuple) -> None:
    # the dealing and the table use the low bits
    to = pickles[entry[0] >> (60 - 4 * level) & (_FAN_OUT - 1)]
    to.dump(entry)
    to.clear_memo()


def _read(f) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def _content(text: str | None) -> tuple[int, bytes]:
    content = (text or "").encode().translate(None, SPACE)
    return int.from_bytes(hashlib.blake2b(content, digest_size=8).digest()), content


def _of_batch(batch: pa.RecordBatch, text: int, ident: int) -> Iterator[tuple[int, bytes, tuple]]:
    """Records of fresh rows."""
    columns = [c.to_pylist() for c in batch.columns]
    for row in zip(*columns, strict=True):
        yield *_content(row[text]), (len(row[text] or ""), row[ident], 1, 1, row)


def _distinct(df: DataFrame, text: str, ident: str, memory: int) -> DataFrame:
    """One row per content: c0 … of its best row, then n_chars, rows, tied."""
    names = [f"c{i}" for i in range(len(df.columns))]
    at_text, at_id = df.columns.index(text), df.columns.index(ident)
    plain = df.toDF(*names)
    fields = list(plain.schema.fields)
    extra = [T.StructField(n, T.LongType()) for n in ("_h", "_chars", "_rows", "_tied")]
    schema = T.StructType(fields + extra)
    n = len(names)

    def batches(entries: Iterator[tuple[int, bytes, tuple]], types: pa.Schema) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for h, content, (chars, _, count, tied, row) in entries:
            rows.append((*row, h - (1 << 63), chars, count, tied))
            size += len(content)
            if size > 8 << 20 or len(rows) >= 2000:
                yield pack(rows, types)
                rows, size = [], 0
        if rows:
            yield pack(rows, types)

    def pack(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, types.field(i).type if i < n else pa.int64()) for i, c in enumerate(columns)], names=[f.name for f in schema]
        )

    def local(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, types = ContentTable(), None
        for batch in source:
            types = batch.schema
            for entry in _of_batch(batch, at_text, at_id):
                table.add(*entry)
                if table.bytes > memory:
                    yield from batches(table.items(), types)
                    table = ContentTable()
        if types is not None:
            yield from batches(table.items(), types)

    def bucket(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[pa.Schema] = []

        def entries() -> Iterator[tuple[int, bytes, tuple]]:
            for batch in source:
                seen[:] = [batch.schema]
                columns = [c.to_pylist() for c in batch.columns]
                for values in zip(*columns, strict=True):
                    row = values[:n]
                    yield *_content(row[at_text]), (values[n + 1], row[at_id], values[n + 2], values[n + 3], row)

        resolved = resolve(entries(), memory)
        first = next(resolved, None)
        if first is not None:
            yield from batches(_chain(first, resolved), seen[0])

    return small_batches(plain).mapInArrow(tidied(local), schema).repartition("_h").mapInArrow(tidied(bucket), schema)


def _chain(first, rest):
    yield first
    yield from rest


def _digests(df: DataFrame, text: str, ident: str) -> DataFrame:
    """Id, code points and digest of every row."""
    rows = df.select(F.col(ident).alias("ident"), F.col(text).alias("t"))
    schema = T.StructType([rows.schema["ident"], T.StructField("chars", T.LongType()), T.StructField("sha", T.StringType())])

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = batch.column(1).to_pylist()
            shas = [hashlib.sha256((t or "").encode().translate(None, SPACE)).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(shas, pa.string())], names=schema.names
            )

    return small_batches(rows).mapInArrow(tidied(work), schema)


def keep_one_each(df: DataFrame, text: str = "text", ident: str = "doc_id", memory: int = 48 << 20) -> DataFrame:
    """The rows of ``df`` that stay, one per content, with their columns."""
    columns = df.columns
    kept = _distinct(df, text, ident, memory)
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


def duplicate_groups(df: DataFrame, text: str = "text", ident: str = "doc_id", memory: int = 48 << 20) -> DataFrame:
    """Every row's id, keep_id, group_size, kept and text_sha256.

    Contents are told apart by complete comparison; rows then meet their group
    by the SHA-256 of the content, of which each group has one.
    """
    rows = df.select(F.col(ident).alias("ident"), F.col(text).alias("t"))
    best = _distinct(rows, "t", "ident", memory)
    groups = _digests(
        best.select(F.struct("c0", "_rows", "_tied").alias("ident"), F.col("c1").alias("t")), "t", "ident"
    ).select(
        F.col("sha"), F.col("ident.c0").alias("keep_id"), F.col("chars").alias("keep_chars"),
        F.col("ident._rows").alias("group_size"), F.col("ident._tied").alias("tied"),
    )
    # rows that agree in id and text are told apart by nothing, so they travel as one row with a count
    alike = _digests(rows, "t", "ident").groupBy("ident", "chars", "sha").agg(F.count(F.lit(1)).alias("n"))
    joined = alike.join(groups, "sha")
    is_best = F.col("ident").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))
    parts = joined.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {_REPEAT}"))).alias("part"))
    length = F.least(F.lit(_REPEAT).cast("bigint"), F.col("n") - F.col("part") * _REPEAT).cast("int")
    each = parts.select("*", F.posexplode(F.array_repeat(F.lit(0), length)).alias("at", "_"))
    return each.select(
        F.col("ident").alias(ident), "keep_id", "group_size",
        (is_best & (F.col("part") == 0) & (F.col("at") == 0)).alias("kept"), F.col("sha").alias("text_sha256"),
    )
