"""Token ids in fixed-width bit packing, with block offsets for random access.

Every id takes the minimum number of bits that the vocabulary needs.  Ids are
packed in blocks of 4096; a pack holds whole documents and looks like this
(little-endian)::

    magic "TIDPACK1" | width u32 | ids a block u32 | documents u64 | ids u64
    start of each document, and the end, in ids      u64 each
    offset of each block, and the end, in bytes      u64 each
    blocks: 64 ids in ``width`` 64-bit words, again and again

Numpy packs and unpacks 64 ids at a time; ``read_ids`` touches only the blocks
that a span of ids lies in.

A packed table is a Parquet folder with one pack a row, in ascending order of
the document id: range partitions hold consecutive ids, every partition numbers
its packs, and the starts of partitions are running sums of their counts.

Defined cases: null text counts as empty and has the end id alone; documents of
equal id are ordered by their text; null ids come first; a text longer than a
pack makes a longer pack; an empty table gives an empty folder.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator, Sequence
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactlake.llm.bpe import byte_alphabet
from redactlake.llm.tables import staged

BLOCK_IDS, PACK_IDS = 4096, 1 << 20
_MAGIC, _HEAD = b"TIDPACK1", struct.Struct("<8sIIQQ")
_MARKS = ".,;:!?"
_CACHED, _LONGEST_CACHED = 600_000, 64


# --- bits ------------------------------------------------------------------------
def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Ids in ``width`` bits each, padded to whole groups of 64."""
    padded = np.zeros(-(-len(ids) // 64) * 64, np.uint64)
    padded[: len(ids)] = ids
    groups = padded.reshape(-1, 64)
    words = np.zeros((len(groups), width), np.uint64)
    for j in range(64):
        k, shift = divmod(j * width, 64)
        words[:, k] |= groups[:, j] << np.uint64(shift)
        if shift + width > 64:
            words[:, k + 1] |= groups[:, j] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack_bits(data: bytes, width: int) -> np.ndarray:
    """All ids of whole groups, padding included."""
    words = np.frombuffer(data, "<u8").reshape(-1, width)
    groups = np.empty((len(words), 64), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        k, shift = divmod(j * width, 64)
        value = words[:, k] >> np.uint64(shift)
        if shift + width > 64:
            value = value | words[:, k + 1] << np.uint64(64 - shift)
        groups[:, j] = value & mask
    return groups.reshape(-1)


def write_pack(documents: Sequence[np.ndarray], width: int) -> bytes:
    starts = np.concatenate(([0], np.cumsum([len(d) for d in documents]))).astype("<u8")
    ids = np.concatenate(documents) if len(documents) else np.empty(0, np.uint64)
    blocks = [pack_bits(ids[i : i + BLOCK_IDS], width) for i in range(0, len(ids), BLOCK_IDS)]
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in blocks]))).astype("<u8")
    head = _HEAD.pack(_MAGIC, width, BLOCK_IDS, len(documents), len(ids))
    return b"".join([head, starts.tobytes(), offsets.tobytes(), *blocks])


def document_starts(pack: bytes) -> np.ndarray:
    """Starts of the documents in ids, and the end."""
    magic, _, _, documents, _ = _HEAD.unpack_from(pack)
    if magic != _MAGIC:
        raise ValueError("not a pack of token ids")
    return np.frombuffer(pack, "<u8", documents + 1, _HEAD.size)


def read_ids(pack: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a pack; reads only their blocks."""
    magic, width, block, documents, ids = _HEAD.unpack_from(pack)
    if magic != _MAGIC:
        raise ValueError("not a pack of token ids")
    stop = ids if stop is None else min(stop, ids)
    if start >= stop:
        return np.empty(0, np.uint32)
    at = _HEAD.size + 8 * (documents + 1)
    count = -(-ids // block) + 1
    offsets, payload = np.frombuffer(pack, "<u8", count, at), at + 8 * count
    first, last = start // block, (stop - 1) // block
    found = unpack_bits(memoryview(pack)[payload + int(offsets[first]) : payload + int(offsets[last + 1])], width)
    return found[start - first * block : stop - first * block].astype(np.uint32)


# --- encoding ------------------------------------------------------------------------
class WordEncoder:
    """The tokenizers library behind a bounded cache of words.

    For vocabularies whose words end at white space, which lower-case and compose
    letters and keep them apart from everything else.
    """

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(content)
        self.library.no_truncation()
        self.library.no_padding()
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.width = max(1, (size - 1).bit_length())
        self.model = self.library.model
        self.letter = {b: c for c, b in byte_alphabet().items()}
        self.layout = [struct.Struct(f"<{n}I") for n in range(24)]
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.mark = {m: self._whole([m])[0] for m in _MARKS}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        """Ids of letters.

        Lower-case letters in composed form are one word to the library, which
        neither normalises nor splits them further, so its BPE model takes them
        as they are; others go the whole way.
        """
        lower = word.lower()
        if not lower.isascii():
            if not lower.isalpha() or "Σ" in word or not is_normalized("NFC", lower):
                return self._whole([word])[0]
            lower = lower.encode().decode("latin-1").translate(self.letter)
        ids = [t.id for t in self.model.tokenize(lower)]
        return self.layout[len(ids)].pack(*ids) if len(ids) < len(self.layout) else np.array(ids, "<u4").tobytes()

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        found, others, old, new, mark, word = {}, [], self.old.get, self.new.get, self.mark, self._word
        for p in pieces:
            known = old(p)
            if known is None:
                if p.isalpha():
                    known = word(p)
                elif p[-1] in mark and (head := p[:-1]).isalpha():
                    known = (new(head) or old(head) or word(head)) + mark[p[-1]]
                else:
                    others.append(p)
                    continue
            found[p] = known
        if others:
            found.update(zip(others, self._whole(others), strict=True))
        if len(self.new) + len(found) > _CACHED:
            self.old, self.new = self.new, {}
        self.new.update((p, e) for p, e in found.items() if len(p) <= _LONGEST_CACHED)
        return found

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        rows, gaps, get = [], [], self.new.get
        for text in texts:
            text = text or ""
            if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # no white space to the library
                rows.append(self._whole([text]))
                continue
            pieces = text.split()
            row, at = list(map(get, pieces)), -1
            for _ in range(row.count(None)):
                at = row.index(None, at + 1)
                gaps.append((row, at, pieces[at]))
            rows.append(row)
        found = self._learn({p for _, _, p in gaps}) if gaps else {}
        for row, at, p in gaps:
            row[at] = found[p]
        return [np.frombuffer(b"".join(row), "<u4") for row in rows]


_encoders: dict[str, WordEncoder] = {}


def _encoder(content: str) -> WordEncoder:
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(content)
    return _encoders[key]


# --- tables ------------------------------------------------------------------------
def pack_table(df: DataFrame, vocabulary_path: str, end_id: int, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Rows ``part, start, ids, idents, pack``: packs in ascending order of the id; ``start`` counts within the part."""
    with open(vocabulary_path, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    rows = df.select(F.col(ident).alias("ident"), F.col(text).alias("t"))
    schema = T.StructType([
        T.StructField("part", T.LongType()), T.StructField("start", T.LongType()), T.StructField("ids", T.LongType()),
        T.StructField("idents", T.ArrayType(rows.schema["ident"].dataType)), T.StructField("pack", T.BinaryType()),
    ])

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = _encoder(shared.value), TaskContext.get().partitionId(), 0
        idents, documents, size, kind = [], [], 0, None

        def out() -> pa.RecordBatch:
            pack = write_pack(documents, encoder.width)
            columns = [pa.array([part]), pa.array([start]), pa.array([size]), pa.array([idents], pa.list_(kind)), pa.array([pack], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in source:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 32):
                some = batch.slice(at, 32)
                found = encoder.encode(some.column(1).to_pylist())
                for i, ids in zip(some.column(0).to_pylist(), found, strict=True):
                    idents.append(i)
                    documents.append(np.append(ids, np.uint32(end_id)))
                    size += len(ids) + 1
                    if size >= PACK_IDS:
                        yield out()
                        idents, documents, start, size = [], [], start + size, 0
        if documents:
            yield out()

    return rows.repartitionByRange("ident").sortWithinPartitions("ident", "t").mapInArrow(work, schema)


def read_packs(packs: DataFrame, ident: str = "doc_id") -> DataFrame:
    """``ident, start, n_tokens, ids_crc32, ids`` of each document of a packed table; ``start`` counts over the whole table."""
    element = packs.schema["idents"].dataType.elementType
    schema = T.StructType([
        T.StructField("part", T.LongType()), T.StructField("ident", element), T.StructField("at", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part, start, idents, pack in zip(*(batch.column(i) for i in range(4)), strict=True):
                data = pack.as_buffer()
                starts, ids = document_starts(data).astype(np.int64), read_ids(data).astype("<u4")
                each = [ids[a:b].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                n = len(each)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, part.as_py(), np.int64)), idents.values, pa.array(starts[:-1] + start.as_py()), pa.array(np.diff(starts)),
                    pa.array([zlib.crc32(e) for e in each], pa.int64()), pa.array(each, pa.binary()),
                ], names=schema.names)

    sums = packs.groupBy("part").agg(F.sum("ids").alias("n"))
    # one row a partition
    before = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    found = packs.select("part", "start", "idents", "pack").mapInArrow(work, schema).join(before, "part")
    return found.select(F.col("ident").alias(ident), (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "ids")


def packed(df: DataFrame, vocabulary_path: str, end_id: int, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """A packed table of ``df``, written to the shared folder and opened."""
    return staged(pack_table(df, vocabulary_path, end_id, text, ident), "packs")
