"""Stupid-backoff language-model scores, computed relationally.

The count table of all n-grams of all orders up to ``order`` is partitioned by
the n-grams' hash; the exploded n-grams of the documents meet it there, and the
scores are summed per document.  To move little, n-grams travel in blocks:

1. documents are dealt into chunks of about 8 MB by a hash of the row;
2. a chunk explodes its documents into n-grams, counts them and sends each
   bucket of hashes the distinct ones with their counts, sorted;
3. a bucket adds up the counts of all chunks (its part of the count table) and
   answers each chunk with the totals of the n-grams that it asked for;
4. a chunk meets its answers again and sums the scores of its documents.

An n-gram of any frequency is one entry of a chunk's block, so no bucket is hot.
Blocks are never empty: there are never more of them than distinct n-grams of the
chunks, however many chunks and buckets there are.
N-grams are hashes of 64 bits at any size of the corpus.

The score of a word after its history is the relative frequency of the longest
n-gram that occurs ``min_count`` times in the corpus (once suffices for single
words), times ``backoff`` for every order given up, be it unseen or longer than
what stands before the word.  A document's score is the sum of the natural
logarithms.  All documents are counted and all are scored.

Words are what white space of ASCII parts, lower-cased.  Defined cases: null,
empty and white-space texts have no words, score 0 and mean null; repeated rows
count as often as they come; null ids pass through; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_digest

from redactlake.llm.tables import give_back, group_key, tidied

ORDER, BACKOFF, MIN_COUNT = 3, 0.4, 2
CHUNK_BYTES, PACKED_BYTES = 8 << 20, 32 << 20
_MULTIPLIER, _FINISH = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9FB21C651E98DF25)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _grams(texts: list[str | None], order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Words of each text; for each order the hashes of the n-grams, and the places of their last words."""
    digests = [b"".join(map(xxh3_64_digest, _words(t))) for t in texts]
    sizes = np.array([len(d) // 8 for d in digests], np.int64)
    words = np.frombuffer(b"".join(digests), "<u8").astype(np.uint64)
    del digests
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    hashes, ends, mixed = [], [], words
    for n in range(1, order + 1):
        if n > 1:
            mixed = mixed[:-1] * _MULTIPLIER + words[n - 1 :] if len(mixed) else mixed
        at = np.flatnonzero(place >= n - 1)
        h = mixed[at - (n - 1)] + np.uint64(n)
        h ^= h >> np.uint64(32)
        h *= _FINISH
        h ^= h >> np.uint64(29)
        hashes.append(h)
        ends.append(at)
    return sizes, hashes, ends


def squeezed(values: np.ndarray) -> bytes:
    """Integers byte by byte, compressed: all low bytes first, the high ones are mostly zeros."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def spread(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def _packed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by chunk, many in one compressed block: a shuffle's own compression sees too little at once."""

    def blocks(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(some).sort_by("chunk").combine_chunks()
        chunk = table["chunk"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
        docs = [_stream(table.slice(a, b - a).drop_columns(["chunk"])) for a, b in zip(cuts, cuts[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(chunk[cuts[:-1]]), pa.array(docs, pa.binary())], names=["chunk", "docs"])

    waiting, size = [], 0
    for batch in source:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        size += batch.nbytes
        if size > PACKED_BYTES:
            yield blocks(waiting)
            waiting, size = [], 0
    if waiting:
        yield blocks(waiting)


def _stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in packed["docs"]]).combine_chunks()


def _scores(totals: list[np.ndarray], ends: list[np.ndarray], count: int, corpus: int, backoff: float, min_count: int) -> np.ndarray:
    """Natural logarithm of each word's score; ``totals`` by order, aligned with ``ends``."""
    full = []
    for total, at in zip(totals, ends, strict=True):
        column = np.zeros(count)
        column[at] = total
        full.append(column)
    score = np.log(full[0] / corpus)
    for n in range(1, len(full)):
        # before the n-gram ending at i stands the history ending at i - 1, of one order less
        history = np.concatenate(([1.0], full[n - 1][:-1]))
        found = full[n] >= min_count
        score = np.where(found, np.log(np.where(found, full[n], 1.0) / np.where(found, history, 1.0)), score + np.log(backoff))
    return score


def _then_tidy(out: pa.Table) -> pa.Table:
    give_back()
    return out


def backoff_scores(
    df: DataFrame, text: str = "text", ident: str = "doc_id", order: int = ORDER, backoff: float = BACKOFF, min_count: int = MIN_COUNT
) -> DataFrame:
    """``ident, n_words, log_score, mean_log_score`` of every row."""
    rows = df.select(F.col(ident).alias("ident"), F.col(text).alias("t"))

    def sizes(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = size = 0
        for batch in source:
            for t in batch.column(0).to_pylist():
                raw = (t or "").encode()
                words, size = words + len(raw.split()), size + len(raw)
        yield pa.RecordBatch.from_arrays([pa.array([words]), pa.array([size])], names=["words", "bytes"])

    whole = rows.select("t").mapInArrow(sizes, "words long, bytes long").agg(F.sum("words").alias("words"), F.sum("bytes").alias("bytes")).collect()[0]
    corpus, chunks = whole["words"] or 0, max(1, -(-(whole["bytes"] or 0) // CHUNK_BYTES))
    buckets = chunks
    borders = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)

    numbered = rows.withColumn("chunk", F.pmod(F.xxhash64(group_key("ident"), "t"), F.lit(chunks)))
    dealt = numbered.mapInArrow(tidied(_packed), "chunk long, docs binary").repartition("chunk")

    def ask(table: pa.Table) -> pa.Table:
        _, hashes, _ = _grams(_unpacked(table)["t"].to_pylist(), order)
        distinct, counts = np.unique(np.concatenate(hashes), return_counts=True)
        cuts = [0, *np.searchsorted(distinct, borders).tolist(), len(distinct)]
        parts = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
        chunk = table["chunk"][0].as_py()
        return pa.table({
            "bucket": pa.array(parts, pa.int64()), "chunk": pa.array([chunk] * len(parts), pa.int64()),
            # sorted, so differences are smaller
            "hashes": pa.array([squeezed(np.diff(distinct[cuts[b] : cuts[b + 1]], prepend=np.uint64(0))) for b in parts], pa.binary()),
            "counts": pa.array([squeezed(counts[cuts[b] : cuts[b + 1]]) for b in parts], pa.binary()),
        })

    def answer(table: pa.Table) -> pa.Table:
        asked = [np.cumsum(spread(x), dtype=np.uint64) for x in table["hashes"].to_pylist()]
        counts = np.concatenate([spread(x) for x in table["counts"].to_pylist()]).astype(np.float64)
        _, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        totals = np.bincount(inverse, weights=counts).astype(np.uint64)[inverse]
        ends = np.cumsum([len(a) for a in asked])
        return pa.table({
            "chunk": table["chunk"], "bucket": table["bucket"],
            "totals": pa.array([squeezed(x) for x in np.split(totals, ends[:-1])], pa.binary()),
        })

    schema = T.StructType([
        rows.schema["ident"], T.StructField("n_words", T.LongType()), T.StructField("log_score", T.DoubleType()), T.StructField("mean_log_score", T.DoubleType()),
    ])

    def score(packed: pa.Table, answers: pa.Table) -> pa.Table:
        docs = _unpacked(packed)
        n, hashes, ends = _grams(docs["t"].to_pylist(), order)
        _, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        parts = [x for _, x in sorted(zip(answers["bucket"].to_pylist(), answers["totals"].to_pylist(), strict=True))]
        known = np.concatenate([spread(x) for x in parts]).astype(np.float64)[inverse] if len(inverse) else np.empty(0)
        totals = np.split(known, np.cumsum([len(h) for h in hashes])[:-1])
        words = int(n.sum())
        each = _scores(totals, ends, words, corpus, backoff, min_count) if words else np.empty(0)
        sums = np.bincount(np.repeat(np.arange(len(n)), n), weights=each, minlength=len(n))
        return pa.table({
            "ident": docs["ident"], "n_words": pa.array(n), "log_score": pa.array(sums),
            "mean_log_score": pa.array(np.where(n > 0, sums / np.maximum(n, 1), 0.0), mask=n == 0),
        })

    # the number of arguments tells Spark whether a key is wanted
    tidy1 = lambda work: lambda a: _then_tidy(work(a))
    tidy2 = lambda work: lambda a, b: _then_tidy(work(a, b))
    asked = dealt.groupBy("chunk").applyInArrow(tidy1(ask), "bucket long, chunk long, hashes binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(tidy1(answer), "chunk long, bucket long, totals binary")
    found = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(tidy2(score), schema)
    return found.select(F.col("ident").alias(ident), "n_words", "log_score", "mean_log_score")
