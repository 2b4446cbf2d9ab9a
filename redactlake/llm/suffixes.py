"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A byte goes when it is covered by a string of ``length`` bytes that also starts
in a document with a smaller id.  Strings are judged on the input, wherever they
start; matches never cross documents.

*Which suffixes are sorted.*  In every string of ``length`` bytes the ``ANCHOR``
bytes with the least hash (of equal ones the leftmost) are its anchor.  Equal
strings have equal anchors at equal offsets, so it suffices to sort the suffixes
that start at anchors, each with the bytes before it that its strings reach.  One
anchor stands for about fourteen strings.

1. Texts that are wholly equal are folded: all but the first id's are one repeat.
   The others are dealt into *chunks* of about ``CHUNK_BYTES``.
2. A chunk sends the hashes of its anchors, delta-coded, to buckets of hashes and
   learns which ones other documents have too.  Only those suffixes go on; the
   hash decides nothing else.
3. A chunk sorts its suffixes, by hash and then by bytes, into a run, drops the
   strings whose earlier document it sees itself, and sends each bucket its part of
   the run *front-coded*: per suffix the length of the prefix it shares with the one
   before, and the rest.
4. A bucket combines the runs of all chunks with a *loser tree*.  Each contestant
   carries the length of the prefix that it shares with the last suffix that left
   the tree; different lengths decide without a look at the bytes, equal ones
   compare from there on, so no known prefix is compared again.  The lengths that
   the tree yields tell which suffixes share how many bytes; suffixes that also
   share the bytes before their anchors hold equal strings, and the smallest id
   keeps them.
5. A chunk learns which of its strings go and cuts them out.

An anchor that ``HOT`` documents or more share would bring all of them to one
bucket, as the bytes around a common passage differ.  Its strings travel one by
one, under the hash of all their bytes, and spread over all buckets.

Blocks are never empty, so there are never more of them than suffixes.

Defined cases: null text equals empty text; texts shorter than ``length`` lose
nothing; a null id is larger than all others; rows that share an id do not remove
from each other; repeated rows get equal results; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactlake.llm.tables import give_back

LENGTH, ANCHOR = 50, 24
MOST_OFFSETS = 31  # places of an anchor in its strings; they are bits of a number
CHUNK_BYTES = 8 << 20
HOT = 10_000
RUN_ROWS = 100_000  # suffixes that are sorted at once
NO_ID = (1 << 63) - 1  # stands for a null id
_SEGMENT = 60_000  # its places fit into 16 bits
_HASH_BITS = 48
_KEY = 8  # bytes of the hash before the bytes of a suffix
_MULTIPLIER, _FINISH = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_FOLDED = 500_000


def anchor_size(length: int) -> int:
    return min(length, max(ANCHOR, length - MOST_OFFSETS + 1))


# --- anchors -------------------------------------------------------------------------
def hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` bytes, the lowest 16 bits zero."""

    def powers(k: int) -> np.ndarray:
        if k == 1:
            return data.astype(np.uint64) + np.uint64(1)
        m = k // 2
        h = powers(m)
        h = h[:-m] * np.uint64(pow(_MULTIPLIER, m, 1 << 64)) + h[m:]
        return h[:-1] * np.uint64(_MULTIPLIER) + data[k - 1 :] + np.uint64(1) if k % 2 else h

    h = powers(size)
    h ^= h >> np.uint64(31)
    h *= _FINISH
    h ^= h >> np.uint64(29)
    return h & np.uint64(0xFFFFFFFFFFFF0000)


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` neighbours."""
    span = 1
    while 2 * span <= size:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = size - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values


class Texts:
    """Texts behind one another, and which places start a string within a text."""

    def __init__(self, texts: list[bytes], length: int) -> None:
        self.length = length
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.borders = np.concatenate(([0], np.cumsum(self.sizes)))
        self.starts = np.ones(len(self.data), bool)
        last = self.borders[1:, None] - np.arange(1, length)
        self.starts[last[last >= self.borders[:-1, None]]] = False

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash (48 bits), place, and first and last string of every anchor."""
        size = anchor_size(self.length)
        found = []
        for begin in range(0, max(len(self.data) - self.length + 1, 0), _SEGMENT):
            part = self.data[begin : begin + _SEGMENT + self.length - 1]
            h = hashes(part, size)
            least = _least(h + np.arange(len(h), dtype=np.uint64), self.length - size + 1)  # the leftmost of equal ones
            valid = self.starts[begin : begin + len(least)]
            cut = np.flatnonzero((least[1:] != least[:-1]) | (valid[1:] != valid[:-1])) + 1
            first = np.concatenate(([0], cut))
            last = np.append(cut, len(least)) - 1
            some = valid[first]
            first, last, key = first[some], last[some], least[first[some]]
            # the least hashes of windows crowd at the low end; multiplied, they spread over all buckets
            spread = (key >> np.uint64(16)) * np.uint64(_MULTIPLIER) & np.uint64((1 << _HASH_BITS) - 1)
            found.append((spread, (key & np.uint64(0xFFFF)).astype(np.int64) + begin, first + begin, last + begin))
        if not found:
            return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def owner(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.borders, places, "right") - 1


# --- runs ----------------------------------------------------------------------------
class Suffixes:
    """Sorted suffixes: ``keys`` (hash and bytes), ``left`` (bytes before the anchor), ``ids``, ``want`` (bits of offsets), ``places``."""

    def __init__(self, keys: np.ndarray, left: np.ndarray, ids: np.ndarray, want: np.ndarray, places: np.ndarray, lcp: np.ndarray) -> None:
        self.keys, self.left, self.ids, self.want, self.places, self.lcp = keys, left, ids, want, places, lcp

    def __len__(self) -> int:
        return len(self.ids)


def shared_prefixes(keys: np.ndarray) -> np.ndarray:
    """Bytes that each key shares with the one before."""
    lcp = np.zeros(len(keys), np.int64)
    if len(keys) > 1:
        differ = keys[1:] != keys[:-1]
        lcp[1:] = np.where(differ.any(1), differ.argmax(1), keys.shape[1])
    return lcp


def _order(matrix: np.ndarray) -> np.ndarray:
    return np.argsort(np.ascontiguousarray(matrix).view(f"S{matrix.shape[1]}").ravel(), kind="stable")


def sorted_suffixes(texts: Texts, h: np.ndarray, places: np.ndarray, first: np.ndarray, last: np.ndarray, ids: np.ndarray) -> Suffixes:
    """The suffixes at ``places``, ``ids`` by suffix; the strings that start from ``first`` to ``last`` belong to them."""
    length, offsets = texts.length, texts.length - anchor_size(texts.length)
    least, most = places - last, places - first
    padded = np.concatenate((np.zeros(offsets, np.uint8), texts.data, np.zeros(length, np.uint8)))
    around = sliding_window_view(padded, offsets + length)[places]
    keys = np.empty((len(places), _KEY + length), np.uint8)
    keys[:, :_KEY] = h.astype(">u8").view(np.uint8).reshape(-1, _KEY)
    # bytes that no string of the anchor holds are blanked out
    keys[:, _KEY:] = np.where(np.arange(length) < (length - least)[:, None], around[:, offsets:], 0)
    left = np.where(np.arange(offsets) >= (offsets - most)[:, None], around[:, :offsets], 0).astype(np.uint8)
    want = ((2 << most) - (1 << least)).astype(np.uint32)
    by = _order(np.concatenate((keys, left, want.astype(">u4").view(np.uint8).reshape(-1, 4)), 1))
    keys = keys[by]
    return Suffixes(keys, left[by], ids[by], want[by], places[by], shared_prefixes(keys))


def repeats(s: Suffixes, length: int) -> np.ndarray:
    """For each suffix the bits of the offsets whose strings a smaller id has too."""
    out, left_hash = np.zeros(len(s), np.uint32), np.zeros(len(s), np.uint64)
    offsets = s.left.shape[1]
    for o in range(offsets + 1):
        if o:
            left_hash = (left_hash + s.left[:, offsets - o] + np.uint64(1)) * _FINISH
            left_hash ^= left_hash >> np.uint64(32)
        some = np.flatnonzero(s.want >> np.uint32(o) & np.uint32(1))
        if len(some) < 2:
            continue
        # suffixes that share all bytes of the string from the anchor on stand together
        group = np.cumsum(s.lcp < _KEY + length - o)[some]
        several = np.bincount(group)[group] > 1
        some, group = some[several], group[several]
        if not len(some):
            continue
        key = (left_hash[some] ^ (group.astype(np.uint64) * np.uint64(_MULTIPLIER))) * _FINISH
        by = np.argsort(key)
        new = np.concatenate(([True], key[by][1:] != key[by][:-1]))
        number = np.cumsum(new) - 1
        head = by[np.flatnonzero(new)][number]
        before = s.left[:, offsets - o :]
        if (group[by] != group[head]).any() or (before[some[by]] != before[some[head]]).any():  # a hash met twice: by the bytes
            whole = np.concatenate((group.astype(">u8").view(np.uint8).reshape(-1, 8), before[some]), 1)
            number = np.unique(whole, axis=0, return_inverse=True)[1].ravel()
            by = np.argsort(number, kind="stable")
            number = number[by]
            new = np.concatenate(([True], number[1:] != number[:-1]))
        ids = s.ids[some[by]]
        smallest = np.minimum.reduceat(ids, np.flatnonzero(new))[number]
        out[some[by][ids > smallest]] |= np.uint32(1 << o)
    return out


def _planes(values: np.ndarray) -> np.ndarray:
    """Whole numbers byte by byte; the high bytes are mostly equal."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)


def _rows(planes: np.ndarray, kind: type) -> np.ndarray:
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _blob(*parts) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(parts, pickle.HIGHEST_PROTOCOL))


def _parts(blob: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def front_coded(s: Suffixes, begin: int, end: int) -> bytes:
    """A stretch of a run: shared prefix lengths, the other bytes, and what belongs to each suffix."""
    keys, lcp = s.keys[begin:end], s.lcp[begin:end].copy()
    lcp[:1] = 0
    rest = keys[np.arange(keys.shape[1]) >= lcp[:, None]]
    return _blob(lcp.astype(np.uint8), rest, s.left[begin:end], _planes(s.ids[begin:end]), _planes(s.want[begin:end]), _planes(s.places[begin:end]))


def decoded(blob: bytes, size: int) -> tuple[list[bytes], list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, shared prefix lengths, left bytes, ids, bits and places of a stretch."""
    lcp, rest, left, ids, want, places = _parts(blob)
    rest, shared, keys, at, key = rest.tobytes(), lcp.tolist(), [], 0, b""
    for n in shared:
        to = at + size - n
        key = key[:n] + rest[at:to]
        keys.append(key)
        at = to
    return keys, shared, left, _rows(ids, np.int64), _rows(want, np.uint32), _rows(places, np.int64)


def merged(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Run, place in the run and shared prefix length of all keys in order, by a loser tree.

    A node keeps the run that lost there and the length of the prefix that its key
    shares with the key that beat it, which is the last one that left the tree on
    the way of the run that moves up next.
    """
    if not runs:
        return [], [], []
    width = 1 << max(len(runs) - 1, 0).bit_length()
    size = len(runs[0][0][0])
    end = b"\xff" * size  # behind every key: their first byte is zero
    keys = [r[0] for r in runs]
    shared = [r[1] for r in runs]
    head = [k[0] for k in keys] + [end] * (width - len(runs))
    at, sizes = [0] * width, [len(k) for k in keys] + [0] * (width - len(runs))
    loser, known = [0] * width, [0] * width

    def compared(x: bytes, y: bytes, n: int) -> int:
        """Shared prefix of two keys that share ``n`` bytes at least."""
        apart = int.from_bytes(x[n:]) ^ int.from_bytes(y[n:])
        return size - (apart.bit_length() + 7) // 8

    def first(node: int) -> int:
        if node >= width:
            return node - width
        a, b = first(2 * node), first(2 * node + 1)
        if head[b] < head[a]:
            a, b = b, a
        loser[node], known[node] = b, compared(head[a], head[b], 0)
        return a

    run, n = first(1), 0
    out_run, out_at, out_lcp = [], [], []
    while head[run] is not end:
        i = at[run]
        out_run.append(run)
        out_at.append(i)
        out_lcp.append(n)
        at[run] = i = i + 1
        if i < sizes[run]:
            head[run], n = keys[run][i], shared[run][i]
        else:
            head[run], n = end, 0
        node = (width + run) >> 1
        while node:
            m = known[node]
            if m > n:
                loser[node], run = run, loser[node]
                known[node], n = n, m
            elif m == n:
                x, y = head[run], head[loser[node]]
                known[node] = compared(x, y, n)
                if y[n:] < x[n:]:
                    loser[node], run = run, loser[node]
            node >>= 1
    return out_run, out_at, out_lcp


def combined(blobs: list[bytes], sources: list[int], length: int) -> tuple[Suffixes, np.ndarray]:
    """The suffixes of all stretches in one order, and where each came from."""
    stretches = [decoded(b, _KEY + length) for b in blobs]
    run, at, lcp = merged([s[:2] for s in stretches])
    run, at = np.array(run, np.int64), np.array(at, np.int64)
    base = np.concatenate(([0], np.cumsum([len(s[0]) for s in stretches])))[:-1]
    by = base[run] + at
    left, ids, want, places = (np.concatenate([s[i] for s in stretches])[by] for i in (2, 3, 4, 5))
    return Suffixes(np.empty(0), left, ids, want, places, np.array(lcp, np.int64)), np.array(sources, np.int64)[run]


# --- steps ---------------------------------------------------------------------------
def _folded(rows: DataFrame) -> DataFrame:
    """``sha, id, t``: each task sends a text once, and its smallest id if that came later."""

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["sha", "id", "t"]
        seen: dict[bytes, list[int]] = {}

        def later() -> pa.RecordBatch:
            some = [(sha, now) for sha, (sent, now) in seen.items() if now < sent]
            return pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in some], pa.binary()), pa.array([i for _, i in some], pa.int64()), pa.nulls(len(some), pa.binary())], names=names
            )

        for batch in source:
            new = []
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                sha, ident = hashlib.sha256(data).digest(), NO_ID if ident is None else ident
                if sha in seen:
                    seen[sha][1] = min(seen[sha][1], ident)
                else:
                    seen[sha] = [ident, ident]
                    new.append((sha, ident, data))
                if len(new) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*new, strict=True), _KINDS, strict=True)], names=names)
                    new = []
            if new:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*new, strict=True), _KINDS, strict=True)], names=names)
            if len(seen) > _FOLDED:
                yield later()
                seen.clear()
        yield later()

    return rows.mapInArrow(work, "sha binary, id long, t binary")


_KINDS = [pa.binary(), pa.int64(), pa.binary()]


def _chunk_texts(table: pa.Table, length: int) -> tuple[list[bytes], np.ndarray, Texts]:
    """Digests, smallest ids and texts of a chunk, always in the same order."""
    texts: dict[bytes, bytes] = {}
    ids: dict[bytes, int] = {}
    for sha, ident, text in zip(table["sha"].to_pylist(), table["id"].to_pylist(), table["t"], strict=True):
        ids[sha] = min(ids.get(sha, NO_ID), ident)
        if text.is_valid and sha not in texts:
            texts[sha] = text.as_buffer().to_pybytes()
    shas = sorted(texts)
    return shas, np.array([ids[s] for s in shas], np.int64), Texts([texts[s] for s in shas], length)


def _asked(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchor hashes of a chunk, and in how many of its texts each stands."""
    h, places, _, _ = texts.anchors()
    owner = texts.owner(places)
    by = np.lexsort((owner, h))
    h, owner = h[by], owner[by]
    other = np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))) if len(h) else np.empty(0, bool)
    return np.unique(h[other], return_counts=True)


def _cuts(h: np.ndarray, buckets: int) -> list[int]:
    """Where the buckets begin and end among rising hashes."""
    borders = np.array([-(-(b << _HASH_BITS) // buckets) for b in range(1, buckets)], np.uint64)
    return [0, *np.searchsorted(h, borders).tolist(), len(h)]


def _sent(texts: Texts, ids: np.ndarray, code: np.ndarray, anchors: tuple) -> Iterator[tuple[Suffixes, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of the suffixes to send, what is known to go already (places, bits), and suffixes alike: place and place that speaks for it."""
    h, places, first, last = anchors
    plain, hot = code == 1, code == 2
    chosen = [(h[plain], places[plain], first[plain], last[plain])]
    if hot.any():
        counts = last[hot] - first[hot] + 1
        each = np.repeat(first[hot], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        for begin in range(0, len(each), RUN_ROWS):
            some = each[begin : begin + RUN_ROWS]
            windows = sliding_window_view(texts.data, texts.length)[some]
            whole = hashes(windows.reshape(-1), texts.length)[:: texts.length] >> np.uint64(16)
            chosen.append((whole, some, some, some))
    for part in chosen:
        for begin in range(0, len(part[0]), RUN_ROWS):
            some = tuple(x[begin : begin + RUN_ROWS] for x in part)
            yield _resolved(sorted_suffixes(texts, *some, ids[texts.owner(some[1])]), texts.length)


def _resolved(s: Suffixes, length: int) -> tuple[Suffixes, np.ndarray, np.ndarray, np.ndarray]:
    gone = repeats(s, length)
    known = np.flatnonzero(gone)
    # of suffixes alike in one text, one is sent
    asks = s.want & ~gone
    alike = np.zeros(len(s), bool)
    alike[1:] = (s.lcp[1:] == s.keys.shape[1]) & (s.left[1:] == s.left[:-1]).all(1) & (asks[1:] == asks[:-1]) & (s.ids[1:] == s.ids[:-1]) & (asks[1:] > 0)
    speaker = np.maximum.accumulate(np.where(alike, 0, np.arange(len(s))))
    send = np.flatnonzero((asks > 0) & ~alike)
    keys = s.keys[send]
    out = Suffixes(keys, s.left[send], s.ids[send], asks[send], s.places[send], shared_prefixes(keys))
    return out, np.stack((s.places[known], gone[known].astype(np.int64))), s.places[alike], s.places[speaker[alike]]


def _cut_out(texts: Texts, places: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes go, and how many bytes and runs of them in each text."""
    starts = np.zeros(len(texts.data) + 1, np.int32)
    for o in range(MOST_OFFSETS):
        starts[places[(bits >> o & 1) > 0] - o] = 1
    running = np.cumsum(starts)[:-1] if len(texts.data) else np.empty(0, np.int64)
    gone = running > 0
    gone[texts.length :] = running[texts.length :] > running[: -texts.length]
    opens = gone.copy()
    opens[1:] &= ~gone[:-1]
    begin = texts.borders[:-1][texts.sizes > 0]
    opens[begin] = gone[begin]
    sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x, dtype=np.int64)))[texts.borders])
    return gone, sums(gone), sums(opens)


def repeated_strings(df: DataFrame, text: str = "text", ident: str = "doc_id", length: int = LENGTH, keep_text: bool = True, hot: int = HOT) -> DataFrame:
    """``ident, n_bytes, n_removed, n_spans, kept_sha256`` of every row, and ``kept`` (the bytes left) if ``keep_text``.

    What is left need not be valid UTF-8: strings are strings of bytes.
    """
    rows = df.select(F.col(f"`{ident}`").alias("ident"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    chunks = max(1, -(-size // CHUNK_BYTES))
    buckets = -(-chunks // 2)
    numbered = rows.select(F.col("ident").cast("bigint").alias("id"), "t")
    dealt = _folded(numbered).withColumn("chunk", F.pmod(F.xxhash64("sha"), F.lit(chunks)).cast("bigint"))

    def tidy(work):
        """``work``, and what it freed goes back to the system."""

        def done(*tables: pa.Table) -> pa.Table:
            out = work(*tables)
            give_back()
            return out

        # the number of arguments tells Spark whether the key is wanted
        return (lambda a: done(a)) if work in (ask, answer, merge) else (lambda a, b: done(a, b))

    def ask(table: pa.Table) -> pa.Table:
        _, _, texts = _chunk_texts(table, length)
        h, counts = _asked(texts)
        cuts = _cuts(h, buckets)
        parts = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
        blobs = [_blob(_planes(np.diff(h[cuts[b] : cuts[b + 1]], prepend=np.uint64(0))), _planes(counts[cuts[b] : cuts[b + 1]])) for b in parts]
        chunk = table["chunk"][0].as_py() if table.num_rows else 0
        return pa.table([pa.array(parts, pa.int64()), pa.array([chunk] * len(parts), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "chunk", "blob"])

    def answer(table: pa.Table) -> pa.Table:
        asked = [_parts(b) for b in table["blob"].to_pylist()]
        h = [np.cumsum(_rows(a, np.uint64), dtype=np.uint64) for a, _ in asked]
        counts = np.concatenate([_rows(c, np.int64) for _, c in asked])
        _, number = np.unique(np.concatenate(h), return_inverse=True)
        total = np.bincount(number, weights=counts)[number]
        code = (total > 1).astype(np.uint8) + (total >= hot)
        blobs = [_blob(x) for x in np.split(code, np.cumsum([len(x) for x in h])[:-1])]
        return pa.table([table["chunk"], table["bucket"], pa.array(blobs, pa.binary())], names=["chunk", "bucket", "blob"])

    def send(docs: pa.Table, answers: pa.Table) -> pa.Table:
        _, ids, texts = _chunk_texts(docs, length)
        out = []
        if answers.num_rows:
            anchors = texts.anchors()
            parts = sorted(zip(answers["bucket"].to_pylist(), answers["blob"].to_pylist(), strict=True))
            codes = np.concatenate([_parts(b)[0] for _, b in parts])
            code = codes[np.unique(anchors[0], return_inverse=True)[1]]
            chunk = docs["chunk"][0].as_py()
            for run, known, alike, speaker in _sent(texts, ids, code, anchors):
                cuts = _cuts(run.keys[:, :_KEY].copy().view(">u8").ravel().astype(np.uint64), buckets)
                out += [(b, chunk, front_coded(run, cuts[b], cuts[b + 1])) for b in range(buckets) if cuts[b] < cuts[b + 1]]
                if known.size or len(alike):
                    out.append((-1 - chunk, chunk, _blob(_planes(known[0]), _planes(known[1]), _planes(alike), _planes(speaker))))
        columns = list(zip(*out, strict=True)) or [[]] * 3
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "chunk", "blob"])

    def merge(table: pa.Table) -> pa.Table:
        if not table.num_rows or table["bucket"][0].as_py() < 0:  # what a chunk knows itself
            return table.select(["chunk", "blob"])
        s, source = combined(table["blob"].to_pylist(), table["chunk"].to_pylist(), length)
        gone = repeats(s, length)
        empty = _planes(np.empty(0, np.int64))
        chunks, blobs = [], []
        some = np.flatnonzero(gone)
        some = some[np.argsort(source[some], kind="stable")]
        for own in np.split(some, np.flatnonzero(np.diff(source[some])) + 1):
            if len(own):
                chunks.append(int(source[own[0]]))
                blobs.append(_blob(_planes(s.places[own]), _planes(gone[own].astype(np.int64)), empty, empty))
        return pa.table([pa.array(chunks, pa.int64()), pa.array(blobs, pa.binary())], names=["chunk", "blob"])

    fields = [("sha", T.BinaryType()), ("least", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha", T.StringType())]
    fields += [("kept", T.BinaryType())] if keep_text else []
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def cut(docs: pa.Table, replies: pa.Table) -> pa.Table:
        shas, ids, texts = _chunk_texts(docs, length)
        parts = [[_rows(x, np.int64) for x in _parts(b)] for b in replies["blob"].to_pylist()]
        places, bits, alike, speaker = (np.concatenate([p[i] for p in parts] or [np.empty(0, np.int64)]) for i in range(4))
        if len(alike):
            by = np.argsort(places, kind="stable")
            # bits of a place may come from more than one bucket or run
            unique, begin = np.unique(places[by], return_index=True)
            joined = np.bitwise_or.reduceat(bits[by], begin) if len(by) else bits
            at = np.searchsorted(unique, speaker)
            known = (at < len(unique)) & (unique[np.minimum(at, len(unique) - 1)] == speaker) if len(unique) else np.zeros(len(speaker), bool)
            places, bits = np.concatenate((places, alike[known])), np.concatenate((bits, joined[at[known]]))
        gone, removed, spans = _cut_out(texts, places, bits)
        kept = []
        for i in range(len(shas)):
            own = slice(texts.borders[i], texts.borders[i + 1])
            kept.append(texts.data[own][~gone[own]].tobytes())
        columns = [pa.array(shas, pa.binary()), pa.array(ids), pa.array(removed), pa.array(spans), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
        return pa.table(columns + ([pa.array(kept, pa.binary())] if keep_text else []), names=schema.names)

    blocks = "bucket long, chunk long, blob binary"
    asked = dealt.groupBy("chunk").applyInArrow(tidy(ask), blocks)
    answers = asked.groupBy("bucket").applyInArrow(tidy(answer), "chunk long, bucket long, blob binary")
    runs = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(tidy(send), blocks)
    replies = runs.groupBy("bucket").applyInArrow(tidy(merge), "chunk long, blob binary")
    found = dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(tidy(cut), schema)

    own = rows.select("ident", F.unhex(F.sha2("t", 256)).alias("sha"), F.octet_length("t").cast("bigint").alias("n_bytes"))
    met = own.join(found, "sha")
    # of equal texts, those of larger ids repeat the first one wholly
    copy = (F.coalesce(F.col("ident").cast("bigint"), F.lit(NO_ID)) > F.col("least")) & (F.col("n_bytes") >= length)
    result = met.select(
        F.col("ident").alias(ident), "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("bigint")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha")).alias("kept_sha256"),
        *([F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if keep_text else []),
    )
    return result
