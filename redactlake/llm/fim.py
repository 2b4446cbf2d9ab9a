"""Fill-in-middle transformation with unit ends marked in 64-bit words (SWAR).

A *unit* is a word with the white space before it; white space that ends a text
is a unit of its own (white space: ``[\\x20\\x09-\\x0D]``).  A seeded hash of the id
draws the two places, counted in units, that cut a text into prefix, middle and
suffix, and the form that the result takes:

* ``plain``: the text as it is;
* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle;
* ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle.

Words are never split out.  Every text is laid out in whole 64-bit words, padded
with blanks, and a batch of texts is one array of words.  Arithmetic on eight
bytes at once marks the bytes that end a unit; ``bitwise_count`` counts the marks
of each word and their running sum, searched for a unit's number, gives the word
that holds its end; a product of that word's marks selects the byte in it.  Cuts
fall behind a blank or before one, so they never split a character.

Every row is worked on where it is read; nothing is shuffled and nothing depends
on other rows.

Defined cases: a null text is an empty one; an empty text, and one that holds a
sentinel, stays plain; a null id is hashed as an empty one; repeated rows get
equal results; an empty table gives an empty result; the other columns, whatever
their names, are carried, except those that results replace.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactlake.llm.tables import replace_columns

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM_RATE, SEED = 50, 80, 42  # percent of the texts transformed, percent of those in the form spm
SLICE_BYTES = 4 << 20
RESULTS = ["n_units", "form", "prefix_chars", "middle_chars", "output"]

_LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
_HIGH = np.uint64(0x8080808080808080)
_EACH = np.uint64(0x0101010101010101)


def _bytes(value: int) -> np.uint64:
    """A word with ``value`` in each of its bytes."""
    return np.uint64(value * 0x0101010101010101)


def blank_marks(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is white space; no sum carries into the next byte."""
    low = words & _LOW
    no_blank = ((words ^ _bytes(0x20)) & _LOW) + _LOW | (words ^ _bytes(0x20))
    from_tab, past_return = low + _bytes(0x80 - 0x09), low + _bytes(0x80 - 0x0E)
    return (~no_blank | (from_tab & ~past_return & ~words)) & _HIGH


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in whole words, each behind the last and followed by one to eight blanks, and the borders between them."""
    sizes = np.array([len(t) // 8 + 1 for t in texts], np.int64)
    data = b"".join([t + b" " * (8 - len(t) % 8) for t in texts])
    return np.frombuffer(data, "<u8"), np.concatenate(([0], np.cumsum(sizes)))


def end_marks(words: np.ndarray, borders: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The high bit of every byte that ends a unit of its text."""
    blank = blank_marks(words)
    follows = (blank >> np.uint64(8)) | (np.append(blank[1:], _HIGH) << np.uint64(56))
    ends = ~blank & follows & _HIGH
    # white space that ends a text ends a unit; after a word the mark is there already
    full = np.flatnonzero(sizes)
    last = sizes[full] - 1
    np.bitwise_or.at(ends, borders[full] + last // 8, np.uint64(0x80) << (8 * (last % 8)).astype(np.uint64))
    return ends


def select_mark(marks: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The byte of each word that holds its mark of that rank (from 1)."""
    # byte j of the product counts the marks of the bytes 0 to j
    counts = (marks >> np.uint64(7)) * _EACH
    reached = ((counts | _HIGH) - rank.astype(np.uint64) * _EACH) & _HIGH
    return 8 - np.bitwise_count(reached).astype(np.int64)


class Units:
    """The units of a batch of texts: how many each has, and the byte behind any of them."""

    def __init__(self, texts: list[bytes]) -> None:
        words, self.borders = laid_out(texts)
        self.marks = end_marks(words, self.borders, np.array([len(t) for t in texts], np.int64))
        self.running = np.cumsum(np.bitwise_count(self.marks), dtype=np.int64)
        upto = np.append(0, self.running)[self.borders]
        self.before, self.counts = upto[:-1], np.diff(upto)

    def ends(self, number: np.ndarray) -> np.ndarray:
        """For each text, the byte behind its first ``number`` units."""
        some = np.flatnonzero(number > 0)
        wanted = self.before[some] + number[some]
        at = np.searchsorted(self.running, wanted)
        rank = wanted - (self.running[at] - np.bitwise_count(self.marks[at]))
        out = np.zeros(len(number), np.int64)
        out[some] = 8 * (at - self.borders[some]) + select_mark(self.marks[at], rank) + 1
        return out


def draws(idents: list, seed: int) -> np.ndarray:
    """Four numbers of 32 bits for each id."""
    heads = [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in idents]
    return np.frombuffer(b"".join(heads), ">u4").reshape(-1, 4).astype(np.int64)


def transform(texts: list[bytes], idents: list, rate: int, spm_rate: int, seed: int) -> list[tuple]:
    """Units, form, code points of prefix and middle, and output of every text."""
    units, h = Units(texts), draws(idents, seed)
    first, second = h[:, 0] % (units.counts + 1), h[:, 1] % (units.counts + 1)
    a, b = units.ends(np.minimum(first, second)), units.ends(np.maximum(first, second))
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    rows = []
    for t, n, x, y, h3, h4 in zip(texts, units.counts.tolist(), a.tolist(), b.tolist(), h[:, 2].tolist(), h[:, 3].tolist(), strict=True):
        if not t or h3 % 100 >= rate or p in t or s in t or m in t:
            rows.append((n, "plain", None, None, t))
            continue
        prefix, middle, suffix = t[:x], t[x:y], t[y:]
        spm = h4 % 100 < spm_rate
        parts = (s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle)
        rows.append((n, "spm" if spm else "psm", len(prefix.decode()), len(middle.decode()), b"".join(parts)))
    return rows


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of some MB of text, or of one row."""
    sizes = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(0)], np.int64)
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total + size > SLICE_BYTES and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    yield batch.slice(start)


def fill_in_middle(
    df: DataFrame, text: str = "text", ident: str = "doc_id", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED
) -> DataFrame:
    """``df`` with ``n_units``, ``form``, ``prefix_chars``, ``middle_chars`` (code points; null if plain) and ``output``."""
    rows = df.select(F.col(f"`{text}`").alias("t"), F.col(f"`{ident}`").cast("string").alias("i"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    schema = T.StructType([
        rows.schema["row"], T.StructField("n_units", T.LongType()), T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()),
    ])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for some in _slices(batch) if batch.num_rows else ():
                texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in some.column(0)]
                *columns, outputs = zip(*transform(texts, some.column(1).to_pylist(), rate, spm_rate, seed), strict=True)
                made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(2), *made, pa.array(outputs, pa.binary()).cast(pa.string())], names=schema.names)

    done = rows.mapInArrow(work, schema)
    keep = replace_columns(df, RESULTS)
    return done.select(*[F.col("row")[c].alias(c) for c in keep], *RESULTS)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text of a transformed row, rebuilt from its output and form: no part of a text holds a sentinel."""

    def behind(sentinel: str) -> Column:
        return F.substring_index(F.col(output), sentinel, -1)

    def between(one: str, other: str) -> Column:
        return F.substring_index(F.substring_index(F.col(output), other, 1), one, -1)

    psm = F.concat(between(PREFIX, SUFFIX), behind(MIDDLE), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), behind(MIDDLE), between(SUFFIX, PREFIX))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))
