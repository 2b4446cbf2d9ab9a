"""Byte-level BPE by speculation and verification.

Encoding a piece of text in three steps:

1. *Speculate*: greedy longest match proposes tokens.
2. *Verify*: one vectorised pass tests every adjacent pair of proposed tokens.
   A proposal is the BPE encoding exactly when no pair would have been merged
   across its border.
3. *Merge*: pieces with a failing pair, and only those, are merged exactly.

The pair test walks back in time.  The border of two tokens was once the border
of their inner parts; a part ``x`` on the left exists from the rank that made it
until the rank that consumed it.  If the rule for ``(x, y)`` ranks below both
consuming ranks, it fires first and the proposal is wrong.  At equal ranks the
leftmost place fires first, so the rule wins against the right consumer only.

Texts are cut before every space that a non-space follows; the pre-tokenising
pattern never crosses such a place, so pieces can be looked up in a bounded
cache.  Texts where white space meets white space after a blank take the
pattern itself.

Defined cases: a null text counts as empty, an empty text has no tokens; the
special tokens' strings become their ids; rows are never dropped or joined, so
repeated rows and null ids pass through; other columns are kept, and an input
column that is named like a result is replaced by it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator, Sequence
from itertools import chain, islice, pairwise
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactlake.llm.tables import replace_columns, small_batches, tidied

# Fixed value: the pre-tokenising pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WORDS = regex.compile(PATTERN)
_BLANK_BEFORE_SPACE = regex.compile(r" (?=[\s\x1c-\x1f]|\Z)")
_MARKS = ".,;:!?"
_FAR = np.int64(1) << 40
_CACHED = 400_000  # entries of one cache generation
_KEPT = 60_000  # entries kept between tasks
_LONGEST_CACHED = 64  # characters of a cached piece


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tables of one byte-level BPE file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model, alphabet = spec["model"], byte_alphabet()
        as_bytes = lambda token: bytes(alphabet[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        ids: dict[bytes, int] = {}
        for token, i in model["vocab"].items():
            if token in self.special:
                continue
            ids[as_bytes(token)] = i
            self.bytes_of[i] = as_bytes(token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.size = size
        self.byte_id = [ids.get(bytes([b]), -1) for b in range(256)]
        if min(self.byte_id) < 0:
            raise ValueError("the vocabulary lacks single bytes")
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        self.merge: dict[int, tuple[int, int]] = {}
        regular = True
        for n, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y = as_bytes(a), as_bytes(b)
            i, j, made = ids[x], ids[y], ids[x + y]
            regular &= self.rank[made] < 0 and len(x + y) > 1 and max(self.rank[i], self.rank[j]) < n
            regular &= (len(x) == 1 or self.rank[i] >= 0) and (len(y) == 1 or self.rank[j] >= 0)
            self.merge.setdefault(i * size + j, (n, made))
            self.rank[made], self.left[made], self.right[made] = n, i, j
        self.rule_rank = {k: n for k, (n, _) in self.merge.items()}
        self.made = [0] * len(model["merges"])
        for n, made in self.merge.values():
            self.made[n] = made
        keys = sorted(self.merge)
        self.keys = np.array(keys, np.int64)
        self.key_rank = np.array([self.merge[k][0] for k in keys], np.int64)
        # tokens that merging really reaches from their own bytes
        sound = np.zeros(size, bool)
        sound[self.byte_id] = True
        if regular:
            made = np.flatnonzero(self.rank >= 0)
            whole = self._borders_hold(self.left[made], self.right[made], self.rank[made], self.rank[made])
            for i, ok in sorted(zip(made.tolist(), whole.tolist(), strict=True), key=lambda x: self.rank[x[0]]):
                sound[i] = ok and sound[self.left[i]] and sound[self.right[i]]
        self.greedy = {b: i for b, i in ids.items() if sound[i]}
        self.reach: dict[bytes, int] = {}  # longest token that starts with these three bytes
        for b in self.greedy:
            if len(b) > 2:
                self.reach[b[:3]] = max(self.reach.get(b[:3], 0), len(b))

    def _rule(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(x), _FAR)
        key = x * self.size + y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], _FAR)

    def _borders_hold(self, x: np.ndarray, y: np.ndarray, until_x=None, until_y=None) -> np.ndarray:
        """For pairs of tokens: no rule fires across the border before the tokens are complete."""
        n = len(x)
        holds = np.ones(n, bool)
        live = np.arange(n)
        x, y = x.astype(np.int64), y.astype(np.int64)
        hx = np.full(n, _FAR - 1) if until_x is None else until_x.copy()
        hy = np.full(n, _FAR - 1) if until_y is None else until_y.copy()
        own = until_x is not None  # the rule that joins the two parts of a token is no fault at first
        while len(live):
            m = self._rule(x, y)
            bad = (m < hx) & ((m < hy) if own else (m <= hy))
            own = False
            holds[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            more = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, hx, hy, rx, ry = (v[more] for v in (live, x, y, hx, hy, rx, ry))
            undo_x = rx > ry
            hx, hy = np.where(undo_x, rx, hx), np.where(undo_x, hy, ry)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return holds

    # --- the three steps ---------------------------------------------------
    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        whole = self.greedy.get(word)
        if whole is not None:
            return [whole]
        out, at, end, get, reach, known = [], 0, len(word), self.greedy.get, self.reach, self.greedy
        while at < end:
            size = min(reach.get(word[at : at + 3]) or (2 if word[at : at + 2] in known else 1), end - at)
            found = get(word[at : at + size])
            while found is None:
                size -= 1
                found = get(word[at : at + size])
            out.append(found)
            at += size
        return out

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: lowest rank first, leftmost first at equal ranks."""
        return self._merged_short(word) if len(word) <= 48 else self._merged_long(word)

    def _merged_short(self, word: bytes) -> list[int]:
        """A scan for the lowest rank at each step; beats a heap on short words."""
        ids, size, rule, none = [self.byte_id[b] for b in word], self.size, self.rule_rank.get, len(self.made)
        ranks = [rule(a * size + b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            ids[i : i + 2] = [self.made[low]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rule(ids[i] * size + ids[i + 1], none)
            if i:
                ranks[i - 1] = rule(ids[i - 1] * size + ids[i], none)
        return ids

    def _merged_long(self, word: bytes) -> list[int]:
        """A heap of applicable rules over a linked list."""
        ids = [self.byte_id[b] for b in word]
        n, size, merge = len(ids), self.size, self.merge
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (rule := merge.get(ids[i] * size + ids[i + 1])) is not None:
                heap.append((rule[0], i, rule[1], ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rule := merge.get(made * size + ids[k])) is not None:
                    heapq.heappush(heap, (rule[0], i, rule[1], made, ids[k]))
            if (h := before[i]) >= 0 and (rule := merge.get(ids[h] * size + made)) is not None:
                heapq.heappush(heap, (rule[0], h, rule[1], ids[h], made))
        return [i for i in ids if i >= 0]

    def encode_words(self, words: Sequence[bytes]) -> list[bytes]:
        """Ids of pre-tokenised words, each as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        proposed = [self.propose(w) for w in words]
        ends = np.cumsum(np.fromiter(map(len, proposed), np.int64, len(proposed)))
        flat = np.fromiter(chain.from_iterable(proposed), np.int64, int(ends[-1]))
        inner = np.ones(len(flat), bool)
        inner[ends - 1] = False  # the last token of a word has no partner
        first = np.flatnonzero(inner)
        wrong = first[~self._borders_hold(flat[first], flat[first + 1])]
        raw, cuts = flat.astype("<u4").tobytes(), [0, *(ends * 4).tolist()]
        out = [raw[i:j] for i, j in pairwise(cuts)]
        for w in np.unique(np.searchsorted(ends, wrong, side="right")).tolist():
            ids = self.merged(words[w])
            out[w] = pack(f"<{len(ids)}I", *ids)
        return out


class Coder:
    """Encodes and decodes texts; caches pieces in two bounded generations."""

    def __init__(self, content: str):
        self.vocabulary = Vocabulary(content)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.vocabulary.special, key=len, reverse=True))) + ")") if self.vocabulary.special else None
        self.mark = dict(zip(_MARKS, self.vocabulary.encode_words([m.encode() for m in _MARKS]), strict=True))
        self.decimal = [str(i) for i in range(self.vocabulary.size)]

    def _pieces(self, text: str) -> list[str]:
        """Cache keys of pieces that no word of the pattern crosses.

        A key without a leading white space stands for itself after a blank; any
        other key is the blank and the piece, to be read without that blank.
        """
        if _BLANK_BEFORE_SPACE.search(text):
            return [" " + w for w in _WORDS.findall(text)]
        pieces = text.split(" ")
        pieces[0] = " " + pieces[0]
        return pieces

    def _learn(self, keys: set[str]) -> dict[str, bytes]:
        found, old, new = {}, self.old.get, self.new.get
        fresh: list[tuple[str, list[str]]] = []
        heads: list[tuple[str, str]] = []  # a word and one mark after it, which are always apart
        for p in keys:
            if (known := old(p)) is not None:
                found[p] = known
            elif p.isalpha():
                fresh.append((p, [" " + p]))
            elif p[-1] in _MARKS and (head := p[:-1]).isalpha():
                if (known := new(head) or old(head)) is not None:
                    found[p] = known + self.mark[p[-1]]
                else:
                    heads.append((p, head))
                    fresh.append((head, [" " + head]))
            else:
                fresh.append((p, _WORDS.findall(p[1:] if p[0] == " " else " " + p)))
        distinct = list(dict.fromkeys(chain.from_iterable([ws for _, ws in fresh])))
        ids = dict(zip(distinct, self.vocabulary.encode_words([w.encode() for w in distinct]), strict=True))
        for p, ws in fresh:
            found[p] = ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws])
        for p, head in heads:
            found[p] = found[head] + self.mark[p[-1]]
        if len(self.new) + len(found) > _CACHED:
            self.old, self.new = self.new, {}
        self.new.update(found if max(map(len, found)) <= _LONGEST_CACHED else {p: e for p, e in found.items() if len(p) <= _LONGEST_CACHED})
        return found

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit arrays."""
        lists, gaps, get = [], [], self.new.get
        for text in texts:
            parts = self.special.split(text or "") if self.special else [text or ""]
            row: list[bytes | None] = []
            for n, part in enumerate(parts):
                if n % 2:
                    row.append(np.array(self.vocabulary.special[part], "<u4").tobytes())
                elif part:
                    keys = self._pieces(part)
                    known, at = list(map(get, keys)), -1
                    for _ in range(known.count(None)):
                        at = known.index(None, at + 1)
                        gaps.append((row, len(row) + at, keys[at]))
                    row += known
            lists.append(row)
        found = self._learn({k for _, _, k in gaps}) if gaps else {}
        for row, at, key in gaps:
            row[at] = found[key]
        return [np.frombuffer(b"".join(row), "<u4") for row in lists]

    def rest(self) -> None:
        """Between tasks only the words seen first, mostly the frequent ones, are kept."""
        self.new, self.old = dict(islice((self.old or self.new).items(), _KEPT)), {}

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids.tolist()))


_RESULTS = {
    "n_tokens": T.LongType(),
    "ids": T.ArrayType(T.IntegerType()),
    "decoded": T.StringType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}
_coders: dict[str, Coder] = {}


def _coder(content: str) -> Coder:
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(content)
    return _coders[key]


def _results(coder: Coder, texts: list[str | None], want: Sequence[str]) -> list[pa.Array]:
    columns: dict[str, list] = {w: [] for w in want}
    for start in range(0, len(texts), 32):
        for ids in coder.encode(texts[start : start + 32]):
            raw = coder.decode(ids) if "decoded" in columns or "decoded_sha256" in columns else b""
            for w in want:
                if w == "n_tokens":
                    columns[w].append(len(ids))
                elif w == "ids":
                    columns[w].append(ids.astype(np.int32))
                elif w == "decoded":
                    columns[w].append(raw.decode("utf-8", "replace"))
                elif w == "ids_sha256":
                    columns[w].append(hashlib.sha256(",".join(map(coder.decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                else:
                    columns[w].append(hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
    kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
    return [pa.array(columns[w], kinds.get(w, pa.string())) for w in want]


def bpe_columns(df: DataFrame, vocabulary_path: str, text: str = "text", want: Sequence[str] = ("n_tokens", "ids")) -> DataFrame:
    """``df`` with the encoding of ``text``: any of n_tokens, ids, decoded, ids_sha256, decoded_sha256.

    ``decoded`` is made from the ids, not from the text.  The vocabulary file is
    read once on the driver and broadcast (a file of fixed size).
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    keep, want = replace_columns(df, list(want)), list(want)
    source = next(c for c in df.columns if c.lower() == text.lower())
    carried = df.select(F.struct(*[F.col(f"`{c}`") for c in keep or [source]]).alias("row"), F.col(f"`{source}`").alias("t"))
    schema = T.StructType([carried.schema["row"]] + [T.StructField(w, _RESULTS[w]) for w in want])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                made = _results(coder, part.column(part.num_columns - 1).to_pylist(), want)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=schema.names)
        coder.rest()

    coded = small_batches(carried).mapInArrow(tidied(code), schema)
    return coded.select(*[F.col("row")[c].alias(c) for c in keep], *want)
