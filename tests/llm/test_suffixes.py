"""Repeated byte strings against brute force."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from redactlake.llm import queries, suffixes
from tests.llm import cases


def brute(rows, length=50):
    """Bytes, removed bytes, removed runs and what is left of every row of (id, text)."""
    key = lambda i: (i is None, i or 0)
    least = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w not in least or key(i) < least[w]:
                least[w] = key(i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < key(i):
                gone[p : p + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=lambda r: (key(r[0]), r[1:]))


def _rows(df):
    return sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def _texts(n, seed):
    """Texts of few words, shared passages, near copies, exact copies and runs of one letter."""
    rng = random.Random(seed)
    words = ["alpha", "be", "gamma", "d", "épsilon", "zeta", "日本", "theta"]
    prose = lambda k: " ".join(rng.choice(words) + str(rng.randint(0, 99) if rng.random() < 0.5 else "") for _ in range(k))
    passages = [prose(12) for _ in range(5)] + ["a" * 70, "ab" * 60, passage := prose(40), passage[7:-9]]
    out = []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.15:
            out.append(rng.choice(out))
        elif out and kind < 0.3:
            t = rng.choice(out)
            at = rng.randint(0, len(t))
            out.append(t[:at] + rng.choice("xyz ") + t[at + rng.randint(0, 2) :])
        else:
            out.append(" ".join(rng.choice([prose(rng.randint(0, 25)), rng.choice(passages)]) for _ in range(rng.randint(1, 5))))
    return out


@pytest.mark.parametrize(("seed", "chunk", "hot", "run"), [(1, 1 << 24, 10_000, 400_000), (2, 2_000, 10_000, 400_000), (3, 3_000, 4, 400_000), (4, 5_000, 20, 37)])
def test_removed_bytes_are_those_of_brute_force(spark, monkeypatch, seed, chunk, hot, run):
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(suffixes, "RUN_ROWS", run)
    ids = list(range(250))
    random.Random(seed).shuffle(ids)
    rows = list(zip(ids, _texts(250, seed), strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert _rows(suffixes.repeated_strings(df, hot=hot)) == brute(rows)


@pytest.mark.parametrize("length", [1, 7, 30, 80])
def test_other_lengths(spark, length):
    rows = list(enumerate(_texts(60, 9)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _rows(suffixes.repeated_strings(df, length=length)) == brute(rows, length)


def test_defined_cases(spark):
    rows = [*cases.TEXTS, (None, "null ids are larger than all others and do not cut each other " * 2), (None, "null ids are larger than all others and do not cut each other " * 2 + "."),
            (3, "null ids are larger than all others and do not cut each other" + "!" * 60), (3, "!" * 120), (70, "!" * 90)]
    df = spark.createDataFrame([(i, t, "x", 1, b"") for i, t in rows], "doc_id long, text string, ident string, n_bytes int, sha binary")
    assert _rows(suffixes.repeated_strings(df)) == brute(rows)
    assert suffixes.repeated_strings(cases.empty(spark)).count() == 0


def test_the_loser_tree_merges_and_measures():
    rng = random.Random(5)
    for count in (1, 2, 3, 7, 8, 20):
        runs = []
        for _ in range(count):
            keys = sorted(bytes([0, rng.randint(0, 2), rng.randint(0, 2)]) + bytes(rng.randint(0, 1) for _ in range(5)) for _ in range(rng.randint(1, 40)))
            matrix = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), 8)
            runs.append((keys, suffixes.shared_prefixes(matrix).tolist()))
        run, at, lcp = suffixes.merged(runs)
        order = [runs[r][0][i] for r, i in zip(run, at, strict=True)]
        assert order == sorted(k for keys, _ in runs for k in keys)
        assert lcp == [0] + [len(os.path.commonprefix([x, y])) for x, y in zip(order, order[1:], strict=False)]


def test_known_prefixes_are_never_compared_again():
    class Watched(bytes):
        """Notes from where on keys are looked at."""

        def __getitem__(self, at):
            looked.append((bytes(self), at.start))
            return bytes.__getitem__(self, at)

    looked: list = []
    rng = random.Random(6)
    runs = []
    for _ in range(8):
        keys = sorted(b"\0" + bytes(rng.randint(0, 1) for _ in range(20)) for _ in range(30))
        matrix = np.frombuffer(b"".join(keys), np.uint8).reshape(30, 21)
        runs.append(([Watched(k) for k in keys], suffixes.shared_prefixes(matrix).tolist()))
    suffixes.merged(runs)
    reached: dict = {}
    # the tree is built first; from then on a key is only looked at behind what is known of it
    for key, start in looked:
        assert start >= reached.get(key, 0)
        reached[key] = start


def test_stretches_survive_front_coding():
    texts = suffixes.Texts([t.encode() for t in _texts(40, 7)], 50)
    h, places, first, last = texts.anchors()
    s = suffixes.sorted_suffixes(texts, h, places, first, last, texts.owner(places))
    for begin, end in ((0, len(s)), (5, 50), (3, 4)):
        keys, lcp, left, ids, want, at = suffixes.decoded(suffixes.front_coded(s, begin, end), s.keys.shape[1])
        assert keys == [k.tobytes() for k in s.keys[begin:end]] and lcp[1:] == s.lcp[begin + 1 : end].tolist()
        assert (left == s.left[begin:end]).all() and (ids == s.ids[begin:end]).all() and (want == s.want[begin:end]).all() and (at == s.places[begin:end]).all()


def test_equal_strings_have_equal_anchors(monkeypatch):
    texts = [t.encode() for t in _texts(80, 8)]
    places = {}
    for segment in (60_000, 61):
        monkeypatch.setattr(suffixes, "_SEGMENT", segment)
        t = suffixes.Texts(texts, 50)
        offsets, strings = {}, 0
        for _, place, first, last in zip(*(x.tolist() for x in t.anchors()), strict=True):
            for start in range(first, last + 1):
                w = t.data[start : start + 50].tobytes()
                assert 0 <= place - start <= 50 - suffixes.ANCHOR and offsets.setdefault(w, place - start) == place - start
                strings += 1
        assert strings == sum(max(len(x) - 49, 0) for x in texts)
        assert places.setdefault("offsets", offsets) == offsets


def test_registered_query(spark, tmp_path):
    rows = [(7 * i % 300, t) for i, t in enumerate(_texts(300, 12))]
    rows = [*rows, (1000, None), (1001, "")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_bytes", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    assert _rows(queries.QUERIES["op13_repeated_strings"](spark, str(tmp_path))) == [r[:5] for r in brute(rows)]
