"""Hard negatives and fill-in-middle against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from redactlake.llm import fim, negatives, queries
from tests.llm import cases

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
_BITS = ["a", "bc", " ", "\n", "\t", "\x0b", "\x0e", "\x08", "é", "日", "😀", "\xa0", "\x00", "\x7f", "\x85", "<P", ">", "<", "P>", "<M>"]


# --- fill-in-middle ------------------------------------------------------------------
def _made(ident, text, rate=50, spm_rate=80):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if ident is None else ident}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, len(units))))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate", [50, 100])
def test_transformed_texts_are_those_of_plain_code(rate):
    rng = random.Random(rate)
    texts = ["".join(rng.choice(_BITS) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + ["", " ", "x" * 5000 + " \n", " y" * 3000]
    made = fim.transform([t.encode() for t in texts], list(range(len(texts))), rate, 80, 42)
    for i, (t, row) in enumerate(zip(texts, made, strict=True)):
        assert (*row[:4], row[4].decode()) == _made(i, t, rate)


def test_rows_columns_and_whole_texts_survive(spark):
    df = cases.edge(spark).withColumn("OUTPUT", F.lit("x")).withColumn("t", F.lit(1))
    done = fim.fill_in_middle(df, rate=100)
    rows = done.select("*", fim.restored().alias("again")).collect()
    assert sorted(r.n for r in rows) == list(range(len(cases.TEXTS))) and rows[0].t == 1
    for r in rows:
        ident, text = cases.TEXTS[r.n]
        assert r.again == (text or "") and r.text == text
        assert (r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output) == _made(ident, text, 100)
    assert fim.fill_in_middle(cases.empty(spark)).count() == 0


def test_every_select_in_a_word():
    for mask in range(1, 256):
        marks = [i for i in range(8) if mask >> i & 1]
        word = np.array([sum(0x80 << 8 * i for i in marks)] * len(marks), np.uint64)
        assert fim.select_mark(word, np.arange(1, len(marks) + 1)).tolist() == marks


# --- hard negatives ------------------------------------------------------------------
def _mined(rows, anchor, positives=5, negatives_=10):
    """``rows`` of (id, label, vector)."""
    rows = [(i, k, [math.floor(256 * x) for x in v]) for i, k, v in rows]
    out = []
    for i, k, q in rows:
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j, c) for j, c, v in rows if j != i)
        for p, j, _ in [x for x in scored if x[2] == k][:positives]:
            fits = [x for x in scored if x[2] != k and -30 * p <= -100 * x[0] <= -90 * p][:negatives_]
            out += [(i, j, rank, n, -p, -s) for rank, (s, n, _) in enumerate(fits, 1)]
    return sorted(out)


def _table(spark, rows):
    return spark.createDataFrame([(i, k, v, "x") for i, k, v in rows], "vec_id long, label int, embedding array<float>, score string")


def _random_rows(n, dim, seed, clusters):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    made = []
    for i in range(n):
        v = centres[i % clusters] + 0.4 * rng.normal(size=dim) if i % 3 else centres[0]  # a third of the rows share a vector
        made.append((i, int(rng.integers(4)), [float(np.float32(x)) for x in v]))
    return made


@pytest.mark.parametrize(("dim", "centroids", "stretch"), [(8, 6, 4), (7, 3, 2), (1, 1, 1), (8, None, 64)])
def test_mined_negatives_are_those_of_brute_force(spark, monkeypatch, dim, centroids, stretch):
    monkeypatch.setattr(negatives, "FIRST_STRETCH", stretch)
    monkeypatch.setattr(negatives, "GROWTH", 2)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 50)
    monkeypatch.setattr(negatives, "BATCH_ROWS", 7)
    rows = _random_rows(400, dim, dim, 9)
    got = negatives.hard_negatives(_table(spark, rows), F.col("id") % 20 == 0, centroids=centroids)
    assert sorted(map(tuple, got.collect())) == _mined(rows, lambda i: i % 20 == 0)


def test_the_walk_gives_every_filled_cell_once_by_falling_bound():
    rng = np.random.default_rng(2)
    index = negatives.MultiIndex([np.zeros((13, 2)), np.zeros((13, 2))])
    index.filled = set(rng.permutation(169)[:100].tolist())
    first, second = rng.integers(0, 9, 13).astype(float), rng.normal(size=13)
    walk = list(index.walk(first, second))
    assert sorted(c for _, c in walk) == sorted(index.filled)
    assert all(x[0] >= y[0] for x, y in zip(walk, walk[1:], strict=False))
    assert all(bound == first[c // 13] + second[c % 13] for bound, c in walk)


def test_the_walk_stops_early_where_vectors_lie_in_groups(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    rows = [(i, i % 2, [float(x) for x in centres[i % 30] + 0.01 * rng.normal(size=16)]) for i in range(600)]
    points, dim = negatives.usable(_table(spark, rows), "vec_id", "embedding", "label")
    cells, blocks, index, parts = negatives.build_index(points, dim, 16, 42)
    q = np.array([[math.floor(256 * x) for x in rows[0][2]]])
    a, b = index.bounds(q)
    best = sorted((int(np.dot(q[0], [math.floor(256 * x) for x in v])) for _, _, v in rows), reverse=True)[9]
    certified = sum(bound >= best for bound, _ in index.walk(a[0], b[0]))
    assert certified < len(index.filled) / 2
    assert cells.count() == 600 and blocks.count() >= len(index.filled) == len(parts)


def test_rows_that_take_no_part(spark):
    rows = _random_rows(60, 4, 5, 3)
    odd = [
        (None, 1, [1.0] * 4), (100, None, [1.0] * 4), (101, 1, None), (102, 1, [1.0, None, 1.0, 1.0]), (103, 1, [math.nan] * 4),
        (104, 1, [math.inf, 0.0, 0.0, 0.0]), (105, 1, [1.0] * 3), (106, 1, []), (107, 1, [3e38] * 4),
    ]
    want = _mined(rows, lambda i: i % 10 == 0)
    got = negatives.hard_negatives(_table(spark, rows + odd + rows[:7]), F.col("id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == want
    big = [(i, k, [1e6 * x for x in v]) for i, k, v in rows]
    got = negatives.hard_negatives(_table(spark, big), F.col("id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == _mined([(i, k, [float(np.float32(x)) for x in v]) for i, k, v in big], lambda i: i % 10 == 0)
    assert negatives.hard_negatives(_table(spark, []), F.lit(True)).count() == 0
    assert negatives.hard_negatives(_table(spark, odd), F.lit(True)).count() == 0
    assert negatives.hard_negatives(_table(spark, rows), F.lit(False)).count() == 0


def test_scores_beyond_doubles_are_exact():
    rng = np.random.default_rng(4)
    q, x = rng.integers(-(1 << 27), 1 << 27, (5, 64)), rng.integers(-(1 << 27), 1 << 27, (9, 64))
    assert negatives.products(q, x).tolist() == [[sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for v in x] for u in q]


def test_registered_queries(spark):
    assert {"op11_hard_negatives", "op12_fill_in_middle"} <= set(queries.QUERIES) & set(queries.ORACLES)
