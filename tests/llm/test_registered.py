"""Registered queries against plain code over whole small tables."""

import hashlib
import math
import zlib
from collections import defaultdict
from fractions import Fraction

import public_tokenizers
import tokenizers
from pyspark.sql import functions as F

from redactlake.llm import queries

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_op1_is_the_library(spark):
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.QUERIES["op1_bpe"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def _ranked(rows):
    """Rows of (source, h, h2, id) by source, in the seeded order."""
    by = defaultdict(list)
    for source, h, h2, ident in rows:
        by[source].append((h, h2, ident))
    return {s: [x[2] for x in sorted(v)] for s, v in by.items()}


def test_op2_is_plain_interleaving(spark):
    text = F.coalesce("text", F.lit(""))
    key = F.struct("doc_id", F.crc32(text).alias("text_crc32"), (F.octet_length(text) + 16).cast("bigint").alias("size"))
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("source", F.xxhash64(F.lit(42), key), F.hash(F.lit(42), key), "doc_id", "text").collect()
    texts = {r.doc_id: (r.text or "").encode() for r in docs}
    name = lambda s: "-" if s is None else f"+{s}"
    sources = _ranked([(name(r[0]), r[1], r[2], r[3]) for r in docs])
    order = sorted(((Fraction(2 * i + 1, 2 * len(ids)), s, i, d) for s, ids in sources.items() for i, d in enumerate(ids)))
    n = len(order)
    want = {}
    for place, (*_, d) in enumerate(order):
        shard = place * 40 // n
        want[d] = (shard, place - -(-shard * n // 40))
    rows = queries.QUERIES["op2_sharding"](spark, LARGER).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in rows} == want
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id]), "rows", None) for r in rows)


def test_op9_is_plain_earliest_deadline_first(spark):
    key = F.struct("doc_id", F.xxhash64("text").alias("_text"))
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("source", F.xxhash64(F.lit(42), key), F.hash(F.lit(42), key), "doc_id").collect()
    sources = _ranked([(f"+{r[0]}" if r[0] is not None else "-", *r[1:]) for r in docs])
    weight = {s: Fraction(str(queries.WEIGHTS.get(s[1:], queries.OTHER_WEIGHT))) for s in sources}
    blocks = {s: [ids[i : i + 64] for i in range(0, len(ids), 64)] for s, ids in sources.items()}
    done, order = dict.fromkeys(blocks, 0), []
    while any(done[s] < len(blocks[s]) for s in blocks):
        left = [s for s in blocks if done[s] < len(blocks[s])]
        total, taken, slot = sum(weight[s] for s in left), dict.fromkeys(left, 0), 0
        while all(done[s] < len(blocks[s]) for s in left):
            share = {s: weight[s] / total for s in left}
            ready = [(math.ceil((taken[s] + 1) / share[s]), s) for s in left if math.floor(taken[s] / share[s]) <= slot]
            s = min(ready)[1]
            order += blocks[s][done[s]]
            done[s] += 1
            taken[s] += 1
            slot += 1
    rows = sorted(queries.QUERIES["op9_mixing"](spark, LARGER).collect(), key=lambda r: r.position)
    assert [r.doc_id for r in rows] == order and [r.position for r in rows] == list(range(len(order)))
