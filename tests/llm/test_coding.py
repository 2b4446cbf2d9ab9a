"""BPE, packed ids and language-model scores against the library and plain counting."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from redactlake.llm import backoff, bpe, packing, queries
from tests.llm import cases

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
BITS = [
    "a", "aa", "the", "ing", " ", "  ", "\n", " \n", "\t", "'s", "'ll", "é", "日本", "😀", "12345", "<|endoftext|>", "<|endof", "====", "\x1c", " ",
    "İ", "Σ", "-", "word,", "\r\n", "́", "한", "nonsenseword", "x's",
]


def _random(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 25))) for _ in range(n)] + ["a" * 5001, " " * 99, "ab" * 900]


def test_speculated_ids_are_the_library_s():
    coder, library = bpe.Coder(open(BYTE, encoding="utf-8").read()), tokenizers.Tokenizer.from_file(BYTE)
    texts = _random(4000)
    for start in range(0, len(texts), 50):
        some = texts[start : start + 50]
        for t, ids in zip(some, coder.encode(some), strict=True):
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, t
            assert coder.decode(ids).decode("utf-8", "replace") == library.decode(ids.tolist(), skip_special_tokens=False)


def test_every_path_of_merging_agrees():
    v = bpe.Vocabulary(open(BYTE, encoding="utf-8").read())
    rng = random.Random(1)
    words = ["".join(rng.choice("aehinrst") for _ in range(rng.randint(1, 40))).encode() for _ in range(800)]
    for w, ids in zip(words, v.encode_words(words), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == v._merged_long(w) == v._merged_short(w)


def test_bpe_keeps_rows_and_other_columns(spark):
    df = cases.edge(spark)
    rows = bpe.bpe_columns(df, BYTE, want=["n_tokens", "ids", "decoded"]).collect()
    library = tokenizers.Tokenizer.from_file(BYTE)
    assert sorted(r.n for r in rows) == list(range(len(cases.TEXTS)))
    for r in rows:
        text = cases.TEXTS[r.n][1] or ""
        assert r.ids == library.encode(text, add_special_tokens=False).ids and r.decoded == text and r.n_tokens == len(r.ids)
    assert bpe.bpe_columns(cases.empty(spark), BYTE).count() == 0


@pytest.mark.parametrize("width", [1, 7, 16, 17, 32])
def test_bits_round_trip_with_random_access(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 63, 64, 65, 4097, 9000):
        ids = rng.integers(0, 1 << width, n).astype(np.uint32)
        pack = packing.write_pack([ids[: n // 3], ids[n // 3 :]], width)
        assert (packing.read_ids(pack) == ids).all() and (packing.read_ids(pack, n // 4, n // 2) == ids[n // 4 : n // 2]).all()
        assert packing.document_starts(pack).tolist() == [0, n // 3, n]
        assert len(pack) <= 400 + 8 * (n // 4096) + (n + 64) * width // 8


def test_word_encoder_is_the_library_s():
    encoder, library = packing.WordEncoder(open(WORD, encoding="utf-8").read()), tokenizers.Tokenizer.from_file(WORD)
    texts = _random(3000, 5)
    for start in range(0, len(texts), 50):
        for t, ids in zip(texts[start : start + 50], encoder.encode(texts[start : start + 50]), strict=True):
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_packed_table_reads_back(spark, monkeypatch):
    monkeypatch.setattr(packing, "PACK_IDS", 50)  # several packs
    rows = packing.read_packs(packing.packed(cases.edge(spark).repartition(3), WORD, 2)).collect()
    library = tokenizers.Tokenizer.from_file(WORD)
    order = sorted(cases.TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for i, t in order:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in sorted(rows, key=lambda r: r.start)] == want
    assert packing.read_packs(packing.packed(cases.empty(spark), WORD, 2)).count() == 0


def _scores(rows, order=3, give_up=0.4, least=2):
    words = [(i, (t or "").encode().lower().split()) for i, t in rows]
    count = Counter(tuple(w[j : j + n]) for _, w in words for n in range(1, order + 1) for j in range(len(w) - n + 1))
    total = sum(len(w) for _, w in words)
    for i, w in words:
        score = 0.0
        for j in range(len(w)):
            for n in range(min(order, j + 1), 0, -1):
                gram = tuple(w[j - n + 1 : j + 1])
                if n == 1 or count[gram] >= least:
                    score += math.log(count[gram] / (count[gram[:-1]] if n > 1 else total)) + (order - n) * math.log(give_up)
                    break
        yield i, len(w), score


def test_registered_scores_use_ngrams_of_any_count(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.log_score for r in queries.QUERIES["op7_backoff_scores"](spark, "/root/testdata/sf0.001").collect()}
    assert got == pytest.approx({i: score for i, _, score in _scores(rows, least=1)})


def test_ngram_hashes_have_64_bits_at_any_size():
    _, hashes, _ = backoff._grams([" ".join(f"w{i % 300}x{i % 7}" for i in range(2100)), "the cat sat"], 3)
    assert all(h.dtype == np.uint64 for h in hashes) and max(int(h.max()) for h in hashes) >> 60 and len(np.unique(hashes[0])) == 2103


def test_backoff_scores_match_plain_counting(spark, monkeypatch):
    monkeypatch.setattr(backoff, "CHUNK_BYTES", 50_000)  # several chunks and buckets
    rows = cases.TEXTS + [(20 + i, " ".join(random.Random(i).choices("the cat sat on a mat".split(), k=30))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
    got = sorted(((r.doc_id, r.n_words, r.log_score) for r in backoff.backoff_scores(df).collect()), key=key)
    for g, w in zip(got, sorted(_scores(rows), key=key), strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2])
    assert backoff.backoff_scores(cases.empty(spark)).count() == 0
