"""Sharding, mixing, personal data, toxicity and the pipeline."""

import re
from collections import Counter
from fractions import Fraction

import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from redactlake.llm import mixing, private, queries, sharding, toxicity
from redactlake.llm.tables import staged
from tests.llm import cases

FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_shards_hold_the_mixture(spark):
    df = spark.range(1003).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    rows = sharding.stratified_shards(df, 40, F.col("doc_id")).collect()
    assert sorted(r.doc_id for r in rows) == list(range(1003)) and sorted(r.position for r in rows) == list(range(1003))
    for k in range(40):
        slots = sorted(r.slot for r in rows if r.shard == k)
        assert slots == list(range(len(slots))) and len(slots) in (25, 26)
    whole, each = Counter(r.source for r in rows), Counter((r.shard, r.source) for r in rows)
    assert all(abs(each[k, s] - n / 40) < 2 for s, n in whole.items() for k in range(40))
    again = {r.doc_id: r.position for r in sharding.stratified_shards(df.repartition(5), 40, F.col("doc_id")).collect()}
    assert again == {r.doc_id: r.position for r in rows}


def test_shards_and_mixtures_of_edge_rows(spark):
    df = cases.edge(spark)
    rows = sharding.stratified_shards(df, 5, F.struct("doc_id", "text")).collect()
    assert sorted(r.n for r in rows) == list(range(len(cases.TEXTS))) and {r.shard for r in rows} == set(range(5))
    rows = mixing.mix_to_weights(df, {None: 2.0, "s1": 0.0}, F.struct("doc_id", "text"), block_rows=2).collect()
    assert sorted(r.n for r in rows) == list(range(len(cases.TEXTS))) and sorted(r.position for r in rows) == list(range(len(rows)))
    ordered = sorted(rows, key=lambda r: r.position)
    assert [r.source for r in ordered if r.source == "s1"] == [r.source for r in ordered][-sum(r.source == "s1" for r in rows) :]
    none = cases.empty(spark)
    assert sharding.stratified_shards(none, 3, F.col("doc_id")).count() == mixing.mix_to_weights(none, {}, F.col("doc_id")).count() == 0
    assert mixing.in_mixed_order(df, {}, F.struct("doc_id", "text")).columns == df.columns


def test_one_period_is_earliest_deadline_first():
    parts = {"a": 50, "b": 31, "c": 18, "d": 1}
    slots = mixing.one_period(parts)
    assert sorted(x for s in slots.values() for x in s) == list(range(100))
    for s, a in parts.items():
        for t in range(1, 101):
            assert abs(sum(x < t for x in slots[s]) - t * a / 100) < 1


def test_mixture_follows_a_plain_schedule(spark):
    """Every source within a block of its share until the first one ends, and again after that."""
    weights, blocks = {"a": 5.0, "b": 3.0, "c": 1.0}, {"a": 40, "b": 90, "c": 7}
    plan = mixing.phases(blocks, weights, 90)
    placed = sorted((s0 + i // parts * length + slots[i % parts], s, b0 + i) for s, b0, n, parts, length, s0, slots in plan for i in range(n))
    assert [p[0] for p in placed] == list(range(137)) and Counter(p[1] for p in placed) == blocks
    for s in blocks:
        assert [p[2] for p in placed if p[1] == s] == list(range(blocks[s]))
    last = min(max(p[0] for p in placed if p[1] == s) for s in blocks)
    seen = Counter()
    for slot, s, _ in placed[: last + 1]:
        seen[s] += 1
        assert all(abs(seen[x] - (slot + 1) * weights[x] / 9) < 1 for x in weights)
    rows = queries.QUERIES["op9_mixing"](spark, FOLDER).collect()
    assert sorted(r.position for r in rows) == list(range(200)) and sorted(r.doc_id for r in rows) == list(range(200))
    in_block = Counter((r.source, r.block) for r in rows)
    sizes = Counter(r.source for r in rows)
    assert all(in_block[s, b] == min(mixing.BLOCK_ROWS, sizes[s] - b * mixing.BLOCK_ROWS) for s, b in in_block)
    assert len({r.slot for r in rows}) == len(in_block)


def _placed(plan):
    return sorted((s0 + i // parts * length + slots[i % parts], s, b0 + i) for s, b0, n, parts, length, s0, slots in plan for i in range(n))


@pytest.mark.parametrize("weights", [
    queries.WEIGHTS | {f"src{i}": queries.OTHER_WEIGHT for i in range(3, 20)}, corpus_pipeline.WEIGHTS | {f"src{i}": 1.0 for i in range(1, 20)},
    {"a": 0.1, "b": 0.2, "c": 0.7}, {"a": 0.123456789, "b": 1.0, "c": 0.3333333333, "d": 1e-7}, {f"s{i}": 1.0 + i for i in range(60)},
])
def test_mixture_keeps_the_exact_weights(weights):
    """Less than one block from the target after every slot, however many there are."""
    blocks = {s: 3000 if weights[s] == max(weights.values()) else 4000 for s in weights}
    placed = _placed(mixing.phases(blocks, weights))
    assert [p[0] for p in placed] == list(range(sum(blocks.values()))) and Counter(p[1] for p in placed) == blocks
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    whole, seen = sum(exact.values()), Counter()
    for slot, s, _ in placed:
        seen[s] += 1
        if slot % 97 == 0:
            assert all(abs(seen[x] - (slot + 1) * exact[x] / whole) < 1 for x in weights)
        if seen[s] == blocks[s]:
            break
    assert slot >= 4000


def test_listed_slots_of_long_periods(spark):
    """Weights with a period of billions of slots, and phases within one row of the list."""
    weights = {"a": 0.123456789, "b": 1.0, "c": 0.3333333333}
    df = spark.range(9000).select(F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, "abcc")), (F.col("id") % 4 + 1).cast("int")).alias("source"))
    rows = mixing.mix_to_weights(df, weights, F.col("doc_id"), block_rows=2).collect()
    sizes = Counter(r.source for r in rows)
    slots = {(s, b): slot for slot, s, b in _placed(mixing.phases({s: -(-n // 2) for s, n in sizes.items()}, weights))}
    assert all(slots[r.source, r.block] == r.slot for r in rows)
    assert sorted(r.position for r in rows) == sorted(r.doc_id for r in rows) == list(range(9000))


def _base_spans(text):
    found = []
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for k, pattern in enumerate(patterns):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))]
            fits = (
                True, max(map(int, re.findall("[0-9]+", m[0])), default=0) <= 255, 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0, 9 <= len(digits) <= 15
            )[k]
            if fits:
                found.append((m.start(), k, m.end()))
    return [(private.KINDS[k], a, b) for a, k, b in sorted(found)]


def test_private_spans_match_plain_patterns(spark):
    import random

    rng = random.Random(6)
    bits = ["a", "@", "b.c", "_", "1", "23", ".", "-", " ", "+", "(", "4111 1111 1111 1111", "255.", "300.", "+49 (0)30-1234567", "é", "😀", "\n", "x@y.z", "0001.2.3.4"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(2500)] + [t for _, t in cases.TEXTS]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in private.find_spans(df).collect():
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind in private.BASE] == _base_spans(texts[r.i])
        assert all(texts[r.i][s.start : s.end] == s.value and 0 < s.score <= 1 for s in r.spans)


def test_further_kinds_need_checksum_or_context(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 now", "DE88370400440532013000", "my ssn is 123-45-6789", "part 123-45-6789", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    kinds = {r.i: [s.kind for s in r.spans if s.kind not in private.BASE] for r in private.find_spans(df).collect()}
    assert kinds == {0: ["iban"], 1: [], 2: ["ssn"], 3: [], 4: [], 5: []}
    # long texts: many matches, and long runs that match nothing
    hard = spark.createDataFrame([(0, "4111 1111 1111 1111, " * 5000), (1, "a." * 50000 + "@"), (2, "+1" + "(" * 50000), (3, "1" * 100000)], "i int, text string")
    assert {r.i: len(r.spans) for r in private.find_spans(hard).collect()} == {0: 5000, 1: 0, 2: 0, 3: 0}
    rows = private.find_spans(cases.edge(spark))
    assert rows.columns == cases.edge(spark).columns[:10] + ["ids", "n", "spans"] and rows.count() == len(cases.TEXTS)
    assert private.find_spans(cases.empty(spark)).count() == 0


def test_accounts_before_capitals_and_digits(spark):
    de, gb, fr, mt = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR14 2004 1010 0505 0001 3M02 606", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"
    follow = ["", " now", " BIC COBADEFFXXX", " A note", " 12 EUR", " I will", " 12 Euro", " AB12", ".", "\n7", " 😀"]
    texts = [a + x for a in (de, de.replace(" ", ""), gb, fr, mt) for x in follow] + [f"{de} {gb} {fr}", f"AB12 {de}", f"{de}EUR", f"{de}x", "DE89 3704 0044 0532 0130 01 BIC"]
    want = [[a] for a in (de, de.replace(" ", ""), gb, fr, mt) for _ in follow] + [[de, gb, fr], [de], [], [], []]
    rows = private.find_spans(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()
    assert {r.i: [s.value for s in r.spans if s.kind == "iban"] for r in rows} == dict(enumerate(want))
    assert all(texts[r.i][s.start : s.end] == s.value for r in rows for s in r.spans)


def test_clauses_not_words_are_scored():
    a = toxicity.Automaton(toxicity.Grammar())
    plain, denied, reported = (a.features(t) for t in ("You are an idiot.", "You are not an idiot.", "They said he is an idiot."))
    assert plain[0] > 0 and denied[0] == 0 < denied[1] and reported[0] == 0 < reported[2]
    assert a.features("An idiot.")[0] < plain[0]  # a target raises the clause
    assert a.features("I will kill you.")[0] > 0 and a.features("I will not kill you.") == a.features("I kill time.") == (0, 0, 0)
    assert a.features("He said so. You idiot.")[0] > 0  # reports end with their clause
    assert a.score(None) == a.score("") < 0.5 < a.score("you stupid pathetic idiot")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{LARGER.replace('0.01', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    grammar = toxicity.learn(docs, labels)
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), grammar).join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id")))
    n = Counter((r.toxic, r.predicted) for r in scored.select("toxic", "predicted").collect())
    assert n[1, 1] / (n[1, 1] + n[1, 0]) > 0.85 and n[0, 1] / (n[0, 1] + n[0, 0]) < 0.02


def test_toxicity_edge_rows(spark):
    df = cases.edge(spark)
    labels = spark.createDataFrame([(1, 0, None), (None, 1, 1), (7, 1, 1)], "doc_id long, quality int, toxic int")
    grammar = toxicity.learn(df, labels)
    rows = toxicity.score_toxicity(df, grammar).collect()
    assert len(rows) == len(cases.TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert toxicity.keep_clean(df, grammar).columns == df.columns and toxicity.keep_clean(df, grammar).count() == len(rows)
    none = cases.empty(spark)
    assert toxicity.score_toxicity(none, toxicity.learn(none, labels.limit(0))).count() == 0


def test_pipeline_matches_brute_force(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    clean = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"), FOLDER).collect()}
    left = [(i, docs[i].text) for i in sorted(clean)]
    keep, _ = cases.keepers(left)
    left = [(i, docs[i].text) for i in sorted(keep.values())]
    left = [i for i, (n, c) in cases.near_components(left).items() if c == i]
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(left)
    assert all(r.ids == library.encode(docs[r.doc_id].text, add_special_tokens=False).ids and r.decoded == docs[r.doc_id].text for r in rows)


def test_pipeline_rows_carry_the_mixture(spark):
    """Over a mixed table of several files, which a read does not give back in their order."""
    source = F.when(F.col("id") % 7 < 2, "src0").otherwise(F.concat(F.lit("src"), F.col("id") % 3 + 1))
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("text"), F.col("id"), F.expr("repeat(sha2(string(id), 256), cast(id % 50 as int))")).alias("text"), source.alias("source")
    )
    docs, name = staged(docs, "docs"), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        mixed = staged(corpus_pipeline.mix_sources(spark, docs, FOLDER), "mixed")
    finally:
        spark.conf.unset(name)
    assert len(mixed.inputFiles()) > 2
    rows = sorted(corpus_pipeline.encode(spark, mixed, FOLDER).collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(6000))
    key = F.struct("doc_id", F.xxhash64("text"))
    placed = mixing.mix_to_weights(docs, corpus_pipeline.WEIGHTS, key, other=corpus_pipeline.OTHER_WEIGHT).orderBy("position").collect()
    assert [r.doc_id for r in rows] == [r.doc_id for r in placed]
    sizes, seen = Counter(r.source for r in rows), Counter()
    share = {s: (4 if s == "src0" else 1) / 7 for s in sizes}
    for n, r in enumerate(rows, 1):
        seen[r.source] += 1
        assert all(abs(seen[s] - n * share[s]) < 2 * mixing.BLOCK_ROWS for s in sizes)  # less than a block, and the block just read
        if seen[r.source] == sizes[r.source]:
            break
    assert n > 1000
    assert corpus_pipeline.encode(spark, cases.edge(spark), FOLDER).count() == len(cases.TEXTS)
    assert corpus_pipeline.encode(spark, cases.empty(spark), FOLDER).count() == 0


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_stand_edge_rows(spark, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    assert run(spark, cases.edge(spark), FOLDER).columns == cases.edge(spark).columns
    assert run(spark, cases.empty(spark), FOLDER).count() == 0
