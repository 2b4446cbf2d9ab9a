"""Exact and near duplicates and fingerprints against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from redactlake.llm import components, exact, near, queries, sketch
from tests.llm import cases
from tests.oracle import connect, differences

FOLDER = "/root/testdata/sf0.001"


def test_exact_groups_match_duckdb(spark):
    assert differences(queries.QUERIES["op3_exact_dedup"](spark, FOLDER), connect(FOLDER), queries.ORACLES["op3_exact_dedup"]) == ""


def test_exact_edge_rows(spark):
    rows = exact.duplicate_groups(cases.edge(spark)).collect()
    assert len(rows) == len(cases.TEXTS)
    cat = [r for r in rows if r.doc_id in (1, 6)]
    assert {r.keep_id for r in cat} == {6} and {r.group_size for r in cat} == {3} and [r.doc_id for r in cat if r.kept] == [6]
    blank = [r for r in rows if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert len(blank) == 4 and {r.keep_id for r in blank} == {4} and sum(r.kept for r in blank) == 1
    assert sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})
    kept = exact.keep_one_each(cases.edge(spark))
    assert kept.columns == cases.edge(spark).columns and kept.count() == len({r.text_sha256 for r in rows})
    assert exact.keep_one_each(cases.empty(spark)).count() == exact.duplicate_groups(cases.empty(spark)).count() == 0


def test_repeated_rows_keep_one(spark):
    rows = exact.duplicate_groups(spark.createDataFrame([(1, "a b")] * 7 + [(None, "q")] * 3, "doc_id long, text string").repartition(4)).collect()
    assert len(rows) == 10 and sum(r.kept for r in rows) == 2 and {r.group_size for r in rows} == {7, 3}


def test_small_memory_spills_and_stays_right():
    rng = random.Random(2)
    texts = [str(rng.randint(0, 400)) * rng.randint(1, 3) for _ in range(3000)]
    records = [(*exact._content(t), (len(t), i, 1, 1, (i, t))) for i, t in enumerate(texts)]
    found = {content: record for _, content, record in exact.resolve(iter(records), limit=3000)}
    for t in set(texts):
        where = [i for i, x in enumerate(texts) if x == t]
        assert found[t.encode()][1] == where[0] and found[t.encode()][2] == len(where)
    assert len(found) == len(set(texts))


def test_equal_hashes_are_told_apart_by_content():
    table = exact.ContentTable()
    for content in (b"one", b"two", b"one"):
        table.add(7, content, (3, 1, 1, 1, None))
    assert sorted(c for _, c, _ in table.items()) == [b"one", b"two"]


def test_near_matches_brute_force(spark):
    """Table rows, a large group of copies edited more or less, and a passage that many rows share."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, passage = [word() for _ in range(150)], [word() for _ in range(60)]
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    for i in range(120):
        edited = list(base)
        for _ in range(rng.randint(0, 8)):
            edited[rng.randrange(150)] = word()
        rows.append((1000 + i, " ".join(edited)))
    rows += [(2000 + i, " ".join([word() for _ in range(rng.randint(0, 12))] + passage)) for i in range(80)]
    rng.shuffle(rows)
    got = near.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == cases.near_components(rows)


def _lists(spark, classes):
    """Members of the lists of classes, given as name: (size, level, places and shingles of the prefix)."""
    rows = [(token, sig, sig, (n << 34) + (at << 4) + level) for sig, (n, level, chosen) in classes.items() for at, token in chosen]
    return spark.createDataFrame(rows, "token long, sig string, label string, meta long").repartition(3)


def test_runs_of_shared_shingles_make_few_rows(spark):
    """Forty classes of 300 common prefix shingles: a row a pair at level 1, four at level 4 and not 300."""
    for level in (1, near.LONGEST):
        lists = _lists(spark, {f"c{i:02}": (1500, level, list(enumerate(range(300)))) for i in range(40)})
        assert near._meetings(lists).count() == level * 40 * 39 // 2
        assert near._all_pairs(lists).count() == 40 * 39 // 2


def test_pairs_of_lists_match_brute_force(spark):
    rng, classes = random.Random(12), {}
    for i in range(150):
        n, level = rng.randint(40, 60), rng.randint(1, near.LONGEST)
        order = sorted(rng.sample(range(400), 25) + rng.choice([[], list(range(100, 112)), list(range(105, 125))]))
        classes[f"c{i:03}"] = n, level, list(enumerate(dict.fromkeys(order)))[: n - near.least_overlap(n) + level]
    expected = set()
    for a, b in itertools.combinations(sorted(classes), 2):
        (n, k, x), (m, j, y) = classes[a], classes[b]
        asked, y = min(k, j), {token: at for at, token in y}
        fit = 100 * min(n, m) >= near.PERCENT * max(n, m)
        needed = -(-near.PERCENT * (n + m) // (100 + near.PERCENT))
        shared = [
            token for at, token in x if fit and token in y and at < n - near.least_overlap(n) + asked and y[token] < m - near.least_overlap(m) + asked
            and min(n - at, m - y[token]) + asked - 1 >= needed
        ]
        if len(shared) >= asked:
            expected.add((a, b))
    assert len(expected) > 100 and {tuple(r) for r in near._all_pairs(_lists(spark, classes)).collect()} == expected


def test_classes_with_too_much_of_their_own_are_not_paired_with_a_large_group(spark):
    """Twenty classes of 17 own shingles, one of which one of sixty linked near copies has too: each meets that copy only."""
    classes = {}
    for i in range(60):
        own = [10_020 + i] if i < 20 else []
        own += [20_000 + 10 * i + j for j in range(5 - len(own))]
        classes[f"m{i:02}"] = 146, near.LONGEST, list(enumerate(own + list(range(50_000, 50_028))))
    for i in range(20):
        own = [10_020 + i] + [30_000 + 20 * i + j for j in range(16)]
        classes[f"x{i:02}"] = 146, near.LONGEST, list(enumerate(own + list(range(50_000, 50_016))))
    lists = _lists(spark, classes).withColumn("label", F.when(F.col("sig").startswith("m"), "m00").otherwise(F.col("sig")))
    met = {(r.a, r.b) for r in near._meetings(lists).collect()}
    assert met == {(f"m{i:02}", f"x{i:02}") for i in range(20)}
    assert {tuple(r) for r in near._all_pairs(lists).collect()} == met


def test_complete_sets_are_staged_for_plausible_pairs_only(spark, monkeypatch):
    """Forty texts that share a half with the next one, and two near copies: the sets of these two alone are written."""
    staged, sets = near.staged, []
    part = lambda i: [f"p{i}x{j}" for j in range(30)]
    rows = [(i, " ".join(part(i) + part((i + 1) % 40))) for i in range(40)] + [(100, " ".join(part(50) + part(51))), (101, " ".join(part(50) + part(51) + ["more"]))]

    def watched(df, label):
        out = staged(df, label)
        if label == "sets":
            sets.append(out.count())
        return out

    monkeypatch.setattr(near, "staged", watched)
    got = near.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == cases.near_components(rows)
    assert sets == [2]


def test_sketch_tells_a_common_shingle_from_rare_ones(spark):
    """The count of a shingle that 30 texts share stays far from those of the others, though each text has 2,000 of its own."""
    rows = [(i, "one two three four five " + " ".join(f"w{i}x{j}" for j in range(2000))) for i in range(30)]
    signatures = near._signatures(near._rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "text", "doc_id"))
    sketch = near._sketch(signatures)
    counts = np.sort(sketch[near.place(near.shingle_set(rows[0][1]))])
    assert counts[-1] >= 30 and counts[-2] < 10 and int(sketch.sum()) == sum(len(near.shingle_set(t)) for _, t in rows)
    assert np.mean(counts > 1) < 0.05


def test_near_edge_rows(spark):
    rows = near.near_groups(cases.edge(spark)).collect()
    assert len(rows) == len(cases.TEXTS)
    assert {r.component_id for r in rows if r.doc_id in (1, 6)} == {1} and {r.component_id for r in rows if r.doc_id in (5, 9)} == {5}
    assert all(r.component_id == r.doc_id for r in rows if r.n_shingles == 0) and {r.doc_id for r in rows if r.n_shingles == 0} == {2, 3, 4, None}
    kept = near.keep_one_each(cases.edge(spark))
    assert kept.columns == cases.edge(spark).columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 2), (False, 3), (False, 4), (False, 5), (False, 7), (False, 8), (True, 0), (True, 0)]
    assert near.near_groups(cases.empty(spark)).count() == near.keep_one_each(cases.empty(spark)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 299)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 299: 299, 300: 299}


def test_sketches_give_back_differences():
    rng = random.Random(4)
    for n in (0, 1, 5, 60, 900):
        for m in (0, 2, 70):
            common = {rng.getrandbits(64) for _ in range(n)}
            x, y = common | {rng.getrandbits(64) for _ in range(m)}, common | {rng.getrandbits(64) for _ in range(m // 2)}
            a, b = (sketch.Sketch.from_string(sketch.Sketch.of(s).to_string()) for s in (x, y))
            assert sketch.difference(a, b) == (x - y, y - x) and a.whole() == x
            assert sketch.likeness(a, b) == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0)


def test_neighbours_match_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()] + [(-5, None), (10**12, "")]
    got = {r.doc_id: r for r in sketch.edited_neighbours(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    assert len(got) == len(rows)
    for n, (i, text) in enumerate(order):
        t, other = text or "", order[(n + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + other[: len(t) // 2]
        r, sets = got[i], [sketch.paragraphs(x) for x in (t, edited, other)]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(jaccard(sets[0], sets[1])) and r.near_next == pytest.approx(jaccard(sets[0], sets[2]))
        assert r.fingerprint == sketch.Sketch.of(sets[0]).to_string() and r.edited_fingerprint == sketch.Sketch.of(sets[1]).to_string()


def test_neighbours_edge_rows(spark):
    rows = sketch.edited_neighbours(cases.edge(spark)).collect()
    assert len(rows) == len(cases.TEXTS) and {r.doc_id for r in rows} == {i for i, _ in cases.TEXTS}
    one = sketch.edited_neighbours(spark.createDataFrame([(3, "abcd")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one[0].near_next == 1.0
    assert sketch.edited_neighbours(cases.empty(spark)).count() == sketch.fingerprints(cases.empty(spark)).count() == 0
    assert sketch.fingerprints(cases.edge(spark)).count() == len(cases.TEXTS)


def test_parities_never_exceed_the_difference():
    rng = random.Random(8)
    for n in (1, 4, 100, 700, 5000):
        for m in (0, 1, n // 10, n):
            common = [rng.getrandbits(64) for _ in range(n)]
            x, y = (np.array(sorted({*common, *(rng.getrandbits(64) for _ in range(k))}), np.uint64) for k in (m, 2 * m))
            assert near.differing(near.parities(x), near.parities(y)) <= len(set(x.tolist()) ^ set(y.tolist()))
    far = [np.array(sorted(rng.getrandbits(64) for _ in range(4000)), np.uint64) for _ in range(2)]
    assert near.differing(*map(near.parities, far)) > 2000


def test_cells_that_only_look_pure_do_not_loop(monkeypatch):
    """With check sums of no use, peeling fails or is right, and always ends."""
    monkeypatch.setattr(sketch, "check_of", lambda digest: 0)
    rng = random.Random(12)
    for _ in range(300):
        x, y = ({rng.getrandbits(64) for _ in range(rng.randint(0, 12))} for _ in range(2))
        found = sketch.Sketch.of(x, 4).minus(sketch.Sketch.of(y, 4)).peeled()
        assert found is None or len(found) == 2
