"""The toxicity grammar against a plain search over clauses, and what it learns."""

import random

import numpy as np
import pytest

from redactlake.llm import toxicity as X
from tests.llm import cases

LEARNED = X.Grammar({"zorn": 2.0, "zornk": 4.0}, dict.fromkeys(X.INSULTS, 3.0) | {"oaf": 5.0})


def brute(text, grammar):
    """Affirmed, denied and reported weight, by looking at every word of every clause."""
    clauses, clause = [], []
    for w in X._WORD.findall((text or "").lower()):
        if w in ".!?;\n":
            clauses.append(clause)
            clause = []
        else:
            clause.append(w)
    total = [0.0, 0.0, 0.0]
    for words in [*clauses, clause]:
        lanes = [0.0, 0.0, 0.0]
        at = lambda kind: [i for i, w in enumerate(words) if w in kind]  # noqa: E731, B023
        negated = lambda i: any(0 < i - j <= 3 for j in at(X.NEGATIONS))
        targets, passives, reports = at(X.TARGETS), at(X.PASSIVES), at(X.REPORTS)
        for i, w in enumerate(words):
            fixed = any(w in kind for kind in (X.NEGATIONS, X.TARGETS, X.PASSIVES, X.REPORTS, X.THREATS))
            if not fixed and (weight := grammar.insult(w)):
                lanes[2 if any(j < i for j in reports) else 1 if negated(i) else 0] += weight
        threats = [i for i in at(X.THREATS) if not negated(i)]
        after = any(i < g for i in threats for g in targets)
        passive = any(g < p < i for i in threats for g in targets for p in passives)
        if after or passive:
            lanes[2 if reports else 0] += X._THREAT_WEIGHT
        bonus = X._TARGET_BONUS if targets else 1.0
        total = [t + bonus * w for t, w in zip(total, lanes, strict=True)]
    return tuple(total)


def test_the_composed_table_finds_what_a_search_finds():
    rng = random.Random(1)
    words = [*X.INSULTS[:3], "oaf", "zornig", "zornkopf", *X.THREATS[:3], *X.TARGETS[:3], *X.NEGATIONS[:2], "nobody", "hardly", *X.REPORTS[:2], "be", "been", "tree", "house", "quiet", ".", ";", "\n"]
    automaton = X.Automaton(LEARNED)
    for _ in range(6000):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 14)))
        assert np.allclose(automaton.features(text), brute(text, LEARNED)), text


@pytest.mark.parametrize(("text", "want"), [
    ("nobody is an idiot", (0, 3.0, 0)), ("You are hardly an idiot.", (0, 3.75, 0)), ("You will be killed by me; I kill you", (15.0, 0, 0)),
    ("They said you are an idiot", (0, 0, 3.75)), ("I would not kill you", (0, 0, 0)), ("what an oaf!", (5.0, 0, 0)), ("", (0, 0, 0)), (None, (0, 0, 0)),
])
def test_clauses(text, want):
    grammar = X.Grammar(words=dict.fromkeys((*X.INSULTS, "oaf"), 3.0) | {"oaf": 5.0})
    assert X.Automaton(grammar).features(text) == want


def test_composition_is_running_both():
    rng = random.Random(2)
    a, b = X.negation_table(), X.threat_table()
    both = X.composed(a, b, hides=True)
    i = j = k = 0
    for _ in range(3000):
        x = rng.choice(list(X.SYMBOLS))
        i, marks = a[i][x]
        j, _ = b[j][X.OTHER if x == X.THREAT and marks & X.DENIED else x]
        k, seen = both[k][x]
        assert (k, seen) == (i * len(b) + j, marks)


def _labelled(spark, insult, toxic, clean):
    rng = random.Random(3)
    words = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    text = lambda extra: " ".join([*(rng.choice(words) for _ in range(30)), extra])
    rows = [(i, text(insult if i % 5 == 0 and i < 5 * toxic else ""), int(i < 5 * toxic and i % 5 == 0)) for i in range(5 * toxic + clean)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, 0, x) for i, _, x in rows], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("insult", ["zog", "xy", "zogging"])
def test_rare_and_short_insults_are_learned(spark, insult):
    docs, labels = _labelled(spark, insult, 40, 2500)
    grammar = X.learn(docs, labels)
    assert grammar.insult(insult) > 3 and X.Automaton(grammar).score(f"you {insult}") > 0.5 > X.Automaton(grammar).score("you tree")


def test_columns_of_any_name_are_carried(spark):
    df = cases.edge(spark).selectExpr("*", "1 AS t", "2 AS _tox_text", "'x' AS predicted")
    rows = X.score_toxicity(df, LEARNED).collect()
    assert sorted(r.n for r in rows) == list(range(len(cases.TEXTS))) and {(r.t, r._tox_text) for r in rows} == {(1, 2)}
