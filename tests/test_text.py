"""Text jobs on composed texts, whose right answer follows from how they were composed, and properties of the jobs."""

import random

import pytest

from redactlake.operators import redaction as X
from redactlake.operators import scopes as C
from redactlake.operators import tokens as T
from redactlake.sources import tables as S
from tests.made import Maker, identity

KINDS = ("MOBILE", "EMAIL", "PAN", "IFSC", "CARD", "DOB")
#: text and its redaction, for rules that depend on lines and words around a value
LINES = [
    ("Passcode: plum-tree-9\nVerification code: 4471", "Passcode: [HIDDEN]\nVerification code: [HIDDEN]"),
    ("Current account 550012340077", "Current account ACCOUNT_1"),
    ("Salary account:\n5500 1234 0077\nA/c no 550012340077", "Salary account:\nACCOUNT_1\nA/c no ACCOUNT_1"),
    ("City: Norvale\nTelephone: 7012345678", "City: ADDRESS_1\nTelephone: MOBILE_1"),
    ("welcome Oona Pell to Norvale", "welcome PERSON_1 to Norvale"), ("Welcome Oona", "Welcome Oona"),
    ("a reorder of 7012345678", "a reorder of 7012345678"), ("an invoice, long ago: 7012345678", "an invoice, long ago: 7012345678"),
    ("invoice " + "z" * 50 + " 7012345678", "invoice " + "z" * 50 + " MOBILE_1"), ("₹ 7012345678", "₹ 7012345678"),
    ("", ""), ("lantern\n\nriver", "lantern\n\nriver"),
]


def _composed(seed, n):
    """Texts of filler and made values from small pools, with their redactions."""
    make, out = Maker(seed), []
    pool = {k: [make.value(k) for _ in range(4)] for k in KINDS}
    for _ in range(n):
        text, want, numbers = [make.filler()], [], {k: {} for k in KINDS}
        want.append(text[0])
        for _ in range(make.rng.randint(0, 6)):
            kind = make.rng.choice(KINDS)
            value = make.rng.choice(pool[kind])
            number = numbers[kind].setdefault(identity(kind, value), len(numbers[kind]) + 1)
            # a card number takes the blank after it along
            rest = make.rng.choice(("\n", ", ") if kind == "CARD" else (" ", "\n", ", ")) + make.filler()
            text += [" " + value, rest]
            want += [f" {kind}_{number}", rest]
        out.append(("".join(text), "".join(want)))
    return out


def test_lines_and_surroundings(spark):
    df = spark.createDataFrame(LINES, "text string, want string")
    assert [(r.text, r.redacted) for r in X.redact_rows(df).collect() if r.redacted != r.want] == []


def test_composed_texts(spark):
    df = spark.createDataFrame(_composed(7, 1200), "text string, want string").repartition(5)
    assert [(r.text, r.redacted, r.want) for r in X.redact_rows(df).collect() if r.redacted != r.want][:3] == []


def test_audit_passes_redacted_and_stops_raw_texts(spark):
    rows = _composed(3, 150)
    df = spark.createDataFrame([(i, t) for i, r in enumerate(rows) for t in r], "i int, redacted string")
    assert {(r.i, r.redacted): r.is_safe for r in X.leak_audit(df).collect()} == {(i, t): t == r[1] for i, r in enumerate(rows) for t in r}
    with pytest.raises(ValueError):
        X.assert_safe(X.leak_audit(df))


def _conversations(seed):
    """Turns that name people once and mention them, and made values, again and again."""
    make, rows = Maker(seed), []
    for scope in range(5):
        people = [f"{make.word().title()} {make.word().title()}" for _ in range(3)]
        values = [make.value(k) for k in ("MOBILE", "EMAIL", "CARD") for _ in range(2)]
        for turn in range(24):
            known = people[: 1 + turn // 8]
            parts = [make.filler(), make.rng.choice(values), make.filler(), make.rng.choice(known)]
            rows.append((scope, turn, f"Name: {known[-1]}" if turn % 8 == 0 else " ".join(parts)))
    return rows


def test_scopes_share_tokens_whatever_the_partitions(spark):
    rows = _conversations(11)
    results = []
    for partitions in (1, 6):
        random.Random(partitions).shuffle(rows)
        items = spark.createDataFrame(rows, "scope int, item_ord long, text string").repartition(partitions)
        done, tokens = C.redact_scopes(items, ["scope"])
        results.append(({(r.scope, r.item_ord): r.redacted for r in done.collect()}, sorted((r.scope, r.kind, r.norm_key, r.token) for r in tokens.collect())))
    assert results[0] == results[1]
    texts, tokens = results[0]
    # one token for each value of a scope and one value for each token, people's aliases aside
    plain = [t for t in tokens if t[1] != "PERSON"]
    assert len({t[:3] for t in tokens}) == len(tokens) and len({(t[0], t[3]) for t in plain}) == len(plain)
    for scope, _, key, _ in tokens:
        assert all(key not in text.lower() for (s, _), text in texts.items() if s == scope)
    # what was redacted is the composed text with each part exchanged
    for scope, turn, text in rows:
        if not text.startswith("Name: "):
            assert texts[scope, turn].count("_") == 2 and texts[scope, turn].split()[0] == text.split()[0]


def test_restored_texts_are_the_originals(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(_composed(5, 60))], "i int, text string")
    rows = X.redact_rows(df)
    vault = rows.selectExpr("i", "text AS original", "redacted AS shown").filter("original <> shown")
    back = T.restore(rows.select("i", "redacted"), vault, ["i"]).collect()
    assert {r.i: r.restored for r in back} == {r.i: r.text for r in df.collect()} and vault.count() > 30


def test_vault_needs_a_request(spark, tmp_path):
    with pytest.raises(ValueError):
        S.write_vault(spark.range(1), str(tmp_path / "v"))
