"""Rules for labelled values: made values per kind, what labels allow, and check-digit properties."""

from redactlake.operators import records as V
from tests.made import Maker

KINDS = ("MOBILE", "EMAIL", "PAN", "IFSC", "CARD", "DOB")
#: label, then the kinds of made values that it accepts under its own kind
LABELS = {
    "Telephone": "MOBILE", "Contact cell": "MOBILE", "Mail ID": "EMAIL", "PAN": "PAN", "Branch IFSC": "IFSC", "Debit card": "CARD", "Birth date": "DOB",
}
OTHERS = [
    ("Nickname of pet", "Tulip", "", None), ("Holder's name", "Oona Pell", "", "PERSON"), ("Home address", "9 Birch Row, Norvale", "", "ADDRESS"),
    ("City", "Norvale", "", "ADDRESS"), ("Postal code", "700014", "", "PIN"), ("Zip code", "70001", "", None), ("Zip code", "7000145", "", None),
    ("Passphrase", "tulip", "", None), ("Passcode", "tulip", "", "PASSWORD"), ("Anything", "tulip", "password", "PASSWORD"),
    ("CVC", "", "", "PASSWORD"), ("Verification code", "88", "", "OTP"), ("Shipment tracking", "7012345678", "", None),
    ("", "INR 7012345678", "", None), ("Telephone", "type your number", "", None), ("Telephone", "5012345678", "", None),
    ("VPA", "oona.pell@quaybank", "", "UPI"), ("VPA", "o@quaybank", "", None), ("Day of birth", "30/02/2001", "", None),
    ("Birth date", "29/02/2001", "", None), ("Birth date", "29/02/2004", "", "DOB"), ("the full name as it stands here", "Oona", "", None),
]
LENGTHS = [(n, 9 <= n <= 18) for n in (8, 9, 12, 18, 19)]


def test_made_values_under_their_labels(spark):
    make = Maker(1)
    rows = [(label, make.value(kind), "", kind) for label, kind in LABELS.items() for _ in range(5)]
    rows += [(label, make.value(other), "", None) for label, kind in LABELS.items() for other in KINDS if other != kind]
    rows += [("", make.value(kind), "", kind) for kind in KINDS for _ in range(5)]
    rows += OTHERS
    rows += [(label, "7" * n, "", "ACCOUNT" if fits else None) for label in ("IBAN", "A/c", "Salary account no") for n, fits in LENGTHS]
    df = spark.createDataFrame(rows, "label string, value string, type string, want string")
    found = V.classify_values(df).collect()
    assert [(r.label, r.value, r.kind, r.want) for r in found if r.kind != r.want] == []
    assert all(r.never_read == (r.kind in ("PASSWORD", "OTP")) for r in found)


def test_check_digits_find_every_wrong_digit(spark):
    """Of ten last digits one is right, and no change of one digit stays right."""
    make = Maker(2)
    bodies = [(make.rng.choice("23456789") + make.digits(10), "5" + make.digits(14)) for _ in range(12)]
    rows = [(i, "AADHAAR", 11, a + str(d)) for i, (a, _) in enumerate(bodies) for d in range(10)]
    rows += [(i, "CARD", 15, c + str(d)) for i, (_, c) in enumerate(bodies) for d in range(10)]
    df = spark.createDataFrame(rows, "i int, kind string, at int, value string")
    labelled = df.selectExpr("i", "kind", "value", "CASE kind WHEN 'CARD' THEN 'Debit card' ELSE 'UID' END AS label", "'' AS type")
    right = [r for r in V.classify_values(labelled.withColumnRenamed("kind", "of")).collect() if r.kind == r.of]
    assert sorted((r.of, r.i) for r in right) == sorted((k, i) for k in ("AADHAAR", "CARD") for i in range(12))
    changed = []
    for r in right:
        for at in range(1, len(r.value)):
            digit = str((int(r.value[at]) + make.rng.randint(1, 9)) % 10)
            changed.append((r.of, r.label, r.value[:at] + digit + r.value[at + 1 :], ""))
    df = spark.createDataFrame(changed, "of string, label string, value string, type string")
    assert [r.value for r in V.classify_values(df).collect() if r.kind == r.of] == []
