"""Scopes that grow: token maps extended, late details numbered, stored values found, decisions about fields."""

import random

from pyspark.sql import functions as F

from redactlake.functions import rules as R
from redactlake.operators import leaks as L
from redactlake.operators import redaction as X
from redactlake.operators import review as W
from redactlake.operators import scopes as C
from redactlake.operators import tokens as T
from redactlake.sources import html as H
from redactlake.sources import resolve
from tests.made import Maker

MENTION = "scope string, item_ord long, phase int, pos int, kind string, raw string"


def _mentions(spark, rows):
    return spark.createDataFrame([(s, n, 0, 0, k, r) for n, (s, k, r) in enumerate(rows)], MENTION).withColumn("norm_key", R.norm_key(F.col("kind"), F.col("raw")))


def test_extending_a_token_map_goes_on_with_its_numbers_and_people(spark):
    old = _mentions(spark, [("a", "PERSON", "Oona Pell"), ("a", "MOBILE", "9876543210"), ("a", "PERSON", "Bram Tull"), ("b", "MOBILE", "9876543211"), (None, "PAN", "ABCDE1234F")])
    tokens = T.assign_tokens(old, ["scope"])
    new = _mentions(spark, [("a", "MOBILE", "98765 43210"), ("a", "MOBILE", "9876543299"), ("b", "MOBILE", "9876543299"), ("a", "PERSON", "Wren Pell"), ("a", "PERSON", "Edda Nash"),
                            ("a", "PERSON", "Koji Nash"), ("a", "PERSON", "Oona Tull"), ("b", "PERSON", "Oona Pell"), (None, "PAN", "abcde1234f"), (None, "PAN", "ABCDE1234G")])
    more = {(r.scope, r.norm_key): r.token for r in T.extend_tokens(tokens, new, ["scope"]).collect()}
    assert more == {
        ("a", "9876543299"): "MOBILE_2", ("b", "9876543299"): "MOBILE_2", ("a", "wren pell"): "PERSON_1", ("a", "edda nash"): "PERSON_3", ("a", "koji nash"): "PERSON_3",
        # two people known by their words, or none: a person of its own
        ("a", "oona tull"): "PERSON_4", ("b", "oona pell"): "PERSON_1", (None, "abcde1234g"): "PAN_2",
    }
    named, every = T.token_mentions(new, tokens, ["scope"])
    assert named.count() == 10 and every.count() == tokens.count() + len(more)


def test_new_names_meet_the_people_of_the_map_by_their_tokens(spark):
    people = lambda scope, *names: [(scope, "PERSON", n) for n in names]
    tokens = T.assign_tokens(_mentions(spark, people("a", "Oona Pell", "Oona Tull") + people("b", "Oona", "Bram Ray", "Oona Bram")), ["scope"])
    assert {(r.scope, r.norm_key): r.token for r in tokens.collect()} == {
        ("a", "oona pell"): "PERSON_1", ("a", "oona tull"): "PERSON_1", ("b", "oona"): "PERSON_1", ("b", "bram ray"): "PERSON_2", ("b", "oona bram"): "PERSON_3",
    }
    # two names of one person are one person; a name of the map keeps its token, whoever used its words since
    new = _mentions(spark, people("a", "Pell Tull") + people("b", "Oona", "Oona Zed"))
    assert {(r.scope, r.norm_key): r.token for r in T.extend_tokens(tokens, new, ["scope"]).collect()} == {("a", "pell tull"): "PERSON_1", ("b", "oona zed"): "PERSON_1"}


def test_details_of_the_second_look_get_numbers_of_their_own(spark):
    maker, name = Maker(4), lambda n: "Q" + 3 * "abcdefghijklmnopqrst"[n]
    rows = [("s", n, f"hi {name(n)}") for n in range(12)]
    cards = [maker.value("CARD").replace("-", "") for _ in range(3)]
    filler = " " + "x" * 26 + " "
    # the amount word begins 45 characters before the card while the name is written PERSON_1, and out of sight when it is PERSON_13
    rows += [("s", 20 + n, f"price hi {name(12 + n)}{filler}{card}") for n, card in enumerate([*cards, cards[0]])]
    items = spark.createDataFrame(rows, "scope string, item_ord long, text string")
    first = C.item_entities(items, ["scope"], "item_ord", "text").filter("kind = 'CARD'").count()
    done, tokens = C.redact_scopes(items, ["scope"])
    shown = {r.item_ord: r.redacted for r in done.collect()}
    held = {r.token: r.value for r in tokens.collect()}
    assert first == 0 and not any(t.endswith("_0") for t in shown.values())
    assert [shown[20 + n].rsplit(" ", 1)[1] for n in range(4)] == ["CARD_1", "CARD_2", "CARD_3", "CARD_1"]
    for _, n, text in rows:  # every token leads back to its value
        back = shown[n]
        for token in sorted(held, key=len, reverse=True):
            back = back.replace(token, held[token])
        assert back == text


def test_stored_values_are_found_as_a_plain_search_finds_them(spark):
    rng = random.Random(6)
    letters = "aé日 "
    word = lambda a, b: "".join(rng.choice(letters) for _ in range(rng.randint(a, b)))
    values = [(f"s{i % 3}" if i % 4 else None, word(1, 5)) for i in range(60)]
    texts = [(f"s{i % 3}" if i % 4 else None, i, word(0, 60) if i % 9 else None) for i in range(80)]
    got = L.known_value_leaks(
        spark.createDataFrame(texts, "scope string, item long, redacted string"), spark.createDataFrame(values, "scope string, value string"), ["scope"], ["item"]
    ).collect()
    want = {(s, i, v) for s, i, t in texts for z, v in values if s == z and len(v) >= 3 and v in (t or "")}
    assert {(r.scope, r.item, r.value) for r in got} == want and len(got) == len(want) and len(want) > 50


def test_many_details_of_one_text_in_linear_time(spark):
    n = 6000
    text = "\n".join(f"mail u{i}@example.org or 7{i:09d} x" for i in range(n)) + "\nmail u5@example.org"
    row = X.redact_rows(spark.createDataFrame([(text,)], "text string")).first()
    assert row.redacted.endswith(f"mail EMAIL_{n} or MOBILE_{n} x\nmail EMAIL_6") and len(row.entities) == 2 * n + 1


def test_decisions_about_fields(spark):
    schema = "page_id long, item_id string, node_ord long, label string, type string, value string, kind string, token string, locked boolean, authentication boolean"
    rows = [
        (1, "a", 1, "Email", "text", "a@b.org", "EMAIL", "EMAIL_1", False, False), (1, "b", 2, "Note", "text", "plum", None, None, False, False),
        (1, "c", 3, "Mobile", "text", "9876543210", None, None, False, False), (1, "d", 4, "Password", "password", "", "PASSWORD", None, True, False),
        (1, "e", 5, "User", "text", "me", None, None, False, True), (1, "f", 6, "Note", "text", "", None, None, False, False), (1, "g", 7, "Note", "text", "pear", None, None, False, False),
        (2, "a", 1, "Email", "text", "a@b.org", "EMAIL", "EMAIL_1", False, False),
    ]
    mentions = _mentions(spark, []).withColumn("page_id", F.lit(1).cast("long"))
    tokens = T.no_tokens(mentions, ["page_id"])
    log = [(1, "a", False, 1), (1, "b", True, 1), (1, "c", True, 2), (1, "d", False, 1), (1, "e", True, 1), (1, "f", True, 1)]
    fields = spark.createDataFrame(rows, schema)
    listed, every = W.field_detections(fields, spark.createDataFrame(log, "page_id long, item_id string, is_private boolean, ts int"), tokens)
    assert {(r.page_id, r.item_id): (r.kind, r.original, r.redacted, r.has_record) for r in listed.collect()} == {
        (1, "a"): ("PRIVATE", "a@b.org", "", False), (1, "b"): ("PRIVATE", "plum", "PRIVATE_1", True), (1, "c"): ("MOBILE", "9876543210", "MOBILE_1", True),
        (1, "d"): ("PASSWORD", None, "", True), (1, "f"): ("PRIVATE", "", "", False), (2, "a"): ("EMAIL", "a@b.org", "EMAIL_1", True),
    }
    assert sorted(r.token for r in every.collect()) == ["MOBILE_1", "PRIVATE_1"]


def test_secrets_leave_no_parser(spark):
    html = "<input name=cvv value=123><label>Card PIN <input value=4711></label><textarea id=otp>8812</textarea><input type=password value=plum><input name=city value=Pune>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id int, html string")
    nodes = H.page_nodes(pages).collect()
    held = [r.attrs.get("value") for r in nodes] + [r.text for r in nodes]
    assert "Pune" in held and not {"123", "4711", "8812", "plum"} & set(held)
    assert [(r.value, r.locked) for r in resolve.page_fields(resolve.resolved_pages(pages)).orderBy("node_ord").collect()] == [("", True)] * 4 + [("Pune", False)]
