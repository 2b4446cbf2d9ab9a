"""Stream jobs: keyed state over batches, replay, restart, revisions, and the same result as the batch job."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from redactlake.operators import scopes as C
from redactlake.streaming import state as Z


def _events(spark, rows):
    return spark.createDataFrame([(s, i, r, o, e, t) for s, i, r, o, e, t in rows], Z.EVENTS)


def _feed(spark, folder, *batches, **options):
    for rows in batches:
        _events(spark, rows).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        records = Z.run_events(spark, f"{folder}/in", f"{folder}/work", **options)
    return records


def _redacted(spark, folder):
    return {(r.scope, r.item_id, r.rev): r.redacted for r in spark.read.parquet(f"{folder}/work/redacted").filter("event = 'put'").collect()}


def test_tokens_and_names_last_over_batches_and_restarts(spark, tmp_path):
    put = lambda s, n, t: (s, str(n), n, n, "put", t)
    first = [put("a", 0, "call 9876543210"), put("a", 1, "mail a.b@x.org or 98765 43210\nName: Oona Pell"), put("b", 0, "call 9876500000"), put(None, 0, "call 7012345678")]
    second = [put("a", 2, "call 9876511111 then 9876543210, ask oona pell or PELL"), put("b", 1, "nothing of Oona"), put("b", 2, "a.b@x.org 9876543210"),
              put(None, 1, "7012345679 or 7012345678")]
    _feed(spark, tmp_path, first, second)  # every batch is a query of its own that goes on from the checkpoint
    assert _redacted(spark, tmp_path) == {
        ("a", "0", 0): "call MOBILE_1", ("a", "1", 1): "mail EMAIL_1 or MOBILE_1\nName: PERSON_1", ("b", "0", 0): "call MOBILE_1",
        (None, "0", 0): "call MOBILE_1", ("a", "2", 2): "call MOBILE_2 then MOBILE_1, ask PERSON_1 or PERSON_1",
        ("b", "1", 1): "nothing of Oona", ("b", "2", 2): "EMAIL_1 MOBILE_2", (None, "1", 1): "MOBILE_2 or MOBILE_1",
    }


def test_revisions_marks_and_deletes(spark, tmp_path):
    put = lambda item, rev, text: ("p", item, rev, 0, "put", text)
    one = [put("x", 1, "call 9876543210"), put("y", 1, "call 9876500000"), put("z", 1, "plain"), put("w", 1, "mail a@b.org"), put("v", 1, "mail c@d.org")]
    two = [put("x", 2, "call MOBILE_1"), ("p", "y", 2, 0, "delete", None), ("p", "w", 2, 0, "unmark", None), ("p", "z", 2, 0, "mark", None), put("v", 2, "now 9876500000")]
    three = [put("w", 3, "mail a@b.org"), put("y", 1, "late"), put("x", 3, "call 9876543210"), ("p", "w", 4, 0, "mark", None), put("v", 3, "MOBILE_2 is gone")]
    rows = _feed(spark, tmp_path, one, two, three, keep_texts=True).collect()
    got = sorted(((r.rev, r.item_id, r.event, r.change, r.shown, r.is_private) for r in rows), key=repr)
    assert got == [
        (1, "v", "put", "new", "mail EMAIL_1", True), (1, "w", "put", "new", "mail EMAIL_2", True), (1, "x", "put", "new", "call MOBILE_1", True),
        (1, "y", "put", "new", "call MOBILE_2", True), (1, "y", "put", "stale", None, False), (1, "z", "put", "plain", "plain", False),
        (2, "v", "put", "replaced", "now MOBILE_2", True), (2, "w", "unmark", "unmarked", "mail a@b.org", False),
        (2, "x", "put", "ours", "call MOBILE_1", True), (2, "y", "delete", "removed", None, False), (2, "z", "mark", "refused", None, False),
        (3, "v", "put", "replaced", "MOBILE_2 is gone", False), (3, "w", "put", "unmarked", "mail a@b.org", False),
        (3, "x", "put", "replaced", "call MOBILE_1", True), (4, "w", "mark", "marked", "mail EMAIL_2", True),
    ]
    shown = {r.item_id: r.shown for r in Z.latest_items(spark.read.parquet(f"{tmp_path}/work/records")).collect()}
    assert shown == {"x": "call MOBILE_1", "w": "mail EMAIL_2", "z": "plain", "v": "MOBILE_2 is gone"}


def test_state_holds_no_clear_values(spark, tmp_path):
    _feed(spark, tmp_path, [("s", "0", 0, 0, "put", "call 9876543210 Name\nName: Oona Pell")])
    for store in (tmp_path / "work" / "redacted-checkpoint" / "state", tmp_path / "work" / "records-checkpoint" / "state"):
        held = b"".join(p.read_bytes() for p in store.rglob("*") if p.is_file())
        assert held and b"9876543210" not in held and b"oona" not in held.lower()
    scope = Z.Scope("k")
    scope.token("MOBILE", "9876543210"), scope.token("PERSON", "oona pell")
    assert not any(word in repr(scope.saved()) for word in ("9876543210", "oona", "pell"))


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_is_the_batch_job_in_order_of_arrival(spark, tmp_path, seed):
    rng = random.Random(seed)
    names = ["Oona Pell", "Bram Tull", "Oona Tull", "Wren O'Neil", "Pell", "Dr. Edda Nash", "Pia-Lou Varga", "Edda"]
    bits = [lambda: f"call 98765{rng.randint(0, 20):05d}", lambda: f"Name: {rng.choice(names)}", lambda: f"hi {rng.choice(names)}", lambda: rng.choice(names).lower() + " came",
            lambda: "price of 9876500001 is fine", lambda: "nothing", lambda: "O'NEIL and dr. edda nash"]
    rows = [(f"s{s}", n, "\n".join(rng.choice(bits)() for _ in range(rng.randint(1, 4)))) for s in range(6) for n in range(8)]
    df = spark.createDataFrame(rows, "scope string, item_ord long, text string")
    want = {(r.scope, r.item_ord): r.redacted for r in C.redact_scopes(df, ["scope"], two_pass_names=False)[0].collect()}
    events = [(s, str(n), n, n, "put", t) for s, n, t in rows]
    _feed(spark, tmp_path, *([e for e in events if n <= e[2] < n + 3] for n in (0, 3, 6)))
    assert {(s, rev): t for (s, _, rev), t in _redacted(spark, tmp_path).items()} == want
    assert spark.read.parquet(f"{tmp_path}/work/redacted").filter(F.col("redacted").rlike("_0\\b")).count() == 0


class _Map(dict):
    """A state by key, as the state store keeps it."""

    exists = dict.__len__
    getValue = dict.get
    updateValue = dict.__setitem__


def _called(processor, held, rows, columns):
    processor.held = held
    frames = [pd.DataFrame(rows[:2], columns=columns), pd.DataFrame(rows[2:], columns=columns)]
    return [tuple(r) for f in processor.handleInputRows((7,), iter(frames), None) for r in f.itertuples(index=False)]


def test_one_call_takes_all_scopes_of_a_bucket():
    columns = ["scope", "item_id", "rev", "item_ord", "event", "text", "entities"]
    oona, held = json.dumps([{"kind": "PERSON", "norm_key": "oona pell"}]), _Map()
    rows = [("a", "2", str(2**60 + 1), "0", "put", "ask PELL", None), (None, "1", None, None, "put", "Name: Oona Pell", oona), ("a", "1", str(2**60), "0", "put", "Name: Oona Pell", oona), ("b", "1", "1", "0", "put", "Pell", None)]
    got = _called(Z._Tokens("k"), held, rows, columns)
    assert sorted(got, key=repr) == sorted([
        ("a", "1", 2**60, 0, "put", "Name: Oona Pell", '{"PERSON:oona pell": "PERSON_1"}', '[["oona pell", "PERSON_1"]]', '[["oona", "PERSON_1"], ["pell", "PERSON_1"]]'),
        ("a", "2", 2**60 + 1, 0, "put", "ask PELL", None, None, '[["pell", "PERSON_1"]]'), ("b", "1", 1, 0, "put", "Pell", None, None, None),
        (None, "1", None, None, "put", "Name: Oona Pell", '{"PERSON:oona pell": "PERSON_1"}', '[["oona pell", "PERSON_1"]]', '[["oona", "PERSON_1"], ["pell", "PERSON_1"]]'),
    ], key=repr)
    assert set(held) == {('"a"',), ("null",)}  # a scope that holds nothing is not stored
    assert _called(Z._Tokens("k"), held, [("a", "3", "9", "0", "put", "oona", None), ("b", "3", "9", "0", "put", "oona", None)], columns) == [
        ("a", "3", 9, 0, "put", "oona", None, None, '[["oona", "PERSON_1"]]'), ("b", "3", 9, 0, "put", "oona", None, None, None),
    ]
    columns, held = ["scope", "item_id", "rev", "item_ord", "event", "text", "redacted"], _Map()
    rows = [("a", "x", "2", "0", "unmark", None, None), ("a", "x", "1", "0", "put", "call 1", "call M"), ("b", "x", "1", "0", "put", None, "plain"), ("b", "x", "0", "0", "put", None, "late")]
    assert sorted(_called(Z._Records(True), held, rows, columns)) == [
        ("a", "x", 1, 0, "put", "new", "call M", True), ("a", "x", 2, 0, "unmark", "unmarked", "call 1", False), ("b", "x", 0, 0, "put", "plain", "late", False), ("b", "x", 1, 0, "put", "plain", "plain", False),
    ]
    assert held == {('["a", "x"]',): (2, "call 1", "call M", False), ('["b", "x"]',): (1, None, None, None)}


def test_python_is_called_by_bucket_and_plain_texts_are_not_looked_through_again(spark, tmp_path):
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    put = lambda s, t: (s, "d", 1, 0, "put", t)
    texts = {f"s{n}": ("nothing here", f"call 98765{n:05d}", "Password: plum", None)[n % 4] for n in range(400)}
    records = {r.scope: (r.change, r.shown, r.is_private) for r in _feed(spark, tmp_path, [put(s, t) for s, t in texts.items()], keep_texts=True).collect()}
    shown = (("plain", "nothing here", False), ("new", "call MOBILE_1", True), ("new", "Password: [HIDDEN]", True), ("plain", None, False))
    assert records == {f"s{n}": shown[n % 4] for n in range(400)}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider
    stream = Z.redact_events(spark.readStream.schema(Z.EVENTS).parquet(f"{tmp_path}/in"))
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "TransformWithStateInPySpark" in plan and "FlatMapGroupsInPandasWithState" not in plan and "bucket" in plan
