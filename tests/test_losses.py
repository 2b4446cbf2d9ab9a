"""Inputs that must not get lost: null keys, folders of files, open sessions, references, long texts."""

import html
from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from redactlake.operators import records as V
from redactlake.operators import review as W
from redactlake.operators import scopes as C
from redactlake.sources import html as H
from redactlake.sources import tables as S
from redactlake.streaming import jobs as J
from tests.oracle import differences

START = datetime(2024, 3, 1, 23, 50)


def _events(spark):
    rows = [(n, None if n % 5 == 0 else n % 3, START + timedelta(minutes=m)) for n, m in enumerate((0, 1, 7, 20, 41, 43, 90, 91, 200, 203, 204, 260))]
    return rows, spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")


def _quiet(rows, minutes):
    """Events of a key that no other follows soon."""
    out = set()
    for n, user, ts in rows:
        later = [t for m, u, t in rows if u == user and (t, m) > (ts, n)]
        if not later or min(later) >= ts + timedelta(minutes=minutes):
            out.add((n, user))
    return out


@pytest.mark.parametrize("files", [1, 4])
def test_debounce_of_null_keys_and_folders(spark, tmp_path, files):
    rows, df = _events(spark)
    want = _quiet(rows, 30)
    assert {(r.event_id, r.user_id) for r in W.debounce(df, ["user_id"], "ts", "event_id", "30 MINUTE").collect()} == want
    path = str(tmp_path / "events.parquet")
    df.repartition(files).write.parquet(path)
    assert {(r.event_id, r.user_id) for r in J.run_debounce(spark, path, "30 minutes", "10 minutes").collect()} == want


def test_null_scope_keeps_its_values_apart(spark):
    rows = [(None, 0, "call 7012345678 or 7012345679"), (None, 1, "call 7012345679"), ("s", 0, "call 7012345679")]
    done, tokens = C.redact_scopes(spark.createDataFrame(rows, "scope string, item_ord long, text string"), ["scope"])
    assert {(r.scope, r.item_ord): r.redacted for r in done.collect()} == {
        (None, 0): "call MOBILE_1 or MOBILE_2", (None, 1): "call MOBILE_2", ("s", 0): "call MOBILE_1"
    }
    assert {(r.scope, r.norm_key) for r in tokens.collect()} == {(None, "7012345678"), (None, "7012345679"), ("s", "7012345679")}


def test_references_read_as_the_standard_library_reads_them(spark):
    texts = [
        "a.b&#64;x.org", "a.b&commat;x.org", "70123&#52;5678", "&#x41;&#X6a;&#65", "&copy 2020 &notit; &ampx &NotEqualTilde;", "&;&#;&#x;& &zzzz;", "&#0;&#128;&#129;&#xD800;&#x110000;",
        "&#99999999999999999999;", "&lt;b&gt;&amp;lt;", "é&eacute;&#233", "&#1;&#11;&#127;", "plain", "&acE;&fjlig;", "&CounterClockwiseContourIntegral;",
    ]
    df = spark.createDataFrame([(i, f"<p>x{t}y</p>") for i, t in enumerate(texts)], "page_id int, html string")
    assert {r.page_id: r.text for r in H.page_chunks(df).collect()} == {i: f"x{html.unescape(t)}y" for i, t in enumerate(texts)}


def test_whole_pages_are_read(spark):
    page = "<p>" + "long text " * 9000 + "</p><p>the end</p>"
    text = H.page_text(spark.createDataFrame([(1, page)], "page_id int, html string")).collect()[0].text
    assert text.endswith("the end") and len(text) > 89_000
    assert len(H.page_text(spark.createDataFrame([(1, page)], "page_id int, html string"), cap=50).collect()[0].text) == 50


def test_origins(spark):
    urls = {
        "https://A.example:443/x": "https://a.example", "http://u:p@a.example:8080?q": "http://a.example:8080", "HTTP://a.example:80": "http://a.example",
        "http://a.example:443/": "http://a.example:443", "https://[::1]:443/": "https://[::1]", "ftp://a.example": "", "https:///x": "", "nothing": "",
    }
    df = spark.createDataFrame(list(urls.items()), "url string, want string")
    assert [(r.url, r.o) for r in df.withColumn("o", V.origin("url")).collect() if r.o != r.want] == []
    kept = V.eligible_pages(df, df.sparkSession.createDataFrame([("https://a.example",)], "origin string")).collect()
    assert [r.url for r in kept] == ["https://A.example:443/x"]


def test_sinks_write_only_allowed_columns(spark, tmp_path):
    df = spark.range(1).select(F.lit("x").alias("html"), F.lit("raw").alias("norm_key"), F.lit("MOBILE_1").alias("redacted"), F.lit("s").alias("scope"))
    S.write_redacted(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).columns == ["redacted", "scope"]
    with pytest.raises(ValueError):
        S.write_redacted(df.select("html"), str(tmp_path / "none"))


def test_overrides_hold_for_their_page_only(spark):
    rows = [(page, "email", "EMAIL", "a@b.example", "EMAIL_1", "EMAIL_1", False, False) for page in (1, 2, None)]
    items = spark.createDataFrame(rows, "page_id long, item_id string, kind string, original string, redacted string, current string, locked boolean, authentication boolean")
    marks = spark.createDataFrame([(1, "email", False, 1), (None, "email", True, 1), (None, "email", False, 2)], "page_id long, item_id string, is_private boolean, ts int")
    shown = {r.page_id: (r.is_private, r.shown) for r in W.apply_overrides(items, marks).collect()}
    assert shown == {1: (False, "a@b.example"), 2: (True, "EMAIL_1"), None: (False, "a@b.example")}


def test_people_on_pictures_get_tokens_too(spark, tmp_path):
    """Keys 0 and 2 modulo 6 are lines with names, 1 and 4 with numbers, the others hold nothing; later pictures of a sheet are those from its eleventh on."""
    keys = [k for k in range(120) if k not in (0, 2, 6, 8)]  # the first sheet has no names before its later pictures
    pq.write_table(pa.Table.from_pylist([{"c_custkey": k} for k in keys]), f"{tmp_path}/customer.parquet")
    df = entry.queries()["register_visual"](spark, str(tmp_path))
    got = {r.image_id: (r.kind, r.token) for r in df.collect()}
    assert set(got) == {k for k in keys if k % 20 >= 10 and k % 6 in (0, 1, 2, 4)}
    # the word "Full" of the line belongs to the first person of the sheet, so all names there are theirs
    assert {v for k, v in got.items() if k % 6 in (0, 2)} == {("PERSON", "PERSON_1")}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
    assert differences(df, con, entry.oracle_sql()["register_visual"]) == ""
