"""Stored tables of one row group are work for all tasks, and shared steps are worked out once."""

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from redactlake.plans import changes, documents
from redactlake.plans.tables import derive, table
from redactlake.sources.tables import FEW_ROWS, spread
from redactlake.streaming import state as Z


def _stored(folder, name, rows, row_group=None):
    pq.write_table(pa.Table.from_pylist(rows), f"{folder}/{name}.parquet", row_group_size=row_group or len(rows))
    return f"{folder}/{name}.parquet"


def _busy(df):
    """Rows of each task that has any."""
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


CUSTOMERS = [{"c_custkey": i if i % 50 else None, "c_name": f"n{i % 7}"} for i in range(3 * FEW_ROWS)]


def test_one_row_group_becomes_work_for_all(spark, tmp_path):
    stored = spark.read.parquet(_stored(tmp_path, "customer", CUSTOMERS))
    assert len(_busy(stored)) == 1
    cores = spark.sparkContext.defaultParallelism
    for dealt in (table(spark, str(tmp_path), "customer"), derive(spark, str(tmp_path), "SELECT c_custkey AS k, c_name FROM customer")):
        assert len(_busy(dealt)) >= cores and max(_busy(dealt)) * cores <= 2 * len(CUSTOMERS)
        assert dealt.exceptAll(stored).isEmpty() and stored.exceptAll(dealt).isEmpty()


def test_costly_filters_stay_behind_the_shuffle(spark, tmp_path):
    _stored(tmp_path, "customer", CUSTOMERS)
    slow = table(spark, str(tmp_path), "customer").withColumn("hit", F.col("c_name").rlike("n[0-3]")).filter("hit")
    plan = _plan(slow)
    assert plan.index("RLIKE") < plan.index("Repartition") and plan.rindex("RLIKE") < plan.index("Repartition")


def test_small_and_even_tables_are_left_alone(spark, tmp_path):
    few = spark.read.parquet(_stored(tmp_path, "few", CUSTOMERS[:FEW_ROWS]))
    assert spread(few) is few
    cores = spark.sparkContext.defaultParallelism
    even = spark.range(0, cores * FEW_ROWS, 1, cores)
    assert spread(even) is even
    none = spark.createDataFrame([], "a long")
    assert spread(none) is none


DOCS = [{"doc_id": i, "text": f"call 98765{i:05d}" if i % 2 else "nothing", "lang": "en", "source": "s", "n_chars": 9} for i in range(30)]


def test_documents_are_redacted_once_for_both_scans(spark, tmp_path):
    _stored(tmp_path, "documents", DOCS)
    for part in changes._two_scans(spark, str(tmp_path)):
        assert "parquet" not in _plan(part)
    got = {r.doc_id: r.change for r in changes.changed_items(spark, str(tmp_path)).collect()}
    assert got == {i: ("removed", "replaced", "ours")[i % 3] for i in range(1, 30, 2)}


def test_outgoing_documents_are_redacted_once_for_leaks(spark, tmp_path):
    _stored(tmp_path, "documents", DOCS)
    found = documents.doc_known_value_leaks(spark, str(tmp_path))
    assert "parquet" not in _plan(found)
    assert found.collect() == []  # documents that go out as they are have even numbers, and nothing to hide
    _stored(tmp_path, "documents", [{**d, "text": "call 9876543210"} for d in DOCS])
    assert {(r.doc_id, r.value) for r in documents.doc_known_value_leaks(spark, str(tmp_path)).collect()} == {(i, "9876543210") for i in range(0, 30, 4)}


def test_events_of_a_group_are_sorted_as_before():
    rows = [(2**60 + 1, 0, "b"), (None, 5, "a"), (3, None, None), (3, None, "a"), (3, 1, "z"), (2**60, 0, "c")]
    mixed = [pd.DataFrame(r, columns=["rev", "item_ord", "item_id"]) for r in (rows[:1], rows[1:5], rows[5:])]
    assert [tuple(r) for r in Z._in_order(iter(mixed))] == [rows[1], rows[2], rows[3], rows[4], rows[5], rows[0]]
    out = Z._frame([("s", None, 1, None, "put", "t", "{}", "[]", "[]")], Z._TOKENED)
    assert list(out.columns)[:4] == ["scope", "item_id", "rev", "item_ord"] and out["item_ord"][0] is None
