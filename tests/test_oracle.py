"""Registered queries against DuckDB on the given tables (a sample; the rest is checked per release)."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, differences

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SAMPLE = [
    "doc_entities", "doc_redacted_numbered", "text_redacted", "text_entities", "page_chunks", "page_nodes", "page_restricted_texts",
    "table_headers", "neighbour_labels", "field_labels", "authentication_fields", "classify_values", "luhn_check", "verhoeff_check",
    "validate_records", "raw_pii_gate", "latest_revision", "debounce_events", "apply_overrides", "role_change", "page_fields",
    "name_substitution", "doc_known_value_leaks",
]
if os.environ.get("TEST_ALL_QUERIES"):
    SAMPLE = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_duckdb(spark, con, name):
    assert differences(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name]) == ""
