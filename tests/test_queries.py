"""Registered queries against their SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__
from ladingspark.queries import checks, parsing, texts

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUICK = ("collapse_repeats", "check_payload", "graph_expand", "page_recheck", "merge_decision", "hybrid_pages", "judge_deals", "invoice_fields", "po_rest", "bl_rest", "lc_rest", "invoice_forms", "bl_forms", "clause_mixed", "classify_by_hand", "invoice_items", "lc_fields", "contract_clauses", "common_fields", "classify_documents", "fields_repaired", "label_normalise", "text_measures", "check_arithmetic", "deal_checks", "knn", "hybrid_search_vector_order", "page_stats", "encrypt_roundtrip", "stream_papers", "document_record", "record_stages", "ledger_rerun", "document_flow")
OWN = parsing.QUERIES | texts.QUERIES | checks.QUERIES


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, Decimal):
        return format(value.normalize(), "f")
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF) if os.path.isdir(SF) else []:
        con.sql(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, duck, name):
    query, sql = OWN[name]
    got = query(spark, SF)
    want = duck.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    fetched = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert rows == sorted((tuple(plain(r[c]) for c in columns) for r in fetched), key=repr)


def test_registration():
    assert set(OWN) <= set(__spark_entry__.queries())
    assert {n for n, (_, sql) in OWN.items() if sql} <= set(__spark_entry__.oracle_sql())
