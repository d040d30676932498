"""Every query of the library against its SQL, and the entry point."""

import os

import duckdb
import pytest

import __spark_entry__
from textloom.plans.queries import QUERIES
from textloom.plans.sql import ORACLES


def rows(found):
    return sorted(repr(tuple(float(r[c]) if type(r[c]).__name__ == "Decimal" else r[c] for c in sorted(r))) for r in found)


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    cursor = con.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    want = rows(dict(zip(names, r)) for r in cursor.fetchall())
    assert rows(r.asDict() for r in QUERIES[name](spark, sf).collect()) == want


def test_queries_without_sql_give_rows(spark, sf):
    assert set(QUERIES) - set(ORACLES) == {"catalog_score_fuzzy", "knowledge_candidates_alike"}
    found = QUERIES["catalog_score_fuzzy"](spark, sf).collect()
    exact = {(r["qid"], r["doc_name"]): r["score"] for r in QUERIES["catalog_score_exact"](spark, sf).collect() if r["rank"] == 1}
    best = {(r["qid"], r["doc_name"]): r["score"] for r in found}
    assert found and all(best.get(k, 9) >= v for k, v in exact.items())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
