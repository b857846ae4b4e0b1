"""Registered queries of the corpus operators on the smallest tables: against their SQL, else that they cover every row."""

import duckdb
import pytest

from check_queries import TABLES, compare
from ligneo.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(ORACLES))
def test_against_sql(spark, con, name):
    message, _, good = compare(spark, con, SF_DIR, name, QUERIES[name], ORACLES[name])
    assert good, message


@pytest.mark.parametrize("name", ["op2_kneser", "op4_packing", "op5_tokenfile", "op6_pathjoin", "op10_sharding", "op11_squares", "op12_periodic"])
def test_every_document_is_there(spark, con, name):
    ids = {r[0] for r in con.sql("SELECT doc_id FROM documents").fetchall()}
    got = [r["doc_id"] for r in QUERIES[name](spark, SF_DIR).select("doc_id").collect()]
    assert set(got) == ids and (name in ("op4_packing", "op11_squares") or len(got) == len(ids))


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
