"""A sample of registered queries against their check SQL on the smallest tables; check.py runs all of them."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, canon

SF = "/root/testdata/sf0.001"
SAMPLE = ["fact_tag_fallback", "join_statements_outer", "forensic_report", "own_history_distribution", "pit_value_asof", "sent_score_text", "mom_snapshot", "resolve_quote"]


def test_every_query_is_checked():
    q, o = contract.queries(), contract.oracle_sql()
    assert set(o) <= set(q) and len(q) > 180


@pytest.mark.skipif(not os.path.isdir(SF), reason="fixture tables not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = contract.queries()[name](spark, SF)
    rel = con.sql(contract.oracle_sql()[name])
    at = [list(rel.columns).index(c) for c in df.columns]
    want = sorted((tuple(canon(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(canon(x) for x in r) for r in df.collect()), key=repr) == want
