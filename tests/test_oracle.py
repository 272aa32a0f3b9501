"""Every registered query against its DuckDB oracle at sf0.01 (the driver's correctness gate)."""

import pytest

import __spark_entry__ as E
from quarry.plans.registry import QUERIES as BASE  # the optional subpackage is tested in tests/llm
from paths import SF001, SF01
from oracle_check import compare

QUERIES = {k: v for k, v in E.queries().items() if k in BASE}
SQL = {k: v for k, v in E.oracle_sql().items() if k in BASE}


def test_registry_is_complete():
    assert set(SQL) <= set(QUERIES)
    # every registered query has an oracle
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck01, name):
    ok, msg = compare(QUERIES[name](spark, SF01), duck01, SQL[name])
    assert ok, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["split", "n_examples", "n_responses", "exact_match", "chrf"]
    assert len(rows) >= 1
    assert all(0.0 <= r["exact_match"] <= 1.0 and 0.0 <= r["chrf"] <= 100.0 for r in rows)
    # stable schema on a second run
    assert E.entry(spark).schema == df.schema
    assert SF001 in E.SMOKE_DIR
