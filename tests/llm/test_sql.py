"""Registered queries of the training-data operators against their SQL."""

import duckdb
import pytest

import __spark_entry__
from offerloom.llm.queries import oracle_sql

TABLES = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "documents pages benchmark labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TABLES}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, TABLES)
    columns = sorted(df.columns)
    result = duck.execute(oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = sorted([tuple(r[names.index(c)] for c in columns) for r in result.fetchall()], key=repr)
    assert sorted([tuple(r[c] for c in columns) for r in df.collect()], key=repr) == want
    assert want


def test_looser_risk_certifies_cutoffs(duck):
    """The SQL sees the method: some texts go that the base rules let pass."""
    assert duck.execute(f"SELECT count(*) FROM ({oracle_sql()['quality_at_looser_risk']}) WHERE NOT kept AND NOT base_failed").fetchone()[0] > 0
