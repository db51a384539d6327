"""Registered queries against SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# one or more of each family; tools/check.py runs all of them
NAMES = [
    "a03_candle_json", "a12_upsert", "a20_bars_m15", "b04_fill_gaps", "c07_first_touch", "c09_split_assignment", "d04_macd",
    "d09_obv", "d33_vol_percentile", "e08_regime_as_of", "e16_regime_flags", "f01_momentum_fast", "f08_vote_majority", "g01_ledger",
    "g07_kelly", "h13_auc", "i08_streaks", "i11_dashboard_metrics", "j05_split_validation", "k09_health_status", "l05_psi",
    "m02_sync_latest", "n08_ranked_scores",
]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    names = sorted(df.columns)
    mine = sorted(tuple(repr(r[n]) for n in names) for r in df.collect())
    res = con.sql(entry.oracle_sql()[name])
    assert sorted(res.columns) == names
    at = [res.columns.index(n) for n in names]
    assert mine == sorted(tuple(repr(r[i]) for i in at) for r in res.fetchall())


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns and df.limit(1).count() == 1
