"""The driver contract, and some queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SOME = ["p2_type_stats", "p4_found", "p4_report", "p6_found", "sc11_converted_edges", "f16_admitted_edges", "a03_group_aggregate", "a23_dynamic_profile", "g14_simple_paths", "u01_pair_metrics", "m16_profile_scores", "m30_region_screen", "e11_expanded_profiles"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "null" if v is None or pd.isna(v) else f"{v:.8g}" if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v))
    return sorted(map(tuple, df.to_numpy()))


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    assert normal(entry.queries()[name](spark, DATA).toPandas()) == normal(con.execute(entry.oracle_sql()[name]).df())
