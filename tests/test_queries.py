"""Registered queries against the SQL that states them."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from netlens.plans import registry


@pytest.fixture(scope="module")
def sql(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


#: One query of each kind; the driver compares all of them.
CHOSEN = [q for q in registry.ORACLE_SQL if not q.startswith("l7_")] + ["l7_ssh", "l7_imap", "l7_monero"]


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, sf_dir, sql, name):
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(map(str, (tuple(r) for r in df.select(columns).collect())))
    made = sql.sql(registry.ORACLE_SQL[name])
    assert sorted(made.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert got == sorted(map(str, sql.sql(f"SELECT {quoted} FROM ({registry.ORACLE_SQL[name]})").fetchall()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
