"""A few registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "events lineitem orders documents pages benchmark".split()
NAMES = ["metrics_by_dims", "feature_frame", "regime_labels", "resolve_venue_first", "slice_hunt", "page_hinkley", "oof_validation", "sink_merge_idempotent", "catalog_integrity", "s_bars"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables absent")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(str(tuple(r)) for r in df.select(cols).collect())
    cur = con.execute(entry.oracle_sql()[name])
    place = [[c[0] for c in cur.description].index(c) for c in cols]
    want = sorted(str(tuple(row[i] for i in place)) for row in cur.fetchall())
    assert got == want


def test_every_sql_has_a_query_and_import_needs_no_session():
    import subprocess
    import sys

    assert set(entry.oracle_sql()) <= set(entry.queries())
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry.__file__))
