"""A sample of registered queries against their SQL on the smallest data; tools/check.py runs them all."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["detector_cascade_failure", "detector_frequency_anomaly", "record_risk", "detect_pii", "cost_spikes", "curve_points", "verify_traces", "recent_edges", "distribution_shift"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    rel = con.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect())))
    idx = [list(rel.columns).index(c) for c in cols]
    want = sorted(map(str, (tuple(r[i] for i in idx) for r in con.execute(entry.oracle_sql()[name]).fetchall())))
    assert got == want


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 20
