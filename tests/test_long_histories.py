"""Queries against their SQL where one key has more rows than a history holds, equal instants and values that lie just on a bound."""

from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from faultline.streaming import jobs as J


@pytest.fixture(scope="module")
def long_dir(spark, tmp_path_factory):
    """12,006 events of one function: six equal ones, then, after more than an hour, a ramp of durations by 0.01 and others."""
    at = tmp_path_factory.mktemp("long")
    i = F.col("id")
    value = F.when(i < 6, 29.27).when(i < 400, F.round(i * 0.1, 2)).otherwise(F.round((i * 7919) % 5600 / 100, 2))
    seconds = F.when(i < 6, i).otherwise(300_000 + i - i % 2)
    kind = F.element_at(F.array(*[F.lit(k) for k in ("view", "click", "signup", "view", "error")]), ((i * 13 % 7) % 5 + 1).cast("int"))
    spark.range(12_006).select(
        i.alias("event_id"), F.expr("timestamp'2024-01-01 00:00:00'").alias("start"), seconds.alias("s"), F.lit(0).cast("bigint").alias("user_id"), kind.alias("event_type"),
        value.alias("value"), F.format_string('{"k": %d}', i % 100).alias("props"),
    ).selectExpr("event_id", "CAST(timestamp_seconds(unix_seconds(start) + s) AS timestamp_ntz) AS ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(f"{at}/events.parquet")
    return str(at)


def differing(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet/*.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = {tuple(r[c] for c in cols) for r in df.collect()}
    rel = con.sql(entry.oracle_sql()[name])
    idx = [list(rel.columns).index(c) for c in cols]
    return sorted(got ^ {tuple(r[i] for i in idx) for r in rel.fetchall()}, key=str)


@pytest.mark.parametrize("name", ["detector_execution_pattern", "detector_seasonal_deviation", "detector_temporal_deviation", "detector_trend_change", "transform_impact", "attack_type"])
def test_long_history_matches_sql(spark, long_dir, name):
    assert differing(spark, long_dir, name)[:3] == []



def test_mean_performance_on_the_bound_is_not_low():
    """Ten points whose mean is .5, added up with noise."""
    row = SimpleNamespace(n=10, traces=1, sides=1, errors=0, points=10, performance=5 - 1e-15, qos={})
    assert J.Fallback().read(0, row) == []
