"""What the history windows hold per task: each block has its own task, and copies of a row carry only what is read of them."""

from pyspark.sql import functions as F

from faultline.operators import detectors as D, history as H
from faultline.sources.tables import telemetry


def test_blocks_are_spread_over_tasks(spark, sf_dir):
    """1,000 rows of one key in blocks of 100: however few bytes they have, no task gets more than a few blocks."""
    t = telemetry(spark, sf_dir).withColumn("function_id", F.lit("f"))
    out = D.detect(t, ["error_clustering"], limit=50, block=100).select("event_id", F.spark_partition_id().alias("task"))
    rows = [r["count"] for r in out.groupBy("task").count().collect()]
    assert sum(rows) == t.count() and max(rows) <= 500 and len(rows) >= 4


def test_a_detector_keeps_only_the_sums_it_reads(spark, sf_dir):
    out = D.detect(telemetry(spark, sf_dir), ["error_clustering"], limit=50, block=100)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "_s_e" in plan and "_s_dm" not in plan and "_s_w2" not in plan


def test_look_back_finds_chosen_fields(spark):
    df = spark.createDataFrame([("k", t, i + 1) for i, t in enumerate([0, 4, 4, 9, 20])], "k string, t long, rn long").withColumn("p", F.struct(F.col("rn").alias("n"), (F.col("t") * 2).alias("x"), F.lit("wide").alias("y")))
    out = H.look_back(df, ["k"], "t", "p", {"a": 5, "b": 9}, fields={"a": ["n"], "b": ["n", "x"]})
    assert out.columns == ["k", "t", "rn", "p", "a", "b"] and out.select("a.*").columns == ["n"] and out.select("b.*").columns == ["n", "x"]
    got = {r.rn: (r.a and r.a.n, r.b and tuple(r.b)) for r in out.collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (None, None), 4: (3, (1, 0)), 5: (4, (4, 18))}


def test_no_two_blocks_share_a_task(spark, sf_dir):
    """20 blocks of one key: a hash over 40 tasks would bring some of them together."""
    t = telemetry(spark, sf_dir).withColumn("function_id", F.lit("f"))
    out = D.detect(t, ["error_clustering"], limit=25, block=50).select(F.spark_partition_id().alias("task"))
    assert [r["count"] for r in out.groupBy("task").count().collect()] == [50] * (t.count() // 50)


def test_keys_far_smaller_than_a_block_share_tasks(spark, sf_dir):
    """100 keys of 5 rows beside one of 500 in blocks of 100: five tasks for the large one, about half a block in each of the others."""
    t = telemetry(spark, sf_dir).withColumn("function_id", F.expr("CASE WHEN event_id % 2 = 0 THEN 'f' ELSE concat('g', event_id DIV 2 % 100) END"))
    out = D.detect(t, ["error_clustering"], limit=50, block=100).select("function_id", F.spark_partition_id().alias("task"))
    tasks = {r.task: (r.keys, r.rows) for r in out.groupBy("task").agg(F.collect_set("function_id").alias("keys"), F.count(F.lit(1)).alias("rows")).collect()}
    large = [rows for keys, rows in tasks.values() if "f" in keys]
    assert large == [100] * 5 and sum(rows for _, rows in tasks.values()) == t.count() and 15 >= len(tasks) > 5
