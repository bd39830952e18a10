"""Shares are rounded as SQL's printf rounds them, and no worker is a worker of the query."""

import __spark_entry__ as entry
from millrace.operators import workflow


def test_ties_round_by_the_binary_value(spark):
    rows = [(1, "task_completed")] + [(2, "task_failed")] * 3 + [(3, "task_completed")] * 796
    log = spark.createDataFrame(rows, "worker_id int, event_type string").withColumn("task_id", workflow.F.lit(1))
    assert {r.worker_id: r.share for r in workflow.utilisation(log).collect()} == {1: "0.12%", 2: "0.38%", 3: "99.50%"}
    log = spark.createDataFrame([(1, "task_failed")] * 201 + [(None, "task_failed")] * 19799, "worker_id int, event_type string")
    assert [(r.worker_id, r.handled, r.share) for r in workflow.utilisation(log).collect()] == [(1, 201, "1.00%")]


def test_events_without_a_worker(spark, tmp_path):
    spark.sql("SELECT id AS event_id, timestamp '2024-01-01' AS ts, if(id = 1, CAST(NULL AS BIGINT), 7L) AS user_id FROM range(1, 6)").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.worker_id, r.handled, r.share) for r in entry.queries()["worker_utilisation"](spark, str(tmp_path)).collect()}
    assert got == {(None, 1, "25.00%"), (7, 3, "75.00%")}
