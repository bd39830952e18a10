"""Tasks, dependencies and the event log of a workforce."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.dedup import _cut, few


def ready(tasks: DataFrame, done: DataFrame, id_col: str = "task_id", deps: str = "dependencies") -> DataFrame:
    """Tasks that aren't done and all of whose dependencies are; without dependencies a task is ready."""
    open_ = tasks.join(done.select(id_col), id_col, "left_anti")
    each = open_.select(id_col, F.explode_outer(deps).alias("_dep"))
    state = each.join(done.select(F.col(id_col).alias("_dep"), F.lit(True).alias("_done")), "_dep", "left")
    ok = state.groupBy(id_col).agg(F.every(F.col("_dep").isNull() | F.coalesce("_done", F.lit(False))).alias("_ready"))
    return open_.join(ok.where("_ready").select(id_col), id_col, "left_semi")


def levels(tasks: DataFrame, id_col: str = "task_id", deps: str = "dependencies") -> DataFrame:
    """``task_id``, ``level``: 0 without dependencies, else one above the highest of them; a topological order is (level, id). A cycle raises."""
    edges = _cut(tasks.select(id_col, F.explode(deps).alias("dep")).join(tasks.select(F.col(id_col).alias("dep")), "dep", "left_semi"))
    left = _cut(tasks.select(id_col))
    out = None
    level = -1
    while not left.isEmpty():
        level += 1
        blocked = edges.join(left.select(F.col(id_col).alias("dep")), "dep", "left_semi").select(id_col)
        now = _cut(left.join(blocked, id_col, "left_anti"))
        if now.isEmpty():
            raise ValueError("the dependencies form a cycle")
        own = now.withColumn("level", F.lit(level).cast("long"))
        out = own if out is None else out.union(own)
        out = _cut(out) if level % 50 == 49 else out
        left = _cut(left.join(now, id_col, "left_anti"))
    return out if out is not None else tasks.select(id_col, F.lit(0).cast("long").alias("level"))


def depths(tasks: DataFrame, id_col: str = "task_id", parent: str = "parent_id") -> DataFrame:
    """``task_id``, ``depth`` in its tree: 1 for a root."""
    rows = tasks.select(id_col, parent)
    now = _cut(rows.where(F.col(parent).isNull()).select(id_col, F.lit(1).cast("long").alias("depth")))
    out, level = now, 0
    while not now.isEmpty():
        now = _cut(rows.join(now.select(F.col(id_col).alias(parent), F.col("depth").alias("_d")), parent).select(id_col, (F.col("_d") + 1).alias("depth")))
        level += 1
        out = _cut(out.union(now)) if level % 50 == 0 else out.union(now)
    return out


def rewired(deps: Column, original: Column, subtasks: Column) -> Column:
    """Dependencies with a decomposed task replaced by its subtasks, which come last."""
    return F.when(F.array_contains(deps, original), F.concat(F.filter(deps, lambda d: d != original), subtasks)).otherwise(deps)


def failure_policy(failures: Column, pending: Column, most_tries: int = 3, most_pending: int = 20) -> Column:
    """What to do with a failed task: halt, replan or retry."""
    return F.when(pending > most_pending, "halt").when(failures >= most_tries, "replan").otherwise("retry")


def shared_memory(records: DataFrame, agents: DataFrame) -> DataFrame:
    """Each agent's copy of all others' records; agents are a bounded table, whose size is checked."""
    return records.join(few(agents.select(F.col("agent_id").alias("receiver"))), F.col("receiver") != F.col("agent_id"))


def completion_times(log: DataFrame, task: str = "task_id", kind: str = "event_type", time: str = "timestamp") -> DataFrame:
    """Seconds from each completion back to the task's last assignment before it."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    upto = Window.partitionBy(task).orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumns({"_t": at, "_o": F.when(F.col(kind) == "task_assigned", 0).otherwise(1)})
    rows = rows.withColumn("_a", F.last(F.when(F.col(kind) == "task_assigned", F.col("_t")), ignorenulls=True).over(upto))
    return rows.where((F.col(kind) == "task_completed") & F.col("_a").isNotNull()).select(task, ((F.col("_t") - F.col("_a")) / 1e6).alias("seconds"))


def kpis(log: DataFrame, roots: DataFrame | None = None, task: str = "task_id", kind: str = "event_type", time: str = "timestamp") -> DataFrame:
    """One row of key figures: tasks created, completed, failed (root tasks not counted) and pending, the log's span and throughput."""
    rows = log.join(roots.select(task, F.lit(True).alias("_root")), task, "left") if roots is not None else log.withColumn("_root", F.lit(None).cast("boolean"))
    count = lambda k: F.count(F.when((F.col(kind) == k) & F.col("_root").isNull(), 1))
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    sums = rows.agg(count("task_created").alias("created"), count("task_completed").alias("completed"), count("task_failed").alias("failed"), ((F.max(micros) - F.min(micros)) / 1e6).alias("seconds"))
    return sums.select("*", (F.col("created") - F.col("completed") - F.col("failed")).alias("pending"), F.try_divide(F.col("completed"), F.col("seconds")).alias("per_second"), (F.try_divide(F.col("completed"), F.col("seconds")) * 60).alias("per_minute"))


@F.pandas_udf(T.StringType())
def _percent(x: pd.Series) -> pd.Series:
    """Two places of the number's exact binary value, as C prints it; Java's formatter rounds its shortest decimal form (0.125 and 1.005 up)."""
    return x.map(lambda v: f"{v:.2f}%", na_action="ignore")


def utilisation(log: DataFrame, roots: DataFrame | None = None, task: str = "task_id", kind: str = "event_type", worker: str = "worker_id", unnamed: bool = False) -> DataFrame:
    """``worker_id``, ``handled``, ``share`` (per cent, two places): tasks completed or failed by each worker, and if ``unnamed`` those of no worker."""
    rows = log.where(F.col(kind).isin("task_completed", "task_failed"))
    if roots is not None:
        rows = rows.join(roots.select(task), task, "left_anti")
    by = rows.groupBy(worker).agg(F.count(F.lit(1)).alias("handled"))
    total = F.sum("handled").over(Window.partitionBy())
    return by.select(worker, "handled", _percent(100.0 * F.col("handled") / total).alias("share")).where(F.col(worker).isNotNull() | F.lit(unnamed))
