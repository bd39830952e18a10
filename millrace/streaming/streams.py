"""Structured Streaming: chunks into texts, task queues, key figures, chat memory, adaptive batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "stream_id string, n long, text string"


def accumulated(chunks: DataFrame, key: str = "stream_id", order: str = "seq", text: str = "chunk") -> DataFrame:
    """The whole text of each stream of chunks, in order (batch)."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return chunks.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p[text]), "").alias("text"))


def accumulating(chunks: DataFrame, key: str = "stream_id", order: str = "seq", text: str = "chunk") -> DataFrame:
    """The same over a stream: after each micro-batch, the text so far of each key that got chunks, which must come in order from batch to batch."""

    def add(keys, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, whole = state.get if state.exists else (0, "")
        for rows in batches:
            rows = rows.sort_values(order)
            n, whole = n + len(rows), whole + "".join(rows[text].fillna(""))
        state.update((n, whole))
        yield pd.DataFrame([(str(keys[0]), n, whole)], columns=["stream_id", "n", "text"])

    return chunks.groupBy(key).applyInPandasWithState(add, _SCHEMA, "n long, text string", "update", "NoTimeout")


#: A task's states by event: from, to.
MOVES = {"publish": (None, "sent"), "claim": ("sent", "processing"), "return": ("processing", "returned"), "archive": ("returned", "archived")}


def task_states(events: DataFrame, task: str = "task_id", order: str = "seq", kind: str = "event") -> DataFrame:
    """Each task's state after its events in order; a move that isn't allowed is passed over. Batch: a fold in the JVM."""
    steps = F.array_sort(F.collect_list(F.struct(order, kind)))
    move = F.lit(None).cast("string")
    fold = lambda a, e: _moved(a, e[kind])
    return events.groupBy(task).agg(F.aggregate(steps, F.coalesce(move, F.lit("none")), fold).alias("state"))


def _moved(state, event):
    out = state
    for name, (before, after) in MOVES.items():
        out = F.when((event == name) & (state == (before or "none")), after).otherwise(out)
    return out


def queued(events: DataFrame) -> DataFrame:
    """Tasks sent and not yet claimed for each assignee, first in first out: ``assignee``, ``task_id``, ``place``."""
    from pyspark.sql import Window

    states = task_states(events).where("state = 'sent'")
    sent = events.where("event = 'publish'").groupBy("task_id", "assignee").agg(F.min("seq").alias("seq"))
    return sent.join(states.select("task_id"), "task_id", "left_semi").select("assignee", "task_id", F.row_number().over(Window.partitionBy("assignee").orderBy("seq")).cast("long").alias("place"))


def counted(events: DataFrame, kind: str = "event_type") -> DataFrame:
    """Events by kind; over a stream, write in update or complete mode."""
    return events.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "2 hours", kind: str = "event_type") -> DataFrame:
    """Events by kind in windows of event time, with a watermark. (An extra that the inventory doesn't have.)"""
    return events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n"))


def appended(stream: DataFrame, path: str, checkpoint: str):
    """Writes what is there as JSON lines and ends; started again, goes on where it ended."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_size(size: float, success: bool, cpu: float = 0.0, memory: float = 0.0, cpu_limit: float = 80.0, memory_limit: float = 85.0) -> int:
    """The next batch size: a fifth more after a success, a fifth less after a failure or under load, between 1 and 20."""
    if cpu > cpu_limit or memory > memory_limit or not success:
        return max(1, int(size * 0.8))
    return min(20, max(int(size * 1.2), int(size) + 1))


def generated(spark: SparkSession, rows_per_second: int = 10) -> DataFrame:
    """An unbounded source of numbered rows, to be mapped by the caller's generator."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
