"""Stores of sorted, bucketed segments under one log: what an index adds batch by batch, merges, and reads without a shuffle.

A segment is a Parquet folder dealt into buckets by a key and sorted in them; it never changes. Segments come in named groups, all of one group with the same
key, number of buckets and columns. Adding and dropping them changes a working copy; ``commit`` publishes it as the next version (see
``versions``), so a batch that touches several groups comes as a whole or not at all. A store opened at the same path later, in another
session too, has the segments of the last version. Tables are entered in the session's catalog under names of their own, since a bucketing is read from there only.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.sources.versions import Files, Log


class SegmentStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.log, self.files, self._names = Log(spark, f"{self.path}/log"), Files(spark), {}
        self.state = {"groups": {}, "meta": {}} | self.log.read()

    @property
    def meta(self) -> dict:
        """What the store's owner keeps with it: numbers and texts, part of the version."""
        return self.state["meta"]

    @property
    def version(self) -> int:
        return self.state["version"]

    def segments(self, group: str) -> list[dict]:
        """``folder``, ``rows`` and further figures of the group's segments, oldest first."""
        return self.state["groups"].get(group, {}).get("segments", [])

    def tables(self, group: str) -> list[DataFrame]:
        return [self.table(group, s["folder"]) for s in self.segments(group)]

    def rows(self, group: str) -> DataFrame | None:
        """All rows of a group as one table without buckets, or None if it has no segment; for what groups or joins them all together.

        A union of bucketed tables won't do there: the plan takes it for dealt by the key, but it has the buckets of its tables one after the other.
        """
        found = [f"{self.path}/data/{s['folder']}" for s in self.segments(group)]
        return self.spark.read.schema(T.StructType.fromJson(json.loads(self.state["groups"][group]["schema"]))).parquet(*found) if found else None

    def table(self, group: str, folder: str) -> DataFrame:
        """A segment's rows; grouping them by the key needs no shuffle, nor does their side of a join by it."""
        if folder not in self._names:
            own = self.state["groups"][group]
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(json.loads(own["schema"])).fields)
            name = f"millrace_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{own['key']}`) INTO {own['buckets']} BUCKETS LOCATION '{self.path}/data/{folder}'")
            self._names[folder] = name
        return self.spark.table(self._names[folder])

    def add(self, group: str, rows: DataFrame, key: str, order: tuple[str, ...] = (), dealt: bool = False, buckets: int | None = None, **figures) -> DataFrame | None:
        """Writes a segment (dealt: its rows lie in their buckets already, as those of the group's tables do); its table, or None if there is no row."""
        own = self.state["groups"].get(group)
        if own is None:
            count = buckets or min(100_000, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
            own = self.state["groups"][group] = {"key": key, "buckets": count, "schema": rows.schema.json(), "segments": []}
        folder, name = uuid.uuid4().hex, f"millrace_{uuid.uuid4().hex}"
        rows = rows if dealt else rows.repartition(own["buckets"], key)
        writer = rows.write.bucketBy(own["buckets"], key).option("path", f"{self.path}/data/{folder}").option("compression", "zstd")
        (writer.sortBy(*order) if order else writer).saveAsTable(name)
        self._names[folder] = name
        n = self.spark.table(name).count()
        if not n:
            self._forget(folder, files=True)
            return None
        own["segments"].append({"folder": folder, "rows": n, **figures})
        return self.spark.table(name)

    def drop(self, group: str, folder: str) -> None:
        """Takes a segment out of the working copy. Its files stay for readers of earlier versions, until ``vacuum``."""
        own = self.state["groups"][group]
        own["segments"] = [s for s in own["segments"] if s["folder"] != folder]

    def commit(self, **meta) -> int:
        """Publishes the working copy; ``Conflict`` if another writer has committed since it was read."""
        self.state["meta"] |= meta
        self.state["version"] = self.log.commit(self.state, self.version)
        return self.version

    def vacuum(self) -> None:
        """Deletes the files of segments that the working copy hasn't, and all versions but the last."""
        listed = {s["folder"] for g in self.state["groups"] for s in self.segments(g)}
        for name in self.files.names(f"{self.path}/data"):
            if name not in listed:
                self._forget(name, files=True)
        for v in self.log.versions()[:-1]:
            self.files.delete(f"{self.log.folder}/{v:020d}.json")

    def close(self) -> None:
        """Takes the tables out of the session's catalog; the store stays."""
        for folder in list(self._names):
            self._forget(folder)

    def remove(self) -> None:
        """The store with all its files."""
        self.close()
        self.files.delete(self.path)

    def _forget(self, folder: str, files: bool = False) -> None:
        if folder in self._names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._names.pop(folder)}")
        if files:
            self.files.delete(f"{self.path}/data/{folder}")


def union(tables: list[DataFrame]) -> DataFrame:
    """Tables one after the other; not to be grouped or joined where these are bucketed (see ``SegmentStore.rows``)."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
