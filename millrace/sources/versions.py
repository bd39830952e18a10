"""Tables of immutable files under a log of manifests: each version is committed by one rename, read as a snapshot, and undone by reading an earlier one.

A table is a folder with ``data`` (Parquet folders that are written once and never changed) and ``log`` (a JSON manifest for each
version, which lists the folders that make it up). Changes write new folders first, then the manifest beside the log, and rename it to
the next version's name, which fails if that is taken. So a failure at any step leaves the last version as it was, with some files that no
manifest lists; ``vacuum`` removes these. Of two writers that start from one version the second gets ``Conflict``; appending can't conflict in what
it means and is tried again on the newer version.

Tables with a key are dealt into parts by the key's hash. Upserts and deletions by key rewrite only the parts that they touch, and lookups read only theirs.
Files are reached through Spark's file systems alone, so the folder may lie in any store that Spark writes to and that renames files without overwriting.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of a table with a key, unless its maker says otherwise; times that an append is tried.
PARTS, TRIES = 16, 20


class Conflict(RuntimeError):
    """Another writer has committed since the version that a change was made from."""


class Files:
    """Files of any store that Spark reaches."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.jvm, self.conf = spark, spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        own = self.jvm.org.apache.hadoop.fs.Path(path)
        return own, own.getFileSystem(self.conf)

    def names(self, folder: str) -> list[str]:
        path, fs = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def exists(self, path: str) -> bool:
        own, fs = self._at(path)
        return fs.exists(own)

    def delete(self, path: str) -> None:
        own, fs = self._at(path)
        fs.delete(own, True)

    def read(self, path: str) -> str:
        own, fs = self._at(path)
        stream = fs.open(own)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        own, fs = self._at(path)
        stream = fs.create(own, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def move(self, old: str, new: str) -> None:
        """Renames a file; one that has the new name already stays, and FileExistsError is raised."""
        (source, fs), (target, _) = self._at(old), self._at(new)
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), self.conf).rename(fs.makeQualified(source), fs.makeQualified(target), none)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise FileExistsError(new) from None
            raise


class Log:
    """Numbered manifests below a folder, of which each is written once."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.files, self.folder = Files(spark), folder

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names(self.folder) if n.endswith(".json") and not n.startswith("_")]

    def read(self, version: int | None = None) -> dict:
        """A version's manifest, by default the last one's; an empty version 0 stands before the first."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if version and version not in known:
            raise ValueError(f"no version {version} of {self.folder}; there are {known}")
        return json.loads(self.files.read(f"{self.folder}/{version:020d}.json")) if version else {"version": 0}

    def commit(self, manifest: dict, after: int) -> int:
        """Makes ``manifest`` the version behind ``after``, if that is the last one still."""
        side = f"{self.folder}/_{uuid.uuid4().hex}"
        self.files.write(side, json.dumps(manifest | {"version": after + 1, "time": time.time()}))
        try:
            self.files.move(side, f"{self.folder}/{after + 1:020d}.json")
        except FileExistsError:
            self.files.delete(side)
            raise Conflict(f"version {after + 1} of {self.folder} was committed by another writer") from None
        return after + 1


class VersionedTable:
    """A table at ``path``: appended to, replaced, upserted and deleted from, each as a new version."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.log, self.files = Log(spark, f"{self.path}/log"), Files(spark)

    @classmethod
    def create(cls, spark: SparkSession, path: str, rows: DataFrame, key: str | None = None, parts: int = PARTS, card: str = "") -> VersionedTable:
        """A new table of these rows; fails if there is one. ``card``: a text that describes it."""
        table = cls(spark, path)
        if table.version():
            raise FileExistsError(f"there is a table at {path}")
        part, taken = "_part", {c.lower() for c in rows.columns}
        while part in taken:
            part += "_"
        made = {"schema": rows.schema.json(), "key": key, "count": parts if key else 1, "part": part, "card": card, "folders": {}}
        if key:
            table._distinct(rows, key)
        table.log.commit(made | {"folders": table._written(rows, made), "operation": "create"}, 0)
        return table

    def version(self) -> int:
        return self.log.read()["version"]

    def history(self) -> list[tuple[int, str]]:
        """Versions with what made them."""
        return [(v, self.log.read(v)["operation"]) for v in self.log.versions()]

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.log.read(version))

    def card(self, version: int | None = None) -> str:
        return self.log.read(version).get("card", "")

    def lookup(self, keys: Sequence) -> DataFrame:
        """The rows of these keys, from their parts only."""
        now = self.log.read()
        if not now.get("key"):
            raise ValueError("the table has no key")
        asked = self._keys(keys, now)
        parts = {str(r[0]) for r in asked.select(self._part_of(now)).distinct().collect()}
        return self._rows(now, parts).join(F.broadcast(asked), F.col(now["key"]).eqNullSafe(F.col("_asked"))).drop("_asked")

    def append(self, rows: DataFrame) -> int:
        """Adds rows. With a key, only those of new keys may come (``upsert`` takes others)."""
        now = self._known()
        if now["key"]:
            self._distinct(rows, now["key"])
        new = self._written(rows, now)
        for _ in range(TRIES):
            if now["key"]:
                both = self._folders(new).select(now["key"]).join(self._rows(now, set(new)).select(F.col(now["key"]).alias("_old")), F.col(now["key"]).eqNullSafe(F.col("_old")))
                if not both.isEmpty():
                    raise ValueError("append would repeat a key")
            try:
                return self.log.commit(now | {"folders": _joined(now["folders"], new), "operation": "append"}, now["version"])
            except Conflict:
                now = self._known()
        raise Conflict(f"{TRIES} tries to append to {self.path} met other writers")

    def replace(self, rows: DataFrame, expected: int | None = None, card: str | None = None) -> int:
        """The table as these rows; their columns may be others."""
        now = self._known(expected)
        if now["key"]:
            self._distinct(rows, now["key"])
        after = now | {"schema": rows.schema.json(), "card": now["card"] if card is None else card}
        return self.log.commit(after | {"folders": self._written(rows, after), "operation": "replace"}, now["version"])

    def upsert(self, rows: DataFrame, expected: int | None = None) -> int:
        """Adds rows, each in place of the one that has its key (null is a key like others). Keys must be distinct among them."""
        now = self._known(expected)
        self._distinct(rows, now["key"])
        new = self._written(rows, now)
        fresh = self._folders(new).select(F.col(now["key"]).alias("_new"))
        rest = self._rows(now, set(new)).join(fresh, F.col(now["key"]).eqNullSafe(F.col("_new")), "left_anti")
        return self._rewritten(now, set(new), rest, new, "upsert")

    def delete(self, keys: Sequence | None = None, where: Column | None = None, expected: int | None = None) -> int:
        """Without the rows of these keys, or those that fulfil ``where``. Only parts with such a row are written anew; without any, no version comes."""
        now = self._known(expected)
        if (keys is None) == (where is None):
            raise ValueError("delete takes keys or a condition")
        if keys is not None:
            asked = self._keys(keys, now)
            touched = {str(r[0]) for r in asked.select(self._part_of(now)).distinct().collect()}
            rows = self._rows(now, touched)
            hit, same = rows.join(F.broadcast(asked), F.col(now["key"]).eqNullSafe(F.col("_asked")), "left_semi"), F.col(now["key"]).eqNullSafe(F.col("_asked"))
            rest = rows.join(F.broadcast(asked), same, "left_anti")
        else:
            rows = self._rows(now)
            hit, sure = rows.where(where), F.coalesce(where, F.lit(False))
            folders = {f: p for p, own in now["folders"].items() for f in own}
            found = [r[0] for r in hit.select(F.element_at(F.split(rows.metadataColumn("_metadata")["file_path"], "/data/"), -1).alias("f")).select(F.regexp_replace("f", "/[^/]*$", "")).distinct().collect()] if folders else []
            touched = {folders[unquote(f)] for f in found}
            rest = self._rows(now, touched).where(~sure)
        if not touched or hit.isEmpty():
            return now["version"]
        return self._rewritten(now, touched, rest, {}, "delete")

    def compact(self, most: int = 4, expected: int | None = None) -> int:
        """Parts of more than ``most`` folders in one folder each."""
        now = self._known(expected)
        many = {p for p, own in now["folders"].items() if len(own) > most}
        return self._rewritten(now, many, self._rows(now, many), {}, "compact") if many else now["version"]

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all versions but the last ``keep`` and what only they, or no manifest, list; how many folders went. No writer may be at work."""
        known = self.log.versions()
        for v in known[:-keep]:
            self.files.delete(f"{self.log.folder}/{v:020d}.json")
        for name in self.files.names(self.log.folder):
            if name.startswith("_"):
                self.files.delete(f"{self.log.folder}/{name}")
        listed = {f.split("/")[0] for v in known[-keep:] for own in self.log.read(v)["folders"].values() for f in own}
        gone = [n for n in self.files.names(f"{self.path}/data") if n not in listed]
        for name in gone:
            self.files.delete(f"{self.path}/data/{name}")
        return len(gone)

    # -- steps

    def _known(self, expected: int | None = None) -> dict:
        now = self.log.read()
        if not now["version"]:
            raise ValueError(f"no table at {self.path}")
        if expected is not None and expected != now["version"]:
            raise Conflict(f"version {now['version']} is the last, not {expected}")
        return now

    def _part_of(self, now: dict, column: str = "_asked") -> Column:
        return F.pmod(F.xxhash64(column), F.lit(now["count"])).cast("int")

    def _keys(self, keys: Sequence, now: dict) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(now["schema"]))[now["key"]].dataType
        return self.spark.createDataFrame([(k,) for k in set(keys)], T.StructType([T.StructField("_asked", kind)]))

    def _distinct(self, rows: DataFrame, key: str | None) -> None:
        if not key:
            raise ValueError("the table has no key")
        if not rows.groupBy(key).count().where("count > 1").isEmpty():
            raise ValueError("rows repeat a key, so which one holds isn't defined")

    def _written(self, rows: DataFrame, now: dict) -> dict[str, list[str]]:
        """Writes rows into new folders, one for each part; their names by part."""
        name = uuid.uuid4().hex
        schema = T.StructType.fromJson(json.loads(now["schema"]))
        rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])
        if not now["key"]:
            rows.write.parquet(f"{self.path}/data/{name}")
            return {"0": [name]}
        part = now["part"]
        rows.withColumn(part, self._part_of(now, now["key"])).repartition(F.col(part)).write.partitionBy(part).parquet(f"{self.path}/data/{name}")
        return {n.rpartition("=")[2]: [f"{name}/{n}"] for n in self.files.names(f"{self.path}/data/{name}") if n.startswith(f"{part}=")}

    def _rewritten(self, now: dict, touched: set[str], rest: DataFrame, new: dict, operation: str) -> int:
        kept = self._written(rest, now)
        folders = {p: own for p, own in now["folders"].items() if p not in touched}
        return self.log.commit(now | {"folders": _joined(_joined(folders, kept), new), "operation": operation}, now["version"])

    def _folders(self, folders: dict[str, list[str]], schema: T.StructType | None = None) -> DataFrame:
        paths = [f"{self.path}/data/{f}" for own in folders.values() for f in own]
        schema = schema or T.StructType.fromJson(json.loads(self.log.read()["schema"]))
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _rows(self, now: dict, parts: set[str] | None = None) -> DataFrame:
        if not now["version"]:
            raise ValueError(f"no table at {self.path}")
        return self._folders({p: own for p, own in now["folders"].items() if parts is None or p in parts}, T.StructType.fromJson(json.loads(now["schema"])))


def _joined(a: dict[str, list[str]], b: dict[str, list[str]]) -> dict[str, list[str]]:
    return {p: [*a.get(p, []), *b.get(p, [])] for p in {**a, **b}}

