"""Data sources for Spark that read as tables and as streams: folders of JSON lines that grow, and of zip archives of chats.

``register(spark)`` makes ``spark.read.format(...)`` and ``spark.readStream.format(...)`` know them:

* ``growing_lines``: option ``path``, a folder of text files to whose ends lines are appended. Rows (``file``, ``at``: the line's first byte, ``line``). A stream's offset is the
  number of bytes read of each file, up to the last whole line, so a line that is being written is read once it has its end. Ranges of
  PART bytes are read by tasks of their own; a line belongs to the range that it begins in.
* ``zipped_files``: option ``path``, a folder of zip archives (or one). Rows (``archive``, ``member``, ``content``). A task reads MEMBERS members. Archives come whole
  and in ascending order of name (as dated dumps do): a stream's offset is the last name.

Both keep what they know in the offsets alone, so a stream that is started again from its checkpoint gives every row once. Paths may be
local, where driver and executors share the folder, or of any store that Arrow knows (``s3://``, ``gs://``, ``hdfs://``).
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow.fs as pfs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of a file, and members of an archive, that one task reads; bytes read at once in search of the last line's end.
PART, MEMBERS, TAIL = 16 << 20, 500, 1 << 16


def _store(path: str) -> tuple[pfs.FileSystem, str]:
    path = path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")
    return (pfs.LocalFileSystem(), path) if "://" not in path else pfs.FileSystem.from_uri(path)


def _listed(path: str, suffix: str = "") -> list[pfs.FileInfo]:
    """The files of a folder by name, or the one file."""
    fs, own = _store(path)
    info = fs.get_file_info(own)
    if info.type == pfs.FileType.File:
        return [info]
    if info.type == pfs.FileType.NotFound:
        return []
    found = fs.get_file_info(pfs.FileSelector(own))
    return sorted((f for f in found if f.type == pfs.FileType.File and f.base_name.endswith(suffix) and f.base_name[0] not in "._"), key=lambda f: f.base_name)


class _Range(InputPartition):
    def __init__(self, file: str, start: int, end: int, most: int) -> None:
        self.file, self.start, self.end, self.most = file, start, end, most


class _Members(InputPartition):
    def __init__(self, archive: str, start: int, end: int) -> None:
        self.archive, self.start, self.end = archive, start, end


class _Lines:
    """What reading and streaming of lines share."""

    def __init__(self, options: dict) -> None:
        self.path, self.suffix, self.part = options["path"], options.get("suffix", ""), int(options.get("part", PART))

    def _ends(self) -> dict[str, int]:
        """Of each file, the bytes up to the end of its last whole line."""
        fs, _ = _store(self.path)
        out = {}
        for info in _listed(self.path, self.suffix):
            end = info.size
            with fs.open_input_file(info.path) as f:
                while end:
                    start = max(0, end - TAIL)
                    f.seek(start)
                    at = f.read(end - start).rfind(b"\n")
                    if at >= 0:
                        end = start + at + 1
                        break
                    end = start
            out[info.base_name] = end
        return out

    def _ranges(self, start: dict[str, int], end: dict[str, int]) -> list[_Range]:
        return [_Range(f, a, min(a + self.part, n), n) for f, n in sorted(end.items()) for a in range(start.get(f, 0), n, self.part)]

    def read(self, part: _Range) -> Iterator[tuple]:
        fs, own = _store(self.path)
        file = own if own.rstrip("/").rpartition("/")[2] == part.file else f"{own.rstrip('/')}/{part.file}"
        with fs.open_input_file(file) as f:
            at = part.start
            if at:  # the line that goes on here belongs to the range before
                f.seek(at - 1)
                lead = _until_end(f, at - 1, part.most)
                at = at - 1 + len(lead)
            f.seek(at)
            rest = b""
            while at < part.end:
                data = rest + f.read(min(1 << 20, part.most - at - len(rest)))
                whole, found, _ = data.rpartition(b"\n")
                if not found:
                    if len(data) == len(rest):
                        break
                    rest = data
                    continue
                for line in whole.split(b"\n"):
                    if at >= part.end:
                        return
                    yield part.file, at, line.removesuffix(b"\r").decode("utf-8", "replace")
                    at += len(line) + 1
                rest = data[len(whole) + 1 :]


def _until_end(f, at: int, most: int) -> bytes:
    """Bytes from ``at`` to the end of that line."""
    out = b""
    while at + len(out) < most:
        part = f.read(min(TAIL, most - at - len(out)))
        cut = part.find(b"\n")
        if cut >= 0:
            return out + part[: cut + 1]
        out += part
    return out


class _LinesReader(_Lines, DataSourceReader):
    def partitions(self) -> list[_Range]:
        return self._ranges({}, self._ends())


class _LinesStream(_Lines, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        return {"files": self._ends()}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        return self._ranges(start["files"], end["files"])

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "file string, at long, line string"

    def reader(self, schema) -> DataSourceReader:
        return _LinesReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _LinesStream(self.options)


class _Zips:
    def __init__(self, options: dict) -> None:
        self.path, self.members = options["path"], int(options.get("members", MEMBERS))

    def _parts(self, archives: list[pfs.FileInfo]) -> list[_Members]:
        fs, _ = _store(self.path)
        out = []
        for info in archives:
            with fs.open_input_file(info.path) as f, zipfile.ZipFile(f) as z:
                n = sum(not m.is_dir() for m in z.infolist())
            out += [_Members(info.path, a, min(n, a + self.members)) for a in range(0, n, self.members)]
        return out

    def read(self, part: _Members) -> Iterator[tuple]:
        fs, _ = _store(self.path)
        with fs.open_input_file(part.archive) as f, zipfile.ZipFile(f) as z:
            for m in [m for m in z.infolist() if not m.is_dir()][part.start : part.end]:
                with z.open(m) as own:
                    yield part.archive.rpartition("/")[2], m.filename, io.TextIOWrapper(own, "utf-8", errors="replace").read()


class _ZipsReader(_Zips, DataSourceReader):
    def partitions(self) -> list[_Members]:
        return self._parts(_listed(self.path, ".zip"))


class _ZipsStream(_Zips, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        return {"last": max((f.base_name for f in _listed(self.path, ".zip")), default="")}

    def partitions(self, start: dict, end: dict) -> list[_Members]:
        return self._parts([f for f in _listed(self.path, ".zip") if start["last"] < f.base_name <= end["last"]])

    def commit(self, end: dict) -> None:
        pass


class ZippedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zipped_files"

    def schema(self) -> str:
        return "archive string, member string, content string"

    def reader(self, schema) -> DataSourceReader:
        return _ZipsReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _ZipsStream(self.options)


def register(spark: SparkSession) -> None:
    for source in (GrowingLines, ZippedFiles):
        spark.dataSource.register(source)


def parsed_chats(rows: DataFrame, content: str = "content") -> DataFrame:
    """Chats from their JSON: ``assistant_role``, ``user_role``, ``original_task``, ``specified_task``, ``messages`` (number to text), beside the other columns; what isn't a chat is left out.

    A chat has both roles (a name before its mark), and neither task is empty. Its messages are the fields named ``message_`` and a number.
    """
    own: Column = F.from_json(F.col(content), "map<string,string>")
    rows = rows.select(*[c for c in rows.columns if c != content], own.alias("_own"))
    role = lambda field, mark: F.when(F.col("_own")[field].contains(mark), F.split(F.col("_own")[field], mark)[0])
    number = lambda k: F.regexp_extract(k, "message_([0-9]+)", 1)
    said = F.map_filter("_own", lambda k, _: number(k) != "")
    messages = F.map_from_entries(F.transform(F.map_entries(said), lambda e: F.struct(number(e["key"]).cast("int").alias("k"), e["value"].alias("v"))))
    found = rows.select(
        *[c for c in rows.columns if c != "_own"], role("role_1", "_RoleType.ASSISTANT").alias("assistant_role"), role("role_2", "_RoleType.USER").alias("user_role"),
        F.col("_own")["original_task"].alias("original_task"), F.col("_own")["specified_task"].alias("specified_task"), messages.alias("messages"),
    )
    return found.where("length(assistant_role) > 0 AND length(user_role) > 0 AND length(original_task) > 0 AND length(specified_task) > 0")


def parsed_lines(rows: DataFrame, schema: str, line: str = "line") -> DataFrame:
    """The fields of JSON lines; blank lines are left out, and lines that aren't JSON have ``malformed`` set and no fields."""
    own = F.from_json(F.col(line), f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = rows.where(F.trim(F.col(line)) != "").withColumn("_own", own)
    fields = [f for f in rows.schema["_own"].dataType.names if f != "_bad"]
    return rows.select(*[c for c in rows.columns if c not in (line, "_own")], *[F.col(f"_own.{f}").alias(f) for f in fields], F.col("_own._bad").isNotNull().alias("malformed"))

