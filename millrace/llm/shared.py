"""What the operators share: the folder all executors see, written tables, checked joins.

Every intermediate result that is read more than once is written as Parquet below
``spark.checkpoint.dir``. A lost executor then costs only the tasks it was running.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes (estimated from a count of rows) up to which one side of a join is sent to every executor.
BROADCAST_BYTES = 32 << 20

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in local mode without that setting, one temporary folder for the process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    return _own.setdefault("", "file://" + tempfile.mkdtemp(prefix="millrace-"))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/millrace/{name}-{uuid.uuid4().hex}"


#: Rows of a small table that one file takes, where a bound of their number is known.
ROWS_A_FILE = 100_000


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df``, written once to the shared folder and read back: its lineage ends there. ``rows``: a bound of its rows, from which follows how many files are enough."""
    path = new_path(df.sparkSession, name)
    (df if rows is None else df.coalesce(rows // ROWS_A_FILE + 1)).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, df: DataFrame) -> None:
    """Removes the files of a table that ``written`` made and nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/millrace/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files of finished jobs go when the driver has collected what refers to them, which a driver with memory left would put off to the end."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def may_broadcast(table: DataFrame, bytes_a_row: int, more: Column | None = None) -> bool:
    """Whether the whole (written) table is within ``BROADCAST_BYTES``: its rows are counted, and ``more`` bytes of each added up."""
    rows, rest = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.lit(0) if more is None else more), F.lit(0))).first()
    return rows * bytes_a_row + rest <= BROADCAST_BYTES


def joined(left: DataFrame, right: DataFrame, on: list[str] | str, how: str, bytes_a_row: int, more: Column | None = None) -> DataFrame:
    """Join in which a right side of proven small size is broadcast; a larger one is shuffled.

    In the shuffled form both sides get their exchange from the join itself, so adaptive execution can
    split a key that holds many rows of ``left``.
    """
    return left.join(F.broadcast(right) if may_broadcast(right, bytes_a_row, more) else right, on, how)


def free(docs: DataFrame, *names: str) -> list[str]:
    """Names for columns beside those of ``docs``: as given, or with underscores behind until none of ``docs`` is called so."""
    taken, found = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with two columns that tell its rows apart, a hash of the file's path and the row's place in it, the same each time it is read; and their names, which none of its own columns has.

    What isn't read from Parquet files as it stands is written first.
    """
    row = free(docs, "_row_file", "_row_at")
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or "parquet" not in plan.toString().lower():
        docs = written(docs, "keyed")
    place = docs.metadataColumn("_metadata")  # also where a column of the table has that name
    return docs.select(F.xxhash64(place["file_path"]).alias(row[0]), place["row_index"].alias(row[1]), "*"), row


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
