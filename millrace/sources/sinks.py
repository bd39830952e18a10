"""Sinks, record hubs, key-value and object stores; all are tables or files at a path that Spark can write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.versions import Files, VersionedTable


def clean_numbers(df: DataFrame) -> DataFrame:
    """NaN and infinities of double and float columns as null."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return df.select(*[F.when(~bad(F.col(f.name)), F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType | T.FloatType) else F.col(f.name) for f in df.schema.fields])


def save_json(df: DataFrame, path: str) -> None:
    """JSON lines in one file of a folder. A reader may meet the folder while it is replaced; ``save_results`` has no such moment."""
    clean_numbers(df).coalesce(1).write.mode("overwrite").json(path)


def save_results(df: DataFrame, path: str, key: str | None = None) -> int:
    """Results as a versioned table at ``path``, NaN and infinities as null: made if there is none, else those with the same key replaced and others added (without a key, all replaced). Readers see
    the version before or after, whatever fails in between. The new version."""
    table = VersionedTable(df.sparkSession, path)
    if not table.version():
        VersionedTable.create(df.sparkSession, path, clean_numbers(df), key)
        return 1
    return table.upsert(clean_numbers(df)) if key else table.replace(clean_numbers(df))


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


WRITERS = {"csv": lambda w, p: w.option("header", True).csv(p), "json": lambda w, p: w.json(p), "parquet": lambda w, p: w.parquet(p), "orc": lambda w, p: w.orc(p), "txt": lambda w, p: w.text(p), "md": lambda w, p: w.text(p)}


def save(df: DataFrame, path: str, kind: str, mode: str = "errorifexists") -> None:
    """Writes by kind; text kinds need one string column."""
    if kind not in WRITERS:
        raise ValueError(f"unsupported kind {kind!r}; known: {sorted(WRITERS)}")
    WRITERS[kind](df.write.mode(mode), path)


def replaced(text: Column, old: str, new: str) -> Column:
    """Exact replacement of a passage; a text without it raises."""
    return F.when(text.contains(old), F.replace(text, F.lit(old), F.lit(new))).otherwise(F.raise_error(F.lit("the passage isn't in the text")).cast("string"))


def markdown_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """``line``: rows as lines of a Markdown table (the header is the caller's)."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


class Hub:
    """Named datasets of records below a folder, each a versioned table: add, update, delete, list, with a card and a history."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def dataset(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self.dataset(name).version() > 0

    def names(self) -> list[str]:
        return [n for n in self.files.names(self.root) if n[0] not in "._" and self.exists(n)]

    def drop(self, name: str) -> None:
        self.files.delete(f"{self.root}/{name}")

    def add(self, name: str, records: DataFrame, id_col: str = "id", card: str = "") -> None:
        """Fails if the dataset is there. Records with an ``id_col``, which must be distinct, can be updated by it."""
        VersionedTable.create(self.spark, f"{self.root}/{name}", records, id_col if id_col in records.columns else None, card=card)

    def records(self, name: str, version: int | None = None) -> DataFrame:
        return self.dataset(name).read(version)

    def card(self, name: str) -> str:
        return self.dataset(name).card()

    def update(self, name: str, records: DataFrame, expected: int | None = None) -> int:
        """Upserts by the dataset's id, the new record winning; the new version. Fails if there is no such dataset, or if ``expected`` isn't its last version."""
        return self.dataset(name).upsert(records, expected)

    def delete(self, name: str, record_id, expected: int | None = None) -> int:
        return self.dataset(name).delete([record_id], expected=expected)


class KeyValueLog:
    """An append-only store of records as JSON lines: save, load, clear."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    def save(self, rows: DataFrame) -> None:
        rows.write.mode("append").json(self.path)

    def load(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).json(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema)

    def clear(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class MemoryStore:
    """The same in the session's memory."""

    def __init__(self) -> None:
        self.rows: DataFrame | None = None

    def save(self, rows: DataFrame) -> None:
        self.rows = rows if self.rows is None else self.rows.unionByName(rows)

    def load(self) -> DataFrame | None:
        return self.rows

    def clear(self) -> None:
        self.rows = None


class ObjectStore:
    """exists, put, get, upload, download below any root that Hadoop's file systems reach (file, hdfs, s3a, abfss, gs)."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        path, fs = self._at(name)
        return fs.exists(path)

    def put(self, name: str, raw: bytes) -> None:
        path, fs = self._at(name)
        out = fs.create(path, True)
        out.write(bytearray(raw))
        out.close()

    def get(self, name: str) -> bytes:
        if not self.exists(name):
            raise FileNotFoundError(name)
        return bytes(self.spark.read.format("binaryFile").load(f"{self.root}/{name}").select("content").first().content)

    def upload(self, local: str, name: str) -> None:
        path, fs = self._at(name)
        fs.copyFromLocalFile(False, True, self.spark._jvm.org.apache.hadoop.fs.Path(local), path)

    def download(self, name: str, local: str) -> None:
        path, fs = self._at(name)
        fs.copyToLocalFile(False, path, self.spark._jvm.org.apache.hadoop.fs.Path(local), True)


class Connector:
    """An outside service behind the caller's function: ``fetch(list of keys) -> list of values``, called once for each batch of rows."""

    def __init__(self, name: str, fetch=None) -> None:
        self.name, self.fetch = name, fetch

    def read(self, keys: DataFrame, key: str, result: str = "string") -> DataFrame:
        if self.fetch is None:
            raise NotImplementedError(f"{self.name} needs a function that calls the service")
        fetch = self.fetch

        def call(values):
            import pandas as pd

            return pd.Series(fetch(values.tolist()))

        from pyspark.sql.functions import pandas_udf

        return keys.withColumn("result", pandas_udf(call, result)(F.col(key)))


#: Services that have this form only: key-value, object and web services.
SERVICES = ["redis", "mem0", "s3", "azure_blob", "gcs", "apify", "chunkr", "crawl", "firecrawl", "jina_reader", "mineru", "ocr", "scrape_graph", "partition", "markdown"]


def crawl(seeds: DataFrame, links, depth: int = 2, url: str = "url") -> DataFrame:
    """Breadth-first from seeds with ``links(DataFrame of url) -> DataFrame of (url, link)``; ``url``, ``depth``, each once."""
    from millrace.operators.dedup import _cut

    seen = _cut(seeds.select(url).distinct().withColumn("depth", F.lit(0)))
    front = seen
    for step in range(1, depth + 1):
        next_ = links(front.select(url)).select(F.col("link").alias(url)).distinct().join(seen, url, "left_anti").withColumn("depth", F.lit(step))
        front = _cut(next_)
        if front.isEmpty():
            break
        seen = _cut(seen.union(front))
    return seen


#: How elements (``text``, ``element_id``, ``metadata`` as JSON) are laid out for labelling tools.
STAGES = {
    "csv": lambda e: e.select("element_id", "text", "metadata"),
    "dict": lambda e: e.select(F.to_json(F.struct("element_id", "text", "metadata")).alias("value")),
    "label_studio": lambda e: e.select(F.to_json(F.struct(F.struct(F.col("text"), F.col("element_id").alias("ref_id")).alias("data"))).alias("value")),
    "prodigy": lambda e: e.select(F.to_json(F.struct("text", F.struct(F.col("element_id").alias("id")).alias("meta"))).alias("value")),
    "datasaur": lambda e: e.select(F.to_json(F.struct("text")).alias("value")),
    "dataframe": lambda e: e.select("element_id", "text", "metadata"),
    "elements": lambda e: e.select(*[F.get_json_object("value", f"$.{c}").alias(c) for c in ("element_id", "text", "metadata")]),
    "csv_for_prodigy": lambda e: e.select("text", F.col("element_id").alias("id"), F.json_tuple("metadata", *_metadata_keys(e)).alias(*_metadata_keys(e))) if _metadata_keys(e) else e.select("text", F.col("element_id").alias("id")),
    "baseplate": lambda e: e.select(_json(data=("{\"text\":%s,\"element_id\":%s}", F.col("text"), F.col("element_id")), metadata=("%s", "metadata")).alias("value")),
    "label_box": lambda e: e.select(_json(rowData=("%s", F.col("text")), externalId=("%s", F.col("element_id")), attachments=("%s", "metadata")).alias("value")),
    "weaviate": lambda e: e.select(F.concat(F.substr("metadata", F.lit(1), F.length("metadata") - 1), F.when(F.length("metadata") > 2, F.lit(",")).otherwise(F.lit("")), F.lit('"text":'), _quoted(F.col("text")), F.lit(',"element_id":'), _quoted(F.col("element_id")), F.lit("}")).alias("value")),
}


def _metadata_keys(elements: DataFrame) -> list[str]:
    """The names that occur in the elements' metadata (a few: they become columns)."""
    return [r[0] for r in elements.select(F.explode(F.json_object_keys("metadata")).alias("k")).distinct().orderBy("k").collect()]


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("x")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def _json(**fields) -> Column:
    """A JSON object of fields, each a pattern whose places are filled by texts (quoted) or by columns that hold JSON (named)."""
    parts = []
    for i, (name, (pattern, *values)) in enumerate(fields.items()):
        filled = F.format_string(pattern, *[_quoted(v) if isinstance(v, Column) else F.coalesce(F.col(v), F.lit("{}")) for v in values])
        parts += [F.lit(f'{"," if i else ""}"{name}":'), filled]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def staged(elements: DataFrame, kind: str) -> DataFrame:
    if kind not in STAGES:
        raise ValueError(f"unsupported stage {kind!r}; known: {sorted(STAGES)}")
    return STAGES[kind](elements)
