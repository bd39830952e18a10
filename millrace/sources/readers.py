"""Sources: one loader by suffix, datasets, documents from files.

What Spark reads itself it reads itself; other formats come as binary files and are parsed in Arrow batches. Pickle files are
refused, since loading one runs its code.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.filters import trimmed
from millrace.functions.text import newlines_stripped


def _with_pandas(kind: str):
    def load(spark: SparkSession, path: str, **options) -> DataFrame:
        read = getattr(pd, f"read_{kind}")
        files = spark.read.format("binaryFile").load(path)

        def shape(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import pyarrow as pa
            from pyspark.sql.pandas.types import from_arrow_schema

            for batch in batches:
                for content in batch["content"]:
                    own = pa.Schema.from_pandas(read(io.BytesIO(content), **options), preserve_index=False)
                    yield pd.DataFrame({"schema": [from_arrow_schema(own).json()]})

        # the first file by name is parsed in a task; the driver gets its schema only
        first = files.agg(F.min("path")).first()[0]
        if first is None:
            raise FileNotFoundError(path)
        found = files.where(F.col("path") == first).select("content").mapInPandas(shape, "schema string").first()[0]
        schema = T.StructType.fromJson(json.loads(found))

        def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for content in batch["content"]:
                    yield read(io.BytesIO(content), **options)[schema.names]

        return files.select("content").mapInPandas(parse, schema)

    return load


def _refused(spark: SparkSession, path: str, **_):
    raise ValueError("pickle files are not loaded: reading one runs its code")


def read_html_tables(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``table_num``, ``row_num``, ``cells`` of every table in HTML files."""
    pages = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))
    return html_tables(pages, "path", "html")


LOADERS = {
    ".csv": lambda s, p, **o: s.read.options(**{"header": True, "inferSchema": True, **o}).csv(p),
    ".json": lambda s, p, **o: s.read.options(**{"multiLine": True, **o}).json(p),
    ".jsonl": lambda s, p, **o: s.read.options(**o).json(p),
    ".parquet": lambda s, p, **o: s.read.options(**o).parquet(p),
    ".orc": lambda s, p, **o: s.read.options(**o).orc(p),
    ".tsv": lambda s, p, **o: s.read.options(**{"header": True, "inferSchema": True, "sep": "\t", **o}).csv(p),
    ".txt": lambda s, p, **o: s.read.options(**o).text(p, wholetext=True),
    ".html": lambda s, p, **o: read_html_tables(s, p),
    ".feather": _with_pandas("feather"),
    ".dta": _with_pandas("stata"),
    ".sas7bdat": _with_pandas("sas"),
    ".xls": _with_pandas("excel"),
    ".xlsx": _with_pandas("excel"),
    ".h5": _with_pandas("hdf"),
    ".hdf": _with_pandas("hdf"),
    ".pkl": _refused,
}


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """Loads a file or folder by its suffix."""
    suffix = re.search(r"(\.[A-Za-z0-9]+)/*$", path)
    if suffix is None or suffix[1].lower() not in LOADERS:
        raise ValueError(f"unsupported file format: {path}; known: {sorted(LOADERS)}")
    return LOADERS[suffix[1].lower()](spark, path, **options)


def from_clipboard(spark: SparkSession, text: str, sep: str = r"\s+") -> DataFrame:
    """The table in a copied text, which the caller takes from the clipboard: a header line, columns parted by white space or ``sep``."""
    return spark.createDataFrame(pd.read_csv(io.StringIO(text), sep=sep, engine="python"))


def load_sql(spark: SparkSession, query: str, url: str | None = None, **options) -> DataFrame:
    """A query: over this session's views, or over JDBC if a URL is given."""
    return spark.sql(query) if url is None else spark.read.format("jdbc").options(url=url, query=query, **options).load()


def load_many(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """Several files of one format, with ``source_path``."""
    found = None
    for path in paths:
        own = load(spark, path, **options).withColumn("source_path", F.lit(path))
        found = own if found is None else found.unionByName(own, allowMissingColumns=True)
    return found


def dataset_from_json(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Data points from a JSON array."""
    return validated(spark.read.option("multiLine", True).schema("question string, final_answer string, rationale string, metadata map<string,string>").json(path), strict)


def dataset_from_jsonl(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Data points from JSON lines; blank lines are skipped, a line that doesn't parse raises."""
    lines = spark.read.text(path).where(trimmed(F.col("value")) != "")
    parsed = F.from_json("value", "question string, final_answer string, rationale string, metadata map<string,string>", {"mode": "FAILFAST"})
    return validated(lines.select(parsed.alias("p")).select("p.*"), strict)


def dataset_from_list(spark: SparkSession, rows: list[dict], strict: bool = False) -> DataFrame:
    """Data points from a list of dictionaries (or any sized, indexable dataset of them)."""
    every = [{k: rows[i].get(k) for k in ("question", "final_answer", "rationale", "metadata")} for i in range(len(rows))]
    return validated(spark.createDataFrame([(r["question"], r["final_answer"], r["rationale"], r["metadata"]) for r in every], "question string, final_answer string, rationale string, metadata map<string,string>"), strict)


def validated(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Rows with a question and a final answer; strict: others raise instead of being left out."""
    ok = F.col("question").isNotNull() & F.col("final_answer").isNotNull()
    return rows.where(F.when(ok, True).otherwise(F.raise_error(F.lit("a row lacks its question or final answer")).cast("boolean"))) if strict else rows.where(ok)


def seed_tasks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def qa_pairs(json_text: Column) -> Column:
    """(key, value) entries of a JSON object of questions and answers; explode it."""
    return F.map_entries(F.from_json(json_text, "map<string,string>"))


def role_names(spark: SparkSession, path: str) -> DataFrame:
    """A name a line, its ordinal taken off."""
    return spark.read.text(path).where(trimmed(F.col("value")) != "").select(F.regexp_replace("value", r"^\S+\s+", "").alias("role"))


def chat_matrix(chats: DataFrame) -> DataFrame:
    """Chats (``name`` "assistant_user…", ``message_1``…) to a map of user role to chat for each assistant role."""
    parts = chats.withColumns({"assistant": F.split_part("name", F.lit("_"), F.lit(1)), "user": F.split_part("name", F.lit("_"), F.lit(2))})
    ok = parts.where((F.col("assistant") != "") & (F.col("user") != ""))
    return ok.groupBy("assistant").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("user", "chat")))).alias("chats"))


def element(text: Column, **metadata: Column) -> Column:
    """A text with an id from its content and its metadata."""
    return F.struct(text.alias("text"), F.sha2(text, 256).alias("element_id"), F.struct(*[v.alias(k) for k, v in metadata.items()]).alias("metadata")) if metadata else F.struct(text.alias("text"), F.sha2(text, 256).alias("element_id"))


class _Visible(HTMLParser):
    """Visible text, and tables row by row."""

    HIDDEN = {"script", "style", "title", "noscript", "template"}
    #: What may stand in a head; any other tag, or text, ends one whose end tag is left out.
    IN_HEAD = HIDDEN | {"base", "link", "meta", "head", "html"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.hidden = 0
        self.head = False
        self.tables: list[list[list[str]]] = []
        self.open: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "head":
            self.head = True
        elif tag not in self.IN_HEAD and self.head:
            self.head, self.hidden = False, 0
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag == "table":
            self.open.append([])
        elif tag == "tr" and self.open:
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open:
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            self.head, self.hidden = False, 0
        elif tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "table" and self.open:
            self.tables.append(self.open.pop())
        elif tag in ("td", "th") and self.open and self.cell is not None:
            if not self.open[-1]:
                self.open[-1].append([])
            self.open[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        if self.cell is not None:
            self.cell.append(data)
        if data.strip():
            self.text.append(" ".join(data.split()))


def visible_text(html: str | None) -> str:
    parser = _Visible()
    parser.feed(html or "")
    parser.close()
    return "\n".join(parser.text)


@F.pandas_udf(T.StringType())
def html_text(html: pd.Series) -> pd.Series:
    """Visible text of HTML, a line for each run."""
    return html.map(visible_text)


def html_tables(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, html in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True):
                parser = _Visible()
                parser.feed(html or "")
                parser.close()
                out += [(key, i, j, row) for i, t in enumerate(parser.tables) for j, row in enumerate(t)]
            yield pd.DataFrame(out, columns=["key", "table_num", "row_num", "cells"])

    kind = dict(pages.dtypes)[id_col]
    return pages.select(id_col, html_col).mapInPandas(parse, f"key {kind}, table_num int, row_num int, cells array<string>").withColumnRenamed("key", id_col)


def docx_text(raw: bytes) -> str:
    """Paragraphs of a Word document."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    tree = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in tree.iter(f"{space}p"))


def _pages(raw: bytes, name: str) -> list[str]:
    suffix = name.rpartition(".")[2].lower()
    if suffix == "docx":
        return [docx_text(raw)]
    if suffix == "json":
        return [json.dumps(json.loads(raw))]
    if suffix in ("html", "htm"):
        return [visible_text(raw.decode("utf-8", "replace"))]
    if suffix == "txt":
        return [re.sub(r"\s*\n\s*", "\n", raw.decode("utf-8", "replace"))]
    if suffix == "pdf":
        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise ValueError("reading PDF needs the package pypdf") from e
        return [p.extract_text() for p in PdfReader(io.BytesIO(raw)).pages]
    raise ValueError(f"unsupported file type: {name}")


def documents_from_files(spark: SparkSession, path: str, skip_failed: bool = False) -> DataFrame:
    """``name``, ``file_id`` (MD5 of the bytes), ``page`` (from 1), ``page_content``, ``error``: docx, pdf, txt, json and html files."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, file_id, content in zip(batch["name"], batch["file_id"], batch["content"], strict=True):
                try:
                    out += [(name, file_id, i + 1, text, None) for i, text in enumerate(_pages(bytes(content), name))]
                except Exception as e:
                    if not skip_failed:
                        raise
                    out.append((name, file_id, None, None, str(e)))
            yield pd.DataFrame(out, columns=["name", "file_id", "page", "page_content", "error"]).astype({"page": "Int32"})

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.md5("content").alias("file_id"), "content")
    return files.mapInPandas(parse, "name string, file_id string, page int, page_content string, error string")


def plain_documents(spark: SparkSession, path: str) -> DataFrame:
    """Text files whole, blank lines collapsed, without Python."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), newlines_stripped(F.col("value")).alias("page_content"))
