"""Files of many kinds as elements and as Markdown. Files come as bytes and are parsed in Arrow batches, a file at a time."""

from __future__ import annotations

import csv
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

from millrace.sources.readers import _pages, _Visible

#: Kinds of the elements that tags make.
KINDS = {"h1": "Title", "h2": "Title", "h3": "Title", "h4": "Title", "h5": "Title", "h6": "Title", "li": "ListItem", "p": "NarrativeText", "td": "Table", "th": "Table", "pre": "CodeSnippet", "blockquote": "NarrativeText"}
_BREAKS = {"div", "section", "article", "body", "br", "ul", "ol", "table", "tr", "header", "footer", "main", "hr"}


class _Outline(HTMLParser):
    """Blocks of a page in order: (kind, level, text, Markdown); rows of tables are one block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, str, str]] = []
        self.kind, self.level, self.plain, self.marked = "", 0, [], []
        self.hidden, self.head, self.links, self.row, self.lists = 0, False, [], None, []

    def _close(self) -> None:
        plain, marked = (" ".join("".join(x).split()) for x in (self.plain, self.marked))
        if plain and self.row is not None:
            self.row.append((plain, marked))
        elif plain:
            self.blocks.append((self.kind or "UncategorizedText", self.level, plain, marked))
        self.kind, self.level, self.plain, self.marked = "", 0, [], []

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "head":
            self.head = True
        elif self.head and tag not in _Visible.IN_HEAD:
            self.head, self.hidden = False, 0
        if tag in _Visible.HIDDEN:
            self.hidden += 1
        elif tag == "tr":
            self._close()
            self.row = []
        elif tag in KINDS or tag in _BREAKS:
            self._close()
            self.kind, self.level = KINDS.get(tag, ""), int(tag[1]) if re.fullmatch("h[1-6]", tag) else 0
            if tag in ("ul", "ol"):
                self.lists.append([tag, 0])
            elif tag == "li" and self.lists:
                self.lists[-1][1] += 1
                self.level = self.lists[-1][1] if self.lists[-1][0] == "ol" else 0
        elif tag in ("b", "strong"):
            self.marked.append("**")
        elif tag in ("i", "em"):
            self.marked.append("*")
        elif tag == "code":
            self.marked.append("`")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.marked.append("[")
        elif tag == "img":
            own = dict(attrs)
            self.marked.append(f"![{own.get('alt') or ''}]({own.get('src') or ''})")

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            self.head, self.hidden = False, 0
        elif tag in _Visible.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "tr" and self.row is not None:
            self._close()
            row, self.row = self.row, None
            if row:
                self.blocks.append(("Table", 0, " ".join(p for p, _ in row), "| " + " | ".join(m for _, m in row) + " |"))
        elif tag in KINDS or tag in _BREAKS:
            self._close()
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
        elif tag in ("b", "strong"):
            self.marked.append("**")
        elif tag in ("i", "em"):
            self.marked.append("*")
        elif tag == "code":
            self.marked.append("`")
        elif tag == "a" and self.links:
            self.marked.append(f"]({self.links.pop()})")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.plain.append(data)
            self.marked.append(data)

    @classmethod
    def of(cls, html: str | None) -> list[tuple[str, int, str, str]]:
        parser = cls()
        parser.feed(html or "")
        parser.close()
        parser._close()
        return parser.blocks


def _block(kind: str, level: int, marked: str) -> str:
    if kind == "Title":
        return f"{'#' * max(1, level)} {marked}"
    if kind == "ListItem":
        return f"{level}. {marked}" if level else f"- {marked}"
    return f"```\n{marked}\n```" if kind == "CodeSnippet" else marked


def markdown_of_html(html: str | None) -> str:
    """Blocks parted by blank lines; items of one list and rows of one table stand in neighbouring lines, the first row as the header."""
    out: list[str] = []
    before = ""
    for kind, level, _, marked in _Outline.of(html):
        line = _block(kind, level, marked)
        if kind in ("ListItem", "Table") and kind == before:
            out[-1] += "\n" + line
        elif kind == "Table":
            out.append(line + "\n|" + " --- |" * (marked.count(" | ") + 1))
        else:
            out.append(line)
        before = kind
    return "\n\n".join(out)


def markdown_of_table(rows: list[list[str]]) -> str:
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join([c.replace("|", "\\|").replace("\n", " ") for c in r] + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def _docx_markdown(raw: bytes) -> str:
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    out = []
    for p in ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).iter(f"{space}p"):
        text, style = "".join(t.text or "" for t in p.iter(f"{space}t")).strip(), next((s.get(f"{space}val") or "" for s in p.iter(f"{space}pStyle")), "")
        heading = re.fullmatch(r"Heading\s?([1-6])", style)
        if text:
            out.append(f"{'#' * int(heading[1])} {text}" if heading else f"- {text}" if style.startswith("List") else text)
    return "\n\n".join(out)


def _pptx_markdown(raw: bytes) -> str:
    a = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
    book = zipfile.ZipFile(io.BytesIO(raw))
    slides = sorted((n for n in book.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    each = [["".join(t.text or "" for t in p.iter(f"{a}t")).strip() for p in ElementTree.fromstring(book.read(n)).iter(f"{a}p")] for n in slides]
    return "\n\n".join(f"## Slide {i}\n\n" + "\n\n".join(x for x in lines if x) for i, lines in enumerate(each, 1))


def _xlsx_markdown(raw: bytes) -> str:
    sheets = pd.read_excel(io.BytesIO(raw), sheet_name=None, header=None, dtype=str)
    return "\n\n".join(f"## {name}\n\n" + markdown_of_table(frame.fillna("").values.tolist()) for name, frame in sheets.items())


def _epub_markdown(raw: bytes) -> str:
    book = zipfile.ZipFile(io.BytesIO(raw))
    return "\n\n".join(markdown_of_html(book.read(n).decode("utf-8", "replace")) for n in book.namelist() if n.lower().endswith((".xhtml", ".html", ".htm")))


def _zip_markdown(raw: bytes) -> str:
    book, out = zipfile.ZipFile(io.BytesIO(raw)), []
    for n in book.namelist():
        if not n.endswith("/") and _suffix(n) in MARKDOWN:
            out.append(f"## File: {n}\n\n{markdown_of_file(n, book.read(n))}")
    return "\n\n".join(out)


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def _json_markdown(raw: bytes) -> str:
    return "```json\n" + json.dumps(json.loads(raw), indent=2, ensure_ascii=False) + "\n```"


def _notebook_markdown(raw: bytes) -> str:
    cells = json.loads(raw).get("cells", [])
    source = lambda c: "".join(c.get("source", []))
    return "\n\n".join(source(c) if c.get("cell_type") == "markdown" else f"```python\n{source(c)}\n```" for c in cells if source(c).strip())


#: Converters by suffix. Pictures and sound need a model, which is the caller's: add one here.
MARKDOWN = {
    "html": lambda r: markdown_of_html(_text(r)), "htm": lambda r: markdown_of_html(_text(r)), "xhtml": lambda r: markdown_of_html(_text(r)), "txt": _text, "md": _text, "rst": _text, "log": _text,
    "csv": lambda r: markdown_of_table(list(csv.reader(io.StringIO(_text(r))))), "tsv": lambda r: markdown_of_table(list(csv.reader(io.StringIO(_text(r)), delimiter="\t"))),
    "json": _json_markdown, "jsonl": lambda r: "```json\n" + _text(r).strip() + "\n```", "xml": lambda r: "```xml\n" + _text(r).strip() + "\n```", "ipynb": _notebook_markdown,
    "docx": _docx_markdown, "pptx": _pptx_markdown, "xlsx": _xlsx_markdown, "epub": _epub_markdown, "zip": _zip_markdown, "pdf": lambda r: "\n\n".join(_pages(r, "x.pdf")),
}


def _suffix(name: str) -> str:
    return name.rpartition(".")[2].lower()


def markdown_of_file(name: str, raw: bytes) -> str:
    if _suffix(name) not in MARKDOWN:
        raise ValueError(f"unsupported file type: {name}; known: {sorted(MARKDOWN)}")
    return MARKDOWN[_suffix(name)](raw)


def markdown_files(spark: SparkSession, path: str, skip_failed: bool = False) -> DataFrame:
    """``path``, ``markdown``, ``error`` of each file; a file that can't be converted raises, or with ``skip_failed`` has an error instead."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                try:
                    out.append((name, markdown_of_file(name, bytes(raw)), None))
                except Exception as e:
                    if not skip_failed:
                        raise
                    out.append((name, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "markdown", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, markdown string, error string")


def html_markdown(html: Column) -> Column:
    @F.pandas_udf("string")
    def of(values: pd.Series) -> pd.Series:
        return values.map(markdown_of_html)

    return of(html)


def _kinds(text: str) -> list[tuple[str, str]]:
    """Elements of plain text: paragraphs between blank lines, list lines, short lines without a full stop as titles."""
    out = []
    for block in re.split(r"\n\s*\n", text):
        lines = [x.strip() for x in block.splitlines() if x.strip()]
        bullets = [re.match(r"(?:[-*\u2022]|\d{1,3}[.)])\s+(.*)", x) for x in lines]
        if lines and all(bullets):
            out += [("ListItem", b[1]) for b in bullets]
        elif lines:
            joint = " ".join(lines)
            title = len(lines) == 1 and len(joint) < 80 and joint[:1].isupper() and joint[-1] not in ".:;,!?"
            out.append(("Title" if title else "NarrativeText", joint))
    return out


def elements_of(rows: DataFrame, column: str, html: bool = True) -> DataFrame:
    """The other columns of ``rows``, ``position`` (from 0), ``kind``, ``text``, ``element_id`` (SHA-256 of kind and text) of the elements of a text or HTML column; null has none."""

    def each(values: pd.Series) -> pd.Series:
        return pd.Series([[] if v is None else [{"kind": k, "text": t} for k, t in ([(b[0], b[2]) for b in _Outline.of(v)] if html else _kinds(v))] for v in values], index=values.index, dtype=object)

    each.__annotations__ = {"values": pd.Series, "return": pd.Series}
    found = F.pandas_udf(each, "array<struct<kind:string,text:string>>")(F.col(column))
    others = [c for c in rows.columns if c != column]
    return rows.select(*others, F.posexplode(found).alias("position", "e")).select(*others, "position", "e.kind", "e.text", F.sha2(F.concat_ws("\0", "e.kind", "e.text"), 256).alias("element_id"))


def elements_from_files(spark: SparkSession, path: str) -> DataFrame:
    """``path`` and the elements of HTML and text files; files of other kinds go by way of their Markdown."""
    files = spark.read.format("binaryFile").load(path)
    page = F.lower("path").rlike(r"\.x?html?$")
    html = files.where(page).select("path", F.decode("content", "UTF-8").alias("body"))
    other = markdown_files(spark, path).where(~page).select("path", F.col("markdown").alias("body"))
    return elements_of(html, "body").union(elements_of(other, "body", html=False))
