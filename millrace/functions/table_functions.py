"""Table functions for SQL: chunkers and parsers that make several rows of one, called with LATERAL.

``register(spark)`` makes them known to SQL:

    SELECT d.doc_id, c.* FROM documents d, LATERAL chunks(d.text, 'chars', 500) c
    SELECT d.doc_id, c.* FROM documents d, LATERAL matches(d.text, '(?<name>[a-z]+)=(?<value>[0-9]+)') c

Their columns depend on the call: ``analyze`` looks at the constant arguments when the query is planned, so ``chunks`` has the columns of the chosen kind
(``chars``: ``n``, ``start``, ``chunk``; ``tokens``, ``titles``: ``n``, ``chunk``; ``windows``: ``n``, ``first_word``, ``chunk``) and ``matches`` one for each named group. Wrong
arguments fail there, before any row is read. Rows pass in Arrow batches. A null or empty text has no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from millrace.functions.parsing import char_chunks, title_chunks, token_chunks

#: Columns beside ``n`` and ``chunk`` of each kind of chunks.
KINDS = {"chars": [("start", T.LongType())], "tokens": [], "titles": [], "windows": [("first_word", T.LongType())]}


def _constant(argument: AnalyzeArgument, what: str, kind: type) -> object:
    if not argument.isConstantExpression or not isinstance(argument.value, kind):
        raise ValueError(f"{what} must be a constant {kind.__name__}")
    return argument.value


class Chunks:
    """``chunks(text, kind, size[, overlap])``; ``overlap`` is for windows: words that one shares with the next."""

    @staticmethod
    def analyze(text: AnalyzeArgument, kind: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        name, n = _constant(kind, "kind", str), _constant(size, "size", int)
        if name not in KINDS:
            raise ValueError(f"unknown kind {name!r}; there are {sorted(KINDS)}")
        step = _constant(overlap, "overlap", int) if overlap is not None else 0
        if n < 1 or not 0 <= step < n or (overlap is not None and name != "windows"):
            raise ValueError("size must be 1 or more, overlap from 0 to below size, and for windows only")
        return AnalyzeResult(T.StructType([T.StructField("n", T.LongType()), *[T.StructField(f, t) for f, t in KINDS[name]], T.StructField("chunk", T.StringType())]))

    def eval(self, text: str, kind: str, size: int, overlap: int = 0) -> Iterator[tuple]:
        if not text:
            return
        if kind == "chars":
            at = 0
            for i, c in enumerate(char_chunks(text, size)):
                yield i, at, c
                at += len(c)
        elif kind == "tokens":
            yield from enumerate(token_chunks(text, size))
        elif kind == "titles":
            yield from enumerate(title_chunks([p.strip() for p in re.split(r"\n\s*\n|\n", text) if p.strip()], size))
        else:
            words = text.split()
            for i, at in enumerate(range(0, max(1, len(words) - overlap), size - overlap) if words else ()):
                yield i, at, " ".join(words[at : at + size])


class Matches:
    """``matches(text, pattern)``: a row for each match, with ``n``, ``start`` and a column for each named group."""

    @staticmethod
    def _compiled(pattern: str) -> re.Pattern:
        return re.compile(re.sub(r"\(\?<(?=[A-Za-z_])", "(?P<", pattern))

    @staticmethod
    def analyze(text: AnalyzeArgument, pattern: AnalyzeArgument) -> AnalyzeResult:
        names = sorted((found := Matches._compiled(_constant(pattern, "pattern", str))).groupindex, key=found.groupindex.get)
        if not names:
            raise ValueError("the pattern names no group")
        return AnalyzeResult(T.StructType([T.StructField("n", T.LongType()), T.StructField("start", T.LongType()), *[T.StructField(x, T.StringType()) for x in names]]))

    def eval(self, text: str, pattern: str) -> Iterator[tuple]:
        found = Matches._compiled(pattern)
        names = sorted(found.groupindex, key=found.groupindex.get)
        for i, m in enumerate(found.finditer(text or "")):
            yield (i, m.start(), *[m[x] for x in names])


def register(spark: SparkSession) -> None:
    spark.udtf.register("chunks", F.udtf(Chunks, useArrow=True))
    spark.udtf.register("matches", F.udtf(Matches, useArrow=True))
