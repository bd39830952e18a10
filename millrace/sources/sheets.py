"""Spreadsheets in long form: cells (sheet, row, col, value), rows and columns from 1, values as strings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.dedup import _cut


def column_number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = 26 * n + ord(c) - 64
    return n


def cell_address(reference: str) -> tuple[int, int]:
    """Row and column of "B7"."""
    m = re.fullmatch(r"([A-Za-z]+)(\d+)", reference)
    if m is None:
        raise ValueError(f"not a cell: {reference!r}")
    return int(m[2]), column_number(m[1])


def range_address(reference: str) -> tuple[int, int, int, int]:
    a, _, b = reference.partition(":")
    (r1, c1), (r2, c2) = cell_address(a), cell_address(b or a)
    return min(r1, r2), min(c1, c2), max(r1, r2), max(c1, c2)


def numbered(df: DataFrame, order: str, name: str = "row") -> DataFrame:
    """Rows with their number, from 1, in order of a column (nulls first). Ranges of the order are sorted by tasks of their own; what comes together is one count for each range."""
    at = [c for c in ("_at", "_at_", "_at__") if c not in df.columns][0]
    placed = _cut(df.repartitionByRange(order).sortWithinPartitions(order).withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(at, 33)  # the number of a row begins with its range's number
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = F.broadcast(sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before")))
    here = F.col("_before") + F.col(at).bitwiseAND((1 << 33) - 1) + 1
    return placed.join(starts, part == F.col("_part")).withColumn(name, here.cast("int")).drop(at, "_part", "_before")


def cells(df: DataFrame, sheet: str, order: str) -> DataFrame:
    """A table as cells; its rows are numbered in order of a column."""
    names = [c for c in df.columns]
    rows = numbered(df, order, "_row")
    each = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("col"), F.col(c).cast("string").alias("value")) for i, c in enumerate(names)]))
    return rows.select(F.lit(sheet).alias("sheet"), F.col("_row").alias("row"), each.alias("c")).select("sheet", "row", "c.col", "c.value")


def _in(sheet: str):
    return F.col("sheet") == sheet


def cell(book: DataFrame, sheet: str, reference: str) -> DataFrame:
    row, col = cell_address(reference)
    return book.where(_in(sheet) & (F.col("row") == row) & (F.col("col") == col)).select("value")


def set_cell(book: DataFrame, sheet: str, reference: str, value) -> DataFrame:
    row, col = cell_address(reference)
    here = _in(sheet) & (F.col("row") == row) & (F.col("col") == col)
    new = book.sparkSession.createDataFrame([(sheet, row, col, str(value))], book.schema)
    return book.where(~here).union(new)


def column(book: DataFrame, sheet: str, letters: str) -> DataFrame:
    """The values of a column that aren't null, with their rows."""
    return book.where(_in(sheet) & (F.col("col") == column_number(letters)) & F.col("value").isNotNull()).select("row", "value")


def find(book: DataFrame, sheet: str, value, letters: str | None = None) -> DataFrame:
    """Cells that hold a value."""
    hit = _in(sheet) & (F.col("value") == str(value))
    return book.where(hit if letters is None else hit & (F.col("col") == column_number(letters))).select("row", "col")


def read_range(book: DataFrame, sheet: str, reference: str) -> DataFrame:
    """``row``, ``cells``: the values of a rectangle, missing ones null."""
    r1, c1, r2, c2 = range_address(reference)
    own = book.where(_in(sheet) & F.col("row").between(r1, r2) & F.col("col").between(c1, c2))
    values = F.map_from_entries(F.collect_list(F.struct("col", "value")))
    return own.groupBy("row").agg(values.alias("m")).select("row", F.transform(F.sequence(F.lit(c1), F.lit(c2)), lambda c: F.try_element_at("m", c)).alias("cells"))


def write_range(book: DataFrame, sheet: str, reference: str, values: list[list]) -> DataFrame:
    """Writes rows of values into a rectangle; what is beyond either is left."""
    r1, c1, r2, c2 = range_address(reference)
    new = [(sheet, r1 + i, c1 + j, None if v is None else str(v)) for i, row in enumerate(values[: r2 - r1 + 1]) for j, v in enumerate(row[: c2 - c1 + 1])]
    fresh = book.sparkSession.createDataFrame(new, book.schema)
    return book.join(fresh.select("sheet", "row", "col"), ["sheet", "row", "col"], "left_anti").select(*book.columns).union(fresh)


def rows(book: DataFrame, sheet: str, start: int = 1, end: int | None = None) -> DataFrame:
    """``row``, ``cells`` of rows that aren't all null."""
    own = book.where(_in(sheet) & (F.col("row") >= start))
    if end is not None:
        own = own.where(F.col("row") <= end)
    each = F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda c: c["value"])
    return own.groupBy("row").agg(each.alias("cells")).where(F.exists("cells", lambda v: v.isNotNull()))


def append_row(book: DataFrame, sheet: str, values: list) -> DataFrame:
    last = book.where(_in(sheet)).agg(F.coalesce(F.max("row"), F.lit(0)).alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(j + 1).alias("col"), F.lit(None if v is None else str(v)).cast("string").alias("value")) for j, v in enumerate(values)]))
    return book.union(last.select(F.lit(sheet).alias("sheet"), (F.col("n") + 1).cast("int").alias("row"), each.alias("c")).select("sheet", "row", "c.col", "c.value"))


def update_row(book: DataFrame, sheet: str, row: int, values: list) -> DataFrame:
    new = book.sparkSession.createDataFrame([(sheet, row, j + 1, None if v is None else str(v)) for j, v in enumerate(values)], book.schema)
    return book.where(~(_in(sheet) & (F.col("row") == row))).union(new)


def delete_rows(book: DataFrame, sheet: str, start: int, end: int | None = None) -> DataFrame:
    """Without the rows; later ones move up."""
    end = start if end is None else end
    moved = F.when(_in(sheet) & (F.col("row") > end), F.col("row") - (end - start + 1)).otherwise(F.col("row"))
    return book.where(~(_in(sheet) & F.col("row").between(start, end))).withColumn("row", moved.cast("int"))


def delete_columns(book: DataFrame, sheet: str, start: int, end: int | None = None) -> DataFrame:
    end = start if end is None else end
    moved = F.when(_in(sheet) & (F.col("col") > end), F.col("col") - (end - start + 1)).otherwise(F.col("col"))
    return book.where(~(_in(sheet) & F.col("col").between(start, end))).withColumn("col", moved.cast("int"))


def to_csv(book: DataFrame, path: str) -> None:
    """A folder for each sheet, a line for each row."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda c: F.coalesce(c["value"], F.lit("")))
    lines = book.groupBy("sheet", "row").agg(F.array_join(F.transform(each, lambda v: F.when(v.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)), ",").alias("line"))
    lines.repartition("sheet").sortWithinPartitions("sheet", "row").select("sheet", "line").write.mode("overwrite").partitionBy("sheet").text(path)
