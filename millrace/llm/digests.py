"""Quartile bucket digests: short fingerprints of texts that can be compared.

Every triplet of neighbouring bytes is hashed to one of BUCKETS counters. The counters' quartiles turn each
count into two bits (up to the first, second, third quartile, or above), and one byte holds the length
on a logarithmic scale. Two digests differ by the sum of the buckets' differences, where the widest
counts double, plus what their lengths differ beyond a step; the likeness falls in a line from 1 at difference 0
to 0 at BOUND, about what unrelated texts differ.

``edited_digests`` also takes each text with its second half replaced by the start of the next text in order of id.
Texts are dealt by ranges of ids once; a range's last text, whose next one lies elsewhere, is finished
afterwards with the first text of the next range.

Defined cases: a null text counts as empty; texts under three bytes have no triplet. Rows without an id come first in
order, rows of one id, or without one, are in order of a hash of their texts (so many of them are several ranges). The last document is followed by the first, a single one
by itself. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.encoding import portions, strings
from millrace.llm.shared import written

BUCKETS, BOUND, LENGTH_COST, LENGTH_MOST = 256, 400, 4, 80
_WEIGHTS = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]], np.int64)


def digest(text: bytes) -> bytes:
    """One byte for the length, then two bits for each bucket."""
    raw = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(raw) > 2:
        mixed = ((raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]) * np.uint32(2654435769)) >> np.uint32(24)
        counts = np.bincount(mixed, minlength=BUCKETS)
    else:
        counts = np.zeros(BUCKETS, np.int64)
    quartiles = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = np.searchsorted(quartiles, counts, "left").astype(np.uint8).reshape(-1, 4)
    length = min(255, round(math.log(1 + len(raw)) / math.log(1.1)))
    return bytes([length]) + (codes << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8).tobytes()


def _codes(of: bytes) -> np.ndarray:
    return (np.frombuffer(of, np.uint8, offset=1)[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).ravel()


def difference(a: bytes, b: bytes) -> int:
    """0 for equal digests; the buckets' part is 6 * BUCKETS at most, the lengths' part LENGTH_MOST."""
    steps = abs(a[0] - b[0])
    return int(_WEIGHTS[_codes(a), _codes(b)].sum()) + min(LENGTH_MOST, LENGTH_COST * max(0, steps - 1))


def likeness(a: bytes, b: bytes) -> float:
    return max(0.0, 1 - difference(a, b) / BOUND)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the ``fingerprint`` (hexadecimal) of every row; nothing is shuffled."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in portions(batch, 1):
                yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array([digest(t.encode()).hex() for t in strings(rows.column(1)).to_pylist()], pa.string())], names=[id_col, "fingerprint"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(scan, f"`{id_col}` long, fingerprint string")


_ROW = "doc_id long, n_chars long, edited binary, print binary, edited_print binary, near_edited double, near_next double"
_EDGE, _INNER, _TAIL, _HEAD = "part long, kind int, text string", 0, 1, 2


def _compared(doc_id: int | None, text: str, own: bytes, after: str, after_print: bytes) -> tuple:
    n = len(text)
    half = n // 2
    edited = (text[: n - half] + after[:half]).encode()
    changed = digest(edited)
    return doc_id, n, hashlib.sha256(edited).digest(), own, changed, likeness(own, changed), likeness(own, after_print)


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string()}
    fields = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def edited_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), None
        for batch in batches:
            for rows in portions(batch, 1):
                out = []
                for doc_id, text in zip(rows.column(0).to_pylist(), strings(rows.column(1)).to_pylist(), strict=True):
                    own = digest(text.encode())
                    if before is None:
                        out.append((None,) * 7 + (part, _HEAD, text))
                    else:
                        out.append(_compared(*before, text, own) + (None, _INNER, None))
                    before = doc_id, text, own
                if out:
                    yield _batch(out, f"{_ROW}, {_EDGE}")
        if before is not None:
            yield _batch([(before[0],) + (None,) * 6 + (part, _TAIL, before[1])], f"{_ROW}, {_EDGE}")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield _batch([_compared(doc_id, text, digest(text.encode()), after, digest(after.encode()))], _ROW)

    rows = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))).toDF("_id", "_text")
    rows = rows.withColumn("_h", F.xxhash64("_text")).repartitionByRange("_id", "_h").sortWithinPartitions("_id", "_h", "_text").drop("_h")
    found = written(rows.mapInArrow(scan, f"{_ROW}, {_EDGE}"), "digests")
    heads = found.where(F.col("kind") == _HEAD).select(F.col("part").alias("_next"), F.col("text").alias("_after"))
    order = found.where(F.col("kind") == _HEAD).select("part")
    order = order.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("_next"))
    tails = found.where(F.col("kind") == _TAIL).select("part", "doc_id", "text").join(order, "part").join(heads, "_next").select("doc_id", "text", "_after")
    every = found.where(F.col("kind") == _INNER).select(*[x.split()[0] for x in _ROW.split(", ")]).union(tails.mapInArrow(finish, _ROW))
    hexed = lambda c: F.lower(F.hex(c))
    return every.select(
        F.col("doc_id").alias(id_col), "n_chars", hexed("edited").alias("edited_sha256"), hexed("print").alias("fingerprint"), hexed("edited_print").alias("edited_fingerprint"), "near_edited", "near_next"
    )
