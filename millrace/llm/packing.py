"""Packing by powers of two: each document is cut into pieces of binary lengths.

A document of n ids gives n // longest pieces of the longest length and one piece for each bit set in
the rest, from the longest to the shortest. Each piece is a sequence of its own, and sequences of
one length form a bucket; no sequence crosses documents and none needs padding.

Defined cases: a null text counts as empty, which leaves the end id alone: one piece of length 1.
Rows that repeat an id, and rows without one, are documents of their own. An empty table gives no
piece. ``sequence_id`` is 64 x (number within the bucket, from 0 without gaps) + log2(length), so a
bucket's sequences can be told and counted from the id; it is the same in every run over the same files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.encoding import encoder, portions, strings
from millrace.llm.shared import may_broadcast, written

#: Distinct chunks that a worker remembers: in the pipeline, packing runs beside a heap that the stages before have filled.
KEPT = 200_000
PIECES = "part long, nth long, exponent int, doc_id long, start long, length long, doc_tokens long, tokens binary"


def binary_pieces(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of n ids: powers of two, descending."""
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if n % longest >> b & 1]


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, longest: int = 1024, id_col: str = "doc_id", text_col: str = "text", spaces: str = "whole") -> DataFrame:
    """A row per piece: ``doc_id``, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset``, ``tokens`` (unsigned 32-bit, little-endian)."""
    if longest < 1 or longest & longest - 1:
        raise ValueError("longest must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seen = encoder(tokenizer_path, spaces, KEPT), TaskContext.get().partitionId(), np.zeros(64, np.int64)
        for batch in batches:
            for rows in portions(batch, 1):
                ids, n = own.encode(strings(rows.column(1)))
                raw = np.insert(ids, np.cumsum(n), end_id).astype("<u4").tobytes()
                lengths = [binary_pieces(int(x) + 1, longest) for x in n]
                counts = np.array([len(x) for x in lengths], np.int64)
                length = np.array([x for own_ in lengths for x in own_], np.int64)
                ends = np.cumsum(length)
                firsts = np.repeat(np.concatenate(([0], np.cumsum(n + 1)[:-1])), counts)
                exponent = np.log2(length).astype(np.int32)
                nth = np.zeros(len(length), np.int64)
                for e in np.unique(exponent):
                    here = np.nonzero(exponent == e)[0]
                    nth[here] = seen[e] + np.arange(len(here))
                    seen[e] += len(here)
                doc_ids = rows.column(0).take(pa.array(np.repeat(np.arange(rows.num_rows), counts)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(length), part), pa.int64()), pa.array(nth), pa.array(exponent), doc_ids.cast(pa.int64()), pa.array(ends - length - firsts), pa.array(length),
                    pa.array(np.repeat(n + 1, counts)), pa.array([raw[4 * (e - k) : 4 * e] for k, e in zip(length.tolist(), ends.tolist(), strict=True)], pa.binary()),
                ], names=[x.split()[0] for x in PIECES.split(", ")])

    pieces = written(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut, PIECES), "pieces")
    counts = pieces.groupBy("exponent", "part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("exponent").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = written(counts.select("exponent", "part", F.coalesce(before, F.lit(0)).alias("_first")), "piece-counts")
    numbered = pieces.join(F.broadcast(firsts) if may_broadcast(firsts, 48) else firsts, ["exponent", "part"])
    return numbered.select(
        F.col("doc_id").alias(id_col), "start", "length", "doc_tokens", ((F.col("_first") + F.col("nth")) * 64 + F.col("exponent")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "tokens"
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Writes one folder per sequence length, for training batches of equal length."""
    pieces.write.partitionBy("length").parquet(path)
