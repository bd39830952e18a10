"""Token-id files: each id in as few bits as the vocabulary needs, readable at any block.

A file holds, little-endian: 8 bytes ``MRTOKEN1``; unsigned 32-bit numbers bits, ids a block; unsigned
64-bit numbers documents, ids, blocks; signed 64-bit document ids; unsigned 64-bit ends of the
documents (ids up to and with each); unsigned 64-bit byte offsets of the blocks, one more than
blocks; the blocks. A block packs its ids from the lowest bit up and is padded to a byte.

Defined cases: a null text counts as empty and gives the end id alone. Rows without an id come
first and are read back without one (-2^63 stands for it in the file). Rows that repeat an id are
documents of their own. Rows of one id, or without one, stand in order of a hash of their texts, so many of them are several ranges. An empty table gives no file. Files are written under a name of the
attempt and then renamed, so a task that runs twice leaves one whole file.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.encoding import encoder, portions, strings
from millrace.llm.shared import may_broadcast, new_path, written

MAGIC, HEAD = b"MRTOKEN1", struct.Struct("<8sIIQQQ")
NO_ID = -(2**63)
BLOCK_IDS = 4096
#: Bytes of text that are encoded at once.
AT_ONCE = 8_000_000
#: Ids from which a file is closed and the range goes on in another; a task holds about so many.
FILE_IDS = 32_000_000


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits((ids[:, None] >> np.arange(bits, dtype=np.uint32) & 1).astype(np.uint8), bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    own = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (own.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if "://" in path else f"file://{path}" if not path.startswith("file:") else "file://" + path.removeprefix("file:"))


def store(path: str, parts: list[bytes]) -> None:
    """Writes a file in one step: under another name first."""
    system, at = open_fs(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    draft = f"{at}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        for x in parts:
            out.write(x)
    system.move(draft, at)


def serialise(doc_ids: list[int], lengths: list[int], ids: np.ndarray, bits: int, block_ids: int = BLOCK_IDS) -> list[bytes]:
    blocks = [pack(ids[i : i + block_ids], bits) for i in range(0, len(ids), block_ids)]
    head = HEAD.pack(MAGIC, bits, block_ids, len(doc_ids), len(ids), len(blocks))
    index = [np.array(doc_ids, "<i8").tobytes(), np.cumsum(lengths).astype("<u8").tobytes()]
    first = len(head) + sum(map(len, index)) + 8 * (len(blocks) + 1)
    return [head, *index, (first + np.cumsum([0, *map(len, blocks)])).astype("<u8").tobytes(), *blocks]


class TokenFile:
    """Random access to one file: only the blocks that hold the wanted ids are read."""

    def __init__(self, path: str | None = None, raw: bytes | None = None) -> None:
        if path is not None:
            system, at = open_fs(path)
            self.file = system.open_input_file(at)
        else:
            self.file = io.BytesIO(raw or b"")
        magic, self.bits, self.block_ids, docs, self.n_ids, blocks = HEAD.unpack(self.file.read(HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.doc_ids = np.frombuffer(self.file.read(8 * docs), "<i8")
        self.ends = np.frombuffer(self.file.read(8 * docs), "<u8").astype(np.int64)
        self.offsets = np.frombuffer(self.file.read(8 * (blocks + 1)), "<u8").astype(np.int64)

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from ``start`` to before ``end`` of the whole file."""
        if end <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block_ids, (end - 1) // self.block_ids
        self.file.seek(int(self.offsets[a]))
        raw = self.file.read(int(self.offsets[b + 1] - self.offsets[a]))
        if self.block_ids * self.bits % 8 == 0:
            own = unpack(raw, self.bits, min(self.n_ids, (b + 1) * self.block_ids) - a * self.block_ids)
        else:
            cut = self.offsets[a : b + 2] - self.offsets[a]
            own = np.concatenate([unpack(raw[cut[i] : cut[i + 1]], self.bits, min(self.block_ids, self.n_ids - (a + i) * self.block_ids)) for i in range(b - a + 1)])
        return own[start - a * self.block_ids : end - a * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", spaces: str = "whole") -> DataFrame:
    """Writes all documents in ascending order of id; returns the list of files.

    A row per file: ``part`` (files in order), ``path``, ``n_docs``, ``n_ids``, ``first_id`` (ids in the files before).
    """
    folder = folder or new_path(docs.sparkSession, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (doc_ids, lengths, found), made = encoder(tokenizer_path, spaces), ([], [], []), 0
        bits = bits_for(max(own.vocabulary, end_id + 1))
        kind = np.uint16 if bits <= 16 else np.uint32
        for batch in batches:
            for rows in portions(batch, 1, AT_ONCE):
                ids, n = own.encode(strings(rows.column(1)))
                whole = np.insert(ids, np.cumsum(n), end_id)
                doc_ids += [NO_ID if x is None else x for x in rows.column(0).to_pylist()]
                lengths += (n + 1).tolist()
                found.append(whole.astype(kind))
                if sum(map(len, found)) >= FILE_IDS:
                    yield file(made, doc_ids, lengths, found, bits)
                    (doc_ids, lengths, found), made = ([], [], []), made + 1
        if doc_ids:
            yield file(made, doc_ids, lengths, found, bits)

    def file(number: int, doc_ids: list[int], lengths: list[int], found: list[np.ndarray], bits: int) -> pa.RecordBatch:
        part, ids = TaskContext.get().partitionId(), np.concatenate(found)
        path = f"{folder}/part-{part:07d}-{number:05d}.mrt"
        store(path, serialise(doc_ids, lengths, ids, bits))
        return pa.RecordBatch.from_pydict({"part": pa.array([(part << 20) + number], pa.int64()), "path": [path], "n_docs": pa.array([len(doc_ids)], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64())})

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col)).toDF("_id", "_text").withColumn("_h", F.xxhash64("_text")).repartitionByRange("_id", "_h").sortWithinPartitions("_id", "_h").drop("_h")
    files = written(rows.mapInArrow(write, "part long, path string, n_docs long, n_ids long"), "token-files")
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("first_id", F.coalesce(before, F.lit(0)))


def read_token_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """A row per document, read from the files: ``doc_id``, ``start`` (ids before it), ``n_tokens``, ``ids`` (unsigned 32-bit, little-endian)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, path in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                file = TokenFile(path)
                for a in range(0, len(file.ends), 2000):
                    b = min(a + 2000, len(file.ends))
                    first = int(file.ends[a - 1]) if a else 0
                    ids, cut = file.ids(first, int(file.ends[b - 1])), file.ends[a:b] - first
                    starts = np.concatenate(([0], cut[:-1]))
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array([part] * (b - a), pa.int64()), "doc_id": pa.array(file.doc_ids[a:b], pa.int64(), mask=file.doc_ids[a:b] == NO_ID), "start": pa.array(first + starts, pa.int64()),
                        "n_tokens": pa.array(cut - starts, pa.int64()), "ids": pa.array([ids[x:y].astype("<u4").tobytes() for x, y in zip(starts, cut, strict=True)], pa.binary()),
                    })

    paths = files.select("part", "path").repartition(max(1, min(files.count(), 100_000)))
    docs = paths.mapInArrow(read, "part long, doc_id long, start long, n_tokens long, ids binary")
    firsts = files.select("part", "first_id")
    docs = docs.join(F.broadcast(firsts) if may_broadcast(files, 32) else firsts, "part")
    return docs.select("doc_id", (F.col("first_id") + F.col("start")).alias("start"), "n_tokens", "ids")
