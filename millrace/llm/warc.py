"""WARC archives: written with one gzip member per record, read sequentially.

The reader inflates a stream piece by piece, starts afresh at each member's end, takes each record's
block by its Content-Length and checks the block's and the payload's SHA-1.

Of records with equal payloads of ``revisit_bytes`` at least, the one with the largest id is a response and the others
are revisits that name it (payloads are equal by length and SHA-256; SHA-1 is what records state); a revisit's block holds the HTTP header alone, whose Content-Length is the full payload's.

Defined cases: a null page counts as empty. Rows without an id are always responses (their record id is derived from
address and payload) and are read back without one. Rows that repeat the largest id of a group are all
responses. Control characters and white space in addresses are percent-encoded; a null address is written as an empty one. An empty table
gives no archive. Archives are written under a draft name and then renamed, so a task that runs twice leaves one whole file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.encoding import portions
from millrace.llm.shared import joined, new_path, written
from millrace.llm.token_files import open_fs

REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "urn:page:"
PIECE = 1 << 20


class WarcError(ValueError):
    """A record that breaks the framing or fails a digest."""


def _base32(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = {"WARC-Type": kind, **headers, "WARC-Block-Digest": _base32(hashlib.sha1(block).digest()), "Content-Length": str(len(block))}
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    sha1 = hashlib.sha1(payload).digest()
    name = f"{PAGE}{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, uri + sha1.hex())}"
    headers = {"WARC-Record-ID": f"<{name}>", "WARC-Date": date, "WARC-Target-URI": uri, "WARC-Payload-Digest": _base32(sha1), "Content-Type": "application/http; msgtype=response"}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return record("response", headers, http + payload)
    return record("revisit", headers | {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{PAGE}{refers_to}>"}, http)


def members(stream) -> Iterator[bytes]:
    """The content of each gzip member of a binary stream, read and inflated piece by piece."""
    left = b""
    while True:
        left = left or stream.read(PIECE)
        if not left:
            return
        inflater, out = zlib.decompressobj(31), []
        while not inflater.eof:
            if not left and not (left := stream.read(PIECE)):
                raise WarcError("the archive ends within a record")
            out.append(inflater.decompress(left))
            left = inflater.unused_data
        yield b"".join(out)


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-cased names) and block of one record, its framing and digests verified."""
    end = raw.find(b"\r\n\r\n")
    if not raw.startswith(b"WARC/1.") or end < 0:
        raise WarcError("not a WARC record")
    fields = _fields(raw[:end])
    size = int(fields["content-length"])
    block = raw[end + 4 : end + 4 + size]
    if len(block) != size or raw[end + 4 + size :] != b"\r\n\r\n":
        raise WarcError("a block differs from its Content-Length")
    if fields.get("warc-block-digest", (own := _base32(hashlib.sha1(block).digest()))) != own:
        raise WarcError("a block fails its digest")
    return fields, block


def pages_of(stream) -> Iterator[tuple]:
    """(page id, address, payload or None, bytes and SHA-1 (hexadecimal) of the full payload, type, page referred to) of each response and revisit."""
    for raw in members(stream):
        fields, block = parse(raw)
        kind = fields["warc-type"]
        if kind not in ("response", "revisit"):
            continue
        head, _, payload = block.partition(b"\r\n\r\n")
        declared, stated = int(_fields(head)["content-length"]), fields["warc-payload-digest"]
        if kind == "response" and (len(payload) != declared or _base32(hashlib.sha1(payload).digest()) != stated):
            raise WarcError(f"a payload fails its length or digest: {fields['warc-record-id']}")
        page = lambda name: int(name[len(PAGE) + 1 : -1]) if name.startswith(f"<{PAGE}") else None
        sha1 = base64.b32decode(stated.removeprefix("sha1:")).hex()
        yield page(fields["warc-record-id"]), fields["warc-target-uri"], payload if kind == "response" else None, declared, sha1, kind, page(fields.get("warc-refers-to", ""))


def write_warc(pages: DataFrame, folder: str | None = None, revisit_bytes: int = REVISIT_BYTES, date: str = "2000-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes an archive for each partition; the list of them: ``path``, ``n_records``."""
    folder = folder or new_path(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, draft, out, n = f"{folder}/part-{TaskContext.get().partitionId():07d}.warc.gz", uuid.uuid4().hex, None, 0
        system, at = open_fs(path)
        for batch in batches:
            for rows in portions(batch, 2):
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                    if out is None:
                        system.create_dir(at.rpartition("/")[0], recursive=True)
                        out = system.open_output_stream(f"{at}.{draft}", compression=None)
                        out.write(record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, path)}>", "WARC-Date": date, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
                    out.write(page_record(page_id, url, html.encode(), refers_to, date))
                    n += 1
        if out is not None:
            out.close()
            system.move(f"{at}.{draft}", at)
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([n], pa.int64())})

    html = F.coalesce(F.col("_html"), F.lit(""))
    source = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col)).toDF("_id", "_url", "_html")
    wide = (F.octet_length(html) >= revisit_bytes) & F.col("_id").isNotNull()
    same = [F.when(wide, F.octet_length(html)).alias("_bytes"), F.when(wide, F.sha2(html.cast("binary"), 256)).alias("_sha")]
    groups = source.select("_id", *same).where("_sha IS NOT NULL").groupBy("_bytes", "_sha").agg(F.max("_id").alias("_last"), F.count(F.lit(1)).alias("_n"))
    groups = written(groups.where("_n > 1").select("_bytes", "_sha", "_last"), "warc-groups")
    rows = joined(source.select("_id", "_url", html.alias("_html"), *same), groups, ["_bytes", "_sha"], "left", 128)
    rows = rows.select("_id", "_url", "_html", F.when(F.col("_last") != F.col("_id"), F.col("_last")).alias("_refers"))
    return written(rows.mapInArrow(write, "path string, n_records long"), "warc-files")


def read_warc(spark: SparkSession, files: DataFrame, payloads: bool = True) -> DataFrame:
    """All responses and revisits of the archives in ``path``: ``page_id``, ``url``, ``payload`` (null in revisits, or if not asked for), ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``."""
    names, kinds = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"], [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paths in batches:
            for path in paths.column(0).to_pylist():
                system, at = open_fs(path)
                rows, held = [], 0
                with system.open_input_stream(at, compression=None) as stream:
                    for page in pages_of(stream):
                        rows.append(page if payloads else (*page[:2], None, *page[3:]))
                        held += len(page[2] or b"") if payloads else 100
                        if held > 4_000_000:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    paths = files.select("path").repartition(max(1, min(files.count(), 100_000)))
    return paths.mapInArrow(read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")
