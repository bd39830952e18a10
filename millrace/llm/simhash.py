"""Near-duplicates by SimHash, with candidates from the pigeonring principle.

A fingerprint is a ring of SEGMENTS segments. If two fingerprints differ in at most t bits, then from
some segment on every chain of l consecutive segments has at most l * t / SEGMENTS differences (whole
numbers: rounded down). With t = 2 and 15 segments the first seven segments of such a chain must be equal (29 or 30
bits, the key of a bucket), the first fourteen may differ in one bit, and the whole ring in two.

A bucket of more than BUCKET distinct fingerprints is split by the next budget: the one difference among the
following seven segments lies in one half of them or the other, so the other half must be equal and joins the key. Buckets
are halved like this as long as they are crowded; at the end all but one bit of fourteen segments is in the key, and only 64
fingerprints can share it. So every link is found, by the same principle at every size, and no bucket is paired that can hold more.

``drop_near_duplicates`` (general; the pipeline's stage) joins texts whose five-word shingles have a Jaccard similarity of 0.8 or
more. Such texts differ in some ten of 64 bits, at which pigeonring keys shrink to six bits; so
its candidates are the links by fingerprint and, beyond these, those of ``minhash``, and each is confirmed on the whole sets of shingles.

Defined cases: a null or wordless text has the fingerprint zero and is linked like any other. Texts of one
or two words hash the whole sequence. Rows without an id never lend a component its name: theirs is the
smallest id in reach, or null if there is none. Rows that repeat an id share its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.encoding import portions, strings
from millrace.llm.minhash import drop_similar
from millrace.llm.shared import joined, written

SEGMENTS, DISTANCE, SEED = 15, 2, 42
#: Distinct fingerprints in a bucket up to which it isn't split any more.
BUCKET = 32
_LANES = np.uint64(0x0101010101010101)


def majority_bits(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes. Eight bits are counted at a time, each in a byte of its own."""
    n = len(hashes)
    h = np.zeros(-(-n // 255) * 255, np.uint64)
    h[:n] = hashes
    out = 0
    for b in range(8):
        lanes = ((h >> np.uint64(b)) & _LANES).reshape(-1, 255).sum(1, dtype=np.uint64)
        counts = lanes.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
        for byte in np.nonzero(2 * counts > n)[0]:
            out |= 1 << (8 * int(byte) + b)
    return out


def fingerprint(text: str, shingle: int = 3, seed: int = SEED) -> int:
    """SimHash of the text's word shingles; A-Z are lower-cased, words are split at ASCII white space."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joint = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joint, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-shingle] + 1)).tolist()
    of = xxhash.xxh64_intdigest
    return majority_bits(np.fromiter((of(joint[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id_col``, ``_fp`` (the 64 bits as a signed long) of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in portions(batch, 1):
                found = np.array([fingerprint(t, shingle) for t in strings(rows.column(1)).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(found.view(np.int64))], names=[id_col, "_fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(scan, f"`{id_col}` long, _fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _starts(segments: int, distance: int) -> list[tuple[int, int, int]]:
    """For each start on the ring: its bit, the bits that must be equal from there, and those that may differ once."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    wide = lambda start, n: sum(cuts[(start + j) % segments + 1] - cuts[(start + j) % segments] for j in range(n))
    chain = lambda budget: max(n for n in range(segments + 1) if n * distance // segments <= budget)
    return [(cuts[i], wide(i, chain(0)), wide(i, chain(1))) for i in range(segments)]


def links(points: DataFrame, bucket: int = BUCKET, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """Edges u, v between the ``node`` of distinct fingerprints ``fp``: all pairs within ``distance``."""
    keys = []
    for at, (bit, equal, once) in enumerate(_starts(segments, distance)):
        turned = F.col("fp") if bit == 0 else F.shiftrightunsigned("fp", bit).bitwiseOR(F.shiftleft("fp", 64 - bit))
        key = turned.bitwiseAND(F.lit(_signed((1 << equal) - 1)))
        keys.append(F.struct(F.lit(at).alias("at"), F.lit(equal).alias("lo"), F.lit(once).alias("hi"), turned.alias("turned"), key.alias("key")))
    rows, own, found = points.select("node", F.explode(F.array(*keys)).alias("k")).select("node", "k.*"), ["at", "lo", "hi", "key"], []
    bits = lambda a, b: F.expr(f"shiftleft(shiftleft(1L, {b} - {a}) - 1, {a})")
    while True:
        sizes = written(rows.groupBy(*own).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-buckets")
        whole = (F.col("n") <= bucket) | (F.col("hi") - F.col("lo") <= 1)
        met = written(joined(rows, sizes.select(*own, whole.alias("whole")), own, "inner", 64), "simhash-met")
        a, b = met.where("whole").alias("a"), met.where("whole").alias("b")
        same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in own]
        diff = F.col("a.turned").bitwiseXOR(F.col("b.turned"))
        near = (F.bit_count(diff.bitwiseAND(F.expr("shiftleft(shiftleft(1L, a.hi - a.lo) - 1, a.lo)"))) <= 1) & (F.bit_count(diff) <= distance)
        pairs = a.join(b, same[0] & same[1] & same[2] & same[3] & (F.col("a.node") < F.col("b.node")) & near)
        found.append(written(pairs.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct(), "simhash-pairs"))
        crowded = met.where("not whole").withColumn("mid", F.expr("(lo + hi) div 2").cast("int"))
        if crowded.isEmpty():
            break
        left = F.struct(F.col("lo"), F.col("mid").alias("hi"), F.col("key").bitwiseOR(F.col("turned").bitwiseAND(bits("mid", "hi"))).alias("key"))
        right = F.struct(F.col("mid").alias("lo"), F.col("hi"), F.col("key").bitwiseOR(F.col("turned").bitwiseAND(bits("lo", "mid"))).alias("key"))
        rows = crowded.select("node", "at", "turned", F.explode(F.array(left, right)).alias("k")).select("node", "at", "k.lo", "k.hi", "turned", "k.key")
    edges = found[0]
    for more in found[1:]:
        edges = edges.union(more)
    return edges


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bucket: int = BUCKET) -> DataFrame:
    """A row per input row: ``id_col``, ``fingerprint`` (16 hexadecimal digits), ``component_id``."""
    prints = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    points = written(prints.groupBy(F.col("_fp").alias("fp")).agg(F.min(id_col).alias("node")).where("node IS NOT NULL"), "simhash-points")
    named = written(components(links(points, bucket)), "simhash-components")
    classes = written(joined(points, named, "node", "left", 32).select(F.col("fp").alias("_fp"), F.coalesce("component", "node").alias("component_id")), "simhash-classes")
    return prints.join(classes, "_fp", "left").select(id_col, F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, **options) -> DataFrame:
    """Keeps of each component of texts with a Jaccard similarity of ``least`` the row with the smallest id (one without an id only if there is no other)."""
    return drop_similar(docs, links, majority_bits, id_col, text_col, shingle, least, **options)
