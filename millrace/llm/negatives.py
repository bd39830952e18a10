"""Hard negatives: rows of another label that score nearly as high as an anchor's positives, by exact integer products.

Vectors are whole numbers: ``floor(SCALE * component)``. A row's score is its inner product with the anchor. Every row meets every
anchor, in blocks of ROWS rows and ANCHORS anchors that Spark deals out, so a task holds two blocks at most.

In a block, most products are never finished. All vectors are turned by an orthogonal matrix, the principal axes of the (uncentred) second moments of all
rows, which are exact sums over the table; turning changes no product, but the first few axes then hold most of it. The partial product
over the leading axes differs from the whole one by at most the product of the two rests' norms (Cauchy-Schwarz), plus a slack for
what the matrix lacks in orthogonality and for the rounding of floats. After each of STAGES axes a pair goes on only if its interval can
still reach what the anchor needs. Survivors are multiplied as whole numbers, and those products alone decide.

First the positives: the ``positives`` best other rows of the anchor's label. An anchor needs more than the worst of the best it has met in
the block. Then the negatives: for a positive of score s, the best of ``low`` / 100 * s to ``high`` / 100 * s; as soon as a positive has
met enough in the block, only better ones within its range count.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part, nor do those with a whole component of 2^26 and more,
whose products needn't fit in 64 bits. Missing components of shorter vectors count as 0, so empty vectors score 0. A row without an
id is no anchor and comes last among ties. Rows that repeat an id are rows of their own, each an anchor if the id is one, and lists may name their id twice. Anchors
whose positives or ranges are empty have no rows; a negative positive score has an empty range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import written

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 5, 80, 100
#: Rows and anchors in a block; axes after which pairs are sorted out; rows of a block that are multiplied at once; a component's bound.
ROWS, ANCHORS, STAGES, AT_ONCE, MOST = 4096, 1024, (8, 24), 1024, 1 << 26
#: Components that are turned; those behind stay as they are.
WIDEST = 512
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_POSITIVES = "anchor long, positive long, positive_id long, positive_score long"
_PAIRS = "anchor long, anchor_id long, positive long, positive_id long, positive_score long, id long, score long"


def whole_vectors(rows: DataFrame, id_col: str, vec_col: str, label: Column, anchor: Column, scale: int = SCALE) -> DataFrame:
    """``key`` (tells rows apart), ``id``, ``label``, ``anchor`` and ``v`` (whole numbers) of the rows that take part, written."""
    x = F.col(vec_col)
    whole = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    sound = x.isNotNull() & label.isNotNull() & F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    rows = rows.where(sound).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), whole.alias("v"))
    rows = rows.where(F.forall("v", lambda c: F.abs(c) < MOST)).select("*", F.monotonically_increasing_id().alias("key"))
    return written(rows, "negatives-vectors")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows, with 0 for what is missing."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), width), np.int64)
    row, at = np.repeat(np.arange(len(column)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row[at < width], at[at < width]] = column.flatten().to_numpy(zero_copy_only=False)[at < width]
    return out


def principal_axes(vectors: DataFrame, width: int) -> np.ndarray:
    """An orthogonal matrix (up to rounding): the eigenvectors of the sum of all outer products, largest first. What comes to the driver is that sum, of WIDEST components at most."""
    width = min(width, WIDEST)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch.column(0), width).astype(np.float64)  # of a longer vector, its beginning
            total += m.T @ m
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "s"])

    moments = np.zeros((width, width))
    for i, j, s in vectors.select("v").mapInArrow(sums, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        moments[i, j] = s
    return np.linalg.eigh((moments + moments.T) / 2)[1][:, ::-1].copy()


class _Turned:
    """Vectors along the axes, their lengths, and those of what is left after each stage."""

    def __init__(self, v: np.ndarray, axes: np.ndarray, stages: list[int]) -> None:
        d = len(axes)
        self.whole, self.y = v, np.hstack((v[:, :d] @ axes, v[:, d:]))
        squares = self.y * self.y
        self.norm = np.sqrt(squares.sum(1))
        self.rest = {m: np.sqrt(squares[:, m:].sum(1)) for m in stages}


def slack(axes: np.ndarray, width: int) -> float:
    """Times both lengths: how far a product of turned vectors can be from the whole one. The first part is the matrix's own error, the second bounds the rounding of both turns, the product and the norms."""
    return float(np.linalg.norm(axes.T @ axes - np.eye(len(axes)))) + 8 * (np.sqrt(width) + 2) * (width + 2) * np.finfo(np.float64).eps


class Bounded:
    """Pairs of a block of rows and the anchors whose products can lie within given limits; ``finished`` counts those that were multiplied as whole numbers."""

    def __init__(self, axes: np.ndarray, width: int) -> None:
        self.axes, self.stages, self.slack, self.finished = axes, [m for m in STAGES if m < width], slack(axes, width), 0

    def turned(self, v: np.ndarray) -> _Turned:
        return _Turned(v, self.axes, self.stages)

    def within(self, rows: _Turned, anchors: _Turned, at: slice, low: np.ndarray, high: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, score) of the pairs ``may`` of rows ``at`` whose score can be from the anchor's ``low`` to its ``high``; all scores are exact."""
        off = self.slack * np.outer(rows.norm[at], anchors.norm) + 1e-6
        if not self.stages:
            r, a = np.nonzero(may)
        else:
            m = self.stages[0]
            part, rest = rows.y[at, :m] @ anchors.y[:, :m].T, np.outer(rows.rest[m][at], anchors.rest[m]) + off
            r, a = np.nonzero(may & (part + rest >= low) & (part - rest <= high))
            part = part[r, a]
            for before, m in zip(self.stages, self.stages[1:], strict=False):
                part = part + np.einsum("ij,ij->i", rows.y[at][r, before:m], anchors.y[a, before:m])
                rest = rows.rest[m][at][r] * anchors.rest[m][a] + off[r, a]
                stays = (part + rest >= low[a]) & (part - rest <= high[a])
                r, a, part = r[stays], a[stays], part[stays]
        self.finished += len(r)
        score = np.einsum("ij,ij->i", rows.whole[at][r], anchors.whole[a])
        stays = (score >= low[a]) & (score <= high[a])
        return r[stays] + at.start, a[stays], score[stays]


def _best(group: np.ndarray, score: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each group, best first."""
    if not len(group):
        return np.zeros(0, np.int64)
    by = np.lexsort((order, -score, group))
    first = np.concatenate(([True], np.diff(group[by]) != 0))
    start = np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
    return by[np.arange(len(by)) - start < k]


def _floors(size: int, group: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each group that has k, of which none has more."""
    worst = np.full(size, _MOST)
    np.minimum.at(worst, group, score)
    return np.where(np.bincount(group, minlength=size) >= k, worst, _LEAST)


def _longs(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy(zero_copy_only=False)


def _ids(table: pa.Table) -> np.ndarray:
    """Ids; rows without one come last among equals."""
    return table.column("id").combine_chunks().fill_null(_MOST).to_numpy(zero_copy_only=False)


def _meet(bounded: Bounded, rows: pa.Table, v: np.ndarray, anchors: pa.Table, av: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, slot: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """For each slot (an anchor with its limits), the k best rows of the block of the same or of another label: slot, row, score.

    ``slot`` has the anchor of each slot; ``low`` and ``high`` are by slot. Pairs are looked for once for all slots of an anchor.
    """
    held = (np.zeros(0, np.int64),) * 3
    own, ids, keys, key = _longs(rows, "label"), _ids(rows), _longs(rows, "key"), _longs(anchors, "key")
    turned, pivots = bounded.turned(v), bounded.turned(av)
    floor, n = low, len(av)
    order = np.argsort(-turned.norm, kind="stable")  # long vectors first, so that floors rise early
    turned = bounded.turned(v[order])
    own, ids, keys = own[order], ids[order], keys[order]
    for start in range(0, len(v), AT_ONCE):
        at = slice(start, min(len(v), start + AT_ONCE))
        least, most = np.full(n, _MOST), np.full(n, _LEAST)
        np.minimum.at(least, slot, floor)
        np.maximum.at(most, slot, high)
        may = (own[at, None] == label[None, :]) == same
        if same:
            may &= keys[at, None] != key[None, :]
        row, anchor, score = bounded.within(turned, pivots, at, least, most, may)
        by = np.argsort(anchor, kind="stable")
        row, anchor, score = row[by], anchor[by], score[by]
        begin, end = np.searchsorted(anchor, slot), np.searchsorted(anchor, slot, "right")
        which = np.repeat(np.arange(len(slot)), end - begin)
        pick = np.repeat(begin - np.concatenate(([0], np.cumsum(end - begin)[:-1])), end - begin) + np.arange((end - begin).sum())
        fits = (score[pick] >= floor[which]) & (score[pick] <= high[which])
        group, place, value = (np.concatenate((x, y)) for x, y in zip(held, (which[fits], row[pick][fits], score[pick][fits]), strict=True))
        best = _best(group, value, ids[place], k)
        held = group[best], place[best], value[best]
        floor = np.maximum(low, _floors(len(slot), held[0], held[2], k))
    return held[0], order[held[1]], held[2]


def _blocks(vectors: DataFrame, anchors: DataFrame, rows: int, by: int, *more: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with the numbers of the blocks in which they meet. Every row is in one block of rows and meets each block of anchors."""
    ns, na = max(1, -(-vectors.count() // rows)), max(1, -(-anchors.count() // by))
    spread = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select("key", "id", "label", "v", spread(ns).alias("rows"), all_(na).alias("by"))
    right = anchors.select("key", "id", "label", "v", *more, all_(ns).alias("rows"), spread(na).alias("by"))
    return left, right


def hard_negatives(rows: DataFrame, id_col: str, vec_col: str, label: Column, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: tuple[int, int] = (ROWS, ANCHORS)) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``."""
    vectors = whole_vectors(rows, id_col, vec_col, label, anchor)
    width = max(1, vectors.agg(F.max(F.size("v"))).first()[0] or 0)
    axes = principal_axes(vectors, width)
    anchors = written(vectors.where("anchor"), "negatives-anchors")
    none = pa.schema([(x.split()[0], pa.int64()) for x in _POSITIVES.split(", ")]).empty_table()
    nothing = pa.schema([(x.split()[0], pa.int64()) for x in _PAIRS.split(", ")]).empty_table()

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return none
        v, av = _matrix(left.column("v"), width), _matrix(right.column("v"), width)
        n = len(av)
        slot, row, score = _meet(Bounded(axes, width), left, v, right, av, _longs(right, "label"), np.full(n, _LEAST), np.full(n, _MOST), True, np.arange(n), positives)
        slot, row = pa.array(slot), pa.array(row)
        return pa.Table.from_arrays([right.column("key").take(slot), left.column("key").take(row), left.column("id").take(row), pa.array(score)], names=["anchor", "positive", "positive_id", "positive_score"])

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return nothing
        v, av = _matrix(left.column("v"), width), _matrix(right.column("v"), width)
        listed = right.column("positives").combine_chunks()
        flat, slots = listed.flatten(), np.repeat(np.arange(len(av)), np.diff(np.asarray(listed.offsets)))
        score = flat.field("positive_score").to_numpy(zero_copy_only=False)
        # low * s <= 100 * score <= high * s in whole numbers
        slot, row, found = _meet(Bounded(axes, width), left, v, right, av, _longs(right, "label"), -(-low * score // 100), high * score // 100, False, slots, negatives)
        of, row = pa.array(slot), pa.array(row)
        on = pa.array(slots[slot])
        columns = [right.column("key").take(on), right.column("id").take(on), *[flat.field(c).take(of) for c in ("positive", "positive_id", "positive_score")], left.column("id").take(row), pa.array(found)]
        return pa.Table.from_arrays(columns, names=[x.split()[0] for x in _PAIRS.split(", ")])

    left, right = _blocks(vectors, anchors, *block)
    near = left.groupBy("rows", "by").cogroup(right.groupBy("rows", "by")).applyInArrow(first, _POSITIVES)
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"), "positive"))
    near = near.select("*", rank.alias("rank")).where(F.col("rank") <= positives)
    own = written(near.groupBy("anchor").agg(F.collect_list(F.struct("positive", "positive_id", "positive_score")).alias("positives")), "negatives-positives")
    left, right = _blocks(vectors, anchors.join(own.withColumnRenamed("anchor", "key"), "key"), *block, "positives")
    found = left.groupBy("rows", "by").cogroup(right.groupBy("rows", "by")).applyInArrow(second, _PAIRS)
    rank = F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    found = found.select("anchor_id", "positive_id", rank.cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    return found.where(F.col("rank") <= negatives)
