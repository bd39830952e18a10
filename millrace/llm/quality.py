"""A quality classifier: regularised quadratic discriminant over document statistics.

``statistics`` turns a whole text into FEATURES numbers, transformed so that each class is roughly Gaussian.
Per class, the mean and the covariance come from sums over all labelled rows (partial sums, so nothing is gathered);
the covariance is shrunk towards the pooled one and that towards its diagonal. The score is the
logistic of the difference of the class log densities, each a squared Mahalanobis distance through the
Cholesky factor of its class, kept in the model, and the log determinant.

Defined cases: a null text counts as empty and is scored like any other. Null labels and labels without a document
are left out, a document labelled twice counts once for each. Labels other than 0 and 1 are an error. If one class has
fewer than MINIMUM rows the prior alone decides: every score is the share of label 1 (0.5 without labels).
Rows without an id are scored (their held_out is false).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.encoding import portions, strings
from millrace.llm.shared import joined, keyed, written

#: Shrinkage of the class covariances to the pooled one, and of that to its diagonal, at least; rows a class needs.
TO_POOLED, TO_DIAGONAL, MINIMUM = 0.02, 0.02, 3
#: Weight of the features' number against a class's rows: few rows are shrunk more.
FEW_ROWS = 0.3
#: Log-density differences are divided by this before the logistic, which keeps scores off 0 and 1.
TEMPERATURE = 2.0

_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("a") : ord("z") + 1] = 3
_KIND[ord("0") : ord("9") + 1] = 4
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 5
_KIND[[i for i in range(33, 127) if _KIND[i] == 0]] = 6
_KIND[128:] = 7
_LETTER = np.isin(_KIND, (2, 3, 7))

FEATURES = [
    "words", "word_length", "word_spread", "upper", "symbols", "marks", "digits", "white", "foreign", "distinct", "commonest", "ends", "mixed", "short",
    "lines", "line_repeats", "pair_repeats", "entropy", "capitals", "longest",
]


#: Cases by which a share is drawn to a usual one, so that short texts aren't odd for being short.
USUAL_CASES = 8


def _share(part: float, whole: float, usual: float) -> float:
    """The log odds of a share, after USUAL_CASES cases of the usual share are added: always finite."""
    return math.log((part + USUAL_CASES * usual) / (max(whole - part, 0) + USUAL_CASES * (1 - usual)))


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text, in the order of FEATURES."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    kind = np.bincount(_KIND[data], minlength=8) if len(data) else np.zeros(8, np.int64)
    counts = np.bincount(data, minlength=256) if len(data) else np.zeros(256, np.int64)
    words = raw.split()
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    starts = np.nonzero(np.diff(np.concatenate(([1], _KIND[data] == 1)).astype(np.int8)) == -1)[0] if n else np.zeros(0, np.int64)
    lasts = data[starts + lengths - 1] if n else data[:0]
    firsts = data[starts] if n else data[:0]
    pairs = len(set(zip(words, words[1:], strict=False)))
    letters = int(kind[2] + kind[3] + kind[7])
    total = len(data)
    share = counts[counts > 0] / max(total, 1)
    per_word = np.add.reduceat(~_LETTER[data] & (_KIND[data] != 1) & (_KIND[data] != 5), starts) if n else np.zeros(0)
    return [
        math.log1p(n), math.log1p(lengths.mean() if n else 0.0), math.log1p(lengths.std() if n else 0.0), _share(int(kind[2]), letters, 0.03), _share(int(kind[6]), total, 0.003), _share(int(kind[5]), total, 0.02),
        _share(int(kind[4]), total, 0.005), _share(int(kind[1]), total, 0.15), _share(int(kind[7]), total, 0.04), _share(len(seen), n, 0.8), _share(max(seen.values(), default=0), n, 0.06), _share(int((~_LETTER[lasts]).sum()), n, 0.12),
        _share(int((per_word > 0).sum()), n, 0.01), _share(int((lengths <= 3).sum()), n, 0.35), math.log1p(n / max(1, len(lines))), _share(len(lines) - len(set(lines)), len(lines), 0.02), _share(max(n - 1, 0) - pairs, max(n - 1, 0), 0.03),
        float(-(share * np.log2(share)).sum()), _share(int((_KIND[firsts] == 2).sum()), n, 0.12), math.log1p(int(lengths.max()) if n else 0),
    ]


@dataclass(frozen=True)
class Model:
    """Class means, inverse Cholesky factors and log-density constants for labels 0 and 1; or the prior alone."""

    prior: float
    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    constants: np.ndarray | None = None
    temperature: float = TEMPERATURE

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        logs = [c - 0.5 * np.square((x - m) @ f.T).sum(1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / self.temperature, -500, 500)))


def fitted(n: np.ndarray, sums: np.ndarray, products: np.ndarray, to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL, temperature: float = TEMPERATURE, few_rows: float = FEW_ROWS) -> Model:
    """The model from each class's number of rows, sum of vectors and sum of outer products."""
    prior = float(n[1] / n.sum()) if n.sum() else 0.5
    if n.min() < MINIMUM:
        return Model(prior)
    means = sums / n[:, None]
    scatter = products - n[:, None, None] * means[:, :, None] * means[:, None, :]
    own, pooled = scatter / n[:, None, None], scatter.sum(0) / n.sum()
    floor = 1e-6 + 1e-3 * np.diag(pooled)
    pooled = (1 - to_diagonal) * pooled + to_diagonal * np.diag(np.diag(pooled))
    factors, constants = [], []
    for k in range(2):
        share = max(to_pooled, few_rows * len(floor) / (few_rows * len(floor) + n[k]))
        lower = np.linalg.cholesky((1 - share) * own[k] + share * pooled + np.diag(floor))
        factors.append(np.linalg.inv(lower))
        constants.append(math.log(n[k] / n.sum()) - np.log(np.diag(lower)).sum())
    return Model(prior, means, np.array(factors), np.array(constants), temperature)


def _scan(docs: DataFrame, id_col: str, text_col: str, more: tuple[str, ...] = ()) -> DataFrame:
    """``_id``, ``_x`` and the columns ``more`` (longs) of every row."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in portions(batch, 1):
                found = [statistics(t) for t in strings(rows.column(1)).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(found, pa.list_(pa.float64())), *rows.columns[2:]], names=["_id", "_x", *more])

    return written(docs.select(F.col(id_col).cast("long"), F.col(text_col), *more).mapInArrow(scan, "_id long, _x array<double>" + "".join(f", {c} long" for c in more)), "quality-statistics")


def fit(statistics_: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Fits on all labelled rows of a table (``_id``, ``_x``)."""
    wanted = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y"))
    rows = statistics_.join(wanted, "_id").select("_y", "_x")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(FEATURES)
        n, first, second = np.zeros(2), np.zeros((2, width)), np.zeros((2, width, width))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            if not np.isin(y, (0, 1)).all():
                raise ValueError("labels must be 0 or 1")
            for k in range(2):
                own = x[y == k]
                n[k] += len(own)
                first[k] += own.sum(0)
                second[k] += own.T @ own
        flat = np.concatenate((n, first.ravel(), second.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["at", "v"])

    width = len(FEATURES)
    flat = np.zeros(2 + 2 * width + 2 * width**2)
    # Partial sums of each task, added up by place: as many rows come to the driver as the model has numbers.
    for at, v in rows.mapInArrow(sums, "at int, v double").groupBy("at").agg(F.sum("v")).collect():
        flat[at] = v
    return fitted(flat[:2], flat[2 : 2 + 2 * width].reshape(2, width), flat[2 + 2 * width :].reshape(2, width, width))


def scored(statistics_: DataFrame, model: Model, more: tuple[str, ...] = ()) -> DataFrame:
    """``_id``, ``score`` and the columns ``more`` for each row of a table (``_id``, ``_x``)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x)), *batch.columns[2:]], names=["_id", "score", *more])

    return statistics_.select("_id", "_x", *more).mapInArrow(score, "_id long, score double" + "".join(f", {c} long" for c in more))


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 when divided by 3; false without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """A row per document: ``doc_id``, ``held_out``, ``score``, ``predicted``. Learns from labels that aren't held out."""
    found = _scan(docs, id_col, text_col)
    model = fit(found, labels.where(~held_out(id_col)), id_col, label_col)
    return scored(found, model).select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows that score 0.5 or more, with all their columns."""
    docs, row = keyed(docs)
    found = _scan(docs, id_col, text_col, tuple(row))
    model = fit(found, labels.where(~held_out(id_col)), id_col, label_col)
    gone = scored(found, model, tuple(row)).where("score < 0.5").select(*row)
    return joined(docs, written(gone, "quality-rejected"), row, "left_anti", 32).drop(*row)
