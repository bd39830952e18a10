"""Hard negatives against brute force; bounds that never discard a pair within the limits."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def mined(df, **options):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = negatives.hard_negatives(df, "vec_id", "embedding", label, F.col("vec_id") % 100 == 0, **options).collect()
    none = lambda i: -1 if i is None else i
    return sorted((r.anchor_id, none(r.positive_id), r["rank"], none(r.negative_id), r.positive_score, r.negative_score) for r in rows)


def brute(rows):
    """Rows are told apart by their place; an id of None comes last."""
    own = []
    for i, v, label in rows:
        if v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    order = lambda s, i: (-s, math.inf if i is None else i)
    for a, (i, label, v) in enumerate(own):
        if i is None or i % 100:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=False)), j, other) for b, (j, other, w) in enumerate(own) if b != a]
        positives = sorted([(s, j) for s, j, other in scored if other == label], key=lambda p: order(*p))[:5]
        against = sorted([(s, j) for s, j, other in scored if other != label], key=lambda p: order(*p))
        for s, j in positives:
            fit = [(t, k) for t, k in against if 80 * s <= 100 * t <= 100 * s][:5]
            out += [(i, -1 if j is None else j, n, -1 if k is None else k, s, t) for n, (t, k) in enumerate(fit, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 24))
    out = []
    for i in range(900):
        v = centres[rng.integers(6)] + 0.5 * rng.normal(size=24) * np.linspace(2, 0.05, 24)
        out.append((i, [float(x) for x in v / np.linalg.norm(v)], int(rng.integers(10))))
    out += [(1000, None, 1), (1100, [0.5] * 24, None), (1200, [float("nan")] * 24, 1), (1201, [float("inf")] + [0.0] * 23, 1), (1300, [None] * 24, 1), (1400, [], 3), (1401, [0.25] * 5, 3), (None, [0.1] * 24, 2), (None, out[5][1], out[5][2])]
    out += [(2000 + i, out[100][1], out[100][2]) for i in range(30)] + [(3000 + i, out[100][1], (out[100][2] + 3) % 10) for i in range(30)] + [(4000, [0.0] * 24, 3)]
    return out


@pytest.mark.parametrize("block", [(negatives.ROWS, negatives.ANCHORS), (50, 3)])
def test_equals_brute_force(spark, rows, block):
    want = brute(rows)
    assert len(want) > 100
    assert mined(spark.createDataFrame(rows, SCHEMA), block=block) == want


def test_rows_that_repeat_an_id_and_nothing(spark):
    rows = [(100, [1.0, 0.5], 1), (100, [1.0, 0.5], 1), (3, [0.9, 0.5], 1), (4, [0.9, 0.4], 2), (4, [0.9, 0.4], 2)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows) and brute(rows)
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(1, [1.0], 1)], SCHEMA)) == []


def test_wide_tables(spark, rows):
    df = spark.createDataFrame(rows[:300], SCHEMA)
    wide = df.select("*", *[F.lit(7).alias(c) for c in ("id", "key", "v", "anchor", "rows", "by", "positives", "score", "rank")])
    assert mined(wide) == mined(df)


@pytest.mark.parametrize("scale", [1, 40_000])
def test_bounds_lose_nothing_and_spare_work(scale):
    rng = np.random.default_rng(2)
    base = (rng.normal(size=(400, 32)) * np.linspace(90, 1, 32)).astype(np.int64) * scale
    v, anchors = base, base[:20]
    moments = (v.T @ v).astype(float)
    axes = np.linalg.eigh(moments)[1][:, ::-1].copy()
    exact = v @ anchors.T
    low = np.sort(exact, 0)[-5]
    high = np.sort(exact, 0)[-2]
    b = negatives.Bounded(axes, 32)
    row, anchor, score = b.within(b.turned(v), b.turned(anchors), slice(0, 400), low, high, np.ones((400, 20), bool))
    want = {(i, j) for i, j in zip(*np.nonzero((exact >= low) & (exact <= high)), strict=True)}
    assert set(zip(row.tolist(), anchor.tolist(), strict=True)) == want and (score == exact[row, anchor]).all()
    assert b.finished < 0.2 * exact.size  # most products are never finished
    y, z = v @ axes, anchors @ axes
    assert (np.abs(y @ z.T - exact) <= negatives.slack(axes, 32) * np.outer(np.linalg.norm(y, axis=1), np.linalg.norm(z, axis=1)) + 1e-6).all()
