"""Vector arithmetic and the conversions from distances to similarities; all in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def inner_product(a: Column, b: Column) -> Column:
    """Sum of products; arrays of different lengths raise."""
    a, b = doubles(a), doubles(b)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double")).otherwise(F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null where a norm is zero."""
    return inner_product(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def cosine_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(cosine(a, b), F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column, floor: float = 1e-10) -> Column:
    """The vector over its norm, which counts as ``floor`` at least."""
    length = F.greatest(norm(v), F.lit(floor))
    return F.transform(doubles(v), lambda x: x / length)


def distance(a: Column, b: Column, metric: str) -> Column:
    """Distances by name: cosine (1 - cos), l2, l2_squared, dot (negated), manhattan, hamming."""
    if metric == "cosine":
        return 1 - cosine_or_zero(a, b)
    if metric in ("l2", "euclidean"):
        return F.sqrt(squared_distance(a, b))
    if metric == "l2_squared":
        return squared_distance(a, b)
    if metric == "dot":
        return -inner_product(a, b)
    if metric == "manhattan":
        return manhattan(a, b)
    if metric == "hamming":
        return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda x: x)).cast("double")
    raise ValueError(f"unknown metric {metric!r}")


#: How each kind of store turns a distance into a similarity: (store, metric) to a function of distance and dimension.
CONVERSIONS = {
    ("chroma", "cosine"): lambda d, n: F.greatest(F.lit(0.0), 1 - d / 2),
    ("chroma", "l2"): lambda d, n: 1 / (1 + d),
    ("chroma", "dot"): lambda d, n: F.greatest(F.lit(0.0), 1 - d),
    ("oceanbase", "cosine"): lambda d, n: F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - d)),
    ("oceanbase", "l2"): lambda d, n: F.exp(-d),
    ("weaviate", "cosine"): lambda d, n: 1 - d / 2,
    ("weaviate", "dot"): lambda d, n: 1 / (1 + F.exp(d)),
    ("weaviate", "l2_squared"): lambda d, n: 1 / (1 + d),
    ("weaviate", "manhattan"): lambda d, n: 1 / (1 + d),
    ("weaviate", "hamming"): lambda d, n: 1 - d / n,
    ("faiss", "l2_squared"): lambda d, n: 1 / (1 + d),
    ("faiss", "dot"): lambda d, n: -d,
    ("surreal", "cosine"): lambda d, n: 1 - d,
    ("milvus", "cosine"): lambda d, n: 1 - d,
    ("pgvector", "cosine"): lambda d, n: 1 - d,
    ("tidb", "cosine"): lambda d, n: 1 - d,
}


def similarity(a: Column, b: Column, store: str, metric: str) -> Column:
    if (store, metric) not in CONVERSIONS:
        raise ValueError(f"{store} has no metric {metric!r}")
    return CONVERSIONS[store, metric](distance(a, b, metric), F.size(a).cast("double"))


def literal(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])
