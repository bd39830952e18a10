"""Vector stores as tables: top-k search, upsert, delete, payloads, an inverted-file index.

Higher scores are better everywhere. Payload conditions hold before the top k are taken, thresholds after. Ties go to the
smaller id.
"""

import functools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.filters import payload_matches
from millrace.functions.similarity import cosine_or_zero, inner_product, literal, normalised, similarity, squared_distance

#: Bytes of queries that one step sends to every task, and parts of a list of an inverted file, which its queries meet one by one.
BYTES, SALTS = 16 << 20, 8
METRICS = {"cosine": cosine_or_zero, "dot": inner_product, "l2": lambda a, b: -F.sqrt(squared_distance(a, b))}


def top_k(vectors: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", store: str | None = None, id_col: str = "id", vector_col: str = "vector", where: dict | None = None, payload_col: str = "payload") -> DataFrame:
    """The k rows most like the query, with ``score`` and ``rank`` from 1. One scan and a bounded heap per task."""
    rows = vectors.where(payload_matches(F.col(payload_col), where)) if where else vectors
    own = literal(query)
    score = similarity(F.col(vector_col), own, store, metric) if store else METRICS[metric](F.col(vector_col), own)
    best = rows.withColumn("score", score).orderBy(F.col("score").desc(), id_col).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), id_col)).cast("long"))


def above(found: DataFrame, threshold: float) -> DataFrame:
    """Results that reach a threshold; it counts after the top k."""
    return found.where(F.col("score") >= threshold)


def top_k_by_query(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector", query_id: str = "query_id", query_col: str = "query") -> DataFrame:
    """The k best rows for each query; ranks are limited before the shuffle.

    Queries are sent to every task only up to BYTES of them. A larger table is dealt into parts by its ids, which take
    their turns, so each step still sends a bounded table and keeps k rows a query.
    """
    order = Window.partitionBy(query_id).orderBy(F.col("score").desc(), id_col)

    def best(part: DataFrame) -> DataFrame:
        pairs = vectors.join(F.broadcast(part), how="cross").withColumn("score", METRICS[metric](F.col(vector_col), F.col(query_col)))
        return pairs.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)

    parts = -(-(queries.agg(F.sum(8 * F.size(query_col) + 64)).first()[0] or 0) // BYTES)
    if parts <= 1:
        return best(queries)
    found = [best(queries.where(F.pmod(F.xxhash64(query_id), F.lit(parts)) == i)) for i in range(parts)]
    return functools.reduce(DataFrame.union, found)


def top_k_per_group(scored: DataFrame, group: str, k: int, id_col: str = "id") -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.col("score").desc(), id_col)
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def upsert(old: DataFrame, new: DataFrame, id_col: str = "id") -> DataFrame:
    """All rows of ``new``, and those of ``old`` whose id it hasn't."""
    return old.join(new.select(id_col), id_col, "left_anti").unionByName(new)


def delete(vectors: DataFrame, ids: Sequence | None = None, where: dict | None = None, id_col: str = "id", payload_col: str = "payload") -> DataFrame:
    """Without the given ids and the rows whose payload matches; one of the two must be given."""
    if not ids and not where:
        raise ValueError("delete needs ids or a payload filter")
    gone = F.lit(False)
    if ids:
        gone |= F.coalesce(F.col(id_col).isin(list(ids)), F.lit(False))
    if where:
        gone |= payload_matches(F.col(payload_col), where)
    return vectors.where(~gone)


def update_payload(vectors: DataFrame, changes: DataFrame, id_col: str = "id", payload_col: str = "payload") -> DataFrame:
    """Merges maps of changes into map payloads, the new value winning."""
    merged = F.map_concat(F.map_filter(F.col(payload_col), lambda k, _: ~F.array_contains(F.map_keys("_change"), k)), F.col("_change"))
    rows = vectors.join(changes.select(id_col, F.col(payload_col).alias("_change")), id_col, "left")
    return rows.withColumn(payload_col, F.when(F.col("_change").isNull(), F.col(payload_col)).otherwise(merged)).drop("_change")


def cleared(vectors: DataFrame) -> DataFrame:
    """The store without its rows."""
    return vectors.where(F.lit(False))


def payloads_by_vector(vectors: DataFrame, query: Sequence[float], k: int, **options) -> DataFrame:
    return top_k(vectors, query, k, **options).where(F.col("payload").isNotNull()).select("rank", "payload")


def status(vectors: DataFrame, vector_col: str = "vector") -> DataFrame:
    """``vector_dim``, ``vector_count``."""
    return vectors.agg(F.max(F.size(vector_col)).cast("long").alias("vector_dim"), F.count(F.lit(1)).alias("vector_count"))


class InvertedFile:
    """Vectors by their nearest centroid; a search reads the lists of the ``probes`` centroids nearest the query.

    The centroids are fitted on ``sample`` vectors at most (smallest hash of the id), a documented bound; every vector is indexed.
    """

    def __init__(self, vectors: DataFrame, lists: int = 16, sample: int = 10_000, rounds: int = 10, id_col: str = "id", vector_col: str = "vector", seed: int = 0) -> None:
        self.id_col, self.vector_col = id_col, vector_col
        rows = vectors.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(sample).select(normalised(F.col(vector_col)).alias("v")).collect()
        x = np.array([r.v for r in rows])
        centres = x[: min(lists, len(x))].copy()
        for _ in range(rounds):
            near = (x @ centres.T).argmax(1)
            for j in range(len(centres)):
                if (near == j).any():
                    own = x[near == j].sum(0)
                    centres[j] = own / max(np.linalg.norm(own), 1e-10)
        self.centres = centres
        self.table = vectors.withColumn("list", self._nearest(F.col(vector_col)))

    def _nearest(self, v: Column) -> Column:
        own = normalised(v)
        scores = F.array(*[F.struct(inner_product(own, literal(c)).alias("s"), F.lit(-j).alias("j")) for j, c in enumerate(self.centres)])
        return (-F.array_max(scores)["j"]).cast("int")

    def search(self, query: Sequence[float], k: int, probes: int = 4) -> DataFrame:
        q = np.asarray(query, float)
        lists = np.argsort(-(self.centres @ (q / max(np.linalg.norm(q), 1e-10))), kind="stable")[:probes]
        return top_k(self.table.where(F.col("list").isin([int(j) for j in lists])), query, k, id_col=self.id_col, vector_col=self.vector_col)

    def search_by_query(self, queries: DataFrame, k: int, probes: int, query_id: str = "query_id", query_col: str = "query") -> DataFrame:
        """The k best rows for each query, of the lists of the ``probes`` centroids nearest it."""
        own = normalised(F.col(query_col))
        near = F.array_sort(F.array(*[F.struct((-inner_product(own, literal(c))).alias("s"), F.lit(j).alias("j")) for j, c in enumerate(self.centres)]))
        asked = queries.withColumn("_near", F.explode(F.transform(F.slice(near, 1, probes), lambda x: x["j"])))
        rows = self.table.withColumn("_salt", F.pmod(F.xxhash64(self.id_col), F.lit(SALTS)))
        asked = asked.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a large list isn't one task's
        pairs = rows.join(asked, (rows["list"] == asked["_near"]) & (rows["_salt"] == asked["_part"])).withColumn("score", cosine_or_zero(F.col(self.vector_col), F.col(query_col)))
        order = Window.partitionBy(query_id).orderBy(F.col("score").desc(), self.id_col)
        return pairs.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).drop("_near", "_salt", "_part")


class QuantisedFile(InvertedFile):
    """An inverted file whose rows carry short codes: of each of ``parts`` pieces of a unit vector, the nearest of ``codes`` fitted pieces.

    A search scores the codes in the probed lists, and takes exact scores of the ``refine`` * k best only, so whole vectors are read and
    moved for these alone. Pieces are fitted on the same bounded sample as the centroids; every vector has a code.
    """

    def __init__(self, vectors: DataFrame, lists: int = 16, parts: int = 16, codes: int = 64, sample: int = 10_000, rounds: int = 10, id_col: str = "id", vector_col: str = "vector", seed: int = 0) -> None:
        super().__init__(vectors, lists, sample, rounds, id_col, vector_col, seed)
        rows = vectors.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(sample).select(normalised(F.col(vector_col)).alias("v")).collect()
        x = np.array([r.v for r in rows])
        self.book = []
        for piece in np.array_split(x, min(parts, x.shape[1]), axis=1):
            centres = piece[np.linspace(0, len(piece) - 1, min(codes, 256, len(piece))).astype(int)].copy()
            for _ in range(rounds):
                near = _nearest_rows(piece, centres)
                for j in np.unique(near):
                    centres[j] = piece[near == j].mean(0)
            self.book.append(centres)
        self.table = self.table.withColumn("code", self._coded(normalised(F.col(vector_col))))

    def _coded(self, v: Column) -> Column:
        book = self.book

        @F.pandas_udf("binary")
        def of(values: pd.Series) -> pd.Series:
            x = np.array(values.tolist(), float).reshape(len(values), -1)
            pieces = np.array_split(x, len(book), axis=1)
            codes = np.stack([_nearest_rows(p, c) for p, c in zip(pieces, book, strict=True)], axis=1).astype(np.uint8)
            return pd.Series([c.tobytes() for c in codes])

        return of(v)

    def _approximate(self, code: Column, query: Column) -> Column:
        book = self.book

        @F.pandas_udf("double")
        def of(codes: pd.Series, queries: pd.Series) -> pd.Series:
            c = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), len(book))
            x = np.concatenate([b[c[:, m]] for m, b in enumerate(book)], axis=1)
            return pd.Series(np.einsum("ij,ij->i", x, np.array(queries.tolist(), float)))

        return of(code, query)

    def search(self, query: Sequence[float], k: int, probes: int = 4, refine: int = 8) -> DataFrame:
        one = self.table.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query_id int, query array<double>")
        return self.search_by_query(one, k, probes, refine=refine).drop("query_id", "query")

    def search_by_query(self, queries: DataFrame, k: int, probes: int, query_id: str = "query_id", query_col: str = "query", refine: int = 8) -> DataFrame:
        own = normalised(F.col(query_col))
        near = F.array_sort(F.array(*[F.struct((-inner_product(own, literal(c))).alias("s"), F.lit(j).alias("j")) for j, c in enumerate(self.centres)]))
        asked = queries.select(query_id, own.alias("_unit"), F.explode(F.transform(F.slice(near, 1, probes), lambda x: x["j"])).alias("list"))
        pairs = self.table.select(self.id_col, "list", "code").join(asked, "list").withColumn("_s", self._approximate(F.col("code"), F.col("_unit")))
        close = pairs.withColumn("_n", F.row_number().over(Window.partitionBy(query_id).orderBy(F.col("_s").desc(), self.id_col))).where(F.col("_n") <= refine * k).select(query_id, self.id_col)
        exact = close.join(self.table.drop("list", "code"), self.id_col).join(queries, query_id).withColumn("score", cosine_or_zero(F.col(self.vector_col), F.col(query_col)))
        order = Window.partitionBy(query_id).orderBy(F.col("score").desc(), self.id_col)
        return exact.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def _nearest_rows(x, centres):
    """For each row the number of the nearest centre."""
    return ((centres**2).sum(1) - 2 * (x @ centres.T)).argmin(1)
