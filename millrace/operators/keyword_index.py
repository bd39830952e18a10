"""A stored BM25 index: postings written once, appended to by batches, searched by one query or by a table of them without reading texts.

Documents are dealt into blocks of about BLOCK rows by a hash of their id. A posting is (block, term, doc, id, tf, dl); a segment holds the postings of a batch,
bucketed by block and sorted by term in it, so that a block's postings lie in one task and a search for few terms skips the pages
of others. Beside them a segment holds its terms (document frequency) and its *block maxima*: of each term and block the largest term
frequency and the shortest document, which bound what the term can add to a score there.

A search weighs its terms by the document frequencies of all segments and scores one block of each segment first. The k-th best score so far is
a floor: a query goes on to other blocks only where the sum of its terms' maxima reaches it. There, a block's scores are sums over the ranges
of its sorted postings, in Arrow; each gives its k best, so what is shuffled is k rows a query and block. Floors and bounds only spare work: results are those of
all blocks.

Defined cases: terms are the pieces between single spaces, empty ones included; a null text is one empty piece, a null query has no term. Documents without an id are
indexed and found, their id null and last among ties. Rows that repeat an id are documents of their own. Scores are rounded to 9 places before they are ranked, so equal texts tie
and the smaller id comes first. Documents without any term of the query aren't found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.dedup import _cut
from millrace.operators.retrieval import EPSILON, K1, B
from millrace.sources.segments import SegmentStore, union

#: Documents of a block; distinct query terms up to which they are looked up in the files' statistics.
BLOCK, NAMED = 4096, 500
_HITS = "query_id long, id long, score double"


class KeywordIndex:
    """The index at ``path``, empty at first; ``KeywordIndex(spark, path)`` opens it again."""

    def __init__(self, spark: SparkSession, path: str, block: int = BLOCK) -> None:
        self.spark, self.store, self.block, self._mean = spark, SegmentStore(spark, path), block, None

    @property
    def documents(self) -> int:
        return self.store.meta.get("documents", 0)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Indexes a batch; it is there for searches once this returns, as a whole."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("doc"), F.split(text, " ", -1).alias("terms"))
        each = rows.select("id", "doc", F.size("terms").cast("int").alias("dl"), F.explode("terms").alias("term")).groupBy("id", "doc", "dl", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
        n = docs.count()
        if n:
            blocks = -(-n // self.block)
            spread = F.pmod(F.xxhash64(F.coalesce("id", "doc")), F.lit(blocks)).cast("int")
            postings = self.store.add("postings", each.select(spread.alias("block"), "term", "doc", "id", "tf", "dl"), "block", ("block", "term"), blocks=blocks)
            folder = self.store.segments("postings")[-1]["folder"]
            maxima = postings.groupBy("block", "term").agg(F.max("tf").alias("tf"), F.min("dl").alias("dl"), F.count(F.lit(1)).alias("df"))
            maxima = self.store.add("maxima", maxima, "term", ("term",), of=folder)
            self.store.add("terms", maxima.groupBy("term").agg(F.sum("df").alias("df")), "term", ("term",), dealt=True)
            words = postings.agg(F.sum("tf")).first()[0]
            self.store.commit(documents=self.documents + n, words=self.store.meta.get("words", 0) + words)
        self._mean = None

    def _idf(self, df: Column) -> Column:
        return F.log(F.lit(self.documents) - df + 0.5) - F.log(df + 0.5)

    def _least(self) -> float:
        """What stands for a negative idf: a share of the mean over all terms."""
        if self._mean is None:
            df = self.store.rows("terms").groupBy("term").agg(F.sum("df").alias("df"))
            self._mean = df.agg(F.avg(self._idf(F.col("df")))).first()[0]
        return EPSILON * self._mean

    def search(self, query: str, k: int) -> DataFrame:
        """``id``, ``score``, ``rank`` of the k best documents for one query."""
        return self.search_many(self.spark.createDataFrame([(0, query)], "query_id long, query string"), k).drop("query_id")

    def search_many(self, queries: DataFrame, k: int, query_id: str = "query_id", query_col: str = "query") -> DataFrame:
        """``query_id``, ``id``, ``score``, ``rank``: the k best documents for each query."""
        if not self.documents:
            return self.spark.createDataFrame([], f"{_HITS}, rank long")
        weights = self._weights(queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(query_col).alias("query")))
        named = [r[0] for r in weights.select("term").distinct().limit(NAMED + 1).collect()]
        named = named if len(named) <= NAMED else None
        parts = list(zip(self.store.segments("postings"), self.store.tables("postings"), self.store.tables("maxima"), strict=True))
        first = [self._scored(postings.where("block = 0"), weights.withColumn("block", F.lit(0)), k, named) for _, postings, _ in parts]
        first = _cut(_kept(union(first), k))
        floors = first.groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("query_id", "floor")
        found = [first]
        for own, postings, maxima in parts:
            if own["blocks"] > 1:
                open_ = _cut(self._open(maxima, weights, floors))
                found.append(self._scored(postings.join(open_.select("block").distinct(), "block", "left_semi"), open_, k, named))
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        return union(found).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)

    def _weights(self, queries: DataFrame) -> DataFrame:
        """``query_id``, ``term``, ``weight``: how often a term stands in the query, times its idf; written, since it is read several times."""
        asked = queries.select("query_id", F.explode(F.split("query", " ", -1)).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("n"))
        df = self.store.rows("terms").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        known = _cut(asked.join(df, "term").select("query_id", "term", "n", self._idf(F.col("df")).alias("idf")))
        if known.where("idf < 0").isEmpty():
            return known.select("query_id", "term", (F.col("n") * F.col("idf")).alias("weight"))
        return known.select("query_id", "term", (F.col("n") * F.when(F.col("idf") < 0, F.lit(self._least())).otherwise(F.col("idf"))).alias("weight"))

    def _open(self, maxima: DataFrame, weights: DataFrame, floors: DataFrame) -> DataFrame:
        """Weights of the blocks behind the first in which a query's terms can reach its floor."""
        mean = self.store.meta["words"] / self.documents
        most = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / mean))
        reach = maxima.where("block > 0").join(weights, "term").groupBy("query_id", "block").agg(F.sum(F.greatest(F.col("weight") * most, F.lit(0.0))).alias("reach"))
        reach = reach.join(floors, "query_id", "left").where(F.col("floor").isNull() | (F.col("reach") * (1 + 1e-9) + 1e-8 >= F.col("floor"))).select("query_id", "block")
        return reach.join(weights, "query_id")

    def _scored(self, postings: DataFrame, weights: DataFrame, k: int, named: list[str] | None) -> DataFrame:
        """The k best documents of each block for each query that has weights (query_id, block, term, weight) there."""
        mean = self.store.meta["words"] / self.documents

        def score(left: pa.Table, right: pa.Table) -> pa.Table:
            out = _best(left, right, mean, k) if left.num_rows and right.num_rows else []
            columns = [np.concatenate([part[i] for part in out]) if out else np.zeros(0) for i in range(3)]
            missing = columns[1] == np.iinfo(np.int64).max
            return pa.Table.from_arrays([pa.array(columns[0].astype(np.int64)), pa.array(columns[1].astype(np.int64), mask=missing), pa.array(columns[2].astype(np.float64))], names=["query_id", "id", "score"])

        rows = postings if named is None else postings.where(F.col("term").isin(named))
        return rows.groupBy("block").cogroup(weights.groupBy("block")).applyInArrow(score, _HITS)


def _best(postings: pa.Table, weights: pa.Table, mean: float, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of one block, the k best documents of each query: query, id (the greatest number for none) and score."""
    terms = postings.column("term").combine_chunks().dictionary_encode()
    code = terms.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    doc, place = np.unique(postings.column("doc").to_numpy()[order], return_inverse=True)
    tf, dl = (postings.column(c).to_numpy()[order].astype(np.float64) for c in ("tf", "dl"))
    gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))
    ids = np.full(len(doc), np.iinfo(np.int64).max)
    ids[place] = postings.column("id").combine_chunks().fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)[order]
    begin = np.searchsorted(code[order], np.arange(len(terms.dictionary) + 1))
    asked = pc.fill_null(pc.index_in(weights.column("term").combine_chunks(), value_set=terms.dictionary), -1).to_numpy()
    query, weight = weights.column("query_id").to_numpy(), weights.column("weight").to_numpy()
    out = []
    by = np.lexsort((asked, query))
    by = by[asked[by] >= 0]
    for rows in np.split(by, np.nonzero(np.diff(query[by]))[0] + 1) if len(by) else []:
        start, end = begin[asked[rows]], begin[asked[rows] + 1]
        n = end - start
        at = np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        score = np.bincount(place[at], gain[at] * np.repeat(weight[rows], n), len(doc))
        hit = np.nonzero(np.bincount(place[at], minlength=len(doc)))[0]
        score = np.round(score[hit], 9)
        top = hit[(chosen := np.lexsort((ids[hit], -score))[:k])]
        out.append((np.full(len(top), query[rows[0]]), ids[top], score[chosen]))
    return out


def _kept(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return hits.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")

