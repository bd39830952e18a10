"""Keyword ranking (Okapi BM25), reciprocal rank fusion, hybrid and multi-collection retrieval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import keyword_hits
from millrace.operators.dedup import _cut

#: BM25 as publicly defined: saturation, length weight, and the share of the mean idf that stands for a negative idf.
K1, B, EPSILON = 1.5, 0.75, 0.25


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``term``, ``tf``, ``dl``: terms are the pieces between single spaces, empty ones included."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Lengths are taken below the explode: beside it they would be computed anew for every term.
    own = docs.select(F.col(id_col).alias("id"), (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long").alias("dl"), text.alias("text"))
    each = own.select("id", "dl", F.explode(F.split("text", " ", -1)).alias("term"))
    return each.groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25_scores(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``score`` of every document with a term of the query (repeated terms count as often as they stand).

    One scan, written off: texts are only searched for the query's few terms; lengths and document frequencies of these are sums. The mean idf, which
    replaces negative ones, needs the document frequency of every term and is computed only if a query term is in over half of the documents.
    """
    wanted: dict[str, int] = {}
    for term in query.split(" "):
        wanted[term] = wanted.get(term, 0) + 1
    names = list(wanted)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Between doubled spaces a term stands apart from its neighbours, so it can be counted by taking it out.
    apart = F.concat(F.lit(" "), F.replace(text, F.lit(" "), F.lit("  ")), F.lit(" "))
    count = lambda t: ((F.length(F.col("apart")) - F.length(F.replace(F.col("apart"), F.lit(f" {t} "), F.lit("")))) / (len(t) + 2)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("double").alias("dl"), F.explode(F.array(apart)).alias("apart"))
    rows = _cut(rows.select("id", "dl", F.explode(F.array(F.array(*[count(t) for t in names]))).alias("tf")))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean"), *[F.sum((F.col("tf")[i] > 0).cast("long")).alias(f"df{i}") for i in range(len(names))])
    idf = [F.log(F.col("n") - F.col(f"df{i}") + 0.5) - F.log(F.col(f"df{i}") + 0.5) for i in range(len(names))]
    counts = stats.first()
    stats = docs.sparkSession.createDataFrame([counts], stats.schema)
    if any(2 * counts[f"df{i}"] > counts["n"] for i in range(len(names))):
        per_term = postings(docs, id_col, text_col).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        floor = per_term.agg((F.avg(F.log(F.lit(counts["n"]) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)) * EPSILON).alias("floor"))
        stats = stats.crossJoin(F.broadcast(floor))
        idf = [F.when(x < 0, F.col("floor")).otherwise(x) for x in idf]
    part = lambda i: F.lit(wanted[names[i]]) * idf[i] * (F.col("tf")[i] * (K1 + 1)) / (F.col("tf")[i] + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    total = F.lit(0.0)
    for i in range(len(names)):
        total = total + part(i)
    hit = F.exists("tf", lambda t: t > 0)
    return rows.where(hit).crossJoin(F.broadcast(stats)).select("id", total.alias("score"))


def ranked(scored: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """The k best with ``rank`` from 1; fewer rows than k give all."""
    best = scored.orderBy(F.col("score").desc(), id_col).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), id_col)).cast("long"))


def bm25_top_k(docs: DataFrame, query: str, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return ranked(bm25_scores(docs, query, id_col, text_col), k)


def rank_fusion(vector: DataFrame, keyword: DataFrame, k: int, vector_weight: float = 0.8, keyword_weight: float = 0.2, smoothing: int = 60, key: str = "text") -> DataFrame:
    """Fuses two rankings (``key``, ``rank``): weight / (smoothing + rank) of each, nothing where a rank is missing.

    A key that stands twice counts with its last rank among the vectors and its first among the keywords.
    """
    v = vector.groupBy(key).agg(F.max("rank").alias("rv"))
    b = keyword.groupBy(key).agg(F.min("rank").alias("rb"))
    part = lambda w, r: F.coalesce(F.lit(float(w)) / (F.lit(smoothing) + F.col(r)), F.lit(0.0))
    fused = v.join(b, key, "full_outer").withColumn("score", part(vector_weight, "rv") + part(keyword_weight, "rb"))
    return ranked(fused, k, key).select(key, "score", "rank")


def hybrid(vector: DataFrame, keyword: DataFrame, k: int = 20, vector_k: int = 50, keyword_k: int = 50, threshold: float = 0.5, vector_weight: float = 0.8, keyword_weight: float = 0.2, smoothing: int = 60, key: str = "id") -> DataFrame:
    """Top k of the fusion of scored vectors (at least ``threshold``, after their top k) and scored keywords."""
    if max(vector_k, keyword_k) < k:
        raise ValueError("k must not be above both retrievers' top k")
    if min(vector_weight, keyword_weight) < 0:
        raise ValueError("weights must not be negative")
    v = ranked(vector, vector_k, key).where(F.col("score") >= threshold)
    return rank_fusion(v, ranked(keyword, keyword_k, key), k, vector_weight, keyword_weight, smoothing, key)


def with_message(found: DataFrame, message: str, text_col: str = "text") -> DataFrame:
    """The results, or one row that says there is none."""
    empty = found.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(*[(F.lit(message) if c == text_col else F.lit(None)).cast(t).alias(c) for c, t in found.dtypes])
    return found.unionByName(empty)


def merged(collections: Sequence[DataFrame], k: int) -> DataFrame:
    """Results of several collections by score, those without one last; the first k."""
    every = collections[0]
    for c in collections[1:]:
        every = every.unionByName(c)
    return every.orderBy(F.col("score").desc_nulls_last(), *[c for c in every.columns if c != "score"]).limit(k)


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n") -> DataFrame:
    """``id``, ``section_num`` (from 0), ``section``: the pieces that aren't blank."""
    pieces = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), separator)).alias("section_num", "section"))
    return pieces.where(F.trim("section") != "").withColumn("section_num", F.col("section_num").cast("long"))


def sections_by_keywords(docs: DataFrame, keywords: Sequence[str], k: int = 4, **options) -> DataFrame:
    """Of each document the k sections with the most keywords, earlier ones first among equals."""
    hits = sections(docs, **options).withColumn("hits", keyword_hits(F.col("section"), keywords)).where("hits > 0")
    order = Window.partitionBy("id").orderBy(F.col("hits").desc(), "section_num")
    return hits.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def files_by_hits(hits: DataFrame, pieces: DataFrame) -> DataFrame:
    """Distinct files of chunk hits (``file_path``, ``rank``, ``score``) in order of their best rank, each rebuilt from its pieces."""
    best = hits.groupBy("file_path").agg(F.min("rank").alias("rank"), F.max("score").alias("score"))
    return best.join(rebuilt(pieces), "file_path").orderBy("rank")


def rebuilt(pieces: DataFrame) -> DataFrame:
    """``file_path``, ``text``: each file from its numbered pieces."""
    parts = F.array_sort(F.collect_list(F.struct("piece_num", "text")))
    return pieces.groupBy("file_path").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def lexical_score(query: str, name: Column, description: Column, stars: Column) -> Column:
    """5 for a name, 3 for a description that holds the query, and a thousandth for each star."""
    hit = lambda c: F.coalesce(F.lower(c).contains(query.lower()), F.lit(False)).cast("double")
    return 5 * hit(name) + 3 * hit(description) + F.coalesce(stars, F.lit(0)) / 1000.0


def golden_answers(questions: DataFrame, golden: DataFrame, key: str = "question", answer: str = "answer") -> DataFrame:
    """Questions with the golden answer to each (the first by order of text, where one has several); a question without one raises."""
    known = golden.groupBy(key).agg(F.min(answer).alias("_answer"))
    missing = F.raise_error(F.concat(F.lit("no golden answer to: "), F.coalesce(F.col(key), F.lit("null")))).cast("string")
    return questions.join(known, key, "left").withColumn("golden", F.when(F.col("_answer").isNull(), missing).otherwise(F.col("_answer"))).drop("_answer")


def reranked(docs: DataFrame, scores: DataFrame, k: int, key: str = "id") -> DataFrame:
    """Documents in order of a model's scores; a document without a score is an error."""
    both = docs.join(scores.select(key, F.col("score").alias("_score")), key, "left")
    both = both.withColumn("score", F.when(F.col("_score").isNull(), F.raise_error(F.lit("documents and scores differ in number")).cast("double")).otherwise(F.col("_score"))).drop("_score")
    return ranked(both, k, key)
