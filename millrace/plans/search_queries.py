"""Queries over embeddings and keywords: vector stores, similarity joins, BM25, fusion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import similarity as S
from millrace.operators import dedup, retrieval, vector
from millrace.plans.catalog import query, table
from millrace.plans.index_queries import keyword_index

#: A query vector that needs no table: 64 numbers by rule.
PROBE = [((7 * i) % 13 - 6) / 10 for i in range(64)]
_Q = "[" + ", ".join(f"{x}::DOUBLE" for x in PROBE) + "]"
_DOT = "list_sum([x * y FOR x, y IN zip])"


def _dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


_V = "(SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
_COS = f"{_dot('v', _Q)} / nullif(sqrt({_dot('v', 'v')}) * sqrt({_dot(_Q, _Q)}), 0)"
_L2 = f"sqrt(list_sum([(v[i] - {_Q}[i]) * (v[i] - {_Q}[i]) FOR i IN range(1, 65)]))"


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("label"), F.to_json(F.struct("label")).alias("payload"))


def _top(score: str, k: int, where: str = "true") -> str:
    return f"SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, {score} AS score FROM {_V} WHERE {where}) ORDER BY score DESC, id LIMIT {k}"


def _shown(df):
    return df.select("id", F.round("score", 6).alias("score"), "rank")


for _metric, _sql in (("cosine", f"coalesce({_COS}, 0)"), ("dot", _dot("v", _Q)), ("l2", f"-{_L2}")):
    query(f"vec_topk_{_metric}", _top(_sql, 20))(lambda spark, d, m=_metric: _shown(vector.top_k(vectors(spark, d), PROBE, 20, m)))

for (_store, _metric), _ in S.CONVERSIONS.items():
    if _metric == "hamming":
        continue
    _d = {"cosine": f"(1 - coalesce({_COS}, 0))", "l2": _L2, "l2_squared": f"({_L2} * {_L2})", "dot": f"(-{_dot('v', _Q)})", "manhattan": f"list_sum([abs(v[i] - {_Q}[i]) FOR i IN range(1, 65)])"}[_metric]
    _c = {
        ("chroma", "cosine"): "greatest(0, 1 - {d} / 2)", ("chroma", "l2"): "1 / (1 + {d})", ("chroma", "dot"): "greatest(0, 1 - {d})", ("oceanbase", "cosine"): "least(1, greatest(0, 1 - {d}))", ("oceanbase", "l2"): "exp(-{d})",
        ("weaviate", "cosine"): "1 - {d} / 2", ("weaviate", "dot"): "1 / (1 + exp({d}))", ("weaviate", "l2_squared"): "1 / (1 + {d})", ("weaviate", "manhattan"): "1 / (1 + {d})", ("faiss", "l2_squared"): "1 / (1 + {d})", ("faiss", "dot"): "-{d}",
        ("surreal", "cosine"): "1 - {d}", ("milvus", "cosine"): "1 - {d}", ("pgvector", "cosine"): "1 - {d}", ("tidb", "cosine"): "1 - {d}",
    }[_store, _metric].format(d=_d)
    query(f"vec_{_store}_{_metric}", f"SELECT id, round({_c}, 6) AS score FROM {_V}")(
        lambda spark, d, s=_store, m=_metric: vectors(spark, d).select("id", F.round(S.similarity(F.col("vector"), S.literal(PROBE), s, m), 6).alias("score"))
    )


@query("vec_weaviate_hamming", f"SELECT id, round(1 - list_sum([(round(v[i], 1) <> {_Q}[i])::INT FOR i IN range(1, 65)]) / 64.0, 6)::DOUBLE AS score FROM {_V}")
def _(spark, d):
    coarse = F.transform("vector", lambda x: F.round(x.cast("double"), 1))
    return vectors(spark, d).select("id", F.round(S.similarity(coarse, S.literal(PROBE), "weaviate", "hamming"), 6).alias("score"))


@query("vec_topk_filtered", _top(f"coalesce({_COS}, 0)", 10, "label = 3"))
def _(spark, d):
    return _shown(vector.top_k(vectors(spark, d), PROBE, 10, where={"label": 3}))


@query("vec_topk_threshold", f"SELECT * FROM ({_top(f'coalesce({_COS}, 0)', 20)}) WHERE score >= 0.2")
def _(spark, d):
    return _shown(vector.above(vector.top_k(vectors(spark, d), PROBE, 20), 0.2)).where("score >= 0.2")


@query("vec_topk_per_label", f"SELECT id, label, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS rank FROM (SELECT id, label::BIGINT AS label, coalesce({_COS}, 0) AS score FROM {_V})) WHERE rank <= 3")
def _(spark, d):
    scored = vectors(spark, d).withColumn("score", S.cosine_or_zero(F.col("vector"), S.literal(PROBE)))
    return vector.top_k_per_group(scored, "label", 3).select("id", "label", F.round("score", 6).alias("score"), "rank")


@query("vec_topk_by_query", f"""
WITH q AS (SELECT id AS query_id, v AS q FROM {_V} WHERE id % 50 = 0), p AS (SELECT query_id, id, list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) AS score FROM {_V}, q)
SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p) WHERE rank <= 5""")
def _(spark, d):
    v = vectors(spark, d)
    found = vector.top_k_by_query(v, v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query")), 5)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("vec_normalize", f"SELECT id, round(v[1] / greatest(sqrt({_dot('v', 'v')}), 1e-10), 6) AS first, round(v[64] / greatest(sqrt({_dot('v', 'v')}), 1e-10), 6) AS last FROM {_V}")
def _(spark, d):
    n = S.normalised(F.col("vector"))
    return vectors(spark, d).select("id", F.round(n[0], 6).alias("first"), F.round(n[63], 6).alias("last"))


@query("vec_status", "SELECT 64::BIGINT AS vector_dim, count(*) AS vector_count FROM embeddings")
def _(spark, d):
    return vector.status(vectors(spark, d))


@query("vec_delete", "SELECT vec_id AS id FROM embeddings WHERE NOT (vec_id IN (1, 2, 3) OR label = 5)")
def _(spark, d):
    return vector.delete(vectors(spark, d), [1, 2, 3], {"label": 5}).select("id")


@query("vec_upsert", "SELECT vec_id + 100 AS id, (label + 1)::BIGINT AS label FROM embeddings UNION ALL SELECT vec_id, label::BIGINT FROM embeddings WHERE vec_id < 100")
def _(spark, d):
    v = vectors(spark, d).select("id", "label")
    return vector.upsert(v, v.select((F.col("id") + 100).alias("id"), (F.col("label") + 1).alias("label"))).where("id >= 0")


@query("vec_payloads", f"SELECT rank, json_object('label', label)::VARCHAR AS payload FROM (SELECT label, row_number() OVER (ORDER BY coalesce({_COS}, 0) DESC, id) AS rank FROM {_V}) WHERE rank <= 8")
def _(spark, d):
    return vector.payloads_by_vector(vectors(spark, d), PROBE, 8)


@query("vec_payload_merge", "SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN 'new' ELSE 'old' END AS state, label::VARCHAR AS label FROM embeddings")
def _(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.create_map(F.lit("state"), F.lit("old"), F.lit("label"), F.col("label").cast("string")).alias("payload"))
    done = vector.update_payload(v, v.where("id % 2 = 0").select("id", F.create_map(F.lit("state"), F.lit("new")).alias("payload")))
    return done.select("id", F.col("payload")["state"].alias("state"), F.col("payload")["label"].alias("label"))


#: Lists of the index and lists read for a query: a recall of 0.9 at least (tests/test_index_recall.py).
LISTS, PROBES = 16, 12


@query("vec_inverted_file")
def _(spark, d):
    v = vectors(spark, d)
    asked = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    found = vector.InvertedFile(v, LISTS).search_by_query(asked, 20, PROBES)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("vec_quantised_file")
def _(spark, d):
    v = vectors(spark, d)
    asked = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    found = vector.QuantisedFile(v, LISTS).search_by_query(asked, 20, PROBES)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_PAIRS = f"(SELECT a.id AS a, b.id AS b, list_dot_product(a.v, b.v) / nullif(sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)), 0) AS s FROM {_V} a JOIN {_V} b ON b.id < a.id)"


@query("dedup_top1", f"SELECT a AS id, arg_max(b, s) AS target, round(max(s), 6) AS similarity FROM {_PAIRS} WHERE s > 0.3 GROUP BY a")
def _(spark, d):
    found = dedup.best_earlier(vectors(spark, d), 0.3, "id", "vector")
    return found.select(F.col("idx").alias("id"), "target", F.round("similarity", 6).alias("similarity"))


@query("dedup_rows", f"SELECT id, t.b AS duplicate_of, t.b IS NULL AS is_unique FROM {_V} v LEFT JOIN (SELECT a, arg_max(b, s) AS b FROM {_PAIRS} WHERE s > 0.3 GROUP BY a) t ON v.id = t.a WHERE t.b IS NOT NULL")
def _(spark, d):
    return dedup.deduplicate(vectors(spark, d), 0.3, "id", "vector").where("duplicate_of IS NOT NULL").select("id", "duplicate_of", "is_unique")


@query("near_dup_pairs", f"SELECT a, b, round(s, 6) AS similarity FROM {_PAIRS} WHERE s >= 0.3")
def _(spark, d):
    return dedup.similarity_links(vectors(spark, d), 0.3, "id", "vector").select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("dedup_greedy", f"""
WITH RECURSIVE e AS (SELECT row_number() OVER (ORDER BY id) AS i, id, v, sqrt({_dot('v', 'v')}) AS norm FROM {_V}),
l AS (SELECT a.i, list(b.i) AS near FROM e a JOIN e b ON b.i < a.i AND {_dot('a.v', 'b.v')} >= 0.3 * a.norm * b.norm GROUP BY a.i),
n AS (SELECT e.i, coalesce(near, []::BIGINT[]) AS near FROM e LEFT JOIN l USING (i)),
g AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT n.i, CASE WHEN list_has_any(kept, near) THEN kept ELSE list_append(kept, n.i) END FROM g JOIN n ON n.i = g.i + 1)
SELECT id FROM e WHERE i IN (SELECT unnest(kept) FROM (SELECT kept FROM g ORDER BY i DESC LIMIT 1))""")
def _(spark, d):
    return dedup.greedy_kept(vectors(spark, d), 0.3, "id", "vector")


_HALF = "SELECT vec_id AS id, label, embedding[1:32]::DOUBLE[] AS x, embedding[33:64]::DOUBLE[] AS y FROM embeddings"


@query("weighted_sim_edges", f"""
WITH h AS ({_HALF}), p AS (SELECT a.id AS src, b.id AS dst, 0.4 * list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x)))
  + 0.6 * list_dot_product(a.y, b.y) / (sqrt(list_dot_product(a.y, a.y)) * sqrt(list_dot_product(b.y, b.y))) AS w FROM h a JOIN h b ON a.id < b.id AND a.label <> b.label)
SELECT src, dst, round(w, 4) AS weight FROM p WHERE w >= 0.35""")
def _(spark, d):
    half = table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("label").alias("file_id"), F.slice("embedding", 1, 32).alias("abstract"), F.slice("embedding", 33, 32).alias("core"))
    return dedup.weighted_links(half, {"abstract": 0.4, "core": 0.6}, 0.35)


_QUERY = "license the passage"
_TERMS = "string_split(coalesce(text, ''), ' ')"


_BM25 = f"""
WITH t AS (SELECT doc_id AS id, {_TERMS} AS terms FROM documents), n AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM t),
each AS (SELECT id, len(terms) AS dl, unnest(terms) AS term FROM t), p AS (SELECT id, any_value(dl) AS dl, term, count(*) AS tf FROM each GROUP BY id, term),
i AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM p, n GROUP BY term, n), f AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM i) ELSE idf END AS idf FROM i),
s AS (SELECT id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) AS score FROM p JOIN f USING (term), n WHERE term IN ('license', 'the', 'passage') GROUP BY id)"""


@query("bm25_topk", f"""{_BM25}
SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s ORDER BY score DESC, id LIMIT 50""")
def _(spark, d):
    return _shown(keyword_index(spark, d).search(_QUERY, 50))


@query("rrf_fusion", """
WITH v AS (SELECT doc_id AS text, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 50), b AS (SELECT doc_id AS text, row_number() OVER (ORDER BY length(coalesce(source, '')) DESC, doc_id) AS rank FROM documents WHERE lang <> 'en' QUALIFY rank <= 50),
f AS (SELECT coalesce(v.text, b.text) AS text, coalesce(0.8 / (60 + v.rank), 0) + coalesce(0.2 / (60 + b.rank), 0) AS score FROM v FULL JOIN b ON v.text = b.text)
SELECT text AS id, round(score, 9) AS score, row_number() OVER (ORDER BY score DESC, text) AS rank FROM f ORDER BY score DESC, text LIMIT 20""")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("text"), "n_chars", F.length(F.coalesce("source", F.lit(""))).alias("l"), "lang")
    v = retrieval.ranked(docs.withColumn("score", F.col("n_chars")), 50, "text").select("text", "rank")
    b = retrieval.ranked(docs.where("lang <> 'en'").withColumn("score", F.col("l")), 50, "text").select("text", "rank")
    return retrieval.rank_fusion(v, b, 20).select(F.col("text").alias("id"), F.round("score", 9).alias("score"), "rank")


@query("hybrid_retrieval", f"""{_BM25},
v AS (SELECT id, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, coalesce({_COS}, 0) AS score FROM {_V})) WHERE rank <= 50 AND score >= 0.1),
b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 50),
h AS (SELECT coalesce(v.id, b.id) AS id, coalesce(0.8 / (60 + v.rank), 0) + coalesce(0.2 / (60 + b.rank), 0) AS score FROM v FULL JOIN b ON v.id = b.id)
SELECT id, round(score, 9) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM h ORDER BY score DESC, id LIMIT 20""")
def hybrid_retrieval(spark, d):
    """Documents by their embedding and by their words, fused."""
    by_vector = vectors(spark, d).select("id", S.cosine_or_zero(F.col("vector"), S.literal(PROBE)).alias("score"))
    found = retrieval.hybrid(by_vector, keyword_index(spark, d).search(_QUERY, 50).select("id", "score"), 20, threshold=0.1)
    return found.select("id", F.round("score", 9).alias("score"), "rank")


@query("multi_collection_merge", "SELECT id, origin, score FROM (SELECT doc_id AS id, 'documents' AS origin, n_chars::DOUBLE AS score FROM documents UNION ALL SELECT item_id, 'benchmark', NULL FROM benchmark) ORDER BY score DESC NULLS LAST, id, origin LIMIT 25")
def _(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("documents").alias("origin"), F.col("n_chars").cast("double").alias("score"))
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("origin"), F.lit(None).cast("double").alias("score"))
    return retrieval.merged([a, b], 25)


@query("file_rebuild", "SELECT conv_id AS file_path, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def _(spark, d):
    return retrieval.rebuilt(table(spark, d, "conversations").select(F.col("conv_id").alias("file_path"), F.col("turn").alias("piece_num"), F.coalesce("text", F.lit("")).alias("text")))


@query("chunk_hits_to_files", "SELECT conv_id AS file_path, min(rank) AS rank FROM (SELECT conv_id, row_number() OVER (ORDER BY length(text) DESC, conv_id, turn) AS rank FROM conversations WHERE text IS NOT NULL) WHERE rank <= 100 GROUP BY conv_id")
def _(spark, d):
    c = table(spark, d, "conversations").where("text IS NOT NULL")
    best = c.select("conv_id", "turn", F.length("text").alias("score")).orderBy(F.col("score").desc(), "conv_id", "turn").limit(100)
    hits = best.select(F.col("conv_id").alias("file_path"), "score", F.row_number().over(Window.orderBy(F.col("score").desc(), "conv_id", "turn")).cast("long").alias("rank"))
    return retrieval.files_by_hits(hits, c.select(F.col("conv_id").alias("file_path"), F.col("turn").alias("piece_num"), "text")).select("file_path", "rank")


@query("lexical_search", "SELECT p_partkey AS id, round(5 * contains(lower(p_name), 're')::INT + 3 * contains(lower(p_type), 're')::INT + p_size / 1000.0, 6) AS score, row_number() OVER (ORDER BY 5 * contains(lower(p_name), 're')::INT + 3 * contains(lower(p_type), 're')::INT + p_size / 1000.0 DESC, p_partkey) AS rank FROM part ORDER BY rank LIMIT 5")
def _(spark, d):
    scored = table(spark, d, "part").select(F.col("p_partkey").alias("id"), retrieval.lexical_score("re", F.col("p_name"), F.col("p_type"), F.col("p_size")).alias("score"))
    return _shown(retrieval.ranked(scored, 5))


@query("attribute_top1", "SELECT label::BIGINT AS label, arg_min(vec_id, -embedding[1]) AS id FROM embeddings GROUP BY label")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding")[0].alias("score"))
    return vector.top_k_per_group(e, "label", 1).select("label", "id")


@query("embedding_cache_misses", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.text = d.text)")
def _(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "benchmark").select("text"), "text", "left_anti").select("doc_id")
