"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.digests import edited_digests
from millrace.llm.divergence import audit
from millrace.llm.exact import exact_groups
from millrace.llm.minhash import similar_documents
from millrace.llm.mixing import mix
from millrace.llm.negatives import hard_negatives
from millrace.llm.packing import pack_documents
from millrace.llm.quality import classify
from millrace.llm.shared import table
from millrace.llm.pii import find_pii, listed
from millrace.llm.simhash import near_duplicates
from millrace.llm.substring import drop_repeats
from millrace.llm.token_files import read_token_files, write_token_files
from millrace.llm.warc import read_warc, write_warc


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies")


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, source_size * 3.0::DOUBLE AS cap, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM s),
fill AS (
  SELECT 0 AS step, (SELECT sum(source_size) FROM s)::DOUBLE / (SELECT sum(weight) FROM w) AS level
  UNION ALL
  SELECT step + 1, (SELECT (sum(source_size) - coalesce(sum(cap) FILTER (cap <= weight * level), 0))::DOUBLE / nullif(sum(weight) FILTER (cap > weight * level), 0) FROM w)
  FROM fill WHERE step < 200 AND level IS NOT NULL),
t AS (SELECT source, source_size, least(cap, coalesce(weight * (SELECT max(level) FROM fill), cap)) AS target FROM w),
sizes AS (SELECT source, size::DOUBLE AS s, count(*)::DOUBLE AS n FROM d WHERE size > 0 GROUP BY ALL),
halved AS (
  SELECT 0 AS step, t.source, target, least(0, ln(target / source_size) / min(s)) AS low, ln(3.0::DOUBLE) / min(s) AS high
  FROM t JOIN sizes ON t.source IS NOT DISTINCT FROM sizes.source WHERE target < source_size * 3.0::DOUBLE * (1 - 1e-12) GROUP BY t.source, target, source_size
  UNION ALL
  SELECT step + 1, source, target, CASE WHEN words < target THEN mid ELSE low END, CASE WHEN words < target THEN high ELSE mid END
  FROM (SELECT h.step, h.source, h.target, h.low, h.high, (h.low + h.high) / 2 AS mid, sum(n * s * CASE WHEN (h.low + h.high) / 2 * s < ln(3.0::DOUBLE) THEN exp((h.low + h.high) / 2 * s) ELSE 3 END) AS words
    FROM halved h JOIN sizes ON h.source IS NOT DISTINCT FROM sizes.source WHERE h.step < 80 GROUP BY ALL)),
tilt AS (SELECT source, (low + high) / 2 AS tilt FROM halved WHERE step = 80),
r AS (SELECT d.*, source_size, target,
    CASE WHEN size = 0 THEN 0 WHEN tilt IS NULL OR tilt * size >= ln(3.0::DOUBLE) THEN 3000000 ELSE floor(exp(tilt * size) * 1000000 + 0.5) END::BIGINT AS rate,
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN tilt ON d.source IS NOT DISTINCT FROM tilt.source),
run AS (SELECT *, (sum(rate) OVER (PARTITION BY source ORDER BY size, (doc_id % 1000000007 + 1000000007) % 1000000007 * 48271 % 2147483647 % 64 NULLS LAST, doc_id NULLS LAST ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM r),
c AS (SELECT *, (upto + 500000) // 1000000 - (upto - rate + 500000) // 1000000 AS copies FROM run),
offers AS (SELECT source, length(bin(size)) AS bits, size >> greatest(length(bin(size)) - 3, 0) AS lead, (doc_id % 4 + 4) % 4 AS part, any_value(target) AS target, sum(copies * size) AS taken,
    max({size: size, id: doc_id}) FILTER (size > 0 AND copies < 3) AS more, max({size: size, id: doc_id}) FILTER (size > 0 AND copies > 0) AS less
  FROM c GROUP BY ALL),
each AS (SELECT source, any_value(target) - sum(taken) AS missing, list(more ORDER BY more.size DESC, more.id DESC) FILTER (more IS NOT NULL) AS mores,
    list(less ORDER BY less.size DESC, less.id DESC) FILTER (less IS NOT NULL) AS lesses FROM offers GROUP BY source),
pick AS (SELECT source, sign(missing) AS change, unnest(list_reduce(
    [{rest: x.size::DOUBLE, ids: [x.id]} FOR x IN CASE WHEN missing > 0 THEN mores ELSE lesses END],
    lambda a, x: CASE WHEN x.rest <= a.rest THEN {rest: a.rest - x.rest, ids: list_concat(a.ids, x.ids)} ELSE a END, {rest: abs(missing)::DOUBLE, ids: []::BIGINT[]}).ids) AS doc_id
  FROM each)
SELECT c.doc_id, size, source_size, target, ((copies + coalesce(change, 0)) * size)::BIGINT AS taken
FROM c LEFT JOIN pick ON c.doc_id = pick.doc_id AND c.source IS NOT DISTINCT FROM pick.source
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    files = write_token_files(docs, path, end_id=2, spaces="dropped")
    return read_token_files(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_warc(spark, write_warc(table(spark, sf_dir, "pages")), payloads=False).drop("url", "payload")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS newest FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN newest END AS refers_to
FROM d
"""


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_digests(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), digest_all=True)


def packed(docs: DataFrame) -> DataFrame:
    pieces = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, longest=1024, spaces="leading")
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
o AS (SELECT doc, lang, source, unnest(terms) AS item FROM d),
kept AS (SELECT lang, item, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT doc) >= 10),
l AS (SELECT lang, item, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q FROM kept),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, item, count(*) AS n FROM o SEMI JOIN kept USING (lang, item) GROUP BY ALL),
dense AS (SELECT lang, source, item, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, item)),
p AS (SELECT lang, source, item, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER w + 2 * count(*) OVER w) AS p FROM dense WINDOW w AS (PARTITION BY lang, source)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.item = b.item AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p JOIN l USING (lang, item) WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 10
"""


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) < 2 THEN words ELSE list_distinct([words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))]) END AS shingles FROM d),
n AS (SELECT doc_id, shingles, len(shingles)::BIGINT AS n_shingles FROM s),
sets AS (SELECT min(doc_id) AS node, n_shingles, unnest(any_value(shingles)) AS shingle FROM n GROUP BY list_sort(shingles), n_shingles),
met AS (SELECT a.node AS u, b.node AS v, any_value(a.n_shingles) + any_value(b.n_shingles) AS total, count(*) AS shared
  FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.node < b.node AND 100 * a.n_shingles >= 80 * b.n_shingles AND 100 * b.n_shingles >= 80 * a.n_shingles GROUP BY ALL),
link AS (SELECT u, v FROM met WHERE 100 * shared >= 80 * (total - shared)),
ways AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reached AS (SELECT DISTINCT u AS node, u AS root FROM ways UNION SELECT ways.v, root FROM reached JOIN ways ON reached.node = ways.u WHERE root < ways.v),
roots AS (SELECT node, min(root) AS component FROM reached GROUP BY node),
classes AS (SELECT n.doc_id, n.n_shingles, CASE WHEN n.n_shingles = 0 THEN n.doc_id ELSE min(n.doc_id) OVER (PARTITION BY list_sort(n.shingles)) END AS node FROM n)
SELECT doc_id, n_shingles, coalesce(component, classes.node) AS component_id, doc_id = coalesce(component, classes.node) AS kept
FROM classes LEFT JOIN roots ON classes.node = roots.node AND n_shingles > 0
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label, F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS id, b.label, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM (FROM e WHERE vec_id % 100 = 0) a JOIN e b ON a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE label <> own AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5
"""

OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_quality": op2_quality,
    "op3_simhash": op3_simhash,
    "op4_mixing": op4_mixing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_token_files": op6_token_files,
    "op7_warc": op7_warc,
    "op8_fingerprints": op8_fingerprints,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_packing": op10_packing,
    "op11_divergence": op11_divergence,
    "op12_minhash": op12_minhash,
    "op13_hard_negatives": op13_hard_negatives,
}
SQL: dict[str, str] = {"op4_mixing": OP4_SQL, "op7_warc": OP7_SQL, "op9_exact_dedup": OP9_SQL, "op11_divergence": OP11_SQL, "op12_minhash": OP12_SQL, "op13_hard_negatives": OP13_SQL}
