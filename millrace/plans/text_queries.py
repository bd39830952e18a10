"""Queries over texts: filters, cleaners, extractors, curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import filters as P
from millrace.functions import text as T
from millrace.operators import curation, retrieval
from millrace.plans.catalog import query, table

_WORDS = "len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\s\\x0B\\x85\\p{Z}]+'), lambda x: x <> ''))"
_TRIM = r"regexp_replace(regexp_replace({0}, '^[\s\x0B\x85\p{{Z}}]+', ''), '[\s\x0B\x85\p{{Z}}]+$', '')"


def _trim(x: str) -> str:
    return _TRIM.format(x)


@query("filter_length", f"SELECT doc_id, {_WORDS}::BIGINT AS n_words, coalesce({_WORDS} BETWEEN 5 AND 200, false) AS ok FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", P.word_count(F.col("text")).alias("n_words"), P.length_ok(F.col("text")).alias("ok"))


@query("filter_keyword", "SELECT doc_id FROM documents WHERE NOT (contains(lower(text), 'password') OR contains(lower(text), 'cc by'))")
def _(spark, d):
    return table(spark, d, "documents").where(P.keyword_ok(F.col("text"), ["Password", "CC BY"])).select("doc_id")


@query("filter_punctuation", r"SELECT doc_id, coalesce(NOT regexp_matches(text, '^[^\p{L}\p{M}\p{N}_\s\x0B\x85\p{Z}]'), false) AS ok FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", P.punctuation_ok(F.col("text")).alias("ok"))


@query("filter_non_english", "SELECT doc_id FROM documents WHERE regexp_matches(text, '^[A-Za-z]')")
def _(spark, d):
    return table(spark, d, "documents").where(P.english_start_ok(F.col("text"))).select("doc_id")


@query("filter_reward", "SELECT l.doc_id FROM labels l WHERE quality - 0.25 * toxic >= 0.7")
def _(spark, d):
    return table(spark, d, "labels").where(P.score_ok(F.col("quality") - 0.25 * F.col("toxic"))).select("doc_id")


@query("filter_failed_names", f"""
SELECT doc_id, array_to_string(list_filter([CASE WHEN NOT {_WORDS} BETWEEN 5 AND 200 THEN 'length' END, CASE WHEN coalesce(contains(lower(text), 'password'), true) THEN 'keyword' END,
  CASE WHEN NOT coalesce(regexp_matches(text, '^[A-Za-z]'), false) THEN 'non_english' END], lambda x: x IS NOT NULL), ',') AS failed FROM documents""")
def _(spark, d):
    own = P.InstructionFilter({"length": {}, "keyword": {"keywords": ["password"]}, "non_english": {}})
    return table(spark, d, "documents").select("doc_id", F.array_join(own.failed(F.col("text")), ",").alias("failed"))


@query("filter_first_failure", f"""
SELECT doc_id, CASE WHEN NOT {_WORDS} BETWEEN 5 AND 200 THEN 'length' WHEN NOT coalesce(regexp_matches(text, '^[A-Za-z]'), false) THEN 'non_english' ELSE '' END AS failed FROM documents""")
def _(spark, d):
    own = P.InstructionFilter({"length": {}, "non_english": {}}, stop_on_first_failure=True)
    return table(spark, d, "documents").select("doc_id", F.array_join(own.failed(F.col("text")), ",").alias("failed"))


_QUALITY = r"(length({0}) - length(replace({0}, '.', '')) >= 2 AND (length({0}) - length(regexp_replace({0}, '[^\p{{L}}\p{{N}}\s\x0B\x85\p{{Z}}]', '', 'g'))) / nullif(length({0}), 0)::DOUBLE <= 0.3)"


@query("text_quality", f"SELECT doc_id, coalesce({_QUALITY.format('text')}, false) AS ok FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", P.text_quality_ok(F.col("text")).alias("ok"))


@query("text_preprocess", f"WITH t AS (SELECT doc_id, {_trim('text')} AS t FROM documents) SELECT doc_id, CASE WHEN length(t) BETWEEN 50 AND 512 AND {_QUALITY.format('t')} THEN t ELSE '' END AS clean FROM t")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", P.preprocessed(F.col("text")).alias("clean"))


_FAILS = " OR ".join([f"contains(lower(t), '{x}')" for x in P.FAILURE_PHRASES] + [f"starts_with(lower(t), '{x}')" for x in P.FAILURE_STARTS])


@query("task_validation", f"WITH t AS (SELECT conv_id, turn, {_trim('text')} AS t FROM conversations) SELECT conv_id, turn, coalesce(t <> '' AND length(t) >= 10 AND NOT ({_FAILS}), false) AS ok FROM t")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", P.task_content_ok(F.col("text"), 10, output=True).alias("ok"))


#: Results that own up to a failure in different ways, or are blank, beside plain ones.
_RESULTS = f"(SELECT conv_id, turn, CASE conv_id % 6 WHEN 0 THEN ' ' || chr(9) WHEN 1 THEN '  {P.FAILURE_STARTS[0].upper()}: ' || text WHEN 2 THEN text || ' {P.FAILURE_PHRASES[0]}' WHEN 3 THEN NULL ELSE text END AS text FROM conversations)"


@query("task_result_insufficient", f"WITH t AS (SELECT conv_id, turn, {_trim('text')} AS t FROM {_RESULTS}) SELECT conv_id, turn FROM t WHERE NOT coalesce(t <> '' AND NOT ({_FAILS}), false)")
def _(spark, d):
    kind, text = F.col("conv_id") % 6, F.col("text")
    said = F.when(kind == 0, " \t").when(kind == 1, F.concat(F.lit(f"  {P.FAILURE_STARTS[0].upper()}: "), text)).when(kind == 2, F.concat(text, F.lit(f" {P.FAILURE_PHRASES[0]}"))).when(kind > 3, text)
    return table(spark, d, "conversations").where(~P.task_content_ok(said, 1, output=True)).select("conv_id", "turn")


@query("payload_filter", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '1' OR (event_type = 'click' AND json_valid(props))")
def _(spark, d):
    return table(spark, d, "events").where(P.payload_matches(F.col("props"), {"k": 1}) | ((F.col("event_type") == "click") & F.try_parse_json("props").isNotNull())).select("event_id")


@query("newlines_stripped", r"SELECT doc_id, regexp_replace(text, '[\s\x0B\x85\p{Z}]*\n[\s\x0B\x85\p{Z}]*', chr(10), 'g') AS clean FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.newlines_stripped(F.col("text")).alias("clean"))


@query("clean_whitespace", f"SELECT doc_id, {_trim('x')} AS clean FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '[\\x{{00a0}}\\n]', ' ', 'g'), ' {{2,}}', ' ', 'g') AS x FROM documents)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.cleaned(F.col("text"), ["clean_extra_whitespace"]).alias("clean"))


@query("clean_chain", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x{2018}\x{2019}\x{201a}\x{201b}]', '''', 'g'), '[\x{201c}\x{201d}\x{201e}\x{201f}]', '\"', 'g'), '[^\x00-\x7f]', '', 'g'), '\p{P}', '', 'g') AS clean FROM documents".replace('\\"', '"'))
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.cleaned(F.col("text"), ["replace_unicode_quotes", "clean_non_ascii_chars", "remove_punctuation"]).alias("clean"))


@query("extract_emails", "SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}')) AS email FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(T.extracted(F.col("text"), "extract_email_address")).alias("email"))


@query("extract_ips", r"SELECT doc_id, unnest(regexp_extract_all(text, '\b\d{1,3}(?:[.]\d{1,3}){3}\b')) AS ip FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(T.extracted(F.col("text"), "extract_ip_address")).alias("ip"))


@query("extract_phone", r"SELECT doc_id, regexp_extract(text, '(?:\+?1[ -]?)?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}', 0) AS phone FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.extracted(F.col("text"), "extract_us_phone_number").alias("phone"))


@query("first_integer", r"SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '(\d+)', 1), '') AS BIGINT) AS n FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.first_int(F.col("text")).alias("n"))


@query("answer_scoring", r"""
WITH a AS (SELECT o_orderkey, '$' || o_orderkey::VARCHAR AS answer, (o_orderkey + (o_orderkey % 2))::VARCHAR AS truth, o_orderpriority AS s, upper(replace(o_orderpriority, '-', ' ')) AS t FROM orders)
SELECT o_orderkey, replace(answer, '$', '')::DOUBLE = truth::DOUBLE AS number_ok, regexp_replace(lower(regexp_replace(s, '\s', '', 'g')), '[!-/:-@\[-`{-~]', '', 'g') = regexp_replace(lower(regexp_replace(t, '\s', '', 'g')), '[!-/:-@\[-`{-~]', '', 'g') AS text_ok FROM a""")
def _(spark, d):
    o = table(spark, d, "orders")
    key, pri = F.col("o_orderkey"), F.col("o_orderpriority")
    return o.select("o_orderkey", T.answer_correct(F.concat(F.lit("$"), key.cast("string")), (key + key % 2).cast("string")).alias("number_ok"), T.answer_correct(pri, F.upper(F.replace(pri, F.lit("-"), F.lit(" ")))).alias("text_ok"))


@query("normalized_text", r"SELECT doc_id, sha256(lower(regexp_replace(text, '[\s\x0B\x85\p{Z}]', '', 'g'))) AS digest FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.plain(F.col("text"), punctuation=True), 256).alias("digest"))


@query("final_answers", "SELECT doc_id, CASE WHEN contains(x, 'FINAL ANSWER') THEN trim(substr(x, strpos(x, 'FINAL ANSWER') + 14)) ELSE 'FINAL ANSWER not found' END AS answer FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'so FINAL ANSWER: ' || n_chars ELSE 'none' END AS x FROM documents)")
def _(spark, d):
    x = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("so FINAL ANSWER: "), F.col("n_chars").cast("string"))).otherwise(F.lit("none"))
    return table(spark, d, "documents").select("doc_id", T.final_answer(x).alias("answer"))


@query("boxed_match", r"SELECT doc_id, doc_id % 3 = n_chars % 3 AS same FROM documents")
def _(spark, d):
    box = lambda c: F.concat(F.lit("thus \\boxed{ "), (F.col(c) % 3).cast("string"), F.lit("} done"))
    return table(spark, d, "documents").select("doc_id", T.boxed_match(box("doc_id"), box("n_chars")).alias("same"))


@query("pascal_names", "SELECT p_partkey, array_to_string([upper(x[1]) || lower(substr(x, 2)) FOR x IN string_split(p_name2, '_')], '') AS pascal FROM (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z]+', '_', 'g') AS p_name2 FROM part)")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", T.pascal(F.regexp_replace(F.lower("p_name"), "[^a-z]+", "_")).alias("pascal"))


@query("collection_names", "SELECT page_id, substr(regexp_replace(lower(url), '[^a-z0-9]', '', 'g'), 1, 10) || '_' || substr(md5(url), 1, 6) AS name FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", T.collection_name(F.col("url")).alias("name"))


@query("template_words", "SELECT n_nationkey, 'Hi ' || n_name || ' in {place}' AS filled, 'name,place' AS words FROM nation")
def _(spark, d):
    t = F.lit("Hi {name} in {place}")
    return table(spark, d, "nation").select("n_nationkey", T.template_filled(t, {"name": F.col("n_name")}).alias("filled"), F.array_join(T.template_words(t), ",").alias("words"))


@query("keyword_sections", r"""
WITH s AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS section, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS section_num FROM documents WHERE text IS NOT NULL),
h AS (SELECT id, section_num, contains(lower(section), 'the')::INT + contains(lower(section), 'license')::INT + contains(lower(section), 'password')::INT AS hits FROM s WHERE trim(section, ' ') <> '')
SELECT id, section_num, hits::BIGINT AS hits, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hits DESC, section_num) AS rank FROM h WHERE hits > 0) WHERE rank <= 4""")
def _(spark, d):
    return retrieval.sections_by_keywords(table(spark, d, "documents"), ["the", "license", "password"]).select("id", "section_num", "hits", "rank")


_SENT = "list_filter([" + _trim("x") + " FOR x IN string_split(coalesce(text, ''), '.')], lambda x: x <> '')"


@query("sentence_triples", f"""
WITH s AS (SELECT doc_id AS id, {_SENT} AS s FROM documents), i AS (SELECT id, s, unnest(range(1, len(s) - 1)) AS i FROM s WHERE len(s) >= 3)
SELECT id, i - 1 AS pos, s[i] AS premise, s[i + 1] AS intermediate, s[i + 2] AS conclusion FROM i WHERE length(s[i]) > 10 AND length(s[i + 1]) > 10""")
def _(spark, d):
    return curation.triples(table(spark, d, "documents")).drop("related")


@query("curate_pipeline", f"""
WITH t AS (SELECT doc_id, {_trim('text')} AS t FROM documents), ok AS (SELECT doc_id AS id, t AS text FROM t WHERE length(t) BETWEEN 50 AND 512 AND {_QUALITY.format('t')}),
s AS (SELECT id, text, {_SENT} AS s FROM ok)
SELECT id, text, len(list_filter(range(1, greatest(len(s) - 1, 1)), lambda i: length(s[i]) > 10 AND length(s[i + 1]) > 10))::BIGINT AS n_triples FROM s""")
def _(spark, d):
    return curation.curated(table(spark, d, "documents"))


@query("qa_complexity", """
SELECT conv_id, round(avg(least(turn % 5 / 3.0, 1) * 0.4 + least(turn % 3 / 3.0, 1) * 0.3 + least(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\s\\x0B\\x85\\p{Z}]+'), lambda x: x <> '')) / 20.0, 1) * 0.15
  + least(len(list_filter(regexp_split_to_array(role, '[\\s\\x0B\\x85\\p{Z}]+'), lambda x: x <> '')) / 50.0, 1) * 0.15), 6) AS complexity FROM conversations GROUP BY conv_id""")
def _(spark, d):
    some = lambda n: F.when(F.col("turn") % n > 0, F.transform(F.sequence(F.lit(1), (F.col("turn") % n).cast("int")), lambda i: i.cast("string"))).otherwise(F.array().cast("array<string>"))
    pairs = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.coalesce("text", F.lit("")).alias("question"), F.col("role").alias("answer"), some(5).alias("reasoning_steps"), some(3).alias("supporting_facts"))).alias("qa"))
    return pairs.select("conv_id", F.round(curation.complexity(F.col("qa")), 6).alias("complexity"))


@query("dedup_exact", "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text, lang")
def _(spark, d):
    return curation.first_of_equal(table(spark, d, "documents"), ["text", "lang"], "doc_id").select("doc_id", "text")


@query("hash_sample")
def _(spark, d):
    return curation.hash_sample(table(spark, d, "documents").select("doc_id", "source"), 100, "doc_id", seed=7)


@query("few_shot_mix")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return curation.few_shot(docs.where("lang = 'en'"), docs.where("lang = 'fr'"), "doc_id", seed=3)
