"""Queries over parsed forms of text, schemas, scores and generated data, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import filters as P
from millrace.functions import numbers as N
from millrace.functions import parsing as X
from millrace.functions import schemas as J
from millrace.functions import text as T
from millrace.operators import conversation as C
from millrace.operators import curation, evaluation
from millrace.operators import graph as G
from millrace.operators import retrieval, vector
from millrace.plans import generate
from millrace.plans.catalog import query, table
from millrace.sources import readers
from millrace.streaming import streams


def _parts(spark, d):
    return table(spark, d, "part")


def _key():
    return F.col("p_partkey").cast("string")


def _size():
    return F.col("p_size").cast("string")


_lit = F.lit


# Parsed texts


@query("task_lists", "SELECT p_partkey, p_name || '|' || p_type || ' kind' AS tasks FROM part")
def _(spark, d):
    text = F.concat(_lit("1. "), "p_name", _lit("!\nno number here\n2. "), "p_type", _lit(" kind?\n3.  "))
    return _parts(spark, d).select("p_partkey", F.array_join(T.task_list(text), "|").alias("tasks"))


@query("code_blocks", """
SELECT p_partkey, unnest(['text', 'code', 'text']) AS kind, unnest([NULL, CASE WHEN p_size % 2 = 0 THEN 'python' END, NULL]) AS language, unnest([p_name, 'print(' || p_size || ')', 'end of ' || p_partkey]) AS content FROM part""")
def _(spark, d):
    text = F.concat("p_name", _lit("\n```"), F.when(F.col("p_size") % 2 == 0, "python").otherwise(""), _lit("\nprint("), _size(), _lit(")\n```\n end of "), _key())
    return _parts(spark, d).select("p_partkey", F.explode(X.blocks_udf(text)).alias("b")).select("p_partkey", "b.*")


@query("templates_filled", "SELECT p_partkey, p_name || ' is ' || p_type || ' and {other} for ' || p_size AS text FROM part")
def _(spark, d):
    text = T.template_filled(_lit("{name} is {kind} and {other} for {size}"), {"name": F.col("p_name"), "kind": F.col("p_type"), "size": F.col("p_size")})
    return _parts(spark, d).select("p_partkey", text.alias("text"))


@query("class_instances", "SELECT p_partkey, unnest([p_name, 'second ' || p_size]) AS input, unnest([p_type, p_brand]) AS output FROM part")
def _(spark, d):
    text = F.concat(_lit("Class label: "), "p_type", _lit("\n"), "p_name", _lit("\nClass label: "), "p_brand", _lit(" \nsecond "), _size())
    return _parts(spark, d).select("p_partkey", F.explode(X.class_instances_udf(text)).alias("i")).select("p_partkey", "i.*")


@query("instances", """
SELECT p_partkey, unnest([p_name, p_brand]) AS input, unnest([p_type, p_size::VARCHAR]) AS output FROM part WHERE p_size % 3 > 0
UNION ALL SELECT p_partkey, '' AS input, 'only ' || p_name AS output FROM part WHERE p_size % 3 = 0""")
def _(spark, d):
    both = F.concat(_lit("Example 1\nInput: "), "p_name", _lit("\nOutput: "), "p_type", _lit("\n\nExample 2\nInput: "), "p_brand", _lit("\nOutput: "), _size())
    text = F.when(F.col("p_size") % 3 > 0, both).otherwise(F.concat(_lit(" only "), "p_name"))
    return _parts(spark, d).select("p_partkey", F.explode(X.instances_udf(text)).alias("i")).select("p_partkey", "i.*")


@query("personas", "SELECT p_partkey, unnest([p_name, p_brand]) AS name, unnest(['likes ' || p_type, 'has size ' || p_size]) AS description FROM part")
def _(spark, d):
    text = F.concat(_lit("1. persona_name: "), "p_name", _lit("\npersona_description: likes "), "p_type", _lit("\n2. persona_name: "), "p_brand", _lit("\npersona_description: has size "), _size())
    return _parts(spark, d).select("p_partkey", F.explode(T.personas(text)).alias("p")).select("p_partkey", "p.*")


@query("graph_mentions", """
SELECT p_partkey, 'node' AS kind, unnest([p_name, p_brand]) AS a, unnest(['Part', 'Brand']) AS b FROM part UNION ALL SELECT p_partkey, 'edge ' || CASE WHEN p_size % 2 = 0 THEN '2024' ELSE '' END, p_name, p_brand FROM part""")
def _(spark, d):
    node = lambda c, kind: F.concat(_lit("Node(id='"), c, _lit(f"', type='{kind}')"))
    a, b = node(F.col("p_name"), "Part"), node(F.col("p_brand"), "Brand")
    edge = F.concat(_lit("Relationship(subj="), a, _lit(", obj="), b, _lit(", type='of'"), F.when(F.col("p_size") % 2 == 0, ", timestamp='2024'").otherwise(""), _lit(")"))
    rows = _parts(spark, d).select("p_partkey", F.concat(a, _lit("\n"), b).alias("nodes"), edge.alias("edge"))
    nodes = rows.select("p_partkey", F.explode(T.graph_nodes(F.col("nodes"))).alias("n")).select("p_partkey", _lit("node").alias("kind"), F.col("n.id").alias("a"), F.col("n.type").alias("b"))
    edges = rows.select("p_partkey", F.explode(T.graph_relationships(F.col("edge"))).alias("r"))
    return nodes.union(edges.select("p_partkey", F.concat(_lit("edge "), F.coalesce("r.timestamp", _lit(""))).alias("kind"), F.col("r.subj").alias("a"), F.col("r.obj").alias("b")))


@query("tagged_tasks", "SELECT p_partkey, unnest([0, 1]) AS index, unnest([p_name, 'see ' || chr(10) || p_type]) AS content FROM part")
def _(spark, d):
    text = F.concat(_lit("x <task> "), "p_name", _lit("</task> y <task>see \n"), "p_type", _lit("\n</task>"))
    return _parts(spark, d).select("p_partkey", F.explode(T.tagged_tasks(text)).alias("t")).select("p_partkey", "t.*")


@query("api_calls", "SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN '[Find(name=''' || p_name || ''', size=' || p_size || ')]' END AS call FROM part")
def _(spark, d):
    call = F.concat(_lit("API-Request: [Find(name='"), "p_name", _lit("', size="), _size(), _lit(")] then"))
    return _parts(spark, d).select("p_partkey", T.api_call(F.when(F.col("p_size") % 4 > 0, call).otherwise(_lit("[none]"))).alias("call"))


@query("api_matches", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS known FROM part")
def _(spark, d):
    known = ["AutoModel.from_pretrained('base')", "torch.hub.load('vision', 'net', pretrained=True)"]
    calls = [_lit("AutoModel.from_pretrained('base', num_labels="), _lit("torch.hub.load('vision', 'net', pretrained=True, seed="), _lit("AutoModel.from_pretrained('other', size="), _lit("load('vision', 'net', True, ")]
    which = calls[3]
    for i in range(3):
        which = F.when(F.col("p_size") % 4 == i, calls[i]).otherwise(which)
    text = F.concat(_lit('{"domain": "x", "api_call": "model = '), which, _size(), _lit(')", "api_provider": "y"}'))
    return _parts(spark, d).select("p_partkey", X.api_match_of(known)(text).alias("known"))


@query("literals", """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '{''a'': ' || p_size || ', ''b'': [1, 2]}' END AS as_dict, CASE WHEN p_size % 2 = 1 THEN '{1, ' || (p_size + 100) || '}' END AS as_set, '(' || p_size || ', ''' || p_type || ''')' AS as_tuple FROM part""")
def _(spark, d):
    even = F.when(F.col("p_size") % 2 == 0, F.concat(_lit(" {'b': [1,2], 'a': "), _size(), _lit("}"))).otherwise(F.concat(_lit("{"), (F.col("p_size") + 100).cast("string"), _lit(", 1, 1}")))
    pair = F.concat(_lit("("), _size(), _lit(',"'), "p_type", _lit('" )'))
    return _parts(spark, d).select("p_partkey", X.dict_udf(even).alias("as_dict"), X.set_udf(even).alias("as_set"), X.tuple_udf(pair).alias("as_tuple"))


@query("boxed_escaped", r"SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '\frac{' || p_size || '}{2}' WHEN 1 THEN p_name || ' \\' END AS answer FROM part")
def _(spark, d):
    text = F.when(F.col("p_size") % 3 == 0, F.concat(_lit(r"so \boxed{ \frac{"), _size(), _lit("}{2} } ."))).when(F.col("p_size") % 3 == 1, F.concat(_lit(r"\boxed{"), "p_name", _lit(r" \\} and }"))).otherwise(_lit(r"\boxed{open \}"))
    return _parts(spark, d).select("p_partkey", X.boxed_udf(text).alias("answer"))


@query("first_strategy", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size WHEN p_size % 3 = 0 THEN p_partkey END::VARCHAR AS value FROM part")
def _(spark, d):
    text = F.when(F.col("p_size") % 2 == 0, F.concat(_lit(r"is \boxed{"), _size(), _lit("} or FINAL ANSWER: 7"))).when(F.col("p_size") % 3 == 0, F.concat(_lit("FINAL ANSWER: "), _key())).otherwise(_lit("none"))
    final = lambda t: F.when(t.contains("FINAL ANSWER"), T.final_answer(t))
    return _parts(spark, d).select("p_partkey", T.first_of([[T.boxed_simple, final], [lambda t: F.regexp_extract(t, r"\d+", 0)]], text).alias("value"))


@query("benchmark_questions", "SELECT item_id, text || chr(10) || 'Call one API of the hub.' || chr(10) || 'Answer briefly.' AS question FROM benchmark")
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.question_for(F.col("text"), "hub", {"hub": "Call one API of the hub."}, "Answer briefly.").alias("question"))


@query("masked_round_trip", "SELECT doc_id, sha256(coalesce(text, '')) AS digest, length(coalesce(text, '')) > 0 AS differs FROM documents")
def _(spark, d):
    text = F.coalesce("text", _lit(""))
    rows = table(spark, d, "documents").select("doc_id", text.alias("text"), X.masked_by("key")(text).alias("masked"))
    return rows.select("doc_id", F.sha2(X.unmasked_by("key")(F.col("masked")), 256).alias("digest"), (F.col("masked") != F.col("text")).alias("differs"))


@query("alpaca_round_trip", "SELECT p_partkey, p_name AS instruction, p_type AS input, 'size ' || p_size AS output FROM part")
def _(spark, d):
    text = T.alpaca_text(F.col("p_name"), F.col("p_type"), F.concat(_lit("size "), _size()))
    return _parts(spark, d).select("p_partkey", T.alpaca_parts(text).alias("a")).select("p_partkey", "a.*")


@query("graph_identifiers", "SELECT p_partkey, regexp_replace(p_name || '-' || p_brand, '[^a-zA-Z0-9]', '', 'g') AS id, upper(replace(p_name, ' ', '_')) AS relation FROM part")
def _(spark, d):
    return _parts(spark, d).select("p_partkey", T.graph_identifier(F.concat("p_name", _lit("-"), "p_brand")).alias("id"), T.relation_name(F.col("p_name")).alias("relation"))


@query("safe_file_names", "SELECT p_partkey, replace(p_name, ' ', '_') || '_cafe_' || p_size || '.html' AS name FROM part")
def _(spark, d):
    return _parts(spark, d).select("p_partkey", X.file_name_udf(F.concat(_lit("/"), "p_name", _lit("/café?!"), _size(), _lit(".html//"))).alias("name"))


@query("options_chosen", "SELECT p_partkey, [p_name, p_type, p_brand][(p_size % 5)::INT] AS option FROM part WHERE p_size % 5 > 0 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_size % 5 = 0")
def _(spark, d):
    choice = F.when(F.col("p_size") % 5 > 0, F.concat(_lit("I take number "), (F.col("p_size") % 5).cast("string"), _lit(", not 1."))).otherwise(_lit("none of them"))
    return _parts(spark, d).select("p_partkey", T.option_chosen(choice, F.array("p_name", "p_type", "p_brand")).alias("option"))


@query("first_errors", "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN -1 ELSE p_size % 7 END::BIGINT AS position FROM part")
def _(spark, d):
    sentence = lambda i: F.when(F.col("p_size") % 7 == i + 1, f"wrong {i}").otherwise(f"right {i}")
    solution = F.concat_ws(". ", *[sentence(i) for i in range(6)], _lit(""))
    return _parts(spark, d).select("p_partkey", X.first_error_of(lambda q, s: "wrong" not in s)(F.col("p_name"), solution).alias("position"))


@query("token_scores", "SELECT p_partkey, p_size / 10.0::DOUBLE AS yes, -p_retailprice AS no FROM part")
def _(spark, d):
    scores = T.log_scores(F.array(_lit("yes"), _lit("no")), F.array((F.col("p_size") / 10).cast("double"), -F.col("p_retailprice")))
    return _parts(spark, d).select("p_partkey", scores["yes"].alias("yes"), scores["no"].alias("no"))


@query("elements_by_content", "SELECT doc_id, sha256(text) AS element_id, lang FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, NULL, lang FROM documents WHERE text IS NULL")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", readers.element(F.col("text"), lang=F.col("lang")).alias("e")).select("doc_id", "e.element_id", F.col("e.metadata.lang").alias("lang"))


@query("qa_pairs", "SELECT p_partkey, unnest([p_name, 'size of ' || p_partkey]) AS key, unnest([p_type, p_size::VARCHAR]) AS value FROM part")
def _(spark, d):
    pairs = F.to_json(F.create_map(F.col("p_name"), F.col("p_type"), F.concat(_lit("size of "), _key()), _size()))
    return _parts(spark, d).select("p_partkey", F.explode(readers.qa_pairs(pairs)).alias("e")).select("p_partkey", "e.*")


# Filters and scores


@query("filter_custom", r"""
SELECT doc_id, array_to_string(list_filter([CASE WHEN NOT len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\x0B\x85\p{Z}]+'), lambda x: x <> '')) BETWEEN 2 AND 300 THEN 'length' END,
  CASE WHEN regexp_matches(coalesce(text, ''), '[0-9]') THEN 'digits' END, CASE WHEN contains(lower(coalesce(text, '')), 'the') THEN 'article' END], lambda x: x IS NOT NULL), ',') AS failed FROM documents""")
def _(spark, d):
    P.register_filter("without", lambda word: lambda t: ~F.lower(F.coalesce(t, _lit(""))).contains(word))
    own = P.InstructionFilter({"length": {"min_len": 2, "max_len": 300}}).add_filter("digits", lambda t: ~F.coalesce(t, _lit("")).rlike("[0-9]")).add_filter("article", P.REGISTRY["without"]("the"))
    return table(spark, d, "documents").select("doc_id", F.array_join(own.failed(F.col("text")), ",").alias("failed"))


@query("qa_quality", """
WITH q AS (SELECT p_partkey, p_name AS a, p_type AS b, p_size FROM part)
SELECT p_partkey, p_size % 4 > 0 AND length(a) >= 10 AND length(b) >= 5 AND a <> b AND (p_size % 4 = 1 OR length('what is its size') >= 10 AND length('size ' || p_size) >= 5) AS ok,
  p_size % 4 > 0 AND length(a) >= 10 AND length(b) >= 5 AND a <> b AND p_size % 4 <> 2 AS long_ok FROM q""")
def _(spark, d):
    qa = lambda q, a: F.struct(q.alias("question"), a.alias("answer"))
    first, second = qa(F.col("p_name"), F.col("p_type")), qa(_lit("what is its size"), F.concat(_lit("size "), _size()))
    none = F.array().cast("array<struct<question:string,answer:string>>")
    pairs = F.when(F.col("p_size") % 4 == 0, none).when(F.col("p_size") % 4 == 1, F.array(first)).otherwise(F.array(first, second))
    text = F.when(F.col("p_size") % 4 == 2, _lit("too short")).otherwise(F.repeat(_lit("word "), 20))
    return _parts(spark, d).select("p_partkey", P.qa_quality_ok(pairs).alias("ok"), P.example_ok(text, pairs).alias("long_ok"))


_LINE = "SELECT l_orderkey, l_linenumber, l_discount * 10 AS a, l_tax * 10 AS b FROM lineitem"


def _scored(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.create_map(_lit("accuracy"), F.col("l_discount") * 10, _lit("clarity"), F.col("l_tax") * 10).alias("scores"))


@query("score_thresholds", f"""
SELECT l_orderkey, l_linenumber, a >= 0.5 AND b >= 0.5 AS every, a >= 0.7 AS named,
  CASE WHEN a >= 0.5 AND b >= 0.5 THEN 'All dimensions meet the threshold' ELSE 'Needs improvement: ' || concat_ws(', ', CASE WHEN a < 0.5 THEN 'accuracy' END, CASE WHEN b < 0.5 THEN 'clarity' END) END AS feedback FROM ({_LINE})""")
def _(spark, d):
    s = F.col("scores")
    return _scored(spark, d).select("l_orderkey", "l_linenumber", P.scores_reach(s, 0.5).alias("every"), P.scores_reach(s, {"accuracy": 0.7}).alias("named"), P.score_feedback(s, 0.5).alias("feedback"))


@query("rewards_reached", f"SELECT l_orderkey, l_linenumber FROM ({_LINE}) WHERE a >= 0.3 AND b >= 0.2")
def _(spark, d):
    return P.rewards_reach(_scored(spark, d), {"accuracy": 0.3, "clarity": 0.2}).select("l_orderkey", "l_linenumber")


@query("problems_refused", """
SELECT p_partkey, CASE WHEN p_size % 5 = 0 OR p_size % 5 = 1 THEN 'problem is missing' WHEN p_size % 5 = 2 THEN 'solution is empty' END AS reject_reason FROM part""")
def _(spark, d):
    kind = F.col("p_size") % 5
    rows = _parts(spark, d).select("p_partkey", F.when(kind == 0, _lit("  ")).when(kind > 1, F.col("p_name")).alias("problem"), F.when(kind == 2, _lit("\n")).when(kind == 3, F.col("p_type")).alias("solution"))
    return P.problem_valid(rows).select("p_partkey", "reject_reason")


@query("oversized_lists", "SELECT doc_id, CASE WHEN n < 128 THEN n END AS n FROM (SELECT doc_id, len(string_split(coalesce(text, ''), ' ')) AS n FROM documents)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(P.oversized_dropped(F.split(F.coalesce("text", _lit("")), " "))).alias("n")).withColumn("n", F.when(F.col("n") >= 0, F.col("n")))


@query("single_statistics", "SELECT l_returnflag, round(avg(l_tax), 6) AS mean, round(stddev_pop(l_tax), 6) AS std, min(l_tax) AS min, max(l_tax) AS max FROM lineitem GROUP BY l_returnflag")
def _(spark, d):
    of = lambda n: evaluation.statistic(n, F.col("l_tax"))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(of("mean"), 6).alias("mean"), F.round(of("std"), 6).alias("std"), of("min").alias("min"), of("max").alias("max"))


@query("call_accuracy", "SELECT o_orderpriority, count(*) AS total, sum((o_orderstatus = 'F')::INT)::BIGINT AS correct, round(avg((o_orderstatus = 'F')::INT), 9) AS accuracy FROM orders GROUP BY o_orderpriority")
def _(spark, d):
    return evaluation.accuracy(table(spark, d, "orders"), F.col("o_orderstatus") == "F", ["o_orderpriority"]).withColumn("accuracy", F.round("accuracy", 9))


@query("reranked", "SELECT p_partkey AS id, (p_size * 7 % 50)::DOUBLE AS score, row_number() OVER (ORDER BY p_size * 7 % 50 DESC, p_partkey) AS rank FROM part ORDER BY rank LIMIT 25")
def _(spark, d):
    parts = _parts(spark, d).select(F.col("p_partkey").alias("id"), "p_size")
    scores = parts.select("id", (F.col("p_size") * 7 % 50).cast("double").alias("score"))
    return retrieval.reranked(parts.select("id"), scores, 25).select("id", "score", "rank")


@query("distinct_methods", "SELECT p_partkey, len(list_distinct([p_type, p_brand, p_type, 'x'])) AS n, 1 AS one FROM part")
def _(spark, d):
    every = F.array("p_type", "p_brand", "p_type", _lit("x"))
    return _parts(spark, d).select("p_partkey", F.size(curation.sampled_methods(every, 9)).alias("n"), F.size(curation.sampled_methods(every, 1)).alias("one"))


# Schemas and functions

_SCHEMA = {"type": "object", "properties": {"k": {"type": "integer"}, "extra": {"type": "array", "items": {"type": "string"}}}, "required": ["k"]}


@query("json_models", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, NULL::VARCHAR AS extra FROM events")
def _(spark, d):
    rows = J.structured(table(spark, d, "events").select("event_id", "props"), "props", _SCHEMA)
    return rows.select("event_id", "parsed.k", F.array_join("parsed.extra", ",").alias("extra"))


@query("json_bounds", "SELECT p_partkey, p_size BETWEEN 5 AND 40 AS size_ok, length(p_name) BETWEEN 8 AND 12 AS name_ok, p_type IN ('ECONOMY', 'SMALL') AS type_ok FROM part")
def _(spark, d):
    return _parts(spark, d).select("p_partkey", J.checks({"minimum": 5, "maximum": 40}, F.col("p_size")).alias("size_ok"), J.checks({"minLength": 8, "maxLength": 12}, F.col("p_name")).alias("name_ok"), J.checks({"enum": ["ECONOMY", "SMALL"]}, F.col("p_type")).alias("type_ok"))


@query("json_sample_model", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def _(spark, d):
    kind = J.schema_of_sample(spark, {"k": 3})
    return table(spark, d, "events").select("event_id", F.from_json("props", kind).alias("p")).select("event_id", F.col("p.k").cast("long").alias("k"))


@query("structured_prompts", """SELECT item_id, sha256(text || chr(10) || chr(10) || 'Answer with one JSON object of this schema and nothing else:' || chr(10) || '{"type": "string"}') AS digest FROM benchmark""")
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.sha2(J.structured_prompt(F.col("text"), {"type": "string"}), 256).alias("digest"))


def _shelf():
    def shelf(name: str, size: int) -> str:
        """The shelf a part lies on."""
        return f"{name[:3]}-{size // 10}"

    return shelf


@query("registered_functions", "SELECT p_partkey, left(p_name, 3) || '-' || (p_size // 10) AS shelf FROM part")
def _(spark, d):
    registry = J.FunctionRegistry(spark)
    registry.register(_shelf(), "millrace_shelf")
    _parts(spark, d).createOrReplaceTempView("millrace_parts")
    return spark.sql("SELECT p_partkey, millrace_shelf(p_name, p_size) AS shelf FROM millrace_parts")


@query("function_schemas", "SELECT unnest(['name', 'size']) AS parameter, unnest(['string', 'integer']) AS type")
def _(spark, d):
    schema = J.json_schema_of(_shelf())["parameters"]
    return spark.createDataFrame([(n, p["type"]) for n, p in schema["properties"].items()], "parameter string, type string")


# Conversations and graphs


@query("calls_grouped", "SELECT user_id::VARCHAR AS tool_call_id, count(*) AS n, string_agg(event_type, ',' ORDER BY event_id) AS kinds FROM events GROUP BY user_id")
def _(spark, d):
    units = table(spark, d, "events").select(F.col("user_id").cast("string").alias("tool_call_id"), F.col("event_id").alias("ord"), _lit("tool").alias("role"), F.col("event_type").alias("content"))
    return C.grouped_calls(units).select("tool_call_id", F.size("units").cast("long").alias("n"), F.array_join(F.transform("units", lambda u: u["content"]), ",").alias("kinds"))


@query("history_interleaved", """
SELECT conv_id AS key, turn AS ord, CASE WHEN turn = min(turn) OVER (PARTITION BY conv_id) THEN 0 ELSE 2 END AS section FROM conversations UNION ALL SELECT conv_id, turn, 1 FROM conversations WHERE role = 'user'""")
def _(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("ord"), "role")
    return C.interleaved(rows.drop("role"), rows.where("role = 'user'").drop("role"))


@query("messages_for_models", "SELECT conv_id, turn, lower(role) AS role, sha256(coalesce(text, '')) AS digest FROM conversations")
def _(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", C.openai_message(F.upper("role"), F.coalesce("text", _lit(""))).alias("m"))
    return rows.select("conv_id", "turn", "m.role", F.sha2("m.content", 256).alias("digest"))


@query("function_messages", "SELECT event_id, CASE WHEN value < 10 THEN 'gpt' ELSE 'tool' END AS \"from\", CASE WHEN value < 10 THEN event_type WHEN event_id % 2 = 0 THEN '[MASKED]' ELSE props END AS value FROM events WHERE value IS NOT NULL")
def _(spark, d):
    result = F.when(F.col("value") >= 10, F.col("props"))
    both = [C.function_message(result, F.col("event_type"), masked=m) for m in (True, False)]
    rows = table(spark, d, "events").where("value IS NOT NULL").select("event_id", F.when(F.col("event_id") % 2 == 0, both[0]).otherwise(both[1]).alias("m"))
    return rows.select("event_id", "m.*")


@query("message_threads", "SELECT event_id AS message_id, event_type FROM events WHERE user_id % 7 = 2")
def _(spark, d):
    messages = table(spark, d, "events").select(F.col("event_id").alias("message_id"), F.col("ts").alias("timestamp"), "event_type", "user_id")
    return C.thread(messages, messages.where("user_id % 7 = 2")).select("message_id", "event_type")


@query("property_schema", "SELECT DISTINCT event_type AS label, unnest(json_keys(props)) AS property FROM events")
def _(spark, d):
    return G.property_schema(table(spark, d, "events").select(F.col("event_type").alias("type"), F.from_json("props", "map<string,string>").alias("properties")))


def _orders(spark, d):
    node = lambda c, kind: F.struct(F.concat(_lit(kind[0].lower()), c.cast("string")).alias("id"), _lit(kind).alias("type"))
    a, b = node(F.col("o_custkey"), "Customer"), node(F.col("o_orderkey"), "Order")
    edge = F.struct(a["id"].alias("subj"), b["id"].alias("obj"), F.concat(_lit("status "), "o_orderstatus").alias("type"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), F.array(a, b).alias("nodes"), F.array(edge, edge).alias("relationships"))


@query("elements_flattened", """
SELECT DISTINCT 'c' || o_custkey AS a, 'Customer' AS b, NULL AS c FROM orders UNION ALL SELECT 'o' || o_orderkey, 'Order', NULL FROM orders UNION ALL SELECT DISTINCT 'c' || o_custkey, 'o' || o_orderkey, 'status ' || o_orderstatus FROM orders""")
def _(spark, d):
    nodes, edges = G.flattened(_orders(spark, d))
    return nodes.select(F.col("id").alias("a"), F.col("type").alias("b"), _lit(None).cast("string").alias("c")).union(edges.select("src", "dst", "type"))


# Generated data, with functions in place of models


@query("few_shot_prompts", "SELECT 'Come up with a new task.' || chr(10) || string_agg('Task ' || i || ': ' || r_name, chr(10) ORDER BY i) || chr(10) || 'Next task:' AS prompt FROM (SELECT r_name, row_number() OVER (ORDER BY r_name) AS i FROM region)")
def _(spark, d):
    return generate.few_shot_prompt(table(spark, d, "region").select(F.col("r_name").alias("instruction")))


@query("evolved_prompts", "SELECT item_id AS id, sha256(text) AS digest, 0 AS step FROM benchmark UNION ALL SELECT item_id, sha256(text || '!'), 1 FROM benchmark")
def _(spark, d):
    model = lambda prompts: [p.partition(": ")[2] + "!" for p in prompts]
    scorer = lambda rows: rows.withColumn("scores", F.create_map(_lit("length"), F.length("prompt").cast("double")))
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("prompt"))
    return generate.evolved(rows, model, scorer, "in-depth").select("id", F.sha2("prompt", 256).alias("digest"), "step")


@query("methods_resolved", "SELECT p_partkey, CASE p_size % 2 WHEN 0 THEN 'deepening' ELSE 'mutation' END AS method FROM part")
def _(spark, d):
    return _parts(spark, d).select("p_partkey", generate.resolved_method(F.when(F.col("p_size") % 2 == 0, "deepening").otherwise("in-breadth"), key=F.col("p_partkey")).alias("method"))


@query("traces_improved", "SELECT p_partkey AS id, greatest(0, least(3, 12 - length(p_name)))::INT AS rounds, length(p_name) + least(3, greatest(0, 12 - length(p_name))) >= 12 AS ok FROM part")
def _(spark, d):
    model = lambda prompts: [p.partition("\nImprove: ")[2] + "+" if "\nImprove: " in p else p for p in prompts]
    scorer = lambda rows: rows.withColumn("scores", F.create_map(_lit("length"), F.length("trace") / 12))
    problems = _parts(spark, d).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("problem"))
    return generate.improved(problems, model, scorer, 1.0).select("id", "rounds", "ok")


@query("accepted_answers", "SELECT p_partkey, upper(p_name) AS answer FROM part WHERE p_size % 3 > 0")
def _(spark, d):
    check = lambda rows: rows.withColumn("accepted", F.col("p_size") % 3 > 0)
    rows = _parts(spark, d).select("p_partkey", "p_size", F.col("p_name").alias("prompt"))
    return generate.with_rationale(rows, lambda prompts: [p.upper() for p in prompts], check, tries=2).select("p_partkey", "answer")


@query("steps_recorded", "SELECT unnest([0, 1])::BIGINT AS turn, unnest(['user', 'assistant']) AS role, unnest(['hi', NULL]) AS message, unnest([NULL, 'f()']) AS function_call")
def _(spark, d):
    return generate.collected([{"role": "user", "message": "hi"}, {"role": "assistant", "function_call": "f()"}], spark).select("turn", "role", "message", "function_call")


@query("batch_sizes", "SELECT unnest([true, true, false, false]) AS success, unnest([10.0, 20.0, 10.0, 1.0])::DOUBLE AS size, unnest([12, 20, 8, 1])::BIGINT AS next")
def _(spark, d):
    rows = [(True, 10.0), (True, 20.0), (False, 10.0), (False, 1.0)]
    return spark.createDataFrame([(ok, n, streams.batch_size(n, ok)) for ok, n in rows], "success boolean, size double, next long")


@query("rouge_filtered", """
WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)
SELECT p_partkey FROM w WHERE NOT (w[1] = 'red' AND w[2] = 'ring')""")
def _(spark, d):
    rows = _parts(spark, d).select("p_partkey", F.col("p_name").alias("instruction"))
    return evaluation.rouge_filter(rows, ["red ring"], 0.7, "instruction").select("p_partkey")


@query("golden_answers", "SELECT p.p_partkey, g.golden FROM part p JOIN (SELECT p_name, min(p_type) AS golden FROM part GROUP BY p_name) g USING (p_name)")
def _(spark, d):
    parts = _parts(spark, d)
    questions, golden = parts.select("p_partkey", F.col("p_name").alias("question")), parts.select(F.col("p_name").alias("question"), F.col("p_type").alias("answer"))
    return retrieval.golden_answers(questions, golden).select("p_partkey", "golden")


@query("rows_sliced", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 50")
def _(spark, d):
    return curation.sliced_rows(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), 50, 150, "o_orderkey")


@query("store_cleared", "SELECT NULL::BIGINT AS vector_dim, 0::BIGINT AS vector_count")
def _(spark, d):
    return vector.status(vector.cleared(table(spark, d, "embeddings")), "embedding")


@query("matrix_algebra", """
SELECT l_orderkey, l_linenumber, round(l_quantity * 3 - 2 * l_linenumber, 4) AS determinant, CASE WHEN abs(l_quantity * 3 - 2 * l_linenumber) > 1e-9 THEN 2 ELSE 1 END AS rank, round(l_quantity + 3, 6) AS trace,
  CASE WHEN abs(l_quantity * 3 - 2 * l_linenumber) > 1e-9 THEN round(3 / (l_quantity * 3 - 2 * l_linenumber), 6) END AS corner FROM lineitem""")
def _(spark, d):
    q, n = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    m = F.array(F.array(q, n), F.array(_lit(2.0), _lit(3.0)))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", N.determinant(m).alias("d"), N.rank(m).alias("rank"), N.trace(m).alias("t"), N.inverse(m)[0][0].alias("i"))
    return rows.select("l_orderkey", "l_linenumber", F.round("d", 4).alias("determinant"), "rank", F.round("t", 6).alias("trace"), F.when(F.col("rank") == 2, F.round("i", 6)).alias("corner"))


@query("chunks_custom", """
SELECT p_partkey, unnest([0, 1]) AS chunk, unnest([array_to_string(w[1:3], ' '), array_to_string(w[4:], ' ')]) AS text FROM (SELECT p_partkey, string_split(p_name || ' of ' || p_type || ' by ' || p_brand, ' ') AS w FROM part)""")
def _(spark, d):
    text = F.concat("p_name", _lit(" of "), "p_type", _lit(" by "), "p_brand")
    return _parts(spark, d).select("p_partkey", F.posexplode(X.token_chunks_of(3, lambda line: len(line.split()))(text)).alias("chunk", "text"))


@query("expressions_interpreted", """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size * (p_partkey + 2) WHEN 1 THEN greatest(p_size, 20) - 1 WHEN 2 THEN CASE WHEN p_size > 25 THEN 1 ELSE 0 END END::DOUBLE AS value FROM part""")
def _(spark, d):
    forms = F.array(_lit("size * (key + 2)"), _lit("max(size, 20) - 1"), _lit("1 if 25 < size <= 50 and not size == 51 else 0"), _lit("__import__('os').system('x')"))
    value = X.interpreted_udf(["size", "key"], "double")(forms[F.col("p_size") % 4], F.col("p_size"), F.col("p_partkey"))
    return _parts(spark, d).select("p_partkey", value.alias("value"))


@query("constrained_answers", """
SELECT p_partkey, 'id-' || p_partkey AS answer FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_partkey, 'yes' FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, '{"size": ' || p_size || '}' FROM part WHERE p_size % 5 > 0""")
def _(spark, d):
    rows = _parts(spark, d)
    ask = lambda text: rows.select("p_partkey", text.alias("prompt"))
    same = lambda prompts: list(prompts)
    by_form = generate.constrained(ask(F.concat(F.when(F.col("p_size") % 3 == 0, "id-").otherwise("no "), _key())), same, regex="id-[0-9]+", tries=2)
    by_choice = generate.constrained(ask(F.when(F.col("p_size") % 2 == 0, "yes").otherwise("maybe")), same, choices=["yes", "no"], tries=2)
    by_schema = generate.constrained(ask(F.concat(_lit('{"size": '), F.when(F.col("p_size") % 5 > 0, _size()).otherwise("broken"), _lit("}"))), same, schema={"type": "object", "properties": {"size": {"type": "integer"}}, "required": ["size"]}, tries=2)
    return by_form.union(by_choice).union(by_schema).select("p_partkey", "answer")
