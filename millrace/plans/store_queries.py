"""Queries over sheets, hubs, parsed texts, generated data and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import embedding
from millrace.functions import numbers as N
from millrace.functions import parsing as X
from millrace.functions import text as T
from millrace.operators import graph as G
from millrace.operators import verify as V
from millrace.plans import generate
from millrace.plans.catalog import query, table
from millrace.plans.file_queries import folder
from millrace.sources import readers, sheets, sinks
from millrace.streaming import streams


def _book(spark, d):
    return sheets.cells(table(spark, d, "nation"), "nation", "n_nationkey")


_CELLS = "(SELECT 'nation' AS sheet, (row_number() OVER (ORDER BY n_nationkey))::INT AS row, unnest([1, 2, 3])::INT AS col, unnest([n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR]) AS value FROM nation)"


@query("sheet_cells", f"SELECT * FROM {_CELLS}")
def _(spark, d):
    return _book(spark, d)


@query("sheet_column", f"SELECT row, value FROM {_CELLS} WHERE col = 2")
def _(spark, d):
    return sheets.column(_book(spark, d), "nation", "B")


@query("sheet_find", f"SELECT row, col FROM {_CELLS} WHERE value = '3'")
def _(spark, d):
    return sheets.find(_book(spark, d), "nation", 3)


@query("sheet_range", f"SELECT row, string_agg(value, '|' ORDER BY col) AS cells FROM {_CELLS} WHERE row BETWEEN 2 AND 9 AND col >= 2 GROUP BY row")
def _(spark, d):
    return sheets.read_range(_book(spark, d), "nation", "B2:C9").select("row", F.array_join("cells", "|").alias("cells"))


@query("sheet_delete_rows", f"SELECT sheet, CASE WHEN row > 5 THEN row - 3 ELSE row END AS row, col, value FROM {_CELLS} WHERE row NOT BETWEEN 3 AND 5")
def _(spark, d):
    return sheets.delete_rows(_book(spark, d), "nation", 3, 5)


@query("sheet_write_range", f"SELECT sheet, row, col, CASE WHEN row = 1 AND col = 2 THEN 'x' WHEN row = 2 AND col = 2 THEN 'y' ELSE value END AS value FROM {_CELLS}")
def _(spark, d):
    return sheets.write_range(_book(spark, d), "nation", "B1:B2", [["x"], ["y"]])


@query("sheet_rows", f"SELECT row, string_agg(value, '|' ORDER BY col) AS cells FROM {_CELLS} WHERE row BETWEEN 4 AND 20 GROUP BY row")
def _(spark, d):
    return sheets.rows(_book(spark, d), "nation", 4, 20).select("row", F.array_join("cells", "|").alias("cells"))


@query("hub_upsert", "SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 = 0 THEN 0::DOUBLE ELSE p_retailprice END AS price FROM part")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", F.col("p_retailprice").alias("price"))
    hub = sinks.Hub(spark, folder(spark))
    hub.add("parts", p, "p_partkey")
    hub.update("parts", p.where("p_partkey % 3 = 0").withColumn("price", F.lit(0.0)))
    return hub.records("parts")


@query("hub_delete", "SELECT p_partkey FROM part WHERE p_partkey <> 7")
def _(spark, d):
    hub = sinks.Hub(spark, folder(spark))
    hub.add("parts", table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey")
    hub.delete("parts", 7)
    return hub.records("parts").select("p_partkey")


@query("dataset_validated", "SELECT conv_id, turn FROM conversations WHERE text IS NOT NULL AND role = 'user'")
def _(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("question"), F.when(F.col("role") == "user", F.col("role")).alias("final_answer"))
    return readers.validated(rows).select("conv_id", "turn")


@query("math_rounding", "SELECT l_orderkey, l_linenumber, l_quantity + 2 AS a, l_quantity - 2 AS s FROM lineitem")
def _(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", N.add(q, F.lit(2)).alias("a"), N.subtract(q, F.lit(2)).alias("s"))


@query("html_text")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", readers.html_text(F.col("html")).alias("text"))


@query("html_links", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link"))


@query("url_parts", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path"))


@query("chunk_chars")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.char_chunks_of(500)(F.coalesce("text", F.lit("")))).alias("chunk", "text"))


@query("chunk_tokens")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.token_chunks_of(100)(F.coalesce("text", F.lit("")))).alias("chunk", "text"))


@query("chunk_titles")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.title_chunks_of(500)(F.coalesce("text", F.lit("")))).alias("chunk", "text"))


@query("boxed_nested", "SELECT p_partkey, p_name || ' {' || p_size || '}' AS answer FROM part")
def _(spark, d):
    text = F.concat(F.lit("so \\boxed{"), "p_name", F.lit(" {"), "p_size", F.lit("}} ok"))
    return table(spark, d, "part").select("p_partkey", X.boxed_udf(text).alias("answer"))


@query("list_normalised", "SELECT p_partkey, CASE WHEN (p_size::VARCHAR) < '7' THEN '[' || p_size || ', 7]' ELSE '[7, ' || p_size || ']' END AS items FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", X.list_udf(F.concat(F.lit("[7,"), "p_size", F.lit("]"))).alias("items"))


@query("call_equality", "SELECT p_partkey, p_size % 2 = 0 AS same FROM part")
def _(spark, d):
    a = F.concat(F.lit("f(x="), (F.col("p_size") % 2).cast("string"), F.lit(", y='a')"))
    return table(spark, d, "part").select("p_partkey", X.same_call_udf(a, F.lit('f(y="a", x=0); g()')).alias("same"))


@query("physics_outcomes", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'equal' WHEN p_size % 3 = 1 THEN 'wrong_value' ELSE 'wrong_unit' END AS outcome FROM part")
def _(spark, d):
    m = F.col("p_size") % 3
    answer = F.when(m == 0, "2.50 km").when(m == 1, "3.1 km").otherwise("2.50 kg")
    return table(spark, d, "part").select("p_partkey", V.physics_outcome(answer, F.lit("$2.50\\times 10^{3}$ m")).alias("outcome"))


@query("verification", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'success' ELSE 'failure' END AS status FROM orders")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("["), "o_orderkey", F.lit(", 1.0]")).alias("s"), F.concat(F.lit("["), (F.col("o_orderkey") + F.col("o_orderkey") % 2), F.lit(", 1]")).alias("r"))
    return V.verified(rows, V.literals_close, "s", "r").select("o_orderkey", "status")


@query("step_rewards", "SELECT o_orderkey, (o_orderstatus = 'F')::INT::DOUBLE + 0.5 AS reward FROM orders")
def _(spark, d):
    return V.step_rewards(table(spark, d, "orders"), F.col("o_orderstatus") == "F", F.create_map(F.lit("style"), F.lit(0.5))).select("o_orderkey", "reward")


@query("game_episodes")
def _(spark, d):
    moves = table(spark, d, "events").select((F.col("event_id") / 9).cast("long").alias("episode"), (F.col("event_id") % 9).alias("turn"), (F.pmod(F.xxhash64("event_id"), F.lit(9)) + 1).cast("string").alias("action"))
    return V.episodes(moves, V.tic_tac_toe, V.tic_tac_toe_start)


@query("stream_accumulate", "SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def _(spark, d):
    return streams.accumulated(table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit(""))), "conv_id", "turn", "text")


@query("task_states", """
WITH e AS (SELECT user_id, list(event_id % 4 ORDER BY event_id) AS k FROM events GROUP BY user_id)
SELECT user_id AS task_id, ['none', 'sent', 'processing', 'returned', 'archived'][list_reduce(k, lambda s, x: CASE WHEN x = s THEN s + 1 ELSE s END, 0::BIGINT) + 1] AS state FROM e""")
def _(spark, d):
    kinds = F.array(*[F.lit(k) for k in streams.MOVES])
    events = table(spark, d, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.element_at(kinds, (F.col("event_id") % 4 + 1).cast("int")).alias("event"))
    return streams.task_states(events)


@query("event_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, d):
    return streams.counted(table(spark, d, "events"))


@query("hourly_counts", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    return streams.windowed_counts(table(spark, d, "events")).select(F.col("window.start").alias("start"), "event_type", "n")


@query("generate_stub", "SELECT item_id, text AS prompt, 'answer to ' || length(text) || ' characters' AS answer FROM benchmark")
def _(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", F.col("text").alias("prompt"))
    return generate.asked(rows, lambda prompts: [f"answer to {len(p)} characters" for p in prompts])


@query("best_attempt", """
WITH a AS (SELECT o_custkey AS id, o_orderkey AS attempt, (o_orderkey % 97) / 100.0::DOUBLE AS score FROM orders)
SELECT id, attempt FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score > 0.9 DESC, CASE WHEN score > 0.9 THEN -attempt ELSE score END DESC, attempt) AS n FROM a) WHERE n = 1""")
def _(spark, d):
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("attempt"), ((F.col("o_orderkey") % 97) / 100.0).alias("score"))
    return generate.best_attempt(a).select("id", "attempt")


@query("embed_documents")
def _(spark, d):
    return embedding.indexed(table(spark, d, "documents")).select("id", "piece_num", F.round(F.col("vector")[0], 6).alias("first"))


@query("embed_cache", "SELECT count(*) AS rows, count(DISTINCT text) AS texts FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")
    cache = embedding.embedded(table(spark, d, "benchmark").select("text").distinct(), "text")
    rows, full = embedding.embedded_with_cache(docs, cache, "text")
    return rows.where("vector IS NOT NULL").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("text").alias("texts"))


@query("model_scores", "SELECT item_id, length(text)::DOUBLE AS length FROM benchmark")
def _(spark, d):
    rows = embedding.scored(table(spark, d, "benchmark"), lambda texts: [{"length": float(len(t))} for t in texts], "text")
    return rows.select("item_id", F.col("scores")["length"].alias("length"))


@query("math_verification", "SELECT p_partkey, p_size % 4 = 0 AS equal FROM part")
def _(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit("\\frac{"), F.col("p_size") % 4, F.lit("}{4} + 2^3")).alias("s"), F.lit("8.0").alias("r"))
    return V.verified(rows, V.math_equal, "s", "r").select("p_partkey", (F.col("status") == "success").alias("equal"))


@query("response_cost", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'F') THEN round(o_custkey * (CASE o_orderstatus WHEN 'O' THEN 0.5 ELSE 0.25 END)::DOUBLE + 3 * (CASE o_orderstatus WHEN 'O' THEN 1.5 ELSE 2 END)::DOUBLE, 6) END AS cost FROM orders")
def _(spark, d):
    usage = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("model"), F.col("o_custkey").alias("prompt_tokens"), F.lit(3).alias("completion_tokens"))
    prices = spark.createDataFrame([("O", 0.5, 1.5), ("F", 0.25, 2.0)], "model string, input_price double, output_price double")
    return V.response_cost(usage, prices).select("o_orderkey", F.round("cost", 6).alias("cost"))


@query("tool_call_format", """SELECT n_nationkey, 'call' || chr(10) || '<tool_call>' || chr(10) || '{"name": "' || n_name || '", "arguments": {"k": ' || n_regionkey || '}}' || chr(10) || '</tool_call>' AS message, '{"name": "' || n_name || '", "arguments": {"k": ' || n_regionkey || '}}' AS call FROM nation""")
def _(spark, d):
    n = table(spark, d, "nation")
    text = T.tool_call_text(F.lit("call"), F.col("n_name"), F.concat(F.lit('{"k": '), "n_regionkey", F.lit("}")))
    return n.select("n_nationkey", text.alias("message"), T.tool_calls(text)[0].alias("call"))


@query("graph_sql", "SELECT n_regionkey::VARCHAR AS region, count(*) AS n FROM nation GROUP BY 1")
def _(spark, d):
    n = table(spark, d, "nation")
    G.register_views(n.select(F.col("n_name").alias("id")), n.select(F.col("n_name").alias("src"), F.col("n_regionkey").cast("string").alias("dst"), F.lit("IN").alias("type")))
    return spark.sql("SELECT dst AS region, count(*) AS n FROM edges WHERE type = 'IN' GROUP BY dst")


@query("staged_elements", "SELECT p_partkey, '{\"text\":\"' || p_name || '\",\"meta\":{\"id\":\"' || p_partkey || '\"}}' AS value FROM part")
def _(spark, d):
    from millrace.sources.sinks import STAGES

    p = table(spark, d, "part").select(F.col("p_name").alias("text"), F.col("p_partkey").cast("string").alias("element_id"), F.lit(None).cast("string").alias("metadata"))
    return STAGES["prodigy"](p).select(F.get_json_object("value", "$.meta.id").cast("long").alias("p_partkey"), "value")
