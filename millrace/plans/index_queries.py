"""Queries over stored indexes, versioned tables, live sources, ordered streams and table functions."""

from __future__ import annotations

import functools
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import table_functions
from millrace.operators import graph, rouge_join
from millrace.operators.keyword_index import KeywordIndex
from millrace.operators.vector_index import NeighbourGraph, VectorLists
from millrace.plans.catalog import query, table
from millrace.plans.chat_queries import _EDGES, _LOG, log, places
from millrace.plans.file_queries import folder
from millrace.sources import live
from millrace.sources.versions import VersionedTable
from millrace.streaming import ordered, streams


@functools.cache
def _made(application: str, d: str, kind: str) -> list[str]:
    return []


def stored(spark, d: str, kind: str, make) -> str:
    """The folder of an index over the tables in ``d``: made by the first query of the session that needs it."""
    path = _made(spark.sparkContext.applicationId, d, kind)
    if not path:
        new = folder(spark)
        make(new)
        path.append(new)
    return path[0]


def keyword_index(spark, d: str) -> KeywordIndex:
    """The documents' index, added in two batches, as it is opened by a reader."""

    def make(path: str) -> None:
        index, docs = KeywordIndex(spark, path), table(spark, d, "documents")
        for odd in (0, 1):
            index.add(docs.where(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(2)) == odd))

    return KeywordIndex(spark, stored(spark, d, "keywords", make))


def _vectors(spark, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _asked(spark, d: str) -> DataFrame:
    return _vectors(spark, d).where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))


def vector_lists(spark, d: str) -> VectorLists:
    def make(path: str) -> None:
        index, rows = VectorLists(spark, path), _vectors(spark, d)
        index.add(rows.where("id % 3 <> 0"))
        index.add(rows.where("id % 3 = 0"))
        index.probes_for(0.95, 20)

    return VectorLists(spark, stored(spark, d, "lists", make))


@query("bm25_many", """
WITH p AS (SELECT doc_id AS id, string_split(coalesce(text, ''), ' ') AS w FROM documents), t AS (SELECT id, len(w) AS dl, unnest(w) AS term FROM p), tf AS (SELECT id, dl, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS mean FROM p), i AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, n GROUP BY term, n), f AS (SELECT 0.25 * avg(idf) AS least FROM i),
s AS (SELECT q.id AS query_id, tf.id, round(sum(q.tf * CASE WHEN idf < 0 THEN least ELSE idf END * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * tf.dl / mean))), 9) AS score
  FROM tf q JOIN tf USING (term) JOIN i USING (term), n, f WHERE q.id % 50 = 0 GROUP BY ALL)
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10""")
def _(spark, d):
    """Each document whose id is divisible by 50 asks with its whole text for the ten documents most like it."""
    asked = table(spark, d, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))
    return keyword_index(spark, d).search_many(asked, 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("vec_stored_lists")
def _(spark, d):
    return vector_lists(spark, d).search_many(_asked(spark, d), 20).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("vec_neighbour_graph")
def _(spark, d):
    path = stored(spark, d, "graph", lambda path: NeighbourGraph(spark, path).build(_vectors(spark, d)))
    return NeighbourGraph(spark, path).search_many(_asked(spark, d), 20).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("rouge_pairs")
def _(spark, d):
    """Pairs of different documents that are alike by ROUGE-L, each text once."""
    found = rouge_join.similar_within(table(spark, d, "documents"), 0.7)
    both = found.select(F.array_join("text", " ").alias("text"), F.array_join("other", " ").alias("other"), "rouge")
    return both.select(F.least("text", "other").alias("text"), F.greatest("text", "other").alias("other"), "rouge")


_SETS = "(SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders)"


@query("versions_changed", f"""
SELECT 'first' AS version, id, status, price FROM {_SETS} WHERE id % 2 = 0
UNION ALL SELECT 'last', id, CASE WHEN id % 6 = 0 THEN 'X' ELSE status END, price FROM {_SETS} WHERE (id % 2 = 0 OR id % 3 = 0 OR id % 10 = 1) AND id % 7 <> 0""")
def _(spark, d):
    """A versioned table that is appended to, upserted and deleted from: its first snapshot and its last."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    made = VersionedTable.create(spark, folder(spark), orders.where("id % 2 = 0"), "id", parts=8)
    made.append(orders.where("id % 10 = 1"))
    made.upsert(orders.where("id % 3 = 0").withColumn("status", F.when(F.col("id") % 6 == 0, "X").otherwise(F.col("status"))))
    made.delete(where=F.col("id") % 7 == 0)
    opened = VersionedTable(spark, made.path)
    named = lambda rows, v: rows.select(F.lit(v).alias("version"), "id", "status", "price")
    return named(opened.read(1), "first").union(named(opened.read(), "last"))


# Streams: events come out of order, in several files


_ENDS = "timestamp '2100-01-01'"


def _live(spark, rows: DataFrame, key: str, time: str, files: int = 4) -> tuple[DataFrame, str]:
    """Rows as a stream of files, dealt by a hash, and a last file with a row of a far time, so that the watermark passes all others."""
    root = folder(spark)
    far = [F.expr(_ENDS).cast(t).alias(c) if c == time else F.lit(-1).cast(t).alias(c) if c == key else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes]
    for part in [*[rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(files)) == i) for i in range(files)], rows.limit(1).select(*far)]:
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ordered.PROVIDER)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"), root


def _run(stream: DataFrame, root: str) -> DataFrame:
    """Runs a stream over what is there and reads what it wrote."""
    live_ = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    live_.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")


@query("completion_times_live", f"""
WITH a AS (SELECT *, last_value(CASE WHEN kind = 'task_assigned' THEN ts END IGNORE NULLS) OVER (PARTITION BY task_id ORDER BY ts, kind <> 'task_assigned' ROWS UNBOUNDED PRECEDING) AS given FROM {_LOG})
SELECT task_id, round((epoch_us(ts) - epoch_us(given)) / 1e6, 3) AS seconds FROM a WHERE kind = 'task_completed' AND given IS NOT NULL""")
def _(spark, d):
    """The last assignment before each completion, over events that come out of order."""
    rows = log(spark, d).select("task_id", "timestamp", "event_type", (F.col("event_type") != "task_assigned").cast("long").alias("o"))
    stream, root = _live(spark, rows, "task_id", "timestamp")
    found = ordered.in_order(stream, "task_id", "timestamp", ordered.LastBefore("event_type", "task_assigned", "task_completed"), "60 days", "o")
    return _run(found, root).select("task_id", F.round("seconds", 3).alias("seconds"))


def _leases(spark, d) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in streams.MOVES])
    return table(spark, d, "events").select((F.col("event_id") % 211).alias("task_id"), "ts", F.col("event_id").alias("seq"), F.element_at(kinds, (F.floor(F.col("event_id") / 211) % 4 + 1).cast("int")).alias("event"))


@query("task_leases_live")
def _(spark, d):
    """Tasks whose claims run out after an hour, each at its last state. The stream must end where the batch does (a test holds it to that)."""
    stream, root = _live(spark, _leases(spark, d), "task_id", "ts")
    found = ordered.in_order(stream, "task_id", "ts", ordered.Leases("event", streams.MOVES, 3600), "60 days", "seq")
    return _run(found, root).groupBy("task_id").agg(F.max_by("state", F.struct("at", F.when(F.col("state") == "sent", 0).otherwise(1))).alias("state"), F.count(F.lit(1)).alias("changes"))


@query("conversations_over_live", """
WITH m AS (SELECT conv_id, turn, sum(coalesce(contains(lower(text), 'the'), false)::INT) OVER w AS a, sum(coalesce(contains(lower(text), 'die'), false)::INT) OVER w AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT conv_id, min(turn) AS turn FROM m WHERE a >= 2 OR b >= 2 GROUP BY conv_id""")
def _(spark, d):
    """When a conversation's words end it, over turns that come out of order."""
    rows = table(spark, d, "conversations").select("conv_id", F.timestamp_seconds(F.col("turn") + 1_000_000_000).alias("ts"), "text")
    stream, root = _live(spark, rows, "conv_id", "ts")
    found = ordered.in_order(stream, "conv_id", "ts", ordered.WordsMet("text", {"the": 2, "die": 2}), "30 days")
    return _run(found, root).select("conv_id", (F.floor(F.col("at") / 1_000_000) - 1_000_000_000).alias("turn"))


@query("growing_lines", "SELECT conv_id, turn, text FROM conversations")
def _(spark, d):
    """Conversations as JSON lines in files that grow; a stream reads them, ends, and goes on from its checkpoint when more has come."""
    root, rows = folder(spark), table(spark, d, "conversations").select("conv_id", "turn", "text")
    live.register(spark)
    for i in range(2):
        rows.where(F.col("conv_id") % 2 == i).write.option("ignoreNullFields", False).mode("append").json(f"{root}/in")
        stream = spark.readStream.format("growing_lines").option("path", f"{root}/in").load()
        found = _run(live.parsed_lines(stream, "conv_id long, turn long, text string").where("NOT malformed").select("conv_id", "turn", "text"), root)
    return found


@query("zipped_chats", "SELECT conv_id, count(*) AS messages, any_value('A' || conv_id % 5) AS assistant_role, any_value('U' || conv_id % 3) AS user_role FROM conversations WHERE conv_id % 11 <> 0 GROUP BY conv_id")
def _(spark, d):
    """Chats in zip archives, one JSON file a chat; those without a task aren't chats."""
    root = folder(spark)
    each = table(spark, d, "conversations").groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("message_"), "turn"), F.coalesce("text", F.lit(""))))).alias("m"))
    head = F.create_map(
        F.lit("role_1"), F.concat(F.lit("A"), F.col("conv_id") % 5, F.lit("_RoleType.ASSISTANT")), F.lit("role_2"), F.concat(F.lit("U"), F.col("conv_id") % 3, F.lit("_RoleType.USER")),
        F.lit("original_task"), F.when(F.col("conv_id") % 11 != 0, F.concat(F.lit("task "), "conv_id")).otherwise(F.lit("")), F.lit("specified_task"), F.lit("more"),
    )
    target = root.removeprefix("file://")

    def write(batches):
        """A task's chats in one archive of the shared folder."""
        import uuid

        import pandas as pd

        Path(target).mkdir(parents=True, exist_ok=True)
        for part in batches:
            with zipfile.ZipFile(f"{target}/{uuid.uuid4().hex}.zip", "w") as z:
                for r in part.itertuples():
                    z.writestr(f"chat_{r.conv_id}.json", r.chat)
            yield pd.DataFrame({"n": [len(part)]})

    each.select("conv_id", F.to_json(F.map_concat("m", head)).alias("chat")).mapInPandas(write, "n long").agg(F.sum("n")).collect()
    live.register(spark)
    chats = live.parsed_chats(spark.read.format("zipped_files").option("path", root).load())
    return chats.select(F.regexp_extract("member", "([0-9]+)", 1).cast("long").alias("conv_id"), F.size("messages").cast("long").alias("messages"), "assistant_role", "user_role")


# Table functions


@query("chunk_windows_sql", r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, n, n * 40 AS first_word, array_to_string(w[n * 40 + 1:n * 40 + 50], ' ') AS chunk FROM (SELECT doc_id, w, unnest(range(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, ceil((len(w) - 10) / 40.0)::BIGINT) END)) AS n FROM w)""")
def _(spark, d):
    table_functions.register(spark)
    table(spark, d, "documents").createOrReplaceTempView("millrace_documents")
    return spark.sql("SELECT d.doc_id, c.n, c.first_word, c.chunk FROM millrace_documents d, LATERAL chunks(d.text, 'windows', 50, 10) c")


@query("matches_sql", r"""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n, regexp_extract(m, '^[a-z]+') AS word, regexp_extract(m, '[0-9]+$') AS number
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]+-[0-9]+')) AS m, generate_subscripts(regexp_extract_all(text, '[a-z]+-[0-9]+'), 1) AS i FROM documents)""")
def _(spark, d):
    table_functions.register(spark)
    table(spark, d, "documents").createOrReplaceTempView("millrace_documents")
    return spark.sql("SELECT d.doc_id, m.n, m.word, m.number FROM millrace_documents d, LATERAL matches(d.text, '(?<word>[a-z]+)-(?<number>[0-9]+)') m")


@query("chunk_chars_sql")
def _(spark, d):
    table_functions.register(spark)
    table(spark, d, "documents").createOrReplaceTempView("millrace_documents")
    return spark.sql("SELECT d.doc_id, c.n, c.start, c.chunk FROM millrace_documents d, LATERAL chunks(d.text, 'chars', 500) c")


# Graphs


@query("node_link_files", f"SELECT src AS source, dst AS target, type FROM {_EDGES} UNION ALL SELECT id, NULL, 'node' FROM (SELECT src AS id FROM {_EDGES} UNION SELECT 'n' || n_nationkey FROM nation UNION SELECT 'r' || r_regionkey FROM region)")
def _(spark, d):
    """A graph written as node-link files and read back: its links, and its nodes as rows without a target."""
    (nodes, edges), path = places(spark, d), folder(spark)
    graph.write_node_link(nodes, edges, path)
    nodes, edges = graph.read_node_link(spark, path)
    return edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "type").union(nodes.select("id", F.lit(None).cast("string"), F.lit("node")))


@query("walk_stratified")
def _(spark, d):
    """A twentieth of customers, suppliers, nations and regions, as many of each as their share, by walks that prefer heavy edges."""
    nodes, edges = places(spark, d)
    nodes = nodes.withColumn("kind", F.substring("id", 1, 1))
    weighed = edges.withColumn("weight", 1 + F.pmod(F.xxhash64("src"), F.lit(5)))
    regions = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"), F.lit("PART_OF").alias("type"), F.lit(1).cast("long").alias("weight"))
    return graph.walk_sample(nodes, weighed.union(regions), ["n1", "n2"], 0.05, seed=5, label="kind", weight="weight")
