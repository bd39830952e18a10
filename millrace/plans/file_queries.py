"""Queries that write tables to files and stores and read them back."""

from __future__ import annotations

import io
import tempfile
import uuid

from pyspark.sql import functions as F

from millrace.plans.catalog import query, table
from millrace.plans.chat_queries import _EDGES, places
from millrace.sources import markup, readers, sheets, sinks
from millrace.streaming import streams

_own: dict[str, str] = {}
_lit = F.lit


def folder(spark) -> str:
    """A new folder that driver and executors see: below ``spark.checkpoint.dir``, in a local session without it a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        root = _own.setdefault("", tempfile.mkdtemp(prefix="millrace-"))
    return f"{root.rstrip('/')}/millrace/files-{uuid.uuid4().hex}"


_CUSTOMERS = "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer"


def _customers(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


def _round_trip(kind: str, suffix: str):
    @query(f"load_{suffix}", _CUSTOMERS)
    def _(spark, d):
        path = f"{folder(spark)}/customers.{suffix}"
        sinks.save(_customers(spark, d), path, kind)
        return readers.load(spark, path).select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


for _kind, _suffix in (("csv", "csv"), ("json", "jsonl"), ("parquet", "parquet"), ("orc", "orc")):
    _round_trip(_kind, _suffix)


@query("load_tsv", "SELECT p_partkey, p_name, p_type FROM part")
def _(spark, d):
    path = f"{folder(spark)}/parts.tsv"
    table(spark, d, "part").select("p_partkey", "p_name", "p_type").write.options(header=True, sep="\t").csv(path)
    return readers.load(spark, path)


@query("load_many", "SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'even.csv' ELSE 'odd.csv' END AS file FROM nation")
def _(spark, d):
    root, nations = folder(spark), table(spark, d, "nation").select("n_nationkey", "n_name")
    paths = [f"{root}/even.csv", f"{root}/odd.csv"]
    for i, path in enumerate(paths):
        sinks.save(nations.where(F.col("n_nationkey") % 2 == i), path, "csv")
    return readers.load_many(spark, paths).select("n_nationkey", "n_name", F.regexp_extract("source_path", r"([^/]+)$", 1).alias("file"))


@query("load_sql", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY c_mktsegment")
def _(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("millrace_customers")
    return readers.load_sql(spark, "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM millrace_customers GROUP BY c_mktsegment")


@query("load_html_tables", "SELECT 'part ' || p_partkey AS part, p_name || ' & ' || p_type AS text FROM part")
def _(spark, d):
    path, key = f"{folder(spark)}/parts.html", F.col("p_partkey").cast("string")
    rows = table(spark, d, "part").select(F.concat(F.lit("<table><tr><th> part "), key, F.lit("<td>"), F.col("p_name"), F.lit(" &amp;\t"), F.col("p_type"), F.lit("</td></tr></table>")).alias("value"))
    rows = rows.select(F.replace("value", F.lit("<td>"), F.lit("</th><td>")).alias("value"))
    rows.write.text(path)
    return readers.load(spark, path).select(F.col("cells")[0].alias("part"), F.col("cells")[1].alias("text"))


@query("dataset_jsonl", "SELECT item_id::VARCHAR AS question, text AS final_answer, CASE WHEN item_id % 3 = 0 THEN 'why ' || item_id END AS rationale FROM benchmark WHERE item_id % 5 <> 0 AND text IS NOT NULL")
def _(spark, d):
    path, key = f"{folder(spark)}/points", F.col("item_id").cast("string")
    rows = table(spark, d, "benchmark").select(key.alias("question"), F.when(F.col("item_id") % 5 != 0, F.col("text")).alias("final_answer"), F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("why "), key)).alias("rationale"))
    sinks.append_jsonl(rows, path)
    spark.createDataFrame([("  ",)], "value string").write.mode("append").text(path)
    return readers.dataset_from_jsonl(spark, path).select("question", "final_answer", "rationale")


@query("role_names", "SELECT n_name || ' ' || n_regionkey AS role FROM nation")
def _(spark, d):
    path = f"{folder(spark)}/roles"
    table(spark, d, "nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(". "), "n_name", F.lit(" "), F.col("n_regionkey").cast("string")).alias("value")).write.text(path)
    return readers.role_names(spark, path)


@query("seed_tasks", "SELECT p_partkey AS id, p_name AS instruction, p_size > 25 AS is_classification FROM part")
def _(spark, d):
    path = f"{folder(spark)}/seeds"
    table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("instruction"), (F.col("p_size") > 25).alias("is_classification")).write.json(path)
    return readers.seed_tasks(spark, path)


@query("append_jsonl", "SELECT event_type, 2 * count(*) AS n, 2 * sum(user_id)::BIGINT AS users FROM events GROUP BY event_type")
def _(spark, d):
    path = f"{folder(spark)}/log"
    for _ in range(2):
        sinks.append_jsonl(table(spark, d, "events").select("event_type", "user_id"), path)
    return spark.read.json(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("user_id").cast("long").alias("users"))


@query("finite_numbers", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber NOT IN (1, 2) THEN l_tax END AS tax FROM lineitem")
def _(spark, d):
    odd = F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).when(F.col("l_linenumber") == 2, F.lit(float("-inf"))).otherwise(F.col("l_tax"))
    return sinks.clean_numbers(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", odd.alias("tax")))


@query("passage_replaced", "SELECT p_partkey, replace(p_name || ' of ' || p_brand, ' of Brand', ' by Brand') AS name FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", sinks.replaced(F.concat("p_name", F.lit(" of "), "p_brand"), " of Brand", " by Brand").alias("name"))


@query("markdown_lines", "SELECT '| ' || c_custkey || ' | ' || c_name || ' | ' || coalesce(c_mktsegment, '') || ' |' AS line FROM customer")
def _(spark, d):
    return sinks.markdown_table(table(spark, d, "customer"), ["c_custkey", "c_name", "c_mktsegment"])


@query("hub_records", """
SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 3 THEN upper(p_name) ELSE p_name END AS content FROM part WHERE (p_partkey % 2 = 0 OR p_partkey % 10 = 3) AND p_partkey <> 4""")
def _(spark, d):
    hub, parts = sinks.Hub(spark, folder(spark)), table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("content"))
    hub.add("parts", parts.where("id % 2 = 0"))
    hub.update("parts", parts.where("id % 10 = 3").select("id", F.upper("content").alias("content")))
    hub.delete("parts", 4)
    if hub.names() != ["parts"]:
        raise AssertionError("the hub lists other datasets")
    return hub.records("parts")


@query("key_value_log", "SELECT conv_id, turn, role FROM conversations UNION ALL SELECT conv_id, turn, role FROM conversations WHERE turn = 0")
def _(spark, d):
    chats = table(spark, d, "conversations").select("conv_id", "turn", "role")
    log = sinks.KeyValueLog(spark, f"{folder(spark)}/log", chats.schema)
    log.save(chats)
    log.clear()
    log.save(chats)
    log.save(chats.where("turn = 0"))
    return log.load()


def _book(spark, d):
    return sheets.cells(table(spark, d, "nation"), "nation", "n_nationkey")


_CELLS = "(SELECT 'nation' AS sheet, (row_number() OVER (ORDER BY n_nationkey))::INT AS row, unnest([1, 2, 3])::INT AS col, unnest([n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR]) AS value FROM nation)"


@query("sheet_set_cell", f"SELECT sheet, row, col, CASE WHEN row = 3 AND col = 2 THEN 'changed' ELSE value END AS value FROM {_CELLS}")
def _(spark, d):
    return sheets.set_cell(_book(spark, d), "nation", "B3", "changed")


@query("sheet_cell", f"SELECT value FROM {_CELLS} WHERE row = 7 AND col = 2")
def _(spark, d):
    return sheets.cell(_book(spark, d), "nation", "B7")


@query("sheet_rows_changed", f"""
SELECT * FROM {_CELLS} WHERE row <> 2 UNION ALL SELECT 'nation', 2, 1, 'a' UNION ALL SELECT 'nation', 2, 2, NULL
UNION ALL SELECT 'nation', (SELECT max(row) + 1 FROM {_CELLS}), unnest([1, 2]), unnest(['x', 'y'])""")
def _(spark, d):
    return sheets.append_row(sheets.update_row(_book(spark, d), "nation", 2, ["a", None]), "nation", ["x", "y"])


@query("sheet_delete_columns", f"SELECT sheet, row, CASE WHEN col = 3 THEN 2 ELSE col END AS col, value FROM {_CELLS} WHERE col <> 2")
def _(spark, d):
    return sheets.delete_columns(_book(spark, d), "nation", 2)


@query("sheets_to_csv", '''
SELECT 'nation' AS sheet, n_nationkey || ',' || n_name || ',' || n_regionkey AS line FROM nation UNION ALL SELECT 'region', r_regionkey || ',"' || r_name || ', or ""' || r_regionkey || '"""' FROM region''')
def _(spark, d):
    quoted = table(spark, d, "region").select("r_regionkey", F.concat("r_name", F.lit(', or "'), F.col("r_regionkey").cast("string"), F.lit('"')).alias("r_name"))
    path = f"{folder(spark)}/csv"
    sheets.to_csv(_book(spark, d).union(sheets.cells(quoted, "region", "r_regionkey")), path)
    return spark.read.text(path).select("sheet", F.col("value").alias("line"))


@query("file_elements", "SELECT 'Title' AS kind, 'Part ' || p_partkey AS text FROM part UNION ALL SELECT 'ListItem', p_name FROM part UNION ALL SELECT 'NarrativeText', 'It is of the kind ' || p_type || ', and of size ' || p_size || '.' FROM part")
def _(spark, d):
    path, key = f"{folder(spark)}/parts", F.col("p_partkey").cast("string")
    page = F.concat(F.lit("<html><head><title>x</title><body><h2>Part "), key, F.lit("</h2><ul><li>"), "p_name", F.lit("</li></ul><p>It is of the kind <b>"), "p_type", F.lit("</b>, and of size "), F.col("p_size").cast("string"), F.lit(".</p>"))
    pages = table(spark, d, "part").select(page.alias("html"))
    return markup.elements_of(pages, "html").select("kind", "text")


@query("files_to_markdown", "SELECT '# Part ' || p_partkey || chr(10) || chr(10) || '- ' || p_name || chr(10) || chr(10) || '[' || p_type || '](/t/' || p_size || ') **' || p_brand || '**' AS markdown FROM part")
def _(spark, d):
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    page = F.concat(F.lit("<h1>Part "), key, F.lit("</h1><ul><li>"), "p_name", F.lit("</li></ul><p><a href='/t/"), size, F.lit("'>"), "p_type", F.lit("</a> <strong>"), "p_brand", F.lit("</strong></p>"))
    return table(spark, d, "part").select(markup.html_markdown(page).alias("markdown"))


@query("csv_files_to_markdown", "SELECT '| ' || n_nationkey || ' | ' || n_name || ' |' AS line FROM nation UNION ALL SELECT '| key | name |' UNION ALL SELECT '| --- | --- |'")
def _(spark, d):
    path = f"{folder(spark)}/nations.csv"
    table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).coalesce(1).write.option("header", True).csv(path)
    found = markup.markdown_files(spark, f"{path}/*.csv")
    return found.select(F.explode(F.split("markdown", "\n")).alias("line"))


@query("staged_for_tools", """
SELECT kind, item_id, CASE kind WHEN 'dataframe' THEN text WHEN 'baseplate' THEN text WHEN 'label_box' THEN sha256(text) WHEN 'weaviate' THEN text WHEN 'csv_for_prodigy' THEN text ELSE text END AS value
FROM (SELECT item_id, text, unnest(['dataframe', 'elements', 'csv_for_prodigy', 'baseplate', 'label_box', 'weaviate']) AS kind FROM benchmark)""")
def _(spark, d):
    items = table(spark, d, "benchmark").select(F.sha2("text", 256).alias("element_id"), "text", F.to_json(F.struct("item_id")).alias("metadata"))
    item = lambda c: F.get_json_object(c, "$.item_id").cast("long")
    frame = sinks.staged(items, "dataframe").select(F.lit("dataframe").alias("kind"), item("metadata").alias("item_id"), F.col("text").alias("value"))
    back = sinks.staged(sinks.staged(items, "dict"), "elements").select(F.lit("elements").alias("kind"), item("metadata").alias("item_id"), F.col("text").alias("value"))
    prodigy = sinks.staged(items, "csv_for_prodigy").select(F.lit("csv_for_prodigy").alias("kind"), F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("value"))
    base = sinks.staged(items, "baseplate").select(F.lit("baseplate").alias("kind"), F.get_json_object("value", "$.metadata.item_id").cast("long").alias("item_id"), F.get_json_object("value", "$.data.text").alias("value"))
    box = sinks.staged(items, "label_box").select(F.lit("label_box").alias("kind"), F.get_json_object("value", "$.attachments.item_id").cast("long").alias("item_id"), F.get_json_object("value", "$.externalId").alias("value"))
    weave = sinks.staged(items, "weaviate").select(F.lit("weaviate").alias("kind"), F.get_json_object("value", "$.item_id").cast("long").alias("item_id"), F.get_json_object("value", "$.text").alias("value"))
    return frame.union(back).union(prodigy).union(base).union(box).union(weave)


@query("saved_json", "SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal FROM customer")
def _(spark, d):
    path = f"{folder(spark)}/customers.json"
    sinks.save_json(table(spark, d, "customer").select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal")), path)
    return spark.read.json(path)


@query("memory_store", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def _(spark, d):
    store, nations = sinks.MemoryStore(), table(spark, d, "nation")
    store.save(nations.select("n_nationkey", "n_name"))
    store.clear()
    store.save(nations.select("n_nationkey", "n_name"))
    store.save(nations.where("n_regionkey = 1").select("n_nationkey", "n_name"))
    return store.load()


@query("file_documents", "SELECT 'txt' AS kind, string_agg(n_name, chr(10) ORDER BY n_nationkey) || chr(10) AS page_content FROM nation UNION ALL SELECT 'json', '{\"r_regionkey\": ' || r_regionkey || ', \"r_name\": \"' || r_name || '\"}' FROM region WHERE r_regionkey = 2 UNION ALL SELECT 'html', 'Nations' || chr(10) || string_agg(n_name, chr(10) ORDER BY n_nationkey) FROM nation")
def _(spark, d):
    root = folder(spark)
    names = table(spark, d, "nation").orderBy("n_nationkey").coalesce(1)
    names.select(F.concat("n_name", _lit("  \n ")).alias("value")).write.text(f"{root}/txt")
    table(spark, d, "region").where("r_regionkey = 2").coalesce(1).write.json(f"{root}/json")
    page = names.agg(F.concat(_lit("<html><head><title>no</title><body><h1>Nations</h1>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(_lit("<p>"), x["n_name"])), "")).alias("value"))
    page.coalesce(1).write.text(f"{root}/page")
    found = None
    for kind, path in (("txt", f"{root}/txt/*.txt"), ("json", f"{root}/json/*.json")):
        own = readers.documents_from_files(spark, path).select(_lit(kind).alias("kind"), "page_content")
        found = own if found is None else found.union(own)
    html = spark.read.text(f"{root}/page").select(_lit("html").alias("kind"), readers.html_text(F.col("value")).alias("page_content"))
    return found.union(html)


def _bytes(write) -> bytes:
    out = io.BytesIO()
    write(out)
    return out.getvalue()


@query("load_feather", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, d):
    store, nations = sinks.ObjectStore(spark, folder(spark)), table(spark, d, "nation")
    for i in range(2):
        store.put(f"nations.feather/part-{i}.feather", _bytes(nations.where(F.col("n_nationkey") % 2 == i).toPandas().to_feather))
    return readers.load(spark, f"{store.root}/nations.feather")


@query("load_stata", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def _(spark, d):
    store = sinks.ObjectStore(spark, folder(spark))
    store.put("regions.dta", _bytes(lambda out: table(spark, d, "region").toPandas().to_stata(out, write_index=False)))
    return readers.load(spark, f"{store.root}/regions.dta").withColumn("r_regionkey", F.col("r_regionkey").cast("long"))


@query("object_store", "SELECT r_name AS name, r_name || ' ' || r_regionkey AS content, true AS stored, false AS other FROM region")
def _(spark, d):
    store, rows = sinks.ObjectStore(spark, folder(spark)), table(spark, d, "region").collect()
    for r in rows:
        store.put(f"regions/{r.r_name}", f"{r.r_name} {r.r_regionkey}".encode())
    found = [(r.r_name, store.get(f"regions/{r.r_name}").decode(), store.exists(f"regions/{r.r_name}"), store.exists(f"other/{r.r_name}")) for r in rows]
    return spark.createDataFrame(found, "name string, content string, stored boolean, other boolean")


@query("clipboard_table", "SELECT unnest([1, 2])::BIGINT AS id, unnest(['a', 'b']) AS name")
def _(spark, d):
    return readers.from_clipboard(spark, "id  name\n1\ta\n2   b\n")


@query("crawled", f"""
WITH e AS (SELECT src, dst FROM {_EDGES} UNION SELECT dst, src FROM {_EDGES}), one AS (SELECT DISTINCT dst AS url FROM e WHERE src = 's1'), two AS (SELECT DISTINCT e.dst AS url FROM e JOIN one ON e.src = one.url WHERE e.dst <> 's1')
SELECT 's1' AS url, 0 AS depth UNION ALL SELECT url, 1 FROM one UNION ALL SELECT url, 2 FROM two""")
def _(spark, d):
    edges = places(spark, d)[1]
    both = edges.select(F.col("src").alias("url"), F.col("dst").alias("link")).union(edges.select("dst", "src"))
    return sinks.crawl(spark.createDataFrame([("s1",)], "url string"), lambda front: both.join(front, "url", "left_semi"), depth=2)


@query("stream_accumulated_live", "SELECT conv_id::VARCHAR AS stream_id, count(*) AS n, string_agg(coalesce(text, ''), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def _(spark, d):
    """The streaming form: two files of chunks come one after the other; the last state of each stream counts."""
    root, chats = folder(spark), table(spark, d, "conversations")
    chunks = chats.select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").alias("seq"), F.coalesce("text", _lit("")).alias("chunk"))
    for late in (False, True):
        chunks.where((F.col("seq") >= 2) == late).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    live = streams.accumulating(stream).writeStream.outputMode("update").foreachBatch(lambda rows, _: rows.write.mode("append").parquet(f"{root}/out"))
    run = live.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("stream_id").agg(F.max("n").alias("n"), F.max_by("text", "n").alias("text"))
