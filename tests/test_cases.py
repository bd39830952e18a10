"""Literal cases and properties of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import embedding
from millrace.functions import filters as P
from millrace.functions import numbers as N
from millrace.functions import parsing as X
from millrace.functions import schemas
from millrace.functions import similarity as S
from millrace.functions import text as T
from millrace.operators import conversation, curation, dedup, evaluation, graph, retrieval, vector, verify, workflow
from millrace.plans import generate
from millrace.sources import readers, sheets, sinks
from millrace.streaming import streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def vectors(spark, *vs):
    return spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(vs)], "idx long, embedding array<double>")


def targets(df):
    return {r.idx: r.target for r in df.collect()}


def test_equal_vectors_point_to_the_first(spark):
    assert targets(dedup.best_earlier(vectors(spark, *[[0.5] * 3] * 4), 0.9)) == {1: 0, 2: 0, 3: 0}


def test_one_pair(spark):
    assert targets(dedup.best_earlier(vectors(spark, [1, 0, 0], [0, 1, 0], [0, 0.99, 0], [0, 0, 1]), 0.95)) == {2: 1}


def test_chains_are_kept(spark):
    chain = vectors(spark, [1, 0], [0.87, 0.5], [0.5, 0.87], [0, 1])
    assert targets(dedup.best_earlier(chain, 0.8)) == {1: 0, 2: 1, 3: 2}
    assert targets(dedup.best_earlier(chain, 0.8, block=2)) == {1: 0, 2: 1, 3: 2}
    assert [r.idx for r in dedup.deduplicate(chain, 0.8).where("is_unique").collect()] == [0]


def test_greedy_keeps_what_is_unlike_the_kept(spark):
    chain = vectors(spark, [1, 0], [0.87, 0.5], [0.5, 0.87], [0, 1])
    assert sorted(r.idx for r in dedup.greedy_kept(chain, 0.8).collect()) == [0, 2]
    assert dedup.greedy_kept(vectors(spark), 0.8).count() == 0


def test_filters(spark):
    check = lambda p, t: one(spark, p(F.lit(t)))
    assert check(lambda t: P.length_ok(t, 2, 5), "This is four words") and not check(lambda t: P.length_ok(t, 2, 5), "Hello")
    assert not check(lambda t: P.keyword_ok(t, ["IMAGE"]), "an Image")
    assert not check(P.punctuation_ok, "!Invalid") and check(P.punctuation_ok, "élan")
    assert not check(P.english_start_ok, "¿Qué") and not check(P.english_start_ok, "文字")
    assert not one(spark, P.length_ok(F.lit(None).cast("string")))
    assert not check(lambda t: P.task_content_ok(t, 1, True), "Task failed") and check(P.task_content_ok, "Task failed")
    with pytest.raises(ValueError):
        P.InstructionFilter({"nothing": {}})


def test_scores_reach(spark):
    scores = F.create_map(F.lit("a"), F.lit(0.9), F.lit("b"), F.lit(0.4))
    assert not one(spark, P.scores_reach(scores, 0.5)) and one(spark, P.scores_reach(scores, {"a": 0.8})) and one(spark, P.scores_reach(scores, {}))


def test_rouge(spark):
    known = ["Write a summary of this document."]
    df = spark.createDataFrame([("Write a summary of this paragraph.",), ("Compute the integral of x squared.",)], "text string")
    assert [r.text for r in evaluation.rouge_filter(df, known).collect()] == ["Compute the integral of x squared."]
    assert evaluation.rouge_filter(df, []).count() == 2
    assert evaluation._rouge("a b c d".split(), "a c x d".split()) == pytest.approx(0.75)


def test_vector_store(spark):
    store = spark.createDataFrame([("v0", [0.1, 0.1, 0.1, 0.1]), ("v1", [0.1, -0.1, -0.1, 0.1]), ("v2", [-0.1, 0.1, -0.1, 0.1]), ("v3", [-0.1, 0.1, 0.1, 0.1])], "id string, vector array<double>")
    assert [r.id for r in vector.top_k(store, [1, 1, 1, 1], 2).orderBy("rank").collect()] == ["v0", "v3"]
    left = vector.delete(store, ["v1", "v3"])
    assert [r.id for r in vector.top_k(left, [1, 1, 1, 1], 9).orderBy("rank").collect()] == ["v0", "v2"]
    assert vector.status(left).first().vector_count == 2
    with pytest.raises(ValueError):
        vector.delete(store)


def test_inverted_file_recall(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    found = {r.id for r in vector.InvertedFile(df, 8).search(x[3].tolist(), 10, probes=6).collect()}
    want = {r.id for r in vector.top_k(df, x[3].tolist(), 10).collect()}
    assert len(found & want) >= 9


def test_rank_fusion(spark):
    v = spark.createDataFrame([("D1", 1), ("D2", 2)], "text string, rank int")
    b = spark.createDataFrame([("D2", 1), ("D3", 2)], "text string, rank int")
    assert [r.text for r in retrieval.rank_fusion(v, b, 2).orderBy("rank").collect()] == ["D2", "D1"]
    with pytest.raises(ValueError):
        retrieval.hybrid(v, b, 100)


def test_context_budget(spark):
    df = spark.createDataFrame([("c", "a", 12, 0.3, 1.0, "user"), ("c", "Hello world!", 10, 0.9, 2.0, "user"), ("c", "b", 11, 0.7, 3.0, "user")], "conv_id string, uuid string, tokens int, score double, timestamp double, role string")
    assert [r.uuid for r in conversation.context(df, 15).collect()] == ["Hello world!"]
    assert [r.uuid for r in conversation.context(df, 99).orderBy("position").collect()] == ["a", "Hello world!", "b"]
    small = spark.createDataFrame([("c", 1, 9, 0.9, 1.0), ("c", 2, 9, 0.8, 1.0), ("c", 3, 1, 0.1, 1.0)], "conv_id string, id int, tokens int, score double, timestamp double")
    assert sorted(r.id for r in conversation.packed(small, 10).collect()) == [1, 3]


def test_window(spark):
    df = spark.createDataFrame([("c", 0, "system"), ("c", 1, "user"), ("c", 2, "assistant"), ("c", 3, "user")], "conv_id string, turn int, role string")
    got = {r.turn: round(r.score, 4) for r in conversation.windowed(df, 2).collect()}
    assert got == {0: 1.0, 2: 0.81, 3: 0.9}
    assert [r.turn for r in conversation.windowed(df, 0).collect()] == [0]


def test_image_tokens(spark):
    size = lambda w, h: one(spark, conversation.image_tokens(F.lit(float(w)), F.lit(float(h)), F.lit(False)))
    assert size(1024, 1024) == 765 and size(2048, 4096) == 1105


def test_parsers():
    assert X.boxed(r"\boxed{nested {braces} test}") == "nested {braces} test"
    assert X.boxed(r"\boxed{open") is None and X.boxed("") is None
    assert X.literal(list)("[3, 1, 2]") == "[1, 2, 3]" and X.literal(set)("[1]") is None and X.literal(tuple)("(1, 2)") == "(1, 2)"
    assert not X.same_call("not a call(", "not a call(") and X.same_call("f(1, x=2)", "f(1,x=2)")
    assert "".join(X.char_chunks("One. Two. Three and more" * 9, 20)) == "One. Two. Three and more" * 9
    assert [b["kind"] for b in X.blocks("a\n```py\nx\n```\nb")] == ["text", "code", "text"]
    assert X.instances("Example 1\nInput: a\nOutput: b") == [{"input": "a", "output": "b"}]
    assert X.file_name("héllo/wörld?.html") == "hello_world_.html"


def test_text_functions(spark):
    assert one(spark, T.pascal(F.lit("snake_case_name"))) == "SnakeCaseName" and one(spark, T.pascal(F.lit("HelloWorld"))) == "HelloWorld"
    assert one(spark, T.task_list(F.lit("1. Do this!\n2. And that\nnothing"))) == ["Do this", "And that"]
    assert [r.content for r in one(spark, T.tagged_tasks(F.lit("<task>a</task> <task> b </task>")))] == ["a", "b"]
    assert one(spark, T.tool_calls(F.lit("<tool_call>{'name': 'f'}</tool_call><tool_call>{</tool_call>"))) == ['{"name": "f"}']
    nodes = one(spark, T.graph_nodes(F.lit("Node(id='A', type='Person') Node(id='B', type='City')")))
    assert [(n.id, n.type) for n in nodes] == [("A", "Person"), ("B", "City")]
    assert one(spark, T.answer_correct(F.lit("$1,000"), F.lit("1000"))) and one(spark, T.answer_correct(F.lit("a, B"), F.lit("A;b"))) and not one(spark, T.answer_correct(F.lit("a"), F.lit("a,b")))
    assert one(spark, T.alpaca_parts(F.lit("### Instruction:\nDo\n\n### Input:\nx\n\n### Response:\ny"))).output == "y"
    with pytest.raises(Exception, match="not an alpaca"):
        one(spark, T.alpaca_parts(F.lit("nothing")))


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.4), (0, float("nan"))], "t int, p double")
    assert evaluation.rmse(df, "t", "p").first().rmse == pytest.approx(math.sqrt((0.01 + 0.01 + 0.36) / 3))
    assert evaluation.auroc(df, "t", "p").first().auroc == 1.0
    assert evaluation.auroc(df.where("false"), "t", "p").first().auroc == 0.5
    assert evaluation.rmse(df.where("false"), "t", "p").first().rmse is None


def test_similarity(spark):
    a, b = S.literal([3, 4]), S.literal([4, 3])
    assert one(spark, S.cosine(a, b)) == pytest.approx(0.96) and one(spark, S.cosine_or_zero(a, S.literal([0, 0]))) == 0
    with pytest.raises(Exception, match="differ in length"):
        one(spark, S.inner_product(a, S.literal([1])))


def test_graph(spark):
    edges = spark.createDataFrame([("A", "B", "X"), ("B", "C", "X")], "src string, dst string, type string")
    nodes = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "id string")
    assert graph.shortest_path(edges, "A", "C").first().path == ["A", "B", "C"]
    assert graph.shortest_path(edges, "A", "D").first().message == "No path exists between 'A' and 'D'"
    assert {r.id: r.degree for r in graph.degree_centrality(nodes, edges).collect()} == {"A": 1, "B": 2, "C": 1, "D": 0}
    n, e = graph.delete_triplet(nodes, edges, "A", "B", "x")
    assert {r.id for r in n.collect()} == {"B", "C", "D"} and e.count() == 1
    weighted = spark.createDataFrame([("A", "C", 5.0), ("A", "B", 1.0), ("B", "C", 1.5)], "src string, dst string, w double")
    assert graph.shortest_path(weighted, "A", "C", weight="w").first().length == 2.5
    walk = [{r.id for r in graph.walk_sample(nodes, edges, ["A"], 0.5, seed=1, neighbour_aware=aware).collect()} for aware in (False, True, False)]
    assert walk[0] == walk[2] and walk[0] <= {"A", "B", "C"} and "A" in walk[1]


def test_workflow(spark):
    t = spark.createDataFrame([("a", []), ("b", ["a"]), ("c", ["a", "b"])], "task_id string, dependencies array<string>")
    assert {r.task_id: r.level for r in workflow.levels(t).collect()} == {"a": 0, "b": 1, "c": 2}
    done = spark.createDataFrame([("a",)], "task_id string")
    assert [r.task_id for r in workflow.ready(t, done).collect()] == ["b"]
    with pytest.raises(ValueError, match="cycle"):
        workflow.levels(spark.createDataFrame([("a", ["b"]), ("b", ["a"])], "task_id string, dependencies array<string>"))


def test_verification(spark):
    assert verify.close({"a": [1, 2.0000001]}, {"a": [1, 2.0]}) and not verify.close([1], (1,))
    rows = spark.createDataFrame([("1", "1"), ("x", "1")], "s string, r string")
    got = verify.verified(rows, lambda a, b: int(a) == int(b), "s", "r").orderBy("s").collect()
    assert [r.status for r in got] == ["success", "error"] and "invalid literal" in got[1].error_message
    state, reward, done = verify.tic_tac_toe(verify.tic_tac_toe_start(), "5")
    assert state["board"].count("O") == 1 and not done


def test_sheets(spark):
    book = spark.createDataFrame([("s", 1, 1, "a"), ("s", 1, 2, "b"), ("s", 2, 1, None)], "sheet string, row int, col int, value string")
    assert sheets.cell_address("AB12") == (12, 28)
    assert sheets.cell(sheets.set_cell(book, "s", "B1", 7), "s", "B1").first().value == "7"
    assert sheets.rows(book, "s").count() == 1
    assert sheets.rows(sheets.append_row(book, "s", ["x", None]), "s").count() == 2


def test_hub(spark, tmp_path):
    hub = sinks.Hub(spark, str(tmp_path))
    hub.add("d", spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"))
    hub.update("d", spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"))
    hub.delete("d", 1)
    assert {(r.id, r.v) for r in hub.records("d").collect()} == {(2, "c"), (3, "d")} and hub.names() == ["d"]
    with pytest.raises(Exception, match="(?i)exists"):
        hub.add("d", spark.range(1))
    store = sinks.ObjectStore(spark, f"{tmp_path}/objects")
    store.put("x.bin", b"\0\1")
    assert store.exists("x.bin") and store.get("x.bin") == b"\0\1"
    log = sinks.KeyValueLog(spark, f"{tmp_path}/kv", "k string, v int")
    assert log.load().count() == 0
    log.save(spark.createDataFrame([("a", 1)], "k string, v int"))
    assert log.load().first().v == 1


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"question": "q", "final_answer": "a"}\n\n{"question": "q"}\n')
    assert readers.dataset_from_jsonl(spark, str(tmp_path / "a.jsonl")).count() == 1
    with pytest.raises(Exception, match="lacks its question"):
        readers.dataset_from_jsonl(spark, str(tmp_path / "a.jsonl"), strict=True).collect()
    (tmp_path / "t.csv").write_text("country,sales\nFR,1\nDE,2\n")
    assert readers.load(spark, str(tmp_path / "t.csv")).agg(F.sum("sales")).first()[0] == 3
    with pytest.raises(ValueError):
        readers.load(spark, "x.pkl")
    with pytest.raises(ValueError):
        readers.load(spark, "x.unknown")
    (tmp_path / "h.html").write_text("<html><script>x</script><p>Hello <b>World</b></p><table><tr><td>1</td><td>2</td></tr></table></html>")
    assert "Hello" in readers.visible_text((tmp_path / "h.html").read_text()) and "x" not in readers.visible_text("<script>x</script>")
    assert readers.load(spark, str(tmp_path / "h.html")).first().cells == ["1", "2"]
    docs = readers.documents_from_files(spark, str(tmp_path / "h.html")).first()
    assert docs.page == 1 and docs.page_content.startswith("Hello")


def test_numbers_schemas_and_registry(spark):
    assert one(spark, N.multiply(F.lit(2.0), F.lit(1.125))) == 2.25
    assert one(spark, N.determinant(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))))) == pytest.approx(-2)
    kind = schemas.type_from_json_schema({"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": {"type": "string"}}}, "required": ["a"]})
    assert kind.simpleString() == "struct<a:bigint,b:array<string>>" and not kind["a"].nullable

    def plus(a: int, b: int = 1) -> int:
        """Adds."""
        return a + b

    registry = schemas.FunctionRegistry(spark)
    registry.register(plus)
    assert spark.sql("SELECT plus(2, 3) AS x").first().x == 5 and registry.schemas["plus"]["parameters"]["required"] == ["a"]


def test_generation(spark):
    seeds = spark.createDataFrame([(f"Describe the {w} in a few plain words please",) for w in ("sea", "sky", "sun", "moon", "wind", "rain")], "instruction string")
    words = iter(range(10**6))
    got = generate.self_instruct(seeds, lambda ps: [f"Explain number {hash(p) % 97} and what follows from it in detail" for p in ps], 1, 4)
    assert got.count() >= 1 and next(words) == 0
    problems = spark.createDataFrame([(1, "p")], "id int, problem string")
    scorer = lambda df: df.withColumn("scores", F.create_map(F.lit("a"), F.col("rounds") * 0.5))
    done = generate.improved(problems, lambda ps: [p + "!" for p in ps], scorer, 0.7, 3).collect()
    assert len(done) == 1 and done[0].ok and done[0].rounds == 2


def test_streams(spark, tmp_path):
    assert streams.batch_size(10, True) == 12 and streams.batch_size(1, False) == 1 and streams.batch_size(19, True) == 20
    source = tmp_path / "in"
    spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "stream_id string, seq long, chunk string").coalesce(1).write.json(str(source))
    stream = spark.readStream.schema("stream_id string, seq long, chunk string").json(str(source))
    q = streams.accumulating(stream).writeStream.format("memory").queryName("texts").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.stream_id, r.text) for r in spark.table("texts").collect()} == {("a", "xy"), ("b", "z")}
    streams.appended(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_curation(spark):
    df = spark.createDataFrame([(1, "The first sentence. The second sentence. A third one. And a fourth sentence.")], "doc_id int, text string")
    got = curation.triples(df).orderBy("pos").collect()
    assert [r.conclusion for r in got] == ["A third one", "And a fourth sentence"] and got[0].related == ["A third one", "And a fourth sentence"]
    assert curation.hash_sample(df, 5, "doc_id").count() == 1


def test_embedding(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "c")], "doc_id int, text string")
    rows = {r.doc_id: r.vector for r in embedding.embedded(df, "text").collect()}
    assert rows[1] == rows[2] and sum(x * x for x in rows[1]) == pytest.approx(1) and not any(rows[3])
    calls = spark.createDataFrame([("a b", [1.0])], "text string, vector array<double>")
    with_cache, full = embedding.embedded_with_cache(df.where("text IS NOT NULL"), calls, "text")
    assert {r.doc_id: r.vector for r in with_cache.collect()}[1] == [1.0] and full.count() == 2
    assert embedding.indexed(df).count() == 3


def test_arithmetic():
    assert verify.math_equal(r"\\frac{1}{2}".replace("\\\\", "\\"), "0.5") and verify.math_equal("1,000", "10^3") and not verify.math_equal("x+1", "x+2") and verify.math_equal("x + 1", "x+1")
    assert verify.numeric_value("__import__('os')") is None and verify.numeric_value("9^9^9^9") is None and verify.numeric_value("1/0") is None
