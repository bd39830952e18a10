"""Versioned tables and stored indexes: failures at each step, other writers, pruned files, recall and exact results."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators.keyword_index import KeywordIndex
from millrace.operators.vector_index import NeighbourGraph, VectorLists
from millrace.sources import sinks, versions
from millrace.sources.versions import Conflict, VersionedTable

SCHEMA = "id long, v string"


def shown(df):
    return sorted((str(r.id), r.v) for r in df.collect())


@pytest.fixture
def made(spark, tmp_path):
    return VersionedTable.create(spark, f"{tmp_path}/t", spark.createDataFrame([(i, f"a{i}") for i in range(40)] + [(None, "none")], SCHEMA), "id", parts=4, card="forty")


def test_versions_and_snapshots(spark, made):
    first = shown(made.read())
    made.upsert(spark.createDataFrame([(1, "b1"), (99, "new"), (None, "other")], SCHEMA))
    made.append(spark.createDataFrame([(100, "more")], SCHEMA))
    made.delete(keys=[2, 3, 12345])
    made.delete(where=F.col("v") == "a4")
    assert made.delete(keys=[777]) == 5 and made.history() == [(1, "create"), (2, "upsert"), (3, "append"), (4, "delete"), (5, "delete")]
    want = {i: f"a{i}" for i in range(40) if i not in (2, 3, 4)} | {1: "b1", 99: "new", 100: "more", None: "other"}
    opened = VersionedTable(spark, made.path)
    assert shown(opened.read()) == sorted((str(k), v) for k, v in want.items()) and shown(opened.read(1)) == first and opened.card() == "forty"
    assert shown(opened.lookup([1, 99, 5555])) == [("1", "b1"), ("99", "new")] and shown(opened.lookup([None])) == [("None", "other")]
    files = opened.lookup([1]).inputFiles()
    assert {re.search(r"_part=(\d+)", f)[1] for f in files} == {re.search(r"_part=(\d+)", files[0])[1]} and len(files) < len(opened.read().inputFiles())
    with pytest.raises(ValueError, match="repeat"):
        opened.append(spark.createDataFrame([(1, "again")], SCHEMA))
    with pytest.raises(ValueError, match="repeat"):
        opened.upsert(spark.createDataFrame([(7, "x"), (7, "y")], SCHEMA))
    with pytest.raises(FileExistsError):
        VersionedTable.create(spark, made.path, spark.range(1))
    before = shown(opened.read())
    assert opened.compact(1) == 6 and shown(opened.read()) == before
    assert opened.vacuum() > 0 and shown(opened.read()) == before and opened.log.versions() == [6] and opened.vacuum() == 0


@pytest.mark.parametrize("step", ["data", "manifest", "rename"])
@pytest.mark.parametrize("change", ["append", "upsert", "delete", "replace"])
def test_a_failure_at_any_step_leaves_the_last_version(spark, made, monkeypatch, step, change):
    before = shown(made.read())

    def fail(*_, **__):
        raise OSError("the machine is gone")

    broken = VersionedTable(spark, made.path)
    owner, name = {"data": (broken, "_written"), "manifest": (broken.log.files, "write"), "rename": (broken.log.files, "move")}[step]
    monkeypatch.setattr(owner, name, fail)
    rows = spark.createDataFrame([(500, "x")], SCHEMA)
    with pytest.raises(OSError):
        {"append": lambda: broken.append(rows), "upsert": lambda: broken.upsert(rows), "delete": lambda: broken.delete(keys=[1]), "replace": lambda: broken.replace(rows)}[change]()
    after = VersionedTable(spark, made.path)
    assert shown(after.read()) == before and after.version() == 1
    after.upsert(rows)
    assert shown(after.read()) == sorted([*before, ("500", "x")])


def test_of_two_writers_the_second_is_told(spark, made, monkeypatch):
    one, other = VersionedTable(spark, made.path), VersionedTable(spark, made.path)
    rows = lambda k: spark.createDataFrame([(k, "w")], SCHEMA)
    write = other.log.commit

    def late(manifest, after):  # the first writer commits just before
        monkeypatch.setattr(other.log, "commit", write)
        one.upsert(rows(1))
        return write(manifest, after)

    monkeypatch.setattr(other.log, "commit", late)
    with pytest.raises(Conflict):
        other.upsert(rows(2))
    assert dict(shown(made.read()))["2"] == "a2" and dict(shown(made.read()))["1"] == "w"
    with pytest.raises(Conflict):
        other.upsert(rows(2), expected=1)
    monkeypatch.setattr(other.log, "commit", late)
    assert other.append(rows(200)) == 4 and dict(shown(made.read()))["200"] == "w"  # tried again on the newer version


def test_tables_without_a_key_and_clashing_names(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, "x"), (1, 3, "y")], "_part long, _metadata long, `a b` string")
    t = VersionedTable.create(spark, f"{tmp_path}/k", rows, "_metadata")
    t.delete(where=F.col("_metadata") == 3)
    assert [tuple(r) for r in t.read().collect()] == [(1, 2, "x")]
    t = VersionedTable.create(spark, f"{tmp_path}/n", rows)
    t.append(rows)
    t.replace(t.read().limit(1).select("_part"))
    assert t.read().columns == ["_part"] and t.read().count() == 1 and t.read(2).count() == 4
    t.replace(spark.createDataFrame([], "x int"))
    assert t.read().count() == 0 and t.read().columns == ["x"]
    with pytest.raises(ValueError, match="no key"):
        t.lookup([1])


def test_hub_and_results(spark, tmp_path):
    hub = sinks.Hub(spark, str(tmp_path / "hub"))
    with pytest.raises(ValueError):
        hub.update("d", spark.createDataFrame([(1, "x")], SCHEMA))
    hub.add("d", spark.createDataFrame([(1, "x")], SCHEMA), card="about d")
    assert hub.update("d", spark.createDataFrame([(1, "y"), (2, "z")], SCHEMA), expected=1) == 2 and hub.card("d") == "about d"
    assert shown(hub.records("d", 1)) == [("1", "x")] and shown(hub.records("d")) == [("1", "y"), ("2", "z")] and hub.names() == ["d"]
    hub.drop("d")
    assert hub.names() == [] and not hub.exists("d")
    rows = lambda *r: spark.createDataFrame(list(r), "id long, score double")
    path = str(tmp_path / "results")
    assert [sinks.save_results(rows((1, 0.5), (2, float("nan"))), path, "id"), sinks.save_results(rows((2, 0.7), (3, float("inf"))), path, "id")] == [1, 2]
    assert sorted((r.id, r.score) for r in VersionedTable(spark, path).read().na.fill(-1).collect()) == [(1, 0.5), (2, 0.7), (3, -1.0)]


# BM25


def plain_bm25(docs, query, k):
    terms = [(i, (t or "").split(" ")) for i, t in docs]
    n, mean = len(terms), sum(len(w) for _, w in terms) / len(terms)
    df = Counter(t for _, w in terms for t in set(w))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    least = 0.25 * sum(idf.values()) / len(idf)
    out = []
    for i, w in terms:
        tf, score, hit = Counter(w), 0.0, False
        for t in query.split(" "):
            if tf[t]:
                hit = True
                score += (least if idf[t] < 0 else idf[t]) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(w) / mean))
        if hit:
            out.append((-round(score, 7), math.inf if i is None else i))
    return [(None if i == math.inf else i, -s) for s, i in sorted(out)[:k]]


def test_keyword_index_equals_plain_scores(spark, tmp_path):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(200)]
    common = ["the", "of", ""]
    docs = [(i, " ".join(rng.choice(common) if rng.random() < 0.4 else words[min(199, int(rng.exponential(30)))] for _ in range(rng.integers(1, 40)))) for i in range(260)]
    docs += [(900, None), (901, ""), (None, "w1 w2 w3"), (902, "w1 w2 w3"), (902, "w1 w2 w3")]
    path = f"{tmp_path}/index"
    for part in (docs[:100], docs[100:110], docs[110:]):
        KeywordIndex(spark, path, block=16).add(spark.createDataFrame(part, "doc_id long, text string"))
    index = KeywordIndex(spark, path)  # as a reader opens it
    queries = {1: "w1 w2 the", 2: "w150", 3: docs[7][1], 4: "the of", 5: "nowhere", 6: "w3 w3 w3 w9", 7: ""}
    asked = spark.createDataFrame([*queries.items(), (8, None)], "query_id long, query string")
    found = index.search_many(asked, 7)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.id, round(r.score, 7)))
    assert got == {q: want for q, text in queries.items() if (want := plain_bm25(docs, text, 7))}
    assert [(r.id, round(r.score, 7)) for r in index.search("w1 w2 the", 7).orderBy("rank").collect()] == got[1]


def test_keyword_index_reads_its_files_and_skips_blocks(spark, tmp_path):
    docs = spark.createDataFrame([(i, "rare " * (20 if i < 5 else 0) + f"common t{i}") for i in range(400)], "doc_id long, text string")
    index = KeywordIndex(spark, f"{tmp_path}/i", block=8)
    index.add(docs)
    weights = index._weights(spark.createDataFrame([(0, "t3 t9")], "query_id long, query string"))
    floors = spark.createDataFrame([(0, 0.0001)], "query_id long, floor double")
    blocks = index._open(index.store.tables("maxima")[0], weights, floors).select("block").distinct().count()
    assert blocks <= 2 < 50 == index.store.segments("postings")[0]["blocks"]
    high = spark.createDataFrame([(0, 1e6)], "query_id long, floor double")
    assert index._open(index.store.tables("maxima")[0], weights, high).count() == 0
    plan = index.search("t3 rare", 3)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in re.findall(r"ReadSchema: struct<([^>]*)>", plan.replace("context", ""))
    assert index.search("t3 rare", 3).first().id == 3


def test_a_failed_batch_isnt_indexed(spark, tmp_path, monkeypatch):
    docs = lambda i: spark.createDataFrame([(i, f"word w{i}")], "doc_id long, text string")
    KeywordIndex(spark, f"{tmp_path}/i").add(docs(1))
    broken = KeywordIndex(spark, f"{tmp_path}/i")
    monkeypatch.setattr(broken.store, "commit", lambda **_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        broken.add(docs(2))
    index = KeywordIndex(spark, f"{tmp_path}/i")
    assert index.documents == 1 and index.search("w2", 5).count() == 0
    assert KeywordIndex(spark, f"{tmp_path}/none").search("w2", 5).count() == 0
    one, other = KeywordIndex(spark, f"{tmp_path}/i"), KeywordIndex(spark, f"{tmp_path}/i")
    one.add(docs(3))
    with pytest.raises(Conflict):
        other.add(docs(4))


# Vectors


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(40, size=1600)] + 0.4 * rng.normal(size=(1600, 16))
    return x, spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, vector array<double>").cache()


def true_neighbours(x, asked, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return {(int(q), int(i)) for q in asked for i in np.argsort(-(unit[q] @ unit.T), kind="stable")[:k]}


def test_vector_lists_prune_files_and_find_neighbours(spark, vectors, tmp_path):
    x, df = vectors
    index = VectorLists(spark, f"{tmp_path}/lists")
    index.add(df.where("id < 900"))
    assert len(index.centres) == 30 and not index.outgrown
    index.add(df.where("id >= 900"))
    probes = index.probes_for(0.95, 10)
    index = VectorLists(spark, f"{tmp_path}/lists")
    assert index.state["probes"] == probes < 15 and index.state["rows"] == 1600
    asked = df.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    got = {(r.query_id, r.id) for r in index.search_many(asked, 10).collect()}
    want = true_neighbours(x, range(0, 1600, 50), 10)
    assert len(got & want) / len(want) >= 0.9 and {(r.query_id, r.id) for r in index.search_many(asked, 10, 30).collect()} == want
    lists = index.nearest_lists(x[:1] / np.linalg.norm(x[0]), 2)[0]
    files = index.rows(lists).inputFiles()
    assert {int(re.search(r"list=(\d+)", f)[1]) for f in files} <= {int(j) for j in lists} and 0 < len(files) < len(index.rows().inputFiles()) / 5
    one = index.search(x[50].tolist(), 3)
    assert one.orderBy("rank").first().id == 50
    index.refit()
    assert len(index.centres) == 40 and {(r.query_id, r.id) for r in index.search_many(asked, 10, 40).collect()} == want


def test_vector_lists_in_blocks_and_odd_rows(spark, vectors, tmp_path, monkeypatch):
    from millrace.operators import vector_index

    x, df = vectors
    monkeypatch.setattr(vector_index, "ROWS", 20)
    monkeypatch.setattr(vector_index, "QUERIES", 3)
    index = VectorLists(spark, f"{tmp_path}/lists")
    assert index.search(x[0].tolist(), 3).count() == 0
    odd = spark.createDataFrame([(5000, None), (5001, [0.0] * 16), (None, [1.0] * 16)], "id long, vector array<double>")
    index.add(df.union(odd), lists=4)
    asked = df.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    assert {(r.query_id, r.id) for r in index.search_many(asked, 10, 4).collect()} == true_neighbours(x, range(0, 1600, 50), 10)
    assert None in {r.id for r in index.search([1.0] * 16, 2, 4).collect()}
    with pytest.raises(Exception, match="16 components"):
        index.add(spark.createDataFrame([(1, [1.0])], "id long, vector array<double>"))
    assert index.state["rows"] == 1602


def test_neighbour_graph(spark, vectors, tmp_path):
    x, df = vectors
    changed = NeighbourGraph(spark, f"{tmp_path}/graph").build(df, degree=12, rounds=6)
    assert changed[-1] < changed[0]
    graph = NeighbourGraph(spark, f"{tmp_path}/graph")
    edges = {(r.id, v) for r in graph.store.tables("edges")[0].collect() for v in r.near}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = unit @ unit.T
    np.fill_diagonal(scores, -2)
    true = {(i, int(j)) for i, row in enumerate(np.argsort(-scores, axis=1)[:, :12]) for j in row}
    assert len(edges & true) / len(true) >= 0.9
    asked = df.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    got = {(r.query_id, r.id) for r in graph.search_many(asked, 10).collect()}
    want = true_neighbours(x, range(0, 1600, 50), 10)
    assert len(got & want) / len(want) >= 0.9
    with pytest.raises(FileExistsError):
        graph.build(df)
    none = NeighbourGraph(spark, f"{tmp_path}/none")
    assert none.build(df.where("id < 0")) == [] and none.search_many(asked, 3).count() == 0


def test_manifests_are_written_once(spark, tmp_path):
    log = versions.Log(spark, f"{tmp_path}/log")
    assert log.read() == {"version": 0} and log.commit({"a": 1}, 0) == 1
    with pytest.raises(Conflict):
        log.commit({"a": 2}, 0)
    assert log.read()["a"] == 1 and log.versions() == [1] and log.files.names(f"{tmp_path}/log") == [f"{1:020d}.json"]
    with pytest.raises(ValueError, match="no version 9"):
        log.read(9)
