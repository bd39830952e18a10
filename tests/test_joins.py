"""Similarity joins with pruning, and graph samples and files."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import dedup, evaluation, graph, rouge_join
from millrace.plans import generate


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    words = ["the", "of", "a", *[f"w{i}" for i in range(120)]]
    bases = [[rng.choice(words) for _ in range(rng.randint(1, 30))] for _ in range(40)]

    def edit(base):
        own = list(base)
        for _ in range(rng.randint(0, max(1, len(own) // 3))):
            at = rng.randrange(len(own) + 1)
            kind = rng.random()
            if kind < 0.4 and own:
                own.pop(min(at, len(own) - 1))
            elif kind < 0.7:
                own.insert(at, rng.choice(words))
            else:
                rng.shuffle(own) if rng.random() < 0.2 else own.append(rng.choice(words))
        return own

    left = [" ".join(edit(rng.choice(bases))) for _ in range(150)] + ["the the the of", "of the the the", "", None, "  ", "single"]
    right = ["  ".join(edit(rng.choice(bases))) for _ in range(120)] + ["the the of the", "single", None]
    return left, right


@pytest.mark.parametrize("threshold", [0.3, 0.7, 0.95])
def test_rouge_pairs_equal_brute_force(spark, texts, threshold):
    left, right = texts
    a, b = ({tuple((t or "").split()) for t in own} - {()} for own in texts)
    want = {(x, y): f for x in a for y in b if (f := evaluation._rouge(list(x), list(y))) > threshold}
    assert len(want) > 10
    dfs = spark.createDataFrame([(t,) for t in left], "text string"), spark.createDataFrame([(t,) for t in right], "other string")
    got = {(tuple(r.text), tuple(r.other)): r.rouge for r in rouge_join.similar_pairs(*dfs, threshold, "text", "other").collect()}
    assert got == pytest.approx(want)
    assert rouge_join.similar_pairs(dfs[0].limit(0), dfs[1], threshold, "text", "other").count() == 0


def test_unlike_equals_the_filter_over_a_list(spark, texts):
    left, right = texts
    df = spark.createDataFrame(list(enumerate(left)), "id int, text string")
    want = {r.id for r in evaluation.rouge_filter(df, [t for t in right if t], 0.7).collect()}
    assert {r.id for r in rouge_join.unlike(df, spark.createDataFrame([(t,) for t in right], "text string")).collect()} == want and 0 < len(want) < len(left)


def test_self_instruct_collects_nothing(spark, monkeypatch):
    seeds = spark.createDataFrame([("Write a poem about the sea and the wind.",), ("List five animals of the forest by size.",)], "instruction string")
    model = lambda prompts: [f"Describe item number {i} of the {p[-3:]} list in plain words." if i % 2 else "Write a poem about the sea and the wind." for i, p in enumerate(prompts)]
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(DataFrame, "collect", lambda self: pytest.fail("collected"))
    made = generate.self_instruct(seeds, model, 2, candidates=4)
    monkeypatch.undo()
    assert {r.instruction for r in made.collect()} and "Write a poem about the sea and the wind." not in {r.instruction for r in made.collect()}


# Cosine


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 32))
    x = centres[rng.integers(30, size=900)] + 0.12 * rng.normal(size=(900, 32))
    x[17] = 0
    x[800:820] = x[3]
    return x[rng.permutation(900)]


def frame(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "idx long, embedding array<double>")


@pytest.mark.parametrize("block", [None, 16, 100])
@pytest.mark.parametrize("threshold", [0.9, 0.2])
def test_cosine_joins_equal_brute_force(spark, clustered, block, threshold):
    x = clustered
    length = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
    cos = np.round(unit @ unit.T, 10)
    df = frame(spark, x)
    links = {(r.a, r.b): round(r.similarity, 10) for r in dedup.similarity_links(df, threshold, block=block).collect()}
    want = {(i, j) for i in range(len(x)) for j in range(i) if cos[i, j] >= threshold}
    assert set(links) == want and all(abs(links[p] - cos[p]) < 1e-9 for p in want)
    best = {r.idx: r.target for r in dedup.best_earlier(df, threshold, block=block).collect()}
    expected = {}
    for i in range(1, len(x)):
        if cos[i, :i].max() > threshold:
            expected[i] = int(cos[i, :i].argmax())
    assert best == expected


def test_pairs_of_far_blocks_are_skipped(spark, clustered):
    df = frame(spark, clustered)
    blocks = dedup._blocks(df, "idx", "embedding", 30)
    n = blocks.count()
    left = dedup.block_pairs(blocks, 0.9).count()
    print("pairs left", left, "of", n * (n + 1) // 2)
    assert left < 0.5 * n * (n + 1) / 2 and dedup.block_pairs(blocks, 0.0).count() == n * (n + 1) // 2


# Graphs


def test_node_link_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(i, f"n{i}" if i % 3 else None, {"k": i}) for i in range(50)], "id long, name string, more map<string,int>")
    edges = spark.createDataFrame([(i, (i * 7) % 50, "knows", i / 4) for i in range(200)], "src long, dst long, type string, weight double")
    graph.write_node_link(nodes.repartition(4), edges.repartition(5), str(tmp_path / "g"))
    got = graph.read_node_link(spark, str(tmp_path / "g"))
    for one, other in zip(got, (nodes, edges), strict=True):
        assert one.dtypes == other.dtypes and sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
    assert len(list((tmp_path / "g/links").glob("part-*"))) == 5


def test_quotas(spark):
    nodes = spark.createDataFrame([(i, "a" if i < 50 else "b" if i < 80 else None if i < 83 else "c") for i in range(100)], "id int, kind string")
    for wanted in (0, 1, 7, 33, 100):
        got = {r.label: r.quota for r in graph.label_quotas(nodes, "kind", wanted).collect()}
        share = Counter("a" if i < 50 else "b" if i < 80 else None if i < 83 else "c" for i in range(100))
        assert sum(got.values()) == wanted and all(abs(got[k] - wanted * n / 100) < 1 for k, n in share.items())


@pytest.mark.parametrize("hub", [10_000, 10])
def test_walks_keep_label_shares_and_prefer_weights(spark, hub):
    rng = random.Random(3)
    nodes = spark.createDataFrame([(i, "abc"[min(2, i // 100)]) for i in range(250)], "id long, kind string")
    pairs = [(0, i, 1.0) for i in range(1, 250)] + [(rng.randrange(250), rng.randrange(250), 1.0) for _ in range(500)]
    edges = spark.createDataFrame(pairs, "src long, dst long, w double")
    got = [graph.walk_sample(nodes, edges, [0], 0.2, seed=s, label="kind", weight="w", hub=hub).collect() for s in (1, 1)]
    assert sorted(map(str, got[0])) == sorted(map(str, got[1]))
    assert Counter(r.label for r in got[0]) == {"a": 20, "b": 20, "c": 10} and len({r.id for r in got[0]}) == 50
    heavy = spark.createDataFrame([(0, i, 50.0 if i <= 10 else 0.5) for i in range(1, 101)], "src long, dst long, w double")
    some = {r.id for r in graph.walk_sample(nodes, heavy, [0], 10 / 250, seed=2, weight="w", hub=hub).collect()}
    assert len(some & set(range(1, 11))) >= 6
    few = graph.walk_sample(nodes, spark.createDataFrame([(0, 1, 1.0), (1, 150, 1.0)], "src long, dst long, w double"), [0], 0.5, label="kind", weight="w")
    assert {r.id for r in few.collect()} == {0, 1, 150}  # all that can be reached
