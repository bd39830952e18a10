"""The pipeline's near-duplicates against brute force over all pairs."""

import random
from collections import Counter
from itertools import combinations

import pytest

import corpus_pipeline
from millrace.llm.simhash import drop_near_duplicates
from tests.llm.test_operators import classes, docs_of, empty


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


@pytest.fixture(scope="module")
def edited():
    """Texts, each with copies in which 1 to 6 words of 150 are changed: similarities on both sides of 0.8."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(20):
        base = [rng.choice(words) for _ in range(150)]
        for c in range(6):
            own = list(base)
            for i in rng.sample(range(150), c):
                own[i] = rng.choice(words)
            rows.append((100 * k + c, " ".join(own)))
    return [*rows, (9000, "two words"), (9001, "Two  words"), (9002, None), (9003, " ")]


def kept(rows, least=51):
    sets = {i: shingles(t) for i, t in rows}
    pairs = [(a, b) for a, b in combinations(sorted(sets), 2) if similar(sets[a], sets[b])]
    assert len(pairs) >= least
    return set(classes(sorted(sets), pairs).values())


def test_stage_equals_brute_force(spark, edited):
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert {r.doc_id for r in stage(spark, docs_of(spark, edited), "").collect()} == kept(edited)
    assert stage(spark, empty(spark), "").count() == 0


def test_large_buckets_lose_nothing(spark, edited):
    for options in ({"bucket": 1, "pairs_a_row": 0, "leaders": 2}, {"bucket": 1, "pairs_a_row": 0, "leaders": 0}):
        got = drop_near_duplicates(docs_of(spark, edited), **options).collect()
        assert {r.doc_id for r in got} == kept(edited)


def test_rows_without_or_with_the_same_id(spark):
    rows = [(None, "a b c d e f"), (5, "A b c d e f"), (None, "only here"), (None, "Only here"), (7, "x y"), (7, "x  y")]
    got = drop_near_duplicates(docs_of(spark, rows)).collect()
    assert Counter(r.doc_id for r in got) == {5: 1, None: 1, 7: 1}
