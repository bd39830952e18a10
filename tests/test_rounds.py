"""Rounds end when nothing is left, never at a cap."""

import pytest

from millrace.operators import dedup, graph, workflow


def test_long_paths_end_whole(spark):
    n = 104
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "src long, dst long").coalesce(1)
    found = graph.shortest_path(edges, 0, n).first()
    assert found.found and found.length == n
    with pytest.raises(ValueError, match="negative"):
        graph.shortest_path(spark.createDataFrame([(0, 1, -1.0)], "src long, dst long, w double"), 0, 1, weight="w")


def test_no_round_cap_is_left():
    for f in (workflow.levels, workflow.depths, dedup.greedy_kept, graph.shortest_path, graph.walk_sample):
        assert "most_rounds" not in f.__code__.co_varnames
