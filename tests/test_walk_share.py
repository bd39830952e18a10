"""Walks go on until their share of the nodes is met."""

import __spark_entry__ as entry
from millrace.operators import graph


def test_walk_sample_meets_its_share(spark):
    sf = "/root/testdata/sf0.1"
    got = entry.queries()["walk_sample"](spark, sf)
    nodes = sum(spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("customer", "supplier", "nation", "region"))
    print("met", got.count(), "of", nodes)
    assert got.count() >= int(0.01 * nodes) > 62
    few = spark.createDataFrame([(i,) for i in range(9)], "id long"), spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long")
    assert {r.id for r in graph.walk_sample(*few, [0], 1.0).collect()} == {0, 1, 2}
