"""A step of a walk costs a walker a few rows, however many edges its node has, and edges are drawn by their weight."""

from collections import Counter

from pyspark.sql import functions as F

from millrace.operators import graph


def test_slots_hold_two_rows_an_edge(spark):
    e = spark.range(1, 2001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"), F.when(F.col("id") == 1, 4000.0).otherwise(F.pmod("id", F.lit(3)) + 0.5).alias("pull"), F.pmod("id", F.lit(4)).cast("int").alias("part"))
    wheels, slots = graph._wheels(e)
    assert slots.count() <= 2 * 2000 and slots.select("dst").distinct().count() == 2000
    wheel = wheels.first().wheel
    assert [p.part for p in wheel] == [0, 1, 2, 3] and abs(wheel[-1].end - e.agg(F.sum("pull")).first()[0]) < 1e-6
    met = slots.groupBy("part", "slot").count().agg(F.avg("count")).first()[0]
    assert met <= 2


def test_many_walkers_at_a_hub(spark):
    nodes, edges = spark.range(20_001), spark.range(1, 20_001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"), F.when(F.col("id") <= 10_000, 3.0).otherwise(1.0).alias("w"))
    got = [r.id for r in graph.walk_sample(nodes, edges, [0], 0.1, seed=1, weight="w", hub=3000).collect()]
    side = Counter(i <= 10_000 for i in got if i)
    assert len(got) == len(set(got)) >= 2000 and 2.2 < side[True] / side[False] < 3.6
