"""Building the neighbour graph moves a vector to few cells, not to every node that it may be a neighbour of."""

import numpy as np

from millrace.operators.vector_index import NeighbourGraph


def shuffled(spark):
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_shuffles_of_a_build(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20, 64))[rng.integers(20, size=2500)] + rng.normal(size=(2500, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    df.write.parquet(f"{tmp_path}/in")
    before = shuffled(spark)
    rounds = NeighbourGraph(spark, f"{tmp_path}/graph").build(spark.read.parquet(f"{tmp_path}/in"))
    own = (shuffled(spark) - before) / (len(rounds) + 1) / len(x)
    print("bytes shuffled a node and round", own, len(rounds))
    assert 0 < own < 6000
