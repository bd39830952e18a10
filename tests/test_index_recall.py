"""The recall of the index queries against brute force."""

import numpy as np
import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["vec_inverted_file", "vec_quantised_file"])
def test_index_recall(spark, name):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    asked = ids % 50 == 0
    best = ids[np.argsort(-(x[asked] @ x.T), axis=1, kind="stable")[:, :20]]
    want = {(int(q), int(i)) for q, own in zip(ids[asked], best, strict=True) for i in own}
    got = {(r.query_id, r.id) for r in entry.queries()[name](spark, sf).collect()}
    recall = len(got & want) / len(want)
    print("recall", recall)
    assert len(want) == 20 * asked.sum() and recall >= 0.9
