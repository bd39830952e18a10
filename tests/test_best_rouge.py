"""Best ROUGE-L over all items against brute force."""

import math

from millrace.operators import evaluation

SF = "/root/testdata/sf0.01"


def test_rouge_l_takes_the_best_item(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 25 = 0"), spark.read.parquet(f"{SF}/benchmark.parquet")
    known = sorted((r.item_id, r.text) for r in items.collect())
    for block in (256, 7):
        got = {r.doc_id: r for r in evaluation.best_rouge(docs.select("doc_id", "text"), items, block=block).collect()}
        assert len(got) == docs.count()
        for r in docs.collect():
            score, item = max((evaluation._rouge((t or "").split(), (r.text or "").split()), -i) for i, t in known)
            assert math.isclose(got[r.doc_id].rouge, score) and got[r.doc_id].item_id == -item
