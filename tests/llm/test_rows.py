"""Rows without an id and rows that repeat one, through the pipeline's stages."""

from collections import Counter

import corpus_pipeline
from millrace.llm import exact, mixing
from tests.llm.test_operators import docs_of


def test_null_and_repeated_ids_through_all_stages(spark, tmp_path):
    good = lambda i: " ".join(f"{w}{(i * 7 + k) % 23}" for k, w in enumerate(["river", "stone", "walks", "slowly", "the", "of"] * 10)) + "."
    junk = lambda i: " ".join(f"$$${i}#{k}" for k in range(60))
    rows = [(i, good(i) if i % 2 else junk(i), "ab"[i % 4 // 2]) for i in range(80)] + [(None, junk(500), "a"), (None, good(1), "a"), (None, good(1000) + " alone", "b")] + [(900, "repeated " + good(3) + " again and again", "b")] * 50
    spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality"](spark, docs_of(spark, rows), str(tmp_path))
    texts = [r.text for r in kept.collect()]
    assert junk(500) not in texts and len([t for t in texts if t == rows[-1][1]]) == 50
    once = stage["exact_dedup"](spark, kept, "").collect()
    assert max(Counter(r.text for r in once).values()) == 1 and any(r.doc_id is None for r in once) and {r.text for r in once} == set(texts)
    mixed = stage["mixing"](spark, docs_of(spark, [(r.doc_id, r.text, r.source) for r in once]), "").collect()
    want = {r.doc_id: r.copies for r in mixing.mix(docs_of(spark, [(r.doc_id, r.text, r.source) for r in once])).collect()}
    assert want[None] > 0 and Counter(r.doc_id for r in mixed) == Counter(want)


def test_mix_of_repeated_rows_stays_within_three_copies(spark):
    rows = [(7, f"four words are here {i % 3}", "s") for i in range(40)] + [(None, "no id but words", "s")] * 5
    assert mixing.mixed_documents(docs_of(spark, rows)).count() <= 3 * len(rows)
    assert exact.drop_exact_duplicates(docs_of(spark, rows)).count() == 4
