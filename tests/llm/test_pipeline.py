"""The pipeline's stages, each against a brute-force version of what it must do with its input."""

import re
import zlib
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_near_dedup import kept

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality"](spark, docs, SF).cache()
    assert set(good.columns) == set(columns) and 0.5 * docs.count() < good.count() < docs.count()
    once = stage["exact_dedup"](spark, good, SF).cache()
    first = {}
    for r in sorted(good.collect(), key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", r.text or ""), r.doc_id)
    assert {r.doc_id for r in once.collect()} == set(first.values())
    near = stage["near_dedup"](spark, once, SF).cache()
    assert {r.doc_id for r in near.collect()} == kept([(r.doc_id, r.text) for r in once.collect()], 1)
    mixed = stage["mixing"](spark, near, SF).cache()
    assert set(mixed.columns) == set(columns) and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in near.collect()}
    packed = stage["packing"](spark, mixed, SF).collect()
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in mixed.collect():
        ids, at = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for size in [1024] * (len(ids) // 1024) + [1 << b for b in range(9, -1, -1) if len(ids) % 1024 >> b & 1]:
            want.append((r.doc_id, at, size, zlib.crc32(ids[at : at + size].tobytes()), len(ids)))
            at += size
    assert sorted((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in packed) == sorted(want)


def test_run_gives_the_stages_rows(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
