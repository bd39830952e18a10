"""Plain-Python versions of operators that SQL can't express: samplers, chunkers, datasets, embeddings."""

import struct

import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.functions import embedding
from millrace.operators import curation, evaluation
from millrace.sources import readers

SF = "/root/testdata/sf0.001"


def spark_hash(seed, key):
    return xxhash.xxh64_intdigest(struct.pack("<q", key), xxhash.xxh64_intdigest(struct.pack("<i", seed), 42))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_hash_samples(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    order = lambda seed, own: sorted(own, key=lambda i: (signed(spark_hash(seed, i)), i))
    assert {r.doc_id for r in curation.hash_sample(docs, 25, "doc_id", seed=7).collect()} == set(order(7, ids)[:25])
    assert curation.hash_sample(docs, 10_000, "doc_id").count() == len(ids) and curation.hash_sample(docs.limit(0), 5, "doc_id").count() == 0
    by = {lang: [r.doc_id for r in docs.where(F.col("lang") == lang).select("doc_id").collect()] for lang in ("en", "fr")}
    got = curation.few_shot(docs.where("lang = 'en'").select("doc_id", "lang"), docs.where("lang = 'fr'").select("doc_id", "lang"), "doc_id", seed=3).collect()
    assert sorted(r.doc_id for r in got) == sorted(order(3, by["en"])[:6] + order(3, by["fr"])[:2])
    short = curation.few_shot(docs.where("lang = 'en'").select("doc_id", "lang"), docs.where("doc_id < 0").select("doc_id", "lang"), "doc_id").collect()
    assert len(short) == 8 and sum(r.doc_id is None for r in short) == 2


def test_datasets(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"question": "q1", "final_answer": "a1", "metadata": {"k": "v"}}, {"question": "q2"}, {"question": null, "final_answer": "a3"}, {"question": "", "final_answer": ""}]')
    got = readers.dataset_from_json(spark, str(tmp_path / "a.json"))
    assert [(r.question, r.final_answer, r.metadata) for r in got.collect()] == [("q1", "a1", {"k": "v"}), ("", "", None)]
    rows = [{"question": "q", "final_answer": "a", "rationale": "r", "other": 1}, {"question": "q"}]
    assert [tuple(r) for r in readers.dataset_from_list(spark, rows).collect()] == [("q", "a", "r", None)]
    assert readers.dataset_from_list(spark, []).count() == 0
    for load in (lambda: readers.dataset_from_json(spark, str(tmp_path / "a.json"), strict=True), lambda: readers.dataset_from_list(spark, rows, strict=True)):
        with pytest.raises(Exception, match="lacks"):
            load().collect()


def test_best_rouge_in_parts_equals_one_part(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.limit(3)).union(spark.createDataFrame([(None, None), (-1, "")], "doc_id long, text string"))
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    one = sorted(map(str, evaluation.best_rouge(docs, items).collect()))
    assert sorted(map(str, evaluation.best_rouge(docs, items, most_bytes=1500).collect())) == one and len(one) == docs.count()


def test_embedded_documents(spark):
    """Each piece's vector is the vector of its text alone, whatever batch it came in."""
    rows = entry.queries()["embed_documents"](spark, SF).collect()
    assert len({(r.id, r.piece_num) for r in rows}) == len(rows) and {r.id for r in rows} <= {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    both = {(r.id, r.piece_num): r.vector for r in embedding.indexed(docs).collect()}
    alone = {(r.id, r.piece_num): r.vector for r in embedding.indexed(docs.repartition(7)).collect()}
    assert both == alone and both


def test_numbered_rows(spark):
    from millrace.sources import sheets

    df = spark.createDataFrame([(i * 37 % 101, f"v{i}") for i in range(101)] + [(None, "none")], "k int, _at string").repartition(6)
    got = {r.k: r.row for r in sheets.numbered(df, "k").collect()}
    assert got == {None: 1} | {k: k + 2 for k in range(101)} and sheets.numbered(df.limit(0), "k").count() == 0
