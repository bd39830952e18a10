"""Columns named like those that the operators put beside the caller's; redaction in the row; the pipeline on nothing; an index that outlives its session."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import exact, mixing, pii, quality, simhash, substring
from tests.llm.test_operators import docs_of, empty, plain_removal

CLASH = ["_copies", "_copy", "_row_file", "_row_at", "_metadata", "_Row_File_", "_file", "_at", "_id", "_text"]


def wide(df):
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])


@pytest.fixture
def rows():
    good = lambda i: " ".join(f"{w}{(i * 7 + k) % 23}" for k, w in enumerate(["river", "stone", "walks", "slowly", "the", "of"] * 10)) + "."
    return [(i, good(i % 9), "ab"[i % 2]) for i in range(30)] + [(None, good(3), "a"), (None, None, "b"), (7, "$$$ ### 0x00 " * 20, "a")]


def test_operators_keep_rows_and_columns(spark, rows):
    labels = spark.createDataFrame([(i, int(i != 7), 0) for i in range(30)], "doc_id long, quality int, toxic int")
    df = docs_of(spark, rows)
    for keep in (exact.drop_exact_duplicates, simhash.drop_near_duplicates, lambda d: quality.keep_good(d, labels), mixing.mixed_documents, pii.redact):
        got, plain = keep(wide(df)), keep(df)
        assert got.columns == [*df.columns, *CLASH]
        assert sorted(map(str, got.select(df.columns).collect())) == sorted(map(str, plain.collect())) and plain.count() > 0
        assert all(r[c] == f"own {c}" for r in got.collect() for c in CLASH)


def test_stages_keep_rows_and_columns(spark, rows, tmp_path):
    spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    wide(docs_of(spark, rows)).write.parquet(f"{tmp_path}/wide.parquet")
    docs_of(spark, rows).write.parquet(f"{tmp_path}/plain.parquet")
    a, b = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("wide", "plain"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got, want = stage(spark, a, str(tmp_path)), stage(spark, b, str(tmp_path))
        assert got.columns == a.columns, name
        assert sorted(map(str, got.select(b.columns).collect())) == sorted(map(str, want.collect())), name


def test_pipeline_of_nothing(spark, tmp_path):
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_redact_null_and_repeated_ids(spark):
    rows = [(None, "write to a.b@c.de now"), (None, "call +1 (919) 555-4584"), (4, "x@y.zz and 1.2.3.4"), (4, "no data"), (5, None), (6, "")]
    got = pii.redact(docs_of(spark, rows))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    found = sorted((str(r.doc_id), str(r.text), r.n_chars) for r in got.collect())
    want = [(None, "write to [email] now"), (None, "call [phone]"), (4, "[email] and [ip]"), (4, "no data"), (5, None), (6, "")]
    assert found == sorted((str(i), str(t), len(o or "")) for (i, t), (_, o) in zip(want, rows, strict=True))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_redacted_columns_may_have_any_name(spark):
    df = spark.createDataFrame([("a.b@c.de", 1)], "`my.text` string, _text int")
    assert pii.redact(df, "my.text").first() == ("[email]", 1)


def test_substring_index_is_opened_again(spark, tmp_path):
    rng = random.Random(9)
    passage = [[f"x{rng.randint(0, 500)}" for _ in range(40)] for _ in range(6)]
    rows = [(i, " ".join(w for _ in range(3) for w in (rng.choice(passage) if rng.random() < 0.5 else [f"y{rng.randint(0, 9999)}" for _ in range(30)]))) for i in range(90)]
    path, found = f"{tmp_path}/index", []
    for k in range(3):  # each batch by an index of its own, which knows the others by the folder alone
        index = substring.SubstringIndex.open(spark, path, fan_out=2)
        assert index.highest == (30 * k - 1 if k else None)
        found.append(index.ingest(docs_of(spark, rows[30 * k : 30 * k + 30])))
        index.close()
    index = substring.SubstringIndex.open(spark, path)
    with pytest.raises(ValueError, match="above"):
        index.ingest(docs_of(spark, rows[:3]))
    index = substring.SubstringIndex.open(spark, path)
    got = {r._id: (r.n_words, r.n_removed, r.kept_text) for r in index.without(found[0].union(found[1]).union(found[2])).collect()}
    assert got == plain_removal(rows) and sum(r[1] for r in got.values()) > 0


def test_a_failed_batch_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    text = " ".join(f"w{i}" for i in range(40))
    path = f"{tmp_path}/index"
    substring.SubstringIndex.open(spark, path).ingest(docs_of(spark, [(1, text)]))
    broken = substring.SubstringIndex.open(spark, path)
    monkeypatch.setattr(broken.store, "commit", lambda **_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        broken.ingest(docs_of(spark, [(2, text)]))
    index = substring.SubstringIndex.open(spark, path)
    assert index.highest == 1
    again = index.ingest(docs_of(spark, [(2, text)]))
    assert [tuple(r) for r in again.collect()] != [] and {r._id: r.n_removed for r in index.without(again).collect()} == {1: 0, 2: 40}


def test_rows_of_one_id_with_other_texts(spark):
    """What all of them have at a place, and repeats, goes; the rest stays."""
    head, tail = " ".join(f"h{i}" for i in range(25)), " ".join(f"t{i}" for i in range(25))
    rows = [(1, f"{head} {tail}"), (2, f"{head} a b c"), (2, f"{head} d e f"), (3, f"one {tail}"), (3, f"two words {tail}")]
    got = sorted((r.doc_id, r.n_removed) for r in substring.drop_repeats(docs_of(spark, rows)).collect())
    assert got == [(1, 0), (2, 25), (2, 25), (3, 0), (3, 0)]
