"""A corpus pipeline: quality classifier, exact dedup, near-dedup, source mix, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns a
DataFrame, which is written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents, whatever these are.

For all stages: a null text counts as empty. Rows are told apart by their place in the files, not by
their id, so rows without an id and rows that repeat one are decided on one by one, and none multiplies
another. Whole texts count, however long. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.exact import drop_exact_duplicates
from millrace.llm.mixing import mixed_documents
from millrace.llm.quality import keep_good
from millrace.llm.queries import packed
from millrace.llm.shared import table, written
from millrace.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Equal texts have equal scores, so they stay or go together. A null or empty text is scored like any other. Without labels of
    both kinds every score is the labels' share (0.5 without any) and rows of 0.5 and more stay.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside), the document with the smallest id stays.

    Null, empty and blank texts are two groups: null and empty ones, and those of white space only. Of rows that repeat
    the smallest id one stays; a row without an id stays only if no row of its text has one.
    """
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 or more, the document with the smallest id stays.

    A-Z are lower-cased. A text under five words is one shingle, so it is like an equal one only; wordless and null texts
    are alike. Of rows that repeat the smallest id one stays; a row without an id stays only if no row of its component has one.
    """
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, three times at most; texts without words go.

    The null source is a source. Among rows alike in source and size those with smaller ids are no more likely to be taken, and which
    of several rows of one id gets a copy more follows their place in the files, so reruns agree.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of at most 1,024 tokens; copies of a document are documents of their own.

    A null or empty text has one token, the end id. Rows without an id are packed too and their pieces have none.
    """
    return packed(docs)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: The classifier and the fingerprints can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
