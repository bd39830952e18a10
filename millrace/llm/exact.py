"""Exact deduplication by progressive refinement.

One pass over the texts notes of every row the length of its normalised text and a hash of its first characters. Rows are
grouped by length; those whose length others share are grouped by length and prefix hash; and only of
rows that still are not alone the full content is read, found by their places in the files, and grouped by the full hash.

Defined cases: a null text counts as empty. Rows without an id take part, but a row with an id is
kept before them; a group with no id at all has the null ``keep_id`` and all its rows are kept.
Rows that repeat an id and a text count as one document in ``kept`` (all are kept) and as several
in ``group_size``. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import joined, keyed, written

#: Characters of the normalised text that the second step hashes.
PREFIX_CHARS = 128


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty string."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, digest_all: bool = False, row: list[str] | None = None) -> DataFrame:
    """One row per input row: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, and the columns ``row``, if ``docs`` is keyed by them.

    ``text_sha256`` is null for rows that dropped out before the last step, unless ``digest_all`` asks
    for the digest of every text; the first pass then takes it too, and none reads texts again. Texts never pass
    through a shuffle when the places of the surviving rows fit a broadcast.
    """
    docs, named = (docs, row) if row else keyed(docs)
    place = ["_file", "_at"]
    kept = ["_id", *place] if row else ["_id"]
    source = docs.select(*[F.col(c).alias(p) for c, p in zip(named, place, strict=True)], F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    norm = source.select("_id", *place, normalised(F.col("_text")).alias("_norm"))
    digest = F.sha2(F.col("_norm"), 256)
    rows = written(norm.select("_id", *place, F.length("_norm").alias("_len"), F.xxhash64(F.substring("_norm", 1, prefix_chars)).alias("_pre"), *([digest.alias("_sha")] if digest_all else [])), "exact-rows")
    lengths = written(rows.groupBy("_len").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_len"), "exact-lengths")
    prefixes = joined(rows.select("_len", "_pre"), lengths, "_len", "left_semi", 16).groupBy("_len", "_pre").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    prefixes = written(prefixes.select("_len", "_pre", F.lit(True).alias("_again")), "exact-prefixes")
    tagged = joined(rows, prefixes, ["_len", "_pre"], "left", 32)
    if digest_all:
        tagged = written(tagged.select(*kept, "_sha", "_again"), "exact-tagged")
        alone, again = tagged.where("_again IS NULL").drop("_again"), tagged.where("_again").drop("_again")
    else:
        tagged = written(tagged.select("_id", *place, "_again"), "exact-tagged")
        alone = tagged.where("_again IS NULL").select(*kept, F.lit(None).cast("string").alias("_sha"))
        places = written(tagged.where("_again").select(*place), "exact-places")
        again = written(joined(norm, places, place, "inner", 32).select(*kept, digest.alias("_sha")), "exact-hash")
    groups = again.groupBy("_sha").agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    groups = written(groups.where("_size > 1"), "exact-groups")
    none = alone.select("*", F.lit(None).cast(dict(docs.dtypes)[id_col]).alias("_keep"), F.lit(None).cast("long").alias("_size"))
    found = again.join(groups, "_sha", "left").select(*none.columns).union(none)
    return found.select(
        F.col("_id").alias(id_col),
        F.when(F.col("_size").isNotNull(), F.col("_keep")).otherwise(F.col("_id")).alias("keep_id"),
        F.coalesce(F.col("_size"), F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("_size").isNotNull(), F.col("_id").eqNullSafe(F.col("_keep"))).otherwise(F.lit(True)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
        *[F.col(p).alias(c) for p, c in zip(place, row or [], strict=False)],
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: one of each group, also of rows that repeat an id and a text or have no id (these come last)."""
    docs, row = keyed(docs)
    found = exact_groups(docs, id_col, text_col, row=row).where("group_size > 1")
    found = written(found.select("text_sha256", "kept", F.col(row[0]).alias("_file"), F.col(row[1]).alias("_at")), "exact-rows")
    order = F.struct((~F.col("kept")).alias("other"), "_file", "_at")
    first = written(found.groupBy("text_sha256").agg(F.min(order).alias("first")), "exact-first")
    gone = joined(found, first, "text_sha256", "inner", 128).where(order != F.col("first")).select(F.col("_file").alias(row[0]), F.col("_at").alias(row[1]))
    return joined(docs, written(gone, "exact-gone"), row, "left_anti", 32).drop(*row)
