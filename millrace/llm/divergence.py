"""How far the sources of a language differ from each other and from the language, by exact term shares.

Terms are runs of letters and of characters beyond ASCII, A-Z lower-cased. A language keeps the terms that stand in at least
LEAST_DOCS of its documents. A group (a source of a language, or the language) gives each of the V kept terms the share
``p = 1 + floor(SCALE * (count + 2) / (N + 2 * V))``, N being the sum of its counts; two shares differ by
``floor((p - q)^2 / (p + q))``. All arithmetic is on whole numbers.

*Pairs of sources* are sums over all kept terms, most of which a source doesn't have: those have one share in a group, its baseline.
So a pair's sum is V times the difference of the baselines, corrected by the terms that one of the two has (they are
known by a histogram of each group's counts, as the other's share is its baseline) and by those that both have (a join
of the sparse counts on the term, summed before the shuffle).

*The terms that stand out* in a group are ranked by radix selection: a histogram over the leading DIGIT bits of all values tells in which bin a group's
k-th value lies, the next one looks into that bin only, until the value is known; among rows that tie with it, histograms over
the items' UTF-8 bytes find how far down the ties go. Each round is one aggregation, summed where the rows lie; no group is sorted
or gathered, but for the at most k rows that it keeps.

Defined cases: null languages, sources and texts are empty strings. A group without terms, or of a language that keeps none, has pairs of
value 0 with nothing to tell them apart but their names, and no term rows. Rows that repeat an id are documents of their own (ids aren't read). A
language with one source has no pair. Texts of any length are read in slices that end between terms. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.encoding import portions, strings
from millrace.llm.shared import delete, joined, written

LEAST_DOCS, SCALE, TOP = 10, 1_000_000_000, 10
#: Bits of a value that one histogram tells apart, and bytes of a tied item that the first one does (twice as many each round).
DIGIT, BYTES = 10, 2
#: Distinct terms that a task holds before it hands its counts on, and bytes of a text that are split at once.
HELD, SLICE = 400_000, 1 << 22
#: Terms in the UTF-8 bytes of a text whose A-Z are lower-cased.
_TERM, _OTHER = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")
_COUNTED = "lang string, source string, term string, n long, docs long"


def slices(data: bytes) -> Iterator[bytes]:
    """``data`` in pieces of about SLICE bytes that end where no term does."""
    at = 0
    while at < len(data):
        end = _OTHER.search(data, at + SLICE) if at + SLICE < len(data) else None
        yield data[at : end.start() if end else len(data)]
        at = end.start() if end else len(data)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term in each group, summed over what a task holds at once; and a row without a term for each group."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def handed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            terms = list(n)
            for i in range(0, len(terms) + 1, 50_000):
                part = terms[i : i + 50_000]
                size = len(part) + (i == 0)
                term = pa.array(part + [None] * (i == 0), pa.binary()).cast(pa.string())
                numbers = [pa.array([of[t] for t in part] + [0] * (i == 0), pa.int64()) for of in (n, docs)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), term, *numbers], names=["lang", "source", "term", "n", "docs"])
        groups.clear()

    for batch in batches:
        for rows in portions(batch, 2):
            for lang, source, text in zip(*(strings(rows.column(i)).to_pylist() for i in range(3)), strict=True):
                n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for part in slices(text.encode().lower()):
                    terms = _TERM.findall(part)
                    n.update(terms)
                    seen.update(terms)
                docs.update(seen)
            if sum(len(n) for n, _ in groups.values()) > HELD:
                yield from handed()
    yield from handed()


def _share(count: str, total: str, kinds: str) -> Column:
    """The share of a term; decimals hold what longs don't, and ``div`` rounds down."""
    return F.expr(f"1 + (cast({count} + 2 AS decimal(20,0)) * {SCALE}) div cast({total} + 2 * {kinds} AS decimal(20,0))")


def _differ(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def shares(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """The groups (``lang``, ``source``, ``v`` kept terms, ``p0`` the share of a term it doesn't have, null if v is 0), and of the kept terms
    each that a group has (``lang``, ``source``, ``term``, its share ``p``, the language's ``q``, the group's ``p0``, ``v``). Both are written."""
    counted = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text")).mapInArrow(_count, _COUNTED)
    counts = written(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms-counts")
    by_lang = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs"))
    kept = written(by_lang.where(F.col("docs") >= least_docs).select("lang", "term", "all"), "terms-kept")
    langs = written(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all").alias("total")), "terms-langs")
    kept = joined(kept, langs, "lang", "inner", 64).select("lang", "term", "v", _share("all", "total", "v").alias("q"))
    own = counts.where("term IS NOT NULL").select("lang", "source", "term", "n")
    own = written(joined(own, written(kept, "terms-lang-shares"), ["lang", "term"], "inner", 64, F.length("term") * 4), "terms-own")
    sizes = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = joined(counts.where("term IS NULL").select("lang", "source"), langs.select("lang", "v"), "lang", "left", 64).join(sizes, ["lang", "source"], "left")
    groups = groups.select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("total", F.lit(0)).alias("total"))
    groups = written(groups.select("lang", "source", "v", "total", F.when(F.col("v") > 0, _share("0", "total", "v")).alias("p0")), "terms-groups")
    sparse = joined(own.drop("v"), groups, ["lang", "source"], "inner", 128).select("lang", "source", "term", _share("n", "total", "v").alias("p"), "q", "p0", "v")
    sparse = written(sparse, "terms-shares")
    for table in (counts, own):
        delete(docs.sparkSession, table)
    return groups.select("lang", "source", "v", "p0"), sparse


def source_pairs(groups: DataFrame, sparse: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``item``, ``value`` of all ordered pairs of sources of a language."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("o0"))
    each = joined(groups, other, "lang", "inner", 128).where("source <> item")
    base = each.select("lang", "source", "item", F.coalesce(F.col("v") * _differ("p0", "o0"), F.lit(0)).alias("value"))
    # terms that one has, as if the other had none of them
    heights = written(sparse.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("m")), "terms-heights")
    one = joined(heights, other, "lang", "inner", 128).where("source <> item").select("lang", "source", "item", (F.col("m") * (_differ("p", "o0") - _differ("p0", "o0"))).alias("value"))
    one = one.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    mirrored = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    # terms that both have: what that still leaves, for one order of the two
    a, b = (sparse.select("lang", "term", F.col("source").alias(f"s{i}"), F.col("p").alias(f"p{i}"), F.col("p0").alias(f"z{i}")) for i in "ab")
    rest = _differ("pa", "pb") - _differ("pa", "zb") - _differ("za", "pb") + _differ("za", "zb")
    both = a.join(b, ["lang", "term"]).where("sa < sb").groupBy("lang", "sa", "sb").agg(F.sum(rest).alias("value"))
    both = written(both, "terms-both")
    ways = [both.select("lang", F.col(f"s{x}").alias("source"), F.col(f"s{y}").alias("item"), "value") for x, y in ("ab", "ba")]
    parts = base.union(one).union(mirrored).union(ways[0]).union(ways[1])
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _narrowed(counts: DataFrame, group: list[str], digit: Column, down: bool) -> DataFrame:
    """Of bins (group, need, digit, c), the one in which a group's ``need``-th row lies: ``digit``, what is still needed there, and how many rows it has."""
    upto = F.sum("c").over(Window.partitionBy(*group).orderBy(digit).rowsBetween(Window.unboundedPreceding, 0))
    reached = counts.select("*", upto.alias("upto")).withColumn("before", F.col("upto") - F.col("c")).where(F.col("before") < F.col("need"))
    pick = F.max_by if not down else F.min_by
    return reached.groupBy(*group).agg(pick("digit", "digit").alias("digit"), (F.first("need") - F.max("before")).alias("need"), F.max_by("c", "upto").alias("c"))


def radix_top(rows: DataFrame, group: list[str], k: int, digit: int = DIGIT) -> DataFrame:
    """Of (``group``, ``item``, ``value``: a long of 0 or more) the ``k`` rows of each group with the largest values, ties by the items' bytes; with their ``rank``.

    Items are distinct in a group. ``rows`` is read several times: write it first.
    """
    spark, left = rows.sparkSession, (rows.agg(F.max("value")).first()[0] or 0).bit_length()
    bar = written(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("c")).select(*group, F.lit(0).cast("long").alias("top"), F.lit(k).cast("long").alias("need"), "c"), "radix")
    while left > 0:
        low = max(0, left - digit)
        within = joined(rows, bar.select(*group, "top", "need"), group, "inner", 128).where(F.shiftright("value", left) == F.col("top"))
        bins = within.groupBy(*group, F.shiftright("value", low).alias("digit")).agg(F.count(F.lit(1)).alias("c"), F.first("need").alias("need"))
        after = written(_narrowed(bins, group, F.col("digit").desc(), True).select(*group, F.col("digit").alias("top"), "need", "c"), "radix")
        delete(spark, bar)
        bar, left = after, low
    # bar: a group's k-th largest value, how many of the rows with it belong to the k, and how many there are
    cut, size, done = written(bar.select(*group, "top", "need", "c", F.lit(None).cast("string").alias("cut"), F.lit(0).alias("wide")), "radix-cut"), BYTES, 0
    code = F.hex(F.encode("item", "UTF-8"))
    tied = written(joined(rows, bar.where("c > need").select(*group, "top"), group, "inner", 128).where("value = top").select(*group, code.alias("code")), "radix-tied")
    while True:
        open_ = cut.where("c > need").select(*group, "need", F.coalesce("cut", F.lit("")).alias("cut"))
        if open_.isEmpty():
            break
        within = joined(tied, open_, group, "inner", 256).where(F.substring("code", 1, 2 * done) == F.col("cut"))
        bins = within.groupBy(*group, F.substring("code", 1, 2 * (done + size)).alias("digit")).agg(F.count(F.lit(1)).alias("c"), F.first("need").alias("need"))
        found = _narrowed(bins, group, F.col("digit").asc(), False).select(*group, F.col("digit").alias("_cut"), F.col("need").alias("_need"), F.col("c").alias("_c"))
        after = cut.join(found, group, "left").select(*group, "top", F.coalesce("_need", "need").alias("need"), F.coalesce("_c", "c").alias("c"), F.coalesce("_cut", "cut").alias("cut"), F.when(F.col("_cut").isNotNull(), 2 * (done + size)).otherwise(F.col("wide")).alias("wide"))
        cut, done, size = written(after, "radix-cut"), done + size, size * 2
    chosen = joined(rows, cut.select(*group, "top", "cut", "wide"), group, "inner", 256)
    within = F.col("cut").isNull() | (F.expr("substring(code, 1, wide)") <= F.col("cut"))  # a cut may be an item that ends before its width
    chosen = chosen.withColumn("code", code).where((F.col("value") > F.col("top")) | ((F.col("value") == F.col("top")) & within)).select(*group, "item", "value")
    return _ranked(chosen, group)


def _ranked(rows: DataFrame, group: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("value"), F.asc("item")))  # strings are ordered by their UTF-8 bytes
    return rows.select("*", rank.cast("int").alias("rank"))


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: of each group the other sources of its language (part ``pair``) and the terms it has more of than its language (part ``term``, the first ``top``).

    The rank among pairs is a window over a group's rows, of which the result holds all: as many as its language has sources.
    """
    groups, sparse = shares(docs, lang_col, source_col, text_col, least_docs)
    pairs = _ranked(source_pairs(groups, sparse), ["lang", "source"])
    more = written(sparse.where("p > q").select("lang", "source", F.col("term").alias("item"), _differ("p", "q").alias("value")), "terms-more")
    terms = radix_top(more, ["lang", "source"], top)
    named = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return named(pairs, "pair").union(named(terms, "term"))
