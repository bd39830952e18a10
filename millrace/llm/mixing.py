"""Mixing sources to target weights by entropy balancing, with built-in functions only.

The rates r of the documents minimise sum(r log r - r + 1), so they stay as near to 1 as they can, under one token
constraint for each source, sum(size * r) = target, and r <= cap. The convex dual gives exponentially tilted rates,
r = min(cap, exp(tilt * size)) with one tilt for each source: where words must go, long documents go first, and where words
must be repeated, long ones are. The dual's gradient, sum(size * r) - target, and its Hessian, the sum of
size^2 * r over documents below the cap, are sums over all documents. Each Newton step takes them in one distributed
aggregation over cells (source, size, number of documents); a step that leaves the bracket known so far halves it
instead. Steps end when every source's gradient is below TOLERANCE of its target, after one more.

Rates (in millionths) become copies by systematic rounding: the documents of a source stand in order of size, salt and
id, and a document gets the whole numbers passed by the running sum of rates plus a half. Neighbours in that order
are alike in size, so the words taken miss the target by about the longest document at most; single copies
more or less, a few for each source, make up for most of that. Running sums
come from counts by (source, size, salt) plus a place among the few rows of that cell, so that a source or a
group of copies with a third of all rows is never sorted as one; salts grow with the number of rows.

Defined cases: a null text has size 0 and takes no words. The null source is a source of its own, the last
in order. Rows without an id come last among rows of their size, and rows that repeat an id are documents of
their own (which of them gets a copy more is open). A source whose target is the cap times its size takes every document cap
times. A corpus without words has targets 0. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import delete, free, joined, keyed, may_broadcast, written

#: Weights of the sources in order, repeating; how often a source's words may be repeated at most.
WEIGHTS, CAP = (1.0, 2.0, 3.0), 3
#: Relative gradient at which a source has converged; steps after which an error is raised (halving alone needs fewer).
TOLERANCE, MOST_STEPS = 1e-10, 200
#: Parts into which the rows of one source and size are dealt, at least; rows of the table for each part more.
SALTS, ROWS_A_SALT = 64, 100_000
#: Rates are whole multiples of 1 / UNIT.
UNIT = 1_000_000


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text (null: 0)."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+|[\x20\x09-\x0D]++", "x")).cast("long") - F.when(
        F.coalesce(text, F.lit("")).rlike(r"^[\x20\x09-\x0D]+\z"), 1
    ).otherwise(0)


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Adds ``target`` to a table of (``source``, ``source_size``), a row per source.

    Shares by weight, filled up to ``cap`` times the source's size; what is above is shared again by weight among
    the rest. That has one level: a source gets min(cap * size, weight * level). Ordered by cap * size / weight, the
    sources at their cap come first, and sums over those before give the level: leaving out a source raises
    it if the source is at its cap and lowers it if not, so the highest is the one.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    each = sources.select("*", w.alias("_w")).select("*", (F.col("source_size") * float(cap)).alias("_cap"))
    up = Window.orderBy((F.col("_cap") / F.col("_w")), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rest = F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("_cap").over(up), F.lit(0.0))
    level = rest / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(up), F.lit(0.0)))
    highest = each.select("*", level.alias("_level")).select("*", F.max("_level").over(every).alias("_at"))
    return highest.select("source", "source_size", F.least(F.col("_cap"), F.col("_w") * F.col("_at")).alias("target"))


def tilts(cells: DataFrame, sources: DataFrame, cap: float = CAP) -> DataFrame:
    """Adds ``tilt`` to (``source``, ``source_size``, ``target``) by Newton's method on the dual; null where all documents are at the cap.

    ``cells``: ``source``, ``size``, ``_n`` documents.
    """
    key = lambda d: [F.coalesce(d["source"], F.lit("")).alias("_s"), d["source"].isNull().alias("_none")]
    cells = cells.where("size > 0").select(*key(cells), F.col("size").cast("double").alias("s"), F.col("_n").cast("double").alias("n"))
    least = cells.groupBy("_s", "_none").agg(F.min("s").alias("least"))
    share = F.try_divide(F.col("target"), F.col("source_size").cast("double"))
    now = sources.select(*key(sources), "source_size", "target").join(least, ["_s", "_none"], "left")
    now = now.select(
        "_s", "_none", "source_size", "target", F.lit(0.0).alias("tilt"),
        F.when(share < 1, F.log(share) / F.col("least")).otherwise(0.0).alias("low"), F.when(share < 1, 0.0).otherwise(F.log(F.lit(float(cap))) / F.col("least")).alias("high"),
        ((F.col("source_size") > 0) & (share < cap * (1 - 1e-12))).alias("open"),
    )
    now = written(now, "mix-tilts")
    few = may_broadcast(now, 128)
    by_source = lambda left, right, how: left.join(F.broadcast(right) if few else right, ["_s", "_none"], how)
    for _ in range(MOST_STEPS):
        turns = now.where("open").select("_s", "_none", "tilt")
        up = F.col("tilt") * F.col("s")
        free = up < F.log(F.lit(float(cap)))
        rate = F.when(free, F.exp(up)).otherwise(F.lit(float(cap)))
        sums = by_source(cells, turns, "inner").groupBy("_s", "_none").agg(F.sum(F.col("n") * F.col("s") * rate).alias("words"), F.sum(F.when(free, F.col("n") * F.col("s") * F.col("s") * rate)).alias("hessian"))
        gradient = F.col("words") - F.col("target")
        stepped = by_source(now, sums, "left").select(
            "*", gradient.alias("gradient"), F.when(gradient > 0, F.col("tilt")).otherwise(F.col("high")).alias("above"), F.when(gradient < 0, F.col("tilt")).otherwise(F.col("low")).alias("below"), (F.col("tilt") - F.try_divide(gradient, F.col("hessian"))).alias("newton"),
        )
        inside = F.coalesce((F.col("newton") >= F.col("below")) & (F.col("newton") <= F.col("above")), F.lit(False))
        after = stepped.select(
            "_s", "_none", "source_size", "target", F.when(F.col("open"), F.when(inside, F.col("newton")).otherwise((F.col("below") + F.col("above")) / 2)).otherwise(F.col("tilt")).alias("tilt"),
            F.when(F.col("open"), F.col("below")).otherwise(F.col("low")).alias("low"), F.when(F.col("open"), F.col("above")).otherwise(F.col("high")).alias("high"),
            (F.col("open") & (F.abs("gradient") > TOLERANCE * F.col("target")) & (F.col("above") > F.col("below"))).alias("open"),
        )
        before, now = now, written(after, "mix-tilts")
        delete(now.sparkSession, before)
        if now.where("open").isEmpty():
            break
    else:
        raise ArithmeticError("the dual of the mix has not converged")
    full = F.col("target") >= cap * (1 - 1e-12) * F.col("source_size")
    return now.select(F.when(~F.col("_none"), F.col("_s")).alias("source"), "source_size", "target", F.when(~full, F.col("tilt")).alias("tilt"))


def rate_units(size: Column, tilt: Column, cap: float = CAP) -> Column:
    """The rate of a document in whole units of 1 / UNIT."""
    up = tilt * size.cast("double")
    rate = F.when(tilt.isNull() | (up >= F.log(F.lit(float(cap)))), F.lit(float(cap))).otherwise(F.exp(up))
    return F.when(size > 0, F.floor(rate * UNIT + 0.5)).otherwise(0).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, cap: int = CAP, more: tuple[str, ...] = ()) -> DataFrame:
    """A row per input row: ``id_col``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``; and ``more``, columns that tell rows of one id apart."""
    stirred = F.pmod(F.pmod(F.col(id_col).cast("long"), F.lit(1_000_000_007)) * 48271, F.lit(2_147_483_647))
    own = F.xxhash64(*more) if more else F.monotonically_increasing_id()
    sized = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.coalesce(stirred, own).alias("_stir"), *more)
    sized = written(sized, "mix-sizes")
    salts = max(SALTS, sized.count() // ROWS_A_SALT)
    sized = sized.withColumn("_salt", F.pmod("_stir", F.lit(salts)) + F.when(F.col("_id").isNull(), salts).otherwise(0)).drop("_stir")
    cells = written(sized.groupBy("source", "size", "_salt").agg(F.count(F.lit(1)).alias("_n")), "mix-cells")
    by_size = written(cells.groupBy("source", "size").agg(F.sum("_n").alias("_n")), "mix-by-size")
    sources = source_targets(by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size")), weights, cap)
    key = lambda d: [F.coalesce(d["source"], F.lit("")).alias("_s"), d["source"].isNull().alias("_none")]
    rated = tilts(by_size, written(sources, "mix-sources"), cap)
    rated = rated.select("source_size", "target", "tilt", *key(rated))
    by_size = joined(by_size.select("size", "_n", *key(by_size)), rated, ["_s", "_none"], "inner", 128).select("*", rate_units(F.col("size"), F.col("tilt"), cap).alias("_rate"))
    earlier = F.sum(F.col("_n") * F.col("_rate")).over(Window.partitionBy("_s", "_none").orderBy("size").rowsBetween(Window.unboundedPreceding, -1))
    by_size = by_size.select("_s", "_none", "size", "source_size", "target", "_rate", F.coalesce(earlier, F.lit(0)).alias("_below"))
    in_size = F.sum("_n").over(Window.partitionBy("_s", "_none", "size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    within = cells.select("size", "_salt", "_n", *key(cells)).select("_s", "_none", "size", "_salt", F.coalesce(in_size, F.lit(0)).alias("_within"))
    firsts = written(within.join(by_size, ["_s", "_none", "size"]), "mix-places")
    placed = sized.select("*", F.row_number().over(Window.partitionBy("source", "size", "_salt").orderBy("_id", *more)).alias("_k"))
    found = placed.select("*", *key(placed)).drop("source").join(firsts, ["_s", "_none", "size", "_salt"], "left")
    upto = F.col("_below") + F.col("_rate") * (F.col("_within") + F.col("_k"))
    copies = F.expr(f"(_at + {UNIT // 2}) div {UNIT} - (_at - _rate + {UNIT // 2}) div {UNIT}")
    rounded = found.select("*", upto.alias("_at")).select("_id", "_s", "_none", "size", "source_size", "target", copies.cast("long").alias("_copies"), *more)
    rounded = written(rounded, "mix-rounded")
    swaps = written(_settled(rounded, cap, more), "mix-settled")
    settled = joined(rounded, swaps, ["_s", "_none", "size", "_id", *more], "left", 64)
    total = F.least(F.lit(cap), F.greatest(F.lit(0), F.col("_copies") + F.coalesce(F.col("_change"), F.lit(0)))).cast("long")  # rows that repeat an id change together
    return settled.select(F.col("_id").alias(id_col), "size", "source_size", "target", total.alias("copies"), *more).withColumn("taken", F.col("copies") * F.col("size"))


def _settled(rounded: DataFrame, cap: int, more: tuple[str, ...] = ()) -> DataFrame:
    """Changes by one copy that bring each source nearer its target: ``_s``, ``_none``, ``size``, ``_id``, ``_change``.

    Documents are classed by the three leading bits of their size and the last two of their id. Of each source and class the largest that may
    change is offered; from large to small, whatever still fits in what is missing (or too much) is changed.
    Rows offered for a source are as many as there are classes: sixteen for each power of two.
    """
    shape = F.expr("struct(length(bin(size)) AS bits, shiftright(size, greatest(length(bin(size)) - 3, 0)) AS lead, pmod(_id, 4) AS part)")
    one = F.struct("size", "_id", *more)
    kind = "array<struct<size:bigint,_id:bigint" + "".join(f",{c}:bigint" for c in more) + ">>"
    able = F.col("_id").isNotNull() & (F.col("size") > 0)
    offers = rounded.groupBy("_s", "_none", shape.alias("_class")).agg(
        F.max(F.when(able & (F.col("_copies") < cap), one)).alias("_more"), F.max(F.when(able & (F.col("_copies") > 0), one)).alias("_less"),
        F.sum(F.col("_copies") * F.col("size")).alias("_taken"), F.first("target").alias("_target"),
    )
    each = offers.groupBy("_s", "_none").agg(F.sort_array(F.collect_list("_more"), asc=False).alias("_more"), F.sort_array(F.collect_list("_less"), asc=False).alias("_less"), (F.first("_target") - F.sum("_taken")).alias("_missing"))
    nothing = F.array().cast(kind)
    step = lambda a, x: F.when(x["size"] <= a["left"], F.struct((a["left"] - x["size"]).alias("left"), F.concat(a["ids"], F.array(x)).alias("ids"))).otherwise(a)
    pick = F.aggregate(F.when(F.col("_missing") > 0, F.col("_more")).otherwise(F.col("_less")).cast(kind), F.struct(F.abs("_missing").alias("left"), nothing.alias("ids")), step, lambda a: a["ids"])
    picked = each.select("_s", "_none", F.signum("_missing").cast("long").alias("_change"), F.explode(pick).alias("_p"))
    return picked.select("_s", "_none", "_p.size", "_p._id", *[f"_p.{c}" for c in more], "_change")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: each row as often as it has copies, with all its columns. Rows are told apart by their place, so ids may repeat or be null."""
    docs, row = keyed(docs)
    copies, copy = free(docs, "_copies", "_copy")
    taken = mix(docs, id_col, more=tuple(row), **options).where(F.col("copies") > 0).select(*row, F.col("copies").cast("int").alias(copies))
    each = joined(docs, written(taken, "mix-copies"), row, "inner", 32).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return each.drop(copy, copies, *row)
