"""Metrics over recorded results: statistics by name, accuracies, RMSE, AUROC, ROUGE-L. Empty input gives null, not an error."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of scores that are ranked apart.
RANGES = 256
STATISTICS = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}


def statistic(name: str, value: Column) -> Column:
    """One statistic by name; the standard deviation is the population's. Unknown names raise."""
    if name not in STATISTICS:
        raise ValueError(f"unknown statistic {name!r}; known: {sorted(STATISTICS)}")
    return STATISTICS[name](value)


def metric_statistics(results: DataFrame, default: Sequence[str] = ("mean", "std"), by_name: dict[str, Sequence[str]] | None = None, metrics: str = "metrics") -> DataFrame:
    """``name`` (metric:statistic), ``value`` for each metric of a map column."""
    by_name = by_name or {}
    each = results.select(F.explode(metrics).alias("metric", "v"))
    every = sorted({*default, *(s for own in by_name.values() for s in own)})
    wide = each.groupBy("metric").agg(*[statistic(s, F.col("v")).alias(s) for s in every])
    long = wide.select("metric", F.explode(F.create_map(*[x for s in every for x in (F.lit(s), F.col(s))])).alias("stat", "value"))
    asked = F.col("stat").isin(list(default))
    for name, own in by_name.items():
        asked = F.when(F.col("metric") == name, F.col("stat").isin(list(own))).otherwise(asked)
    return long.where(asked).select(F.concat_ws(":", "metric", "stat").alias("name"), "value")


def share(condition: Column) -> Column:
    """The share of rows for which a condition holds; null without rows."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def accuracy(results: DataFrame, correct: Column, keys: Sequence[str] = ()) -> DataFrame:
    """``total``, ``correct``, ``accuracy`` by the keys."""
    return results.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.sum(F.coalesce(correct, F.lit(False)).cast("long")).alias("correct"), share(correct).alias("accuracy"))


def accuracy_and_hallucination(results: DataFrame, correct: Column, hallucinated: Column) -> DataFrame:
    return results.agg(share(correct).alias("accuracy"), share(hallucinated).alias("hallucination"))


def rmse(results: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Root mean squared error of the rows whose prediction is a number; null if none is."""
    ok = F.col(prediction).isNotNull() & ~F.isnan(F.col(prediction).cast("double"))
    return results.where(ok).agg(F.sqrt(F.avg(F.pow(F.col(prediction).cast("double") - F.col(truth).cast("double"), 2))).alias("rmse"))


def auroc(results: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the ROC curve by ranks, ties sharing theirs; 0.5 if no score is a number, null if there is one class only.

    Scores are counted first, so what is ranked is a row for each distinct score, and running sums over ranges of scores are
    kept apart from those within a range. Ranges are cut at approximate quantiles, so there are RANGES of them at most, whatever the scores.
    """
    ok = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))
    counts = results.where(ok).groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.when(F.col(truth).cast("int") == 1, 1).otherwise(0)).alias("p"), F.count(F.lit(1)).alias("n"))
    cuts = results.where(ok).agg(F.percentile_approx(F.col(score).cast("double"), [i / RANGES for i in range(1, RANGES)], 10 * RANGES)).first()[0]
    ranged = counts.withColumn("r", F.size(F.filter(F.lit(sorted(set(cuts or [0.0]))), lambda c: c < F.col("s"))))
    totals = ranged.groupBy("r").agg(F.sum("n").alias("rn"))
    below = totals.withColumn("before", F.coalesce(F.sum("rn").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("r", "before")
    within = F.coalesce(F.sum("n").over(Window.partitionBy("r").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = ranged.withColumn("within", within).join(below, "r").select("p", "n", (F.col("before") + F.col("within") + (F.col("n") + 1) / 2.0).alias("rank"))
    sums = ranks.agg(F.sum(F.col("p") * F.col("rank")).alias("sum"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    area = (F.col("sum") - F.col("p") * (F.col("p") + 1) / 2.0) / F.nullif(F.col("p") * (F.col("n") - F.col("p")), F.lit(0))
    return sums.select(F.when(F.col("n").isNull(), F.lit(0.5)).otherwise(area).alias("auroc"))


def ragas_metrics(results: DataFrame, relevance: str, faithfulness: str, true_relevance: str = "relevance_score", adherence: str = "adherence_score") -> DataFrame:
    """RMSE of the relevance, and AUROC of 1 - faithfulness against the lack of adherence."""
    turned = results.withColumns({"_t": (~F.col(adherence).cast("boolean")).cast("int"), "_s": 1 - F.col(faithfulness)})
    return rmse(results, true_relevance, relevance).crossJoin(auroc(turned, "_t", "_s"))


def performance(results: DataFrame, failed: Column, seconds: str) -> DataFrame:
    """``error_rate`` in per cent and ``avg_time``."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    return results.agg((100.0 * F.coalesce(F.sum(failed.cast("int")), F.lit(0)) / n).alias("error_rate"), F.avg(seconds).alias("avg_time"))


def total_reward(rewards: Column) -> Column:
    return F.aggregate(F.map_values(rewards), F.lit(0.0), lambda s, x: s + x)


def mean_score(scores: Column) -> Column:
    """The mean of a map's values; null if it is empty."""
    return F.aggregate(F.map_values(scores), F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(scores), F.lit(0))


def best_candidate(candidates: DataFrame, key: str, passes: str, score: str, order: str) -> DataFrame:
    """Per key the candidate that passes with the highest score, else the one with the highest; the earlier of equals."""
    at = Window.partitionBy(key).orderBy(F.col(passes).desc(), F.col(score).desc(), order)
    return candidates.withColumn("_n", F.row_number().over(at)).where("_n = 1").drop("_n")


def rouge_l(reference: Column, hypothesis: Column) -> Column:
    """ROUGE-L F1 over words: twice the longest common subsequence over both lengths (0 if either is empty)."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_rouge((x or "").split(), (y or "").split()) for x, y in zip(a, b, strict=True)], dtype="float64")

    return of(reference, hypothesis)


def best_rouge(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block: int = 256, most_bytes: int = 8 << 20) -> DataFrame:
    """Each text's best ROUGE-L F1 over all items: ``id_col``, ``item_col``, ``rouge``; ties go to the smaller item.

    Items are counted by bytes first and sent to every task ``most_bytes`` at a time, so more of them mean more scans and not more memory.
    The subsequences of a block of items are computed at once: their words lie side by side in one number, with a free bit after each item for its carry.
    """
    items = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = max(1, -(-(items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) // most_bytes))
    if parts == 1:
        return _best_of_items(docs.select(F.col(id_col).cast("long"), text_col), items, id_col, text_col, item_col, block).drop("_row")
    from millrace.operators.dedup import _cut

    rows = _cut(docs.select(F.col(id_col).cast("long"), text_col))
    found = [_best_of_items(rows, items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == i), id_col, text_col, item_col, block) for i in range(parts)]
    both = found[0]
    for more in found[1:]:
        both = both.union(more)
    better = F.max(F.struct("rouge", (-F.col(item_col)).alias("item")))
    return both.groupBy("_row", id_col).agg(better.alias("b")).select(id_col, (-F.col("b.item")).alias(item_col), F.col("b.rouge").alias("rouge"))


def _best_of_items(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, block: int) -> DataFrame:
    """The same with items that are few enough to be held, and ``_row``, which tells the rows apart."""
    import pyarrow as pa

    known = sorted((r.item, r.text.split()) for r in items.collect())
    known = docs.sparkSession.sparkContext.broadcast(known)

    def scan(batches):
        ids = np.array([i for i, _ in known.value], np.int64)
        sizes = np.array([len(w) for _, w in known.value], np.int64)
        blocks = [_side_by_side([w for _, w in known.value[k : k + block]]) for k in range(0, len(ids), block)]
        for batch in batches:
            items_, scores = [], []
            for text in batch.column(1).to_pylist():
                words = (text or "").split()
                common = np.concatenate([_common(words, *b) for b in blocks]) if blocks else np.zeros(0, np.int64)
                score = np.where(common > 0, 2.0 * common / np.maximum(sizes + len(words), 1), 0.0)
                best = int(score.argmax()) if len(score) else None
                items_.append(None if best is None else int(ids[best]))
                scores.append(0.0 if best is None else float(score[best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(items_, pa.int64()), pa.array(scores, pa.float64())], names=[id_col, "_row", item_col, "rouge"])

    return docs.select(id_col, text_col, F.monotonically_increasing_id().alias("_row")).mapInArrow(scan, f"`{id_col}` long, _row long, `{item_col}` long, rouge double")


def _side_by_side(texts: list[list[str]]) -> tuple[dict[str, int], int, np.ndarray, np.ndarray]:
    """Where each word stands in all texts, all places, and where each text begins and its length."""
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    at: dict[str, int] = {}
    full = 0
    for s, t in zip(starts.tolist(), texts, strict=True):
        full |= ((1 << len(t)) - 1) << s
        for i, w in enumerate(t):
            at[w] = at.get(w, 0) | 1 << s + i
    return at, full, starts, lengths


def _common(words: list[str], at: dict[str, int], full: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences with each of the texts."""
    rows = full
    for w in words:
        if places := at.get(w):
            hit = rows & places
            rows = (rows + hit | rows - hit) & full
    bits = np.unpackbits(np.frombuffer(rows.to_bytes(int(starts[-1] + lengths[-1]) // 8 + 1, "little"), np.uint8), bitorder="little")
    return lengths - np.add.reduceat(bits.astype(np.int64), starts)


def _rouge(a: list[str], b: list[str]) -> float:
    if not a or not b:
        return 0.0
    # Bit-parallel longest common subsequence: a set bit of `rows` marks a word of `a` that doesn't raise the length.
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = full
    for w in b:
        hit = rows & at.get(w, 0)
        rows = (rows + hit | rows - hit) & full
    common = len(a) - rows.bit_count()
    return 2.0 * common / (len(a) + len(b))


def rouge_filter(candidates: DataFrame, existing: Sequence[str], threshold: float = 0.7, text: str = "text") -> DataFrame:
    """Candidates whose ROUGE-L with no existing text (a list the caller holds) is above the threshold."""
    from pyspark.sql.functions import pandas_udf

    known = [x.split() for x in existing]

    @pandas_udf("double")
    def most(a: pd.Series) -> pd.Series:
        return pd.Series([max((_rouge(k, (x or "").split()) for k in known), default=0.0) for x in a], dtype="float64")

    return candidates.withColumn("rouge", most(F.col(text))).where(F.col("rouge") <= threshold)
