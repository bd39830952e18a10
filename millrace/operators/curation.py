"""From raw texts to multi-hop examples: sentence triples, complexity, exact dedup, samples by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.filters import preprocessed, word_count
from millrace.functions.text import sentences
from millrace.operators.dedup import first_of_equal


def triples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10) -> DataFrame:
    """Runs of three sentences, the first two of over ``least`` characters: ``id``, ``pos``, ``premise``, ``intermediate``, ``conclusion``, ``related`` (up to two other long sentences)."""
    own = docs.select(F.col(id_col).alias("id"), F.explode(F.array(F.struct(sentences(F.coalesce(F.col(text_col), F.lit(""))).alias("s")))).alias("x")).select("id", F.col("x.s").alias("s"))
    n = F.greatest(F.size("s") - 2, F.lit(0))
    # The first two long sentences besides i and i + 1 are among the first four long ones, which is all that a row carries.
    long = F.slice(F.filter(F.transform(F.col("s"), lambda x, j: F.struct(j.alias("j"), x.alias("x"))), lambda e: F.length(e["x"]) > least), 1, 4)
    threes = F.arrays_zip(F.slice("s", 1, n).alias("premise"), F.slice("s", 2, n).alias("intermediate"), F.slice("s", 3, n).alias("conclusion"))
    runs = own.select("id", long.alias("l"), threes.alias("t")).select("id", "l", F.posexplode("t").alias("pos", "t"))
    runs = runs.where((F.length("t.premise") > least) & (F.length("t.intermediate") > least))
    related = F.slice(F.filter("l", lambda e: (e["j"] != F.col("pos")) & (e["j"] != F.col("pos") + 1)), 1, 2)
    return runs.select("id", F.col("pos").cast("long").alias("pos"), "t.premise", "t.intermediate", "t.conclusion", F.transform(related, lambda e: e["x"]).alias("related"))


def complexity(pairs: Column) -> Column:
    """Mean over (question, answer, reasoning_steps, supporting_facts): 0.4, 0.3, 0.15 and 0.15 of how full steps (3), facts (3), question (20 words) and answer (50) are; 0 if empty."""
    full = lambda n, most: F.least(n / float(most), F.lit(1.0))
    each = F.transform(pairs, lambda p: full(F.size(p["reasoning_steps"]), 3) * 0.4 + full(F.size(p["supporting_facts"]), 3) * 0.3 + full(word_count(p["question"]), 20) * 0.15 + full(word_count(p["answer"]), 50) * 0.15)
    return F.when(F.size(pairs) > 0, F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(pairs)).otherwise(F.lit(0.0))


def complexity_filter(examples: DataFrame, threshold: float = 0.5, column: str = "complexity") -> DataFrame:
    return examples.where(F.col(column) >= threshold)


def distinct_examples(examples: DataFrame, text: str = "text", pairs: str = "qa_pairs", order: str = "idx") -> DataFrame:
    """The first example of each text and list of pairs, by value."""
    return first_of_equal(examples.withColumn("_pairs", F.to_json(pairs)), [text, "_pairs"], order).drop("_pairs")


def sliced_rows(rows: DataFrame, start: int, end: int, order: str) -> DataFrame:
    """Rows ``start`` to before ``end`` in order of a column, from 0; a negative place raises."""
    if start < 0 or end < start:
        raise IndexError(f"no rows {start} to {end}")
    return rows.orderBy(order).offset(start).limit(end - start)


def hash_order(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def hash_sample(rows: DataFrame, n: int, id_col: str, seed: int = 0) -> DataFrame:
    """n rows without replacement, the same for the same seed."""
    return rows.orderBy(hash_order(seed, id_col), id_col).limit(n)


def few_shot(human: DataFrame, machine: DataFrame, id_col: str, humans: int = 6, machines: int = 2, seed: int = 0) -> DataFrame:
    """Human and machine tasks for a prompt; machine tasks that are too few are made up with blank ones."""
    h, m = hash_sample(human, humans, id_col, seed), hash_sample(machine, machines, id_col, seed)
    blank = m.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.sequence(F.lit(0), F.lit(machines))).alias("i"), "n").where(F.col("i").between(1, F.lit(machines) - F.col("n")))
    empty = blank.select(*[F.lit("" if t == "string" else None).cast(t).alias(c) for c, t in m.dtypes])
    return h.unionByName(m).unionByName(empty)


def sampled_methods(methods: Column, n: int, seed: int = 0) -> Column:
    """Distinct methods in a seeded order, the first n."""
    order = F.array_sort(F.transform(F.array_distinct(methods), lambda m: F.struct(F.xxhash64(F.lit(seed), m).alias("h"), m.alias("m"))))
    return F.transform(F.slice(order, 1, n), lambda x: x["m"])


def curated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts that pass length and quality, with the number of their triples; the model that asks the questions is the caller's."""
    ok = docs.select(F.col(id_col).alias("id"), preprocessed(F.col(text_col)).alias("text")).where("text <> ''")
    counts = triples(ok, "id", "text").groupBy("id").agg(F.count(F.lit(1)).alias("n_triples"))
    return ok.join(counts, "id", "left").select("id", "text", F.coalesce("n_triples", F.lit(0)).alias("n_triples"))
