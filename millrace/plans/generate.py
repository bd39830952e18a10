"""The relational part of data generation. Models are the caller's functions from a list of prompts to a list of answers, called per batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.filters import InstructionFilter, scores_reach
from millrace.functions.schemas import type_from_json_schema
from millrace.operators.curation import few_shot
from millrace.operators.dedup import _cut
from millrace.operators.rouge_join import unlike

Model = Callable[[list[str]], list[str]]

#: Names of evolution methods by kind.
METHODS = {"in-depth": ["constraints", "deepening", "concretizing", "reasoning"], "in-breadth": ["mutation"]}


def asked(rows: DataFrame, model: Model, prompt: str = "prompt", answer: str = "answer") -> DataFrame:
    """Each row with the model's answer to its prompt."""

    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model(batch.tolist()))

    call.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return rows.withColumn(answer, F.pandas_udf(call, "string")(F.col(prompt)))


def few_shot_prompt(tasks: DataFrame, text: str = "instruction") -> DataFrame:
    """One prompt from a few tasks, numbered in order of their texts."""
    each = F.transform(F.array_sort(F.collect_list(F.col(text))), lambda t, i: F.concat(F.lit("Task "), (i + 1).cast("string"), F.lit(": "), t))
    return tasks.agg(F.concat(F.lit("Come up with a new task.\n"), F.array_join(each, "\n"), F.lit("\nNext task:")).alias("prompt"))


def resolved_method(name: Column, seed: int = 0, key: Column | None = None) -> Column:
    """A method's name; the name of a kind gives one of its methods by a seeded hash, an unknown one raises."""
    known = [m for own in METHODS.values() for m in own]
    pick = F.when(name.isin(known), name)
    for kind, own in METHODS.items():
        at = F.pmod(F.xxhash64(F.lit(seed), key if key is not None else name), F.lit(len(own))).cast("int")
        pick = pick.when(name == kind, F.array(*[F.lit(m) for m in own])[at])
    return pick.otherwise(F.raise_error(F.concat(F.lit("unknown method "), name)).cast("string"))


def self_instruct(seeds: DataFrame, model: Model, rounds: int, candidates: int = 8, filters: InstructionFilter | None = None, threshold: float = 0.7, seed: int = 0) -> DataFrame:
    """Instructions that a model comes up with from examples, filtered, unlike what there is (ROUGE-L), round by round. ``seeds``: ``instruction``."""
    filters = filters or InstructionFilter({"length": {}, "punctuation": {}, "non_english": {}})
    machine = seeds.sparkSession.createDataFrame([], "instruction string")
    for r in range(rounds):
        examples = few_shot(seeds.select("instruction"), machine, "instruction", seed=seed + r)
        prompt = few_shot_prompt(examples).select("prompt", F.explode(F.sequence(F.lit(1), F.lit(candidates))).alias("i"))
        new = asked(prompt.select(F.concat("prompt", F.lit(" ("), "i", F.lit(")")).alias("prompt")), model).select(F.col("answer").alias("instruction")).distinct()
        existing = seeds.select("instruction").union(machine)
        machine = _cut(machine.union(unlike(new.where(filters.passes(F.col("instruction"))), existing, threshold, "instruction").select("instruction")))
    return machine


def evolved(prompts: DataFrame, model: Model, scorer: Callable[[DataFrame], DataFrame], method: str, generations: int = 2, iterations: int = 1, seed: int = 0) -> DataFrame:
    """Each prompt rewritten ``iterations`` times; of the generations of a step the one with the highest total score goes on. ``prompts``: ``id``, ``prompt``."""
    now = prompts.select("id", "prompt", F.lit(0).alias("step"))
    every = now
    for step in range(1, iterations + 1):
        each = now.select("id", F.col("prompt").alias("before"), F.explode(F.sequence(F.lit(0), F.lit(generations - 1))).alias("n"))
        each = each.withColumn("method", resolved_method(F.lit(method), seed + step, F.struct("id", "n")))
        made = asked(each.withColumn("prompt", F.concat(F.lit("Rewrite by "), "method", F.lit(": "), "before")), model).select("id", "n", F.col("answer").alias("prompt"))
        scored = scorer(made).withColumn("total", F.aggregate(F.map_values("scores"), F.lit(0.0), lambda s, x: s + x))
        now = _cut(scored.groupBy("id").agg(F.max_by("prompt", F.struct("total", -F.col("n"))).alias("prompt")).withColumn("step", F.lit(step)))
        every = every.union(now)
    return every


def improved(problems: DataFrame, model: Model, scorer: Callable[[DataFrame], DataFrame], thresholds: float | dict[str, float] = 0.7, most: int = 3) -> DataFrame:
    """Traces rewritten until their scores reach the thresholds, ``most`` times at most. ``problems``: ``id``, ``problem``; adds ``trace``, ``rounds``, ``ok``."""
    now = asked(problems.withColumn("prompt", F.col("problem")), model, answer="trace").select("id", "problem", "trace", F.lit(0).alias("rounds"))
    done = None
    for _ in range(most + 1):
        scored = _cut(scorer(now).withColumn("ok", scores_reach(F.col("scores"), thresholds)))
        own = scored.where("ok").select("id", "problem", "trace", "rounds", "ok")
        done = own if done is None else done.union(own)
        left = scored.where("NOT ok")
        now = asked(left.withColumn("prompt", F.concat("problem", F.lit("\nImprove: "), "trace")), model, answer="better").select("id", "problem", F.col("better").alias("trace"), (F.col("rounds") + 1).alias("rounds"))
    return done.union(left.select("id", "problem", "trace", "rounds", "ok"))


def best_attempt(attempts: DataFrame, key: str = "id", score: str = "score", order: str = "attempt", enough: float = 0.9) -> DataFrame:
    """The first recorded attempt above ``enough``, else the best."""
    passes = F.col(score) > enough
    rank = F.struct(passes.alias("p"), F.when(passes, -F.col(order).cast("double")).otherwise(F.col(score)).alias("s"), (-F.col(order)).alias("o"))
    return attempts.groupBy(key).agg(F.max_by(F.struct(*attempts.columns), rank).alias("b")).select("b.*")


def with_rationale(questions: DataFrame, model: Model, check: Callable[[DataFrame], DataFrame], tries: int = 10) -> DataFrame:
    """Questions whose answer a verifier accepts (``check`` adds ``accepted``); the others are asked again, ``tries`` times at most."""
    left, done = questions, None
    for _ in range(tries):
        made = _cut(check(asked(left, model)))
        own = made.where("accepted")
        done = own if done is None else done.union(own)
        left = made.where("NOT accepted").select(*questions.columns)
        if left.isEmpty():
            break
    return done


def constrained(prompts: DataFrame, model: Model, regex: str | None = None, choices: Sequence[str] | None = None, schema: dict | None = None, tries: int = 3) -> DataFrame:
    """Rows (``prompt``) with an answer that keeps the constraints: a pattern for the whole answer, a set of answers, a JSON schema.

    The model is asked again, ``tries`` times at most, for answers that break one; rows without a good answer are left out.
    """
    ok = F.lit(True)
    if regex is not None:
        ok &= F.col("answer").rlike(f"^(?:{regex})\\z")
    if choices is not None:
        ok &= F.col("answer").isin(list(choices))
    if schema is not None:
        needed = [F.get_json_object("answer", f"$.{name}").isNotNull() for name in schema.get("required", [])]
        ok &= F.from_json("answer", type_from_json_schema(schema), {"mode": "PERMISSIVE"}).isNotNull() & F.try_parse_json("answer").isNotNull()
        for n in needed:
            ok &= n
    return with_rationale(prompts, model, lambda rows: rows.withColumn("accepted", F.coalesce(ok, F.lit(False))), tries).drop("accepted")


def collected(rows: Sequence[dict], spark) -> DataFrame:
    """Recorded steps (role, name, message, function_call) in order."""
    return spark.createDataFrame([(i, r.get("role"), r.get("name"), r.get("message"), r.get("function_call")) for i, r in enumerate(rows)], "turn long, role string, name string, message string, function_call string")
