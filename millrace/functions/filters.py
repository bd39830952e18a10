"""Predicates over texts and messages: each takes columns and gives a boolean column (null text: false)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases and beginnings that mark a failed task result.
FAILURE_PHRASES = [
    "i cannot complete", "i cannot do", "task failed", "unable to complete", "cannot be completed",
    "failed to complete", "i cannot", "not possible", "impossible to", "cannot perform",
]
FAILURE_STARTS = ["error", "failed", "cannot", "unable"]


def word_count(text: Column) -> Column:
    """Words between Unicode white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")).cast("long")


def length_ok(text: Column, low: int = 5, high: int = 200) -> Column:
    return word_count(text).between(low, high)


def keyword_ok(text: Column, keywords: Sequence[str]) -> Column:
    """No keyword, lower-cased, occurs in the lower-cased text."""
    bad = F.lit(False)
    for k in keywords:
        bad |= F.lower(text).contains(k.lower())
    return F.coalesce(~bad, F.lit(False))


def punctuation_ok(text: Column) -> Column:
    """Doesn't begin with a character that is neither a word character nor white space."""
    return F.coalesce(~text.rlike(r"(?U)^[^\w\s]"), F.lit(False))


def english_start_ok(text: Column) -> Column:
    return F.coalesce(text.rlike("^[A-Za-z]"), F.lit(False))


def score_ok(score: Column, threshold: float = 0.7) -> Column:
    """A reward model's score reaches the threshold (registry default 0.7)."""
    return F.coalesce(score >= threshold, F.lit(False))


#: Named constructors: keyword arguments to a predicate over the text column.
REGISTRY: dict[str, Callable[..., Callable[[Column], Column]]] = {
    "length": lambda min_len=5, max_len=200: lambda t: length_ok(t, min_len, max_len),
    "keyword": lambda keywords: lambda t: keyword_ok(t, keywords),
    "punctuation": lambda: punctuation_ok,
    "non_english": lambda: english_start_ok,
}


def register_filter(name: str, constructor: Callable[..., Callable[[Column], Column]]) -> None:
    REGISTRY[name] = constructor


class InstructionFilter:
    """An AND of named predicates that can tell which of them failed."""

    def __init__(self, config: dict[str, dict] | None = None, stop_on_first_failure: bool = False) -> None:
        self.filters: list[tuple[str, Callable[[Column], Column]]] = []
        self.stop = stop_on_first_failure
        for name, options in (config or {}).items():
            if name not in REGISTRY:
                raise ValueError(f"unknown filter {name!r}; known: {sorted(REGISTRY)}")
            self.add_filter(name, REGISTRY[name](**options))

    def add_filter(self, name: str, predicate: Callable[[Column], Column]) -> InstructionFilter:
        self.filters.append((name, predicate))
        return self

    def failed(self, text: Column) -> Column:
        """Names of the predicates that fail, in order (only the first, if asked to stop there)."""
        names = F.filter(F.array(*[F.when(~p(text), F.lit(n)) for n, p in self.filters]), lambda x: x.isNotNull())
        return F.slice(names, 1, 1) if self.stop else names

    def passes(self, text: Column) -> Column:
        return F.size(self.failed(text)) == 0


def text_quality_ok(text: Column) -> Column:
    """Two full stops at least; at most 30 % of the characters neither letters, numbers nor white space."""
    special = F.length(text) - F.length(F.regexp_replace(text, r"(?U)[^\p{L}\p{N}\s]", ""))
    stops = F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))
    return F.coalesce((stops >= 2) & (special / F.nullif(F.length(text), F.lit(0)) <= 0.3), F.lit(False))


def preprocessed(text: Column, low: int = 50, high: int = 512) -> Column:
    """The trimmed text if its length and quality are right, else the empty string."""
    own = trimmed(text)
    return F.when(F.length(own).between(low, high) & text_quality_ok(own), own).otherwise(F.lit(""))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def task_content_ok(text: Column, min_length: int = 1, output: bool = False) -> Column:
    """Task text that isn't blank or too short; a result, moreover, that doesn't own up to a failure."""
    own = trimmed(text)
    ok = text.isNotNull() & (own != "") & (F.length(own) >= min_length)
    if output:
        lower = F.lower(own)
        for phrase in FAILURE_PHRASES:
            ok &= ~lower.contains(phrase)
        for start in FAILURE_STARTS:
            ok &= ~lower.startswith(start)
    return F.coalesce(ok, F.lit(False))


def qa_quality_ok(pairs: Column) -> Column:
    """An array of (question, answer) that isn't empty: questions of 10 characters, answers of 5, and none the same."""
    each = F.forall(pairs, lambda p: (F.length(p["question"]) >= 10) & (F.length(p["answer"]) >= 5) & (p["question"] != p["answer"]))
    return F.coalesce((F.size(pairs) > 0) & each, F.lit(False))


def example_ok(text: Column, pairs: Column, min_words: int = 20) -> Column:
    return qa_quality_ok(pairs) & (word_count(text) >= min_words)


def scores_reach(scores: Column, thresholds: float | dict[str, float]) -> Column:
    """Each score of a map reaches its threshold: one number for all, or by name (0 where not named)."""
    if isinstance(thresholds, dict):
        own = F.create_map(*[F.lit(x) for kv in thresholds.items() for x in (kv[0], float(kv[1]))]) if thresholds else F.create_map().cast("map<string,double>")
        return F.forall(F.map_entries(scores), lambda e: e["value"] >= F.coalesce(F.element_at(own, e["key"]), F.lit(0.0)))
    return F.forall(F.map_values(scores), lambda v: v >= float(thresholds))


def score_feedback(scores: Column, threshold: float) -> Column:
    """Which scores of a map fall short, by name."""
    low = F.array_sort(F.map_keys(F.map_filter(scores, lambda _, v: v < threshold)))
    return F.when(F.size(low) > 0, F.concat(F.lit("Needs improvement: "), F.array_join(low, ", "))).otherwise(F.lit("All dimensions meet the threshold"))


def rewards_reach(messages: DataFrame, thresholds: dict[str, float], scores: str = "scores") -> DataFrame:
    """Rows whose map of rewards reaches every threshold; a reward that is missing is an error."""
    ok = F.lit(True)
    for name, least in thresholds.items():
        value = F.try_element_at(F.col(scores), F.lit(name))
        ok &= F.when(value.isNull(), F.raise_error(F.lit(f"no score of type {name}")).cast("double")).otherwise(value) >= least
    return messages.where(ok)


def payload_matches(payload: Column, conditions: dict[str, object]) -> Column:
    """Every key of a JSON payload has the given value."""
    ok = F.lit(True)
    for key, value in conditions.items():
        text = str(value).lower() if isinstance(value, bool) else str(value)
        ok &= F.get_json_object(payload, f"$.{key}") == text
    return F.coalesce(ok, F.lit(False))


def problem_valid(problem: DataFrame) -> DataFrame:
    """Problems with the reason for which they are refused (null: none)."""
    blank = lambda c: F.col(c).isNull() | (trimmed(F.col(c)) == "")
    return problem.withColumn("reject_reason", F.when(blank("problem"), "problem is missing").when(F.col("solution").isNotNull() & (trimmed(F.col("solution")) == ""), "solution is empty"))


def oversized_dropped(values: Column, most: int = 128) -> Column:
    """An array unless it has ``most`` elements or more, then null."""
    return F.when(F.size(values) < most, values)


def compress_needed(messages: DataFrame, key: str, tokens: str, message_limit: int = 40, token_limit: int | None = None) -> DataFrame:
    """Per key, whether its messages or tokens are beyond the limit."""
    over = F.count(F.lit(1)) > message_limit
    if token_limit is not None:
        over |= F.sum(tokens) > token_limit
    return messages.groupBy(key).agg(F.count(F.lit(1)).alias("n_messages"), F.sum(tokens).alias("n_tokens"), over.alias("compress"))
