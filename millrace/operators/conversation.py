"""Chat histories: windows with decaying scores, context packing, flow rules and training formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DECAY = 0.9
#: Names of roles in the shared conversation format.
SHAREGPT = {"system": "system", "developer": "system", "user": "human", "assistant": "gpt", "function": "tool", "tool": "tool"}
COLLECTED = {"human": "human", "gpt": "gpt", "observation": "tool", "function_call": "gpt", "system": "system"}


def windowed(messages: DataFrame, size: int | None = None, key: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """The last ``size`` messages of each conversation with a ``score``; a first message by the system or developer stays beside them.

    Scores are 0.9 to the number of kept messages from the last one to this, the system's not counted; the system's is 1. A size of 0 keeps the first alone.
    """
    if size is not None and size < 0:
        raise ValueError("size must not be negative")
    preserved = F.lower(role).isin("system", "developer")
    forward = Window.partitionBy(key).orderBy(turn)
    rows = messages.withColumn("_lead", (F.row_number().over(forward) == 1) & F.coalesce(preserved, F.lit(False)))
    back = Window.partitionBy(key, "_lead").orderBy(F.col(turn).desc())
    rows = rows.withColumn("_back", F.row_number().over(back))
    if size is not None:
        rows = rows.where(F.col("_lead") | (F.col("_back") <= size))
    steps = F.sum(F.when(F.lower(role) == "system", 0).otherwise(1)).over(Window.partitionBy(key).orderBy(F.col(turn).desc()).rowsBetween(Window.unboundedPreceding, 0))
    score = F.when(F.lower(role) == "system", F.lit(1.0)).otherwise(F.pow(F.lit(DECAY), steps.cast("double")))
    return rows.withColumn("score", score).drop("_lead", "_back")


def packed(units: DataFrame, budget: int, key: str = "conv_id", unit: str = "id", tokens: str = "tokens", score: str = "score", time: str = "timestamp") -> DataFrame:
    """Units that fit a budget of tokens, greedily by (score desc, time desc, unit): one that doesn't fit is passed over and later ones may still fit.

    Each conversation is folded on its own, over an array of its units in order, in the JVM.
    """
    order = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), (-F.col(time)).alias("t"), F.col(unit).alias("u"), F.col(tokens).cast("long").alias("n"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{dict(units.dtypes)[unit]}>").alias("kept"))
    step = lambda a, x: F.when(a["used"] + x["n"] <= budget, F.struct((a["used"] + x["n"]).alias("used"), F.concat(a["kept"], F.array(x["u"])).alias("kept"))).otherwise(a)
    kept = units.groupBy(key).agg(F.aggregate(order, start, step)["kept"].alias("kept")).select(key, F.explode("kept").alias(unit))
    return units.join(kept, [key, unit], "left_semi")


def context(records: DataFrame, budget: int, key: str = "conv_id", uuid: str = "uuid", tokens: str = "tokens", score: str = "score", time: str = "timestamp", role: str = "role", call: str | None = None) -> DataFrame:
    """Records in the order in which they enter a model's context, with ``position`` from 0.

    System first; records of one uuid once; all if they fit, else the best by ``packed`` beside the system's; groups of a tool call go
    together; in order of (time, score desc).
    """
    once = Window.partitionBy(key, uuid).orderBy(time, F.col(score).desc())
    rows = records.withColumn("_once", F.row_number().over(once)).where("_once = 1").drop("_once")
    rows = rows.withColumn("_system", F.coalesce(F.lower(role) == "system", F.lit(False))).withColumn("_group", F.coalesce(F.col(call), F.col(uuid)) if call else F.col(uuid))
    room = rows.groupBy(key).agg((F.lit(budget) - F.sum(F.when(F.col("_system"), F.col(tokens)).otherwise(0))).alias("_room"), F.sum(tokens).alias("_all"))
    rows = rows.join(room, key)
    groups = rows.where(~F.col("_system")).groupBy(key, "_group").agg(F.sum(tokens).alias("n"), F.max(score).alias("s"), F.max(time).alias("t"), F.first("_room").alias("_room"), F.first("_all").alias("_all"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), (-F.col("t")).alias("t"), F.col("_group").alias("g"), F.col("n").cast("long").alias("n"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("kept"))
    fold = lambda room: F.aggregate(order, start, lambda a, x: F.when(a["used"] + x["n"] <= room, F.struct((a["used"] + x["n"]).alias("used"), F.concat(a["kept"], F.array(x["g"].cast("string"))).alias("kept"))).otherwise(a))["kept"]
    every = F.transform(order, lambda x: x["g"].cast("string"))
    kept = groups.groupBy(key, "_room", "_all").agg(F.when(F.col("_all") <= budget, every).otherwise(fold(F.col("_room"))).alias("kept"))
    kept = kept.select(key, F.explode("kept").alias("_g"))
    chosen = rows.where("_system").unionByName(rows.where(~F.col("_system")).withColumn("_g", F.col("_group").cast("string")).join(kept, [key, "_g"], "left_semi").drop("_g"))
    at = Window.partitionBy(key).orderBy(F.col("_system").desc(), time, F.col(score).desc(), uuid)
    return chosen.withColumn("position", (F.row_number().over(at) - 1).cast("long")).drop("_system", "_group", "_room", "_all")


def without_tool_traffic(messages: DataFrame, role: str = "role", calls: str | None = None) -> DataFrame:
    """Without function and tool messages, and assistant messages that call tools."""
    gone = F.lower(role).isin("function", "tool")
    if calls is not None:
        gone |= (F.lower(role) == "assistant") & F.col(calls).isNotNull()
    return messages.where(~gone)


def with_content(messages: DataFrame, content: str = "text") -> DataFrame:
    return messages.where(F.coalesce(F.trim(content), F.lit("")) != "")


def flow_valid(messages: DataFrame, key: str = "conv_id", turn: str = "turn", sender: str = "from") -> DataFrame:
    """Per conversation, whether it begins with the system or a human, and every model message follows a human or tool and every tool message a model's."""
    before = F.lag(sender).over(Window.partitionBy(key).orderBy(turn))
    ok = F.when(before.isNull(), F.col(sender).isin("system", "human")).when(F.col(sender) == "gpt", before.isin("human", "tool", "system")).when(F.col(sender) == "tool", before == "gpt").when(F.col(sender) == "system", False).otherwise(True)
    return messages.select(key, ok.alias("_ok")).groupBy(key).agg(F.every("_ok").alias("valid"))


def interleaved(history: DataFrame, hits: DataFrame) -> DataFrame:
    """First message of the history, retrieved ones, the rest: both tables need ``key``, ``ord``; adds ``section``."""
    h = history.withColumn("section", F.when(F.row_number().over(Window.partitionBy("key").orderBy("ord")) == 1, 0).otherwise(2))
    return h.unionByName(hits.withColumn("section", F.lit(1)))


def last_user_message(messages: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    return messages.where(F.lower(role) == "user").groupBy(key).agg(F.max_by(content, turn).alias("last_user"))


def sliced(messages: DataFrame, most: int, content: str = "text", time: str = "timestamp") -> DataFrame:
    """Messages of more than ``most`` words as numbered slices; each later slice is a microsecond later."""
    own = messages.withColumn("_words", F.split(content, " ")).withColumn("n_slices", F.greatest(F.ceil(F.size("_words") / most), F.lit(1)).cast("int"))
    parts = F.transform(F.sequence(F.lit(0), F.col("n_slices") - 1), lambda i: F.array_join(F.slice("_words", i * most + 1, most), " "))
    rows = own.select(*messages.columns, "n_slices", F.posexplode(parts).alias("slice", "_part"))
    return rows.withColumn(content, F.col("_part")).withColumn(time, F.col(time) + F.col("slice") * 1e-6).drop("_part")


def api_samples(messages: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", api_role: str = "API") -> DataFrame:
    """Two samples for each API turn: what stands before it, with it as the goal; and what stands up to it, with the next turn as the goal."""
    api = messages.where(F.col(role) == api_role).select(key, F.col(turn).alias("api_turn"))
    each = api.select(key, "api_turn", F.explode(F.array(F.lit(0), F.lit(1))).alias("past"))
    both = each.join(messages.select(key, turn), key).where(F.col(turn) < F.col("api_turn") + F.col("past"))
    counted = both.groupBy(key, "api_turn", "past").agg(F.count(F.lit(1)).alias("prefix"))
    return each.join(counted, [key, "api_turn", "past"], "left").select(key, "api_turn", F.coalesce("prefix", F.lit(0)).alias("prefix"), (F.col("api_turn") + F.col("past")).alias("goal_turn"))


def terminated(messages: DataFrame, words: dict[str, int], any_word: bool = True, case_sensitive: bool = False, key: str = "conv_id", turn: str = "turn", content: str = "text") -> DataFrame:
    """Messages with ``terminated``: whether up to here a word (or all) has come in as many messages as it needs."""
    upto = Window.partitionBy(key).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    text = F.col(content) if case_sensitive else F.lower(content)
    met = [F.sum(F.coalesce(text.contains(w if case_sensitive else w.lower()), F.lit(False)).cast("int")).over(upto) >= n for w, n in words.items()]
    total = met[0]
    for m in met[1:]:
        total = (total | m) if any_word else (total & m)
    return messages.withColumn("terminated", total)


def token_limited(messages: DataFrame, limit: int, key: str = "conv_id", turn: str = "turn", tokens: str = "tokens") -> DataFrame:
    upto = Window.partitionBy(key).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("terminated", F.sum(tokens).over(upto) >= limit)


def grouped_calls(units: DataFrame, call_id: str = "tool_call_id", order: str = "ord") -> DataFrame:
    """Calls and responses of each tool call together, in order."""
    return units.where(F.col(call_id).isNotNull()).groupBy(call_id).agg(F.array_sort(F.collect_list(F.struct(order, "role", "content"))).alias("units"))


def openai_message(role: Column, content: Column) -> Column:
    """(role, content); roles that plain messages can't have raise."""
    return F.when(F.lower(role).isin("system", "user", "assistant"), F.struct(F.lower(role).alias("role"), content.alias("content"))).otherwise(F.raise_error(F.concat(F.lit("unsupported role: "), role)).cast("struct<role:string,content:string>"))


def sharegpt_role(role: Column, mapping: dict[str, str] = SHAREGPT) -> Column:
    out = F.lit(None).cast("string")
    for name, other in mapping.items():
        out = F.when(F.lower(role) == name, other).otherwise(out)
    return out


def alpaca_export(messages: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """``instruction``, ``input`` (empty), ``output`` of conversations of one pair, with or without a system message before; others are left out."""
    rows = F.array_sort(F.collect_list(F.struct(turn, F.lower(role).alias("r"), F.col(content).alias("c"))))
    each = messages.groupBy(key).agg(rows.alias("m"))
    n, first = F.size("m"), F.col("m")[0]
    three = (n == 3) & (first["r"] == "system")
    ok = each.where((n == 2) | three)
    at = F.when(F.size("m") == 3, 1).otherwise(0)
    system = F.when(F.size("m") == 3, F.col("m")[0]["c"]).otherwise(F.lit(""))
    return ok.select(key, F.concat(system, F.get("m", at)["c"]).alias("instruction"), F.lit("").alias("input"), F.get("m", at + 1)["c"].alias("output"))


def sharegpt_export(messages: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text", call: str | None = None) -> DataFrame:
    """``system`` and ``conversations``, an array of (from, value) in order."""
    name = F.when(F.lower(role) == "user", "human").when(F.lower(role) == "assistant", F.when(F.col(call).isNotNull(), "function_call").otherwise("gpt") if call else F.lit("gpt")).when(F.lower(role).isin("function", "tool"), "observation")
    value = F.when(name == "function_call", F.col(call)).otherwise(F.col(content)) if call else F.col(content)
    rows = messages.select(key, turn, F.lower(role).alias("_r"), name.alias("_from"), value.alias("_value"), F.col(content).alias("_c"))
    items = F.transform(F.array_sort(F.collect_list(F.when(F.col("_from").isNotNull(), F.struct(turn, "_from", "_value")))), lambda x: F.struct(x["_from"].alias("from"), x["_value"].alias("value")))
    return rows.groupBy(key).agg(F.coalesce(F.min_by(F.when(F.col("_r") == "system", F.col("_c")), F.when(F.col("_r") == "system", F.col(turn))), F.lit("")).alias("system"), items.alias("conversations"))


def function_message(result: Column, call: Column, masked: bool = False) -> Column:
    """(from, value) of a tool message: without a result it is the call (gpt), else the response (tool)."""
    return F.when(result.isNull(), F.struct(F.lit("gpt").alias("from"), call.alias("value"))).otherwise(F.struct(F.lit("tool").alias("from"), (F.lit("[MASKED]") if masked else result).alias("value")))


def as_lines(messages: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """Each conversation as lines "role: content"."""
    rows = F.array_sort(F.collect_list(F.struct(turn, F.concat(F.col(role), F.lit(": "), F.coalesce(F.col(content), F.lit(""))).alias("line"))))
    return messages.groupBy(key).agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("conversation"))


def thread(messages: DataFrame, ids: DataFrame, id_col: str = "message_id", time: str = "timestamp") -> DataFrame:
    """Messages with the given ids in order of time."""
    return messages.join(ids.select(id_col), id_col, "left_semi").orderBy(time, id_col)


def token_count(messages: DataFrame, count: Column, key: str = "conv_id", per_message: int = 3, priming: int = 3) -> DataFrame:
    """Tokens of each list of messages: ``count`` of each, a frame around each, and what primes the reply. The counter is the caller's."""
    return messages.groupBy(key).agg((F.sum(count + per_message) + priming).cast("long").alias("n_tokens"))


def image_tokens(width: Column, height: Column, low: Column) -> Column:
    """85 in low detail; else the picture is fitted in 2048, its shorter side brought to 768, and costs 85 and 170 a tile of 512. Null if a side vanishes when it is fitted."""
    shrink = F.greatest(F.lit(1.0), F.greatest(width, height) / 2048.0)
    w, h = F.floor(width / shrink), F.floor(height / shrink)
    scale = F.least(w, h) / 768.0
    tiles = F.ceil(F.floor(F.try_divide(h, scale)) / 512.0) * F.ceil(F.floor(F.try_divide(w, scale)) / 512.0)
    return F.when(low, F.lit(85)).otherwise(85 + 170 * tiles).cast("long")
