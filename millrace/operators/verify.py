"""Verification of answers, rewards and episodes of environments. Generated code is never run."""

from __future__ import annotations

import ast
import signal
import time
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import physics_number, tolerance, value_and_unit


def close(a, b, tolerance: float = 1e-6) -> bool:
    """Equality with an absolute tolerance for numbers, through lists, tuples, dictionaries and sets. Whole numbers of any size are told apart."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, int | float) and isinstance(b, int | float):
        return a == b or (a != a and b != b) or abs(a - b) <= tolerance
    if type(a) is not type(b):
        return False
    if isinstance(a, list | tuple):
        return len(a) == len(b) and all(close(x, y, tolerance) for x, y in zip(a, b, strict=True))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(close(a[k], b[k], tolerance) for k in a)
    if isinstance(a, set | frozenset):
        return len(a) == len(b) and all(any(close(x, y, tolerance) for y in b) for x in a)
    return a == b


def literals_close(answer: str | None, truth: str | None, tolerance: float = 1e-6) -> bool:
    try:
        return answer is not None and truth is not None and close(ast.literal_eval(answer), ast.literal_eval(truth), tolerance)
    except (ValueError, SyntaxError, RecursionError, MemoryError):
        return answer == truth


@F.pandas_udf(T.BooleanType())
def literal_equal(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([literals_close(x, y) for x, y in zip(a, b, strict=True)])


class _TimeUp(BaseException):
    """A check has used up its time; no handler of errors within it takes this for one of its own."""


def _time_up(*_) -> None:
    raise _TimeUp


def verified(rows: DataFrame, verify: Callable[[str, str], bool], solution: str, reference: str, extract: Callable[[str], str | None] | None = None, tries: int = 3, timeout: float | None = None) -> DataFrame:
    """Adds ``status`` (success, failure, error, timeout), ``result``, ``duration``, ``error_message``; a row's error doesn't fail the others.

    An error is tried again, up to ``tries``. A row's tries together have ``timeout`` seconds: then a timer interrupts the check, and the row has timed out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if timeout is not None:
            signal.signal(signal.SIGALRM, _time_up)
        for batch in batches:
            out = []
            for s, r in zip(batch[solution], batch[reference], strict=True):
                began, status, result, message = time.monotonic(), "error", None, None
                for _ in range(tries):
                    try:
                        if timeout is not None:
                            signal.setitimer(signal.ITIMER_REAL, max(1e-3, timeout - (time.monotonic() - began)))
                        result = extract(s) if extract else s
                        status = "failure" if result is None else "success" if verify(result, r) else "failure"
                        message = None if result is not None else "nothing could be extracted"
                        break
                    except _TimeUp:
                        result, message = None, f"not done within {timeout} s"
                        break
                    except Exception as e:
                        message = str(e)
                    finally:
                        if timeout is not None:
                            signal.setitimer(signal.ITIMER_REAL, 0)
                took = time.monotonic() - began
                if timeout is not None and took > timeout:
                    status = "timeout"
                out.append((status, result, took, message))
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(out, columns=["status", "result", "duration", "error_message"])], axis=1)

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInPandas(run, f"{fields}, status string, result string, duration double, error_message string")


#: Units as a factor and a base unit.
UNITS = {"m": (1.0, "m"), "cm": (0.01, "m"), "mm": (0.001, "m"), "km": (1000.0, "m"), "s": (1.0, "s"), "ms": (0.001, "s"), "min": (60.0, "s"), "h": (3600.0, "s"), "g": (0.001, "kg"), "kg": (1.0, "kg"), "J": (1.0, "J"), "kJ": (1000.0, "J"), "eV": (1.602176634e-19, "J"), "N": (1.0, "N"), "W": (1.0, "W"), "kW": (1000.0, "W"), "V": (1.0, "V"), "A": (1.0, "A"), "Hz": (1.0, "Hz"), "Pa": (1.0, "Pa"), "K": (1.0, "K"), "": (1.0, "")}


def _in_base(unit: Column) -> tuple[Column, Column]:
    factors = F.create_map(*[F.lit(x) for k, (f, _) in UNITS.items() for x in (k, f)])
    bases = F.create_map(*[F.lit(x) for k, (_, b) in UNITS.items() for x in (k, b)])
    return F.coalesce(F.try_element_at(factors, unit), F.lit(1.0)), F.coalesce(F.try_element_at(bases, unit), unit)


def physics_outcome(answer: Column, truth: Column, default_tolerance: float = 1e-2) -> Column:
    """equal, wrong_value, wrong_unit or unreadable, for a value with a unit against the true one."""
    a, t = value_and_unit(physics_number(answer)), value_and_unit(physics_number(truth))
    (fa, ba), (ft, bt) = _in_base(a["unit"]), _in_base(t["unit"])
    near = F.abs(a["value"] * fa - t["value"] * ft) <= tolerance(physics_number(truth), default_tolerance) * F.abs(t["value"] * ft)
    return F.when(a["value"].isNull() | t["value"].isNull(), "unreadable").when((ba != bt) & (a["unit"] != ""), "wrong_unit").when(near, "equal").otherwise("wrong_value")


def step_rewards(rows: DataFrame, correct: Column, custom: Column | None = None) -> DataFrame:
    """``rewards`` (a map: correctness, and the caller's own) and ``reward``, their sum."""
    own = F.create_map(F.lit("correctness"), F.when(correct, 1.0).otherwise(0.0))
    total = own if custom is None else F.map_concat(own, custom)
    return rows.withColumn("rewards", total).withColumn("reward", F.aggregate(F.map_values("rewards"), F.lit(0.0), lambda s, x: s + x))


def episodes(actions: DataFrame, step: Callable[[dict, str], tuple[dict, float, bool]], start: Callable[[], dict], key: str = "episode", order: str = "turn", action: str = "action") -> DataFrame:
    """Plays each episode's actions in order through ``step(state, action) -> (state, reward, done)``; what comes after the end is left out."""

    def play(rows: pd.DataFrame) -> pd.DataFrame:
        state, out = start(), []
        for turn, act in rows.sort_values(order)[[order, action]].itertuples(index=False):
            state, reward, done = step(state, act)
            out.append((rows[key].iloc[0], turn, reward, done))
            if done:
                break
        return pd.DataFrame(out, columns=[key, order, "reward", "done"])

    kinds = dict(actions.dtypes)
    return actions.groupBy(key).applyInPandas(play, f"{key} {kinds[key]}, {order} {kinds[order]}, reward double, done boolean")


#: The lines of the board.
LINES = [(0, 1, 2), (3, 4, 5), (6, 7, 8), (0, 3, 6), (1, 4, 7), (2, 5, 8), (0, 4, 8), (2, 4, 6)]


def tic_tac_toe_start() -> dict:
    return {"board": " " * 9}


def _winner(board: str) -> str | None:
    return next((board[a] for a, b, c in LINES if board[a] != " " and board[a] == board[b] == board[c]), None)


@lru_cache(maxsize=None)
def _best(board: str, player: str) -> tuple[int, int]:
    """Value for O and the first best move by full search."""
    won = _winner(board)
    if won or " " not in board:
        return (1 if won == "O" else -1 if won == "X" else 0), -1
    moves = [(_best(board[:i] + player + board[i + 1 :], "X" if player == "O" else "O")[0], -i) for i in range(9) if board[i] == " "]
    value, at = max(moves) if player == "O" else min((v, -i) for v, i in moves)
    return value, -at if player == "O" else at


def tic_tac_toe(state: dict, action: str) -> tuple[dict, float, bool]:
    """The player is X and gives a field 1 to 9; O answers by full search. Rewards: 1 won, 0.5 drawn, 0 lost or not allowed."""
    board = state["board"]
    if not str(action).strip().isdigit() or not 1 <= int(action) <= 9 or board[int(action) - 1] != " ":
        return state, 0.0, False
    board = board[: int(action) - 1] + "X" + board[int(action) :]
    if _winner(board) != "X" and " " in board:
        at = _best(board, "O")[1]
        board = board[:at] + "O" + board[at + 1 :]
    won = _winner(board)
    done = won is not None or " " not in board
    return {"board": board}, (1.0 if won == "X" else 0.5 if done and won is None else 0.0), done


def numeric_value(text: str | None) -> float | None:
    """The value of an arithmetic expression: numbers, + - * / ^, brackets, LaTeX fractions and roots; null if it is anything else."""
    import re

    if text is None:
        return None
    own = re.sub(r"\\[dt]?frac\{([^{}]*)\}\{([^{}]*)\}", r"((\1)/(\2))", text.replace("$", "").strip())
    own = re.sub(r"\\sqrt\{([^{}]*)\}", r"((\1)**0.5)", own)
    own = re.sub(r"(?<=\d),(?=\d{3})", "", own).replace("\\cdot", "*").replace("\\times", "*").replace("\\left", "").replace("\\right", "").replace("^", "**").replace("\\%", "/100").replace("%", "/100")
    try:
        return _value(ast.parse(own, mode="eval").body)
    except (SyntaxError, ValueError, ZeroDivisionError, OverflowError, RecursionError, MemoryError):
        return None


def _value(node: ast.AST) -> float:
    if isinstance(node, ast.Constant) and isinstance(node.value, int | float) and not isinstance(node.value, bool):
        return float(node.value)
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub | ast.UAdd):
        return -_value(node.operand) if isinstance(node.op, ast.USub) else _value(node.operand)
    if isinstance(node, ast.BinOp):
        a, b = _value(node.left), _value(node.right)
        if isinstance(node.op, ast.Pow):
            if abs(b) > 64:
                raise ValueError("the exponent is too large")
            out = a**b
        else:
            ops = {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: a / b}
            if type(node.op) not in ops:
                raise ValueError("not arithmetic")
            out = ops[type(node.op)]()
        if isinstance(out, complex):
            raise ValueError("not a real number")
        return out
    raise ValueError("not arithmetic")


def math_equal(answer: str | None, truth: str | None, tolerance: float = 1e-6) -> bool:
    """Both are arithmetic and their values are close, or they are the same text without white space."""
    a, b = numeric_value(answer), numeric_value(truth)
    if a is not None and b is not None:
        return close(a, b, tolerance)
    return answer is not None and truth is not None and "".join(answer.split()) == "".join(truth.split())


def response_cost(usage: DataFrame, prices: DataFrame, model: str = "model", tokens_in: str = "prompt_tokens", tokens_out: str = "completion_tokens") -> DataFrame:
    """Adds ``cost`` from a price table (``model``, ``input_price``, ``output_price`` a token); null where a model has no price."""
    both = usage.join(prices.select(model, "input_price", "output_price"), model, "left")
    return both.withColumn("cost", F.col(tokens_in) * F.col("input_price") + F.col(tokens_out) * F.col("output_price")).drop("input_price", "output_price")
