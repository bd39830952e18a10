"""What regular expressions can't parse: balanced braces, Python literals, calls, chunks. All run in Arrow batches."""

from __future__ import annotations

import ast
import base64
import hashlib
import operator
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _each(f: Callable, kind: str | T.DataType = "string"):
    """A column function from a function of one value (null stays null)."""

    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else f(v) for v in values], index=values.index, dtype=object)

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return lambda column: F.pandas_udf(run, kind)(column)


def boxed(text: str) -> str | None:
    """The content of the first \\boxed{…}, braces balanced, a character behind a backslash not counted; null if it isn't closed."""
    start = text.find(r"\boxed{")
    if start < 0:
        return None
    depth, out, i = 1, [], start + 7
    while i < len(text):
        c = text[i]
        if c == "\\":
            out.append(text[i : i + 2])
            i += 2
            continue
        depth += (c == "{") - (c == "}")
        if depth == 0:
            return "".join(out).strip()
        out.append(c)
        i += 1
    return None


def literal(kind: type) -> Callable[[str], str | None]:
    """A Python literal of one type in normal form: lists and sets sorted by their text; null if it is another or none."""

    def parse(text: str) -> str | None:
        try:
            value = ast.literal_eval(text.strip())
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return None
        if not isinstance(value, kind) or (kind is list and not isinstance(value, list)):
            return None
        if kind is list:
            return repr(sorted(value, key=str))
        if kind is set:
            return "{" + ", ".join(repr(v) for v in sorted(value, key=str)) + "}" if value else "set()"
        if kind is dict:
            return repr(dict(sorted(value.items(), key=lambda kv: str(kv[0]))))
        return repr(value)

    return parse


def function_call(text: str) -> dict | None:
    """Name, positional and keyword arguments of the first call before ";"; null if there is none."""
    try:
        node = ast.parse(text.split(";")[0].strip(), mode="eval").body
        if not isinstance(node, ast.Call):
            return None
        return {"name": ast.unparse(node.func), "args": [ast.unparse(a) for a in node.args], "kwargs": {k.arg: ast.unparse(k.value) for k in node.keywords if k.arg}}
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def same_call(pair: str, other: str) -> bool:
    """Both parse and have the same name and arguments; two that don't parse aren't the same."""
    a, b = function_call(pair), function_call(other)
    return a is not None and a == b


def calls_in(text: str) -> list[ast.Call]:
    """All calls of a Python text, outer ones first; none if it doesn't parse."""
    try:
        return [n for n in ast.walk(ast.parse(text.strip())) if isinstance(n, ast.Call)]
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []


def api_match(response: str, known: list[str]) -> int | None:
    """Place of the first known API call that a response makes: same function, and every literal argument of the known call stands in it."""
    answer = response.partition("api_call")[2] or response
    answer = answer.partition("api_provider")[0].strip().lstrip("\"'>: ")
    answer = answer[: answer.rfind(")") + 1]
    made = [(ast.unparse(c.func), {ast.unparse(a) for a in c.args} | {ast.unparse(k.value) for k in c.keywords}) for c in calls_in(answer)]
    for i, call in enumerate(known):
        for want in calls_in(call)[:1]:
            needed = {ast.unparse(a) for a in (*want.args, *[k.value for k in want.keywords]) if isinstance(a, ast.Constant)}
            if any(name == ast.unparse(want.func) and needed <= given for name, given in made):
                return i
    return None


def api_match_of(known: list[str]):
    return _each(lambda r: api_match(r, known), "int")


def first_error(question: str, solution: str, verify: Callable[[str, str], bool]) -> int:
    """How many sentences of a solution stand before its first wrong one, found by halving; -1 if the whole verifies."""
    parts = [s.strip() for s in re.split("[.\u3002]", solution) if s.strip()]
    if verify(question, solution):
        return -1
    good, bad = -1, len(parts)  # a prefix of ``good`` sentences verifies, one of ``bad`` doesn't
    while bad - good > 1:
        mid = (good + bad) // 2
        if verify(question, ". ".join(parts[:mid]) + "."):
            good = mid
        else:
            bad = mid
    return bad


def first_error_of(verify: Callable[[str, str], bool]):
    def run(questions: pd.Series, solutions: pd.Series) -> pd.Series:
        return pd.Series([None if q is None or s is None else first_error(q, s, verify) for q, s in zip(questions, solutions, strict=True)], dtype="Int64")

    return F.pandas_udf(run, "long")


#: What an interpreted expression may do.
_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow}
_COMPARED = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.In: lambda a, b: a in b, ast.NotIn: lambda a, b: a not in b}
_CALLABLE = {"abs": abs, "min": min, "max": max, "round": round, "len": len, "sum": sum, "sorted": sorted, "str": str, "int": int, "float": float}
#: Powers beyond this exponent, and texts or lists longer than this, are refused.
MOST_POWER, MOST_LENGTH = 1000, 1_000_000


def interpreted(expression: str, names: dict[str, object]):
    """The value of a Python expression over numbers, texts, lists and a few functions; whatever else it holds raises ValueError.

    Nothing is compiled or imported: the tree is walked node by node.
    """

    def short(value):
        if isinstance(value, str | list | tuple) and len(value) > MOST_LENGTH:
            raise ValueError("a value is too long")
        return value

    def of(node: ast.expr):
        match node:
            case ast.Constant(value=v) if isinstance(v, int | float | str | bool) or v is None:
                return v
            case ast.Name(id=name) if name in names:
                return names[name]
            case ast.List(elts=each) | ast.Tuple(elts=each):
                return [of(e) for e in each]
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                x, y = of(a), of(b)
                if isinstance(op, ast.Pow) and (not isinstance(y, int | float) or abs(y) > MOST_POWER):
                    raise ValueError("a power is too high")
                if isinstance(op, ast.Mult) and any(isinstance(p, str | list) and isinstance(q, int) and len(p) * q > MOST_LENGTH for p, q in ((x, y), (y, x))):
                    raise ValueError("a value would be too long")
                return short(_BINARY[type(op)](x, y))
            case ast.UnaryOp(op=ast.USub(), operand=a):
                return -of(a)
            case ast.UnaryOp(op=ast.Not(), operand=a):
                return not of(a)
            case ast.BoolOp(op=op, values=each):
                value = None
                for e in each:
                    value = of(e)
                    if bool(value) != isinstance(op, ast.And):
                        break
                return value
            case ast.Compare(left=a, ops=ops, comparators=rest) if all(type(o) in _COMPARED for o in ops):
                x = of(a)
                for o, e in zip(ops, rest, strict=True):
                    y = of(e)
                    if not _COMPARED[type(o)](x, y):
                        return False
                    x = y
                return True
            case ast.IfExp(test=t, body=a, orelse=b):
                return of(a) if of(t) else of(b)
            case ast.Subscript(value=a, slice=i) if not isinstance(i, ast.Slice):
                return of(a)[of(i)]
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in _CALLABLE:
                return short(_CALLABLE[name](*[of(x) for x in args]))
        raise ValueError(f"not allowed in an expression: {ast.unparse(node)}")

    try:
        return of(ast.parse(expression.strip(), mode="eval").body)
    except (SyntaxError, RecursionError, MemoryError) as e:
        raise ValueError(f"not an expression: {expression!r}") from e


def interpreted_udf(names: list[str], kind: str):
    """A column function of an expression and the named values; null where the expression fails."""

    def run(expressions: pd.Series, *values: pd.Series) -> pd.Series:
        out = []
        for e, *row in zip(expressions, *values, strict=True):
            try:
                out.append(None if e is None else interpreted(e, dict(zip(names, row, strict=True))))
            except (ValueError, TypeError, ArithmeticError, LookupError):
                out.append(None)
        return pd.Series(out, dtype=object)

    run.__annotations__ = {"expressions": pd.Series, "values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


def blocks(message: str) -> list[dict]:
    """Texts and fenced code blocks in order: (kind, language, content)."""
    out, at = [], 0
    for m in re.finditer(r"```([^\n`]*)\n(.*?)```", message, re.S):
        if message[at : m.start()].strip():
            out.append({"kind": "text", "language": None, "content": message[at : m.start()].strip()})
        out.append({"kind": "code", "language": m[1].strip() or None, "content": m[2].strip()})
        at = m.end()
    if message[at:].strip():
        out.append({"kind": "text", "language": None, "content": message[at:].strip()})
    return out


def char_chunks(text: str, n: int) -> list[str]:
    """Chunks of about n characters, each up to the last full stop or line break between 0.8 n and 1.2 n, or else of n."""
    out, at, low, high = [], 0, int(0.8 * n), int(1.2 * n)
    while at < len(text):
        window_end = min(at + high, len(text))
        cut = max(text.rfind(".", at + low, window_end), text.rfind("\n", at + low, window_end)) + 1
        end = cut if cut > at + low else (min(at + n, len(text)) if window_end >= at + low else window_end)
        out.append(text[at : max(end, at + 1)])
        at = max(end, at + 1)
    return out


def token_chunks(text: str, most: int, count: Callable[[str], int] = lambda line: len(line.split())) -> list[str]:
    """Lines gathered into chunks of ``most`` tokens by the caller's counter; picture lines go, a line that is too long is split by words."""
    out, now, used = [], [], 0
    for line in text.splitlines():
        if re.search(r"!\[.*?\]\(.*?\)|<img\b", line):
            continue
        pieces = [line]
        if count(line) > most:
            words, pieces = line.split(), []
            pieces = [" ".join(words[i : i + most]) for i in range(0, len(words), most)]
        for piece in pieces:
            n = count(piece)
            if now and used + n > most:
                out.append("\n".join(now))
                now, used = [], 0
            now.append(piece)
            used += n
    if now:
        out.append("\n".join(now))
    return [c for c in out if c.strip()]


def title_chunks(elements: list[str], most: int = 500) -> list[str]:
    """Paragraphs gathered under short title-like ones, up to ``most`` characters."""
    out, now = [], ""
    for e in elements:
        title = len(e) < 80 and not e.rstrip().endswith((".", ":", ";", ",")) and e[:1].isupper()
        if now and (title or len(now) + 2 + len(e) > most):
            out.append(now)
            now = ""
        while len(e) > most:
            cut = e.rfind(" ", 0, most)
            cut = cut if cut > 0 else most
            out.append(e[:cut])
            e = e[cut:].lstrip()
        now = f"{now}\n\n{e}" if now else e
    return [*out, now] if now else out


def instances(text: str) -> list[dict]:
    """(input, output) of "Example n / Input: / Output:" sections; without any, one row with the whole as output."""
    found = re.findall(r"Input:\s*(.*?)\s*Output:\s*(.*?)\s*(?=Example\s*\d+|Input:|\Z)", text, re.S)
    return [{"input": a.strip(), "output": b.strip()} for a, b in found] or [{"input": "", "output": text.strip()}]


def class_instances(text: str) -> list[dict]:
    """(input, output) of "Class label: x" sections."""
    return [{"input": b.strip(), "output": a.strip()} for a, b in re.findall(r"Class label:\s*([^\n]*)\n(.*?)(?=Class label:|\Z)", text, re.S)]


def file_name(url: str, default: str = "index", most: int = 255) -> str:
    own = unicodedata.normalize("NFKD", url).encode("ascii", "ignore").decode()
    own = re.sub(r"[^A-Za-z0-9._-]+", "_", own)
    return re.sub(r"_+", "_", own).strip("_.")[:most] or default


def masked(text: str, password: str) -> str:
    """A text combined by XOR with a key stream from a password's SHA-256, in base 64."""
    key = hashlib.sha256(password.encode()).digest()
    return base64.b64encode(bytes(c ^ key[i % len(key)] for i, c in enumerate(text.encode()))).decode()


def unmasked(cipher: str, password: str) -> str | None:
    """A text that was combined by XOR with a key stream from a password's SHA-256."""
    try:
        raw = base64.b64decode(cipher)
        key = hashlib.sha256(password.encode()).digest()
        return bytes(c ^ key[i % len(key)] for i, c in enumerate(raw)).decode()
    except ValueError:
        return None


boxed_udf = _each(boxed)
list_udf, dict_udf, set_udf, tuple_udf = (_each(literal(k)) for k in (list, dict, set, tuple))
call_udf = _each(function_call, "struct<name:string,args:array<string>,kwargs:map<string,string>>")
blocks_udf = _each(blocks, "array<struct<kind:string,language:string,content:string>>")
instances_udf = _each(instances, "array<struct<input:string,output:string>>")
class_instances_udf = _each(class_instances, "array<struct<input:string,output:string>>")
file_name_udf = _each(file_name)


def char_chunks_of(n: int):
    return _each(lambda t: char_chunks(t, n), "array<string>")


def token_chunks_of(most: int = 8192, count: Callable[[str], int] | None = None):
    return _each(lambda t: token_chunks(t, most, count) if count else token_chunks(t, most), "array<string>")


def title_chunks_of(most: int = 500):
    return _each(lambda t: title_chunks([p.strip() for p in re.split(r"\n\s*\n|\n", t) if p.strip()], most), "array<string>")


def masked_by(password: str):
    return _each(lambda t: masked(t, password))


def unmasked_by(password: str):
    return _each(lambda c: unmasked(c, password))


@F.pandas_udf(T.BooleanType())
def same_call_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([x is not None and y is not None and same_call(x, y) for x, y in zip(a, b, strict=True)])
