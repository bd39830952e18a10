"""JSON schemas and callables to Spark types, and a registry of functions."""

from __future__ import annotations

import inspect
import json
import typing
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_JSON = {"integer": T.LongType(), "number": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}
_PYTHON = {int: "integer", float: "number", str: "string", bool: "boolean", list: "array", dict: "object"}


def type_from_json_schema(schema: dict) -> T.DataType:
    kind = schema.get("type", "string")
    if kind == "object":
        if "properties" not in schema:
            return T.MapType(T.StringType(), T.StringType())
        needed = set(schema.get("required", []))
        return T.StructType([T.StructField(k, type_from_json_schema(v), k not in needed or bool(v.get("nullable"))) for k, v in schema["properties"].items()])
    if kind == "array":
        return T.ArrayType(type_from_json_schema(schema.get("items", {})))
    if kind not in _JSON:
        raise ValueError(f"unsupported JSON type {kind!r}")
    return _JSON[kind]


def schema_of_sample(spark: SparkSession, sample: dict) -> T.DataType:
    return T._parse_datatype_string(spark.range(1).select(F.schema_of_json(F.lit(json.dumps(sample)))).first()[0])


def checks(schema: dict, column: Column) -> Column:
    """Whether a value keeps its bounds: minLength, maxLength, minimum, maximum, enum, nullable."""
    ok = F.lit(True)
    for key, test in (("minLength", lambda v: F.length(column) >= v), ("maxLength", lambda v: F.length(column) <= v), ("minimum", lambda v: column >= v), ("maximum", lambda v: column <= v), ("enum", lambda v: column.isin(v))):
        if key in schema:
            ok &= test(schema[key])
    return F.when(column.isNull(), F.lit(bool(schema.get("nullable", True)))).otherwise(F.coalesce(ok, F.lit(False)))


def json_schema_of(f: Callable) -> dict:
    """The JSON schema of a callable's parameters, from its type hints and docstring."""
    hints = typing.get_type_hints(f)
    parameters = inspect.signature(f).parameters
    kind = lambda t: _PYTHON.get(typing.get_origin(t) or t, "string")
    props = {n: {"type": kind(hints.get(n, str))} for n in parameters}
    needed = [n for n, p in parameters.items() if p.default is inspect.Parameter.empty]
    return {"name": f.__name__, "description": (inspect.getdoc(f) or "").split("\n\n")[0], "parameters": {"type": "object", "properties": props, "required": needed}}


class FunctionRegistry:
    """Named Python functions that become SQL functions, in Arrow batches."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.schemas = spark, {}

    def register(self, f: Callable, name: str | None = None) -> Callable:
        import pandas as pd

        hints = typing.get_type_hints(f)
        result = _JSON.get(_PYTHON.get(hints.get("return", str), "string"), T.StringType())

        def run(*columns: pd.Series) -> pd.Series:
            return pd.Series([f(*row) for row in zip(*columns, strict=True)])

        run.__annotations__ = {"columns": pd.Series, "return": pd.Series}
        own = F.pandas_udf(run, result)
        self.spark.udf.register(name or f.__name__, own)
        self.schemas[name or f.__name__] = json_schema_of(f)
        return own


def structured(df: DataFrame, text_col: str, schema: dict, out: str = "parsed") -> DataFrame:
    """A model's JSON answers as typed columns; what doesn't parse is null."""
    return df.withColumn(out, F.from_json(F.col(text_col), type_from_json_schema(schema), {"mode": "PERMISSIVE"}))


def structured_prompt(message: Column, schema: dict) -> Column:
    return F.concat(message, F.lit("\n\nAnswer with one JSON object of this schema and nothing else:\n" + json.dumps(schema, sort_keys=True)))
