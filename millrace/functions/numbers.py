"""Arithmetic and linear algebra. Rounding is half-even on the decimal text, as Spark's bround does it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def add(a: Column, b: Column) -> Column:
    return a + b


def subtract(a: Column, b: Column) -> Column:
    return a - b


def multiply(a: Column, b: Column, places: int = 2) -> Column:
    return F.bround(a * b, places)


def divide(a: Column, b: Column, places: int = 2) -> Column:
    """Division by zero raises."""
    return F.bround(F.when(b == 0, F.raise_error(F.lit("division by zero")).cast("double")).otherwise(a.cast("double") / b), places)


def rounded(a: Column, places: int = 0) -> Column:
    return F.bround(a, places)


def _matrix(f, kind: str):
    def run(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            try:
                out.append(f(np.array([list(r) for r in v], float)))
            except (np.linalg.LinAlgError, ValueError, TypeError):
                out.append(None)
        return pd.Series(out, dtype=object)

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return lambda column: F.pandas_udf(run, kind)(column)


#: Of a matrix as an array of rows; null where it isn't defined. Symbolic algebra is the caller's.
determinant = _matrix(lambda m: float(np.linalg.det(m)), "double")
inverse = _matrix(lambda m: np.linalg.inv(m).tolist(), "array<array<double>>")
rank = _matrix(lambda m: int(np.linalg.matrix_rank(m)), "int")
#: Null if one isn't real; ``complex_eigenvalues`` gives pairs of real and imaginary part.
eigenvalues = _matrix(lambda m: sorted(x.real.tolist()) if not np.iscomplexobj(x := np.linalg.eigvals(m)) or not x.imag.any() else None, "array<double>")
complex_eigenvalues = _matrix(lambda m: sorted([float(x.real), float(x.imag)] for x in np.linalg.eigvals(m).astype(complex)), "array<array<double>>")
trace = _matrix(lambda m: float(np.trace(m)), "double")
