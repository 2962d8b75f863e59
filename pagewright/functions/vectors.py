"""Vector expressions over ARRAY<FLOAT|DOUBLE> columns, computed in double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once per row, however often `use` refers to it (expressions are substituted else)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column, least: float = 1e-12) -> Column:
    return let(doubles(v), lambda w: let(F.greatest(norm(w), F.lit(least)), lambda n: F.transform(w, lambda x: x / n)))


def cosine(a: Column, b: Column) -> Column:
    """With its own scaling, for vectors of any length."""
    return dot(a, b) / (norm(a) * norm(b))


def is_unit(v: Column, tolerance: float = 1e-5) -> Column:
    return F.abs(norm(v) - 1) < tolerance
