"""Assertions over DataFrames and Grids for tests of data pipelines: one join and
one aggregation each, so they hold for tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.ufuncs import dbl, isclose, spacing


def _worst(actual: DataFrame, desired: DataFrame, on: list[str], v: str, bad) -> tuple[int, object]:
    both = actual.select(*on, F.col(v).alias("_x"), F.lit(True).alias("_a")).join(desired.select(*on, F.col(v).alias("_y"), F.lit(True).alias("_d")), on, "full")
    wrong = F.col("_a").isNull() | F.col("_d").isNull() | bad(F.col("_x"), F.col("_y"))
    row = both.filter(wrong).agg(F.count("*").alias("n"), F.min(F.struct(*on, "_x", "_y")).alias("first")).first()
    return row.n, row.first


def _raise(n: int, first, what: str) -> None:
    if n:
        raise AssertionError(f"{n} elements are not {what}; the first: {first}")


def assert_array_equal(actual: DataFrame, desired: DataFrame, on: list[str], v: str = "v") -> None:
    _raise(*_worst(actual, desired, on, v, lambda x, y: ~x.eqNullSafe(y)), "equal")


def assert_allclose(actual: DataFrame, desired: DataFrame, on: list[str], v: str = "v", rtol: float = 1e-7, atol: float = 0.0) -> None:
    def bad(x: Column, y: Column) -> Column:
        return ~F.coalesce(isclose(x, y, rtol, atol) | (x == y) | (x.isNull() & y.isNull()), F.lit(False))

    _raise(*_worst(actual, desired, on, v, bad), f"close (rtol {rtol}, atol {atol})")


def assert_array_almost_equal(actual: DataFrame, desired: DataFrame, on: list[str], v: str = "v", decimal: int = 6) -> None:
    _raise(*_worst(actual, desired, on, v, lambda x, y: ~F.coalesce(F.abs(dbl(x) - dbl(y)) < 1.5 * 10.0**-decimal, x.isNull() & y.isNull())), f"equal to {decimal} places")


def assert_array_less(actual: DataFrame, desired: DataFrame, on: list[str], v: str = "v") -> None:
    _raise(*_worst(actual, desired, on, v, lambda x, y: ~F.coalesce(x < y, F.lit(False))), "less")


def assert_array_max_ulp(actual: DataFrame, desired: DataFrame, on: list[str], v: str = "v", maxulp: int = 1) -> None:
    _raise(*_worst(actual, desired, on, v, lambda x, y: F.abs(dbl(x) - dbl(y)) > maxulp * F.abs(spacing(F.greatest(F.abs(dbl(x)), F.abs(dbl(y)))))), f"within {maxulp} ulp")


def assert_raises(kind: type[BaseException], f, *args) -> None:
    try:
        f(*args)
    except kind:
        return
    raise AssertionError(f"{kind.__name__} was not raised")
