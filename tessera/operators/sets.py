"""Set operations over columns: distinct values in sorted order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordering import with_index


def _values(df: DataFrame, v: str) -> DataFrame:
    return df.select(F.col(v).alias("v")).distinct()


def unique(df: DataFrame, v: str, index: str | None = None) -> DataFrame:
    """``v, count`` and with an index column ``first``, its least place."""
    more = [F.min(index).alias("first")] if index else []
    return df.groupBy(F.col(v).alias("v")).agg(F.count("*").alias("count"), *more)


unique_counts = unique


def unique_values(df: DataFrame, v: str) -> DataFrame:
    return _values(df, v)


def unique_inverse(df: DataFrame, v: str, name: str = "inverse") -> DataFrame:
    """Each row with the place of its value among the sorted distinct values."""
    places = with_index(_values(df, v), "v", name)
    return df.join(places, df[v].eqNullSafe(places["v"])).drop(places["v"])


def unique_all(df: DataFrame, v: str, index: str) -> DataFrame:
    """``i, v, count, first``: distinct values with their place, count and first index."""
    return with_index(unique(df, v, index), "v", "i")


def union1d(a: DataFrame, x: str, b: DataFrame, y: str) -> DataFrame:
    return _values(a, x).union(_values(b, y)).distinct()


def intersect1d(a: DataFrame, x: str, b: DataFrame, y: str) -> DataFrame:
    return _values(a, x).intersect(_values(b, y))


def setdiff1d(a: DataFrame, x: str, b: DataFrame, y: str) -> DataFrame:
    return _values(a, x).subtract(_values(b, y))


def setxor1d(a: DataFrame, x: str, b: DataFrame, y: str) -> DataFrame:
    left, right = _values(a, x).withColumn("_a", F.lit(1)), _values(b, y).withColumn("_b", F.lit(1))
    return left.join(right, "v", "full").filter("_a IS NULL OR _b IS NULL").select("v")


def isin(df: DataFrame, v: str, tests: DataFrame, w: str, invert: bool = False) -> DataFrame:
    """The rows whose value is (not) among the tests: a semi or anti join."""
    keys = _values(tests, w)
    return df.join(keys, df[v] == keys["v"], "left_anti" if invert else "left_semi")


in1d = isin


def isin_flag(df: DataFrame, v: str, tests: DataFrame, w: str, name: str = "isin") -> DataFrame:
    """All rows with the answer as a column."""
    keys = _values(tests, w).withColumn("_hit", F.lit(True)).withColumnRenamed("v", "_key")
    return df.join(keys, df[v] == keys["_key"], "left").withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_hit", "_key")
