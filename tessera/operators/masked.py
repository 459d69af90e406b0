"""Masked arrays: a NULL is a masked element, so every Spark function already
skips or propagates it; here are the functions that make, fill and report masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import aggregates

# What a masked element is filled with by default.
FILL = {"boolean": True, "bigint": 2**63 - 1, "int": 2**31 - 1, "double": 1e20, "float": 1e20, "string": "N/A"}


def masked_where(condition: Column, v: Column) -> Column:
    return F.when(~F.coalesce(condition, F.lit(False)), v)


def masked_equal(v: Column, x) -> Column:
    return masked_where(v == x, v)


masked_values = masked_equal
masked_object = masked_equal


def masked_not_equal(v: Column, x) -> Column:
    return masked_where(v != x, v)


def masked_greater(v: Column, x) -> Column:
    return masked_where(v > x, v)


def masked_greater_equal(v: Column, x) -> Column:
    return masked_where(v >= x, v)


def masked_less(v: Column, x) -> Column:
    return masked_where(v < x, v)


def masked_less_equal(v: Column, x) -> Column:
    return masked_where(v <= x, v)


def masked_inside(v: Column, a, b) -> Column:
    """Bounds in either order; both are inside."""
    return masked_where((v >= min(a, b)) & (v <= max(a, b)), v)


def masked_outside(v: Column, a, b) -> Column:
    return masked_where((v < min(a, b)) | (v > max(a, b)), v)


def masked_invalid(v: Column) -> Column:
    return masked_where(F.isnan(v) | (F.abs(v) == float("inf")), v)


def fix_invalid(v: Column, fill: float = 1e20) -> Column:
    return F.coalesce(masked_invalid(v), F.lit(fill))


def mask_or(a: Column, b: Column) -> Column:
    return a | b


def getmask(v: Column) -> Column:
    return v.isNull()


getmaskarray = is_masked = getmask


def default_fill_value(kind: str):
    return FILL[kind]


def filled(v: Column, value=None, kind: str = "double") -> Column:
    return F.coalesce(v, F.lit(FILL[kind] if value is None else value))


def compressed(df: DataFrame, v: str) -> DataFrame:
    return df.filter(F.col(v).isNotNull())


def count(v) -> Column:
    return F.count(v)


def count_masked(v: Column) -> Column:
    return F.count_if(v.isNull())


def sum_(v) -> Column:
    return aggregates.sum_(v)


def prod(v) -> Column:
    return aggregates.prod(v)


def mean(v) -> Column:
    """NaN where everything is masked."""
    return F.coalesce(aggregates.mean(v), F.lit(float("nan")))


def var(v, ddof: int = 0) -> Column:
    return F.coalesce(aggregates.var(v, ddof), F.lit(float("nan")))


def std(v, ddof: int = 0) -> Column:
    return F.sqrt(var(v, ddof))


def min_(v) -> Column:
    return aggregates.min_(v, strict=True)


def max_(v) -> Column:
    return aggregates.max_(v, strict=True)


median, average, ptp, argmin, argmax = aggregates.median, aggregates.average, aggregates.ptp, aggregates.argmin, aggregates.argmax


def anom(v: Column, partition_by: list[str]) -> Column:
    """Deviation from the mean of the unmasked elements of the group."""
    return v - F.avg(v).over(Window.partitionBy(*partition_by))


anomalies = anom


def allequal(a: Column, b: Column, fill_value: bool = True) -> Column:
    """Aggregate: all pairs equal; pairs with a masked side count as fill_value."""
    return F.coalesce(F.bool_and(F.coalesce(a == b, F.lit(fill_value))), F.lit(True))


def allclose(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.coalesce(F.bool_and(F.coalesce(F.abs(a - b) <= atol + rtol * F.abs(b), F.lit(True))), F.lit(True))


def runs(df: DataFrame, v: str, order: str, partition_by: list[str], masked: bool) -> DataFrame:
    """``..., start, stop``: runs of masked or unmasked elements of each group, as
    half-open ranges of the order column (whole numbers without gaps)."""
    hit = df.filter(F.col(v).isNull() if masked else F.col(v).isNotNull())
    w = Window.partitionBy(*partition_by).orderBy(order)
    island = hit.withColumn("_g", F.col(order) - F.row_number().over(w))
    return island.groupBy(*partition_by, "_g").agg(F.min(order).alias("start"), (F.max(order) + 1).alias("stop")).drop("_g")


def clump_masked(df: DataFrame, v: str, order: str, partition_by: list[str]) -> DataFrame:
    return runs(df, v, order, partition_by, True)


def clump_unmasked(df: DataFrame, v: str, order: str, partition_by: list[str]) -> DataFrame:
    return runs(df, v, order, partition_by, False)


def compress_rows(df: DataFrame, row: str, v: str) -> DataFrame:
    """Rows (of coordinate form) with a masked element drop out."""
    bad = df.filter(F.col(v).isNull()).select(row).distinct()
    return df.join(bad, row, "left_anti")


compress_cols = compress_rows


def mask_rowcols(df: DataFrame, row: str, column: str, v: str) -> DataFrame:
    """Everything in a row or column with a masked element is masked."""
    bad = df.filter(F.col(v).isNull())
    rows, cols = bad.select(row).distinct().withColumn("_r", F.lit(True)), bad.select(column).distinct().withColumn("_c", F.lit(True))
    out = df.join(rows, row, "left").join(cols, column, "left")
    return out.withColumn(v, F.when(F.col("_r").isNull() & F.col("_c").isNull(), F.col(v))).drop("_r", "_c")


def toflex(df: DataFrame, v: str) -> DataFrame:
    """Data and mask side by side."""
    return df.withColumn("_mask", F.col(v).isNull()).withColumnRenamed("_mask", f"{v}_mask")


torecords = toflex
