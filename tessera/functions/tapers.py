"""Signal windows (tapers) as functions of a sample's place i in 0..m-1."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.ufuncs import i0


def _taper(i: Column, m: int, weight) -> Column:
    return F.lit(1.0) if m == 1 else weight(i.cast("double"))


def bartlett(i: Column, m: int) -> Column:
    return _taper(i, m, lambda x: 1 - F.abs(2 * x / (m - 1) - 1))


def hanning(i: Column, m: int) -> Column:
    return _taper(i, m, lambda x: 0.5 - 0.5 * F.cos(2 * math.pi * x / (m - 1)))


hann = hanning


def hamming(i: Column, m: int) -> Column:
    return _taper(i, m, lambda x: 0.54 - 0.46 * F.cos(2 * math.pi * x / (m - 1)))


def blackman(i: Column, m: int) -> Column:
    return _taper(i, m, lambda x: 0.42 - 0.5 * F.cos(2 * math.pi * x / (m - 1)) + 0.08 * F.cos(4 * math.pi * x / (m - 1)))


def kaiser(i: Column, m: int, beta: float) -> Column:
    return _taper(i, m, lambda x: i0(beta * F.sqrt(F.greatest(1 - F.pow(2 * x / (m - 1) - 1, 2), F.lit(0.0)))) / i0(F.lit(float(beta))))


def taper(spark: SparkSession, name: str, m: int, *args) -> DataFrame:
    """``i, v`` of a window of m samples."""
    return spark.range(max(m, 0)).select(F.col("id").alias("i"), globals()[name](F.col("id"), m, *args).alias("v"))
