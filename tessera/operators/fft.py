"""Fourier transforms of columns of arrays (one signal per row) and of whole
columns in coordinate form."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPLEX = "array<struct<re:double,im:double>>"


def _transform(name: str, signal: Column, real_out: bool, n: int | None, norm: str | None, shape: tuple[int, ...] | None = None) -> Column:
    """numpy's transform of each cell; cells of equal length are transformed as one array."""
    f = getattr(np.fft, name)

    @F.arrow_udf("array<double>" if real_out else COMPLEX)
    def run(cells: pa.Array) -> pa.Array:
        size = pc.fill_null(pc.list_value_length(cells), -1).to_numpy()
        flat = cells.flatten()
        if pa.types.is_struct(flat.type):
            re, im = (pc.cast(pc.struct_field(flat, k), pa.float64()).to_numpy(zero_copy_only=False) for k in (0, 1))
            flat = re + 1j * im
        else:
            flat = pc.cast(flat, pa.float64()).to_numpy(zero_copy_only=False)
        start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
        parts, length, rows = [], np.zeros(len(size), np.int64), []
        for own in np.unique(size[size >= 0]).tolist():
            at = np.flatnonzero(size == own)
            x = flat[start[at][:, None] + np.arange(own)]
            if shape is None:
                y = f(x, n=n, norm=norm, axis=-1)
            else:
                y = f(x.reshape(len(at), *shape), axes=tuple(range(1, len(shape) + 1)), norm=norm).reshape(len(at), -1)
            parts.append(y.ravel())
            length[at] = y.shape[1]
            rows.append(at)
        out = np.concatenate(parts) if parts else np.zeros(0)
        values = pa.array(out.real, pa.float64()) if real_out else pa.StructArray.from_arrays([pa.array(np.real(out), pa.float64()), pa.array(np.imag(out), pa.float64())], ["re", "im"])
        rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length[rows])]).astype(np.int32)), values)
        place = np.full(len(size), -1)
        place[rows] = np.arange(len(rows))
        return lists.take(pa.array(np.maximum(place, 0), pa.int64(), mask=place < 0))

    return run(signal)


def fft(x: Column, n: int | None = None, norm: str | None = None) -> Column:
    return _transform("fft", x, False, n, norm)


def ifft(x: Column, n: int | None = None, norm: str | None = None) -> Column:
    return _transform("ifft", x, False, n, norm)


def rfft(x: Column, n: int | None = None, norm: str | None = None) -> Column:
    return _transform("rfft", x, False, n, norm)


def irfft(x: Column, n: int | None = None, norm: str | None = None) -> Column:
    return _transform("irfft", x, True, n, norm)


def hfft(x: Column, n: int | None = None, norm: str | None = None) -> Column:
    return _transform("hfft", x, True, n, norm)


def ihfft(x: Column, n: int | None = None, norm: str | None = None) -> Column:
    return _transform("ihfft", x, False, n, norm)


def fftn(x: Column, shape: tuple[int, ...], norm: str | None = None) -> Column:
    """Of arrays that hold a grid of the given shape in row-major order."""
    return _transform("fftn", x, False, None, norm, shape)


def ifftn(x: Column, shape: tuple[int, ...], norm: str | None = None) -> Column:
    return _transform("ifftn", x, False, None, norm, shape)


fft2, ifft2 = fftn, ifftn


def rfftn(x: Column, shape: tuple[int, ...], norm: str | None = None) -> Column:
    return _transform("rfftn", x, False, None, norm, shape)


def irfftn(x: Column, shape: tuple[int, ...], norm: str | None = None) -> Column:
    """shape is that of the half spectrum."""
    return _transform("irfftn", x, True, None, norm, shape)


rfft2, irfft2 = rfftn, irfftn


def dft(x: Column) -> Column:
    """The transform by its definition, inside the JVM: for short arrays."""
    n = F.size(x)
    places = F.sequence(F.lit(0), n - 1)

    def bin_(k: Column) -> Column:
        angle = lambda j: -2 * math.pi * k * j / n
        zero = F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
        terms = F.transform(x, lambda v, j: F.struct((v * F.cos(angle(j))).alias("re"), (v * F.sin(angle(j))).alias("im")))
        return F.aggregate(terms, zero, lambda s, t: F.struct((s["re"] + t["re"]).alias("re"), (s["im"] + t["im"]).alias("im")))

    return F.transform(places, bin_)


def goertzel(df: DataFrame, i: str, v: str, n: int, bins: list[int]) -> DataFrame:
    """``k, re, im`` of chosen bins of one long signal: one aggregation, no sort."""
    cells = []
    for k in bins:
        angle = F.pmod(F.col(i) * k, F.lit(n)) * (-2 * math.pi / n)
        cells.append(F.struct(F.lit(k).alias("k"), F.sum(F.col(v) * F.cos(angle)).alias("re"), F.sum(F.col(v) * F.sin(angle)).alias("im")))
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def fft_long(df: DataFrame, i: str, v: str, n: int) -> DataFrame:
    """``i, re, im``: the transform of one signal of n rows by the four-step method.

    n splits into rows x cols; columns are transformed, turned by twiddle
    factors, and rows are transformed, each in groups of about sqrt(n)."""
    cols = max(d for d in range(1, math.isqrt(n) + 1) if n % d == 0)
    rows = n // cols

    def step(pdf: pd.DataFrame, size: int, key: str, turn: bool) -> pd.DataFrame:
        x = np.zeros(size, complex)
        x[pdf["j"].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        y = np.fft.fft(x)
        k = np.arange(size)
        if turn:
            y = y * np.exp(-2j * np.pi * k * int(pdf[key].iloc[0]) / n)
        return pd.DataFrame({"g": int(pdf[key].iloc[0]), "j": k, "re": y.real, "im": y.imag})

    start = df.select((F.col(i) % cols).alias("g"), F.floor(F.col(i) / cols).cast("bigint").alias("j"), F.col(v).cast("double").alias("re"), F.lit(0.0).alias("im"))
    schema = "g bigint, j bigint, re double, im double"
    first = start.groupBy("g").applyInPandas(lambda p: step(p, rows, "g", True), schema)
    second = first.select(F.col("j").alias("g"), F.col("g").alias("j"), "re", "im").groupBy("g").applyInPandas(lambda p: step(p, cols, "g", False), schema)
    return second.select((F.col("g") + F.col("j") * rows).alias("i"), "re", "im")


def fftfreq(i: Column, n: int, d: float = 1.0) -> Column:
    return F.when(i < (n + 1) // 2, i).otherwise(i - n) / (n * d)


def rfftfreq(i: Column, n: int, d: float = 1.0) -> Column:
    return i / (n * d)


def fftshift(x: Column) -> Column:
    n = F.size(x)
    h = F.ceil(n / 2).cast("int")
    return F.concat(F.slice(x, h + 1, n - h), F.slice(x, F.lit(1), h))


def ifftshift(x: Column) -> Column:
    n = F.size(x)
    h = F.floor(n / 2).cast("int")
    return F.concat(F.slice(x, h + 1, n - h), F.slice(x, F.lit(1), h))


def power_spectrum(x: Column) -> Column:
    return F.transform(rfft(x), lambda z: z["re"] * z["re"] + z["im"] * z["im"])
