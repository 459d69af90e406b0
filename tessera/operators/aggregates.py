"""Reductions and statistics.

The first half are aggregate Columns for ``groupBy(...).agg(...)`` or
``agg(...)``: an axis reduction groups by the other axes.  NULL is a masked
element and is skipped; NaN is a value and propagates unless the name starts
with ``nan``.  The second half take and return DataFrames.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN = float("nan")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _d(x) -> Column:
    return _c(x).cast("double")


def _has_nan(x: Column) -> Column:
    return F.coalesce(F.max(F.isnan(x.cast("double"))), F.lit(False))


def _nonempty(x: Column, value: Column, what: str) -> Column:
    """Raises where there is nothing to reduce."""
    return F.when(F.count(x) == 0, F.raise_error(F.lit(f"{what} of no elements"))).otherwise(value)


def sum_(v) -> Column:
    return F.coalesce(F.sum(_c(v)), F.lit(0))


def sum_bool(v) -> Column:
    return F.coalesce(F.sum(_c(v).cast("bigint")), F.lit(0))


def prod(v) -> Column:
    return F.coalesce(F.product(_d(v)), F.lit(1.0))


def min_(v, strict: bool = False) -> Column:
    x = _c(v)
    out = F.when(_has_nan(x), F.lit(NAN)).otherwise(F.min(x))
    return _nonempty(x, out, "min") if strict else out


def max_(v, strict: bool = False) -> Column:
    x = _c(v)
    return _nonempty(x, F.max(x), "max") if strict else F.max(x)


def ptp(v) -> Column:
    return max_(v) - min_(v)


def mean(v) -> Column:
    return F.avg(_d(v))


def var(v, ddof: int = 0) -> Column:
    """NaN where there are no more elements than ddof."""
    x = _d(v)
    n = F.count(x)
    if ddof == 0:
        return F.var_pop(x)
    return F.when(n > ddof, F.var_pop(x) * n / F.when(n > ddof, n - ddof)).otherwise(F.lit(NAN))


def std(v, ddof: int = 0) -> Column:
    return F.sqrt(var(v, ddof))


def median(v) -> Column:
    return F.percentile(_d(v), 0.5)


def quantile(v, q: float) -> Column:
    """Linear interpolation at (n-1)q."""
    if not 0 <= q <= 1:
        raise ValueError("q must lie in [0, 1]")
    return F.percentile(_d(v), q)


def percentile(v, q: float) -> Column:
    if not 0 <= q <= 100:
        raise ValueError("q must lie in [0, 100]")
    return F.percentile(_d(v), q / 100)


def average(v, weights=None) -> Column:
    """Weighted mean; raises where the weights sum to 0."""
    if weights is None:
        return mean(v)
    total = F.sum(F.when(_c(v).isNotNull(), _d(weights)))
    return F.when(total == 0, F.raise_error(F.lit("weights sum to zero")).cast("double")).otherwise(F.sum(_d(v) * _d(weights)) / F.when(total != 0, total))


def all_(v) -> Column:
    return F.coalesce(F.bool_and(_d(v) != 0), F.lit(True))


def any_(v) -> Column:
    return F.coalesce(F.bool_or(_d(v) != 0), F.lit(False))


def count_nonzero(v) -> Column:
    return F.count_if(_d(v) != 0)


def argmax(i, v) -> Column:
    """The first place of the greatest element; the first NaN wins."""
    return F.min_by(_c(i), F.when(_c(v).isNotNull(), F.struct((~F.isnan(_d(v))).alias("n"), (-_d(v)).alias("v"), _c(i).alias("i"))))


def argmin(i, v) -> Column:
    return F.min_by(_c(i), F.when(_c(v).isNotNull(), F.struct((~F.isnan(_d(v))).alias("n"), _d(v).alias("v"), _c(i).alias("i"))))


def trace(i, j, v) -> Column:
    return F.coalesce(F.sum(F.when(_c(i) == _c(j), _c(v))), F.lit(0))


# --- the same without NaN

def without_nan(v) -> Column:
    return F.when(~F.isnan(_d(v)), _c(v))


def nansum(v) -> Column:
    return sum_(without_nan(v))


def nanprod(v) -> Column:
    return prod(without_nan(v))


def nanmin(v) -> Column:
    return _nonempty(without_nan(v), F.min(without_nan(v)), "nanmin")


def nanmax(v) -> Column:
    return _nonempty(without_nan(v), F.max(without_nan(v)), "nanmax")


def nanmean(v) -> Column:
    return F.coalesce(mean(without_nan(v)), F.lit(NAN))


def nanvar(v, ddof: int = 0) -> Column:
    return F.coalesce(var(without_nan(v), ddof), F.lit(NAN))


def nanstd(v, ddof: int = 0) -> Column:
    return F.sqrt(nanvar(v, ddof))


def nanmedian(v) -> Column:
    return F.coalesce(median(without_nan(v)), F.lit(NAN))


def nanquantile(v, q: float) -> Column:
    return F.coalesce(quantile(without_nan(v), q), F.lit(NAN))


def nanpercentile(v, q: float) -> Column:
    return F.coalesce(percentile(without_nan(v), q), F.lit(NAN))


def nanargmin(i, v) -> Column:
    return argmin(i, without_nan(v))


def nanargmax(i, v) -> Column:
    return argmax(i, without_nan(v))


# --- relations between columns

def cov(x, y, ddof: int = 1) -> Column:
    a, b = _d(x), _d(y)
    return F.coalesce(F.covar_samp(a, b) if ddof == 1 else F.covar_pop(a, b), F.lit(NAN))


def corrcoef(x, y) -> Column:
    return F.coalesce(F.corr(_d(x), _d(y)), F.lit(NAN))


def cov_matrix(df: DataFrame, columns: list[str], correlation: bool = False) -> DataFrame:
    """``i, j, v`` over all pairs of columns: one aggregation of all moments, then
    its single row is turned into rows."""
    f = corrcoef if correlation else cov
    cells = [F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), f(x, y).alias("v")) for a, x in enumerate(columns) for b, y in enumerate(columns)]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def linear_fit(x, y) -> Column:
    """struct<slope, intercept> of the least-squares line, from one pass of moments."""
    slope = F.regr_slope(_d(y), _d(x))
    return F.struct(slope.alias("slope"), F.regr_intercept(_d(y), _d(x)).alias("intercept"))


# --- histograms

def _range(df: DataFrame, v: Column, bounds: tuple[float, float] | None) -> tuple[float, float]:
    if bounds is not None:
        return float(bounds[0]), float(bounds[1])
    lo, hi = df.agg(F.min(without_nan(v)), F.max(without_nan(v))).first()
    if lo is None:
        raise ValueError("a histogram of no elements needs a range")
    return float(lo), float(hi)


def bin_number(v, lo: float, hi: float, bins: int) -> Column:
    """The equal bin of v in [lo, hi], the last one closed; NULL outside and for NaN."""
    x = _d(v)
    width = (hi - lo) / bins
    at = F.least(F.floor((x - lo) / width), F.lit(bins - 1))
    return F.when((x >= lo) & (x <= hi) & ~F.isnan(x), at.cast("bigint"))


def histogram_bin_edges(df: DataFrame, v, bins: int = 10, bounds: tuple[float, float] | None = None) -> list[float]:
    lo, hi = _range(df, _c(v), bounds)
    return [lo + (hi - lo) * k / bins for k in range(bins)] + [hi]


def histogram(df: DataFrame, v, bins: int = 10, bounds: tuple[float, float] | None = None, weights=None, density: bool = False) -> DataFrame:
    """``bin, lo, hi, count`` of equal bins; a range without width raises."""
    if bins <= 0:
        raise ValueError("bins must be positive")
    lo, hi = _range(df, _c(v), bounds)
    if lo == hi:
        raise ValueError("a histogram over a range without width")
    one = F.lit(1) if weights is None else _d(weights)
    counts = df.select(bin_number(v, lo, hi, bins).alias("bin"), one.alias("w")).filter("bin IS NOT NULL").groupBy("bin").agg(F.sum("w").alias("count"))
    width = (hi - lo) / bins
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    out = every.join(counts, "bin", "left").select("bin", (lo + F.col("bin") * width).alias("lo"), (lo + (F.col("bin") + 1) * width).alias("hi"), F.coalesce("count", F.lit(0)).alias("count"))
    if not density:
        return out
    total = counts.agg(F.sum("count")).first()[0] or 0
    return out.withColumn("density", F.col("count") / F.lit(float(total or NAN)) / width)


def histogramdd(df: DataFrame, columns: list, bins: list[int], bounds: list[tuple[float, float] | None] | None = None) -> DataFrame:
    """``b0, b1, ..., count`` of the bins that hold rows; a dimension without
    width is widened by a half on both sides."""
    keys = []
    for k, v in enumerate(columns):
        lo, hi = _range(df, _c(v), bounds[k] if bounds else None)
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        keys.append(bin_number(v, lo, hi, bins[k]).alias(f"b{k}"))
    names = [f"b{k}" for k in range(len(columns))]
    return df.select(*keys).dropna().groupBy(*names).agg(F.count("*").alias("count"))


def histogram2d(df: DataFrame, x, y, bins: int | tuple[int, int] = 10, bounds=None) -> DataFrame:
    return histogramdd(df, [x, y], [bins, bins] if isinstance(bins, int) else list(bins), bounds)


def bincount(df: DataFrame, v, weights=None, minlength: int = 0) -> DataFrame:
    """``i, v`` (double) for 0 up to the greatest value or minlength-1; a negative value raises."""
    x = _c(v).cast("bigint")
    x = F.when(x < 0, F.raise_error(F.lit("bincount of a negative value")).cast("bigint")).otherwise(x)
    one = F.lit(1.0) if weights is None else _d(weights)
    counts = df.select(x.alias("i"), one.alias("w")).filter("i IS NOT NULL").groupBy("i").agg(F.sum("w").alias("v"))
    top = counts.agg(F.max("i")).first()[0]
    n = max(minlength, 0 if top is None else top + 1)
    return df.sparkSession.range(n).withColumnRenamed("id", "i").join(counts, "i", "left").select("i", F.coalesce("v", F.lit(0.0)).alias("v"))


def searchsorted(v, keys: list[float], side: str = "left") -> Column:
    """Keys below v (left) or not above it (right); keys are literals in ascending order."""
    x = _d(v)
    below = (lambda k: k < x) if side == "left" else (lambda k: k <= x)
    return F.size(F.filter(F.array(*[F.lit(float(k)) for k in keys]), below)).cast("bigint")


def digitize(v, edges: list[float], right: bool = False) -> Column:
    """right=False counts the edges below v, right=True those not above it."""
    return searchsorted(v, edges, "right" if right else "left")


def interp(x, xp: list[float], fp: list[float], left: float | None = None, right: float | None = None) -> Column:
    """Piecewise-linear through the points, ends held unless given."""
    v = _d(x)
    out = F.lit(float(fp[-1]))
    for k in range(len(xp) - 1, 0, -1):
        slope = (fp[k] - fp[k - 1]) / (xp[k] - xp[k - 1])
        out = F.when(v < xp[k], fp[k - 1] + slope * (v - xp[k - 1])).otherwise(out)
    out = F.when(v < xp[0], F.lit(float(fp[0] if left is None else left))).when(v > xp[-1], F.lit(float(fp[-1] if right is None else right))).otherwise(out)
    return F.when(v.isNull() | F.isnan(v), v).otherwise(out)


def allclose(a: DataFrame, b: DataFrame, on: list[str], v: str = "v", rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """One row ``equal``: same index sets and all elements close."""
    from tessera.functions.ufuncs import isclose

    both = a.select(*on, F.col(v).alias("x"), F.lit(True).alias("in_a")).join(b.select(*on, F.col(v).alias("y"), F.lit(True).alias("in_b")), on, "full")
    fits = F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & F.coalesce(isclose(F.col("x"), F.col("y"), rtol, atol), F.lit(False))
    return both.agg(F.coalesce(F.bool_and(fits), F.lit(True)).alias("equal"))


def array_equal(a: DataFrame, b: DataFrame, on: list[str], v: str = "v") -> DataFrame:
    both = a.select(*on, F.col(v).alias("x"), F.lit(True).alias("in_a")).join(b.select(*on, F.col(v).alias("y"), F.lit(True).alias("in_b")), on, "full")
    fits = F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & F.coalesce(F.col("x") == F.col("y"), F.lit(False))
    return both.agg(F.coalesce(F.bool_and(fits), F.lit(True)).alias("equal"))


def apply_over_axes(df: DataFrame, f, axes: list[str], v: str = "v", keep: list[str] = ()) -> DataFrame:
    """f reduced over the named index columns, one after another."""
    def step(d: DataFrame, axis: str) -> DataFrame:
        rest = [c for c in d.columns if c not in (axis, v)]
        return d.groupBy(*rest).agg(f(F.col(v)).alias(v))

    return reduce(step, axes, df)
