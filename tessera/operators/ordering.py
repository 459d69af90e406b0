"""Operators that depend on order: sorting, ranks, running and sliding windows.

Every one takes the order as columns, as rows have none of their own.  With a
partition key the windows are Spark's.  Without one, a whole column is dealt by
ranges of its order, worked on range by range, and corrected by the ranges
before: two passes instead of one task for all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.storage import settled


def _cols(order) -> list[Column]:
    order = order if isinstance(order, (list, tuple)) else [order]
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _ranged(df: DataFrame, order) -> DataFrame:
    """Rows with ``_part`` (their range) and ``_at`` (their place in it)."""
    cols = _cols(order)
    mid = F.monotonically_increasing_id()
    parts = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    return settled(parts.withColumns({"_part": F.shiftright(mid, 33), "_at": mid.bitwiseAND(F.lit((1 << 33) - 1))}), "ranges")


def with_index(df: DataFrame, order, name: str = "i") -> DataFrame:
    """Rows numbered from 0 in the given order (make it total for a fixed result)."""
    rows = _ranged(df, order)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row per range
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def sort(df: DataFrame, by, name: str = "i") -> DataFrame:
    """Sorted rows with their place; NaN after numbers, NULL last."""
    return with_index(df, [c.asc_nulls_last() for c in _cols(by)], name)


def argsort(df: DataFrame, index: str, by) -> DataFrame:
    """``rank, index``: the old index at each sorted place; ties by index."""
    return with_index(df.select(index, *_cols(by)), [*_cols(by), F.col(index)], "rank").select("rank", index)


def lexsort(df: DataFrame, index: str, keys: list) -> DataFrame:
    """Like argsort over several keys, the last one primary; stable."""
    return with_index(df, [*_cols(keys)[::-1], F.col(index)], "rank").select("rank", index)


def topk(df: DataFrame, by, k: int) -> DataFrame:
    return df.orderBy(*_cols(by)).limit(k)


def partition(df: DataFrame, v: str, kth: int) -> DataFrame:
    """Rows with ``side``: -1 before, 0 at, 1 behind the kth sorted place."""
    ranked = with_index(df, [F.col(v)], "_rank")
    return ranked.withColumn("side", F.signum(F.col("_rank") - kth).cast("int")).drop("_rank")


def within(partition_by: list[str], order) -> Window:
    return Window.partitionBy(*partition_by).orderBy(*_cols(order))


def running(v, aggregate: Callable[[Column], Column], partition_by: list[str], order) -> Column:
    c = F.col(v) if isinstance(v, str) else v
    return aggregate(c).over(within(partition_by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def cumsum(v, partition_by: list[str], order) -> Column:
    return running(v, F.sum, partition_by, order)


def cumprod(v, partition_by: list[str], order) -> Column:
    return running(v, F.product, partition_by, order)


def nancumsum(v, partition_by: list[str], order) -> Column:
    c = F.col(v) if isinstance(v, str) else v
    return cumsum(F.when(F.isnan(c), 0.0).otherwise(c), partition_by, order)


def nancumprod(v, partition_by: list[str], order) -> Column:
    c = F.col(v) if isinstance(v, str) else v
    return cumprod(F.when(F.isnan(c), 1.0).otherwise(c), partition_by, order)


def cumsum_all(df: DataFrame, v: str, order, name: str = "cumsum") -> DataFrame:
    """The running sum over a whole column, range by range."""
    rows = _ranged(df, order)
    sums = rows.groupBy("_part").agg(F.sum(v).alias("_s"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.sum(v).over(inside)).join(F.broadcast(offsets), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_at", "_before")


def diff(v, partition_by: list[str], order, n: int = 1) -> Column:
    """The nth difference, from binomial weights over lags; NULL for the first n rows."""
    c = F.col(v) if isinstance(v, str) else v
    w, out, binomial = within(partition_by, order), None, 1
    for k in range(n + 1):
        term = F.lag(c, k).over(w) * ((-1) ** k * binomial)
        out = term if out is None else out + term
        binomial = binomial * (n - k) // (k + 1)
    return out


ediff1d = diff


def gradient(v, partition_by: list[str], order, spacing: float = 1.0) -> Column:
    """Central differences inside, one-sided at the ends."""
    c, w = F.col(v) if isinstance(v, str) else v, within(partition_by, order)
    before, after = F.lag(c).over(w), F.lead(c).over(w)
    return F.when(before.isNull(), (after - c) / spacing).when(after.isNull(), (c - before) / spacing).otherwise((after - before) / (2 * spacing))


def trapezoids(y, x, partition_by: list[str], order) -> Column:
    """The area between a row and the one before; their sum is the integral."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (y, x))
    w = within(partition_by, order)
    return F.coalesce((a + F.lag(a).over(w)) / 2 * (b - F.lag(b).over(w)), F.lit(0.0))


def unwrap(v, partition_by: list[str], order, period: float = 6.283185307179586) -> Callable[[DataFrame], DataFrame]:
    """A function of a DataFrame that adds ``unwrapped``: jumps of over half a
    period are taken back (a jump of exactly half keeps its sign)."""
    def run(df: DataFrame) -> DataFrame:
        w = within(partition_by, order)
        jump = F.col(v) - F.lag(v).over(w)
        wrapped = F.pmod(jump + period / 2, F.lit(period)) - period / 2
        wrapped = F.when((wrapped == -period / 2) & (jump > 0), period / 2).otherwise(wrapped)
        fix = F.when(F.abs(jump) < period / 2, 0.0).otherwise(wrapped - jump)
        out = df.withColumn("_fix", F.coalesce(fix, F.lit(0.0)))
        return out.withColumn("unwrapped", F.col(v) + F.sum("_fix").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fix")

    return run


def sliding_window_view(v, width: int, partition_by: list[str], order) -> Column:
    """The array of a row and the width-1 after it; NULL where there are fewer."""
    c = F.col(v) if isinstance(v, str) else v
    frame = F.collect_list(c).over(within(partition_by, order).rowsBetween(0, width - 1))
    return F.when(F.size(frame) == width, frame)


def sliding(v, aggregate: Callable[[Column], Column], width: int, partition_by: list[str], order) -> Column:
    c = F.col(v) if isinstance(v, str) else v
    w = within(partition_by, order).rowsBetween(0, width - 1)
    return F.when(F.count(c).over(w) == width, aggregate(c).over(w))


def correlate(v, kernel: list[float], partition_by: list[str], order) -> Column:
    """Valid cross-correlation with a short kernel: a sum over leads."""
    c, w = F.col(v) if isinstance(v, str) else v, within(partition_by, order)
    out = None
    for k, weight in enumerate(kernel):
        term = F.lead(c, k).over(w) * float(weight)
        out = term if out is None else out + term
    return out


def convolve(df: DataFrame, i: str, v: str, kernel: list[float], mode: str = "full") -> DataFrame:
    """``i, v``: each element spreads over len(kernel) places, which are summed."""
    spread = df.select(F.posexplode(F.array(*[F.lit(float(k)) for k in kernel])).alias("_k", "_w"), F.col(i).alias("_i"), F.col(v).alias("_v"))
    full = spread.groupBy((F.col("_i") + F.col("_k")).alias("i")).agg(F.sum(F.col("_v") * F.col("_w")).alias("v"))
    if mode == "full":
        return full
    m = len(kernel)
    if mode == "same":
        first = (m - 1) // 2
        n = df.count()
        return full.filter((F.col("i") >= first) & (F.col("i") < first + n)).select((F.col("i") - first).alias("i"), "v")
    n = df.count()
    return full.filter((F.col("i") >= m - 1) & (F.col("i") < n)).select((F.col("i") - m + 1).alias("i"), "v")


def rank_inverse(v) -> Column:
    """For few distinct values: the place of v among them (0-based dense rank needs
    one sorted table of the distinct values; see sets.unique)."""
    return F.dense_rank().over(Window.orderBy(v)) - 1
