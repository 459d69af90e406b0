"""N-dimensional arrays as DataFrames in coordinate form.

A ``Grid`` is a DataFrame with index columns ``i0, i1, ...`` (bigint) and a
value column ``v``, plus its shape on the driver.  Reshaping, slicing and
transposing are arithmetic on index columns (no shuffle); broadcasting is a
join on the axes that are not stretched; reductions group by the other axes.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import aggregates


MAX_BROADCAST = 1_000_000  # elements; sizes are known from shapes


def axes(n: int) -> list[str]:
    return [f"i{k}" for k in range(n)]


def normal_axis(axis: int, ndim: int) -> int:
    if not -ndim <= axis < ndim:
        raise IndexError(f"axis {axis} of an array of {ndim} dimensions")
    return axis % ndim


def broadcast_shapes(*shapes: tuple[int, ...]) -> tuple[int, ...]:
    """Right-aligned; sizes are equal or 1."""
    n = max(map(len, shapes), default=0)
    out = []
    for k in range(n):
        sizes = {s[len(s) - n + k] for s in shapes if len(s) - n + k >= 0} - {1}
        if len(sizes) > 1:
            raise ValueError(f"shapes {shapes} don't broadcast")
        out.append(sizes.pop() if sizes else 1)
    return tuple(out)


def strides(shape: tuple[int, ...], order: str = "C") -> list[int]:
    dims = shape if order == "C" else shape[::-1]
    out = [math.prod(dims[k + 1 :]) for k in range(len(dims))]
    return out if order == "C" else out[::-1]


def ravel_multi_index(index: list[Column], shape: tuple[int, ...], order: str = "C") -> Column:
    return reduce(lambda a, b: a + b, [i * s for i, s in zip(index, strides(shape, order), strict=True)], F.lit(0).cast("bigint"))


def unravel_index(flat: Column, shape: tuple[int, ...], order: str = "C") -> list[Column]:
    return [F.expr("CAST(0 AS BIGINT)") if s == 1 else F.floor(flat / st).cast("bigint") % s for s, st in zip(shape, strides(shape, order), strict=True)]


def _places(n: int) -> Column:
    """0 to n-1, a row each."""
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")) if n > 0 else F.array().cast("array<bigint>"))


class Grid:
    def __init__(self, df: DataFrame, shape: tuple[int, ...]):
        self.df, self.shape = df.select(*axes(len(shape)), "v"), tuple(shape)

    # --- attributes

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def dtype(self) -> str:
        return self.df.schema["v"].dataType.simpleString()

    @property
    def index(self) -> list[Column]:
        return [F.col(a) for a in axes(self.ndim)]

    def __len__(self) -> int:
        return self.shape[0]

    def with_value(self, v: Column) -> Grid:
        return Grid(self.df.withColumn("v", v), self.shape)

    def map(self, f: Callable[[Column], Column]) -> Grid:
        """An element-wise function."""
        return self.with_value(f(F.col("v")))

    def astype(self, kind: str) -> Grid:
        return self.map(lambda v: v.cast(kind))

    def _moved(self, index: list[Column], shape: tuple[int, ...], where: Column | None = None) -> Grid:
        df = self.df if where is None else self.df.filter(where)
        return Grid(df.select(*[c.cast("bigint").alias(a) for c, a in zip(index, axes(len(shape)), strict=True)], "v"), shape)

    # --- shape

    def reshape(self, *shape: int, order: str = "C") -> Grid:
        shape = list(shape)
        if shape.count(-1) == 1:
            rest = -math.prod(shape)
            shape[shape.index(-1)] = self.size // rest if rest else 0
        if math.prod(shape) != self.size:
            raise ValueError(f"{self.shape} has no {tuple(shape)}")
        return self._moved(unravel_index(ravel_multi_index(self.index, self.shape, order), tuple(shape), order), tuple(shape))

    def ravel(self, order: str = "C") -> Grid:
        return self.reshape(self.size, order=order)

    flatten = ravel

    def transpose(self, *order: int) -> Grid:
        order = [normal_axis(a, self.ndim) for a in order] or list(range(self.ndim))[::-1]
        return self._moved([self.index[a] for a in order], tuple(self.shape[a] for a in order))

    permute_dims = transpose

    def swapaxes(self, a: int, b: int) -> Grid:
        order = list(range(self.ndim))
        order[a], order[b] = order[b], order[a]
        return self.transpose(*order)

    def matrix_transpose(self) -> Grid:
        return self.swapaxes(-1, -2)

    def moveaxis(self, source: int, target: int) -> Grid:
        order = [k for k in range(self.ndim) if k != normal_axis(source, self.ndim)]
        order.insert(normal_axis(target, self.ndim), normal_axis(source, self.ndim))
        return self.transpose(*order)

    def rollaxis(self, axis: int, start: int = 0) -> Grid:
        axis = normal_axis(axis, self.ndim)
        return self.moveaxis(axis, start - 1 if axis < start else start)

    def expand_dims(self, axis: int) -> Grid:
        at = normal_axis(axis, self.ndim + 1)
        index, shape = self.index, list(self.shape)
        index.insert(at, F.lit(0))
        shape.insert(at, 1)
        return self._moved(index, tuple(shape))

    def squeeze(self, axis: int | None = None) -> Grid:
        drop = [k for k, s in enumerate(self.shape) if s == 1] if axis is None else [normal_axis(axis, self.ndim)]
        if any(self.shape[k] != 1 for k in drop):
            raise ValueError("only axes of size 1 can be squeezed")
        keep = [k for k in range(self.ndim) if k not in drop]
        return self._moved([self.index[k] for k in keep], tuple(self.shape[k] for k in keep))

    def atleast(self, n: int) -> Grid:
        out = self
        while out.ndim < n:
            out = out.expand_dims(0 if out.ndim != 2 else 2)
        return out

    def broadcast_to(self, *shape: int) -> Grid:
        if broadcast_shapes(self.shape, shape) != tuple(shape):
            raise ValueError(f"{self.shape} doesn't broadcast to {shape}")
        lead = len(shape) - self.ndim
        df = self.df.select(*[F.col(f"i{k}").alias(f"i{k + lead}") for k in range(self.ndim)], "v")
        for k, s in enumerate(shape):
            if k < lead or self.shape[k - lead] != s:
                df = df.withColumn(f"i{k}", _places(s))
        return Grid(df, tuple(shape))

    # --- rearrangement

    def flip(self, axis: int | None = None) -> Grid:
        which = range(self.ndim) if axis is None else [normal_axis(axis, self.ndim)]
        return self._moved([self.shape[k] - 1 - i if k in which else i for k, i in enumerate(self.index)], self.shape)

    def fliplr(self) -> Grid:
        return self.flip(1)

    def flipud(self) -> Grid:
        return self.flip(0)

    def roll(self, shift: int, axis: int | None = None) -> Grid:
        """Without an axis over the flattened array."""
        if axis is None:
            flat = F.pmod(ravel_multi_index(self.index, self.shape) + shift, F.lit(max(self.size, 1)))
            return self._moved(unravel_index(flat, self.shape), self.shape)
        at = normal_axis(axis, self.ndim)
        return self._moved([F.pmod(i + shift, F.lit(self.shape[k])) if k == at else i for k, i in enumerate(self.index)], self.shape)

    def rot90(self, k: int = 1) -> Grid:
        k %= 4
        if k == 0:
            return self
        if k == 2:
            return self.flip(0).flip(1)
        return self.swapaxes(0, 1).flip(0) if k == 1 else self.flip(0).swapaxes(0, 1)

    def tile(self, *reps: int) -> Grid:
        n = max(self.ndim, len(reps))
        base = self.reshape(*([1] * (n - self.ndim) + list(self.shape)))
        reps = [1] * (n - len(reps)) + list(reps)
        df = base.df
        for k, r in enumerate(reps):
            df = df.withColumn("_r", _places(r)).withColumn(f"i{k}", F.col(f"i{k}") + F.col("_r") * base.shape[k])
        return Grid(df, tuple(s * r for s, r in zip(base.shape, reps, strict=True)))

    def repeat(self, n: int, axis: int | None = None) -> Grid:
        base = self.ravel() if axis is None else self
        at = normal_axis(axis or 0, base.ndim)
        df = base.df.withColumn("_r", _places(n)).withColumn(f"i{at}", F.col(f"i{at}") * n + F.col("_r"))
        return Grid(df, tuple(s * n if k == at else s for k, s in enumerate(base.shape)))

    def pad(self, before: list[int], after: list[int], mode: str = "constant", value=0) -> Grid:
        """constant, edge, wrap, reflect and symmetric."""
        shape = tuple(b + s + a for b, s, a in zip(before, self.shape, after, strict=True))
        if mode not in ("constant", "edge", "wrap", "reflect", "symmetric"):
            raise ValueError(f"pad mode {mode!r}")
        inner = self._moved([i + b for i, b in zip(self.index, before, strict=True)], shape)
        if mode == "constant":
            return full(self.df.sparkSession, shape, value).overlay(inner)
        every = full(self.df.sparkSession, shape, 0).df.drop("v")
        for k, (b, s) in enumerate(zip(before, self.shape, strict=True)):
            at = F.col(f"i{k}") - b
            folded = {
                "edge": F.greatest(F.lit(0), F.least(F.lit(s - 1), at)),
                "wrap": F.pmod(at, F.lit(s)),
                "reflect": (s - 1) - F.abs(F.pmod(at, F.lit(max(2 * (s - 1), 1))) - (s - 1)) if s > 1 else F.lit(0),
                "symmetric": F.when(F.pmod(at, F.lit(2 * s)) < s, F.pmod(at, F.lit(2 * s))).otherwise(2 * s - 1 - F.pmod(at, F.lit(2 * s))),
            }[mode]
            every = every.withColumn(f"s{k}", folded.cast("bigint"))
        source = self.df.select(*[F.col(a).alias(f"s{k}") for k, a in enumerate(axes(self.ndim))], "v")
        return Grid(every.join(source, [f"s{k}" for k in range(self.ndim)]), shape)

    def overlay(self, other: Grid) -> Grid:
        """This grid with the elements of another put over its own."""
        over = other.df.withColumnRenamed("v", "_new").withColumn("_hit", F.lit(True))
        return Grid(self.df.join(over, axes(self.ndim), "left").withColumn("v", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("v"))), self.shape)

    put = overlay

    # --- indexing

    def __getitem__(self, key) -> Grid:
        """Integers, slices (any step), ``...`` and None."""
        key = key if isinstance(key, tuple) else (key,)
        if Ellipsis in key:
            at = key.index(Ellipsis)
            fill = self.ndim - sum(k is not None and k is not Ellipsis for k in key)
            key = (*key[:at], *[slice(None)] * fill, *key[at + 1 :])
        key = (*key, *[slice(None)] * (self.ndim - sum(k is not None for k in key)))
        index, shape, where, axis = [], [], F.lit(True), 0
        for k in key:
            if k is None:
                index.append(F.lit(0))
                shape.append(1)
                continue
            i, n = self.index[axis], self.shape[axis]
            if isinstance(k, int):
                if not -n <= k < n:
                    raise IndexError(f"{k} on an axis of size {n}")
                where = where & (i == k % n)
            else:
                places = range(*k.indices(n))
                lo, hi = (min(places), max(places)) if len(places) else (0, -1)
                where = where & (i >= lo) & (i <= hi) & (F.pmod(i - places.start, F.lit(abs(places.step))) == 0)
                index.append(((i - places.start) / places.step).cast("bigint"))
                shape.append(len(places))
            axis += 1
        return self._moved(index, tuple(shape), where)

    def take(self, places: list[int] | DataFrame, axis: int = 0) -> Grid:
        """Elements along an axis at given places: a join with a table ``i, place``
        (a list becomes one)."""
        at = normal_axis(axis, self.ndim)
        if isinstance(places, list):
            n = self.shape[at]
            if any(not -n <= p < n for p in places):
                raise IndexError("place out of range")
            spark, m = self.df.sparkSession, len(places)
            table = spark.createDataFrame([(i, p % n) for i, p in enumerate(places)], "i bigint, place bigint")
        else:
            table, m = places, places.count()
        df = self.df.join(table, self.df[f"i{at}"] == table["place"]).drop(f"i{at}", "place").withColumnRenamed("i", f"i{at}")
        return Grid(df, tuple(m if k == at else s for k, s in enumerate(self.shape)))

    def take_along_axis(self, places: Grid, axis: int) -> Grid:
        at = normal_axis(axis, self.ndim)
        rest = [a for k, a in enumerate(axes(self.ndim)) if k != at]
        want = places.df.withColumnRenamed("v", "_p")
        have = self.df.withColumnRenamed(f"i{at}", "_p")
        return Grid(want.join(have, [*rest, "_p"]), places.shape)

    def put_along_axis(self, places: Grid, values: Grid, axis: int) -> Grid:
        at = normal_axis(axis, self.ndim)
        moved = places.df.withColumnRenamed("v", "_p").join(values.df, axes(self.ndim)).drop(f"i{at}").withColumnRenamed("_p", f"i{at}")
        return self.overlay(Grid(moved, self.shape))

    def compress(self, condition: list[bool], axis: int = 0) -> Grid:
        return self.take([k for k, c in enumerate(condition) if c], axis)

    def delete(self, places: list[int], axis: int = 0) -> Grid:
        n = self.shape[normal_axis(axis, self.ndim)]
        gone = {p % n for p in places}
        return self.take([k for k in range(n) if k not in gone], axis)

    def insert(self, place: int, values: Grid, axis: int = 0) -> Grid:
        key = [slice(None)] * self.ndim
        at = normal_axis(axis, self.ndim)
        head, tail = list(key), list(key)
        head[at], tail[at] = slice(0, place), slice(place, None)
        return concatenate([self[tuple(head)], values, self[tuple(tail)]], at)

    def append(self, values: Grid, axis: int | None = None) -> Grid:
        return concatenate([self.ravel(), values.ravel()], 0) if axis is None else concatenate([self, values], axis)

    def resize(self, *shape: int) -> Grid:
        """The elements over again until the shape is full."""
        n, need = self.size, math.prod(shape)
        flat = self.ravel().tile(-(-need // n))[:need]
        return flat.reshape(*shape)

    def diagonal(self, k: int = 0) -> Grid:
        a, b = self.shape[:2]
        n = max(0, min(a, b - k) if k >= 0 else min(a + k, b))
        rest = self.index[2:]
        return self._moved([*rest, F.least(self.index[0], self.index[1])], (*self.shape[2:], n), self.index[1] - self.index[0] == k)

    def diag(self, k: int = 0) -> Grid:
        """A diagonal matrix from a vector, the diagonal of a matrix."""
        if self.ndim == 2:
            return self.diagonal(k)
        n = self.shape[0] + abs(k)
        moved = self._moved([self.index[0] + max(-k, 0), self.index[0] + max(k, 0)], (n, n))
        return full(self.df.sparkSession, (n, n), 0).astype(self.dtype).overlay(moved)

    diagflat = diag

    def fill_diagonal(self, value) -> Grid:
        return self.with_value(F.when(reduce(lambda a, b: a & b, [i == self.index[0] for i in self.index]), F.lit(value)).otherwise(F.col("v")))

    def tril(self, k: int = 0) -> Grid:
        return self.with_value(F.when(self.index[-1] - self.index[-2] <= k, F.col("v")).otherwise(F.lit(0)))

    def triu(self, k: int = 0) -> Grid:
        return self.with_value(F.when(self.index[-1] - self.index[-2] >= k, F.col("v")).otherwise(F.lit(0)))

    def nonzero(self) -> DataFrame:
        return self.df.filter("v <> 0").select(*axes(self.ndim))

    argwhere = nonzero

    def flatnonzero(self) -> DataFrame:
        return self.ravel().nonzero()

    def trim_zeros(self) -> Grid:
        lo, hi = self.df.filter("v <> 0").agg(F.min("i0"), F.max("i0")).first()
        return self[0:0] if lo is None else self[lo : hi + 1]

    def vander(self, n: int | None = None, increasing: bool = False) -> Grid:
        n = self.shape[0] if n is None else n
        k = _places(n)
        df = self.df.withColumn("i1", k).withColumn("v", F.pow("v", F.col("i1") if increasing else n - 1 - F.col("i1")))
        return Grid(df, (self.shape[0], n))

    def array_split(self, sections: int | list[int], axis: int = 0) -> list[Grid]:
        """A number of parts, the first ones one longer, or the places to cut at."""
        at = normal_axis(axis, self.ndim)
        n = self.shape[at]
        if isinstance(sections, int):
            cuts = [0]
            for k in range(sections):
                cuts.append(cuts[-1] + n // sections + (k < n % sections))
        else:
            cuts = [0, *sections, n]
        key = [slice(None)] * self.ndim
        return [self[tuple([*key[:at], slice(a, b), *key[at + 1 :]])] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def split(self, sections: int | list[int], axis: int = 0) -> list[Grid]:
        if isinstance(sections, int) and self.shape[normal_axis(axis, self.ndim)] % sections:
            raise ValueError("the axis doesn't divide into equal parts")
        return self.array_split(sections, axis)

    def hsplit(self, sections) -> list[Grid]:
        return self.split(sections, 1 if self.ndim > 1 else 0)

    def vsplit(self, sections) -> list[Grid]:
        return self.split(sections, 0)

    def dsplit(self, sections) -> list[Grid]:
        return self.split(sections, 2)

    def unstack(self, axis: int = 0) -> list[Grid]:
        at = normal_axis(axis, self.ndim)
        key = [slice(None)] * self.ndim
        return [self[tuple([*key[:at], k, *key[at + 1 :]])] for k in range(self.shape[at])]

    def sliding_window_view(self, width: int) -> Grid:
        """Of a vector: (n-width+1) x width."""
        n = self.shape[0] - width + 1
        df = self.df.withColumn("i1", _places(width)).withColumn("i0", F.col("i0") - F.col("i1"))
        return Grid(df.filter((F.col("i0") >= 0) & (F.col("i0") < n)), (n, width))

    # --- arithmetic

    def combine(self, other: Grid, f: Callable[[Column, Column], Column]) -> Grid:
        """Element by element with broadcasting: one join on the axes both have in full."""
        shape = broadcast_shapes(self.shape, other.shape)
        n = len(shape)

        def view(g: Grid, name: str) -> tuple[DataFrame, list[str]]:
            lead = n - g.ndim
            own = [k for k in range(n) if k >= lead and (g.shape[k - lead] != 1 or shape[k] == 1)]
            return g.df.select(*[F.col(f"i{k - lead}").alias(f"i{k}") for k in own], F.col("v").alias(name)), [f"i{k}" for k in own]

        (a, x), (b, y) = view(self, "_a"), view(other, "_b")
        shared = [k for k in x if k in y]
        if shared:
            joined = a.join(b, shared)
        else:  # one side is a single element, or an outer combination was asked for
            small, large = (b, a) if other.size <= self.size else (a, b)
            joined = large.crossJoin(F.broadcast(small) if min(self.size, other.size) <= MAX_BROADCAST else small)
        return Grid(joined.withColumn("v", f(F.col("_a"), F.col("_b"))), shape)

    def _op(self, other, f) -> Grid:
        return self.combine(other, f) if isinstance(other, Grid) else self.map(lambda v: f(v, F.lit(other)))

    def __add__(self, other):
        return self._op(other, lambda a, b: a + b)

    def __sub__(self, other):
        return self._op(other, lambda a, b: a - b)

    def __mul__(self, other):
        return self._op(other, lambda a, b: a * b)

    def __truediv__(self, other):
        from tessera.functions.ufuncs import divide

        return self._op(other, divide)

    def __matmul__(self, other):
        from tessera.operators.linalg import matmul

        return matmul(self, other)

    def __neg__(self):
        return self.map(lambda v: -v)

    # --- reductions

    def reduce(self, f: Callable, axis: int | tuple[int, ...] | None = None, keepdims: bool = False) -> Grid:
        """f is an aggregate of the value column, such as those in ``aggregates``."""
        gone = range(self.ndim) if axis is None else [normal_axis(a, self.ndim) for a in (axis if isinstance(axis, tuple) else (axis,))]
        keep = [k for k in range(self.ndim) if k not in gone]
        out = self.df.groupBy(*[f"i{k}" for k in keep]).agg(f(F.col("v")).alias("v"))
        if keepdims:
            for k in gone:
                out = out.withColumn(f"i{k}", F.lit(0).cast("bigint"))
            return Grid(out, tuple(1 if k in gone else s for k, s in enumerate(self.shape)))
        return Grid(out.select(*[F.col(f"i{k}").alias(f"i{n}") for n, k in enumerate(keep)], "v"), tuple(self.shape[k] for k in keep))

    def sum(self, axis=None, keepdims=False):
        return self.reduce(aggregates.sum_, axis, keepdims)

    def prod(self, axis=None, keepdims=False):
        return self.reduce(aggregates.prod, axis, keepdims)

    def mean(self, axis=None, keepdims=False):
        return self.reduce(aggregates.mean, axis, keepdims)

    def var(self, axis=None, ddof=0, keepdims=False):
        return self.reduce(lambda v: aggregates.var(v, ddof), axis, keepdims)

    def std(self, axis=None, ddof=0, keepdims=False):
        return self.reduce(lambda v: aggregates.std(v, ddof), axis, keepdims)

    def min(self, axis=None, keepdims=False):
        return self.reduce(aggregates.min_, axis, keepdims)

    def max(self, axis=None, keepdims=False):
        return self.reduce(aggregates.max_, axis, keepdims)

    def ptp(self, axis=None, keepdims=False):
        return self.reduce(aggregates.ptp, axis, keepdims)

    def median(self, axis=None, keepdims=False):
        return self.reduce(aggregates.median, axis, keepdims)

    def all(self, axis=None, keepdims=False):
        return self.reduce(aggregates.all_, axis, keepdims)

    def any(self, axis=None, keepdims=False):
        return self.reduce(aggregates.any_, axis, keepdims)

    def argmax(self, axis: int) -> Grid:
        at = normal_axis(axis, self.ndim)
        return self.reduce(lambda v: aggregates.argmax(F.col(f"i{at}"), v), axis)

    def argmin(self, axis: int) -> Grid:
        at = normal_axis(axis, self.ndim)
        return self.reduce(lambda v: aggregates.argmin(F.col(f"i{at}"), v), axis)

    def trace(self, k: int = 0) -> Grid:
        return self.diagonal(k).sum(-1)

    def cumsum(self, axis: int) -> Grid:
        from tessera.operators.ordering import cumsum

        at = normal_axis(axis, self.ndim)
        return self.with_value(cumsum("v", [a for k, a in enumerate(axes(self.ndim)) if k != at], f"i{at}"))

    def cumprod(self, axis: int) -> Grid:
        from tessera.operators.ordering import cumprod

        at = normal_axis(axis, self.ndim)
        return self.with_value(cumprod("v", [a for k, a in enumerate(axes(self.ndim)) if k != at], f"i{at}"))

    def sort(self, axis: int = -1) -> Grid:
        from pyspark.sql import Window

        at = normal_axis(axis, self.ndim)
        w = Window.partitionBy(*[a for k, a in enumerate(axes(self.ndim)) if k != at]).orderBy(F.col("v").asc_nulls_last())
        return Grid(self.df.withColumn(f"i{at}", (F.row_number().over(w) - 1).cast("bigint")), self.shape)

    def apply_along_axis(self, f: Callable[[Column], Column], axis: int) -> Grid:
        """f maps the array of values along an axis to an array or a scalar Column."""
        at = normal_axis(axis, self.ndim)
        rest = [a for k, a in enumerate(axes(self.ndim)) if k != at]
        lines = self.df.groupBy(*rest).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(f"i{at}").alias("i"), "v"))), lambda s: s["v"]).alias("_line"))
        out = lines.withColumn("_out", f(F.col("_line")))
        if out.schema["_out"].dataType.typeName() == "array":
            spread = out.select(*rest, F.posexplode("_out").alias("_p", "v")).withColumnRenamed("_p", f"i{at}")
            n = out.select(F.max(F.size("_out"))).first()[0] or 0
            return Grid(spread, tuple(n if k == at else s for k, s in enumerate(self.shape)))
        return Grid(out.select(*[F.col(a).alias(f"i{k}") for k, a in enumerate(rest)], F.col("_out").alias("v")), tuple(s for k, s in enumerate(self.shape) if k != at))

    # --- results on the driver

    def to_numpy(self):
        import numpy as np

        rows = self.df.collect()
        kind = type(rows[0]["v"]) if rows else float
        out = np.zeros(self.shape, dtype=kind if kind in (int, float, bool) else object)
        for r in rows:
            out[tuple(r[a] for a in axes(self.ndim))] = r["v"]
        return out

    def tolist(self) -> list:
        return self.to_numpy().ravel().tolist()

    def tobytes(self) -> bytes:
        return self.to_numpy().tobytes()

    def item(self):
        if self.size != 1:
            raise ValueError("item of more than one element")
        return self.df.first()["v"]


# --- creation

def from_flat(spark: SparkSession, values: DataFrame | Column, shape: tuple[int, ...]) -> Grid:
    """From a table ``i, v`` of the flat array, or a value Column of the flat index ``id``."""
    if isinstance(values, Column):
        values = spark.range(math.prod(shape)).withColumn("v", values).withColumnRenamed("id", "i")
    return Grid(values.select(*[c.cast("bigint").alias(a) for c, a in zip(unravel_index(F.col("i"), shape), axes(len(shape)), strict=True)], "v"), shape)


def array(spark: SparkSession, values) -> Grid:
    """From nested lists or anything numpy takes (small)."""
    import numpy as np

    a = np.asarray(values)
    if a.ndim == 0:
        return Grid(spark.createDataFrame([(a.item(),)], ["v"]), ())
    kind = {"b": "boolean", "i": "bigint", "u": "bigint", "f": "double"}.get(a.dtype.kind, "string")
    rows = [(*map(int, at), a[at].item() if hasattr(a[at], "item") else str(a[at])) for at in np.ndindex(*a.shape)]
    return Grid(spark.createDataFrame(rows, ", ".join(f"{x} bigint" for x in axes(a.ndim)) + f", v {kind}"), a.shape)


asarray = asanyarray = ascontiguousarray = asfortranarray = copy = array


def full(spark: SparkSession, shape: tuple[int, ...], value) -> Grid:
    return from_flat(spark, F.lit(value), tuple(shape))


def zeros(spark: SparkSession, shape: tuple[int, ...]) -> Grid:
    return full(spark, shape, 0.0)


def ones(spark: SparkSession, shape: tuple[int, ...]) -> Grid:
    return full(spark, shape, 1.0)


empty = zeros


def full_like(g: Grid, value) -> Grid:
    return g.with_value(F.lit(value))


def zeros_like(g: Grid) -> Grid:
    return full_like(g, 0.0)


def ones_like(g: Grid) -> Grid:
    return full_like(g, 1.0)


empty_like = zeros_like


def arange(spark: SparkSession, start: float, stop: float | None = None, step: float = 1) -> Grid:
    start, stop = (0, start) if stop is None else (start, stop)
    n = max(0, math.ceil((stop - start) / step))
    return from_flat(spark, F.lit(start) + F.col("id") * F.lit(step), (n,))


def linspace(spark: SparkSession, start: float, stop: float, num: int = 50, endpoint: bool = True) -> Grid:
    parts = num - 1 if endpoint else num
    v = F.lit(float(start)) if parts <= 0 else F.lit(float(start)) + F.col("id") * ((stop - start) / parts)
    return from_flat(spark, F.when(F.col("id") == num - 1, F.lit(float(stop))).otherwise(v) if endpoint and num > 1 else v, (num,))


def logspace(spark: SparkSession, start: float, stop: float, num: int = 50, base: float = 10.0) -> Grid:
    return linspace(spark, start, stop, num).map(lambda v: F.pow(F.lit(base), v))


def geomspace(spark: SparkSession, start: float, stop: float, num: int = 50) -> Grid:
    if start == 0 or stop == 0 or (start < 0) != (stop < 0):
        raise ValueError("ends must have one sign and not be 0")
    return logspace(spark, math.log10(abs(start)), math.log10(abs(stop)), num).map(lambda v: v * math.copysign(1, start))


def eye(spark: SparkSession, n: int, m: int | None = None, k: int = 0) -> Grid:
    g = full(spark, (n, m or n), 0.0)
    return g.with_value(F.when(F.col("i1") - F.col("i0") == k, 1.0).otherwise(0.0))


identity = eye


def tri(spark: SparkSession, n: int, m: int | None = None, k: int = 0) -> Grid:
    return full(spark, (n, m or n), 1.0).tril(k)


def fromfunction(spark: SparkSession, f: Callable[..., Column], shape: tuple[int, ...]) -> Grid:
    g = full(spark, shape, 0.0)
    return g.with_value(f(*g.index))


def indices(spark: SparkSession, shape: tuple[int, ...]) -> list[Grid]:
    return [fromfunction(spark, lambda *i, k=k: i[k], shape) for k in range(len(shape))]


def meshgrid(x: Grid, y: Grid) -> tuple[Grid, Grid]:
    shape = (y.shape[0], x.shape[0])
    return x.broadcast_to(*shape), y.expand_dims(1).broadcast_to(*shape)


def mgrid(spark: SparkSession, *ranges: tuple[float, float, float]) -> list[Grid]:
    sizes = tuple(max(0, math.ceil((b - a) / s)) for a, b, s in ranges)
    return [fromfunction(spark, lambda *i, k=k: F.lit(ranges[k][0]) + i[k] * F.lit(ranges[k][2]), sizes) for k in range(len(ranges))]


def ogrid(spark: SparkSession, *ranges: tuple[float, float, float]) -> list[Grid]:
    n = len(ranges)
    return [arange(spark, *r).reshape(*[-1 if j == k else 1 for j in range(n)]) for k, r in enumerate(ranges)]


def ix_(*places: list[int]) -> list[tuple[int, ...]]:
    return list(product(*places))


def diag_indices(spark: SparkSession, n: int, ndim: int = 2) -> DataFrame:
    return spark.range(n).select(*[F.col("id").alias(a) for a in axes(ndim)])


def tril_indices(spark: SparkSession, n: int, k: int = 0, m: int | None = None) -> DataFrame:
    return full(spark, (n, m or n), 0).df.filter(F.col("i1") - F.col("i0") <= k).select("i0", "i1")


def triu_indices(spark: SparkSession, n: int, k: int = 0, m: int | None = None) -> DataFrame:
    return full(spark, (n, m or n), 0).df.filter(F.col("i1") - F.col("i0") >= k).select("i0", "i1")


# --- joining

def concatenate(parts: list[Grid], axis: int = 0) -> Grid:
    at = normal_axis(axis, parts[0].ndim)
    first, total, frames = parts[0].shape, 0, []
    for g in parts:
        if g.ndim != len(first) or any(a != b for k, (a, b) in enumerate(zip(g.shape, first, strict=True)) if k != at):
            raise ValueError("shapes differ beside the axis")
        frames.append(g.df.withColumn(f"i{at}", F.col(f"i{at}") + total))
        total += g.shape[at]
    return Grid(reduce(lambda a, b: a.unionByName(b), frames), tuple(total if k == at else s for k, s in enumerate(first)))


concat = concatenate


def stack(parts: list[Grid], axis: int = 0) -> Grid:
    at = normal_axis(axis, parts[0].ndim + 1)
    return concatenate([g.expand_dims(at) for g in parts], at)


def vstack(parts: list[Grid]) -> Grid:
    return concatenate([g.atleast(2) for g in parts], 0)


row_stack = vstack


def hstack(parts: list[Grid]) -> Grid:
    return concatenate(parts, 0 if parts[0].ndim == 1 else 1)


def dstack(parts: list[Grid]) -> Grid:
    return concatenate([g.atleast(2).expand_dims(2) if g.ndim < 3 else g for g in parts], 2)


def column_stack(parts: list[Grid]) -> Grid:
    return concatenate([g.expand_dims(1) if g.ndim == 1 else g for g in parts], 1)


def block(rows: list[list[Grid]]) -> Grid:
    return concatenate([concatenate(r, 1) for r in rows], 0)


def where(condition: Grid, x: Grid, y: Grid) -> Grid:
    """Shapes must be the same."""
    if not condition.shape == x.shape == y.shape:
        raise ValueError("where doesn't broadcast")
    both = x.combine(y, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return condition.combine(both, lambda c, s: F.when(c.cast("boolean"), s["a"]).otherwise(s["b"]))


def broadcast_arrays(*grids: Grid) -> list[Grid]:
    shape = broadcast_shapes(*[g.shape for g in grids])
    return [g.broadcast_to(*shape) for g in grids]
