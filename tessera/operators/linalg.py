"""Linear algebra.

Products are contractions: a join on the shared index and a sum over the rest,
for matrices of any size in coordinate form.  ``matmul`` tiles its operands, so
that the join is between blocks and a block's product is one dense call.
Decompositions go through the Gram matrix where one side is long and thin (one
aggregation over all rows, then a small problem on the driver), or row by row
over arrays of small matrices.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.grid import Grid, array, normal_axis

BLOCK = 256
MAX_LOCAL = 4_000_000  # elements of a matrix that may be brought to the driver


# --- contractions

def einsum(spec: str, *grids: Grid) -> Grid:
    """``ij,jk->ik`` over coordinate arrays; the ``->`` is asked for.

    Operands are joined two at a time on the letters they share; letters that
    neither the result nor a later operand needs are summed right away.
    """
    if "->" not in spec or "..." in spec:
        raise ValueError("einsum needs an explicit result and no ellipsis")
    left, out = spec.replace(" ", "").split("->")
    terms = left.split(",")
    if len(terms) != len(grids):
        raise ValueError("as many operands as terms are needed")
    sizes: dict[str, int] = {}
    for t, g in zip(terms, grids, strict=True):
        if len(t) != g.ndim:
            raise ValueError(f"term {t} for an array of {g.ndim} dimensions")
        for c, s in zip(t, g.shape, strict=True):
            if sizes.setdefault(c, s) != s:
                raise ValueError(f"sizes of {c} differ")

    def load(term: str, g: Grid) -> tuple[DataFrame, str]:
        df, kept = g.df, ""
        for k, c in enumerate(term):
            if c in kept:  # a repeated letter is a diagonal
                df = df.filter(F.col(f"i{k}") == F.col(f"_{c}")).drop(f"i{k}")
            else:
                df, kept = df.withColumnRenamed(f"i{k}", f"_{c}"), kept + c
        return df, kept

    frame, have = load(terms[0], grids[0])
    for n in range(1, len(terms)):
        other, letters = load(terms[n], grids[n])
        shared = [f"_{c}" for c in have if c in letters]
        other = other.withColumnRenamed("v", "_w")
        frame = (frame.join(other, shared) if shared else frame.crossJoin(other)).withColumn("v", F.col("v") * F.col("_w")).drop("_w")
        have += "".join(c for c in letters if c not in have)
        needed = set(out).union(*terms[n + 1 :])
        keep = "".join(c for c in have if c in needed)
        if keep != have:
            frame, have = frame.groupBy(*[f"_{c}" for c in keep]).agg(F.sum("v").alias("v")), keep
    frame = frame.groupBy(*[f"_{c}" for c in out]).agg(F.sum("v").alias("v")) if set(have) != set(out) else frame
    return Grid(frame.select(*[F.col(f"_{c}").alias(f"i{k}") for k, c in enumerate(out)], "v"), tuple(sizes[c] for c in out))


def einsum_path(spec: str, *grids: Grid) -> list[tuple[int, int]]:
    return [(0, k) for k in range(1, len(grids))]


def _blocks(g: Grid, rows: str, cols: str) -> DataFrame:
    """Tiles of at most BLOCK x BLOCK elements, one row each."""
    b = F.lit(BLOCK)
    cell = F.struct((F.col("i0") % b).cast("int").alias("r"), (F.col("i1") % b).cast("int").alias("c"), F.col("v").cast("double").alias("v"))
    return g.df.groupBy(F.floor(F.col("i0") / b).alias(rows), F.floor(F.col("i1") / b).alias(cols)).agg(F.collect_list(cell).alias("cells"))


def _dense(cells) -> np.ndarray:
    out = np.zeros((BLOCK, BLOCK))
    for c in cells:
        out[c["r"], c["c"]] = c["v"]
    return out


def matmul(a: Grid, b: Grid) -> Grid:
    """Matrix product of two matrices (vectors are rows or columns, as usual)."""
    if a.ndim == 1 and b.ndim == 1:
        return einsum("i,i->", a, b)
    if a.ndim == 1:
        return einsum("j,jk->k", a, b)
    if b.ndim == 1:
        return einsum("ij,j->i", a, b)
    if a.ndim != 2 or b.ndim != 2:
        lead = "abcdefgh"[: max(a.ndim, b.ndim) - 2]
        return einsum(f"{lead[-(a.ndim - 2) :] if a.ndim > 2 else ''}ij,{lead[-(b.ndim - 2) :] if b.ndim > 2 else ''}jk->{lead}ik", a, b)
    if a.shape[1] != b.shape[0]:
        raise ValueError(f"shapes {a.shape} and {b.shape} don't fit")
    if max(*a.shape, *b.shape) <= 2 * BLOCK:
        return einsum("ij,jk->ik", a, b)
    left, right = _blocks(a, "bi", "bk").withColumnRenamed("cells", "x"), _blocks(b, "bk", "bj").withColumnRenamed("cells", "y")

    def tiles(batches):
        for pdf in batches:
            for bi, bj, x, y in zip(pdf["bi"], pdf["bj"], pdf["x"], pdf["y"], strict=True):
                p = _dense(x) @ _dense(y)
                r, c = np.nonzero(p)
                yield pd.DataFrame({"i0": bi * BLOCK + r, "i1": bj * BLOCK + c, "v": p[r, c]})

    parts = left.join(right, "bk").select("bi", "bj", "x", "y").mapInPandas(tiles, "i0 bigint, i1 bigint, v double")
    return Grid(parts.groupBy("i0", "i1").agg(F.sum("v").alias("v")), (a.shape[0], b.shape[1]))


def dot(a: Grid, b: Grid) -> Grid:
    if a.ndim <= 2 and b.ndim <= 2:
        return matmul(a, b)
    return tensordot(a, b, ([a.ndim - 1], [max(b.ndim - 2, 0)]))


def tensordot(a: Grid, b: Grid, over: int | tuple[list[int], list[int]] = 2) -> Grid:
    x, y = (list(range(a.ndim - over, a.ndim)), list(range(over))) if isinstance(over, int) else over
    x, y = [normal_axis(k, a.ndim) for k in x], [normal_axis(k, b.ndim) for k in y]
    left = [chr(97 + k) for k in range(a.ndim)]
    right = [chr(97 + a.ndim + k) for k in range(b.ndim)]
    for i, j in zip(x, y, strict=True):
        right[j] = left[i]
    out = [c for k, c in enumerate(left) if k not in x] + [c for k, c in enumerate(right) if k not in y]
    return einsum(f"{''.join(left)},{''.join(right)}->{''.join(out)}", a, b)


def inner(a: Grid, b: Grid) -> Grid:
    return tensordot(a, b, ([a.ndim - 1], [b.ndim - 1]))


def outer(a: Grid, b: Grid) -> Grid:
    return einsum("i,j->ij", a.ravel(), b.ravel())


def vdot(a: Grid, b: Grid) -> Grid:
    return einsum("i,i->", a.ravel(), b.ravel())


vecdot = vdot


def matvec(a: Grid, x: Grid) -> Grid:
    return matmul(a, x)


def vecmat(x: Grid, a: Grid) -> Grid:
    return matmul(x, a)


def kron(a: Grid, b: Grid) -> Grid:
    p, q = b.shape
    out = einsum("ij,kl->ikjl", a, b)
    df = out.df.select((F.col("i0") * p + F.col("i1")).alias("i0"), (F.col("i2") * q + F.col("i3")).alias("i1"), "v")
    return Grid(df, (a.shape[0] * p, a.shape[1] * q))


def cross(a: Grid, b: Grid) -> Grid:
    """Of rows of three elements."""
    def part(g: Grid, k: int) -> Grid:
        return g[..., k]

    cells = []
    for k in range(3):
        m, n = (k + 1) % 3, (k + 2) % 3
        cells.append(part(a, m) * part(b, n) - part(a, n) * part(b, m))
    from tessera.operators.grid import stack

    return stack(cells, -1)


def trace(a: Grid, k: int = 0) -> Grid:
    return a.trace(k)


def matrix_power(a: Grid, n: int) -> Grid:
    if n < 0:
        return matrix_power(inv(a), -n)
    from tessera.operators.grid import eye

    out, base = eye(a.df.sparkSession, a.shape[0]), a
    while n:
        out, base, n = (matmul(out, base) if n & 1 else out), (matmul(base, base) if n > 1 else base), n >> 1
    return out


def multi_dot(parts: list[Grid]) -> Grid:
    """The cheapest order of products by the sizes (dynamic programming)."""
    n, d = len(parts), [parts[0].shape[0]] + [p.shape[1] for p in parts]
    cost = {(i, i): (0, i) for i in range(n)}
    for span in range(1, n):
        for i in range(n - span):
            j = i + span
            cost[i, j] = min((cost[i, k][0] + cost[k + 1, j][0] + d[i] * d[k + 1] * d[j + 1], k) for k in range(i, j))

    def build(i: int, j: int) -> Grid:
        return parts[i] if i == j else matmul(build(i, cost[i, j][1]), build(cost[i, j][1] + 1, j))

    return build(0, n - 1)


# --- norms

def norm(a: Grid, order: float | str | None = None, axis: int | tuple[int, int] | None = None) -> Grid:
    if axis is not None and not isinstance(axis, int) and len(axis) > 2:
        raise ValueError("norms over at most two axes")
    if isinstance(axis, int) or (axis is None and (order is None or a.ndim == 1)):
        return vector_norm(a, 2 if order is None else order, axis)
    return matrix_norm(a, "fro" if order is None else order)


def vector_norm(a: Grid, order: float | str = 2, axis: int | None = None) -> Grid:
    if isinstance(order, str):
        raise ValueError("this norm is for matrices")
    v: Callable[[Column], Column]
    if order == float("inf"):
        v = lambda x: F.max(F.abs(x))
    elif order == float("-inf"):
        v = lambda x: F.min(F.abs(x))
    elif order == 0:
        v = lambda x: F.count_if(x != 0).cast("double")
    else:
        v = lambda x: F.pow(F.sum(F.pow(F.abs(x), F.lit(float(order)))), F.lit(1.0 / order))
    return a.reduce(v, axis)


def matrix_norm(a: Grid, order: float | str = "fro") -> Grid:
    if order == "fro":
        return a.map(F.abs).reduce(lambda x: F.sqrt(F.sum(x * x)))
    if order in (1, -1, float("inf"), float("-inf")):
        sums = a.map(F.abs).sum(0 if abs(order) == 1 else 1)
        return sums.max() if order > 0 else sums.min()
    s = svdvals(a)
    value = {"nuc": s.sum(), 2: s.max(), -2: s.min()}[order]
    return array(a.df.sparkSession, float(value))


# --- through the driver: small matrices, or the Gram matrix of tall ones

def local(a: Grid) -> np.ndarray:
    if a.size > MAX_LOCAL:
        raise ValueError(f"{a.shape} has more than {MAX_LOCAL} elements for one machine")
    return a.to_numpy().astype(float)


def gram(a: Grid) -> Grid:
    """Transposed a times a: k x k for n x k.  Rows are put together once; each task
    adds up the products of its rows, so k x k numbers a task meet in the sum."""
    k = a.shape[1]
    if k * k > MAX_LOCAL or a.dtype not in ("double", "float", "int", "bigint"):
        return einsum("ni,nj->ij", a, a)
    cells = a.df.filter(F.col("v").isNotNull())  # a masked element adds nothing, as in any sum
    rows = cells.groupBy("i0").agg(F.collect_list(F.struct("i1", F.col("v").cast("double").alias("v"))).alias("cells")).select("cells.i1", "cells.v")

    def add(batches):
        total = np.zeros((k, k))
        for batch in batches:
            at, v = batch.column(0), batch.column(1)
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(at.offsets)))
            dense = np.zeros((batch.num_rows, k))
            dense[row, at.flatten().to_numpy()] = v.flatten().to_numpy()
            total += dense.T @ dense
        i, j = np.indices((k, k))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i0", "i1", "v"])

    return Grid(rows.mapInArrow(add, "i0 bigint, i1 bigint, v double").groupBy("i0", "i1").agg(F.sum("v").alias("v")), (k, k))


def svdvals(a: Grid) -> np.ndarray:
    """Singular values; of a tall matrix the roots of the Gram matrix's eigenvalues."""
    if a.size <= MAX_LOCAL // 4:
        return np.linalg.svd(local(a), compute_uv=False)
    thin = a if a.shape[0] >= a.shape[1] else a.transpose()
    return np.sqrt(np.maximum(np.linalg.eigvalsh(local(gram(thin)))[::-1], 0))


def svd(a: Grid) -> tuple[Grid, np.ndarray, np.ndarray]:
    """(U, s, Vt): U is a Grid of the rows' size."""
    g = np.linalg.eigh(local(gram(a)))
    s = np.sqrt(np.maximum(g[0][::-1], 0))
    v = g[1][:, ::-1]
    keep = s > max(a.shape) * np.finfo(float).eps * max(s[0], 1e-300)
    spark = a.df.sparkSession
    u = matmul(a, array(spark, v[:, keep] / s[keep]))
    return u, s[keep], v[:, keep].T


def qr(a: Grid) -> tuple[Grid, np.ndarray]:
    """Cholesky QR, done twice for accuracy; a must have full column rank."""
    spark = a.df.sparkSession
    r1 = np.linalg.cholesky(local(gram(a))).T
    q1 = matmul(a, array(spark, np.linalg.inv(r1)))
    r2 = np.linalg.cholesky(local(gram(q1))).T
    return matmul(q1, array(spark, np.linalg.inv(r2))), r2 @ r1


def lstsq(a: Grid, b: Grid) -> np.ndarray:
    """Least squares from the normal equations: one pass over the rows."""
    rhs = einsum("ni,n->i", a, b) if b.ndim == 1 else einsum("ni,nj->ij", a, b)
    return np.linalg.lstsq(local(gram(a)), local(rhs), rcond=None)[0]


def _local(f: Callable) -> Callable:
    def run(a: Grid, *more):
        out = f(local(a), *[local(m) if isinstance(m, Grid) else m for m in more])
        spark = a.df.sparkSession
        return tuple(array(spark, np.asarray(o)) for o in out) if isinstance(out, tuple) else array(spark, np.asarray(out))

    return run


inv, det, cholesky, solve = _local(np.linalg.inv), _local(np.linalg.det), _local(np.linalg.cholesky), _local(np.linalg.solve)
eigh, eigvalsh, pinv = _local(lambda a: tuple(np.linalg.eigh(a))), _local(np.linalg.eigvalsh), _local(np.linalg.pinv)
slogdet, matrix_rank, cond = _local(lambda a: tuple(np.linalg.slogdet(a))), _local(np.linalg.matrix_rank), _local(np.linalg.cond)
tensorsolve, tensorinv = _local(np.linalg.tensorsolve), _local(np.linalg.tensorinv)


def eig(a: Grid) -> tuple[np.ndarray, np.ndarray]:
    """Complex eigenvalues and vectors (small matrices)."""
    return np.linalg.eig(local(a))


def eigvals(a: Grid) -> np.ndarray:
    return np.linalg.eigvals(local(a))


# --- columns of small matrices: array<double> in row-major order

def batched(matrix: Column, n: int, f: str, m: int | None = None) -> Column:
    """numpy.linalg's f over a column of n x (m or n) matrices, Arrow batch by batch."""
    shape = (n, m or n)

    @F.pandas_udf("array<double>")
    def run(cells: pd.Series) -> pd.Series:
        if not len(cells):
            return pd.Series([], dtype=object)
        stack = np.stack([np.asarray(c, float).reshape(shape) for c in cells])
        out = getattr(np.linalg, f)(stack)
        return pd.Series(list(np.asarray(out).reshape(len(cells), -1)))

    return run(matrix)


# --- columns of vectors: array<double>, no Python

def vec_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def vec_norm(a: Column) -> Column:
    return F.sqrt(vec_dot(a, a))


def vec_distance(a: Column, b: Column) -> Column:
    return vec_norm(F.zip_with(a, b, lambda x, y: x.cast("double") - y))


def cosine(a: Column, b: Column) -> Column:
    return vec_dot(a, b) / (vec_norm(a) * vec_norm(b))


def mat_vec(rows: list[list[float]], x: Column) -> Column:
    """A fixed small matrix times a column of vectors."""
    return F.array(*[vec_dot(F.array(*[F.lit(float(c)) for c in r]), x) for r in rows])


def det3(m: Column) -> Column:
    e = lambda k: F.element_at(m, k + 1)
    return e(0) * (e(4) * e(8) - e(5) * e(7)) - e(1) * (e(3) * e(8) - e(5) * e(6)) + e(2) * (e(3) * e(7) - e(4) * e(6))


def det2(m: Column) -> Column:
    e = lambda k: F.element_at(m, k + 1)
    return e(0) * e(3) - e(1) * e(2)


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = 64) -> np.ndarray:
    """Strassen's product of square matrices, a driver-side kernel."""
    n = len(a)
    if n <= leaf or n % 2:
        return a @ b
    h = n // 2
    a11, a12, a21, a22 = a[:h, :h], a[:h, h:], a[h:, :h], a[h:, h:]
    b11, b12, b21, b22 = b[:h, :h], b[:h, h:], b[h:, :h], b[h:, h:]
    s = lambda x, y: strassen(x, y, leaf)
    m1, m2, m3, m4 = s(a11 + a22, b11 + b22), s(a21 + a22, b11), s(a11, b12 - b22), s(a22, b21 - b11)
    m5, m6, m7 = s(a11 + a12, b22), s(a21 - a11, b11 + b12), s(a12 - a22, b21 + b22)
    return np.block([[m1 + m4 - m5 + m7, m3 + m5], [m2 + m4, m1 - m2 + m3 + m6]])


def quantized_matmul(a: Grid, b: Grid, bits: int = 8) -> Grid:
    """Product of matrices rounded to 2**(bits-1)-1 levels of their largest element."""
    top = float(2 ** (bits - 1) - 1)

    def levels(g: Grid) -> tuple[Grid, float]:
        scale = float(g.map(F.abs).max().item() or 0.0) / top or 1.0
        return g.map(lambda v: F.rint(v / scale)), scale

    (x, sx), (y, sy) = levels(a), levels(b)
    return matmul(x, y).map(lambda v: v * (sx * sy))


