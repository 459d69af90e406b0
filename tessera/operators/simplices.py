"""Simplicial complexes, homology and Vietoris-Rips filtrations.

A complex is a DataFrame ``dim int, simplex array<bigint>`` with sorted
vertices.  Faces, boundaries and counts are relational; ranks and Smith forms
of boundary matrices are computed on the driver, as they are sequential.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import gcd

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.storage import settled

TILE, STRIP = 4096, 512  # points of a block that meets others, and of a part of it that is measured at once
EDGES = 1_000_000  # in one part of a count of triangles


def from_maximal(spark: SparkSession, maximal: list[list[int]]) -> DataFrame:
    return close(spark.createDataFrame([(sorted(s),) for s in maximal], "simplex array<bigint>"))


def close(simplices: DataFrame) -> DataFrame:
    """All faces of the given simplices: subsets by the bits of a number."""
    n = F.size("simplex")
    mask = F.explode(F.sequence(F.lit(1), F.pow(F.lit(2), n).cast("int") - 1))
    face = F.filter("simplex", lambda v, i: F.call_function("getbit", F.col("_m"), i) == 1)
    return simplices.select("simplex", mask.alias("_m")).select(face.alias("simplex")).distinct().select((F.size("simplex") - 1).alias("dim"), "simplex")


def simplex(spark: SparkSession, n_vertices: int) -> DataFrame:
    return from_maximal(spark, [list(range(n_vertices))])


def circle(spark: SparkSession) -> DataFrame:
    return from_maximal(spark, [[0, 1], [1, 2], [0, 2]])


def sphere(spark: SparkSession, n: int = 2) -> DataFrame:
    """The boundary of an (n+1)-simplex."""
    return from_maximal(spark, [list(c) for c in combinations(range(n + 2), n + 1)])


def boundary(complex_: DataFrame, dim: int) -> DataFrame:
    """``face, simplex, v``: the signed incidence of dimension dim over dim-1."""
    s = complex_.filter(F.col("dim") == dim)
    parts = s.select("simplex", F.posexplode("simplex").alias("k", "_gone"))
    face = F.expr("filter(simplex, (x, i) -> i <> k)")
    return parts.select(face.alias("face"), "simplex", F.when(F.col("k") % 2 == 0, 1).otherwise(-1).alias("v"))


def euler_characteristic(complex_: DataFrame) -> DataFrame:
    return complex_.agg(F.sum(F.when(F.col("dim") % 2 == 0, 1).otherwise(-1)).alias("chi"))


def boundary_matrix(complex_: DataFrame, dim: int) -> np.ndarray:
    """Dense, on the driver; rows are faces and columns simplices in sorted order."""
    name = lambda d: {tuple(r.simplex): i for i, r in enumerate(complex_.filter(F.col("dim") == d).orderBy("simplex").collect())}
    rows, cols = name(dim - 1), name(dim)
    out = np.zeros((len(rows), len(cols)), np.int64)
    for r in boundary(complex_, dim).collect():
        out[rows[tuple(r.face)], cols[tuple(r.simplex)]] = r.v
    return out


def smith_normal_form(a: np.ndarray) -> list[int]:
    """The invariant factors of an integer matrix."""
    m = [list(map(int, r)) for r in a]
    out, top = [], 0
    rows, cols = len(m), len(m[0]) if m else 0
    while top < min(rows, cols):
        pick = min(((abs(m[i][j]), i, j) for i in range(top, rows) for j in range(top, cols) if m[i][j]), default=None)
        if pick is None:
            break
        _, i, j = pick
        m[top], m[i] = m[i], m[top]
        for r in m:
            r[top], r[j] = r[j], r[top]
        while True:
            p, clean = m[top][top], True
            for i in range(top + 1, rows):
                q = m[i][top] // p
                if q:
                    m[i] = [x - q * y for x, y in zip(m[i], m[top], strict=True)]
                if m[i][top]:
                    m[top], m[i], clean = m[i], m[top], False
                    break
            if not clean:
                continue
            for j in range(top + 1, cols):
                q = m[top][j] // p
                if q:
                    for r in m[top:]:
                        r[j] -= q * r[top]
                if m[top][j]:
                    for r in m:
                        r[top], r[j] = r[j], r[top]
                    clean = False
                    break
            if not clean:
                continue
            bad = next((i for i in range(top + 1, rows) for j in range(top + 1, cols) if m[i][j] % p), None)
            if bad is None:
                break
            m[top] = [x + y for x, y in zip(m[top], m[bad], strict=True)]
        out.append(abs(m[top][top]))
        top += 1
    return out


def homology(complex_: DataFrame) -> list[tuple[int, list[int]]]:
    """(Betti number, torsion coefficients) of each dimension."""
    counts = {r.dim: r.n for r in complex_.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    top = max(counts)
    factors = {d: smith_normal_form(boundary_matrix(complex_, d)) for d in range(1, top + 1)}
    return [(counts[d] - len(factors.get(d, [])) - len(factors.get(d + 1, [])), [f for f in factors.get(d + 1, []) if f > 1]) for d in range(top + 1)]


def betti_numbers(complex_: DataFrame) -> list[int]:
    return [b for b, _ in homology(complex_)]


def homology_string(complex_: DataFrame) -> str:
    part = lambda b, t: " + ".join((["Z^%d" % b] if b > 1 else ["Z"] if b else []) + [f"Z/{x}" for x in t]) or "0"
    return ", ".join(f"H_{d} = {part(b, t)}" for d, (b, t) in enumerate(homology(complex_)))


def links(points: DataFrame, eps: float, id_col: str = "id", vec: str = "vec") -> DataFrame:
    """``a, b, d`` of all pairs a < b that are at most eps apart.

    Every block of points meets every other in one product of matrices; what it
    may link (up to the product's rounding error) is measured coordinate by
    coordinate.  A missing or infinite coordinate, or another number of them, links nothing.
    """
    known = F.forall("x", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    p = points.select(F.col(id_col).cast("bigint").alias("a"), F.col(vec).alias("x")).filter("a IS NOT NULL AND size(x) > 0").filter(known)
    blocks = -(-p.count() // TILE) or 1
    dealt = p.withColumn("t", F.pmod(F.xxhash64("a", "x"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("s")
    met = dealt.select("a", "x", "t", other).select(F.least("t", "s").alias("i"), F.greatest("t", "s").alias("j"), "t", "a", "x")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        same = table["i"][0] == table["j"][0]
        lengths = np.asarray(pc.list_value_length(table["x"]))
        left, right = np.asarray(table["t"]) == table["i"][0].as_py(), np.asarray(table["t"]) == table["j"][0].as_py()
        for n in np.unique(lengths):
            sides = []
            for side in (left, right):
                rows = table.filter(pa.array(side & (lengths == n)))
                sides.append((np.asarray(rows["a"]), np.asarray(pc.list_flatten(rows["x"]), dtype=float).reshape(-1, n)))
            yield from _near(*sides[0], *sides[1], eps, same)

    return met.groupBy("i", "j").applyInArrow(tile, "a bigint, b bigint, d double")


def _near(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, eps: float, same: bool) -> Iterator[pa.RecordBatch]:
    """The links between two blocks of points, or within one."""
    if not len(a) or not len(b):
        return
    with np.errstate(over="ignore", invalid="ignore"):
        xx, yy = (x * x).sum(1), (y * y).sum(1)
        most = eps * eps + 8 * (x.shape[1] + 4) * np.finfo(float).eps * (xx.max() + yy.max())
        for at in range(0, len(a), STRIP):
            square = x[at : at + STRIP] @ y.T
            square *= -2
            square += xx[at : at + STRIP, None]
            square += yy
            r, c = np.nonzero(~(square > most))
            r += at
            kept = a[r] < b[c] if same else a[r] != b[c]
            r, c = r[kept], c[kept]
            d = np.zeros(len(r))
            for k in range(x.shape[1]):
                gap = x[r, k] - y[c, k]
                d += gap * gap
            d = np.sqrt(d)
            r, c, d = r[d <= eps], c[d <= eps], d[d <= eps]
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[r], b[c])), pa.array(np.maximum(a[r], b[c])), pa.array(d)], ["a", "b", "d"])


def triangle_count(edges: DataFrame) -> DataFrame:
    """``n``, a part each: the triples a < b < c whose three edges ``a, b`` (a < b) are
    there, none of them written out.  An edge that stands k times counts k times.

    Vertices have one of a few colours; a part has the triangles of three colours.
    """
    colours = max(2, math.ceil(math.sqrt(3 * edges.count() / EDGES)))
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(colours)).cast("int")
    third = F.explode(F.sequence(F.lit(0), F.lit(colours - 1))).alias("w")
    placed = edges.select("a", "b", of("a").alias("u"), of("b").alias("v"), third)
    roles = [placed.select(*[F.col(x).alias(y) for x, y in zip(at, "ijk", strict=True)], F.lit(k).alias("role"), "a", "b") for k, at in enumerate(("uvw", "wuv", "uwv"))]
    dealt = roles[0].unionByName(roles[1]).unionByName(roles[2])

    def part(table: pa.Table) -> pa.Table:
        role, a, b = (np.asarray(table[c]) for c in ("role", "a", "b"))
        first, second, third = ((a[role == k], b[role == k]) for k in range(3))
        return pa.table({"n": pa.array([_closed(*first, *second, *third)], pa.int64())})

    return dealt.groupBy("i", "j", "k").applyInArrow(part, "n bigint")


def _closed(a: np.ndarray, b: np.ndarray, b2: np.ndarray, c: np.ndarray, a3: np.ndarray, c3: np.ndarray) -> int:
    """How often an edge (a, b) and an edge (b2 = b, c) are closed by an edge (a3 = a, c3 = c)."""
    if not (len(a) and len(b2) and len(a3)):
        return 0
    names, ends = np.unique(np.concatenate([c, c3]), return_inverse=True)
    order = np.argsort(b2, kind="stable")
    b2, c = b2[order], ends[: len(c)][order]
    order = np.argsort(a3, kind="stable")
    a3, c3 = a3[order], ends[len(ends) - len(c3) :][order]
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    lo, hi = np.searchsorted(b2, b), np.searchsorted(b2, b, "right")
    closing = np.zeros(len(names), np.int64)
    total = 0
    tops, at = np.unique(a, return_index=True)
    for top, start, stop, u, v in zip(tops, at, [*at[1:], len(a)], np.searchsorted(a3, tops), np.searchsorted(a3, tops, "right"), strict=True):
        if u == v:
            continue
        np.add.at(closing, c3[u:v], 1)
        for k in range(start, stop):
            total += int(closing[c[lo[k] : hi[k]]].sum())
        closing[c3[u:v]] = 0
    return total


def vietoris_rips(points: DataFrame, eps: float, id_col: str = "id", vec: str = "vec") -> DataFrame:
    """``dim, simplex, birth`` of all vertices, edges and triangles whose points
    are at most eps apart."""
    near = settled(links(points, eps, id_col, vec), "links")
    e1, e2, e3 = near, near.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("d").alias("d2")), near.select("a", F.col("b").alias("c"), F.col("d").alias("d3"))
    triangles = e1.join(e2, "b").join(e3, ["a", "c"]).select(F.lit(2).alias("dim"), F.array("a", "b", "c").alias("simplex"), F.greatest("d", "d2", "d3").alias("birth"))
    vertices = points.select(F.lit(0).alias("dim"), F.array(F.col(id_col).cast("bigint")).alias("simplex"), F.lit(0.0).alias("birth"))
    edges = near.select(F.lit(1).alias("dim"), F.array("a", "b").alias("simplex"), F.col("d").alias("birth"))
    return vertices.unionByName(edges).unionByName(triangles)


def vietoris_rips_counts(points: DataFrame, eps: float, id_col: str = "id", vec: str = "vec") -> DataFrame:
    """``dim, n``: how many simplices ``vietoris_rips`` has of each dimension, without listing triangles."""
    near = settled(links(points, eps, id_col, vec), "links")
    numbers = [points.agg(F.count("*").alias("n")), near.agg(F.count("*").alias("n")), triangle_count(near).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"))]
    return reduce(DataFrame.unionByName, [one.select(F.lit(dim).alias("dim"), "n") for dim, one in enumerate(numbers)])


def persistence_barcode(filtration: list[tuple[float, tuple[int, ...]]]) -> list[tuple[int, float, float]]:
    """(dim, birth, death) by column reduction modulo 2; zero-length bars are left out."""
    order = sorted(filtration, key=lambda s: (s[0], len(s[1]), s[1]))
    place = {s: i for i, (_, s) in enumerate(order)}
    low: dict[int, set[int]] = {}
    bars, open_ = [], set()
    for j, (_, s) in enumerate(order):
        column = {place[f] for f in combinations(s, len(s) - 1)} if len(s) > 1 else set()
        while column and max(column) in low:
            column ^= low[max(column)]
        if column:
            i = max(column)
            low[i] = column
            open_.discard(i)
            if order[i][0] < order[j][0]:
                bars.append((len(order[i][1]) - 1, order[i][0], order[j][0]))
        else:
            open_.add(j)
    return sorted(bars + [(len(order[i][1]) - 1, order[i][0], float("inf")) for i in open_])


def bottleneck_distance(a: list[tuple[int, float, float]], b: list[tuple[int, float, float]]) -> float:
    """Bars sorted by dimension are compared pair by pair; missing ones count as (0, 0)."""
    worst = 0.0
    for dim in range(4):
        x, y = sorted(t[1:] for t in a if t[0] == dim), sorted(t[1:] for t in b if t[0] == dim)
        n = max(len(x), len(y))
        for p, q in zip(x + [(0.0, 0.0)] * (n - len(x)), y + [(0.0, 0.0)] * (n - len(y)), strict=True):
            for u, v in zip(p, q, strict=True):
                if u != v:
                    worst = max(worst, abs(u - v))
    return worst


def barcode_string(bars: list[tuple[int, float, float]]) -> str:
    return "\n".join(f"H{d}: [{b:g}, {e:g})" for d, b, e in bars)


def cohomology(complex_: DataFrame) -> list[tuple[int, list[int]]]:
    """By universal coefficients: torsion moves up one dimension."""
    h = homology(complex_)
    return [(b, h[d - 1][1] if d else []) for d, (b, _) in enumerate(h)]


def connected_components(complex_: DataFrame) -> int:
    return betti_numbers(complex_)[0]


def rank_over_gf2(a: np.ndarray) -> int:
    rows = [int("".join(map(str, (r % 2).tolist())), 2) for r in np.asarray(a)]
    rank = 0
    while rows:
        pivot = rows.pop()
        if pivot:
            rank += 1
            bit = pivot & -pivot
            rows = [r ^ pivot if r & bit else r for r in rows]
    return rank


def gcd_all(values: list[int]) -> int:
    out = 0
    for v in values:
        out = gcd(out, v)
    return out
