"""Registered queries over whole grids: rearrangement, creation, linear algebra,
Fourier transforms, random draws and files.

A rearranged grid is compared by its size and a sum in which every element is
weighed by its place, so that an element out of place shows.
"""

from __future__ import annotations

import os
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.random import default_rng
from tessera.operators import fft, grid, linalg
from tessera.plans.catalog import QUERIES, SQL, _embeddings, read, register
from tessera.plans.storage import folder, settled
from tessera.sources import arrays


def mark(name: str, g: grid.Grid | DataFrame) -> DataFrame:
    """``op, n, c`` of a grid."""
    df = g.df if isinstance(g, grid.Grid) else g
    places = [c for c in df.columns if c != "v"]
    weight = F.lit(1.0)
    for k, p in enumerate(places):
        weight = weight * (F.col(p) % 1009 + k + 1)
    value = F.col("v") if "v" in df.columns else F.lit(1.0)
    return df.agg(F.lit(name).alias("op"), F.count("*").alias("n"), F.round(F.coalesce(F.sum(weight * value), F.lit(0.0)), 2).alias("c"))


def sql_mark(name: str, places: list[str], value: str, source: str) -> str:
    weight = " * ".join(f"(({p}) % 1009 + {k + 1})" for k, p in enumerate(places))
    return f"SELECT '{name}' AS op, count(*) AS n, round(coalesce(sum({weight} * ({value})), 0.0), 2) AS c FROM {source}"


def marked(name: str, head: str, checks: list[tuple], base) -> None:
    """Registers a query of checks (op, maker of a grid from ``base``'s, places, value, source)."""

    def query(spark, sf_dir):
        g = base(spark, sf_dir)
        out = None
        for op, make, *_ in checks:
            one = mark(op, make(g))
            out = one if out is None else out.unionByName(one)
        return out

    QUERIES[name] = query
    SQL[name] = f"WITH {head} " + " UNION ALL ".join(sql_mark(op, places, value, source) for op, _, places, value, source in checks)


def _vectors(spark, sf_dir) -> grid.Grid:
    g = _embeddings(spark, sf_dir)
    return grid.Grid(settled(g.df, "vectors"), g.shape)


# n vectors (i) of 64 numbers (j).
E = "e AS (SELECT vec_id AS i, unnest(range(64)) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), s AS (SELECT count(*) AS n FROM embeddings)"
ALL = "e, s"

marked("rearrange_axes", E, [
    ("fliplr", lambda g: g.fliplr(), ["i", "63 - j"], "v", ALL),
    ("flipud", lambda g: g.flipud(), ["n - 1 - i", "j"], "v", ALL),
    ("swapaxes", lambda g: g.swapaxes(0, 1), ["j", "i"], "v", ALL),
    ("matrix_transpose", lambda g: g.matrix_transpose(), ["j", "i"], "v", ALL),
    ("moveaxis", lambda g: g.moveaxis(0, 1), ["j", "i"], "v", ALL),
    ("rollaxis", lambda g: g.rollaxis(1), ["j", "i"], "v", ALL),
    ("expand_dims", lambda g: g.expand_dims(1), ["i", "0", "j"], "v", ALL),
    ("squeeze", lambda g: g.expand_dims(0).squeeze(), ["i", "j"], "v", ALL),
    ("atleast", lambda g: g.atleast(3), ["i", "j", "0"], "v", ALL),
    ("ravel", lambda g: g.ravel(), ["i * 64 + j"], "v", ALL),
    ("flatten", lambda g: g.flatten(), ["i * 64 + j"], "v", ALL),
    ("resize", lambda g: g.resize(g.shape[0] * 2, 32), ["(i * 64 + j) // 32", "j % 32"], "v", ALL),
    ("repeat", lambda g: g.repeat(2, 1), ["i", "2 * j + k"], "v", "e, s, range(2) r(k)"),
    ("compress", lambda g: g.compress([True, False, True], 1), ["i", "j // 2"], "v", "e WHERE j IN (0, 2)"),
    ("delete", lambda g: g.delete([0, 63], 1), ["i", "j - 1"], "v", "e WHERE j BETWEEN 1 AND 62"),
    ("take_along_axis", lambda g: g.take_along_axis(grid.Grid(g.df.filter("i1 < 2").withColumn("v", F.lit(63).cast("bigint") - F.col("i1")), (g.shape[0], 2)), 1), ["i", "63 - j"], "v", "e WHERE j >= 62"),
    ("astype", lambda g: g.astype("float").astype("double"), ["i", "j"], "v", ALL),
], _vectors)

marked("rearrange_parts", E, [
    ("append", lambda g: g.append(g, 1), ["i", "j + 64 * k"], "v", "e, s, range(2) r(k)"),
    ("vstack", lambda g: grid.vstack([g, g]), ["i + n * k", "j"], "v", "e, s, range(2) r(k)"),
    ("hstack", lambda g: grid.hstack([g, g]), ["i", "j + 64 * k"], "v", "e, s, range(2) r(k)"),
    ("dstack", lambda g: grid.dstack([g, g]), ["i", "j", "k"], "v", "e, s, range(2) r(k)"),
    ("column_stack", lambda g: grid.column_stack([g.mean(1), g.mean(1)]), ["i", "k"], "m", "(SELECT i, avg(v) AS m FROM e GROUP BY 1), range(2) r(k)"),
    ("block", lambda g: grid.block([[g, g], [g, g]]), ["i + n * (k // 2)", "j + 64 * (k % 2)"], "v", "e, s, range(4) r(k)"),
    ("array_split", lambda g: g.array_split(3, 1)[1], ["i", "j - 22"], "v", "e WHERE j BETWEEN 22 AND 42"),
    ("hsplit", lambda g: g.hsplit(4)[3], ["i", "j - 48"], "v", "e WHERE j >= 48"),
    ("vsplit", lambda g: g.vsplit([10])[1], ["i - 10", "j"], "v", "e WHERE i >= 10"),
    ("unstack", lambda g: g.unstack(1)[5], ["i"], "v", "e WHERE j = 5"),
    ("broadcast_to", lambda g: g.mean(0).broadcast_to(3, 64), ["k", "j"], "m", "(SELECT j, avg(v) AS m FROM e GROUP BY 1), range(3) r(k)"),
    ("triu", lambda g: g.triu(1), ["i", "j"], "CASE WHEN j > i THEN v ELSE 0 END", ALL),
    ("fill_diagonal", lambda g: g.fill_diagonal(2.0), ["i", "j"], "CASE WHEN i = j THEN 2.0 ELSE v END", ALL),
    ("diag", lambda g: g.diag(2), ["i"], "v", "e WHERE j = i + 2"),
    ("flatnonzero", lambda g: g.map(lambda v: F.when(v > 0, v).otherwise(0.0)).flatnonzero(), ["i * 64 + j"], "1", "e WHERE v > 0"),
    ("insert", lambda g: g.insert(1, grid.full(g.df.sparkSession, (g.shape[0], 1), 7.0), 1), ["i", "CASE WHEN j >= 1 THEN j + 1 ELSE j END"], "v", "(SELECT i, j, v FROM e UNION ALL SELECT i, 0.5, 7.0 FROM e WHERE j = 0) q(i, j, v)"),
    ("overlay", lambda g: g.overlay(grid.Grid(g.df.filter("i1 = 3").withColumn("v", F.lit(9.0)), g.shape)), ["i", "j"], "CASE WHEN j = 3 THEN 9.0 ELSE v END", ALL),
], _vectors)
SQL["rearrange_parts"] = SQL["rearrange_parts"].replace("CASE WHEN j >= 1 THEN j + 1 ELSE j END", "CASE WHEN j = 0.5 THEN 1 WHEN j >= 1 THEN j + 1 ELSE j END")


class _Spark:
    """Stands for a grid where only the session is needed."""

    def __init__(self, spark, sf_dir):
        self.s = spark


marked("array_creation", "one AS (SELECT 1)", [
    ("zeros", lambda g: grid.zeros(g.s, (3, 4)), ["a", "b"], "0.0", "range(3) x(a), range(4) y(b)"),
    ("ones", lambda g: grid.ones(g.s, (3, 4)), ["a", "b"], "1.0", "range(3) x(a), range(4) y(b)"),
    ("full", lambda g: grid.full(g.s, (3, 4), 2.5), ["a", "b"], "2.5", "range(3) x(a), range(4) y(b)"),
    ("full_like", lambda g: grid.full_like(grid.ones(g.s, (5,)), 2.5), ["a"], "2.5", "range(5) x(a)"),
    ("zeros_like", lambda g: grid.zeros_like(grid.ones(g.s, (5,))), ["a"], "0.0", "range(5) x(a)"),
    ("ones_like", lambda g: grid.ones_like(grid.zeros(g.s, (5,))), ["a"], "1.0", "range(5) x(a)"),
    ("eye", lambda g: grid.eye(g.s, 4, 5, 1), ["a", "b"], "CASE WHEN b = a + 1 THEN 1.0 ELSE 0 END", "range(4) x(a), range(5) y(b)"),
    ("tri", lambda g: grid.tri(g.s, 4, 5, 1), ["a", "b"], "CASE WHEN b <= a + 1 THEN 1.0 ELSE 0 END", "range(4) x(a), range(5) y(b)"),
    ("array", lambda g: grid.array(g.s, [[1.0, 2.0], [3.0, 4.0]]), ["a", "b"], "1.0 + 2 * a + b", "range(2) x(a), range(2) y(b)"),
    ("geomspace", lambda g: grid.geomspace(g.s, 1.0, 1000.0, 4), ["a"], "pow(10, a)", "range(4) x(a)"),
    ("indices", lambda g: grid.indices(g.s, (3, 4))[1], ["a", "b"], "b", "range(3) x(a), range(4) y(b)"),
    ("mgrid", lambda g: grid.mgrid(g.s, (0.0, 3.0, 1.0), (5.0, 7.0, 1.0))[1], ["a", "b"], "5.0 + b", "range(3) x(a), range(2) y(b)"),
    ("ogrid", lambda g: grid.ogrid(g.s, (0.0, 3.0, 1.0), (5.0, 7.0, 1.0))[0], ["a", "0"], "a", "range(3) x(a)"),
    ("diag_indices", lambda g: grid.diag_indices(g.s, 4), ["a", "a"], "1", "range(4) x(a)"),
    ("tril_indices", lambda g: grid.tril_indices(g.s, 4), ["a", "b"], "1", "range(4) x(a), range(4) y(b) WHERE b <= a"),
    ("triu_indices", lambda g: grid.triu_indices(g.s, 4, 1), ["a", "b"], "1", "range(4) x(a), range(4) y(b) WHERE b > a"),
    ("vander", lambda g: grid.arange(g.s, 1.0, 5.0).vander(3), ["a", "b"], "pow(a + 1, 2 - b)", "range(4) x(a), range(3) y(b)"),
    ("trim_zeros", lambda g: grid.array(g.s, [0.0, 0.0, 1.0, 2.0, 0.0, 3.0, 0.0]).trim_zeros(), ["a"], "CASE a WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 3 END", "range(4) x(a)"),
    ("dsplit", lambda g: grid.fromfunction(g.s, lambda i, j, k: i + j * 2.0 + k * 5, (2, 3, 4)).dsplit(2)[1], ["a", "b", "c"], "a + b * 2.0 + (c + 2) * 5", "range(2) x(a), range(3) y(b), range(2) z(c)"),
], _Spark)


# ------------------------------------------------------------------ linear algebra


def _tall(spark, sf_dir) -> grid.Grid:
    """Parts by size and price (in thousands)."""
    p = read(spark, sf_dir, "part")
    cells = p.select(F.col("p_partkey").cast("bigint").alias("i0"), F.posexplode(F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 1000)).alias("i1", "v")).withColumn("i1", F.col("i1").cast("bigint"))
    return grid.Grid(settled(cells, "parts"), (p.agg(F.max("p_partkey") + 1).first()[0], 2))


# The Gram matrix is ((a, b), (b, d)).
TALL = """g AS (SELECT sum(CAST(p_size AS DOUBLE) * p_size) AS a, sum(p_size * p_retailprice / 1000) AS b, sum(p_retailprice / 1000 * p_retailprice / 1000) AS d, sum(CAST(p_size AS DOUBLE)) AS s, sum(p_retailprice / 1000) AS t, count(*) AS n,
  sum(CAST(p_size AS DOUBLE) * p_partkey) AS sk, sum(p_retailprice / 1000 * p_partkey) AS tk FROM part),
  h AS (SELECT *, a * d - b * b AS det, (a + d + sqrt((a - d) * (a - d) + 4 * b * b)) / 2 AS big, (a * d - b * b) / ((a + d + sqrt((a - d) * (a - d) + 4 * b * b)) / 2) AS small FROM g)"""
NUMBERS = [
    ("det", lambda x, g: linalg.det(g), "det"),
    ("slogdet", lambda x, g: linalg.slogdet(g)[1], "ln(det)"),
    ("inv", lambda x, g: _corner(linalg.inv(g)), "-b / det"),
    ("pinv", lambda x, g: _corner(linalg.pinv(g)), "-b / det"),
    ("tensorinv", lambda x, g: _corner(linalg.inv(g)), "-b / det"),
    ("cholesky", lambda x, g: _corner(linalg.cholesky(g), 1, 1), "sqrt(d - b * b / a)"),
    ("eigvalsh", lambda x, g: _corner(linalg.eigvalsh(g), 1), "big"),
    ("eigh", lambda x, g: _corner(linalg.eigh(g)[0], 0), "small"),
    ("eigvals", lambda x, g: float(np.sort(linalg.eigvals(g).real)[1]), "big"),
    ("eig", lambda x, g: float(np.sort(linalg.eig(g)[0].real)[0]), "small"),
    ("svdvals", lambda x, g: float(linalg.svdvals(x)[0]), "sqrt(big)"),
    ("svd", lambda x, g: float(linalg.svd(x)[1][0]), "sqrt(big)"),
    ("qr", lambda x, g: float(abs(linalg.qr(x)[1][0, 0])), "sqrt(a)"),
    ("cond", lambda x, g: linalg.cond(g), "big / small"),
    ("matrix_rank", lambda x, g: linalg.matrix_rank(g), "2.0"),
    ("trace", lambda x, g: linalg.trace(g), "a + d"),
    ("norm", lambda x, g: linalg.norm(g), "sqrt(a * a + 2 * b * b + d * d)"),
    ("matrix_norm", lambda x, g: linalg.matrix_norm(g, "fro"), "sqrt(a * a + 2 * b * b + d * d)"),
    ("vector_norm", lambda x, g: linalg.vector_norm(x[:, 0]), "sqrt(a)"),
    ("matrix_power", lambda x, g: _corner(linalg.matrix_power(g, 2)), "a * b + b * d"),
    ("multi_dot", lambda x, g: _corner(linalg.multi_dot([g, g, g])), "a * (a * b + b * d) + b * (b * b + d * d)"),
    ("matmul", lambda x, g: _corner(linalg.matmul(x.transpose(), x)), "b"),
    ("dot", lambda x, g: linalg.dot(x[:, 0], x[:, 1]), "b"),
    ("vdot", lambda x, g: linalg.vdot(x[:, 0], x[:, 1]), "b"),
    ("vecdot", lambda x, g: linalg.vecdot(x[:, 1], x[:, 1]), "d"),
    ("inner", lambda x, g: linalg.inner(x[:, 0], x[:, 1]), "b"),
    ("outer", lambda x, g: linalg.outer(g[0], g[1]), "a * b + a * d + b * b + b * d"),
    ("tensordot", lambda x, g: linalg.tensordot(g, g, 2), "a * a + 2 * b * b + d * d"),
    ("matvec", lambda x, g: _corner(linalg.matvec(g, g[0]), 1), "a * b + b * d"),
    ("vecmat", lambda x, g: _corner(linalg.vecmat(g[0], g), 0), "a * a + b * b"),
    ("solve", lambda x, g: _corner(linalg.solve(g, g[0]), 0), "1.0"),
    ("lstsq", lambda x, g: float(linalg.lstsq(x, x.sum(1))[1]), "1.0"),
    ("gram", lambda x, g: _corner(linalg.gram(x), 1, 1), "d"),
]


def _corner(g: grid.Grid, *at: int) -> grid.Grid:
    """One element (0, 1 if no place is named)."""
    at = at or (0, 1)
    return g[tuple(at)] if len(at) > 1 else g[at[0]]


@register(f"WITH {TALL} SELECT op, CASE WHEN v = 0 THEN 0.0 ELSE sign(v) * (round(ln(abs(v)), 6) + 100) END AS v FROM (" + " UNION ALL ".join(f"SELECT '{name}' AS op, CAST({sql} AS DOUBLE) AS v FROM h" for name, _, sql in NUMBERS) + ")")
def linear_algebra(spark, sf_dir):
    x = _tall(spark, sf_dir)
    g = linalg.gram(x)
    g = grid.Grid(settled(g.df, "gram"), g.shape)
    out = None
    for name, make, _ in NUMBERS:
        v = make(x, g)
        if isinstance(v, grid.Grid):
            one = v.df.agg(F.sum(F.col("v").cast("double")).alias("v"))
        else:
            one = spark.createDataFrame([(float(v),)], "v double")
        one = one.select(F.lit(name).alias("op"), "v")
        out = one if out is None else out.unionByName(one)
    v = F.col("v")
    return out.select("op", F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * (F.round(F.ln(F.abs(v)), 6) + 100)).alias("v"))


# ------------------------------------------------------------------ Fourier transforms

WAVE = "e AS (SELECT vec_id, unnest(range(64)) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
FULL = f"WITH {WAVE}, f AS (SELECT vec_id, k, sum(x * cos(2 * pi() * k * j / 64)) AS re, -sum(x * sin(2 * pi() * k * j / 64)) AS im FROM e, range(64) t(k) GROUP BY 1, 2)"


def _bins(spark, sf_dir, make) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return rows.select("vec_id", F.posexplode(make(F.col("x"))).alias("k", "z"))


def _near(c: str):
    return (F.round(c, 5) + 0.0).alias(c.split(".")[-1])


@register(f"{FULL} SELECT vec_id, CAST(k AS INT) AS k, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM f WHERE k <= 32")
def fft_real(spark, sf_dir):
    return _bins(spark, sf_dir, fft.rfft).select("vec_id", "k", _near("z.re"), _near("z.im"))


@register(f"{FULL} SELECT vec_id, CAST(k AS INT) AS k, round(re / 64, 5) + 0.0 AS re, round(-im / 64, 5) + 0.0 AS im FROM f")
def fft_inverse(spark, sf_dir):
    return _bins(spark, sf_dir, fft.ifft).select("vec_id", "k", _near("z.re"), _near("z.im"))


@register(f"{FULL} SELECT vec_id, CAST(k AS INT) AS k, round(re / 64, 5) + 0.0 AS re, round(-im / 64, 5) + 0.0 AS im FROM f WHERE k <= 32")
def fft_hermitian(spark, sf_dir):
    return _bins(spark, sf_dir, fft.ihfft).select("vec_id", "k", _near("z.re"), _near("z.im"))


@register(f"WITH {WAVE} SELECT vec_id, CAST(j AS INT) AS k, round(x, 5) + 0.0 AS back, round(x, 5) + 0.0 AS real_back, round(x, 5) + 0.0 AS grid_back, round(x, 5) + 0.0 AS hermitian_back, round(x, 5) + 0.0 AS shifted_back FROM e")
def fft_round_trips(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    x = F.col("x")
    back = rows.select(
        "vec_id", fft.ifft(fft.fft(x)).alias("a"), fft.irfft(fft.rfft(x)).alias("b"), fft.irfftn(fft.rfftn(x, (8, 8)), (8, 5)).alias("c"), fft.hfft(fft.ihfft(x), 64).alias("d"), fft.ifftshift(fft.fftshift(x)).alias("s"),
        fft.ifftn(fft.fftn(x, (8, 8)), (8, 8)).alias("g"),
    )
    cells = back.select("vec_id", F.posexplode(F.arrays_zip("a", "b", "c", "d", "s", "g")).alias("k", "z"))
    near = lambda c: F.round(c, 5) + 0.0
    grid_back = F.when(F.abs(F.col("z.c") - F.col("z.g.re")) < 1e-6, F.col("z.c"))
    return cells.select("vec_id", "k", near("z.a.re").alias("back"), near("z.b").alias("real_back"), near(grid_back).alias("grid_back"), near("z.d").alias("hermitian_back"), near("z.s").alias("shifted_back"))


@register(f"WITH {WAVE}, f AS (SELECT vec_id, a * 8 + b AS k, sum(x * cos(2 * pi() * (a * (j // 8) + b * (j % 8)) / 8)) AS re, -sum(x * sin(2 * pi() * (a * (j // 8) + b * (j % 8)) / 8)) AS im FROM e, range(8) p(a), range(8) q(b) GROUP BY 1, 2) SELECT vec_id, CAST(k AS INT) AS k, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM f")
def fft_two_dimensions(spark, sf_dir):
    return _bins(spark, sf_dir, lambda x: fft.fft2(x, (8, 8))).select("vec_id", "k", _near("z.re"), _near("z.im"))


@register("SELECT CAST(i AS BIGINT) AS i, CASE WHEN i < 5 THEN i / 5.0::DOUBLE ELSE (i - 10) / 5.0::DOUBLE END AS f, i / 5.0::DOUBLE AS r FROM range(10) t(i)")
def fft_frequencies(spark, sf_dir):
    return spark.range(10).select(F.col("id").alias("i"), fft.fftfreq(F.col("id"), 10, 0.5).alias("f"), fft.rfftfreq(F.col("id"), 10, 0.5).alias("r"))


# ------------------------------------------------------------------ random draws

# Each distribution's draws, and the mean and variance that they must come near to.
DRAWS = [
    ("random", lambda r: r.random(), 0.5, 1 / 12),
    ("uniform", lambda r: r.uniform(2.0, 4.0), 3.0, 1 / 3),
    ("integers", lambda r: r.integers(0, 10), 4.5, 8.25),
    ("standard_normal", lambda r: r.standard_normal(), 0.0, 1.0),
    ("normal", lambda r: r.normal(1.0, 2.0), 1.0, 4.0),
    ("lognormal", lambda r: r.lognormal(0.0, 0.5), float(np.exp(0.125)), float((np.exp(0.25) - 1) * np.exp(0.25))),
    ("standard_exponential", lambda r: r.standard_exponential(), 1.0, 1.0),
    ("exponential", lambda r: r.exponential(2.0), 2.0, 4.0),
    ("standard_gamma", lambda r: r.standard_gamma(2.5), 2.5, 2.5),
    ("gamma", lambda r: r.gamma(2.0, 3.0), 6.0, 18.0),
    ("beta", lambda r: r.beta(2.0, 3.0), 0.4, 0.04),
    ("chisquare", lambda r: r.chisquare(4.0), 4.0, 8.0),
    ("noncentral_chisquare", lambda r: r.noncentral_chisquare(4.0, 1.0), 5.0, 12.0),
    ("f", lambda r: r.f(5.0, 20.0), 20 / 18, 2 * 400 * 23 / (5 * 18 * 18 * 16)),
    ("noncentral_f", lambda r: r.noncentral_f(5.0, 20.0, 1.0), 20 * 6 / (5 * 18), 2 * ((6 * 6 + (5 + 2) * 18) / (18 * 18 * 16)) * 16),
    ("standard_t", lambda r: r.standard_t(10.0), 0.0, 1.25),
    ("weibull", lambda r: r.weibull(1.0), 1.0, 1.0),
    ("pareto", lambda r: r.pareto(6.0), 0.2, 6 / (25 * 4)),
    ("power", lambda r: r.power(3.0), 0.75, 3 / 80),
    ("laplace", lambda r: r.laplace(1.0, 2.0), 1.0, 8.0),
    ("gumbel", lambda r: r.gumbel(0.0, 1.0), 0.5772156649, float(np.pi**2 / 6)),
    ("logistic", lambda r: r.logistic(0.0, 1.0), 0.0, float(np.pi**2 / 3)),
    ("rayleigh", lambda r: r.rayleigh(1.0), float(np.sqrt(np.pi / 2)), float(2 - np.pi / 2)),
    ("triangular", lambda r: r.triangular(0.0, 1.0, 2.0), 1.0, 1 / 6),
    ("wald", lambda r: r.wald(2.0, 8.0), 2.0, 1.0),
    ("vonmises", lambda r: r.vonmises(0.0, 4.0), 0.0, None),
    ("poisson", lambda r: r.poisson(3.0), 3.0, 3.0),
    ("binomial", lambda r: r.binomial(10, 0.3), 3.0, 2.1),
    ("negative_binomial", lambda r: r.negative_binomial(5, 0.5), 5.0, 10.0),
    ("geometric", lambda r: r.geometric(0.5), 1.0, 2.0),
    ("hypergeometric", lambda r: r.hypergeometric(10, 10, 5), 2.5, 5 * 0.25 * 15 / 19),
    ("logseries", lambda r: r.logseries(0.5), float(-0.5 / (np.log(0.5) * 0.5)), None),
    ("zipf", lambda r: r.zipf(4.0), float(sum(k**-3.0 for k in range(1, 10**5)) / sum(k**-4.0 for k in range(1, 10**5))), None),
    ("multinomial", lambda r: r.multinomial(6, [0.5, 0.5])[0], 3.0, 1.5),
    ("multivariate_hypergeometric", lambda r: r.multivariate_hypergeometric([10, 10], 5)[0], 2.5, None),
    ("dirichlet", lambda r: r.dirichlet([2.0, 3.0])[0], 0.4, 0.04),
    ("multivariate_normal", lambda r: r.multivariate_normal([1.0, 2.0], [[2.0, 0.5], [0.5, 1.0]])[0], 1.0, 2.0),
    ("permuted", lambda r: r.permuted(F.array(F.lit(0.0), F.lit(1.0)))[0], 0.5, 0.25),
    ("choice_of", lambda r: r.choice_of([1.0, 2.0, 3.0], [0.25, 0.5, 0.25]), 2.0, 0.5),
    ("bytes", lambda r: F.octet_length(r.bytes(7)), 7.0, 0.0),
]


@register("SELECT op, true AS mean_is_near, true AS variance_is_near, CAST(3000 AS BIGINT) AS n FROM (VALUES " + ", ".join(f"('{name}')" for name, *_ in DRAWS) + ") t(op)")
def random_moments(spark, sf_dir):
    """3000 draws of every distribution: the mean within five standard errors, the variance within a third."""
    drawn = spark.range(3000).select(*[make(default_rng(k, F.col("id"))).cast("double").alias(name) for k, (name, make, *_) in enumerate(DRAWS)])
    sums = drawn.agg(*[F.struct(F.avg(name).alias("m"), F.var_pop(name).alias("v"), F.count(name).alias("n")).alias(name) for name, *_ in DRAWS])
    checks = []
    for name, _, mean, variance in DRAWS:
        m, v, n = (F.col(f"{name}.{c}") for c in "mvn")
        spread = F.sqrt(v if variance is None else F.lit(variance) / 1.0)
        near = F.abs(m - mean) <= 5 * spread / F.sqrt(n.cast("double")) + 1e-9
        checks.append(F.struct(F.lit(name).alias("op"), near.alias("mean_is_near"), (F.lit(True) if variance is None else F.abs(v - variance) <= variance / 3 + 1e-9).alias("variance_is_near"), n.alias("n")))
    return sums.select(F.inline(F.array(*checks)))


# ------------------------------------------------------------------ files

FORMATS = ["fromfile", "fromregex", "genfromtxt", "load", "load_many", "load_npz", "loadtxt", "savez_compressed"]


@register(f"WITH {E}, m AS (" + sql_mark("x", ["i * 64 + j"], "v", ALL) + ") SELECT t.op, m.n, m.c FROM m, (VALUES " + ", ".join(f"('{f}')" for f in FORMATS) + ") t(op)")
def file_round_trips(spark, sf_dir):
    """Written in each format to the shared folder (which single files need mounted) and read back."""
    g = _vectors(spark, sf_dir)
    at = folder(spark, "files")
    path = urlparse(at).path
    os.makedirs(path)
    arrays.save(g, f"{path}/a.npy")
    arrays.savez(f"{path}/a.npz", a=g)
    arrays.savez_compressed(f"{path}/b.npz", a=g)
    arrays.tofile(g, f"{path}/a.bin")
    arrays.savetxt(g, f"{at}/text")
    flat = grid.Grid(g.ravel().df, (g.size,))
    flat.df.orderBy("i0").select(F.concat_ws(";", F.col("i0").cast("string"), F.col("v").cast("string")).alias("value")).write.text(f"{at}/lines")
    pairs = arrays.fromregex(spark, f"{at}/lines", r"^(\d+);(\S+)$", ["i0", "v"], ["bigint", "double"])
    back = {
        "load": arrays.load(spark, f"{at}/a.npy").ravel(), "load_npz": arrays.load_npz(spark, f"{at}/a.npz")["a"].ravel(), "savez_compressed": arrays.load_npz(spark, f"{at}/b.npz")["a"].ravel(),
        "fromfile": arrays.fromfile(spark, f"{at}/a.bin"), "loadtxt": arrays.loadtxt(spark, f"{at}/text").ravel(), "genfromtxt": arrays.genfromtxt(spark, f"{at}/text").ravel(),
        "load_many": arrays.load_many(spark, at).select(F.col("i").alias("i0"), "v"), "fromregex": pairs,
    }
    out = None
    for name, one in sorted(back.items()):
        m = mark(name, one)
        out = m if out is None else out.unionByName(m)
    return out
