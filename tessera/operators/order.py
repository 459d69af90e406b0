"""Posets as relations, and integer lattices given by basis rows."""

from __future__ import annotations

from itertools import product
from math import gcd

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Poset:
    """A DataFrame ``a, b`` of all pairs with a <= b, the diagonal included."""

    def __init__(self, leq: DataFrame):
        self.leq = leq.select("a", "b").distinct()

    @staticmethod
    def divisors(spark: SparkSession, n: int) -> Poset:
        d = spark.range(1, n + 1).filter(F.lit(n) % F.col("id") == 0)
        return Poset(d.select(F.col("id").alias("a")).crossJoin(F.broadcast(d.select(F.col("id").alias("b")))).filter("b % a = 0"))

    @staticmethod
    def subsets(spark: SparkSession, n: int) -> Poset:
        """The Boolean lattice: sets as bits of a number, n at most 12."""
        if n > 12:
            raise ValueError("2**n elements, n at most 12")
        d = spark.range(1 << n)
        return Poset(d.select(F.col("id").alias("a")).crossJoin(F.broadcast(d.select(F.col("id").alias("b")))).filter("(a & b) = a"))

    def elements(self) -> DataFrame:
        return self.leq.select("a").union(self.leq.select("b")).distinct().withColumnRenamed("a", "e")

    def strict(self) -> DataFrame:
        return self.leq.filter("a <> b")

    def hasse_diagram(self) -> DataFrame:
        """Pairs with nothing between them."""
        s = self.strict()
        between = s.select(F.col("a"), F.col("b").alias("m")).join(s.select(F.col("a").alias("m"), F.col("b")), "m").select("a", "b").distinct()
        return s.join(between, ["a", "b"], "left_anti")

    def meets(self) -> DataFrame:
        """``x, y, meet`` for all pairs that have one: the lower bound that is above all others."""
        low = self.leq.select(F.col("a").alias("m"), F.col("b").alias("x"))
        bounds = low.join(low.withColumnRenamed("x", "y"), "m")
        depth = self.leq.groupBy(F.col("b").alias("m")).agg(F.count("*").alias("below"))
        ranked = bounds.join(depth, "m").groupBy("x", "y").agg(F.count("*").alias("n"), F.max_by("m", "below").alias("meet"), F.max("below").alias("below"))
        return ranked.filter("n = below").select("x", "y", "meet")

    def joins(self) -> DataFrame:
        return Poset(self.leq.select(F.col("b").alias("a"), F.col("a").alias("b"))).meets().withColumnRenamed("meet", "join")

    def is_lattice(self) -> bool:
        n = self.elements().count()
        return self.meets().count() == n * n and self.joins().count() == n * n

    def is_distributive(self) -> bool:
        """x and (y or z) is (x and y) or (x and z) for all triples."""
        m = {(r.x, r.y): r.meet for r in self.meets().collect()}
        j = {(r.x, r.y): r["join"] for r in self.joins().collect()}
        e = sorted({x for x, _ in m})
        return all(m[x, j[y, z]] == j[m[x, y], m[x, z]] for x, y, z in product(e, repeat=3))

    def is_modular(self) -> bool:
        m = {(r.x, r.y): r.meet for r in self.meets().collect()}
        j = {(r.x, r.y): r["join"] for r in self.joins().collect()}
        e = sorted({x for x, _ in m})
        return all(j[x, m[y, z]] == m[j[x, y], z] for x, y, z in product(e, repeat=3) if m[x, z] == x)

    def zeta(self) -> DataFrame:
        return self.leq.withColumn("v", F.lit(1))

    def mobius(self) -> dict[tuple, int]:
        """mu(a, b), by the sum over [a, b) of mu; intervals are walked upwards."""
        up: dict = {}
        for r in self.leq.collect():
            up.setdefault(r.a, set()).add(r.b)
        size = {a: len(b) for a, b in up.items()}
        out = {}
        for a in up:
            for b in sorted(up[a], key=lambda x: -size[x]):
                out[a, b] = 1 if a == b else -sum(out[a, c] for c in up[a] if c != b and b in up[c])
        return out


class Lattice:
    """An integer lattice; its basis is small and lives on the driver."""

    def __init__(self, basis):
        self.basis = np.array(basis, dtype=float)

    @staticmethod
    def cubic(n: int, scale: float = 1.0) -> Lattice:
        return Lattice(np.eye(n) * scale)

    @staticmethod
    def hexagonal(scale: float = 1.0) -> Lattice:
        return Lattice([[scale, 0.0], [scale / 2, scale * 3**0.5 / 2]])

    @staticmethod
    def a_n(n: int) -> Lattice:
        return Lattice([[1.0 if j == i else -1.0 if j == i + 1 else 0.0 for j in range(n + 1)] for i in range(n)])

    @staticmethod
    def d_n(n: int) -> Lattice:
        rows = [[1.0 if j == i else -1.0 if j == i + 1 else 0.0 for j in range(n)] for i in range(n - 1)]
        return Lattice([*rows, [1.0 if j >= n - 2 else 0.0 for j in range(n)]])

    @staticmethod
    def e8() -> Lattice:
        rows = [[2.0] + [0.0] * 7] + [[-1.0 if j == i else 1.0 if j == i + 1 else 0.0 for j in range(8)] for i in range(6)]
        return Lattice([*rows, [0.5] * 8])

    @property
    def rank(self) -> int:
        return len(self.basis)

    @property
    def dim(self) -> int:
        return self.basis.shape[1]

    def gram_matrix(self) -> np.ndarray:
        return self.basis @ self.basis.T

    def volume(self) -> float:
        return float(np.sqrt(max(np.linalg.det(self.gram_matrix()), 0)))

    def dual(self) -> Lattice:
        return Lattice(np.linalg.solve(self.gram_matrix(), self.basis))

    def independent(self) -> bool:
        return np.linalg.matrix_rank(self.basis) == self.rank

    def contains(self, v, tol: float = 1e-9) -> bool:
        c, *_ = np.linalg.lstsq(self.basis.T, np.asarray(v, float), rcond=None)
        return bool(np.all(np.abs(c - np.rint(c)) < 1e-6) and np.allclose(np.rint(c) @ self.basis, v, atol=max(tol, 1e-9)))

    def lll_reduce(self, delta: float = 0.75) -> Lattice:
        """Size reduction and swaps until Lovasz's condition holds throughout."""
        b, k = self.basis.copy(), 1

        def orthogonal() -> tuple[np.ndarray, np.ndarray]:
            g, mu = np.zeros_like(b), np.eye(len(b))
            for i in range(len(b)):
                g[i] = b[i]
                for j in range(i):
                    mu[i, j] = b[i] @ g[j] / max(g[j] @ g[j], 1e-300)
                    g[i] = g[i] - mu[i, j] * g[j]
            return g, mu

        while k < len(b):
            for j in range(k - 1, -1, -1):
                b[k] -= np.rint(orthogonal()[1][k, j]) * b[j]
            g, mu = orthogonal()
            if g[k] @ g[k] >= (delta - mu[k, k - 1] ** 2) * (g[k - 1] @ g[k - 1]):
                k += 1
            else:
                b[[k, k - 1]] = b[[k - 1, k]]
                k = max(k - 1, 1)
        return Lattice(b)

    def shortest_vector(self, reach: int = 2) -> np.ndarray:
        """The least of all small combinations of the reduced basis (dimensions up to about 8)."""
        b = self.lll_reduce().basis
        best = min((np.array(c) @ b for c in product(range(-reach, reach + 1), repeat=len(b)) if any(c)), key=lambda v: (round(float(v @ v), 9), *(-v)))
        return best

    def closest_vector(self, target, reach: int = 1) -> np.ndarray:
        b = self.lll_reduce().basis
        c0 = np.rint(np.linalg.lstsq(b.T, np.asarray(target, float), rcond=None)[0])
        return min(((c0 + np.array(d)) @ b for d in product(range(-reach, reach + 1), repeat=len(b))), key=lambda v: float(np.sum((v - target) ** 2)))


def lcm(a: int, b: int) -> int:
    return a // gcd(a, b) * b
