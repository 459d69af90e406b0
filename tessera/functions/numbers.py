"""Number theory: arithmetic functions as Columns where rows can be worked on
alone, series and lifts as Python integers of any size."""

from __future__ import annotations

import cmath
from fractions import Fraction
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def is_prime(n: Column) -> Column:
    """Trial division up to the root, inside the JVM."""
    v = n.cast("bigint")
    top = F.greatest(F.floor(F.sqrt(v.cast("double"))).cast("bigint"), F.lit(2).cast("bigint"))
    found = F.exists(F.sequence(F.lit(2).cast("bigint"), top), lambda d: (v % d == 0) & (d < v))
    return (v >= 2) & ~F.when(v >= 2, found).otherwise(True)


def sigma(k: int, n: Column) -> Column:
    """The sum of the kth powers of the divisors."""
    v = n.cast("bigint")
    root = F.floor(F.sqrt(v.cast("double"))).cast("bigint")
    power = lambda d: F.pow(d.cast("double"), F.lit(float(k))).cast("bigint")
    small = F.filter(F.sequence(F.lit(1).cast("bigint"), F.greatest(root, F.lit(1).cast("bigint"))), lambda d: v % d == 0)
    both = lambda d: power(d) + F.when(d * d == v, F.lit(0).cast("bigint")).otherwise(power((v / d).cast("bigint")))
    return F.aggregate(small, F.lit(0).cast("bigint"), lambda s, d: s + both(d))


def divisor_sums(spark: SparkSession, n: int, k: int = 1) -> DataFrame:
    """``n, v`` for 1..n as one relation: each divisor meets its multiples."""
    d = spark.range(1, n + 1)
    pairs = d.select(F.explode(F.sequence(F.col("id"), F.lit(n), F.col("id"))).alias("n"), F.pow(F.col("id").cast("double"), F.lit(float(k))).cast("bigint").alias("p"))
    return pairs.groupBy("n").agg(F.sum("p").alias("v"))


def valuation(n: Column, p: int) -> Column:
    """How often p divides n; NULL for 0."""
    v = F.abs(n.cast("bigint"))
    powers = [p**k for k in range(1, 64) if p**k < 2**63]
    return F.when(v != 0, sum((F.when(v % q == 0, 1).otherwise(0) for q in powers[1:]), F.when(v % powers[0] == 0, 1).otherwise(0)))


def padic_norm(n: Column, p: int) -> Column:
    return F.when(n == 0, F.lit(0.0)).otherwise(F.pow(F.lit(float(p)), -valuation(n, p)))


def padic_digits(n: Column, p: int, precision: int = 20) -> Column:
    """The first digits of n in Z_p, lowest first (negative numbers wrap around)."""
    modulus = p ** min(precision, 62 if p == 2 else max(k for k in range(1, 64) if p**k < 2**62))
    v = F.pmod(n.cast("bigint"), F.lit(modulus))
    return F.array(*[(F.floor(v / p**k) % p).cast("int") if p**k < modulus else F.lit(0) for k in range(precision)])


class Padic:
    """A p-adic integer modulo p**precision."""

    def __init__(self, p: int, value: int | Fraction, precision: int = 20):
        self.p, self.precision, self.modulus = p, precision, p**precision
        f = Fraction(value)
        if f.denominator % p == 0:
            raise ValueError("not a p-adic integer")
        self.value = f.numerator * pow(f.denominator, -1, self.modulus) % self.modulus

    def _with(self, v: int) -> Padic:
        return Padic(self.p, v % self.modulus, self.precision)

    def __add__(self, o: Padic) -> Padic:
        return self._with(self.value + o.value)

    def __sub__(self, o: Padic) -> Padic:
        return self._with(self.value - o.value)

    def __mul__(self, o: Padic) -> Padic:
        return self._with(self.value * o.value)

    def __truediv__(self, o: Padic) -> Padic:
        return self * o.inverse()

    def __eq__(self, o) -> bool:
        return isinstance(o, Padic) and (self.p, self.value) == (o.p, o.value)

    def __hash__(self) -> int:
        return hash((self.p, self.value))

    def valuation(self) -> int:
        if self.value == 0:
            return self.precision
        v, k = self.value, 0
        while v % self.p == 0:
            v, k = v // self.p, k + 1
        return k

    def norm(self) -> float:
        return 0.0 if self.value == 0 else float(self.p) ** -self.valuation()

    def is_unit(self) -> bool:
        return self.value % self.p != 0

    def inverse(self) -> Padic:
        return self._with(pow(self.value, -1, self.modulus))

    def expansion(self) -> list[int]:
        return [self.value // self.p**k % self.p for k in range(self.precision)]

    def teichmuller(self) -> Padic:
        """The root of unity with the same residue: the limit of p-th powers."""
        return self._with(pow(self.value, self.p**self.precision, self.modulus))


def hensel_lift(a: Padic, f, df) -> Padic:
    """A root of f near a, by Newton's step, doubling the digits each time."""
    for _ in range(a.precision.bit_length() + 1):
        a = a - f(a) / df(a)
    return a


def bernoulli(k: int) -> Fraction:
    b = [Fraction(1)]
    for m in range(1, k + 1):
        b.append(-sum(comb(m + 1, j) * b[j] for j in range(m)) / (m + 1))
    return b[k]


def sigma_int(k: int, n: int) -> int:
    return sum(d**k for d in range(1, n + 1) if n % d == 0)


def eisenstein_series(k: int, n: int) -> list[int | Fraction]:
    """The first n coefficients of the normalised series of weight k."""
    c = Fraction(-2 * k) / bernoulli(k)
    out = [Fraction(1)] + [c * sigma_int(k - 1, m) for m in range(1, n)]
    return [int(x) if x.denominator == 1 else x for x in out]


def series_product(a: list[int], b: list[int], n: int) -> list[int]:
    out = [0] * n
    for i, x in enumerate(a[:n]):
        if x:
            for j, y in enumerate(b[: n - i]):
                out[i + j] += x * y
    return out


def ramanujan_tau(n: int) -> list[int]:
    """tau(1..n): coefficients of q times the 24th power of the product of (1-q^m)."""
    eta = [0] * n
    for k in range(-n, n + 1):
        e = k * (3 * k - 1) // 2
        if 0 <= e < n:
            eta[e] += (-1) ** (k % 2)
    out = [1] + [0] * (n - 1)
    for _ in range(24):
        out = series_product(out, eta, n)
    return out


def j_invariant(n: int) -> list[int]:
    """Coefficients from q^-1 on: E4 cubed over the discriminant."""
    e4 = eisenstein_series(4, n)
    top, delta, out = series_product(series_product(e4, e4, n), e4, n), ramanujan_tau(n), []
    for m in range(n):
        out.append(top[m] - sum(out[i] * delta[m - i] for i in range(m)))
    return out


def hecke(coefficients: list[int], p: int, weight: int) -> list[int]:
    """T_p of a form by its coefficients a_0, a_1, ..."""
    n = len(coefficients)
    return [coefficients[m * p] + (p ** (weight - 1) * coefficients[m // p] if m % p == 0 else 0) for m in range(-(-n // p))]


def dedekind_eta(tau: complex, terms: int = 50) -> complex:
    q = cmath.exp(2j * cmath.pi * tau)
    out = cmath.exp(2j * cmath.pi * tau / 24)
    for m in range(1, terms + 1):
        out *= 1 - q**m
    return out


def modular_discriminant(tau: complex, terms: int = 50) -> complex:
    return dedekind_eta(tau, terms) ** 24 * (2 * cmath.pi) ** 12
