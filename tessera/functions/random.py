"""Random columns: draws that depend on (seed, stream, row key) alone.

A draw hashes the row's key, so it is the same for any partitioning, after a
lost executor and on a rerun.  Distributions are built from uniform draws by
inversion, or from sums and ratios of other draws; loops have fixed lengths
unrolled over an array, all inside the JVM.  Distributions are reproduced, not
the bit streams of any other generator.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TERMS = 64


class Generator:
    def __init__(self, seed: int = 0, key: Column | None = None):
        self.seed, self.key, self._next = seed, key if key is not None else F.monotonically_increasing_id(), 0

    def spawn(self, n: int) -> list[Generator]:
        """Independent generators over the same keys."""
        return [Generator(self.seed * 1_000_003 + 7919 * (k + 1), self.key) for k in range(n)]

    def _bits(self, *more: Column) -> Column:
        self._next += 1
        return F.xxhash64(F.lit(self.seed), F.lit(self._next), self.key, *more)

    def random(self, *more: Column) -> Column:
        """Uniform in (0, 1), never 0: 53 bits and a half."""
        return (F.shiftrightunsigned(self._bits(*more), 11) + 0.5) / float(1 << 53)

    random_sample = ranf = sample = random

    def uniform(self, low=0.0, high=1.0) -> Column:
        return low + (high - low) * self.random()

    def integers(self, low: int, high: int) -> Column:
        """Integers in [low, high)."""
        if high <= low:
            raise ValueError("low >= high")
        return (F.floor(self.random() * (high - low)) + low).cast("bigint")

    randint = integers

    def bytes(self, n: int) -> Column:
        parts = [F.lpad(F.hex(self._bits()), 16, "0") for _ in range(-(-n // 8))]
        return F.substring(F.unhex(F.concat(*parts)), 1, n)

    def standard_normal(self, *more: Column) -> Column:
        """Box-Muller."""
        return F.sqrt(-2 * F.ln(self.random(*more))) * F.cos(2 * math.pi * self.random(*more))

    def normal(self, loc=0.0, scale=1.0) -> Column:
        _positive(scale, "scale", zero=True)
        return loc + scale * self.standard_normal()

    def complex_normal(self, scale: float = 1.0) -> Column:
        return F.struct(self.normal(0.0, scale / math.sqrt(2)).alias("re"), self.normal(0.0, scale / math.sqrt(2)).alias("im"))

    def lognormal(self, mean=0.0, sigma=1.0) -> Column:
        return F.exp(self.normal(mean, sigma))

    def standard_exponential(self) -> Column:
        return -F.ln(self.random())

    def exponential(self, scale=1.0) -> Column:
        _positive(scale, "scale", zero=True)
        return scale * self.standard_exponential()

    def standard_gamma(self, shape: float) -> Column:
        """Marsaglia and Tsang's squeeze: the first of 8 tries that is accepted
        (each is accepted with probability over 0.95)."""
        _positive(shape, "shape")
        if shape < 1:
            return self.standard_gamma(shape + 1) * F.pow(self.random(), F.lit(1.0 / shape))
        d = shape - 1.0 / 3.0
        c = 1.0 / math.sqrt(9 * d)
        gen = self

        def attempt(k: Column) -> Column:
            x, u = gen.standard_normal(k), gen.random(k)
            v = F.pow(1 + c * x, F.lit(3.0))
            ok = (v > 0) & (F.ln(u) < 0.5 * x * x + d - d * v + d * F.ln(F.when(v > 0, v)))
            return F.when(ok, d * v)

        tries = F.transform(F.sequence(F.lit(1), F.lit(8)), attempt)
        return F.get(F.filter(tries, lambda v: v.isNotNull()), 0)

    def gamma(self, shape: float, scale: float = 1.0) -> Column:
        return scale * self.standard_gamma(shape)

    def beta(self, a: float, b: float) -> Column:
        x, y = self.standard_gamma(a), self.standard_gamma(b)
        return x / (x + y)

    def chisquare(self, df: float) -> Column:
        return 2.0 * self.standard_gamma(df / 2)

    def noncentral_chisquare(self, df: float, nonc: float) -> Column:
        _positive(nonc, "nonc", zero=True)
        if df > 1:
            shifted = self.standard_normal() + math.sqrt(nonc)
            return shifted * shifted + self.chisquare(df - 1)
        n = self.poisson(nonc / 2)
        extra = F.transform(F.sequence(F.lit(0), F.lit(TERMS)), lambda k: F.when((k > 0) & (k <= n), -2.0 * F.ln(self.random(k))).otherwise(0.0))
        return self.chisquare(df) + F.aggregate(extra, F.lit(0.0), lambda s, x: s + x)

    def f(self, dfnum: float, dfden: float) -> Column:
        return (self.chisquare(dfnum) / dfnum) / (self.chisquare(dfden) / dfden)

    def noncentral_f(self, dfnum: float, dfden: float, nonc: float) -> Column:
        return (self.noncentral_chisquare(dfnum, nonc) / dfnum) / (self.chisquare(dfden) / dfden)

    def standard_t(self, df: float) -> Column:
        return self.standard_normal() / F.sqrt(self.chisquare(df) / df)

    def standard_cauchy(self) -> Column:
        return F.tan(math.pi * (self.random() - 0.5))

    def weibull(self, a: float) -> Column:
        _positive(a, "a")
        return F.pow(self.standard_exponential(), F.lit(1.0 / a))

    def pareto(self, a: float) -> Column:
        _positive(a, "a")
        return F.exp(self.standard_exponential() / a) - 1

    def power(self, a: float) -> Column:
        _positive(a, "a")
        return F.pow(self.random(), F.lit(1.0 / a))

    def laplace(self, loc=0.0, scale=1.0) -> Column:
        u = self.random() - 0.5
        return loc - scale * F.signum(u) * F.ln(1 - 2 * F.abs(u))

    def gumbel(self, loc=0.0, scale=1.0) -> Column:
        return loc - scale * F.ln(-F.ln(self.random()))

    def logistic(self, loc=0.0, scale=1.0) -> Column:
        u = self.random()
        return loc + scale * F.ln(u / (1 - u))

    def rayleigh(self, scale=1.0) -> Column:
        return scale * F.sqrt(2 * self.standard_exponential())

    def triangular(self, left: float, mode: float, right: float) -> Column:
        if not left <= mode <= right or left == right:
            raise ValueError("left <= mode <= right and left < right are asked for")
        u, cut = self.random(), (mode - left) / (right - left)
        return F.when(u < cut, left + F.sqrt(u * (right - left) * (mode - left))).otherwise(right - F.sqrt((1 - u) * (right - left) * (right - mode)))

    def wald(self, mean: float, scale: float) -> Column:
        _positive(mean, "mean")
        _positive(scale, "scale")
        n = self.standard_normal()
        y = n * n * mean
        x = mean + mean * (y - F.sqrt(4 * scale * y + y * y)) / (2 * scale)
        return F.when(self.random() <= mean / (mean + x), x).otherwise(mean * mean / x)

    def vonmises(self, mu: float, kappa: float) -> Column:
        """Best and Fisher's wrapped-Cauchy rejection, TERMS tries at most needed far less."""
        if kappa < 1e-8:
            return self.uniform(-math.pi, math.pi)
        tau = 1 + math.sqrt(1 + 4 * kappa * kappa)
        rho = (tau - math.sqrt(2 * tau)) / (2 * kappa)
        r = (1 + rho * rho) / (2 * rho)

        def attempt(k: Column) -> Column:
            z = F.cos(math.pi * self.random(k))
            w = (1 + r * z) / (r + z)
            y = kappa * (r - w)
            u = self.random(k)
            ok = (y * (2 - y) - u > 0) | (F.ln(y / u) + 1 - y >= 0)
            return F.when(ok, F.acos(F.greatest(F.least(w, F.lit(1.0)), F.lit(-1.0))))

        w = F.get(F.filter(F.transform(F.sequence(F.lit(1), F.lit(32)), attempt), lambda v: v.isNotNull()), 0)
        turned = F.when(self.random() < 0.5, -w).otherwise(w) + mu
        return turned - 2 * math.pi * F.floor((turned + math.pi) / (2 * math.pi))

    # discrete distributions

    def _inverted(self, weights: list[float]) -> Column:
        """The index drawn with the given probabilities."""
        edges, total = [], 0.0
        for w in weights:
            total += w
            edges.append(total)
        u = self.random() * total
        return F.aggregate(F.array(*map(F.lit, edges[:-1] or [total])), F.lit(0).cast("bigint"), lambda s, e: s + F.when(u >= e, 1).otherwise(0)) if len(weights) > 1 else F.lit(0).cast("bigint")

    def poisson(self, lam: float) -> Column:
        _positive(lam, "lam", zero=True)
        top = int(lam + 12 * math.sqrt(lam) + 30)
        return self._inverted([math.exp(-lam + k * math.log(lam) - math.lgamma(k + 1)) if lam else float(k == 0) for k in range(top)])

    def binomial(self, n: int, p: float) -> Column:
        _share(p)
        if p in (0.0, 1.0):
            return F.lit(n if p else 0).cast("bigint") + F.lit(0)
        return self._inverted([math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)) for k in range(n + 1)])

    def negative_binomial(self, n: float, p: float) -> Column:
        _share(p)
        lam_top = n * (1 - p) / p
        top = int(lam_top + 14 * math.sqrt(lam_top / p) + 40)
        return self._inverted([math.exp(math.lgamma(n + k) - math.lgamma(n) - math.lgamma(k + 1) + n * math.log(p) + (k * math.log1p(-p) if p < 1 else (0.0 if k == 0 else -math.inf))) for k in range(top)])

    def geometric(self, p: float) -> Column:
        """Failures before the first success; 1 where p is 1."""
        _share(p)
        if p == 1:
            return F.lit(1).cast("bigint")
        return F.floor(F.ln(self.random()) / math.log1p(-p)).cast("bigint")

    def hypergeometric(self, good: int, bad: int, n: int) -> Column:
        if min(good, bad, n) < 0 or n > good + bad:
            raise ValueError("n is more than good + bad, or one of them is negative")
        choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
        lo, hi = max(0, n - bad), min(good, n)
        return self._inverted([math.exp(choose(good, k) + choose(bad, n - k) - choose(good + bad, n)) for k in range(lo, hi + 1)]) + lo

    def logseries(self, p: float) -> Column:
        """Kemp's second accelerated generator."""
        if not 0 < p < 1:
            raise ValueError("p must lie in (0, 1)")
        q = 1 - F.exp(self.random() * math.log1p(-p))
        v = self.random()
        return F.when(v <= q * q, F.floor(1 + F.ln(v) / F.ln(q))).when(v <= q, 2).otherwise(1).cast("bigint")

    def zipf(self, a: float) -> Column:
        """Devroye's rejection."""
        if a <= 1:
            raise ValueError("a must be over 1")
        b = 2.0 ** (a - 1)

        def attempt(k: Column) -> Column:
            x = F.floor(F.pow(self.random(k), F.lit(-1 / (a - 1))))
            t = F.pow(1 + 1 / x, F.lit(a - 1))
            return F.when((x < 2.0**62) & (self.random(k) * x * (t - 1) / (b - 1) <= t / b), x.cast("bigint"))

        return F.get(F.filter(F.transform(F.sequence(F.lit(1), F.lit(TERMS)), attempt), lambda v: v.isNotNull()), 0)

    # several numbers a row

    def multinomial(self, n: int, p: list[float]) -> Column:
        """Counts of n draws by category, as an array."""
        _shares(p)
        edges = [sum(p[: k + 1]) for k in range(len(p) - 1)]
        draws = F.transform(F.sequence(F.lit(1), F.lit(max(n, 1))), lambda k: self._category(edges, k))
        times = lambda j: F.size(F.filter(draws, lambda c: c == j))
        return F.array(*[times(j) if n else F.lit(0) for j in range(len(p))])

    def _category(self, edges: list[float], k: Column) -> Column:
        u, out = self.random(k), F.lit(len(edges))
        for j in reversed(range(len(edges))):
            out = F.when(u < edges[j], j).otherwise(out)
        return out

    def multivariate_hypergeometric(self, colors: list[int], n: int) -> Column:
        """Draws without replacement: the n of all marbles with the least random keys."""
        marbles = [c for c, m in enumerate(colors) for _ in range(m)]
        if n > len(marbles):
            raise ValueError("more draws than marbles")
        keyed = F.array_sort(F.array(*[F.struct(self.random().alias("u"), F.lit(c).alias("c")) for c in marbles]))
        times = lambda j: F.size(F.filter(F.slice(keyed, 1, n), lambda x: x["c"] == j))
        return F.array(*[times(j) if n else F.lit(0) for j in range(len(colors))])

    def dirichlet(self, alpha: list[float]) -> Column:
        parts = F.array(*[self.standard_gamma(a) for a in alpha])
        return F.transform(parts, lambda x: x / F.aggregate(parts, F.lit(0.0), lambda s, y: s + y))

    def multivariate_normal(self, mean: list[float], cov: list[list[float]]) -> Column:
        import numpy as np

        low = np.linalg.cholesky(np.asarray(cov, float))
        z = [self.standard_normal() for _ in mean]
        return F.array(*[F.lit(float(mean[i])) + sum((z[j] * float(low[i, j]) for j in range(i + 1)), F.lit(0.0)) for i in range(len(mean))])

    def permuted(self, values: Column) -> Column:
        """The elements of each array in random order."""
        keyed = F.transform(values, lambda x, i: F.struct(self.random(i).alias("u"), i.alias("i"), x.alias("x")))
        return F.transform(F.array_sort(keyed), lambda s: s["x"])

    def choice_of(self, values: list, p: list[float] | None = None) -> Column:
        """One of the values for each row."""
        p = p or [1 / len(values)] * len(values)
        _shares(p)
        return F.element_at(F.array(*map(F.lit, values)), (self._inverted(p) + 1).cast("int"))


def _positive(x, name: str, zero: bool = False) -> None:
    if not isinstance(x, Column) and (x < 0 or (x == 0 and not zero)):
        raise ValueError(f"{name} must be {'at least' if zero else 'over'} 0")


def _share(p: float) -> None:
    if not 0 < p <= 1:
        raise ValueError("p must lie in (0, 1]")


def _shares(p: list[float]) -> None:
    if min(p) < 0 or abs(sum(p) - 1) > 1e-8:
        raise ValueError("p must be probabilities that sum to 1")


def default_rng(seed: int = 0, key: Column | None = None) -> Generator:
    return Generator(seed, key)


def shuffle(df: DataFrame, seed: int = 0) -> DataFrame:
    """Rows in random order: a range-partitioned sort on a hash, no single task."""
    return df.orderBy(F.xxhash64(F.lit(seed), *df.columns))


permutation = shuffle


def choice(df: DataFrame, n: int, replace: bool = False, seed: int = 0) -> DataFrame:
    """n rows: without replacement those with the least hashes; with replacement
    each row as often as n draws of row numbers hit it."""
    total = df.count()
    if not replace:
        if n > total:
            raise ValueError("more rows asked for than there are")
        return df.orderBy(F.xxhash64(F.lit(seed), *df.columns)).limit(n)
    if total == 0:
        raise ValueError("no rows to choose from")
    draws = df.sparkSession.range(n).select(Generator(seed, F.col("id")).integers(0, total).alias("_row"))
    from tessera.operators.ordering import with_index

    return draws.join(with_index(df, [F.xxhash64(F.lit(seed), *df.columns)], "_row"), "_row").drop("_row")


def rand(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), Generator(seed, F.col("id")).random().alias("v"))


def randn(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), Generator(seed, F.col("id")).standard_normal().alias("v"))
