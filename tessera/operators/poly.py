"""Polynomials: evaluation as Columns, fits from one pass of moments, and
coefficient arithmetic on the driver.

Free functions have coefficients from high to low degree; the basis classes
from low to high.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def polyval(p: list[float] | Column, x: Column) -> Column:
    """Horner's rule; p is a list or a column of arrays, highest degree first."""
    x = x.cast("double")
    if isinstance(p, Column):
        return F.aggregate(p, F.lit(0.0), lambda s, c: s * x + c)
    out = F.lit(0.0)
    for c in p:
        out = out * x + float(c)
    return out


def poly(roots: list[float]) -> list[float]:
    return np.poly(roots).tolist() if len(roots) else [1.0]


def polyadd(a, b) -> list[float]:
    return np.polyadd(a, b).tolist()


def polysub(a, b) -> list[float]:
    return np.polysub(a, b).tolist()


def polymul(a, b) -> list[float]:
    return np.polymul(a, b).tolist()


def polydiv(u, v) -> tuple[list[float], list[float]]:
    q, r = np.polydiv(u, v)
    return np.atleast_1d(q).tolist(), np.atleast_1d(r).tolist()


def polyder(p, m: int = 1) -> list[float]:
    return np.atleast_1d(np.polyder(p, m)).tolist()


def polyint(p, m: int = 1) -> list[float]:
    return np.atleast_1d(np.polyint(p, m)).tolist()


def roots(p) -> np.ndarray:
    return np.roots(p)


def poly_trim(c, tol: float = 0.0) -> list[float]:
    c = list(c)
    while len(c) > 1 and abs(c[-1]) <= tol:
        c.pop()
    return c


def mapparms(old: tuple[float, float], new: tuple[float, float]) -> tuple[float, float]:
    span = old[1] - old[0]
    return (old[1] * new[0] - old[0] * new[1]) / span, (new[1] - new[0]) / span


def mapdomain(x: Column, old: tuple[float, float], new: tuple[float, float]) -> Column:
    off, scale = mapparms(old, new)
    return off + scale * x


def polyvander(x: Column, deg: int) -> Column:
    return F.array(*[F.pow(x.cast("double"), F.lit(float(k))) for k in range(deg + 1)])


def _fit(df: DataFrame, terms: list[Column], y: Column) -> np.ndarray:
    """Least squares of y over the terms, from the sums of all products."""
    n = len(terms)
    sums = [F.sum(terms[i] * terms[j]) for i in range(n) for j in range(i, n)] + [F.sum(t * y) for t in terms]
    row = df.agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first()
    a, k = np.zeros((n, n)), 0
    for i in range(n):
        for j in range(i, n):
            a[i, j] = a[j, i] = row[k]
            k += 1
    return np.linalg.lstsq(a, np.array([row[k + i] for i in range(n)], float), rcond=None)[0]


def polyfit(df: DataFrame, x: str, y: str, deg: int) -> list[float]:
    """Highest degree first.  x is mapped to [-1, 1] for the sums of powers (one
    pass for the range, one for the moments), then mapped back."""
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None:
        raise ValueError("a fit of no points")
    domain = (float(lo), float(hi)) if lo < hi else (float(lo) - 1, float(hi) + 1)
    t = mapdomain(F.col(x).cast("double"), domain, (-1.0, 1.0))
    fitted = _fit(df, chebyshev_terms(t, deg), F.col(y).cast("double"))
    series = np.polynomial.Chebyshev(fitted, domain=domain).convert(kind=np.polynomial.Polynomial, domain=(-1, 1))
    coef = np.zeros(deg + 1)
    coef[: len(series.coef)] = series.coef
    return coef[::-1].tolist()


def chebyshev_terms(t: Column, deg: int) -> list[Column]:
    return Chebyshev.terms(t, deg)


class _Basis:
    """A series in a basis with a three-term recurrence, coefficients from low
    to high degree, over a domain that is mapped to the window."""

    _kind: type
    window = (-1.0, 1.0)

    def __init__(self, coef, domain: tuple[float, float] | None = None):
        self.coef = [float(c) for c in coef]
        self.domain = tuple(domain) if domain is not None else self.window

    @staticmethod
    def _next(k: int, x: Column, last: Column, before: Column) -> Column:
        raise NotImplementedError

    @staticmethod
    def _first(x: Column) -> Column:
        return x

    @classmethod
    def terms(cls, x: Column, deg: int) -> list[Column]:
        out = [F.lit(1.0)]
        if deg:
            out.append(cls._first(x))
        for k in range(1, deg):
            out.append(cls._next(k, x, out[-1], out[-2]))
        return out[: deg + 1]

    def val(self, x: Column) -> Column:
        """The series at x, as one fold along the recurrence."""
        t = mapdomain(x.cast("double"), self.domain, self.window)
        total = F.lit(0.0)
        for c, term in zip(self.coef, self.terms(t, len(self.coef) - 1), strict=True):
            total = total + c * term
        return total

    __call__ = val

    def _np(self):
        return self._kind(self.coef, domain=self.domain, window=self.window)

    def _own(self, series):
        return type(self)(series.coef, series.domain)

    def deriv(self, m: int = 1):
        return self._own(self._np().deriv(m))

    def integ(self, m: int = 1):
        return self._own(self._np().integ(m))

    def roots(self) -> np.ndarray:
        return self._np().roots()

    def degree(self) -> int:
        return len(self.coef) - 1

    def trim(self, tol: float = 0.0):
        return type(self)(poly_trim(self.coef, tol), self.domain)

    def truncate(self, size: int):
        return type(self)(self.coef[:size], self.domain)

    def cutoff(self, deg: int):
        return self.truncate(deg + 1)

    def copy(self):
        return type(self)(self.coef, self.domain)

    def convert(self, kind: type):
        return kind(self._np().convert(kind=kind._kind).coef)

    cast = convert

    def linspace(self, n: int = 100) -> tuple[np.ndarray, np.ndarray]:
        return self._np().linspace(n)

    def mapparms(self) -> tuple[float, float]:
        return mapparms(self.domain, self.window)

    def __add__(self, other):
        return self._own(self._np() + other._np())

    def __sub__(self, other):
        return self._own(self._np() - other._np())

    def __mul__(self, other):
        return self._own(self._np() * other._np())

    def has_samecoef(self, other) -> bool:
        return self.coef == other.coef

    def has_samedomain(self, other) -> bool:
        return self.domain == other.domain

    def has_samewindow(self, other) -> bool:
        return self.window == other.window

    def has_sametype(self, other) -> bool:
        return type(self) is type(other)

    def has_samepars(self, other) -> bool:
        return self.has_samecoef(other) and self.has_samedomain(other) and self.has_samewindow(other)

    @classmethod
    def basis(cls, deg: int):
        return cls([0.0] * deg + [1.0])

    @classmethod
    def identity(cls):
        return cls(cls._kind.identity().coef)

    @classmethod
    def fromroots(cls, values):
        return cls(cls._kind.fromroots(values, domain=cls.window).coef)

    @classmethod
    def fit(cls, df: DataFrame, x: str, y: str, deg: int):
        lo, hi = df.agg(F.min(x), F.max(x)).first()
        domain = (float(lo), float(hi)) if lo < hi else (float(lo) - 1, float(hi) + 1)
        t = mapdomain(F.col(x).cast("double"), domain, cls.window)
        return cls(_fit(df, cls.terms(t, deg), F.col(y).cast("double")), domain)


class Polynomial(_Basis):
    _kind = np.polynomial.Polynomial

    @staticmethod
    def _next(k, x, last, before):
        return x * last


class Chebyshev(_Basis):
    _kind = np.polynomial.Chebyshev

    @staticmethod
    def _next(k, x, last, before):
        return 2 * x * last - before


class Legendre(_Basis):
    _kind = np.polynomial.Legendre

    @staticmethod
    def _next(k, x, last, before):
        return ((2 * k + 1) * x * last - k * before) / (k + 1)


class Laguerre(_Basis):
    _kind = np.polynomial.Laguerre
    window = (0.0, 1.0)

    @staticmethod
    def _first(x):
        return 1 - x

    @staticmethod
    def _next(k, x, last, before):
        return ((2 * k + 1 - x) * last - k * before) / (k + 1)


class Hermite(_Basis):
    _kind = np.polynomial.Hermite

    @staticmethod
    def _first(x):
        return 2 * x

    @staticmethod
    def _next(k, x, last, before):
        return 2 * x * last - 2 * k * before


class HermiteE(_Basis):
    _kind = np.polynomial.HermiteE

    @staticmethod
    def _next(k, x, last, before):
        return x * last - k * before


class poly1d:  # noqa: N801
    """A polynomial by its coefficients from high to low, or by its roots."""

    def __init__(self, c, from_roots: bool = False):
        self.coef = poly(c) if from_roots else [float(x) for x in c]

    def __call__(self, x: Column) -> Column:
        return polyval(self.coef, x)

    def deriv(self, m: int = 1):
        return poly1d(polyder(self.coef, m))

    def integ(self, m: int = 1):
        return poly1d(polyint(self.coef, m))

    @property
    def order(self) -> int:
        return len(self.coef) - 1

    @property
    def r(self) -> np.ndarray:
        return roots(self.coef)

    def __getitem__(self, k: int) -> float:
        return self.coef[-1 - k] if 0 <= k < len(self.coef) else 0.0
