import math
from datetime import date

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.functions import calendar, numbers, physics, random, tapers, text
from tessera.functions import ufuncs as u
from tessera.functions.expr import Form, Formula, curl, divergence

NAN, INF = float("nan"), float("inf")


def values(spark, *columns):
    """The row of the given Columns over one row."""
    return list(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def same(a, b):
    return (a is None and b is None) or (a is not None and b is not None and (a == b or (isinstance(a, float) and math.isnan(a) and math.isnan(b))))


def test_division_and_remainders(spark):
    got = values(spark, u.divide(1.0, 0.0), u.divide(-1.0, 0.0), u.divide(0.0, 0.0), u.divide(1.0, -0.0), u.remainder(7, -3), u.remainder(-7, 3), u.fmod(-7.0, 3.0), u.fmod(1.0, 0.0), u.floor_divide(-7, 2), u.int_power(2, -1), u.divide(F.lit(None).cast("double"), 0.0))
    assert all(same(a, b) for a, b in zip(got, [INF, -INF, NAN, -INF, -2, 2, -1.0, NAN, -4, 0, None], strict=True))
    with pytest.raises(PySparkException):
        values(spark, u.floor_divide(1, 0))


def test_logarithms_rounding_and_parts(spark):
    got = values(spark, u.log(0.0), u.log(-1.0), u.log1p(-1.0), u.floor(NAN), u.ceil(INF), u.round_(2.5), u.round_(-1.25, 1), u.trunc(-2.7), u.copysign(3.0, -0.0), u.signbit(-0.0), u.gcd(12, -18), u.lcm(4, 6), u.sinc(0.0), u.heaviside(0.0, 0.5))
    assert all(same(a, b) for a, b in zip(got, [-INF, NAN, -INF, NAN, INF, 2.0, -1.2, -2.0, -3.0, True, 6, 12, 1.0, 0.5], strict=True))
    m, e = values(spark, u.frexp(10.0))[0]
    assert (m, e) == math.frexp(10.0)
    for x, t in ((1.0, 2.0), (1.0, 0.0), (-3.5, 0.0), (0.1, 5.0)):
        assert values(spark, u.nextafter(x, t))[0] == np.nextafter(x, t)
    for x in (0.0, 1.0, 5.0, 12.5):
        assert values(spark, u.i0(x))[0] == pytest.approx(float(np.i0(x)), rel=1e-12)


def test_comparisons_follow_ieee(spark):
    got = values(spark, u.equal(NAN, NAN), u.not_equal(NAN, NAN), u.greater(NAN, 1.0), u.maximum(NAN, 1.0), u.maximum(1.0, NAN), u.fmin(NAN, 2.0), u.isclose(1.0, 1.0 + 1e-9), u.isclose(NAN, NAN), u.isclose(INF, INF), u.isfinite(NAN), u.isposinf(INF))
    assert all(same(a, b) for a, b in zip(got, [False, True, False, NAN, 1.0, 2.0, True, False, False, False, True], strict=True))


def test_bits(spark):
    got = values(spark, u.bitwise_and(12, 10), u.bitwise_or(12, 10), u.bitwise_xor(12, 10), u.left_shift(3, 4), u.right_shift(-8, 1), u.binary_repr(-5), u.binary_repr(-5, 8), u.base_repr(35, 36), u.packbits(F.array(*[F.lit(int(c)) for c in "10101010"])), u.unpackbits(F.array(F.lit(5))))
    assert got == [8, 14, 6, 48, -4, "-101", "11111011", "Z", [170], [0, 0, 0, 0, 0, 1, 0, 1]]
    with pytest.raises(PySparkException):
        values(spark, u.left_shift(1, 64))


def test_complex(spark):
    z = values(spark, u.emath.sqrt(-4.0), u.emath.arcsin(2.0), u.emath.arctanh(2.0), u.complex_divide(u.complex_(1.0, 2.0), u.complex_(3.0, -1.0)), u.emath.power(-8.0, 1 / 3))
    want = [2j, np.emath.arcsin(2.0), np.emath.arctanh(2.0), (1 + 2j) / (3 - 1j), np.emath.power(-8.0, 1 / 3)]
    for a, b in zip(z, want, strict=True):
        assert (a.re, abs(a.im)) == pytest.approx((b.real, abs(b.imag)))


def test_strings(spark):
    got = values(
        spark, text.title("they're BILL-smith"), text.center("ab", 5, "*"), text.ljust("abcdef", 3), text.zfill("-42", 6), text.find("héllo", "l"), text.rfind("hello", "l"), text.find("abc", "z"), text.count("aaaa", "aa"),
        text.join("-", "abc"), text.strip("\t a \n"), text.swapcase("aBc"), text.expandtabs("a\tbc", 4), text.partition("a=b=c", "="), text.rpartition("a=b=c", "="), text.rsplit("a,b,c", ",", 1), text.splitlines("a\r\nb\nc\n"), text.replace("aaa", "a", "b", 2), text.isalpha("ab1"), text.str_len("é"),
    )
    assert got == ["They'Re Bill-Smith", "*ab**", "abcdef", "-00042", 3, 3, -1, 2, "a-b-c", "a", "AbC", "a   bc", ["a", "=", "b=c"], ["a=b", "=", "c"], ["a,b", "c"], ["a", "b", "c"], "bba", False, 2]


def test_business_days(spark):
    day = lambda *a: F.lit(date(2023, *a))
    cal = calendar.BusinessCalendar(holidays=[date(2023, 1, 9)])
    none = F.lit(None).cast("date")
    got = values(
        spark, calendar.is_busday(day(1, 9)), calendar.is_busday(day(1, 14)), calendar.is_busday(none), cal.is_busday(day(1, 9)), calendar.busday_count(day(1, 9), day(1, 16)), calendar.busday_count(day(1, 16), day(1, 9)), calendar.busday_count(none, day(1, 9)), cal.busday_count(day(1, 9), day(1, 16)),
        calendar.busday_offset(day(1, 14), 0, "forward"), calendar.busday_offset(day(1, 14), 0, "nat"), calendar.busday_offset(day(1, 15), 0, "backward"), calendar.busday_offset(day(1, 9), 1), calendar.busday_offset(day(1, 16), -1), cal.busday_offset(day(1, 6), 1), calendar.as_string(day(1, 15), "s"), calendar.as_string(none), calendar.from_string(F.lit("2023-01-15T10")),
    )
    assert got == [True, False, False, False, 5, -5, 0, 4, date(2023, 1, 16), None, date(2023, 1, 13), date(2023, 1, 10), date(2023, 1, 13), date(2023, 1, 10), "2023-01-15T00:00:00", "NaT", date(2023, 1, 15)]
    with pytest.raises(PySparkException):
        values(spark, calendar.busday_offset(day(1, 14), 0))
    assert calendar.parse_weekmask("Mon Tue") == calendar.parse_weekmask("1100000")


def test_formulas(spark):
    f = Formula("x^2 + y^2", ["x", "y"])
    assert (f(3, 4), f.diff("x")(3, 4), f.diff("y")(3, 4), f.laplacian()(1, 1)) == (25, 6, 8, 4)
    g = Formula("exp(-x) * sin(x^3) / (1 + x)")
    h = 1e-6
    assert g.diff()(0.7) == pytest.approx((g(0.7 + h) - g(0.7 - h)) / (2 * h), rel=1e-6)
    got = values(spark, g.column(x=F.lit(0.7)), g.dual("x", x=F.lit(0.7))["slope"])
    assert got == pytest.approx([g(0.7), g.diff()(0.7)])
    assert Form.of(f).d().d().parts == {}
    xyz = ["x", "y", "z"]
    field = [Formula(t, xyz) for t in ("-y", "x", "z^2")]
    assert divergence(field)(1, 1, 3) == 6 and [c(1, 2, 3) for c in curl(field)] == [0, 0, 2]
    for bad in ("x +", "(x", "foo(x)", "x y"):
        with pytest.raises(ValueError):
            Formula(bad)


def test_random_distributions(spark):
    g = random.Generator(3, F.col("id"))
    draws = {"uniform": (g.random(), 0.5, 1 / 12), "normal": (g.normal(1, 2), 1, 4), "gamma": (g.gamma(0.5, 2), 1, 2), "beta": (g.beta(2, 3), 0.4, 0.04), "poisson": (g.poisson(4.0), 4, 4), "binomial": (g.binomial(9, 0.3), 2.7, 1.89), "geometric": (g.geometric(0.25), 3, 12), "laplace": (g.laplace(), 0, 2), "triangular": (g.triangular(0, 1, 2), 1, 1 / 6), "hyper": (g.hypergeometric(5, 5, 4), 2, 2 / 3), "wald": (g.wald(1, 3), 1, 1 / 3)}
    df = spark.range(20_000).select(*[c.cast("double").alias(n) for n, (c, *_) in draws.items()])
    row = df.agg(*[f(n).alias(f"{n}_{f.__name__}") for n in draws for f in (F.avg, F.var_pop)]).first()
    for n, (_, mean, var) in draws.items():
        assert row[f"{n}_avg"] == pytest.approx(mean, abs=6 * math.sqrt(var / 20_000)) and row[f"{n}_var_pop"] == pytest.approx(var, rel=0.2)
    again = spark.range(20_000).repartition(5).select(random.Generator(3, F.col("id")).random().alias("u")).agg(F.sum("u")).first()[0]
    assert again == pytest.approx(df.agg(F.sum("uniform")).first()[0])
    with pytest.raises(ValueError):
        random.choice(spark.range(3), 4)


def test_tapers(spark):
    for name, f in (("bartlett", np.bartlett), ("blackman", np.blackman), ("hamming", np.hamming), ("hanning", np.hanning)):
        assert [r.v for r in tapers.taper(spark, name, 9).orderBy("i").collect()] == pytest.approx(f(9).tolist())
    assert [r.v for r in tapers.taper(spark, "kaiser", 9, 5.0).orderBy("i").collect()] == pytest.approx(np.kaiser(9, 5.0).tolist())


def test_numbers():
    assert numbers.ramanujan_tau(6) == [1, -24, 252, -1472, 4830, -6048]
    assert numbers.eisenstein_series(4, 4) == [1, 240, 2160, 6720] and numbers.j_invariant(4) == [1, 744, 196884, 21493760]
    a = numbers.hensel_lift(numbers.Padic(7, 3), lambda x: x * x - numbers.Padic(7, 2), lambda x: x + x)
    assert (a * a) == numbers.Padic(7, 2)
    assert numbers.Padic(5, 50).valuation() == 2 and numbers.Padic(5, 50).norm() == 0.04
    t = numbers.Padic(5, 2).teichmuller()
    assert t * t * t * t == numbers.Padic(5, 1) and t.value % 5 == 2


def test_solvers():
    x = np.linspace(0, 2 * np.pi, 64, endpoint=False)
    dx = x[1]
    assert physics.poisson_fft(-np.sin(x), dx) == pytest.approx(np.sin(x), abs=2e-3)
    u0 = np.sin(x)
    assert physics.heat(u0, 100, 1.0, 0.001, dx) == pytest.approx(u0 * math.exp(-0.1), abs=1e-3)
    pos, vel = physics.nbody(np.array([[1.0, 0, 0], [0, 0, 0]]), np.array([[0, 1.0, 0], [0, 0, 0]]), np.array([1e-9, 1.0]), 6283, 0.001)
    assert pos[0] == pytest.approx([1, 0, 0], abs=2e-3)
    a, b = physics.navier_stokes2d(np.random.default_rng(0).normal(size=(16, 16)), np.zeros((16, 16)), 5)
    div = (np.roll(a, -1, 0) - np.roll(a, 1, 0) + np.roll(b, -1, 1) - np.roll(b, 1, 1)) / 2
    assert np.abs(div).max() < 1e-9
