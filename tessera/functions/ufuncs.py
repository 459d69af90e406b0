"""Element-wise functions: Column in, Column out, with IEEE semantics.

NaN is a value and NULL is a missing (masked) element: a NULL operand gives
NULL, a NaN operand gives what IEEE arithmetic gives.  Spark's ANSI mode stays
on; the guards here stand where Spark would raise or return NULL instead of a
float result (division and logarithms of zero), and nowhere else, so integer
overflow and integer division by zero still raise.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | float | int | bool

INF, NAN = float("inf"), float("nan")


def col(x: Value) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def dbl(x: Value) -> Column:
    return col(x).cast("double")


def either_null(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull()


# --- arithmetic

def add(a: Value, b: Value) -> Column:
    return col(a) + col(b)


def subtract(a: Value, b: Value) -> Column:
    return col(a) - col(b)


def multiply(a: Value, b: Value) -> Column:
    return col(a) * col(b)


def divide(a: Value, b: Value) -> Column:
    """True division; a float zero divisor gives a signed infinity or NaN."""
    x, y = dbl(a), dbl(b)
    sign = F.when(is_negative_zero(y), F.lit(-1.0)).otherwise(F.lit(1.0))
    by_zero = F.when(F.isnan(x) | (x == 0), F.lit(NAN)).when(x > 0, F.lit(INF) * sign).otherwise(F.lit(-INF) * sign)
    return F.when(either_null(x, y), F.lit(None).cast("double")).when(y == 0, by_zero).otherwise(x / F.when(y != 0, y))


true_divide = divide


def is_negative_zero(x: Column) -> Column:
    return (x == 0) & x.cast("string").startswith("-")


def remainder(a: Value, b: Value) -> Column:
    """Remainder with the sign of the divisor; integers raise on zero."""
    x, y = col(a), col(b)
    return ((x % y) + y) % y


def float_remainder(a: Value, b: Value) -> Column:
    x, y = dbl(a), dbl(b)
    safe = F.when(y != 0, y)
    return F.when(either_null(x, y), F.lit(None).cast("double")).otherwise(F.coalesce(((x % safe) + safe) % safe, F.lit(NAN)))


mod = remainder


def fmod(a: Value, b: Value) -> Column:
    """Remainder with the sign of the dividend; NaN for a zero divisor."""
    x, y = dbl(a), dbl(b)
    return F.when(either_null(x, y), F.lit(None).cast("double")).otherwise(F.coalesce(x % F.when(y != 0, y), F.lit(NAN)))


def floor_divide(a: Value, b: Value) -> Column:
    """Floored integer division; raises on zero."""
    x, y = col(a), col(b)
    return ((x - remainder(x, y)) / y).cast("bigint")


def float_floor_divide(a: Value, b: Value) -> Column:
    return floor(divide(a, b))


def divmod_(a: Value, b: Value) -> Column:
    return F.struct(floor_divide(a, b).alias("quotient"), remainder(a, b).alias("remainder"))


def power(a: Value, b: Value) -> Column:
    return F.pow(dbl(a), dbl(b))


float_power = power


def int_power(a: Value, b: Value) -> Column:
    """Integer power; a negative exponent truncates toward zero."""
    return F.pow(dbl(a), dbl(b)).cast("bigint")


def reciprocal(x: Value) -> Column:
    return divide(1.0, x)


def positive(x: Value) -> Column:
    return +col(x) if hasattr(Column, "__pos__") else col(x)


def negative(x: Value) -> Column:
    return -col(x)


def square(x: Value) -> Column:
    return col(x) * col(x)


def absolute(x: Value) -> Column:
    return F.abs(col(x))


fabs = abs_ = absolute


def sign(x: Value) -> Column:
    return F.when(F.isnan(dbl(x)), F.lit(NAN)).otherwise(F.signum(dbl(x)))


def fma(a: Value, b: Value, c: Value) -> Column:
    return dbl(a) * dbl(b) + dbl(c)


def gcd(a: Value, b: Value) -> Column:
    """Greatest common divisor, an Arrow batch at a time; null where either is."""

    @F.arrow_udf("bigint")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        out = np.gcd(*(pc.fill_null(c, 0).to_numpy(zero_copy_only=False) for c in (x, y)))
        return pa.array(out, pa.int64(), mask=np.asarray(pc.or_(pc.is_null(x), pc.is_null(y))))

    return run(col(a).cast("bigint"), col(b).cast("bigint"))


def lcm(a: Value, b: Value) -> Column:
    """Raises where the result has more than 64 bits."""
    g = gcd(a, b)
    part = F.call_function("div", F.abs(col(a).cast("bigint")), F.when(g != 0, g))
    return F.when(g == 0, F.lit(0).cast("bigint")).otherwise(part * F.abs(col(b).cast("bigint")))


# --- exponentials and logarithms

def exp(x: Value) -> Column:
    return F.exp(dbl(x))


def exp2(x: Value) -> Column:
    return F.pow(F.lit(2.0), dbl(x))


def expm1(x: Value) -> Column:
    return F.expm1(dbl(x))


def _logarithm(f, x: Value, edge: float) -> Column:
    v = dbl(x)
    return F.when(v.isNull(), v).when(F.isnan(v) | (v < edge), F.lit(NAN)).when(v == edge, F.lit(-INF)).otherwise(f(F.when(v > edge, v)))


def log(x: Value) -> Column:
    return _logarithm(F.ln, x, 0.0)


def log2(x: Value) -> Column:
    return _logarithm(F.log2, x, 0.0)


def log10(x: Value) -> Column:
    return _logarithm(F.log10, x, 0.0)


def log1p(x: Value) -> Column:
    return _logarithm(F.log1p, x, -1.0)


def logaddexp(a: Value, b: Value) -> Column:
    x, y = dbl(a), dbl(b)
    hi, lo = F.greatest(x, y), F.least(x, y)
    return F.when(x == y, x + F.ln(F.lit(2.0))).otherwise(hi + F.log1p(F.exp(lo - hi)))


def logaddexp2(a: Value, b: Value) -> Column:
    x, y = dbl(a), dbl(b)
    hi, lo = F.greatest(x, y), F.least(x, y)
    return F.when(x == y, x + 1.0).otherwise(hi + F.log2(1 + F.pow(F.lit(2.0), lo - hi)))


def sqrt(x: Value) -> Column:
    return F.sqrt(dbl(x))


def cbrt(x: Value) -> Column:
    return F.cbrt(dbl(x))


# --- trigonometry

def _one(f):
    return lambda x: f(dbl(x))


sin, cos, tan = _one(F.sin), _one(F.cos), _one(F.tan)
arcsin, arccos, arctan = _one(F.asin), _one(F.acos), _one(F.atan)
sinh, cosh, tanh = _one(F.sinh), _one(F.cosh), _one(F.tanh)
arcsinh, arccosh = _one(F.asinh), _one(F.acosh)
degrees = rad2deg = _one(F.degrees)
radians = deg2rad = _one(F.radians)


def arctanh(x: Value) -> Column:
    v = dbl(x)
    return F.when(v == 1, F.lit(INF)).when(v == -1, F.lit(-INF)).otherwise(F.atanh(v))


def arctan2(y: Value, x: Value) -> Column:
    return F.atan2(dbl(y), dbl(x))


def hypot(a: Value, b: Value) -> Column:
    return F.hypot(dbl(a), dbl(b))


def sinc(x: Value) -> Column:
    v = dbl(x) * F.pi()
    return F.when(v == 0, F.lit(1.0)).otherwise(F.sin(v) / F.when(v != 0, v))


def angle(re: Value, im: Value) -> Column:
    return F.atan2(dbl(im), dbl(re))


# Chebyshev coefficients of the modified Bessel function of order 0 on [0, 8] and beyond.
I0_SMALL = (
    -4.41534164647933937950e-18, 3.33079451882223809783e-17, -2.43127984654795469359e-16, 1.71539128555513303061e-15, -1.16853328779934516808e-14,
    7.67618549860493561688e-14, -4.85644678311192946090e-13, 2.95505266312963983461e-12, -1.72682629144155570723e-11, 9.67580903537323691224e-11,
    -5.18979560163526290666e-10, 2.65982372468238665035e-9, -1.30002500998624804212e-8, 6.04699502254191894932e-8, -2.67079385394061173391e-7,
    1.11738753912010371815e-6, -4.41673835845875056359e-6, 1.64484480707288970893e-5, -5.75419501008210370398e-5, 1.88502885095841655729e-4,
    -5.76375574538582365885e-4, 1.63947561694133579842e-3, -4.32430999505057594430e-3, 1.05464603945949983183e-2, -2.37374148058994688156e-2,
    4.93052842396707084878e-2, -9.49010970480476444210e-2, 1.71620901522208775349e-1, -3.04682672343198398683e-1, 6.76795274409476084995e-1,
)
I0_LARGE = (
    -7.23318048787475395456e-18, -4.83050448594418207126e-18, 4.46562142029675999901e-17, 3.46122286769746109310e-17, -2.82762398051658348494e-16,
    -3.42548561967721913462e-16, 1.77256013305652638360e-15, 3.81168066935262242075e-15, -9.55484669882830764870e-15, -4.15056934728722208663e-14,
    1.54008621752140982691e-14, 3.85277838274214270114e-13, 7.18012445138366623367e-13, -1.79417853150680611778e-12, -1.32158118404477131188e-11,
    -3.14991652796324136454e-11, 1.18891471078464383424e-11, 4.94060238822496958910e-10, 3.39623202570838634515e-9, 2.26666899049817806459e-8,
    2.04891858946906374183e-7, 2.89137052083475648297e-6, 6.88975834691682398426e-5, 3.36911647825569408990e-3, 8.04490411014108831608e-1,
)


def i0(x: Value) -> Column:
    """Modified Bessel function of the first kind, order 0 (Chebyshev series)."""
    v = F.abs(dbl(x))

    def series(at: Column, coefficients: tuple[float, ...]) -> Column:
        start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"))
        step = lambda s, k: F.struct((at * s["a"] - s["b"] + k).alias("a"), s["a"].alias("b"), s["b"].alias("c"))
        return F.aggregate(F.array(*map(F.lit, coefficients)), start, step, lambda s: (s["a"] - s["c"]) / 2)

    beyond = F.when(v > 8, v).otherwise(9.0)
    return F.when(v <= 8, F.exp(v) * series(v / 2 - 2, I0_SMALL)).otherwise(F.exp(v) * series(32 / beyond - 2, I0_LARGE) / F.sqrt(beyond))


# --- rounding and parts

def _guarded(f, x: Value) -> Column:
    v = dbl(x)
    return F.when(F.isnan(v) | (F.abs(v) >= 2.0**52), v).otherwise(f(v).cast("double"))


def floor(x: Value) -> Column:
    return _guarded(F.floor, x)


def ceil(x: Value) -> Column:
    return _guarded(F.ceil, x)


def trunc(x: Value) -> Column:
    """Toward zero; zero keeps its sign, and what lies between -1 and 0 gives -0.0."""
    return _guarded(lambda v: F.when(v == 0, v).when(v < 0, -F.floor(-v).cast("double")).otherwise(F.floor(v)), x)


fix = trunc


def rint(x: Value) -> Column:
    return F.rint(dbl(x))


def round_(x: Value, decimals: int = 0) -> Column:
    """Half to even on the scaled value."""
    scale = 10.0**decimals
    return F.rint(dbl(x) * scale) / scale


around = round_


def clip(x: Value, lo: Value | None, hi: Value | None) -> Column:
    v = col(x)
    out = v if lo is None else F.when(v < col(lo), col(lo)).otherwise(v)
    return out if hi is None else F.when(out > col(hi), F.when(is_nan(v), v).otherwise(col(hi))).otherwise(out)


def is_nan(x: Column) -> Column:
    return F.isnan(x.cast("double"))


def modf(x: Value) -> Column:
    v = dbl(x)
    whole = trunc(v)
    return F.struct(F.when(F.abs(v) == INF, F.lit(0.0)).otherwise(v - whole).alias("fraction"), whole.alias("whole"))


def frexp(x: Value) -> Column:
    """struct<mantissa in [0.5, 1), exponent>."""
    v = dbl(x)
    plain = F.isnan(v) | (v == 0) | (F.abs(v) == INF)
    e = F.floor(F.log2(F.when(~plain, F.abs(v)))).cast("int") + 1
    m = v / F.pow(F.lit(2.0), e)
    over = F.abs(m) >= 1
    under = F.abs(m) < 0.5
    e2 = F.when(over, e + 1).when(under, e - 1).otherwise(e)
    m2 = F.when(over, m / 2).when(under, m * 2).otherwise(m)
    return F.struct(F.when(plain, v).otherwise(m2).alias("mantissa"), F.when(plain, F.lit(0)).otherwise(e2).alias("exponent"))


def ldexp(m: Value, e: Value) -> Column:
    return dbl(m) * F.pow(F.lit(2.0), dbl(e))


def signbit(x: Value) -> Column:
    v = dbl(x)
    return (v < 0) | is_negative_zero(v)


def copysign(a: Value, b: Value) -> Column:
    return F.when(signbit(b), -F.abs(dbl(a))).otherwise(F.abs(dbl(a)))


def spacing(x: Value) -> Column:
    """The distance to the next double away from zero."""
    v = F.abs(dbl(x))
    e = frexp(v)["exponent"]
    return F.when(F.isnan(v) | (v == INF), F.lit(NAN)).when(v < 2.0**-1021, F.lit(5e-324)).otherwise(F.pow(F.lit(2.0), e - 53)) * F.when(signbit(x), -1.0).otherwise(1.0)


def nextafter(x: Value, toward: Value) -> Column:
    v, t = dbl(x), dbl(toward)
    up = t > v
    gap = F.abs(spacing(v))
    power_of_two = F.abs(frexp(v)["mantissa"]) == 0.5
    inward = (up & (v < 0)) | (~up & (v > 0))
    step = F.when(power_of_two & inward & (F.abs(v) > 2.0**-1021), gap / 2).otherwise(gap)
    return F.when(F.isnan(v) | F.isnan(t), F.lit(NAN)).when(v == t, t).when(up, v + step).otherwise(v - step)


def heaviside(x: Value, at_zero: Value) -> Column:
    v = dbl(x)
    return F.when(F.isnan(v), v).when(v < 0, F.lit(0.0)).when(v == 0, dbl(at_zero)).otherwise(F.lit(1.0))


def nan_to_num(x: Value, nan: float = 0.0, posinf: float = 1.7976931348623157e308, neginf: float = -1.7976931348623157e308) -> Column:
    v = dbl(x)
    return F.when(F.isnan(v), F.lit(nan)).when(v == INF, F.lit(posinf)).when(v == -INF, F.lit(neginf)).otherwise(v)


# --- extremes

def maximum(a: Value, b: Value) -> Column:
    """NaN in the first operand wins, in the second it is dropped."""
    x, y = col(a), col(b)
    return F.when(either_null(x, y), F.lit(None)).when(is_nan(x), x).when(is_nan(y), x).when(x < y, y).otherwise(x)


def minimum(a: Value, b: Value) -> Column:
    x, y = col(a), col(b)
    return F.when(either_null(x, y), F.lit(None)).when(is_nan(x), x).when(is_nan(y), x).when(y < x, y).otherwise(x)


def fmax(a: Value, b: Value) -> Column:
    x, y = col(a), col(b)
    return F.when(is_nan(x), y).when(is_nan(y), x).otherwise(F.when(either_null(x, y), F.lit(None)).otherwise(F.greatest(x, y)))


def fmin(a: Value, b: Value) -> Column:
    x, y = col(a), col(b)
    return F.when(is_nan(x), y).when(is_nan(y), x).otherwise(F.when(either_null(x, y), F.lit(None)).otherwise(F.least(x, y)))


# --- predicates and comparisons: IEEE, so NaN compares false (and != true)

def isnan(x: Value) -> Column:
    v = col(x)
    return F.when(v.isNull(), F.lit(None)).otherwise(F.isnan(v.cast("double")))


def isinf(x: Value) -> Column:
    return F.abs(dbl(x)) == INF


def isposinf(x: Value) -> Column:
    return dbl(x) == INF


def isneginf(x: Value) -> Column:
    return dbl(x) == -INF


def isfinite(x: Value) -> Column:
    v = dbl(x)
    return ~(F.isnan(v) | (F.abs(v) == INF)) & v.isNotNull()


def isnat(x: Value) -> Column:
    """The missing date."""
    return col(x).isNull()


def _ordered(a: Value, b: Value, test) -> Column:
    x, y = col(a), col(b)
    return test(x, y) & ~(F.isnan(x.cast("double")) | F.isnan(y.cast("double")))


def equal(a: Value, b: Value) -> Column:
    return _ordered(a, b, lambda x, y: x == y)


def not_equal(a: Value, b: Value) -> Column:
    return ~equal(a, b)


def less(a: Value, b: Value) -> Column:
    return _ordered(a, b, lambda x, y: x < y)


def less_equal(a: Value, b: Value) -> Column:
    return _ordered(a, b, lambda x, y: x <= y)


def greater(a: Value, b: Value) -> Column:
    return _ordered(a, b, lambda x, y: x > y)


def greater_equal(a: Value, b: Value) -> Column:
    return _ordered(a, b, lambda x, y: x >= y)


def truth(x: Value) -> Column:
    """Non-zero (NaN is true)."""
    return col(x).cast("double") != 0


def logical_and(a: Value, b: Value) -> Column:
    return truth(a) & truth(b)


def logical_or(a: Value, b: Value) -> Column:
    return truth(a) | truth(b)


def logical_xor(a: Value, b: Value) -> Column:
    return truth(a) != truth(b)


def logical_not(x: Value) -> Column:
    return ~truth(x)


def isclose(a: Value, b: Value, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    x, y = dbl(a), dbl(b)
    gap = F.abs(x - y)
    return ~F.isnan(gap) & (gap <= atol + rtol * F.abs(y)) & (F.abs(y) != INF)


# --- bits

def bitwise_and(a: Value, b: Value) -> Column:
    return col(a).bitwiseAND(col(b))


def bitwise_or(a: Value, b: Value) -> Column:
    return col(a).bitwiseOR(col(b))


def bitwise_xor(a: Value, b: Value) -> Column:
    return col(a).bitwiseXOR(col(b))


def invert(x: Value) -> Column:
    return F.bitwise_not(col(x))


bitwise_not = bitwise_invert = invert
bitwise_xor_ct = bitwise_xor


def bitwise_count(x: Value) -> Column:
    """One bits of the absolute value."""
    return F.bit_count(F.abs(col(x)))


bit_count = bitwise_count


def _shift(x: Value, n: Value, name: str, width: int) -> Column:
    v, k = col(x).cast("bigint"), col(n).cast("int")
    bad = (k < 0) | (k >= width)
    return F.when(bad, F.raise_error(F.lit(f"shift count out of range 0..{width - 1}")).cast("bigint")).otherwise(F.call_function(name, v, k))


def left_shift(x: Value, n: Value, width: int = 64) -> Column:
    """Raises for counts below 0 or not below the width."""
    return _shift(x, n, "shiftleft", width)


def right_shift(x: Value, n: Value, width: int = 64) -> Column:
    return _shift(x, n, "shiftright", width)


bitwise_left_shift, bitwise_right_shift = left_shift, right_shift


def binary_repr(x: Value, width: int | None = None) -> Column:
    """Binary digits with a minus sign, or two's complement in ``width`` digits."""
    v = col(x).cast("bigint")
    if width is None:
        return F.when(v < 0, F.concat(F.lit("-"), F.bin(-v))).otherwise(F.bin(v))
    digits = F.when(v < 0, F.substring(F.bin(v), -width, width)).otherwise(F.bin(v))
    return F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))


def base_repr(x: Value, base: int = 2) -> Column:
    return F.conv(col(x).cast("string"), 10, base)


def packbits(bits: Column, little: bool = False) -> Column:
    """Bytes (0 to 255) of an array of 0 and 1, padded with zeros at the end."""
    n = F.ceil(F.size(bits) / 8).cast("int")
    one = lambda k, j: F.coalesce(F.get(bits, (k * 8 + j).cast("int")).cast("int"), F.lit(0)) * (1 << (j if little else 7 - j))
    return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda k: reduce(lambda a, b: a + b, [one(k, j) for j in range(8)]))


def unpackbits(bytes_: Column, little: bool = False) -> Column:
    order = range(8) if little else range(7, -1, -1)
    return F.flatten(F.transform(bytes_, lambda b: F.array(*[F.shiftright(b.cast("int"), j).bitwiseAND(F.lit(1)) for j in order])))


def ct_select(cond: Value, a: Value, b: Value) -> Column:
    return F.when(col(cond), col(a)).otherwise(col(b))


# --- choice

def where(cond: Value, a: Value, b: Value) -> Column:
    return F.when(col(cond), col(a)).otherwise(col(b))


def select(conditions: list[Column], choices: list[Value], default: Value = 0) -> Column:
    """The first choice whose condition holds."""
    out = F.when(conditions[0], col(choices[0]))
    for c, v in zip(conditions[1:], choices[1:], strict=True):
        out = out.when(c, col(v))
    return out.otherwise(col(default))


def piecewise(x: Column, conditions: list[Column], functions: list, default: Value = 0) -> Column:
    """The last condition that holds decides; functions may be values or callables of x."""
    values = [f(x) if callable(f) else f for f in functions]
    return select(conditions[::-1], values[::-1], default)


def choose(index: Column, choices: list[Value], mode: str = "raise") -> Column:
    n = len(choices)
    at = {"wrap": F.pmod(index, F.lit(n)), "clip": F.greatest(F.lit(0), F.least(F.lit(n - 1), index)), "raise": index}[mode]
    return F.element_at(F.array(*map(col, choices)), (at + 1).cast("int"))


# --- complex numbers: struct<re, im>

def complex_(re: Value, im: Value = 0.0) -> Column:
    return F.struct(dbl(re).alias("re"), dbl(im).alias("im"))


def real(z: Column) -> Column:
    return z["re"]


def imag(z: Column) -> Column:
    return z["im"]


def conj(z: Column) -> Column:
    return complex_(z["re"], -z["im"])


conjugate = conj


def complex_abs(z: Column) -> Column:
    return F.hypot(z["re"], z["im"])


def complex_angle(z: Column) -> Column:
    return F.atan2(z["im"], z["re"])


def complex_add(a: Column, b: Column) -> Column:
    return complex_(a["re"] + b["re"], a["im"] + b["im"])


def complex_multiply(a: Column, b: Column) -> Column:
    return complex_(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def complex_divide(a: Column, b: Column) -> Column:
    n = b["re"] * b["re"] + b["im"] * b["im"]
    top = complex_multiply(a, conj(b))
    return complex_(divide(top["re"], n), divide(top["im"], n))


def complex_exp(z: Column) -> Column:
    m = F.exp(z["re"])
    return complex_(m * F.cos(z["im"]), m * F.sin(z["im"]))


def complex_log(z: Column) -> Column:
    return complex_(log(complex_abs(z)), complex_angle(z))


def complex_sqrt(z: Column) -> Column:
    m = complex_abs(z)
    im = F.sqrt(F.greatest((m - z["re"]) / 2, F.lit(0.0)))
    return complex_(F.sqrt(F.greatest((m + z["re"]) / 2, F.lit(0.0))), F.when(z["im"] < 0, -im).otherwise(im))


def iscomplex(z: Column) -> Column:
    return z["im"] != 0


def isreal(z: Column) -> Column:
    return z["im"] == 0


def real_if_close(z: Column, tol: float = 100) -> Column:
    return F.when(F.abs(z["im"]) < tol * 2.220446049250313e-16, z["re"])


class emath:  # noqa: N801
    """Real functions whose results may be complex: struct<re, im>."""

    @staticmethod
    def sqrt(x: Value) -> Column:
        v = dbl(x)
        return F.when(v < 0, complex_(0.0, F.sqrt(-v))).otherwise(complex_(F.sqrt(v)))

    @staticmethod
    def log(x: Value) -> Column:
        v = dbl(x)
        return complex_(log(F.abs(v)), F.when(v < 0, F.pi()).otherwise(0.0))

    @staticmethod
    def logn(n: Value, x: Value) -> Column:
        z = emath.log(x)
        return complex_(z["re"] / F.ln(dbl(n)), z["im"] / F.ln(dbl(n)))

    @staticmethod
    def log2(x: Value) -> Column:
        return emath.logn(2.0, x)

    @staticmethod
    def log10(x: Value) -> Column:
        return emath.logn(10.0, x)

    @staticmethod
    def power(x: Value, p: Value) -> Column:
        z = emath.log(x)
        k = dbl(p)
        whole = F.pow(dbl(x), k)
        return F.when((dbl(x) >= 0) | (k == F.rint(k)), complex_(whole)).otherwise(complex_exp(complex_(z["re"] * k, z["im"] * k)))

    @staticmethod
    def arcsin(x: Value) -> Column:
        v = dbl(x)
        beyond = complex_(F.signum(v) * F.pi() / 2, F.signum(v) * F.acosh(F.greatest(F.abs(v), F.lit(1.0))))
        return F.when(F.abs(v) <= 1, complex_(F.asin(v))).otherwise(beyond)

    @staticmethod
    def arccos(x: Value) -> Column:
        z = emath.arcsin(x)
        return complex_(F.pi() / 2 - z["re"], -z["im"])

    @staticmethod
    def arctanh(x: Value) -> Column:
        v = dbl(x)
        out = F.abs(v) > 1
        return complex_(F.when(out, F.atanh(1 / F.when(out, v))).otherwise(arctanh(v)), F.when(out, F.signum(v) * F.pi() / 2).otherwise(0.0))
