"""Registered queries over element-wise functions of numbers, predicates, bits,
complex numbers, texts and masked values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import tapers, text, types
from tessera.functions import ufuncs as u
from tessera.operators import aggregates as agg
from tessera.operators import masked, ordering, poly, sets
from tessera.plans.catalog import read, register
from tessera.plans.catalog_formulas import per_row

NAN, INF = float("nan"), float("inf")


class Event:
    """An event's value, a share of 1 of it, a whole number, and one that is sometimes NaN or infinite."""

    def __init__(self):
        self.v, self.i = F.col("value"), F.col("event_id").cast("bigint")
        self.x = F.col("event_id") % 97 / 100.0  # 0 to 0.96
        self.odd = F.when(self.i % 7 == 0, F.lit(NAN)).when(self.i % 7 == 1, F.lit(INF)).when(self.i % 7 == 2, F.lit(-INF)).otherwise(self.v)
        self.z = u.complex_(self.v, F.when(self.i % 3 == 0, 0.0).otherwise(self.x))


X = "(event_id % 97 / 100.0::DOUBLE)"
ODD = "CASE event_id % 7 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN '-inf'::DOUBLE ELSE value END"
IM = f"CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE {X} END"

per_row("trigonometry", "events", "event_id", [
    ("tan", lambda c: u.tan(c.x), f"tan({X})"),
    ("asin", lambda c: u.arcsin(c.x), f"asin({X})"),
    ("acos", lambda c: u.arccos(c.x), f"acos({X})"),
    ("atan", lambda c: u.arctan(c.v), "atan(value)"),
    ("deg", lambda c: u.degrees(c.v), "degrees(value)"),
    ("rad", lambda c: u.rad2deg(u.deg2rad(c.v)), "value"),
    ("sinh", lambda c: u.sinh(c.x), f"sinh({X})"),
    ("cosh", lambda c: u.cosh(c.x), f"cosh({X})"),
    ("tanh", lambda c: u.tanh(c.x), f"tanh({X})"),
    ("asinh", lambda c: u.arcsinh(c.v), "asinh(value)"),
    ("acosh", lambda c: u.arccosh(c.x + 1.5), f"acosh({X} + 1.5)"),
    ("atanh", lambda c: u.arctanh(c.x), f"atanh({X})"),
    ("expm1", lambda c: u.expm1(c.x), f"exp({X}) - 1"),
    ("exp2", lambda c: u.exp2(c.x), f"pow(2, {X})"),
    ("log10", lambda c: u.log10(c.x + 3), f"log10({X} + 3)"),
    ("log2", lambda c: u.log2(c.x + 3), f"log2({X} + 3)"),
    ("lae", lambda c: u.logaddexp(c.x, c.x * 3), f"ln(exp({X}) + exp({X} * 3))"),
    ("sinc", lambda c: u.sinc(c.x), f"CASE WHEN {X} = 0 THEN 1.0 ELSE sin(pi() * {X}) / (pi() * {X}) END"),
    ("angle", lambda c: u.angle(c.v, c.x), f"atan2({X}, value)"),
    ("bessel", lambda c: u.i0(c.x * 3), f"list_sum(list_transform(range(0, 24), lambda k: pow({X} * 1.5, 2 * k) / (gamma(k + 1) * gamma(k + 1))))"),
], Event)

per_row("arithmetic", "events", "event_id", [
    ("=sq", lambda c: u.square(c.i), "CAST(event_id * event_id AS BIGINT)"),
    ("pw", lambda c: u.power(c.v + 1, 1.5), "pow(value + 1, 1.5)"),
    ("fpw", lambda c: u.float_power(c.i, 0.5), "sqrt(event_id)"),
    ("=rint", lambda c: u.rint(c.v), "round_even(value, 0)"),
    ("=rnd", lambda c: u.round_(c.i / 4, 0) + u.around(c.i / 8, 0), "round_even(event_id / 4, 0) + round_even(event_id / 8, 0)"),
    ("=ab", lambda c: F.round(u.absolute(c.v - 50) + u.fabs(50 - c.v) + u.abs_(c.v), 6), "round(abs(value - 50) * 2 + abs(value), 6)"),
    ("=fmx", lambda c: u.fmax(c.odd, 3.0), f"CASE WHEN isnan({ODD}) THEN 3.0 ELSE greatest({ODD}, 3.0) END"),
    ("=fmn", lambda c: u.fmin(c.odd, 3.0), f"CASE WHEN isnan({ODD}) THEN 3.0 ELSE least({ODD}, 3.0) END"),
    ("=fmd", lambda c: u.fmod(-c.i, 7).cast("bigint"), "-(event_id % 7)"),
    ("rec", lambda c: u.reciprocal(c.v + 1), "1 / (value + 1)"),
    ("=pos", lambda c: u.positive(c.i), "event_id"),
    ("=neg", lambda c: u.negative(c.i), "-event_id"),
    ("=sub", lambda c: u.subtract(c.i, 3), "event_id - 3"),
    ("=mul", lambda c: u.multiply(c.i, 3), "event_id * 3"),
    ("=cps", lambda c: u.copysign(c.v, 50 - c.v), "CASE WHEN value > 50 THEN -abs(value) ELSE abs(value) END"),
    ("=n2n", lambda c: u.nan_to_num(c.odd, 1.0, 2.0, 3.0), "CASE event_id % 7 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 WHEN 2 THEN 3.0 ELSE value END"),
    ("fma", lambda c: u.fma(c.v, 2.0, 1.0), "value * 2 + 1"),
    ("=fix", lambda c: u.fix(50 - c.v), "trunc(50 - value)"),
    ("mant", lambda c: u.frexp(c.v + 1)["mantissa"], "(value + 1) / pow(2, floor(log2(value + 1)) + 1)"),
    ("=exp_", lambda c: u.frexp(c.v + 1)["exponent"].cast("bigint"), "CAST(floor(log2(value + 1)) + 1 AS BIGINT)"),
    ("ldx", lambda c: u.ldexp(c.v, 5), "value * 32"),
    ("gap", lambda c: u.spacing(c.v + 1), "pow(2, floor(log2(value + 1)) - 52)"),
    ("=after", lambda c: u.nextafter(c.v, 1000.0) > c.v, "nextafter(value, 1000.0::DOUBLE) > value"),
    ("=quot", lambda c: u.divmod_(c.i, 7)["quotient"].cast("bigint"), "CAST(event_id // 7 AS BIGINT)"),
    ("=rest", lambda c: u.divmod_(c.i, 7)["remainder"].cast("bigint"), "CAST(event_id % 7 AS BIGINT)"),
], Event)

per_row("complex_numbers", "events", "event_id", [
    ("re", lambda c: u.real(c.z), "value"),
    ("im", lambda c: u.imag(c.z), IM),
    ("cj", lambda c: u.conj(c.z)["im"] + u.conjugate(c.z)["im"], f"-2 * ({IM})"),
    ("mod", lambda c: u.complex_abs(c.z), f"sqrt(value * value + ({IM}) * ({IM}))"),
    ("arg", lambda c: u.complex_angle(c.z), f"atan2({IM}, value)"),
    ("=cpx", lambda c: u.iscomplex(c.z), f"({IM}) <> 0"),
    ("=rl", lambda c: u.isreal(c.z), f"({IM}) = 0"),
    ("=close", lambda c: u.real_if_close(c.z), f"CASE WHEN ({IM}) = 0 THEN value END"),
    ("sqim", lambda c: u.emath.sqrt(-c.v)["im"], "sqrt(value)"),
    ("lgre", lambda c: u.emath.log(-c.v - 1)["re"] + u.emath.log(-c.v - 1)["im"], "ln(value + 1) + pi()"),
    ("lg2", lambda c: u.emath.log2(-c.v - 1)["im"] + u.emath.log2(c.v + 1)["re"], "pi() / ln(2) + log2(value + 1)"),
    ("lg10", lambda c: u.emath.log10(-c.v - 1)["im"] + u.emath.log10(c.v + 1)["re"], "pi() / ln(10) + log10(value + 1)"),
    ("lgn", lambda c: u.emath.logn(3, c.v + 4)["re"], "ln(value + 4) / ln(3)"),
    ("pw", lambda c: u.emath.power(-c.v - 1, 0.5)["im"] + u.emath.power(c.v, 2)["re"], "sqrt(value + 1) + value * value"),
    ("as_", lambda c: u.emath.arcsin(c.x)["re"] + u.emath.arcsin(c.x + 2)["im"], f"asin({X}) + acosh({X} + 2)"),
    ("ac", lambda c: u.emath.arccos(c.x)["re"] - u.emath.arccos(c.x + 2)["im"], f"acos({X}) + acosh({X} + 2)"),
    ("at", lambda c: u.emath.arctanh(c.x)["re"] + u.emath.arctanh(c.x + 2)["im"], f"atanh({X}) + pi() / 2"),
], Event)

per_row("predicates", "events", "event_id", [
    ("=fin", lambda c: u.isfinite(c.odd), "event_id % 7 > 2"),
    ("=inf", lambda c: u.isinf(c.odd), "event_id % 7 IN (1, 2)"),
    ("=nat", lambda c: u.isnat(F.when(c.i % 2 == 0, F.current_date())), "event_id % 2 = 1"),
    ("=land", lambda c: u.logical_and(c.i % 2, c.i % 3), "event_id % 2 <> 0 AND event_id % 3 <> 0"),
    ("=lor", lambda c: u.logical_or(c.i % 2, c.i % 3), "event_id % 2 <> 0 OR event_id % 3 <> 0"),
    ("=lxor", lambda c: u.logical_xor(c.i % 2, c.i % 3), "(event_id % 2 <> 0) <> (event_id % 3 <> 0)"),
    ("=lnot", lambda c: u.logical_not(c.i % 3), "event_id % 3 = 0"),
    ("=gt", lambda c: u.greater(c.odd, 40.0), "event_id % 7 = 1 OR (event_id % 7 > 2 AND value > 40)"),
    ("=ge", lambda c: u.greater_equal(c.odd, 40.0), "event_id % 7 = 1 OR (event_id % 7 > 2 AND value >= 40)"),
    ("=lt", lambda c: u.less(c.odd, 40.0), "event_id % 7 = 2 OR (event_id % 7 > 2 AND value < 40)"),
    ("=le", lambda c: u.less_equal(c.odd, 40.0), "event_id % 7 = 2 OR (event_id % 7 > 2 AND value <= 40)"),
    ("=eq", lambda c: u.equal(c.odd, c.odd), "event_id % 7 <> 0"),
    ("=ne", lambda c: u.not_equal(c.odd, c.odd), "event_id % 7 = 0"),
    ("=inv", lambda c: u.invert(c.i), "~event_id"),
    ("=bnot", lambda c: u.bitwise_not(c.i) + u.bitwise_invert(c.i), "~event_id + ~event_id"),
    ("=xct", lambda c: u.bitwise_xor_ct(c.i, 5), "xor(event_id, 5)"),
    ("=pack", lambda c: F.element_at(u.packbits(F.transform(F.sequence(F.lit(7), F.lit(0)), lambda k: F.getbit(c.i, k))), 1).cast("bigint"), "event_id % 256"),
    ("=unpack", lambda c: F.array_join(u.unpackbits(F.array(c.i % 256)).cast("array<string>"), ""), "lpad(to_base(event_id % 256, 2), 8, '0')"),
    ("=sel", lambda c: u.ct_select(c.i % 2 == 0, c.i, 0), "CASE WHEN event_id % 2 = 0 THEN event_id ELSE 0 END"),
    ("=hex", lambda c: u.base_repr(c.i, 16), "upper(to_base(event_id, 16))"),
    ("=pw", lambda c: u.piecewise(c.v, [c.v < 50, c.v < 10], [1.0, lambda x: x, 2.0][:2], 2.0), "CASE WHEN value < 10 THEN value WHEN value < 50 THEN 1.0 ELSE 2.0 END"),
], Event)


class Customer:
    def __init__(self):
        self.n, self.m, self.k = F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey")
        self.mixed = F.concat(F.lower(F.substring("c_mktsegment", 1, 3)), F.substring("c_mktsegment", 4, 99))
        self.blank = F.concat(F.lit("  \t"), F.col("c_name"), F.lit(" \n"))
        self.lines = F.concat_ws("\n", "c_name", "c_mktsegment", F.lit("x\ty"))


MIXED = "lower(substr(c_mktsegment, 1, 3)) || substr(c_mktsegment, 4)"
per_row("text_functions", "customer", "c_custkey", [
    ("=ls", lambda c: text.lstrip(c.blank), "c_name || ' ' || chr(10)"),
    ("=rs", lambda c: text.rstrip(c.blank), "'  ' || chr(9) || c_name"),
    ("=swap", lambda c: text.swapcase(c.mixed), "upper(substr(c_mktsegment, 1, 3)) || lower(substr(c_mktsegment, 4))"),
    ("=ttl", lambda c: text.title(F.concat_ws(" ", c.mixed, c.m)), "upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' ' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2))"),
    ("=rj", lambda c: text.rjust(c.m, 12, "*"), "lpad(c_mktsegment, CAST(greatest(12, length(c_mktsegment)) AS INT), '*')"),
    ("=eq", lambda c: text.equal(c.m, F.lit("BUILDING")), "c_mktsegment = 'BUILDING'"),
    ("=ne", lambda c: text.not_equal(c.m, F.lit("BUILDING")), "c_mktsegment <> 'BUILDING'"),
    ("=lt", lambda c: text.less(c.m, F.lit("FURNITURE")), "c_mktsegment < 'FURNITURE'"),
    ("=le", lambda c: text.less_equal(c.m, F.lit("FURNITURE")), "c_mktsegment <= 'FURNITURE'"),
    ("=gt", lambda c: text.greater(c.m, F.lit("FURNITURE")), "c_mktsegment > 'FURNITURE'"),
    ("=ge", lambda c: text.greater_equal(c.m, F.lit("FURNITURE")), "c_mktsegment >= 'FURNITURE'"),
    ("=cmp", lambda c: text.compare(c.m, F.lit("FURNITURE"), ">="), "c_mktsegment >= 'FURNITURE'"),
    ("=ends", lambda c: text.endswith(c.m, "ING"), "c_mktsegment LIKE '%ING'"),
    ("=alnum", lambda c: text.isalnum(c.m), "regexp_full_match(c_mktsegment, '[A-Za-z0-9]+')"),
    ("=digit", lambda c: text.isdigit(F.substring(c.n, -3, 3)), "true"),
    ("=decimal", lambda c: text.isdecimal(c.n), "false"),
    ("=numeric", lambda c: text.isnumeric(c.k.cast("string")), "true"),
    ("=low", lambda c: text.islower(c.mixed) | text.islower(F.lower(c.m)), "true"),
    ("=space", lambda c: text.isspace(F.substring(c.blank, 1, 3)), "true"),
    ("=ttl_", lambda c: text.istitle(c.m), "false"),
    ("=tabs", lambda c: text.expandtabs(F.concat(c.m, F.lit("\tz")), 4), "c_mktsegment || repeat(' ', 4 - length(c_mktsegment) % 4) || 'z'"),
    ("=rp", lambda c: F.concat_ws("|", text.rpartition(c.n, "0")), "CASE WHEN strpos(c_name, '0') = 0 THEN '||' || c_name ELSE substr(c_name, 1, length(c_name) - strpos(reverse(c_name), '0')) || '|0|' || substr(c_name, length(c_name) - strpos(reverse(c_name), '0') + 2) END"),
    ("=ix", lambda c: text.index(c.n, "#").cast("bigint"), "strpos(c_name, '#') - 1"),
    ("=rix", lambda c: text.rindex(c.n, "#").cast("bigint"), "length(c_name) - strpos(reverse(c_name), '#')"),
    ("=rsp", lambda c: F.concat_ws("|", text.rsplit(c.n, "#", 1)), "replace(c_name, '#', '|')"),
    ("=nl", lambda c: F.concat_ws("|", text.splitlines(c.lines)), "c_name || '|' || c_mktsegment || '|x' || chr(9) || 'y'"),
    ("=tr", lambda c: text.translate(c.m, "AEI", "aei"), "translate(c_mktsegment, 'AEI', 'aei')"),
    ("=enc", lambda c: text.decode(text.encode(c.m)), "c_mktsegment"),
    ("=byt", lambda c: F.hex(text.encode(c.m)), "hex(encode(c_mktsegment))"),
    ("=mul", lambda c: text.multiply(c.m, 3), "repeat(c_mktsegment, 3)"),
], Customer)


class Masked:
    """A value that is masked (null) in every fifth row."""

    def __init__(self):
        self.v, self.w, self.i = F.col("value"), F.when(F.col("event_id") % 5 != 0, F.col("value")), F.col("event_id")
        self.odd = F.when(self.i % 7 == 0, F.lit(NAN)).otherwise(self.v)
        self.t = F.col("user_id")


per_row("masked_values", "events", "event_id", [
    ("=w", lambda c: masked.masked_where(c.i % 5 == 0, c.v), "CASE WHEN event_id % 5 <> 0 THEN value END"),
    ("=eq", lambda c: masked.masked_equal(c.t, 3), "nullif(user_id, 3)"),
    ("=vals", lambda c: masked.masked_values(c.t, 3), "nullif(user_id, 3)"),
    ("=obj", lambda c: masked.masked_object(c.t, 4), "nullif(user_id, 4)"),
    ("=ne", lambda c: masked.masked_not_equal(c.t, 3), "CASE WHEN user_id = 3 THEN 3 END"),
    ("=gt", lambda c: masked.masked_greater(c.v, 50), "CASE WHEN value <= 50 THEN value END"),
    ("=ge", lambda c: masked.masked_greater_equal(c.v, 50), "CASE WHEN value < 50 THEN value END"),
    ("=lt", lambda c: masked.masked_less(c.v, 50), "CASE WHEN value >= 50 THEN value END"),
    ("=le", lambda c: masked.masked_less_equal(c.v, 50), "CASE WHEN value > 50 THEN value END"),
    ("=bad", lambda c: masked.masked_invalid(c.odd), "CASE WHEN event_id % 7 <> 0 THEN value END"),
    ("=fix", lambda c: masked.fix_invalid(c.odd, -1.0), "CASE WHEN event_id % 7 <> 0 THEN value ELSE -1.0 END"),
    ("=mask", lambda c: masked.getmask(c.w), "event_id % 5 = 0"),
    ("=arr", lambda c: masked.getmaskarray(c.w) & masked.is_masked(c.w), "event_id % 5 = 0"),
    ("=either", lambda c: masked.mask_or(c.i % 2 == 0, c.i % 3 == 0), "event_id % 2 = 0 OR event_id % 3 = 0"),
    ("=fill", lambda c: masked.filled(c.w, -2.0), "CASE WHEN event_id % 5 <> 0 THEN value ELSE -2.0 END"),
    ("=default_", lambda c: masked.filled(c.w), f"CASE WHEN event_id % 5 <> 0 THEN value ELSE {masked.default_fill_value('double')!r}::DOUBLE END"),
], Masked)


@register("""
WITH e AS (SELECT event_type, event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS v FROM events), m AS (SELECT event_type, avg(v) AS a FROM e GROUP BY 1)
SELECT e.event_type, event_id, round(v - a, 6) AS anom FROM e JOIN m ON e.event_type = m.event_type WHERE v IS NOT NULL
""")
def masked_anomalies(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_type", "event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("v"))
    return masked.compressed(rows.withColumn("anom", masked.anom(F.col("v"), ["event_type"])), "v").select("event_type", "event_id", F.round("anom", 6).alias("anom"))


@register("""
SELECT user_id, list_aggregate(list(v ORDER BY ts, event_id), 'sum') IS NOT NULL AS some, round(sum(v), 4) AS s, round(product(1 + v / 1e4), 8) AS p, count(v) AS n, round(avg(v), 6) AS m, round(var_pop(v), 6) AS var, round(stddev_pop(v), 6) AS sd, min(v) AS lo, max(v) AS hi
FROM (SELECT user_id, ts, event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS v FROM events) GROUP BY 1
""")
def masked_reductions(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 5 != 0, F.col("value")))
    return rows.groupBy("user_id").agg(
        (masked.count("v") > 0).alias("some"), F.round(masked.sum_("v"), 4).alias("s"), F.round(masked.prod(1 + F.col("v") / 1e4), 8).alias("p"), masked.count("v").alias("n"), F.round(masked.mean("v"), 6).alias("m"),
        F.round(masked.var("v"), 6).alias("var"), F.round(masked.std("v"), 6).alias("sd"), masked.min_("v").alias("lo"), masked.max_("v").alias("hi"),
    )


@register("""
SELECT event_type, round(product(1 + v / 1e4), 8) AS prod, round(stddev_pop(v), 6) AS sd, round(quantile_cont(v, 0.3), 6) AS q, round(quantile_cont(v, 0.3), 6) AS p,
  min(event_id) FILTER (WHERE v = lo) AS first_least, min(event_id) FILTER (WHERE v = hi) AS first_most
FROM (SELECT *, min(v) OVER (PARTITION BY event_type) AS lo, max(v) OVER (PARTITION BY event_type) AS hi FROM (SELECT event_type, event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events)) GROUP BY 1
""")
def nan_statistics_more(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 7 == 0, F.lit(NAN)).otherwise(F.col("value")))
    return rows.groupBy("event_type").agg(
        F.round(agg.nanprod(1 + F.col("v") / 1e4), 8).alias("prod"), F.round(agg.nanstd("v"), 6).alias("sd"), F.round(agg.nanquantile("v", 0.3), 6).alias("q"), F.round(agg.nanpercentile("v", 30), 6).alias("p"),
        agg.nanargmin("event_id", "v").alias("first_least"), agg.nanargmax("event_id", "v").alias("first_most"),
    )


@register("""
SELECT event_id, round(sum(CASE WHEN event_id % 7 <> 0 THEN value ELSE 0 END) OVER w, 4) AS ncs, round(product(CASE WHEN event_id % 7 <> 0 THEN 1 + value / 1e4 ELSE 1 END) OVER w, 8) AS ncp, round(product(1 + value / 1e4) OVER w, 8) AS cp
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
""")
def running_products(spark, sf_dir):
    by, order = ["user_id"], ["ts", "event_id"]
    gap = F.col("event_id") % 7 == 0
    return read(spark, sf_dir, "events").select(
        "event_id", F.round(ordering.nancumsum(F.when(gap, F.lit(NAN)).otherwise(F.col("value")), by, order), 4).alias("ncs"),
        F.round(ordering.nancumprod(F.when(gap, F.lit(NAN)).otherwise(1 + F.col("value") / 1e4), by, order), 8).alias("ncp"), F.round(ordering.cumprod(1 + F.col("value") / 1e4, by, order), 8).alias("cp"),
    )


@register("SELECT p_size AS v, count(*) AS count FROM part GROUP BY 1")
def unique_counts_of_sizes(spark, sf_dir):
    return sets.unique_counts(read(spark, sf_dir, "part"), "p_size").select("v", "count")


BASES = {"Polynomial": "x", "Chebyshev": "cos({k} * acos(x))", "Legendre": "", "Laguerre": "", "Hermite": "", "HermiteE": ""}
# Coefficients 1, 2, 3, 4 in each basis, written out in powers of x.
WRITTEN_OUT = {
    "Polynomial": "1 + 2 * x + 3 * x * x + 4 * x * x * x",
    "Chebyshev": "1 + 2 * x + 3 * (2 * x * x - 1) + 4 * (4 * x * x * x - 3 * x)",
    "Legendre": "1 + 2 * x + 3 * (3 * x * x - 1) / 2 + 4 * (5 * x * x * x - 3 * x) / 2",
    "Laguerre": "1 + 2 * (1 - x) + 3 * (x * x - 4 * x + 2) / 2 + 4 * (-x * x * x + 9 * x * x - 18 * x + 6) / 6",
    "Hermite": "1 + 2 * (2 * x) + 3 * (4 * x * x - 2) + 4 * (8 * x * x * x - 12 * x)",
    "HermiteE": "1 + 2 * x + 3 * (x * x - 1) + 4 * (x * x * x - 3 * x)",
}
# Their derivatives, and their integrals from 0.
SLOPES = {
    "Polynomial": "2 + 6 * x + 12 * x * x",
    "Chebyshev": "2 + 12 * x + 4 * (12 * x * x - 3)",
    "Legendre": "2 + 9 * x + 2 * (15 * x * x - 3)",
    "Laguerre": "-2 + 3 * (x - 2) + 4 * (-3 * x * x + 18 * x - 18) / 6",
    "Hermite": "4 + 24 * x + 4 * (24 * x * x - 12)",
    "HermiteE": "2 + 6 * x + 4 * (3 * x * x - 3)",
}
AREAS = {
    "Polynomial": "x + pow(x, 2) + pow(x, 3) + pow(x, 4)",
    "Chebyshev": "x + pow(x, 2) + 2 * pow(x, 3) - 3 * x + 4 * pow(x, 4) - 6 * pow(x, 2)",
    "Legendre": "x + pow(x, 2) + (pow(x, 3) - x) * 1.5 + 2.5 * pow(x, 4) - 3 * pow(x, 2)",
    "Laguerre": "x + 2 * x - pow(x, 2) + 1.5 * (pow(x, 3) / 3 - 2 * pow(x, 2) + 2 * x) + (-pow(x, 4) / 4 + 3 * pow(x, 3) - 9 * pow(x, 2) + 6 * x) * 4 / 6",
    "Hermite": "x + 2 * pow(x, 2) + 4 * pow(x, 3) - 6 * x + 8 * pow(x, 4) - 24 * pow(x, 2)",
    "HermiteE": "x + pow(x, 2) + pow(x, 3) - 3 * x + pow(x, 4) - 6 * pow(x, 2)",
}


class Point:
    """A discount from 0 to 0.1, as a place at which series are evaluated."""

    def __init__(self):
        self.x = F.col("p_size") / 50.0


def _series(kind: str):
    make = getattr(poly, kind)
    at = lambda sql: "(" + sql.replace("x", "(p_size / 50.0::DOUBLE)") + ")"
    s = lambda: make([1.0, 2.0, 3.0, 4.0])
    value, slope, area = at(WRITTEN_OUT[kind]), at(SLOPES[kind]), at(AREAS[kind])
    return [
        ("val", lambda c: s().val(c.x), value),
        ("deriv", lambda c: s().deriv().val(c.x), slope),
        ("integ", lambda c: s().integ().val(c.x) - s().integ().val(F.lit(0.0)) + 20, f"{area} + 20"),
        ("plus", lambda c: (s() + s()).val(c.x) - (s() - s().copy()).val(c.x), f"2 * {value}"),
        ("times", lambda c: (s() * s()).val(c.x) + 1, f"{value} * {value} + 1"),
        ("cast_", lambda c: s().convert(poly.Polynomial).val(c.x), value),
        ("back", lambda c: s().convert(poly.Chebyshev).convert(make).val(c.x), value),
        ("trim", lambda c: make([1.0, 2.0, 3.0, 4.0, 0.0, 0.0]).trim().val(c.x), value),
        ("cut", lambda c: make([1.0, 2.0, 3.0, 4.0, 5.0]).truncate(4).val(c.x), value),
        ("cutoff", lambda c: make([1.0, 2.0, 3.0, 4.0, 5.0]).cutoff(3).val(c.x), value),
        ("ident", lambda c: make.identity().val(c.x) + 1, at("x + 1")),
        ("basis", lambda c: make([1.0, 2.0]).val(c.x) + sum((make.basis(k).val(c.x) * v for k, v in ((2, 3.0), (3, 4.0))), F.lit(0.0)), value),
        ("zeros", lambda c: make.fromroots([0.5, -1.0, 2.0]).val(c.x) + 9, at("(x - 0.5) * (x + 1) * (x - 2) + 9")),
        ("=deg", lambda c: F.lit(s().degree()), "3"),
        ("=same", lambda c: F.lit(s().has_samecoef(s().copy()) and s().has_samedomain(s()) and s().has_samewindow(s()) and s().has_sametype(s()) and s().has_samepars(s())), "true"),
        ("=parms", lambda c: F.lit(float(s().mapparms()[1])), "1.0::DOUBLE"),
        ("=root", lambda c: F.round(F.lit(float(sorted(make.fromroots([0.5, -1.0, 2.0]).roots().real)[1])), 6), "0.5::DOUBLE"),
        ("=ends", lambda c: F.lit(float(s().linspace(5)[0][-1] - s().linspace(5)[0][0])), "1.0::DOUBLE" if kind == "Laguerre" else "2.0::DOUBLE"),
    ]


for _kind in WRITTEN_OUT:
    per_row(f"series_{_kind.lower()}", "part", "p_partkey", _series(_kind), Point)

per_row("polynomials", "part", "p_partkey", [
    ("=add", lambda c: F.array(*map(F.lit, poly.polyadd([1.0, 2.0], [3.0, 4.0, 5.0]))).cast("string"), "'[3.0, 5.0, 7.0]'"),
    ("=sub", lambda c: F.array(*map(F.lit, poly.polysub([1.0, 2.0], [3.0, 4.0, 5.0]))).cast("string"), "'[-3.0, -3.0, -3.0]'"),
    ("=mul", lambda c: F.array(*map(F.lit, poly.polymul([1.0, 2.0], [3.0, 4.0]))).cast("string"), "'[3.0, 10.0, 8.0]'"),
    ("=div", lambda c: F.array(*map(F.lit, poly.polydiv([3.0, 10.0, 8.0], [1.0, 2.0])[0])).cast("string"), "'[3.0, 4.0]'"),
    ("=der", lambda c: F.array(*map(F.lit, poly.polyder([3.0, 10.0, 8.0]))).cast("string"), "'[6.0, 10.0]'"),
    ("=int_", lambda c: F.array(*map(F.lit, poly.polyint([6.0, 10.0]))).cast("string"), "'[3.0, 10.0, 0.0]'"),
    ("at", lambda c: poly.polyval(poly.poly([1.0, -2.0]), c.x) + 3, "(p_size / 50.0::DOUBLE - 1) * (p_size / 50.0::DOUBLE + 2) + 3"),
    ("p1", lambda c: poly.poly1d([1.0, 2.0, 3.0]).deriv()(c.x) + poly.poly1d([1.0, 2.0, 3.0]).integ()(c.x), "2 * (p_size / 50.0::DOUBLE) + 2 + pow(p_size / 50.0::DOUBLE, 3) / 3 + pow(p_size / 50.0::DOUBLE, 2) + 3 * (p_size / 50.0::DOUBLE)"),
    ("=order", lambda c: F.lit(poly.poly1d([1.0, 2.0, 3.0]).order), "2"),
    ("=roots", lambda c: F.round(F.lit(float(max(poly.roots([1.0, -3.0, 2.0]).real) + max(poly.poly1d([1.0, -3.0, 2.0]).r.real))), 6), "4.0::DOUBLE"),
    ("mapped", lambda c: poly.mapdomain(c.x, (0.0, 1.0), (10.0, 30.0)), "10 + 20 * (p_size / 50.0::DOUBLE)"),
    ("vander", lambda c: F.aggregate(poly.polyvander(c.x, 3), F.lit(0.0), lambda s, v: s + v), "1 + (p_size / 50.0::DOUBLE) + pow(p_size / 50.0::DOUBLE, 2) + pow(p_size / 50.0::DOUBLE, 3)"),
], Point)


TYPES = [("int8", "uint8"), ("int32", "float32"), ("int64", "uint64"), ("float32", "float64"), ("bool", "int16"), ("float64", "complex128")]


@register("""
SELECT * FROM (VALUES ('int8', 'uint8', 'uint8', false, 1, true, true, false, false, false), ('int32', 'float32', 'float32', true, 4, true, true, false, false, false), ('int64', 'uint64', 'uint64', false, 8, true, true, false, false, false),
  ('float32', 'float64', 'float64', true, 4, false, false, true, false, false), ('bool', 'int16', 'int16', true, 1, false, false, false, false, true), ('float64', 'complex128', 'complex128', true, 8, false, false, true, false, false))
  t(a, b, promoted, safe, size, whole, signed, floating, complex_, bool_)
""")
def type_rules(spark, sf_dir):
    rows = []
    for a, b in TYPES:
        assert types.promote_types(a, b) == types.result_type(a, b) == types.find_common_type(a, b) == types.common_type(a, b)
        rows.append((a, b, types.promote_types(a, b), types.can_cast(a, b), types.dtype_size(a), types.dtype_is_integer(a), types.dtype_is_signed(a), types.dtype_is_floating(a), types.dtype_is_complex(a), types.dtype_is_bool(a)))
    return spark.createDataFrame(rows, "a string, b string, promoted string, safe boolean, size int, whole boolean, signed boolean, floating boolean, complex_ boolean, bool_ boolean")


@register("SELECT CAST(i AS BIGINT) AS i, round(list_sum(list_transform(range(0, 30), lambda k: pow(7.0 * sqrt(greatest(1 - pow(2.0 * i / 15 - 1, 2), 0)), 2 * k) / (pow(4, k) * gamma(k + 1) * gamma(k + 1)))) / list_sum(list_transform(range(0, 30), lambda k: pow(7.0, 2 * k) / (pow(4, k) * gamma(k + 1) * gamma(k + 1)))), 6) AS v FROM range(16) t(i)")
def kaiser_taper(spark, sf_dir):
    return spark.range(16).select(F.col("id").alias("i"), F.round(tapers.kaiser(F.col("id"), 16, 7.0), 6).alias("v"))
