"""The registered queries of the array engine, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import calendar, random, tapers, text
from tessera.functions import ufuncs as u
from tessera.functions.expr import Form, Formula
from tessera.operators import aggregates as agg
from tessera.operators import fft, grid, linalg, masked, ordering, poly, sets
from tessera.streaming import events as spikes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c):
    return F.round(c, 6)


def rounded(c, decimals: int):
    """c to some decimals by rounding the scaled double half away from zero, as the SQL
    does.  Spark's round goes by the shortest text of c instead, and so takes a double just
    below a half, like 0.5046875 (323/640), for one."""
    scale = 10.0**decimals
    return F.round(c * scale) / scale


def revenue():
    return u.multiply(F.col("l_extendedprice"), 1 - F.col("l_discount"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats_by_group(spark, sf_dir)


# ------------------------------------------------------------------ reductions and statistics


@register("""
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 6) AS sum_qty, round(avg(l_extendedprice * (1 - l_discount)), 4) AS mean_revenue,
  round(var_pop(l_quantity), 6) AS var_qty, round(stddev_pop(l_quantity), 6) AS std_qty, round(var_samp(l_quantity), 6) AS var1_qty,
  min(l_quantity) AS min_qty, max(l_quantity) AS max_qty, max(l_quantity) - min(l_quantity) AS ptp_qty,
  round(quantile_cont(l_quantity, 0.5), 6) AS median_qty, round(quantile_cont(l_extendedprice, 0.25), 6) AS p25_price, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90_price
FROM lineitem GROUP BY 1, 2
""")
def stats_by_group(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), r6(agg.sum_("l_quantity")).alias("sum_qty"), F.round(agg.mean(revenue()), 4).alias("mean_revenue"),
        r6(agg.var("l_quantity")).alias("var_qty"), r6(agg.std("l_quantity")).alias("std_qty"), r6(agg.var("l_quantity", 1)).alias("var1_qty"),
        agg.min_("l_quantity").alias("min_qty"), agg.max_("l_quantity").alias("max_qty"), agg.ptp("l_quantity").alias("ptp_qty"),
        r6(agg.median("l_quantity")).alias("median_qty"), r6(agg.percentile("l_extendedprice", 25)).alias("p25_price"), r6(agg.quantile("l_extendedprice", 0.9)).alias("p90_price"),
    )


@register("""
SELECT o_orderstatus, round(sum(o_totalprice * o_custkey) / sum(o_custkey), 4) AS weighted, bool_and(o_totalprice <> 0) AS all_set, bool_or(o_custkey = 0) AS any_zero,
  count(*) FILTER (WHERE o_custkey <> 0) AS nonzero
FROM orders GROUP BY 1
""")
def average_all_any(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(
        F.round(agg.average("o_totalprice", "o_custkey"), 4).alias("weighted"), agg.all_("o_totalprice").alias("all_set"),
        agg.any_((F.col("o_custkey") == 0).cast("int")).alias("any_zero"), agg.count_nonzero("o_custkey").alias("nonzero"),
    )


@register("""
WITH r AS (SELECT l_returnflag, l_orderkey * 10 + l_linenumber AS i, l_extendedprice AS v FROM lineitem),
m AS (SELECT l_returnflag, max(v) AS hi, min(v) AS lo FROM r GROUP BY 1)
SELECT r.l_returnflag, min(i) FILTER (WHERE v = hi) AS argmax, min(i) FILTER (WHERE v = lo) AS argmin FROM r JOIN m ON r.l_returnflag = m.l_returnflag GROUP BY 1
""")
def argmax_argmin(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("i", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return rows.groupBy("l_returnflag").agg(agg.argmax("i", "l_extendedprice").alias("argmax"), agg.argmin("i", "l_extendedprice").alias("argmin"))


@register("""
SELECT event_type, round(sum(v), 4) AS s, round(avg(v), 6) AS m, round(var_pop(v), 6) AS var, min(v) AS lo, max(v) AS hi, round(quantile_cont(v, 0.5), 6) AS med
FROM (SELECT event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events) GROUP BY 1
""")
def nan_statistics(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return rows.groupBy("event_type").agg(
        F.round(agg.nansum("v"), 4).alias("s"), r6(agg.nanmean("v")).alias("m"), r6(agg.nanvar("v")).alias("var"),
        agg.nanmin("v").alias("lo"), agg.nanmax("v").alias("hi"), r6(agg.nanmedian("v")).alias("med"),
    )


@register("""
WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
c AS (SELECT least(CAST(floor((l_extendedprice - lo) / ((hi - lo) / 10)) AS BIGINT), 9) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1)
SELECT CAST(g.bin AS BIGINT) AS bin, round(lo + g.bin * ((hi - lo) / 10), 4) AS lo, round(lo + (g.bin + 1) * ((hi - lo) / 10), 4) AS hi, coalesce(n, 0) AS count
FROM (SELECT unnest(range(10)) AS bin) g CROSS JOIN b LEFT JOIN c ON g.bin = c.bin
""")
def histogram(spark, sf_dir):
    h = agg.histogram(read(spark, sf_dir, "lineitem"), "l_extendedprice", 10)
    return h.select("bin", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), F.col("count").cast("bigint").alias("count"))


@register("""
WITH b AS (SELECT min(l_quantity) AS a0, max(l_quantity) AS a1, min(l_discount) AS c0, max(l_discount) AS c1 FROM lineitem)
SELECT least(CAST(floor((l_quantity - a0) / ((a1 - a0) / 5)) AS BIGINT), 4) AS b0, least(CAST(floor((l_discount - c0) / ((c1 - c0) / 4)) AS BIGINT), 3) AS b1, count(*) AS count
FROM lineitem, b GROUP BY 1, 2
""")
def histogram2d(spark, sf_dir):
    return agg.histogram2d(read(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", (5, 4))


@register("""
SELECT CAST(g.i AS BIGINT) AS i, round(coalesce(sum(l_quantity), 0), 4) AS v, CAST(count(l_linenumber) AS DOUBLE) AS n
FROM (SELECT unnest(range((SELECT max(l_linenumber) + 1 FROM lineitem))) AS i) g LEFT JOIN lineitem ON l_linenumber = g.i GROUP BY 1
""")
def bincount(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    plain, weighted = agg.bincount(rows, "l_linenumber"), agg.bincount(rows, "l_linenumber", "l_quantity")
    return weighted.join(plain.withColumnRenamed("v", "n"), "i").select("i", F.round("v", 4).alias("v"), "n")


@register("""
SELECT d0, d1, count(*) AS n FROM (
  SELECT CAST((l_quantity > 10)::INT + (l_quantity > 20)::INT + (l_quantity > 30)::INT AS BIGINT) AS d0, CAST((l_quantity >= 10)::INT + (l_quantity >= 20)::INT + (l_quantity >= 30)::INT AS BIGINT) AS d1 FROM lineitem
) GROUP BY 1, 2
""")
def digitize(spark, sf_dir):
    edges = [10.0, 20.0, 30.0]
    rows = read(spark, sf_dir, "lineitem").select(agg.digitize("l_quantity", edges).alias("d0"), agg.digitize("l_quantity", edges, True).alias("d1"))
    return rows.groupBy("d0", "d1").agg(F.count("*").alias("n"))


@register("""
WITH c AS (SELECT covar_samp(l_quantity, l_quantity) AS v00, covar_samp(l_quantity, l_extendedprice) AS v01, covar_samp(l_extendedprice, l_extendedprice) AS v11 FROM lineitem)
SELECT 0 AS i, 0 AS j, round(v00, 3) AS v FROM c UNION ALL SELECT 0, 1, round(v01, 3) FROM c UNION ALL SELECT 1, 0, round(v01, 3) FROM c UNION ALL SELECT 1, 1, round(v11, 3) FROM c
""")
def cov_matrix(spark, sf_dir):
    return agg.cov_matrix(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"]).withColumn("v", F.round("v", 3))


@register("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_samp(l_quantity, l_discount), 6) AS c FROM lineitem GROUP BY 1")
def corrcoef(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(r6(agg.corrcoef("l_quantity", "l_extendedprice")).alias("r"), r6(agg.cov("l_quantity", "l_discount")).alias("c"))


@register("""
SELECT CAST((o_totalprice > 50000)::INT + (o_totalprice > 100000)::INT + (o_totalprice > 200000)::INT AS BIGINT) AS place, count(*) AS n FROM orders GROUP BY 1
""")
def searchsorted(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(agg.searchsorted("o_totalprice", [50000.0, 100000.0, 200000.0]).alias("place")).groupBy("place").agg(F.count("*").alias("n"))


@register("""
SELECT p_partkey, round(CASE WHEN p_size < 1 THEN 0.0 WHEN p_size < 10 THEN (p_size - 1) * 2.0 / 9 WHEN p_size < 30 THEN 2 + (p_size - 10) * 6.0 / 20 ELSE 8.0 END, 6) AS v FROM part
""")
def interp(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", r6(agg.interp("p_size", [1.0, 10.0, 30.0], [0.0, 2.0, 8.0])).alias("v"))


# ------------------------------------------------------------------ element-wise functions


@register("""
SELECT event_id, round(sin(value), 6) AS s, round(cos(value), 6) AS c, round(atan2(value, 2.0), 6) AS a, round(sqrt(value * value + 9), 6) AS h,
  round(exp(-value / 100), 6) AS e, round(CASE WHEN value > 0 THEN ln(value) END, 6) AS l, round(cbrt(value), 6) AS cb, floor(value) AS f, ceil(value) AS ce, trunc(value) AS t,
  round(radians(value), 6) AS rad, CAST(sign(value) AS DOUBLE) AS sg
FROM events
""")
def ufuncs_float(spark, sf_dir):
    v = F.col("value")
    return read(spark, sf_dir, "events").select(
        "event_id", r6(u.sin(v)).alias("s"), r6(u.cos(v)).alias("c"), r6(u.arctan2(v, 2.0)).alias("a"), r6(u.hypot(v, 3.0)).alias("h"),
        r6(u.exp(-v / 100)).alias("e"), r6(F.when(v > 0, u.log(v))).alias("l"), r6(u.cbrt(v)).alias("cb"), u.floor(v).alias("f"), u.ceil(v).alias("ce"), u.trunc(v).alias("t"),
        r6(u.radians(v)).alias("rad"), u.sign(v).alias("sg"),
    )


@register("""
SELECT l_orderkey, l_linenumber, CAST(((l_partkey - 500) % 7 + 7) % 7 AS BIGINT) AS rem, CAST(floor((l_partkey - 500) / 7.0) AS BIGINT) AS fd,
  CAST(gcd(l_partkey, l_suppkey) AS BIGINT) AS g, CAST(lcm(l_partkey, l_suppkey) AS BIGINT) AS lc, l_partkey & 255 AS band, l_partkey | 256 AS bor, xor(l_partkey, 85) AS bx, CAST(bit_count(l_partkey) AS INT) AS ones,
  l_partkey << 3 AS sl, l_partkey >> 2 AS sr
FROM lineitem
""")
def ufuncs_integer(spark, sf_dir):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", u.remainder(p - 500, 7).alias("rem"), u.floor_divide(p - 500, 7).alias("fd"), u.gcd(p, s).alias("g"), u.lcm(p, s).alias("lc"),
        u.bitwise_and(p, 255).alias("band"), u.bitwise_or(p, 256).alias("bor"), u.bitwise_xor(p, 85).alias("bx"), u.bitwise_count(p).alias("ones"),
        u.left_shift(p, 3).alias("sl"), u.right_shift(p, 2).alias("sr"),
    )


@register("""
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'inf' WHEN event_id % 5 = 1 THEN '-inf' WHEN event_id % 5 = 2 THEN 'nan' ELSE 'num' END AS kind FROM events
""")
def divide_by_zero(spark, sf_dir):
    k = F.col("event_id") % 5
    q = u.divide(F.when(k == 0, 1.0).when(k == 1, -1.0).when(k == 2, 0.0).otherwise(2.0), F.when(k < 3, 0.0).otherwise(3.0))
    kind = F.when(u.isposinf(q), "inf").when(u.isneginf(q), "-inf").when(u.isnan(q), "nan").otherwise("num")
    return read(spark, sf_dir, "events").select("event_id", kind.alias("kind"))


@register("""
SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' WHEN o_totalprice > 10000 THEN 'mid' ELSE 'small' END AS band, greatest(o_custkey, 100) AS mx, least(o_custkey, 100) AS mn,
  CAST(least(greatest(o_totalprice, 1000), 5000) AS DOUBLE) AS cl, abs(o_totalprice - 5000) <= 1e-8 + 0.5 * 5000 AS near, CASE WHEN o_custkey % 2 = 0 THEN o_custkey ELSE -o_custkey END AS w, CASE o_custkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS ch
FROM orders
""")
def choice_functions(spark, sf_dir):
    p, c = F.col("o_totalprice"), F.col("o_custkey")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", u.select([p > 100000, p > 10000], ["big", "mid"], "small").alias("band"), u.maximum(c, F.lit(100)).alias("mx"), u.minimum(c, F.lit(100)).alias("mn"),
        u.clip(p, 1000.0, 5000.0).alias("cl"), u.isclose(p, 5000.0, rtol=0.5).alias("near"), u.where(c % 2 == 0, c, -c).alias("w"), u.choose(c % 3, ["a", "b", "c"]).alias("ch"),
    )


@register("""
SELECT n_nationkey, round(re, 6) AS re, round(im, 6) AS im, round(sqrt(re * re + im * im), 6) AS m FROM (
  SELECT n_nationkey, CASE WHEN n_nationkey < 10 THEN 0.0 ELSE sqrt(n_nationkey - 10.0) END AS re, CASE WHEN n_nationkey < 10 THEN sqrt(10.0 - n_nationkey) ELSE 0.0 END AS im FROM nation)
""")
def complex_sqrt(spark, sf_dir):
    z = u.emath.sqrt(F.col("n_nationkey") - 10.0)
    return read(spark, sf_dir, "nation").select("n_nationkey", r6(z["re"]).alias("re"), r6(z["im"]).alias("im"), r6(u.complex_abs(z)).alias("m"))


@register("""
SELECT p_partkey, lower(p_name) AS lo, upper(p_name) AS up, octet_length(encode(p_name)) AS n, strpos(p_name, 'a') - 1 AS f, replace(p_name, 'a', '@') AS r, lpad(CAST(p_size AS VARCHAR), 6, '0') AS z,
  starts_with(p_brand, 'Brand') AS sw, regexp_matches(p_brand, '^[A-Za-z]+$') AS alpha, (length(p_name) - length(replace(p_name, 'e', '')))::INT AS c, reverse(reverse(p_type)) || '!' AS ad, trim(p_type) AS st, p_brand || repeat('.', greatest(12 - length(p_brand), 0)::INT) AS lj
FROM part
""")
def string_functions(spark, sf_dir):
    n = F.col("p_name")
    return read(spark, sf_dir, "part").select(
        "p_partkey", text.lower(n).alias("lo"), text.upper(n).alias("up"), text.str_len(n).cast("bigint").alias("n"), text.find(n, "a").cast("bigint").alias("f"), text.replace(n, "a", "@").alias("r"),
        text.zfill(F.col("p_size").cast("string"), 6).alias("z"), text.startswith(F.col("p_brand"), "Brand").alias("sw"), text.isalpha(F.col("p_brand")).alias("alpha"), text.count(n, "e").alias("c"),
        text.add(F.col("p_type"), "!").alias("ad"), text.strip(F.col("p_type")).alias("st"), text.ljust(F.col("p_brand"), 12, ".").alias("lj"),
    )


@register("""
SELECT doc_id, octet_length(encode(text)) AS n_bytes, length(text) AS n_chars, len(string_split_regex(trim(text, E' \\t\\n\\r'), '[ \\t\\n\\r]+')) AS n_words, len(regexp_extract_all(text, '\\n')) + 1 AS n_lines
FROM documents
""")
def document_lengths(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", text.str_len(t).cast("bigint").alias("n_bytes"), F.length(t).cast("bigint").alias("n_chars"), F.size(F.split(text.strip(t), "[ \t\n\r]+")).cast("bigint").alias("n_words"), (text.count(t, "\n") + 1).cast("bigint").alias("n_lines"))


# ------------------------------------------------------------------ dates


@register("""
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS b, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INT) AS e FROM orders)
SELECT o_orderkey, isodow(b) < 6 AND b <> DATE '1996-01-01' AS busday,
  (SELECT count(*) FROM range(0, CAST(o_orderkey % 30 AS BIGINT)) t(k) WHERE isodow(b + CAST(k AS INT)) < 6 AND b + CAST(k AS INT) <> DATE '1996-01-01') AS n, strftime(b, '%Y-%m') AS m, CAST(isodow(b) - 1 AS INT) AS wd
FROM o
""")
def business_days(spark, sf_dir):
    cal = calendar.BusinessCalendar(holidays=[date(1996, 1, 1)])
    b = F.col("o_orderdate").cast("date")
    e = F.date_add(b, (F.col("o_orderkey") % 30).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", cal.is_busday(b).alias("busday"), cal.busday_count(b, e).alias("n"), calendar.as_string(b, "M").alias("m"), calendar.weekday(b).alias("wd"))


@register("""
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS b FROM orders),
d AS (SELECT o_orderkey, b + CAST(k AS INT) AS x, row_number() OVER (PARTITION BY o_orderkey ORDER BY k) AS n FROM o, range(0, 40) t(k) WHERE isodow(b + CAST(k AS INT)) < 6 AND b + CAST(k AS INT) NOT IN (DATE '1996-01-01', DATE '1996-12-25'))
SELECT o_orderkey, x AS shifted FROM d WHERE n = o_orderkey % 12 + 1
""")
def business_offset(spark, sf_dir):
    cal = calendar.BusinessCalendar(holidays=[date(1996, 1, 1), date(1996, 12, 25)])
    rows = read(spark, sf_dir, "orders")
    return rows.select("o_orderkey", cal.busday_offset(F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 12, "forward").alias("shifted"))


# ------------------------------------------------------------------ order, windows, sets


@register("""
SELECT event_id, round(sum(value) OVER w, 4) AS cs, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS d,
  round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), 6) AS m3
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
""")
def cumulative_and_difference(spark, sf_dir):
    by, order = ["user_id"], ["ts", "event_id"]
    w = ordering.within(by, order).rowsBetween(0, 2)
    return read(spark, sf_dir, "events").select("event_id", F.round(ordering.cumsum("value", by, order), 4).alias("cs"), r6(ordering.diff("value", by, order)).alias("d"), r6(F.avg("value").over(w)).alias("m3"))


@register("""
SELECT event_id, round(CASE WHEN a IS NULL THEN b - value WHEN b IS NULL THEN value - a ELSE (b - a) / 2 END, 6) AS g, round(2 * b + value, 6) AS k FROM (
  SELECT event_id, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
""")
def gradient_and_correlate(spark, sf_dir):
    by, order = ["user_id"], ["ts", "event_id"]
    return read(spark, sf_dir, "events").select("event_id", r6(ordering.gradient("value", by, order)).alias("g"), r6(ordering.correlate("value", [1.0, 2.0], by, order)).alias("k"))


@register("SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS cumsum FROM orders")
def cumsum_whole_column(spark, sf_dir):
    return ordering.cumsum_all(read(spark, sf_dir, "orders"), "o_totalprice", ["o_orderdate", "o_orderkey"]).select("o_orderkey", F.round("cumsum", 2).alias("cumsum"))


@register("SELECT row_number() OVER (ORDER BY o_orderstatus, o_custkey, o_orderkey) - 1 AS rank, o_orderkey FROM orders")
def lexsort(spark, sf_dir):
    return ordering.lexsort(read(spark, sf_dir, "orders"), "o_orderkey", ["o_custkey", "o_orderstatus"])


@register("SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS i, c_custkey, c_acctbal FROM customer")
def sort_with_index(spark, sf_dir):
    return ordering.with_index(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"])


@register("SELECT CASE WHEN r < 100 THEN -1 WHEN r = 100 THEN 0 ELSE 1 END AS side, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY l_extendedprice) - 1 AS r FROM lineitem) GROUP BY 1")
def partition_kth(spark, sf_dir):
    return ordering.partition(read(spark, sf_dir, "lineitem").select("l_extendedprice"), "l_extendedprice", 100).groupBy("side").agg(F.count("*").alias("n"))


@register("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def topk(spark, sf_dir):
    return ordering.topk(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), "c_custkey"], 20)


@register("""
WITH d AS (SELECT event_id, value - 50 AS v FROM events), k AS (SELECT * FROM (VALUES (0, 0.5), (1, 1.0), (2, -0.5)) t(j, w))
SELECT CAST(event_id + j AS BIGINT) AS i, round(sum(v * w), 6) AS v FROM d, k GROUP BY 1
""")
def convolve(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("i"), (F.col("value") - 50).alias("v"))
    return ordering.convolve(rows, "i", "v", [0.5, 1.0, -0.5]).select("i", r6("v").alias("v"))


@register("""
SELECT user_id, round(sum((value + p) / 2 * (event_id - q)), 3) AS area FROM (
  SELECT user_id, value, event_id, lag(value) OVER w AS p, lag(event_id) OVER w AS q FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE p IS NOT NULL GROUP BY 1
""")
def trapezoid(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("a", ordering.trapezoids("value", "event_id", ["user_id"], "event_id"))
    n = rows.groupBy("user_id").agg(F.round(F.sum("a"), 3).alias("area"), F.count("*").alias("n"))
    return n.filter("n > 1").select("user_id", "area")


@register("SELECT p_brand AS v, count(*) AS count, min(p_partkey) AS first FROM part GROUP BY 1")
def unique_counts(spark, sf_dir):
    return sets.unique(read(spark, sf_dir, "part"), "p_brand", "p_partkey")


@register("SELECT p_partkey, dense_rank() OVER (ORDER BY p_type) - 1 AS inverse FROM part")
def unique_inverse(spark, sf_dir):
    return sets.unique_inverse(read(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type").select("p_partkey", "inverse")


def _two(spark, sf_dir):
    return read(spark, sf_dir, "customer").filter("c_acctbal > 5000"), "c_nationkey", read(spark, sf_dir, "supplier").filter("s_acctbal > 5000"), "s_nationkey"


@register("SELECT c_nationkey AS v FROM customer WHERE c_acctbal > 5000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def union1d(spark, sf_dir):
    return sets.union1d(*_two(spark, sf_dir))


@register("SELECT c_nationkey AS v FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def intersect1d(spark, sf_dir):
    return sets.intersect1d(*_two(spark, sf_dir))


@register("SELECT c_nationkey AS v FROM customer WHERE c_acctbal > 5000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def setdiff1d(spark, sf_dir):
    return sets.setdiff1d(*_two(spark, sf_dir))


@register("(SELECT c_nationkey AS v FROM customer WHERE c_acctbal > 5000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000 EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 5000)")
def setxor1d(spark, sf_dir):
    return sets.setxor1d(*_two(spark, sf_dir))


@register("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def isin_invert(spark, sf_dir):
    rich = read(spark, sf_dir, "customer").filter("c_acctbal > 0")
    return sets.isin(read(spark, sf_dir, "orders"), "o_custkey", rich, "c_custkey", invert=True).select("o_orderkey", "o_custkey")


# ------------------------------------------------------------------ masked arrays


@register("""
SELECT d.lang, count(q) AS n, count(*) - count(q) AS masked, sum(q) AS s, round(avg(q), 6) AS m, sum(CASE WHEN q IS NULL THEN 9 ELSE q END) AS f FROM (
  SELECT lang, l.quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) d GROUP BY 1
""")
def masked_statistics(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    q = F.col("quality")
    return rows.groupBy("lang").agg(masked.count(q).alias("n"), masked.count_masked(q).alias("masked"), F.sum(q).alias("s"), r6(masked.mean(q)).alias("m"), F.sum(masked.filled(q, 9)).alias("f"))


@register("""
WITH r AS (SELECT d.doc_id, l.quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), g AS (SELECT doc_id, doc_id - row_number() OVER (ORDER BY doc_id) AS k FROM r WHERE q IS NULL)
SELECT min(doc_id) AS start, max(doc_id) + 1 AS stop FROM g GROUP BY k
""")
def masked_runs(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left").withColumn("one", F.lit(0))
    return masked.clump_masked(rows, "quality", "doc_id", ["one"]).select("start", "stop")


# ------------------------------------------------------------------ grids and linear algebra


def _embeddings(spark, sf_dir, n: int = 64) -> grid.Grid:
    e = read(spark, sf_dir, "embeddings")
    cells = e.select(F.col("vec_id").alias("i0"), F.posexplode("embedding").alias("i1", "x")).select("i0", F.col("i1").cast("bigint").alias("i1"), F.col("x").cast("double").alias("v"))
    return grid.Grid(cells, (e.count(), n))


@register("""
WITH e AS (SELECT vec_id, unnest(range(64)) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT a.j AS i0, b.j AS i1, round(sum(a.x * b.x), 3) AS v FROM e a JOIN e b ON a.vec_id = b.vec_id GROUP BY 1, 2
""")
def matmul_gram(spark, sf_dir):
    return linalg.gram(_embeddings(spark, sf_dir)).df.withColumn("v", F.round("v", 3))


@register("""
WITH e AS (SELECT vec_id, unnest(range(64)) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT j AS i0, round(avg(x), 6) AS m, round(stddev_pop(x), 6) AS s, min(x) AS lo FROM e GROUP BY 1
""")
def axis_reductions(spark, sf_dir):
    g = _embeddings(spark, sf_dir)
    m, s, lo = g.mean(0), g.std(0), g.min(0)
    return m.df.select("i0", r6("v").alias("m")).join(s.df.select("i0", r6("v").alias("s")), "i0").join(lo.df.withColumnRenamed("v", "lo"), "i0")


@register("""
WITH e AS (SELECT vec_id, unnest(range(64)) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT j, avg(x) AS m FROM e GROUP BY 1)
SELECT e.vec_id AS i0, CAST(e.j AS BIGINT) AS i1, round(x - m, 6) AS v FROM e JOIN m ON e.j = m.j
""")
def broadcast_center(spark, sf_dir):
    g = _embeddings(spark, sf_dir)
    return (g - g.mean(0)).df.withColumn("v", r6("v"))


@register("""
WITH e AS (SELECT vec_id, unnest(range(64)) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT CAST((vec_id * 64 + j) // 16 AS BIGINT) AS i0, CAST((vec_id * 64 + j) % 16 AS BIGINT) AS i1, round(x, 6) AS v FROM (SELECT vec_id - 1 AS vec_id, j, x FROM e WHERE vec_id >= 1)
""")
def reshape_slice(spark, sf_dir):
    return _embeddings(spark, sf_dir)[1:].reshape(-1, 16).df.withColumn("v", r6("v"))


@register("""
WITH e AS (SELECT vec_id, unnest(range(64)) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT CAST(63 - j AS BIGINT) AS i0, CAST((vec_id + 3) % (SELECT count(*) FROM embeddings) AS BIGINT) AS i1, round(x, 6) AS v FROM e
""")
def transpose_roll_flip(spark, sf_dir):
    return _embeddings(spark, sf_dir).roll(3, 0).transpose().flip(0).df.withColumn("v", r6("v"))


@register("""
WITH e AS (SELECT vec_id, unnest(range(64)) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT vec_id, round(sqrt(sum(x * x)), 5) AS n2, round(sum(abs(x)), 5) AS n1, round(max(abs(x)), 6) AS ninf FROM e GROUP BY 1
""")
def vector_norms(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(linalg.vec_norm(v), 5).alias("n2"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x)), 5).alias("n1"), r6(F.array_max(F.transform(v, F.abs))).alias("ninf"))


@register("""
WITH e AS (SELECT vec_id, label, unnest(range(64)) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), c AS (SELECT label, j, avg(x) AS m FROM e GROUP BY 1, 2)
SELECT vec_id, round(sqrt(sum((x - m) * (x - m))), 4) AS dist FROM e JOIN c ON e.label = c.label AND e.j = c.j GROUP BY 1
""")
def distance_to_centroid(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    cells = rows.select("label", F.posexplode("embedding").alias("j", "x"))
    center = cells.groupBy("label", "j").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "m"))), lambda s: s["m"]).alias("c"))
    return rows.join(center, "label").select("vec_id", F.round(linalg.vec_distance(F.col("embedding"), F.col("c")), 4).alias("dist"))


@register("""
WITH q AS (SELECT r_regionkey AS i, n_nationkey AS j, 1.0 * n_nationkey * (r_regionkey + 1) AS v FROM region, nation), w AS (SELECT n_nationkey AS j, n_regionkey AS k FROM nation)
SELECT CAST(i AS BIGINT) AS i0, CAST(k AS BIGINT) AS i1, CAST(sum(v) AS DOUBLE) AS v FROM q JOIN w ON q.j = w.j GROUP BY 1, 2
""")
def einsum(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    a = grid.fromfunction(spark, lambda i, j: j * (i + 1.0), (5, 25))
    b = grid.Grid(n.select(F.col("n_nationkey").cast("bigint").alias("i0"), F.col("n_regionkey").cast("bigint").alias("i1"), F.lit(1.0).alias("v")), (25, 5))
    return linalg.einsum("ij,jk->ik", a, b).df


@register("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem GROUP BY 1")
def linear_fit(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(agg.linear_fit("l_quantity", "l_extendedprice").alias("f"))
    return rows.select("l_returnflag", F.round("f.slope", 4).alias("slope"), F.round("f.intercept", 3).alias("intercept"))


@register("SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS c1, round(regr_intercept(l_extendedprice, l_quantity), 2) AS c0 FROM lineitem")
def polyfit(spark, sf_dir):
    c = poly.polyfit(read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 1)
    return spark.range(1).select(F.round(F.lit(c[0]), 3).alias("c1"), F.round(F.lit(c[1]), 2).alias("c0"))


@register("""
SELECT p_partkey, round(1 + 2.0 * x + 3.0 * (2 * x * x - 1), 6) AS cheb, round(1 + 2.0 * x + 3.0 * (1.5 * x * x - 0.5), 6) AS leg, round(1 + 2.0 * 2 * x + 3.0 * (4 * x * x - 2), 6) AS herm,
  round(1 + 2.0 * (1 - x) + 3.0 * (x * x / 2 - 2 * x + 1), 6) AS lag, round((x - 3) * x + 2, 6) AS p
FROM (SELECT p_partkey, p_size / 50.0 AS x FROM part)
""")
def polynomial_bases(spark, sf_dir):
    x, c = F.col("p_size") / 50.0, [1.0, 2.0, 3.0]
    return read(spark, sf_dir, "part").select(
        "p_partkey", r6(poly.Chebyshev(c)(x)).alias("cheb"), r6(poly.Legendre(c)(x)).alias("leg"), r6(poly.Hermite(c)(x)).alias("herm"), r6(poly.Laguerre(c)(x)).alias("lag"), r6(poly.polyval([1, -3, 2], x)).alias("p"),
    )


@register("""
WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS j FROM events), n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
SELECT s.user_id, k, round(sum(value * cos(-2 * pi() * k * j / n)), 4) + 0.0 AS re, round(sum(value * sin(-2 * pi() * k * j / n)), 4) + 0.0 AS im
FROM s JOIN n ON s.user_id = n.user_id, (SELECT CAST(unnest(range(3)) AS INT) AS k) WHERE n >= 5 GROUP BY 1, 2
""")
def fft_by_user(spark, sf_dir):
    line = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda s: s["value"])
    rows = read(spark, sf_dir, "events").groupBy("user_id").agg(line.alias("x")).filter(F.size("x") >= 5)
    bins = rows.select("user_id", F.slice(fft.fft(F.col("x")), 1, 3).alias("z")).select("user_id", F.posexplode("z").alias("k", "z"))
    return bins.select("user_id", "k", (F.round("z.re", 4) + 0.0).alias("re"), (F.round("z.im", 4) + 0.0).alias("im"))


@register("""
SELECT CAST(i AS BIGINT) AS i, round(0.5 - 0.5 * cos(2 * pi() * i / 50), 6) + 0.0 AS hann, round(0.54 - 0.46 * cos(2 * pi() * i / 50), 6) AS hamm, round(0.42 - 0.5 * cos(2 * pi() * i / 50) + 0.08 * cos(4 * pi() * i / 50), 6) + 0.0 AS black, round(1 - abs(2.0 * i / 50 - 1), 6) AS bart
FROM range(51) t(i)
""")
def tapers_all(spark, sf_dir):
    i = F.col("id")
    return spark.range(51).select(i.alias("i"), (r6(tapers.hanning(i, 51)) + 0.0).alias("hann"), r6(tapers.hamming(i, 51)).alias("hamm"), (r6(tapers.blackman(i, 51)) + 0.0).alias("black"), r6(tapers.bartlett(i, 51)).alias("bart"))


# ------------------------------------------------------------------ formulas, events, random


@register("""
SELECT event_id, round(x * x * y + sin(x), 6) AS f, round(2 * x * y + cos(x), 6) AS dx, round(x * x, 6) AS dy, round(2 * y - sin(x), 6) AS lap, round(2 * x, 6) AS mixed
FROM (SELECT event_id, value / 100 AS x, user_id / 10.0 AS y FROM events)
""")
def formula(spark, sf_dir):
    f = Formula("x^2*y + sin(x)", ["x", "y"])
    rows = read(spark, sf_dir, "events").select("event_id", (F.col("value") / 100).alias("x"), (F.col("user_id") / 10.0).alias("y"))
    return rows.select("event_id", r6(f.column()).alias("f"), r6(f.diff("x").column()).alias("dx"), r6(f.diff("y").column()).alias("dy"), r6(f.laplacian().column()).alias("lap"), r6(f.diff("x").diff("y").column()).alias("mixed"))


@register("SELECT event_id, round(2 * value / 100, 6) AS d01, 0.0 AS dd FROM events")
def exterior_derivative(spark, sf_dir):
    # d(x^2 dy) = 2x dx dy, and d of d is 0.
    w = Form(1, ["x", "y"], {(1,): Formula("x^2", ["x", "y"]).tree})
    dd = Form.of(Formula("x*y + sin(x*y)", ["x", "y"])).d().d()
    rows = read(spark, sf_dir, "events").select("event_id", (F.col("value") / 100).alias("x"), (F.col("user_id") / 10.0).alias("y"))
    return rows.select("event_id", r6(w.d().column(0, 1)).alias("d01"), (F.round(dd.column(0, 1), 6) + 0.0).alias("dd"))


@register()
def lif_spikes(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("t"), (F.col("user_id") % 8).cast("int").alias("x"), (F.col("event_id") % 4).cast("int").alias("y"), F.lit(1).alias("p"), "event_id")
    return spikes.simulate(e, spikes.LIF(weight=10.0), 8, 4, ["t", "event_id"])


@register("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(avg(value), 6) AS m FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return spikes.tumbling(e, "ts", "1 hour", keys=["event_type"], n=F.count("*"), m=r6(F.avg("value"))).select("event_type", "start", "n", "m")


@register("""
WITH s AS (SELECT event_id, CAST(round_even(value * 2, 0) AS INT) AS n FROM events)
SELECT event_id AS i, round(1.0 * k / n, 6) AS t FROM s, range(0, 1000) r(k) WHERE k < n
""")
def spikes_by_rate(spark, sf_dir):
    return spikes.encode_rate(read(spark, sf_dir, "events"), "event_id", "value", 2000.0, 1.0).select("i", rounded(F.col("t"), 6).alias("t"))


@register()
def random_draws(spark, sf_dir):
    g = random.Generator(7, F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    draws = {"uniform": g.random(), "normal": g.standard_normal(), "exponential": g.standard_exponential(), "gamma": g.standard_gamma(2.5), "poisson": g.poisson(3.0), "binomial": g.binomial(10, 0.3), "geometric": g.geometric(0.25)}
    rows = read(spark, sf_dir, "lineitem").select(*[c.cast("double").alias(n) for n, c in draws.items()])
    return rows.agg(*[F.round(f(F.col(n)), 6).alias(f"{f.__name__}_{n}") for n in draws for f in (F.avg, F.var_pop)])
