import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.operators import aggregates as agg
from tessera.operators import fft, grid, linalg, masked, order, ordering, poly, quantum, sets, simplices
from tessera.sources import arrays
from tessera.streaming import events


def column(spark, values, kind="double"):
    return spark.createDataFrame(list(enumerate(values)), f"i long, v {kind}")


def test_statistics(spark):
    df = column(spark, [3.0, 1.0, 2.0, 5.0, 4.0])
    row = df.agg(agg.median("v").alias("m"), agg.ptp("v").alias("p"), agg.var("v", 1).alias("var"), agg.argmax("i", "v").alias("x"), agg.average("v", "i").alias("w")).first()
    assert (row.m, row.p, row.var, row.x) == (3.0, 4.0, 2.5, 3) and row.w == pytest.approx((1 + 4 + 15 + 16) / 10)
    nan = column(spark, [1.0, float("nan"), 3.0])
    row = nan.agg(agg.min_("v").alias("lo"), agg.nansum("v").alias("s"), agg.nanmean("v").alias("m"), agg.argmin("i", "v").alias("x"), agg.var("v", 5).alias("few")).first()
    assert math.isnan(row.lo) and (row.s, row.m, row.x) == (4.0, 2.0, 1) and math.isnan(row.few)
    empty = df.limit(0).agg(agg.sum_("v").alias("s"), agg.prod("v").alias("p"), agg.all_("v").alias("a"), agg.any_("v").alias("b")).first()
    assert tuple(empty) == (0, 1.0, True, False)
    with pytest.raises(ValueError):
        agg.percentile("v", 101)
    with pytest.raises(PySparkException):
        df.agg(agg.average("v", F.lit(0.0))).collect()


def test_histograms(spark):
    df = column(spark, [0.0, 0.5, 1.0, 2.0, 2.0, float("nan")])
    assert [r["count"] for r in agg.histogram(df, "v", 4).orderBy("bin").collect()] == [1, 1, 1, 2]
    with pytest.raises(ValueError):
        agg.histogram(column(spark, [1.0, 1.0]), "v")
    assert [r.v for r in agg.bincount(column(spark, [0, 3, 3], "int"), "v", minlength=6).orderBy("i").collect()] == [1, 0, 0, 2, 0, 0]
    with pytest.raises(PySparkException):
        agg.bincount(column(spark, [-1], "int"), "v").collect()


def test_whole_column_order(spark):
    df = column(spark, [float((k * 37) % 101) for k in range(101)]).repartition(5)
    assert [r.v for r in ordering.sort(df, "v", "p").orderBy("p").collect()] == sorted(float(k) for k in range(101))
    total = {r.i: r.cumsum for r in ordering.cumsum_all(df, "v", ["i"]).collect()}
    assert [total[k] for k in range(101)] == np.cumsum([(k * 37) % 101 for k in range(101)]).tolist()
    assert {r.v: r.inverse for r in sets.unique_inverse(df, "v").collect()} == {float(k): k for k in range(101)}
    keys = spark.createDataFrame([(0, 1, 0), (1, 1, 1), (2, 0, 0), (3, 0, 1)], "i long, k0 int, k1 int")
    assert [r.i for r in ordering.lexsort(keys, "i", ["k0", "k1"]).orderBy("rank").collect()] == [2, 0, 3, 1]


def test_unwrap_and_difference(spark):
    x = [0.0, 3.0, -3.0, 2.0, -2.5, 0.5]
    df = column(spark, x).withColumn("g", F.lit(0))
    got = ordering.unwrap("v", ["g"], "i")(df).orderBy("i").collect()
    assert [r.unwrapped for r in got] == pytest.approx(np.unwrap(x).tolist())
    assert [r.d for r in df.select("i", ordering.diff("v", ["g"], "i", 2).alias("d")).orderBy("i").collect()][2:] == pytest.approx(np.diff(x, 2).tolist())
    assert [r.v for r in ordering.convolve(df, "i", "v", [1.0, -2.0, 0.5], "same").orderBy("i").collect()] == pytest.approx(np.convolve(x, [1, -2, 0.5], "same").tolist())


A = np.arange(24).reshape(2, 3, 4)


@pytest.mark.parametrize(
    "ours,theirs",
    [
        (lambda g: g.reshape(4, -1), A.reshape(4, -1)), (lambda g: g.transpose(2, 0, 1), A.transpose(2, 0, 1)), (lambda g: g[1, ::-1, 1:3], A[1, ::-1, 1:3]), (lambda g: g[..., None, -1], A[..., None, -1]),
        (lambda g: g.flip(1), np.flip(A, 1)), (lambda g: g.roll(5), np.roll(A, 5)), (lambda g: g.roll(-1, 2), np.roll(A, -1, 2)), (lambda g: g.moveaxis(0, 2), np.moveaxis(A, 0, 2)), (lambda g: g[0].rot90(3), np.rot90(A[0], 3)),
        (lambda g: g.repeat(2, 1), A.repeat(2, 1)), (lambda g: g[0].tile(2, 3), np.tile(A[0], (2, 3))), (lambda g: g.take([2, 0], 1), A.take([2, 0], 1)), (lambda g: g.delete([1], 2), np.delete(A, [1], 2)), (lambda g: g.cumsum(1), A.cumsum(1)),
        (lambda g: g[0] + g[0, 1], A[0] + A[0, 1]), (lambda g: g[0, :, :1] * g[0, 1], A[0, :, :1] * A[0, 1]), (lambda g: g.sum((0, 2)), A.sum((0, 2))), (lambda g: g.max(1, keepdims=True), A.max(1, keepdims=True)),
        (lambda g: g[0].pad([1, 2], [0, 3], "wrap"), np.pad(A[0], ((1, 0), (2, 3)), "wrap")), (lambda g: g[0].pad([2, 1], [1, 4], "symmetric"), np.pad(A[0], ((2, 1), (1, 4)), "symmetric")), (lambda g: g[0].pad([1, 1], [1, 1], "edge"), np.pad(A[0], 1, "edge")),
        (lambda g: g.insert(1, g[:, :1], 1), np.insert(A, 1, A[:, 0], 1)), (lambda g: g[0].diagonal(-1), np.diagonal(A[0], -1)), (lambda g: g[0, 0].diag(1), np.diag(A[0, 0], 1)), (lambda g: g[0].triu(1), np.triu(A[0], 1)), (lambda g: g.argmax(2), A.argmax(2)),
        (lambda g: grid.vstack([g[0], g[1]]), np.vstack([A[0], A[1]])), (lambda g: grid.dstack([g[0], g[1]]), np.dstack([A[0], A[1]])), (lambda g: g[0, 0].vander(3), np.vander(A[0, 0], 3)), (lambda g: g.ravel().sliding_window_view(5), np.lib.stride_tricks.sliding_window_view(A.ravel(), 5)),
    ],
)
def test_grids_against_numpy(spark, ours, theirs):
    g = ours(grid.array(spark, A))
    assert g.shape == theirs.shape and np.array_equal(g.to_numpy(), theirs)


def test_grid_errors(spark):
    g = grid.array(spark, A)
    for bad in (lambda: g.reshape(5, 5), lambda: g[5], lambda: g.squeeze(0), lambda: grid.broadcast_shapes((2, 3), (4,)), lambda: g.split(2, 1), lambda: grid.where(g, g, g[0])):
        with pytest.raises((ValueError, IndexError)):
            bad()


def test_linear_algebra(spark, monkeypatch):
    rnd = np.random.default_rng(1)
    a, b = rnd.normal(size=(7, 5)), rnd.normal(size=(5, 6))
    ga, gb = grid.array(spark, a), grid.array(spark, b)
    assert (ga @ gb).to_numpy() == pytest.approx(a @ b)
    monkeypatch.setattr(linalg, "BLOCK", 2)
    assert linalg.matmul(ga, gb).to_numpy() == pytest.approx(a @ b)
    assert linalg.einsum("ij,jk,ki->", ga, gb, grid.array(spark, (a @ b).T)).item() == pytest.approx(np.einsum("ij,jk,ki->", a, b, (a @ b).T))
    assert linalg.einsum("ii->i", grid.array(spark, a[:5])).to_numpy() == pytest.approx(np.diag(a[:5]))
    assert linalg.norm(ga).item() == pytest.approx(np.linalg.norm(a)) and linalg.norm(ga, 1).item() == pytest.approx(np.linalg.norm(a, 1))
    q, r = linalg.qr(ga)
    assert q.to_numpy() @ r == pytest.approx(a)
    uu, s, vt = linalg.svd(ga)
    assert uu.to_numpy() * s @ vt == pytest.approx(a) and linalg.svdvals(ga) == pytest.approx(s)
    assert linalg.lstsq(ga, grid.array(spark, a[:, 0])) == pytest.approx(np.eye(5)[0], abs=1e-9)
    assert linalg.inv(grid.array(spark, a[:5])).to_numpy() == pytest.approx(np.linalg.inv(a[:5]))
    c = rnd.normal(size=(8, 8))
    assert linalg.strassen(c, c, 2) == pytest.approx(c @ c)
    with pytest.raises(ValueError):
        linalg.einsum("ij,jk", ga, gb)
    m = spark.createDataFrame([(a[:3, :3].ravel().tolist(),)], "m array<double>")
    row = m.select(linalg.det3(F.col("m")).alias("d"), linalg.batched(F.col("m"), 3, "inv").alias("i")).first()
    assert row.d == pytest.approx(np.linalg.det(a[:3, :3])) and row.i == pytest.approx(np.linalg.inv(a[:3, :3]).ravel())


def test_fft(spark):
    x = np.random.default_rng(2).normal(size=12)
    df = spark.createDataFrame([(x.tolist(),)], "x array<double>")
    row = df.select(fft.fft(F.col("x")).alias("f"), fft.dft(F.col("x")).alias("d"), fft.irfft(fft.rfft(F.col("x"))).alias("r"), fft.fftshift(F.col("x")).alias("s")).first()
    want = np.fft.fft(x)
    for name in "fd":
        assert [complex(z.re, z.im) for z in row[name]] == pytest.approx(want)
    assert row.r == pytest.approx(x) and row.s == pytest.approx(np.fft.fftshift(x))
    long = {r.i: complex(r.re, r.im) for r in fft.fft_long(column(spark, x.tolist()), "i", "v", 12).collect()}
    assert [long[k] for k in range(12)] == pytest.approx(want)


def test_polynomials(spark):
    df = column(spark, [1.0, 2.0, 5.0, 10.0, 17.0])
    assert poly.polyfit(df, "i", "v", 2) == pytest.approx([1, 0, 1], abs=1e-9)
    x = np.linspace(-0.9, 0.9, 7)
    points = column(spark, x.tolist())
    c = [0.5, -1.0, 2.0, 0.25]
    for ours, theirs in ((poly.Chebyshev, np.polynomial.Chebyshev), (poly.Legendre, np.polynomial.Legendre), (poly.Hermite, np.polynomial.Hermite), (poly.HermiteE, np.polynomial.HermiteE), (poly.Laguerre, np.polynomial.Laguerre), (poly.Polynomial, np.polynomial.Polynomial)):
        got = [r.y for r in points.select("i", ours(c)(F.col("v")).alias("y")).orderBy("i").collect()]
        assert got == pytest.approx(theirs(c)(x).tolist())
        assert ours(c).deriv().coef == pytest.approx(theirs(c).deriv().coef.tolist())
    assert sorted(poly.roots([1, -3, 2]).real) == pytest.approx([1, 2])


def test_masked(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (1, 0, 3.0), (1, 1, 4.0)], "i0 long, i1 long, v double")
    assert df.agg(masked.count("v")).first()[0] == 3
    assert {(r.i0, r.i1): r.v for r in masked.mask_rowcols(df, "i0", "i1", "v").collect()} == {(0, 0): None, (0, 1): None, (1, 0): 3.0, (1, 1): None}
    assert [r.i0 for r in masked.compress_rows(df, "i0", "v").collect()] == [1, 1]


def test_simplices_and_order(spark):
    assert simplices.betti_numbers(simplices.circle(spark)) == [1, 1]
    assert simplices.betti_numbers(simplices.sphere(spark, 2)) == [1, 0, 1]
    projective = [[0, 1, 4], [0, 1, 5], [0, 2, 3], [0, 2, 4], [0, 3, 5], [1, 2, 3], [1, 2, 5], [1, 3, 4], [2, 4, 5], [3, 4, 5]]
    assert simplices.homology(simplices.from_maximal(spark, projective)) == [(1, []), (0, [2]), (0, [])]
    bars = simplices.persistence_barcode([(0.0, (0,)), (0.0, (1,)), (1.0, (0, 1))])
    assert bars == [(0, 0.0, 1.0), (0, 0.0, math.inf)]
    p = order.Poset.divisors(spark, 12)
    assert p.is_lattice() and p.is_distributive() and p.is_modular() and p.mobius()[1, 6] == 1 and p.mobius()[1, 4] == 0
    assert order.Lattice.e8().volume() == pytest.approx(1)
    assert order.Lattice.hexagonal().contains([0.5, 3**0.5 / 2])


def test_quantum(spark):
    p = {r.i: r.p for r in quantum.bell(spark).probabilities().collect()}
    assert p == pytest.approx({0: 0.5, 1: 0, 2: 0, 3: 0.5})
    found = {r.i: r.p for r in quantum.grover(spark, 3, 5).probabilities().collect()}
    assert found[5] > 0.9


def test_events(spark):
    rows = [(0.3, 1, 1, 1), (0.1, 1, 1, 1), (0.2, 1, 1, 1), (0.1, 0, 0, -1), (0.1, 9, 0, 1)]
    out = events.simulate(events.events(spark, rows), events.LIF(weight=10.0), 2, 2).collect()
    assert [(r.t, r.x, r.y) for r in out] == [(0.3, 1, 1)]
    assert events.simulate(events.events(spark, rows), events.LIF(weight=0.1)).count() == 0


def test_events_stream(spark, tmp_path):
    rows = [(0.1 * k, k % 2, 0, 1) for k in range(40)]
    for k in range(0, 40, 10):
        events.events(spark, rows[k : k + 10]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "t double, x int, y int, p int"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = events.simulate_stream(stream, events.LIF(weight=10.0)).writeStream.format("memory").queryName("spikes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = events.simulate(events.events(spark, rows), events.LIF(weight=10.0))
    assert spark.table("spikes").count() == batch.count() > 0


def test_array_files(spark, tmp_path):
    a = np.array([[1.5, -2.0, 3.25], [0.0, 1.0, 2.0]])
    np.save(tmp_path / "a.npy", a)
    assert np.array_equal(arrays.load(spark, str(tmp_path / "a.npy")).to_numpy(), a)
    arrays.save(grid.array(spark, a), str(tmp_path / "b.npy"))
    assert np.array_equal(np.load(tmp_path / "b.npy"), a)
    np.savez(tmp_path / "z.npz", x=np.array([1, 2, 3]), y=a)
    z = arrays.load_npz(spark, str(tmp_path / "z.npz"))
    assert np.array_equal(z["x"].to_numpy(), [1, 2, 3]) and np.array_equal(z["y"].to_numpy(), a)
    (tmp_path / "t.txt").write_text("# head\n1 2 3\n\n4 5 6 # tail\n")
    assert arrays.loadtxt(spark, str(tmp_path / "t.txt")).to_numpy().tolist() == [[1, 2, 3], [4, 5, 6]]
    (tmp_path / "g.txt").write_text("1,,x\n4,5,6\n")
    got = arrays.genfromtxt(spark, str(tmp_path / "g.txt"), ",").to_numpy()
    assert np.isnan(got[0, 1]) and np.isnan(got[0, 2]) and got[1].tolist() == [4, 5, 6]
    (tmp_path / "r.txt").write_text("1 2\n3\n")
    with pytest.raises(ValueError):
        arrays.loadtxt(spark, str(tmp_path / "r.txt"))
