"""Single files are written and read without the whole array on the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import grid
from tessera.sources import arrays


def test_files_pass_through_the_driver_in_pieces(spark, tmp_path, monkeypatch):
    def whole(g):
        raise AssertionError("the driver asked for the whole array")

    monkeypatch.setattr(grid.Grid, "to_numpy", whole)
    monkeypatch.setattr(grid, "array", whole)
    a = np.arange(3 * arrays.PIECE + 6, dtype=float).reshape(-1, 2) / 7
    a[1 : arrays.PIECE + 3] = 0.0  # cells that the grid lacks, a whole piece among them
    g = grid.from_flat(spark, F.col("id") / 7, a.shape)
    g = grid.Grid(g.df.filter(f"i0 = 0 OR i0 >= {arrays.PIECE + 3}"), a.shape)
    k = grid.from_flat(spark, F.col("id") * 3, (5,))
    arrays.save(g, f"{tmp_path}/a.npy")
    arrays.tofile(g, f"{tmp_path}/a.bin")
    arrays.savez(f"{tmp_path}/a.npz", a=g, k=k)
    assert (tmp_path / "a.npy").read_bytes() == arrays.npy_bytes(a) and (tmp_path / "a.bin").read_bytes() == a.tobytes()
    with np.load(f"{tmp_path}/a.npz") as z:
        assert np.array_equal(z["a"], a) and z["k"].tolist() == [0, 3, 6, 9, 12] and z["k"].dtype == int
    back = arrays.load_npz(spark, f"{tmp_path}/a.npz")
    assert back["a"].shape == a.shape and back["k"].dtype == "bigint"
    assert [tuple(r) for r in back["a"].df.filter("v <> 0").orderBy("i0", "i1").limit(2).collect()] == [(0, 1, 1 / 7), (arrays.PIECE + 3, 0, a[arrays.PIECE + 3, 0])]
    assert back["a"].df.agg(F.count("*"), F.max("v")).first() == (a.size, a.max())


def test_masked_whole_numbers_and_places_outside_are_refused(spark, tmp_path):
    masked = grid.Grid(spark.sql("SELECT id AS i0, IF(id = 2, NULL, id) AS v FROM range(4)"), (4,))
    arrays.save(masked.astype("double"), f"{tmp_path}/d.npy")
    assert np.array_equal(np.load(f"{tmp_path}/d.npy"), [0, 1, np.nan, 3], equal_nan=True)
    with pytest.raises(Exception, match="masked cells"):
        arrays.save(masked, f"{tmp_path}/m.npy")
    with pytest.raises(Exception, match="outside"):
        arrays.save(grid.Grid(spark.sql("SELECT id AS i0, id AS v FROM range(4)"), (3,)), f"{tmp_path}/o.npy")


def test_no_task_reads_a_whole_file_and_fortran_order_is_kept(spark, tmp_path):
    a = np.arange(12.0).reshape(3, 4)
    np.save(f"{tmp_path}/f.npy", np.asfortranarray(a))
    np.savez_compressed(f"{tmp_path}/z.npz", f=np.asfortranarray(a), scalar=np.array(3), empty=np.zeros((0, 2)), c=np.array([1 + 2j]))
    a.astype("float32").tofile(f"{tmp_path}/r.bin")
    z = arrays.load_npz(spark, f"{tmp_path}/z.npz")
    assert np.array_equal(z["f"].to_numpy(), a) and z["scalar"].shape == () and z["scalar"].item() == 3
    assert z["empty"].shape == (0, 2) and z["empty"].df.count() == 0 and tuple(z["c"].df.first()["v"]) == (1.0, 2.0)
    assert np.array_equal(arrays.load(spark, f"{tmp_path}/f.npy").to_numpy(), a)
    assert arrays.fromfile(spark, f"{tmp_path}/r.bin", "float32").tolist() == a.ravel().tolist()
    many = arrays.load_many(spark, str(tmp_path))
    assert [(r.i, r.v) for r in many.orderBy("i").collect()] == list(enumerate(a.ravel().tolist()))
    content = arrays._binary(spark, f"{tmp_path}/f.npy")
    assert content.first()["content"] is None  # opened by the task instead


def test_files_of_a_store_that_is_not_mounted_are_read_by_spark(spark, tmp_path):
    a = np.arange(6).reshape(2, 3)
    np.save(f"{tmp_path}/a.npy", a)
    np.savez(f"{tmp_path}/a.npz", a=a)
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.single.link./in", f"file://{tmp_path}")
    assert np.array_equal(arrays.load(spark, "viewfs://single/in/a.npy").to_numpy(), a)
    assert np.array_equal(arrays.load_npz(spark, "viewfs://single/in/a.npz")["a"].to_numpy(), a)
