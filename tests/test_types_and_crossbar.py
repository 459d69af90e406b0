import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import types
from tessera.operators import crossbar
from tessera.plans import checks


def test_types():
    assert types.can_cast("int64", "float16") and not types.can_cast("int8", "uint8") and types.can_cast("bool", "string")
    assert types.can_cast("float64", "float32", "same_kind") and not types.can_cast("float64", "float32")
    assert types.promote_types("int64", "uint8") == "uint8" and types.result_type("int8", "float32", "bool") == "float32"
    assert [types.min_scalar_type(x) for x in (0, 300, -1, 2**70, 0.5, 0.1)] == ["uint8", "uint16", "int8", "bigint", "float32", "float64"]
    assert types.issubdtype("float32", "floating") and types.isdtype("int8", "signed integer") and types.sctype2char("float64") == "d"
    assert types.from_spark("double") == "float64" and types.spark_type("uint32") == "bigint" and types.format_parser("f8,i4") == ["double", "int"]


def test_crossbar(spark):
    w = np.random.default_rng(0).normal(size=(6, 3))
    bar = crossbar.Crossbar(w, bits=8)
    assert bar.effective_weights() == pytest.approx(w, abs=bar.scale() / 255)
    x = [1.0, -2.0, 0.5, 0.0, 3.0, 1.0]
    got = spark.createDataFrame([(x,)], "x array<double>").select(bar.dot(F.col("x"))).first()[0]
    assert got == pytest.approx((np.array(x) @ bar.effective_weights()).tolist())


@pytest.mark.parametrize("n", [2, 4, 6])
def test_mesh(n):
    rnd = np.random.default_rng(n)
    u = np.linalg.qr(rnd.normal(size=(n, n)) + 1j * rnd.normal(size=(n, n)))[0]
    parts, phases = crossbar.mesh_phases(u)
    assert crossbar.mesh_unitary(parts, phases) == pytest.approx(u) and crossbar.fidelity(u, crossbar.mesh_unitary(parts, phases)) == pytest.approx(1)


def test_checks(spark):
    a = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, float("nan"))], "i long, v double")
    b = a.withColumn("v", F.col("v") * (1 + 1e-12))
    checks.assert_array_equal(a, a, ["i"])
    checks.assert_allclose(a, b, ["i"])
    checks.assert_array_almost_equal(a.limit(2), b.limit(2), ["i"])
    with pytest.raises(AssertionError, match="2 elements"):
        checks.assert_array_equal(a, b, ["i"])
    with pytest.raises(AssertionError):
        checks.assert_array_less(a, b.limit(1), ["i"])
    checks.assert_raises(ValueError, int, "x")
