"""Text tables that stand in several files keep their order."""

import numpy as np

from tessera.sources import arrays


def test_rows_of_several_files_come_in_order_of_their_names(spark, tmp_path):
    want, at = [], 0
    for k, n in enumerate((2, 300, 40, 1, 90)):  # Spark deals out the largest first
        rows = np.arange(at, at + 3 * n, dtype=float).reshape(n, 3)
        (tmp_path / f"part-0000{k}.txt").write_text("".join(" ".join(map(str, r)) + "\n" for r in rows.tolist()))
        want, at = [*want, *rows.tolist()], at + 3 * n
    assert arrays.loadtxt(spark, f"file://{tmp_path}").tolist() == np.ravel(want).tolist()
    assert arrays.genfromtxt(spark, f"file://{tmp_path}").tolist() == np.ravel(want).tolist()


def test_parts_of_a_split_file_come_in_order(spark, tmp_path):
    (tmp_path / "one.txt").write_text("".join(f"{k} {k * k}\n" for k in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        g = arrays.loadtxt(spark, f"file://{tmp_path}/one.txt")
        assert g.shape == (5000, 2) and g.to_numpy()[:, 0].tolist() == list(range(5000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
