"""Links, Vietoris-Rips filtrations and their counts against all pairs and triples in numpy."""

import time
from itertools import combinations
from math import comb, dist

import numpy as np

from tessera.operators import simplices


def test_filtration_and_counts_match_all_triples(spark, monkeypatch):
    monkeypatch.setattr(simplices, "TILE", 16)
    monkeypatch.setattr(simplices, "EDGES", 40)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.6, 3).tolist()) for i in range(60)] + [(70, [0.0, 0.0, 0.0]), (71, [0.0, 0.0, 0.9]), (72, [0.0, 0.0, 0.0])]
    odd = [(80, None), (81, [0.0, None, 0.0]), (82, [float("nan"), 0.0, 0.0]), (83, [float("inf"), 0.0, 0.0]), (84, [0.0, 0.0]), (85, [])]
    points = spark.createDataFrame(rows + odd, "id bigint, vec array<double>")
    near = {(a, b): dist(x, y) for (a, x), (b, y) in combinations(rows, 2) if dist(x, y) <= 0.9}
    want = {(a,): 0.0 for a, _ in rows + odd} | near
    want |= {(a, b, c): max(near[a, b], near[b, c], near[a, c]) for a, b, c in combinations([i for i, _ in rows], 3) if {(a, b), (b, c), (a, c)} <= near.keys()}
    got = {tuple(r.simplex): r.birth for r in simplices.vietoris_rips(points, 0.9).collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-12 for s in want)
    counts = {r.dim: r.n for r in simplices.vietoris_rips_counts(points, 0.9).collect()}
    assert counts == {d: sum(len(s) == d + 1 for s in want) for d in range(3)}
    assert [r.n for r in simplices.vietoris_rips_counts(points.filter("id < 0"), 0.9).orderBy("dim").collect()] == [0, 0, 0]


def test_repeated_ids_count_as_rows_do_in_a_join(spark):
    points = spark.createDataFrame([(0, [0.0]), (0, [0.1]), (1, [0.2]), (2, [0.3]), (2, [0.4])], "id bigint, vec array<float>")
    assert [r.n for r in simplices.vietoris_rips_counts(points, 0.9).orderBy("dim").collect()] == [5, 2 + 2 + 4, 2 * 2 * 4]


def test_query_takes_thousands_of_points_and_a_large_group(spark, tmp_path):
    from tessera.plans.catalog_more import vietoris_rips

    rng = np.random.default_rng(6)
    far = rng.normal(size=(2500, 64))
    group = rng.normal(size=64) + rng.normal(0, 0.02, (500, 64))
    x = np.concatenate([far, group])
    x /= np.linalg.norm(x, axis=1)[:, None]
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    began = time.time()
    counts = {r.dim: r.n for r in vietoris_rips(spark, str(tmp_path)).collect()}
    assert time.time() - began < 60
    others = sum(int((x[a] @ x[a + 1 :].T >= 1 - 0.405).sum()) for a in range(3000)) - comb(500, 2)
    assert counts == {0: 3000, 1: comb(500, 2) + others, 2: comb(500, 3)}
