import pytest

from tessera.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free} if free else {}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return {**fixed, **share}
        for s in over:
            fixed[s] = cap * sizes[s]
            left -= fixed[s]


def run(spark, rows, **how):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, target string")
    return mixing.mix_sources(docs, **how).collect()


def rows_of(spec):
    out, i = [], 0
    for source, n, words in spec:
        for k in range(n):
            out.append((i, "w " * (1 + (k * 7919) % words), source))
            i += 1
    return out


@pytest.mark.parametrize("spec", [[("a", 300, 20), ("b", 100, 30), ("c", 50, 10), ("é", 20, 5), (None, 40, 9)], [("a", 1, 3)], [("b", 2, 2), ("a", 400, 50)]])
def test_targets_and_taken(spark, spec):
    rows = rows_of(spec)
    out = run(spark, rows)
    assert sorted(r.id for r in out) == [r[0] for r in rows]
    source = {r[0]: r[2] for r in rows}
    sizes, taken, longest = {}, {}, {}
    for r in out:
        s = source[r.id]
        assert r.size == len(rows[r.id][1].split()) and r.taken % r.size == 0 and r.taken <= 3 * r.size
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        longest[s] = max(longest.get(s, 0), r.size)
    want = brute_targets(sizes)
    for r in out:
        assert r.source_size == sizes[source[r.id]] and abs(r.target - want[source[r.id]]) < 1e-6 * max(1, r.target)
    for s, t in want.items():
        assert abs(taken[s] - t) <= longest[s]


def test_reruns_agree_and_seeds_differ(spark):
    rows = rows_of([("a", 200, 9), ("b", 200, 9)])
    one, two, other = ({r.id: r.taken for r in run(spark, rows, seed=s)} for s in (0, 0, 1))
    assert one == two != other


def test_expected_share_is_kept(spark):
    rows = rows_of([("a", 30, 3), ("b", 30, 3)])
    total = [0] * 60
    for seed in range(12):
        for r in run(spark, rows, seed=seed):
            total[r.id] += r.taken / r.size / 12
    first = [r for r in run(spark, rows) if r.id == 0][0]
    assert abs(sum(total[:30]) / 30 - first.target / first.source_size) < 0.1


def test_nulls_repeats_and_empty(spark):
    out = run(spark, [(1, None, "a"), (2, "", "a"), (None, "x y", "a"), (3, "x y z", "b"), (3, "x y z", "b"), (3, "x y z", "b")])
    assert len(out) == 6
    assert all(r.taken == 0 for r in out if r.size == 0)
    assert run(spark, []) == []
    assert [tuple(r) for r in run(spark, [(1, None, None)])] == [(1, 0, 0, 0.0, 0)]


def test_plan_is_native(spark):
    docs = spark.createDataFrame([(1, "x", "a")], "doc_id long, text string, source string")
    plan = mixing.mix_sources(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_many_repeats_are_numbered_in_blocks(spark):
    counted = spark.createDataFrame([(1, "a", 3, 1), (2, "a", 3, 1000), (3, None, 0, 2501)], "doc long, source string, size long, times long")
    rows = mixing._numbered(counted).collect()
    assert sorted((r.doc, r.nth) for r in rows) == [(1, 1)] + [(2, k) for k in range(1, 1001)] + [(3, k) for k in range(1, 2502)]
