import random

import numpy as np
import pytest

from tessera.llm import graph, neardup
from tests_llm_helpers import brute_classes


def corpus(seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6)))
    out = []
    for _ in range(25):
        base = [word() for _ in range(rnd.choice([6, 60, 200]))]
        out.append(" ".join(base))
        for _ in range(rnd.randint(0, 4)):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 2, 6])):
                copy[rnd.randrange(len(copy))] = word()
            out.append("  ".join(copy))
    return out + [None, "", " \n", "one two", "one two", "one  two three", "w " * 20_000, "w " * 15_000]


@pytest.mark.parametrize("weighting", ["set", "count"])
def test_classes_against_brute_force(spark, weighting):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, same string, keys int")
    out = {r.id: r for r in neardup.near_duplicates(df, weighting=weighting).collect()}
    want = brute_classes(texts, weighting)
    assert [out[i].class_id for i in range(len(texts))] == want
    assert all(out[i].kept == (want[i] == i) for i in range(len(texts)))
    kept = neardup.drop_near_copies(df, weighting=weighting)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_one_large_group_of_near_copies(spark):
    rnd = random.Random(9)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(400):
        copy = list(base)
        copy[rnd.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in out} == {0} and sum(r.kept for r in out) == 1


@pytest.mark.parametrize("group", [0, 150])
def test_pairs_inside_a_large_template_bucket(spark, group):
    """Texts at 0.79 of each other, near copies at 0.81 of some, and a large class in the same buckets."""
    rnd = random.Random(5)
    template = [f"t{k}" for k in range(150)]
    texts = [" ".join(template + [f"u{i}x{k}" for k in range(19)]) for i in range(500)]
    copies = rnd.sample(range(500), 60)
    for i in copies:
        texts.append(" ".join(texts[i].split()[:-17] + [f"c{i}x{k}" for k in range(17)]))
    texts += [" ".join(template + [f"g{k}" for k in range(18)] + [f"z{j}"]) for j in range(group)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.id: r.class_id for r in neardup.near_duplicates(df).collect()}
    assert [out[500 + k] for k in range(60)] == copies
    assert all(out[i] == i for i in range(500)) and {out[i] for i in range(560, len(texts))} <= {560}


def test_unmet_pairs_hold_every_link(spark):
    rnd = random.Random(6)
    sets = {i: rnd.sample(range(40), rnd.randint(1, 40)) for i in range(0, 120, 2)}
    sets |= {i + 1: sorted(set(s) - set(rnd.sample(s, min(len(s) // 6, 3)))) for i, s in sets.items()}
    root = {i: i - i % 12 if i < 60 else i for i in sets}
    raw = spark.createDataFrame([(i, np.array(sorted(s), np.int64).tobytes()) for i, s in sets.items()], "id long, shingles binary")
    field = spark.createDataFrame(list(root.items()), "member long, root long")
    got = {(r.a, r.b) for r in neardup._unmet(raw, field, 0.8).collect()}
    links = {(a, b) for a in sets for b in sets if a < b and root[a] != root[b] and len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))}
    assert links and links <= got and all(root[a] != root[b] for a, b in got)


def test_repeats_nulls_and_empty(spark):
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(5, text), (5, text), (7, text), (None, text), (None, None)], "doc_id long, text string")
    out = neardup.near_duplicates(df).collect()
    assert sorted((r.id or -1, r.class_id or -1) for r in out) == [(-1, -1), (-1, -1), (5, 5), (5, 5), (7, 5)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0
    assert neardup.near_duplicates(df.limit(1)).count() == 1


@pytest.mark.parametrize("weights", [(1.0, 1.0), (3.0, 1.0), (2.5, 0.25)])
def test_dart_signatures_estimate_weighted_similarity(weights):
    rnd = np.random.default_rng(4)
    hits, total, k = 0, 0, 64
    shared, own = weights
    for _ in range(60):
        e = rnd.integers(0, 2**63, 90, dtype=np.uint64)
        a, b = e[:60], np.concatenate([e[:30], e[60:]])
        w = np.array([shared] * 30 + [own] * 30)
        s = neardup.dart_signatures(np.concatenate([a, b]), np.repeat([0, 1], 60), 2, k, np.concatenate([w, w]))
        hits += int((s[0] == s[1]).sum())
        total += k
    want = shared * 30 / (shared * 30 + own * 60)
    assert abs(hits / total - want) < 0.03


def test_components(spark):
    rnd = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(50)] + [(300, 300)]
    out = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert out == {n: find(n) for n in root if n != 300}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ids_of_any_type(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [("b", text), ("a", text + " more"), ("c", "other words here"), (None, text), ("d", "")]
    out = {(r.id, r.class_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert out == {("b", "a", False), ("a", "a", True), ("c", "c", True), (None, None, True), ("d", "d", True)}
