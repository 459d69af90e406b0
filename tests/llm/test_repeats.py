import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import repeats, substring, suffixes


def make_texts(seed, unit):
    """Random texts over few words with planted repeats at all kinds of places."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "bb", "the", "é", "x1", "漢"]) if rnd.random() < 0.5 else "".join(rnd.choice("abcdef") for _ in range(rnd.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rnd.randint(unit // 2, 3 * unit))) for _ in range(8)]
    out = []
    for _ in range(60):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            parts.append(rnd.choice(passages) if rnd.random() < 0.4 else " ".join(word() for _ in range(rnd.randint(0, 2 * unit))))
        out.append(rnd.choice([" ", "\n", " \t"]).join(parts))
    out += [None, "", "   ", "w " * (unit - 1), "same " * (5 * unit), "same " * (3 * unit) + "end", out[0], out[0] + " tail", "q" * 3000, "z" + "q" * 900, "one two " * (3 * unit)]
    return out


def marks(n_units, starts, size):
    gone = [False] * n_units
    for s in starts:
        gone[s : s + size] = [True] * size
    return gone


def brute_words(texts, size):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = marks(len(w), [i for i in range(len(w) - size + 1) if count[tuple(w[i : i + size])] > 1], size)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def brute_bytes(texts, size):
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + size] for r in raws for i in range(len(r) - size + 1))
    out = []
    for r in raws:
        gone = marks(len(r), [i for i in range(len(r) - size + 1) if count[r[i : i + size]] > 1], size)
        kept = bytes(x for x, g in zip(r, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(texts)], "doc_id long, text string, key string, h int, spans string").repartition(3)


@pytest.mark.parametrize("size,rounds", [(35, 3), (35, None), (7, 3), (7, 0)])
def test_words_against_brute_force(spark, size, rounds):
    texts = make_texts(size, size)
    out = {r.id: (r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in substring.remove_repeated_words(frame(spark, texts), size, rounds).collect()}
    assert [out[i] for i in range(len(texts))] == brute_words(texts, size)


@pytest.mark.parametrize("size,hot", [(200, 4096), (60, 4096), (60, 0)])
def test_bytes_against_brute_force(spark, size, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_RANGES", hot)
    texts = make_texts(size + 1, 30)
    rows = suffixes.remove_repeated_bytes(frame(spark, texts), size).collect()
    out = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in rows}
    assert [out[i] for i in range(len(texts))] == brute_bytes(texts, size)


@pytest.mark.parametrize("f", [substring.remove_repeated_words, suffixes.remove_repeated_bytes])
def test_repeated_ids_and_empty_tables(spark, f):
    text = " ".join(f"word{k}" for k in range(60))
    other = " ".join(f"other{k}" for k in range(60))
    df = spark.createDataFrame([(1, text), (1, text), (1, other), (None, text)], "doc_id long, text string")
    out = sorted((r.id is None, r.n_removed > 0) for r in f(df).collect())
    assert out == [(False, False), (False, True), (False, True), (True, True)]
    assert f(df.limit(0)).count() == 0


def test_recompression_names_depend_on_content_alone():
    rnd = np.random.default_rng(1)
    inner = rnd.integers(1, 6, 300).astype(np.uint64)
    names = []
    for _ in range(2):
        words = np.concatenate([rnd.integers(1, 6, 50).astype(np.uint64), inner, rnd.integers(1, 6, 70).astype(np.uint64)])
        at = 50
        got = set()
        for d, level in enumerate(substring.recompress(words, np.zeros(len(words), np.int64), 35)):
            for n, s, e, lo, hi in zip(level.name.tolist(), level.start, level.end, level.lo, level.hi, strict=True):
                if lo >= at and hi <= at + 300 and hi - lo <= 35:
                    got.add((d, n, int(s) - at, int(e) - at))
        names.append(got)
    assert names[0] == names[1] and len({d for d, *_ in names[0]}) >= 4


def test_suffix_ranks_are_a_suffix_order():
    rnd = random.Random(0)
    for _ in range(400):
        n = rnd.randint(1, 50)
        raw = np.array([rnd.randint(1, rnd.choice([1, 2, 4])) for _ in range(n)])
        ranks = suffixes.suffix_ranks(np.unique(raw, return_inverse=True)[1] + 1, 1, 10**6)
        order = sorted(range(n), key=lambda i: raw[i:].tolist())
        assert [ranks[i] for i in order] == list(range(1, n + 1))


@pytest.mark.parametrize("size", [1, 2, 5, 35])
def test_rounds_end_on_any_batch(size):
    rnd = np.random.default_rng(size)
    for _ in range(60):
        lengths = rnd.integers(0, 40, rnd.integers(1, 6))
        doc = np.repeat(np.arange(len(lengths)), lengths)
        if len(doc):
            levels = substring.recompress(rnd.integers(1, rnd.integers(2, 9), len(doc)).astype(np.uint64), doc, size)
            assert len(levels) <= size + 1
