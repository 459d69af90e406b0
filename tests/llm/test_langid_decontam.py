import random

import numpy as np
import pytest

from tessera.llm import decontam, langid
from tests_llm_helpers import brute_leaks

SYLLABLES = {"xx": ["ka", "lo", "mi", "zu"], "yy": ["schr", "ung", "ein", "ter"], "zz": ["ção", "lh", "nh", "ei"]}


def sentence(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def labelled(spark):
    rnd = random.Random(1)
    rows = [(i, sentence(rnd, lang, rnd.randint(5, 80)), lang) for i, lang in enumerate(["xx", "yy", "zz"] * 80)]
    rows += [(1000, None, "xx"), (1001, "", "yy"), (1002, "123 !?", "zz"), (1003, sentence(rnd, "xx", 40), None), (1004, sentence(rnd, "yy", 120_000), "yy"), (1005, "ジャパン語の文章です。" * 30, None)]
    return spark.createDataFrame([(*r, 0.5, "s") for r in rows], "doc_id long, text string, lang string, score double, found string")


def test_language_identification(spark):
    docs = labelled(spark)
    model = langid.fit(docs.filter(~langid.is_held_out()))
    assert set(model.labels) == {"xx", "yy", "zz"} and len(model.labels) > 3
    out = {r.doc_id: r for r in docs.select("doc_id", "lang", langid.is_held_out().alias("held"), langid.identify(docs, model).alias("f")).collect()}
    held = [r for i, r in out.items() if i < 1000 and r.held]
    assert len(held) > 40 and all(r.f.lang == r.lang and not r.f.rejected for r in held)
    for i in (1000, 1001, 1002):
        assert out[i].f.lang == "und" and out[i].f.score == 0 and out[i].f.rejected
    assert out[1003].f.lang == "xx" and out[1004].f.lang == "yy"
    assert out[1005].f.rejected and out[1005].f.lang != "und"
    assert all(0 <= r.f.score <= 1 for r in out.values())


def test_prediction_does_not_depend_on_batches(spark):
    docs = labelled(spark).filter("doc_id < 60")
    model = langid.fit(docs)
    one = {r.doc_id: r.f for r in docs.coalesce(1).select("doc_id", langid.identify(docs, model).alias("f")).collect()}
    many = {r.doc_id: r.f for r in docs.repartition(7).select("doc_id", langid.identify(docs, model).alias("f")).collect()}
    assert all(one[i].lang == many[i].lang and abs(one[i].score - many[i].score) < 1e-5 for i in one)


def test_nothing_to_learn_from(spark):
    docs = labelled(spark)
    for train in (docs.limit(0), docs.filter("lang IS NULL"), docs.filter("doc_id IN (1001, 1002)")):
        model = langid.fit(train)
        assert {r.f.lang for r in docs.select(langid.identify(docs, model).alias("f")).collect()} == {"und"}


def test_held_out_is_crc32(spark):
    import zlib

    rows = {r.id: r.h for r in spark.range(50).select("id", langid.is_held_out("id").alias("h")).collect()}
    assert rows == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)}


def test_counts_of_pieces_add_up(monkeypatch):
    rnd = random.Random(3)
    texts = [sentence(rnd, "zz", n) for n in (1, 30, 400)] + ["", "12 34"]
    whole, letters = langid.counts(texts)
    for t, row, n in zip(texts, whole, letters, strict=True):
        alone, m = langid.counts([t])
        assert (alone[0] == row).all() and m[0] == n == sum(c.isalpha() for c in t)


def test_counts_of_a_long_text_in_slices(monkeypatch):
    rnd = random.Random(4)
    texts = [sentence(rnd, "zz", 3000) + "Σ ΣΑΣ", "x", sentence(rnd, "xx", 500)]
    whole, letters = langid.counts(texts)
    for size in (7, 100, 1001):
        monkeypatch.setattr(langid, "SLICE", size)
        again, n = langid.counts(texts)
        assert (again == whole).all() and (n == letters).all()


# ---- decontamination


def leak_case():
    rnd = random.Random(7)
    word = lambda: rnd.choice(["the", "of", "and", "to"]) if rnd.random() < 0.4 else "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rnd.choice([12, 30, 60, 150]))) for i in range(40)] + [(90, None), (91, ""), (92, "a b"), (93, "the of and to the of")]
    docs, planted = [], set()
    for i in range(60):
        body = text(rnd.randint(0, 400))
        if i % 3 == 0:
            item, words = rnd.choice(items[:40])
            if i % 6 == 0:
                words = words.upper().replace(" ", ", ")
            at = rnd.randint(0, len(body.split()))
            parts = body.split()
            body = " ".join(parts[:at] + [words] + parts[at:])
            planted.add((i, item))
        docs.append((i, body))
    return docs + [(100, None), (101, ""), (102, text(60_000) + " " + items[0][1])], items, planted | {(102, 0)}


@pytest.mark.parametrize("min_score,min_overlap,slab", [(0.6, 0.8, 1000), (0.3, 0.4, 7), (0.6, 0.8, 7)])
def test_leaks_against_brute_force(spark, min_score, min_overlap, slab, monkeypatch):
    monkeypatch.setattr(decontam, "SLAB_ITEMS", slab)
    monkeypatch.setattr(decontam, "PASS_BYTES", 30_000)
    docs, items, planted = leak_case()
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.id, r.item_id): r.score for r in decontam.find_leaks(df, bench, min_score, min_overlap).collect()}
    want = brute_leaks(docs, items, min_score, min_overlap)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)
    assert planted <= got.keys()


def test_short_and_changed_items(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    items = [[word() for _ in range(n)] for n in (1, 2, 4, 30)]
    changed = [word() if k % 7 == 6 else w for k, w in enumerate(items[3])]
    fill = [word() for _ in range(50)]
    docs = [(0, items[2]), (1, fill + items[2] + fill), (2, fill + items[1]), (3, items[0]), (4, fill + items[0]), (5, fill + changed), (6, [items[2][0], *fill, *items[2][1:]]), (7, fill)]
    docs = [(i, " ".join(w)) for i, w in docs]
    bench = [(k, " ".join(w)) for k, w in enumerate(items)]
    got = {(r.id, r.item_id) for r in decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == {(0, 2), (1, 2), (2, 1), (3, 0), (5, 3)} == set(brute_leaks(docs, bench, 0.6, 0.8))


def test_question_and_answer_columns(spark):
    bench = spark.createDataFrame([("x", "what is the tallest hill of the eastern plain", "mount ararel"), ("y", None, None)], "item_id string, q string, a string")
    docs = spark.createDataFrame([("1", "What is the tallest hill of the eastern plain? Mount Ararel."), ("2", "What is the tallest hill of the eastern plain?"), (None, None)], "doc_id string, text string")
    got = decontam.find_leaks(docs, bench, question_col="q", answer_col="a").collect()
    assert [(r.id, r.item_id, r.answer_overlap) for r in got] == [("1", "x", 1.0)]


def test_empty_tables(spark):
    docs, items, _ = leak_case()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontam.find_leaks(df, bench.limit(0)).count() == 0
    assert decontam.find_leaks(df.limit(0), bench).count() == 0


def test_in_order():
    a = np.array([1, 2, 3, 4], np.uint64)
    assert decontam.in_order(a, np.array([9, 1, 9, 2, 3, 9, 4], np.uint64)) == 1
    assert decontam.in_order(a, np.array([4, 3, 2, 1], np.uint64)) == 0.25
