import random


import __spark_entry__
import corpus_pipeline
from tessera.llm import exact, langid
from tests_llm_helpers import brute_classes, brute_leaks


def write(spark, folder, docs, items):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def corpus():
    rnd = random.Random(11)
    syllables = {"xx": ["ka", "lo", "mi", "zu", "ra", "te"], "yy": ["schr", "ung", "ein", "ter", "ob", "isch"]}
    word = lambda lang: "".join(rnd.choice(syllables[lang]) for _ in range(rnd.randint(1, 5)))
    text = lambda lang, n: " ".join(word(lang) for _ in range(n))
    items = [(k, text("xx", 40)) for k in range(6)]
    docs = []
    for i in range(120):
        lang = rnd.choice(["xx", "yy"])
        docs.append([i, text(lang, rnd.randint(30, 150)), lang, rnd.choice(["a", "b", None])])
    for i in range(120, 150):
        like = docs[rnd.randrange(120)]
        words = like[1].split()
        if i % 3 == 0:
            words = words[:]
        elif i % 3 == 1:
            words[rnd.randrange(len(words))] = "changed"
        else:
            words[len(words) // 2 : len(words) // 2] = rnd.choice(items)[1].split()
        docs.append([i, ("  " if i % 2 else " ").join(words), like[2], like[3]])
    return docs + [[200, None, "xx", "a"], [201, "", None, "b"], [202, "12 34", "yy", "a"], [203, "日本語の文章です" * 40, None, "a"], [204, docs[0][1], None, "b"]], items


def test_pipeline_against_brute_force(spark, tmp_path):
    docs, items = corpus()
    write(spark, str(tmp_path), docs, items)
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    # Stage 1 by the operator's own decisions on each text; the rest by brute force.
    model = langid.fit(table.filter(~langid.is_held_out()))
    left = [d for d in docs if not model.predict([d[1] or ""])[2][0]]
    assert {d[0] for d in docs} - {d[0] for d in left} == {200, 201, 202, 203}
    groups = {}
    for d in left:
        groups.setdefault(exact.normalised(d[1]), []).append(d)
    left = sorted((min(g, key=lambda d: (-len(d[1]), d[0])) for g in groups.values()), key=lambda d: d[0])
    classes = brute_classes([d[1] for d in left])
    left = [d for k, d in enumerate(left) if classes[k] == k]
    leaked = {d for d, _ in brute_leaks([(d[0], d[1]) for d in left], items, 0.6, 0.8)}
    assert leaked
    left = [d for d in left if d[0] not in leaked]
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(out) == [d[0] for d in left]
    sizes = {d[0]: len(d[1].split()) for d in left}
    assert all(r.size == sizes[i] and r.taken % max(r.size, 1) == 0 for i, r in out.items())
    per_source, taken = {}, {}
    for d in left:
        per_source[d[3]] = per_source.get(d[3], 0) + sizes[d[0]]
        taken[d[3]] = taken.get(d[3], 0) + out[d[0]].taken
    for d in left:
        assert out[d[0]].source_size == per_source[d[3]] and abs(taken[d[3]] - out[d[0]].target) <= max(sizes.values())


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    docs, items = corpus()
    write(spark, str(tmp_path), docs, items)
    table = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumnRenamed("n_chars", "_found")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_copies", "near_copies", "benchmark_leaks", "mixture"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table.limit(0), str(tmp_path))
        assert out.count() == 0
        if name != "mixture":
            assert out.columns == table.columns
    first = corpus_pipeline.language(spark, table, str(tmp_path))
    assert first.columns == table.columns and first.count() == len(docs) - 4


def test_null_and_repeated_ids_keep_their_texts(spark, tmp_path):
    text = lambda k, n=40: " ".join(f"w{k}x{j}" for j in range(n))
    item = text(99)
    rows = [(None, text(0)), (None, text(1)), (None, text(1)), (5, text(2)), (5, text(3)), (None, text(4) + " " + item), (5, text(5) + " " + item), (6, text(3) + " more"), (7, text(2).replace(" ", "  ", 1))]
    write(spark, str(tmp_path), [(i, t, "xx", "a") for i, t in rows], [(1, item)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    found = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    exact_left = [rows[k] for k in (0, 1, 4, 5, 6, 7, 8)]
    docs = corpus_pipeline.exact_copies(spark, docs, str(tmp_path))
    assert found(docs) == sorted(exact_left, key=repr)
    docs = corpus_pipeline.near_copies(spark, docs.localCheckpoint(), str(tmp_path))
    assert found(docs) == sorted((rows[k] for k in (0, 1, 4, 5, 6, 8)), key=repr)
    docs = corpus_pipeline.benchmark_leaks(spark, docs.localCheckpoint(), str(tmp_path))
    assert found(docs) == sorted((rows[k] for k in (0, 1, 4, 8)), key=repr)


def test_entry_registers_all_queries():
    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)


def test_brute_force_helpers_agree():
    assert brute_classes(["a b c d e f", "a  b c d e f", "x"]) == [0, 0, 2]
