"""The registered queries of the corpus operators over whole small tables: their
columns and types, and their values against the library, brute force or held-out rows."""

import glob
import os
import re
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
from tests_llm_helpers import brute_classes, brute_leaks
from tokenizers import Tokenizer

from tessera.llm import entries, urls

FOLDER = os.environ.get("TESSERA_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")
# The columns of each query's contract.
COLUMNS = {
    "op1_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op2_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op3_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op4_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op5_decontamination": {"doc_id": "bigint", "item_id": "bigint"},
    "op6_near_dedup": {"doc_id": "bigint", "class_id": "bigint", "n_links": "bigint", "kept": "boolean"},
    "op7_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op8_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op9_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op10_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
}


@pytest.fixture(scope="module")
def found(spark):
    kept = {}

    def of(name):
        if name not in kept:
            df = entries.QUERIES[name](spark, FOLDER)
            types = dict(df.dtypes)
            assert {c: types[c] for c in COLUMNS[name]} == COLUMNS[name]
            kept[name] = df.collect()
        return kept[name]

    return of


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(entries.SQL))
def test_query_matches_sql(found, tables, name):
    want = tables.sql(entries.SQL[name])
    columns = sorted(COLUMNS[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in found(name)), key=repr) == sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=repr)


def test_languages_of_held_out_rows(found, tables):
    lang = dict(tables.sql("SELECT doc_id, lang FROM documents").fetchall())
    rows = [r for r in found("op1_language_id") if r.held_out and lang[r.doc_id] is not None and r.lang_pred != "und"]
    right = sum(r.lang_pred == lang[r.doc_id] for r in rows)
    assert len(rows) > 20 and right >= 0.97 * len(rows)


def test_token_counts_are_the_library_s(found, tables):
    text = dict(tables.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in found("op4_token_counts"):
        n = len(library.encode(text[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text[r.doc_id].encode()), n, n > 512)


def test_leaks_are_those_of_brute_force(found, tables):
    docs, items = (tables.sql(f"SELECT * FROM (SELECT {k}, text FROM {t})").fetchall() for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert {(r.doc_id, r.item_id) for r in found("op5_decontamination")} == set(brute_leaks(docs, items, 0.6, 0.8))


def test_classes_are_those_of_brute_force(found, tables):
    docs = tables.sql("SELECT doc_id, text FROM documents ORDER BY 1").fetchall()
    want = brute_classes([t for _, t in docs])
    assert {r.doc_id: r.class_id for r in found("op6_near_dedup")} == {i: docs[k][0] for (i, _), k in zip(docs, want, strict=True)}


def test_urls_by_rule(found, tables):
    url = dict(tables.sql("SELECT page_id, url FROM pages").fetchall())
    rows = found("op7_url_filter")
    assert len(rows) == len(url)
    for r in rows:
        host, path = urls.split_url(url[r.page_id])
        fits = [(h + p, v) for v, h, p in entries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda f: len(f[0])) if fits else (None, r.verdict)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict) and r.verdict in ("allow", "block")


def test_mix_by_water_filling(found, tables):
    docs = tables.sql("SELECT doc_id, text, source FROM documents").fetchall()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in docs}
    of = {i: s for i, _, s in docs}
    total = defaultdict(int)
    for i in size:
        total[of[i]] += size[i]
    names = sorted((s for s in total if s is not None)) + [s for s in total if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:
        room, load = sum(total.values()) - sum(target.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if room * weight[s] / load > 3 * total[s]}
        target |= {s: 3 * total[s] for s in over} if over else {s: room * weight[s] / load for s in open_}
        open_ = open_ - over if over else set()
    rows = found("op8_mixing")
    assert Counter(r.doc_id for r in rows) == Counter(list(size))
    taken = defaultdict(int)
    for r in rows:
        taken[of[r.doc_id]] += r.taken
        assert r.size == size[r.doc_id] and r.source_size == total[of[r.doc_id]] and r.target == pytest.approx(target[of[r.doc_id]])
        assert 0 <= r.taken <= 3 * r.size and (r.taken == 0 if r.size == 0 else r.taken % r.size == 0)
    for s in names:
        assert abs(taken[s] - target[s]) <= max(size[i] for i in size if of[i] == s)
