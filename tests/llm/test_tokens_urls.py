import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import tokens, urls

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = [" ", "  ", "\n", "\t", "a", "b", "é", "ß", "1", "²", "٣", "’", "'s", "'", "<|endoftext|>", "\x1c", "\x85", "\u2003", "\u3000", "漢", "😀", "\u200b", "aaaaaaa", "...", "!", "\r\n", "\x00", "Ⅷ", "the ", "ation"]


def texts():
    rnd = random.Random(3)
    return [None, "", " ", "x" * 3000, "ab" * 5000, " the" * 2000] + ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))) for _ in range(400)]


def test_counts_equal_the_library(spark):
    rows = texts()
    lib = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = {r.doc_id: r.n for r in docs.select("doc_id", tokens.token_counts(F.col("text"), PATH).alias("n")).collect()}
    assert out == {i: len(lib.encode(t or "", add_special_tokens=False)) for i, t in enumerate(rows)}
    assert docs.limit(0).select(tokens.token_counts(F.col("text"), PATH)).count() == 0


def test_overlapping_pairs_merge_from_the_left():
    m = tokens.RankMerger(PATH)
    lib = Tokenizer.from_file(PATH)
    words = ["a" * n for n in range(1, 40)] + ["ab" * n for n in range(1, 20)]
    assert m.merge([w.encode() for w in words]).tolist() == [len(lib.encode(w)) for w in words]


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def brute_rule(url):
    host, path = urls.split_url(url)
    fits = [(v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[1]), default=(None, None))


URLS = [
    None, "", "no scheme", "http://", "http://A.Example.NET/en/1", "http://example.net/EN/1", "http://example.net/en", "x://sub.example.net/en/#f", "http://net", "http://net/", "http://planet/",
    "http://notexample.com/de/1", "http://a.example.com/de/?q", "http://a.example.com?/de/", "http://a.org/fr/1", "http://a.org#/fr/", "a://b://net/", "http://ÄÖ.net/x", "http://a.example.com/de/" + "y" * 50_000, "http://u\nv.net/\nx",
]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(rows)], "page_id long, url string, host string, listed string")


def test_listed_rules(spark):
    out = {r.id: r for r in urls.judge_urls(pages(spark, URLS), RULES).collect()}
    assert len(out) == len(URLS)
    for i, u in enumerate(URLS):
        verdict, rule = brute_rule(u)
        assert (out[i].host, out[i].path) == urls.split_url(u) and out[i].rule == rule
        if verdict:
            assert out[i].verdict == verdict
    assert urls.judge_urls(pages(spark, []), RULES).count() == 0


def test_mined_rules_match_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(600):
        toks = sorted({rnd.choice("abcdefgh") for _ in range(4)})
        rows.append((toks, "block" if {"a", "b"} <= set(toks) or "h" in toks else "allow" if rnd.random() < 0.98 else "block"))
    df = spark.createDataFrame(rows, "tokens array<string>, label string")
    rules = urls.mine_rules(df, min_support=0.02, min_confidence=0.95, min_rows=5)
    have = {(body, label) for body, label, *_ in rules}
    assert (frozenset("h"), "block") in have and (frozenset("ab"), "block") in have
    for body, label, confidence, support in rules:
        hit = [lab for t, lab in rows if body <= set(t)]
        assert confidence == pytest.approx(hit.count(label) / len(hit)) and support == pytest.approx(hit.count(label) / len(rows))
    best = {tuple(r.tokens): r.m for r in df.select("tokens", urls.match_rules(F.col("tokens"), rules).alias("m")).collect()}
    for t, m in best.items():
        fits = sorted(((-c, -s, -len(b), sorted(b), lab) for b, lab, c, s in rules if b <= set(t)))
        assert (m is None) == (not fits) and (m is None or m.label == fits[0][4])


def test_labels_of_another_table(spark):
    labels = spark.createDataFrame([(f"http://spam{k}.bad.com/p{k}/", "block") for k in range(40)] + [(f"http://ok{k}.good.com/p{k}/", "allow") for k in range(40)], "url string, label string")
    out = urls.judge_urls(pages(spark, ["http://spam99.bad.com/1", "http://ok99.good.com/1", "http://new.com/1"]), [], labels=labels).collect()
    assert [r.verdict for r in sorted(out, key=lambda r: r.id)] == ["block", "allow", "allow"]


def test_tokens_that_come_together_and_long_rules(spark):
    rnd = random.Random(9)
    together = [f"t{k:02}" for k in range(30)]  # 2**30 combinations, one item
    rows = [(["site", *together], "block")] * 60 + [(["site", *rnd.sample("abcdef", 3)], "allow") for _ in range(200)]
    rows += [(["site", *"pqrstu"], "block")] * 40 + [(["site", *rnd.sample("pqrstu", 5)], "allow") for _ in range(200)]
    df = spark.createDataFrame(rows, "tokens array<string>, label string")
    rules = {(body, label) for body, label, *_ in urls.mine_rules(df, min_support=0.02, min_confidence=0.9, min_rows=5)}
    assert (frozenset(["site", *together]), "block") in rules
    assert (frozenset(["site", *"pqrstu"]), "block") in rules  # six tokens and no fewer
    assert urls.mine_rules(df.limit(0)) == []


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": {"type": "BPE", "ignore_merges": True, "vocab": {}, "merges": []}}])
def test_other_settings_are_refused(tmp_path, change):
    import json

    spec = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "model": {"type": "BPE", "vocab": {}, "merges": []}} | change
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="settings"):
        tokens.RankMerger(str(path))
