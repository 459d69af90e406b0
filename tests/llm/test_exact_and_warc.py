import hashlib
import struct

import pytest
import zstandard
from pyspark.errors import PythonException

from tessera.llm import exact, warc

LONG = "x y " * 60_000
ROWS = [
    (1, "a b c", "s"), (2, "abc", "s"), (3, " a\tb\nc ", None), (4, None, "s"), (5, "", "s"), (6, "\n\n", "t"),
    (7, "abd", "s"), (8, LONG, "s"), (9, LONG.replace(" ", ""), "s"), (10, "é é", "s"), (11, "éé", "s"), (2, "abc", "s"), (12, "only one", "s"),
]


def docs(spark, rows=ROWS):
    # id, group_key, digest and n clash with names that the operator uses itself
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, source string, group_key string, digest string, n int")


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(exact.normalised(t), []).append((-len(t or ""), i))
    return {(i, min(groups[exact.normalised(t)])[1], len(groups[exact.normalised(t)])) for i, t, *_ in rows}


@pytest.mark.parametrize("digest_all,keys", [(False, 200_000), (True, 200_000), (False, 0), (True, 0)])
def test_exact_groups(spark, digest_all, keys, monkeypatch):
    monkeypatch.setattr(exact, "MAX_BROADCAST_KEYS", keys)
    out = exact.exact_dedup(docs(spark), digest_all=digest_all).collect()
    assert len(out) == len(ROWS)
    assert {(r.id, r.keep_id, r.group_size) for r in out} == brute(ROWS)
    assert all(r.kept == (r.id == r.keep_id) for r in out)
    texts = {i: t for i, t, _ in ROWS}
    for r in out:
        want = hashlib.sha256(exact.normalised(texts[r.id]).encode()).hexdigest()
        assert r.digest == want or (not digest_all and r.digest is None and r.group_size == 1)


def test_exact_null_ids_and_empty_table(spark):
    out = exact.exact_dedup(docs(spark, [(None, "q", "s"), (3, "q", "s")])).collect()
    assert {(r.id, r.keep_id, r.kept) for r in out} == {(None, None, True), (3, None, False)}
    assert exact.exact_dedup(docs(spark, [])).count() == 0


def test_drop_exact_copies_keeps_columns_and_one_row(spark):
    left = exact.drop_exact_copies(docs(spark))
    assert left.columns == docs(spark).columns
    assert sorted(r.doc_id for r in left.collect()) == [3, 6, 7, 8, 10, 12]


PAGES = [(5, "http://a.b/é\r\nx", "<p>" + "z" * 200), (3, None, "<p>" + "z" * 200), (9, "u", "<p>" + "z" * 200), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", "ü" * 90), (8, "u", "ü" * 90), (10, "u", "line\r\n\r\nline" * 5000), (3, None, "<p>" + "z" * 200)]


def expected(rows):
    first = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 100:
            first[raw] = min(first.get(raw, i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        target = first.get(raw, i)
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if target == i else "revisit", None if target == i else target))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [PAGES, PAGES + [(100 + k, "http://h/", f"<html>{k} some words of a page number {k * 7919} </html>" * 20) for k in range(300)], []])
def test_warc_round_trip(spark, rows):
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    manifest = warc.write_warc(pages)
    assert sum(r.records for r in manifest.collect()) == len(rows)
    records = warc.read_warc(spark, [r.archive for r in manifest.collect()])
    out = warc.page_records(records).collect()
    assert sorted([tuple(r) for r in out], key=repr) == expected(rows)
    payloads = {r.record_id: bytes(r.payload) for r in records.collect() if r.record_type == "response"}
    for i, _, h in rows:
        if f"<urn:page:{i}>" in payloads:
            assert payloads[f"<urn:page:{i}>"] == (h or "").encode()


def archive(*frames, dictionary=b""):
    return (warc.dictionary_frame(dictionary) if dictionary else b"") + b"".join(frames)


def frame(data, dictionary=None):
    kind = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor()
    return kind.compress(data)


def record(n):
    body = f"page {n}".encode()
    return warc.record_bytes(n, "http://h/", hashlib.sha256(body).hexdigest(), body)


def test_reader_takes_dictionary_from_the_leading_frame():
    dictionary = zstandard.train_dictionary(4096, [record(k) * 3 for k in range(500)]).as_bytes()
    data = archive(*[frame(record(k), dictionary) for k in range(50)], dictionary=dictionary)
    assert struct.unpack_from("<I", data)[0] == warc.DICTIONARY_MAGIC
    assert [r["payload"] for _, r in warc.read_archive(data)] == [f"page {k}".encode() for k in range(50)]


@pytest.mark.parametrize(
    "data",
    [
        archive(frame(record(1))[:-3]),
        archive(frame(record(1)), b"junk"),
        archive(frame(record(1) + record(2))),
        archive(frame(record(1).replace(b"page 1", b"page 2"))),
        archive(frame(record(1).replace(b"WARC/1.1", b"HTTP/1.1"))),
        archive(frame(record(1).replace(b"Content-Length: ", b"Content-Length: 9"))),
        warc.dictionary_frame(b"abc")[:-1],
    ],
)
def test_reader_refuses_broken_archives(data):
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(data))


def test_broken_archive_names_the_file(spark, tmp_path):
    (tmp_path / "bad.warc.zst").write_bytes(archive(frame(record(1)), b"junk"))
    with pytest.raises(PythonException, match="bad.warc.zst"):
        warc.read_warc(spark, [str(tmp_path)]).collect()


def test_urls_and_ids_come_back(spark, tmp_path):
    rows = [("a", "http://a.b/x%20y?q=café"), ("b", " http://edge "), ("c", "http://a/\n\r%"), ("d", None), ("a", "http://a.b/%25")]
    df = spark.createDataFrame([(i, u, "p" * 200) for i, u in rows], "page_id string, url string, html string")
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_warc(df, folder)
    (tmp_path / "w" / "left-by-a-failed-attempt.warc.zst").write_bytes(b"broken")
    with pytest.raises(PythonException):
        warc.read_warc(spark, [folder]).count()
    (tmp_path / "w" / "left-by-a-failed-attempt.warc.zst").unlink()
    records = warc.read_manifest(manifest, folder)
    assert sorted((r.record_id[10:-1], r.uri) for r in records.collect()) == sorted(rows, key=lambda r: (r[0], r[1]))
    out = warc.page_records(records, "string").collect()
    assert {(r.page_id, r.record_type, r.refers_to) for r in out} == {("a", "response", None), ("b", "revisit", "a"), ("c", "revisit", "a"), ("d", "revisit", "a")}
    part = manifest.filter("false")
    assert warc.read_manifest(part, folder).count() == 0


def test_records_outside_the_manifest_are_left_out(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    df = spark.createDataFrame([(i, "http://a", f"text {i}") for i in range(20)], "page_id long, url string, html string")
    warc.write_warc(df.filter("page_id < 10").coalesce(1), folder).count()
    second = warc.write_warc(df.filter("page_id >= 10").coalesce(1), folder)
    assert {r.page_id for r in warc.page_records(warc.read_manifest(second, folder)).collect()} == set(range(10, 20))
