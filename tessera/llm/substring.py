"""Removal of repeated word runs, found by recompression.

Each round renames a document's symbol string: maximal runs of one symbol
become one symbol, then neighbouring pairs of a left-class and a right-class
symbol become one.  Names and classes are hashes of content (a pair's of its
two names), which makes them the same in every document without an exchange;
one Spark count over the corpus then says which names are shared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import CHUNK_BYTES, chunks, hash_table, hash_words, mix64, rolling, text_buffers, word_spans
from tessera.llm.repeats import counted, covered, keyed, ranges_of, repeated_spans, with_spans

WINDOW = 35
# More rounds give longer symbols but more, shorter ranges: rows to exchange.  The result is the same for any number.
ROUNDS = 3
_U = np.uint64


class Level:
    """A symbol string: names, documents, the words [start, end) of each symbol,
    and the words [lo, hi) that decide that it arises there.  At a document's
    edge lo or hi lies outside of the document, as the missing neighbour is not
    part of any window."""

    def __init__(self, name, doc, start, end, lo, hi):
        self.name, self.doc, self.start, self.end, self.lo, self.hi = name, doc, start, end, lo, hi


def _merged(level: Level, first: np.ndarray, name: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Level:
    last = np.append(first[1:], len(level.name)) - 1
    return Level(name, level.doc[first], level.start[first], level.end[last], lo, hi)


def _neighbours(level: Level) -> tuple[np.ndarray, np.ndarray]:
    """lo of the symbol before and hi of the symbol after; one beyond the edge of the document."""
    same = level.doc[1:] == level.doc[:-1]
    before, after = level.start - 1, level.end + 1
    before[1:] = np.where(same, level.lo[:-1], before[1:])
    after[:-1] = np.where(same, level.hi[1:], after[:-1])
    return before, after


def compress_runs(level: Level, nth: int) -> Level:
    """Maximal runs of one name become one symbol named by it and the length.
    A run is decided by the symbols on both sides of it."""
    new = np.ones(len(level.name), bool)
    new[1:] = (level.name[1:] != level.name[:-1]) | (level.doc[1:] != level.doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(level.name)) - 1
    n = (last - first + 1).astype(np.uint64)
    name = np.where(n > 1, mix64(level.name[first] + n * _U(0xD6E8FEB86659FD93) + _U(2 * nth)), level.name[first])
    before, after = _neighbours(level)
    return _merged(level, first, name, before[first], after[last])


def compress_pairs(level: Level, nth: int) -> Level:
    """Left-class symbols join the right-class symbol after them.  A pair is
    decided by its two names; a symbol that stays alone also by the neighbour
    that could have joined it."""
    if len(level.name) < 2:
        return level
    side = (mix64(level.name ^ hash_table(64, 41)[nth % 64]) & _U(1)).astype(bool)  # True: left
    pair = side[:-1] & ~side[1:] & (level.doc[1:] == level.doc[:-1])
    second = np.concatenate([[False], pair])
    heads = np.concatenate([pair, [False]])
    first = np.flatnonzero(~second)
    paired = heads[first]
    after_it = np.minimum(first + 1, len(level.name) - 1)
    joined = mix64(level.name[first] * _U(0x9E3779B97F4A7C15) + mix64(level.name[after_it]) + _U(2 * nth + 1))
    before, after = _neighbours(level)
    lo = np.where(paired | side[first], level.lo[first], before[first])
    hi = np.where(paired, level.hi[after_it], np.where(side[first], after[first], level.hi[first]))
    return _merged(level, first, np.where(paired, joined, level.name[first]), lo, hi)


def recompress(words: np.ndarray, doc: np.ndarray, size: int, rounds: int | None = None) -> list[Level]:
    """The symbol strings round by round, up to the last one with a symbol that
    some run of ``size`` words of a document decides, or to the given number of
    rounds; words are numbered over all rows.

    A window that decides a symbol also decides the symbols it is made of, so the
    rounds that a window sees depend on its own words alone, not on what else is
    in the batch.  In each round a symbol inside a document takes in a neighbour or
    depends on one more, so the rounds end."""
    at = np.arange(len(words))
    level = Level(words, doc, at, at + 1, at, at + 1)
    levels = [level]
    begin, end = np.searchsorted(doc, doc, side="left"), np.searchsorted(doc, doc, side="right")
    nth = 0
    while rounds is None or nth < rounds:
        level = compress_pairs(compress_runs(level, nth), nth)
        # A symbol's deciding words never shrink from its own: keep them in order for searching.
        level.lo = np.minimum.accumulate(level.lo[::-1])[::-1]
        level.hi = np.maximum.accumulate(level.hi)
        if not ((level.hi - level.lo <= size) & (level.lo >= begin[level.start]) & (level.hi <= end[level.start])).any():
            return levels
        levels.append(level)
        nth += 1
    return levels


def window_anchors(levels: list[Level], n_windows: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, level, first word) of the symbol that each window [i, i+size)
    carries: of the symbols of the highest level that are decided inside the
    window, the longest, among equally long ones that of least name, the
    leftmost if equal.  (Long symbols are rare by chance, so few windows that
    aren't repeats share one.)"""
    name, depth, place = np.zeros(n_windows, np.uint64), np.full(n_windows, -1), np.zeros(n_windows, np.int64)
    left = np.arange(n_windows)
    for d in range(len(levels) - 1, -1, -1):
        level = levels[d]
        if not len(left):
            break
        a = np.searchsorted(level.lo, left, side="left")
        b = np.searchsorted(level.hi, left + size, side="right")
        has = b > a
        where, a, b = left[has], a[has], b[has]
        if len(where):
            size_ = np.minimum(level.end - level.start, 31).astype(np.uint64)
            score = ((_U(31) - size_) << _U(59)) | (level.name >> _U(5))
            span = np.frexp((b - a).astype(float))[1] - 1  # floor(log2)
            best = np.arange(len(level.name))
            out = np.empty(len(where), np.int64)
            for k in range(int(span.max()) + 1):
                if k:
                    half = 1 << (k - 1)
                    x, y = best[:-half], best[half:]
                    best = np.where(score[y] < score[x], y, x)
                now = span == k
                x, y = best[a[now]], best[b[now] - (1 << k)]
                out[now] = np.where(score[y] < score[x], y, x)
            name[where], depth[where], place[where] = level.name[out], d, level.start[out]
        left = left[~has]
    return name, depth, place


def _parsed(texts: pa.Array):
    raw, off = text_buffers(texts)
    starts, ends, doc = word_spans(raw, off)
    size = np.bincount(doc, minlength=len(texts))
    return raw, off, starts, ends, doc, np.cumsum(size) - size, hash_words(raw, starts, ends)


def _anchors(size: int, rounds: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, hs, texts in chunks(batch.columns, 2, CHUNK_BYTES):
                _, _, _, _, doc, first_word, words = _parsed(texts)
                m = len(words) - size + 1
                if m <= 0:
                    continue
                name, depth, place = window_anchors(recompress(words, doc, size, rounds), m, size)
                inside = doc[:m] == doc[size - 1 :]
                at, n = ranges_of(np.where(inside, place, -1), doc[:m])
                if not len(at):
                    continue
                key = mix64(name[at] + mix64(depth[at].astype(np.uint64)))
                # The range as a whole: all its words, and where the anchor lies in it.
                total = np.zeros(len(words) + 1, np.uint64)
                np.cumsum(words * _powers(len(words)), out=total[1:])
                whole = (total[at + n + size - 1] - total[at]) * _inverse_powers(len(words))[at]
                mark = mix64(whole + mix64(n.astype(np.uint64) * _U(3) + (place[at] - at).astype(np.uint64) * _U(0x10001)))
                row = doc[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(mark.view(np.int64)), ids.take(pa.array(row)), hs.take(pa.array(row)), pa.array((at - first_word[row]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["key", "print", "id", "h", "at", "n"],
                )

    return run


_BASE = 0x9E3779B97F4A7C15
_TABLES: dict[str, np.ndarray] = {}


def _table(which: str, base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64; kept, and doubled when too short."""
    have = _TABLES.get(which)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.ones(1, np.uint64)
        while len(have) < size:
            step = _U(pow(base, len(have), 1 << 64))
            have = np.concatenate([have, have * step])
        if size <= 1 << 21:  # longer tables are for one very long text
            _TABLES[which] = have
    return have[:n]


def _powers(n: int) -> np.ndarray:
    return _table("up", _BASE, n)


def _inverse_powers(n: int) -> np.ndarray:
    return _table("down", pow(_BASE, -1, 1 << 64), n)


def _emit(size: int):
    """The fingerprints of every window of the wanted ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, hs, texts, wanted in chunks(batch.columns, 2, CHUNK_BYTES):
                _, _, _, _, _, first_word, words = _parsed(texts)
                p, q = rolling(words, size, 61), rolling(words, size, 62)
                flat = wanted.flatten()
                row = np.repeat(np.arange(len(texts)), np.diff(np.asarray(wanted.offsets)))
                at, n = (flat.field(c).to_numpy() for c in ("at", "n"))
                ask = flat.field("ask").to_numpy(zero_copy_only=False)
                if not len(at):
                    continue
                within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                own_row, own_at = np.repeat(row, n), np.repeat(at, n) + within
                window = first_word[own_row] + own_at
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(own_row)), hs.take(pa.array(own_row)), pa.array(own_at.astype(np.int32)), pa.array(p[window].view(np.int64)), pa.array(q[window].view(np.int64)), pa.array(np.repeat(ask, n))],
                    names=["id", "h", "at", "p", "q", "ask"],
                )

    return run


def _cut(size: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, texts, spans in chunks(batch.columns, 2, CHUNK_BYTES):
                raw, _, starts, ends, doc, first_word, _ = _parsed(texts)
                n_words = np.bincount(doc, minlength=len(texts))
                removed, digests, kept_texts = [], [], []
                for i, own in enumerate(spans.to_pylist()):
                    a, b = first_word[i], first_word[i] + n_words[i]
                    gone = covered(own, size, int(n_words[i]))
                    s, e = starts[a:b][~gone], ends[a:b][~gone]
                    kept = b" ".join([raw[x:y].tobytes() for x, y in zip(s.tolist(), e.tolist(), strict=True)])
                    removed.append(int(gone.sum()))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    kept_texts.append(kept.decode() if with_text else None)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n_words.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(digests), pa.array(kept_texts, pa.string())], names=["id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def remove_repeated_words(docs: DataFrame, size: int = WINDOW, rounds: int | None = ROUNDS, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """``id, n_words, n_removed, kept_sha256, kept`` per input row: each word that
    is covered by a run of ``size`` words that also starts anywhere else, in
    the same text or another, is removed; kept words are joined by one space
    (``kept`` is null without ``with_text``).

    Words are ``[^\\x20\\x09-\\x0D]+``.  After ``rounds`` rounds of recompression (None: as
    many as windows of this size decide symbols of; the result doesn't depend on it) every window is filed under the least high-level symbol that its own words decide
    (or one of a lower level, down to the words, if no higher one is decided).
    Equal windows have equal symbols at equal places, so windows whose symbol
    occurs once are no repeats.  Ranges of windows around a shared symbol that
    are equal throughout are repeats; the windows of the others are compared by
    two 64-bit fingerprints.

    Null texts have no words; texts shorter than a window keep all words; rows
    that repeat a text are repeats of each other; an empty table gives an empty
    result.  Names and counts cover all documents; no group is gathered.
    """
    source = keyed(docs, id_col, text_col)
    spans = repeated_spans(source, _anchors(size, rounds), _emit(size), counted, "id ID, h int, at int, p long, q long, ask boolean", "words")
    kind = source.schema["id"].dataType.simpleString()
    return with_spans(source, spans).mapInArrow(_cut(size, with_text), f"id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")
