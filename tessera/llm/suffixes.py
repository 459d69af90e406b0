"""Removal of repeated byte strings, found with difference-cover suffix sorting.

Suffixes are dealt to tasks by content-defined anchors (see ``repeats``), so
that strings which can be equal are sorted by the same task.  Within a task the
difference-cover algorithm modulo 3 sorts sampled triples, recurses on their
names, merges the remaining suffixes, and adjacent prefixes are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import BYTE_CODE, CHUNK_BYTES, chunks, mix64, text_buffers
from tessera.llm.repeats import counted, covered, keyed, ranges_of, repeated_spans, with_spans
from tessera.llm.substring import _inverse_powers, _powers

WINDOW = 200
GRAM = 32
BATCH_BYTES = 1 << 20
_U = np.uint64


# ---------------------------------------------------------------- difference cover

def _bits(column: np.ndarray) -> int:
    return max(1, int(column.max()).bit_length()) if len(column) else 1


def _pack(columns: list[np.ndarray], bits: list[int]) -> np.ndarray:
    """Columns side by side in one number each; they fit into 64 bits."""
    key = columns[0].astype(np.uint64)
    for c, b in zip(columns[1:], bits[1:], strict=True):
        key = (key << _U(b)) | c.astype(np.uint64)
    return key


def _dense(columns: list[np.ndarray]) -> np.ndarray:
    """Order-preserving names, from 1, of rows given by columns of numbers."""
    bits = [_bits(c) for c in columns]
    if sum(bits) > 64:  # names of the first columns, then the last
        return _dense([_dense(columns[:-1]), columns[-1]])
    key = _pack(columns, bits)
    if sum(bits) <= 21:
        seen = np.zeros(1 << sum(bits), bool)
        at = key.astype(np.int64)
        seen[at] = True
        return np.cumsum(seen)[at]
    order = np.argsort(key)
    sorted_ = key[order]
    new = np.ones(len(key), np.int64)
    new[1:] = sorted_[1:] != sorted_[:-1]
    names = np.empty(len(key), np.int64)
    names[order] = np.cumsum(new)
    return names


def _comparable(x: list[np.ndarray], y: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two position sets as numbers that sort alike."""
    bits = [max(_bits(a), _bits(b)) for a, b in zip(x, y, strict=True)]
    if sum(bits) <= 64:
        return _pack(x, bits), _pack(y, bits)
    both = _dense([np.concatenate(c) for c in zip(x, y, strict=True)])
    return both[: len(x[0])], both[len(x[0]) :]


def suffix_ranks(text: np.ndarray, covers: int, need: int) -> np.ndarray:
    """1 + the number of smaller suffixes, for each suffix of ``text`` (numbers
    from 1 without gaps), exact up to at least ``need`` units; a number of
    ``text`` stands for ``covers`` units.  Suffixes equal so far share a rank."""
    n = len(text)
    if n == 0:
        return text
    if n < 3 or covers >= need:
        names = text
        if n < 3:
            s = np.concatenate([text, np.zeros(2, text.dtype)])
            names = _dense([s[:n], s[1 : n + 1]])
        times = np.bincount(names)
        return (np.cumsum(times) - times)[names] + 1
    s = np.concatenate([text, np.zeros(3, text.dtype)])
    # Sampled suffixes: places 1 and 2 modulo 3, a difference cover.  A place beyond the
    # end joins where the first half would otherwise lack its terminator.
    extra = n % 3 == 1
    one, two, zero = np.arange(1, n + extra, 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sampled = np.concatenate([one, two])
    names = _dense([s[sampled], s[sampled + 1], s[sampled + 2]])
    if int(names.max()) < len(names):  # some triples are equal: recurse on the string of names
        names = suffix_ranks(names, covers * 3, need)
    rank = np.zeros(n + 3, np.int64)
    rank[sampled] = names - extra  # the extra suffix is the least
    rank[n:] = 0
    one = one[one < n]
    # The remaining suffixes, by their first unit and the rank of the sampled suffix behind
    # it; merged by counting the smaller ones of the other kinds.
    z1, o1 = _comparable([s[zero], rank[zero + 1]], [s[one], rank[one + 1]])
    z2, t2 = _comparable([s[zero], s[zero + 1], rank[zero + 2]], [s[two], s[two + 1], rank[two + 2]])
    order = np.argsort(z1)
    z1_sorted = z1[order]
    z2_sorted = np.sort(z2)
    out = np.empty(n, np.int64)
    less = np.searchsorted(z1_sorted, z1_sorted) + np.searchsorted(np.sort(o1), z1_sorted)
    out[zero[order]] = less
    t_sorted = np.sort(t2)
    by_two = np.argsort(z2)
    out[zero[by_two]] += np.searchsorted(t_sorted, z2[by_two])
    out[one] = rank[one] - 1 + np.searchsorted(z1_sorted, o1)
    out[two] = rank[two] - 1 + np.searchsorted(z2_sorted, t2)
    return out + 1


def repeated_starts(raw: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of the given places of ``raw`` start a string of ``size`` bytes that
    starts at another of them too."""
    if len(starts) < 2:
        return np.zeros(len(starts), bool)
    letters = np.zeros(256, bool)
    letters[raw] = True
    rank = suffix_ranks(np.cumsum(letters)[raw], 1, size)
    order = np.argsort(rank[starts], kind="stable")
    place = starts[order]
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.zeros(8, np.uint8)]), 8)
    words = np.ascontiguousarray(words).view(np.uint64).ravel()
    # Adjacent prefixes, eight bytes at a time, for pairs that are still equal.
    pair = np.arange(len(place) - 1)
    for k in [*range(0, size - 7, 8), max(0, size - 8)]:
        pair = pair[words[place[pair] + k] == words[place[pair + 1] + k]]
    out = np.zeros(len(starts), bool)
    out[order[pair]] = True
    out[order[pair + 1]] = True
    return out


# ---------------------------------------------------------------- anchors

def _sliding_argmin(value: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of each run of ``width`` 32-bit values, the leftmost if equal."""
    n, m = len(value), len(value) - width + 1
    grid = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = (value << _U(32)) | np.arange(n, dtype=np.uint64)
    grid = grid.reshape(-1, width)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(tail[:m], head[width - 1 : width - 1 + m]) & _U(0xFFFFFFFF)).astype(np.int64)


def _sums(raw: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any part of ``raw`` follows."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_CODE[raw] * _powers(len(raw)), out=out[1:])
    return out


def _anchors(size: int, gram: int):
    """Of the grams of each window, the one of least hash is its anchor (winnowing)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, hs, texts in chunks(batch.columns, 2, CHUNK_BYTES):
                raw, off = text_buffers(texts)
                m = len(raw) - size + 1
                if m <= 0:
                    continue
                sums, down = _sums(raw), _inverse_powers(len(raw))
                grams = mix64((sums[gram:] - sums[:-gram]) * down[: len(raw) - gram + 1])
                place = _sliding_argmin(grams >> _U(32), size - gram + 1)
                length = np.diff(off)
                doc = np.repeat(np.arange(len(texts)), length)
                inside = doc[:m] == doc[size - 1 :]
                at, n = ranges_of(np.where(inside, place, -1), doc[:m])
                if not len(at):
                    continue
                place, row = place[at], doc[at]
                whole = (sums[at + n + size - 1] - sums[at]) * down[at]
                mark = mix64(whole + mix64(n.astype(np.uint64) * _U(3) + (place - at).astype(np.uint64) * _U(0x10001)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[place].view(np.int64)), pa.array(mark.view(np.int64)), ids.take(pa.array(row)), hs.take(pa.array(row)), pa.array((at - off[row]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["key", "print", "id", "h", "at", "n"],
                )

    return run


def _emit(size: int):
    """The bytes of the wanted ranges; of hot ones the fingerprints of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, hs, texts, wanted in chunks(batch.columns, 2, CHUNK_BYTES):
                raw, off = text_buffers(texts)
                flat = wanted.flatten()
                row = np.repeat(np.arange(len(texts)), np.diff(np.asarray(wanted.offsets)))
                key, at, n = (flat.field(c).to_numpy() for c in ("key", "at", "n"))
                ask, hot = (flat.field(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("ask", "hot"))
                begin = off[row] + at
                parts = [None if warm else raw[b : b + k + size - 1].tobytes() for warm, b, k in zip(hot, begin.tolist(), n.tolist(), strict=True)]
                cold = np.flatnonzero(~hot)
                if len(cold):
                    pick, none = pa.array(row[cold]), pa.nulls(len(cold), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pick), hs.take(pick), pa.array(at[cold].astype(np.int32)), pa.array(n[cold].astype(np.int32)), pa.array(ask[cold]), pa.array(key[cold]), pa.array([parts[i] for i in cold], pa.binary()), none, none],
                        names=["id", "h", "at", "n", "ask", "key", "part", "p", "q"],
                    )
                warm = np.flatnonzero(hot)
                if len(warm):
                    k = n[warm]
                    within = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
                    own, place = np.repeat(warm, k), np.repeat(begin[warm], k) + within
                    pick = pa.array(row[own])
                    sums, down = _sums(raw), _inverse_powers(len(raw))
                    p = mix64((sums[place + size] - sums[place]) * down[place])
                    other = np.zeros(len(raw) + 1, np.uint64)
                    np.cumsum(mix64(BYTE_CODE[raw]) * _powers(len(raw)), out=other[1:])
                    q = mix64((other[place + size] - other[place]) * down[place])
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pick), hs.take(pick), pa.array((at[own] + within).astype(np.int32)), pa.array(np.ones(len(own), np.int32)), pa.array(ask[own]), pa.nulls(len(own), pa.int64()), pa.nulls(len(own), pa.binary()), pa.array(p.view(np.int64)), pa.array(q.view(np.int64))],
                        names=["id", "h", "at", "n", "ask", "key", "part", "p", "q"],
                    )

    return run


def _sorted_batches(size: int):
    """Sorts the suffixes of ranges, a batch of whole keys at a time."""

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        raw, off = text_buffers(rows.column(5).cast(pa.binary()))
        n = rows.column(3).to_numpy()
        base = np.repeat(off[:-1], n)
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        again = repeated_starts(raw, base + within, size)
        owner = np.repeat(np.arange(len(n)), n)
        again &= np.repeat(rows.column(4).to_numpy(zero_copy_only=False).astype(bool), n)
        new = again.copy()
        new[1:] &= ~again[:-1] | (owner[1:] != owner[:-1])
        end = again.copy()
        end[:-1] &= ~again[1:] | (owner[1:] != owner[:-1])
        first, last = np.flatnonzero(new), np.flatnonzero(end)
        if not len(first):
            return None
        pick = pa.array(owner[first])
        at = rows.column(2).to_numpy()[owner[first]] + within[first]
        return pa.RecordBatch.from_arrays([rows.column(0).take(pick), rows.column(1).take(pick), pa.array(at.astype(np.int32)), pa.array((last - first + 1).astype(np.int32))], names=["id", "h", "at", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size_held, last_key = [], 0, None
        for batch in batches:
            keys = batch.column(6).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            _, off = text_buffers(batch.column(5).cast(pa.binary()))
            at = 0
            # Cut only where the key changes, once a batch's worth of bytes is held.
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if a == b:
                    continue
                if keys[a] != last_key and size_held + off[a] - off[at] >= BATCH_BYTES:
                    if a > at:
                        held.append(batch.slice(at, a - at))
                    if (out := solve(held)) is not None:
                        yield out
                    held, size_held, at = [], 0, a
                last_key = keys[a]
            if at < len(keys):
                held.append(batch.slice(at))
                size_held += int(off[-1] - off[at])
        if held and (out := solve(held)) is not None:
            yield out

    return run


def _resolve(size: int):
    def resolve(parts: DataFrame) -> DataFrame:
        kind = parts.schema["id"].dataType.simpleString()
        cold = parts.filter("part IS NOT NULL").select("id", "h", "at", "n", "ask", "part", "key")
        sorted_ = cold.repartition("key").sortWithinPartitions("key").mapInArrow(_sorted_batches(size), f"id {kind}, h int, at int, n int")
        return sorted_.unionByName(counted(parts.filter("part IS NULL").select("id", "h", "at", "p", "q", "ask")))

    return resolve


def _cut(size: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, texts, spans in chunks(batch.columns, 2, CHUNK_BYTES):
                raw, off = text_buffers(texts)
                removed, runs, digests, kept_bytes = [], [], [], []
                for i, own in enumerate(spans.to_pylist()):
                    part = raw[off[i] : off[i + 1]]
                    if own:
                        gone = covered(own, size, len(part))
                        kept = part[~gone].tobytes()
                        removed.append(int(gone.sum()))
                        runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                    else:
                        kept = part.tobytes()
                        removed.append(0)
                        runs.append(0)
                    digests.append(hashlib.sha256(kept).hexdigest())
                    kept_bytes.append(kept if with_text else None)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests), pa.array(kept_bytes, pa.binary())],
                    names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    return run


def remove_repeated_bytes(docs: DataFrame, size: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256, kept`` per input row: each
    byte of the UTF-8 text that is covered by a string of ``size`` bytes that
    also starts anywhere else, in the same text or another, is removed.  kept
    holds the remaining bytes (a cut can split a character); it is null
    without ``with_text``.

    Windows of ``size`` bytes are filed under their gram of least hash.  Equal
    windows have the same gram at the same place, so windows whose gram occurs
    once hold no repeat, and grams whose surroundings are equal throughout are
    repeats throughout.  The rest is dealt by gram to tasks which sort its
    suffixes with the difference cover {1, 2} modulo 3: sampled triples get
    names by sorting, names are sorted recursively until they tell ``size``
    bytes apart, the remaining suffixes are merged in, and adjacent prefixes
    of ``size`` bytes are compared byte by byte.  A task sorts about 1 MB at a
    time, whole grams only; a gram with more than 4096 different surroundings
    is resolved by counting the fingerprints of its windows instead.

    A null text is empty; texts shorter than ``size`` are kept whole; rows that
    repeat a text are repeats of each other; strings never cross texts; an
    empty table gives an empty result.
    """
    source = keyed(docs, id_col, text_col)
    schema = "id ID, h int, at int, n int, ask boolean, key long, part binary, p long, q long"
    spans = repeated_spans(source, _anchors(size, gram), _emit(size), _resolve(size), schema, "bytes")
    kind = source.schema["id"].dataType.simpleString()
    return with_spans(source, spans).mapInArrow(_cut(size, with_text), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
