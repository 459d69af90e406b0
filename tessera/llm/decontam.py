"""Benchmark decontamination: BM25 over an inverted index of test items, searched
with block-max WAND, then a check of question and answer overlap."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import CHUNK_BYTES, chunks, hash_words, rolling, text_buffers

K1, B = 1.2, 0.75
SEGMENT = 64
BLOCK_ITEMS = 8
# A slab of the index holds at most so many items and about so many words (one item at least); a pass over
# the documents carries slabs of at most PASS_BYTES together (one at least).
SLAB_ITEMS = 2048
SLAB_WORDS = 1 << 16
PASS_BYTES = 64 << 20
MIN_SCORE = 0.6
MIN_OVERLAP = 0.8
RUN_WORDS = 5

# Which bytes belong to words: all but white space and ASCII punctuation.
_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def words_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, its row) of lower-cased texts, with ASCII punctuation
    and white space between words."""
    if len(raw) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = _WORD[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off[:-1]] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | edge))
    edge[off[1:]] = True
    ends = np.flatnonzero(before & (~inside | edge))
    return hash_words(raw, starts, ends), np.searchsorted(off, starts, side="right") - 1


def _hash_text(text: str) -> np.ndarray:
    return words_of(*text_buffers(pc.utf8_lower(pa.array([text], pa.string()))))[0]


def question_and_answer(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two parts of an item without marked fields: its first three quarters
    are held to be the question, the rest the answer."""
    at = max(1, (3 * len(words) + 3) // 4)
    return words[:at], words[at:]


def in_order(part: np.ndarray, passage: np.ndarray) -> float:
    """The share of a part's words that a passage has in the same order (LCS)."""
    if len(part) == 0:
        return 1.0
    passage = passage[np.isin(passage, part)]
    row = np.zeros(len(passage) + 1, np.int32)
    for w in part:
        new = row.copy()
        new[1:] = np.maximum(row[1:], np.where(passage == w, row[:-1] + 1, 0))
        row = np.maximum.accumulate(new)
    return float(row[-1]) / len(part)


def verified(question: np.ndarray, answer: np.ndarray, passage: np.ndarray, min_overlap: float) -> tuple[float, float] | None:
    """The overlaps of question and answer if both suffice and the passage also
    has a run of RUN_WORDS of the item's words unchanged, or the whole of a
    shorter item.  A single word says nothing: it must be the whole passage."""
    item = np.concatenate([question, answer])
    if len(item) < 2:
        return (1.0, 1.0) if len(item) and len(passage) == 1 and passage[0] == item[0] else None
    run = min(RUN_WORDS, len(item))
    if not np.isin(rolling(item, run), rolling(passage, run)).any():
        return None
    q, a = in_order(question, passage), in_order(answer, passage)
    return (q, a) if q >= min_overlap and a >= min_overlap else None


@dataclass(frozen=True)
class Item:
    """A test item: its id and the word hashes of its two parts."""

    id: object
    question: np.ndarray
    answer: np.ndarray

    @property
    def words(self) -> np.ndarray:
        return np.concatenate([self.question, self.answer])

    def pieces(self) -> list[np.ndarray]:
        """At most SEGMENT words each."""
        words = self.words
        return np.array_split(words, -(-len(words) // SEGMENT))


@dataclass(frozen=True)
class ItemStatistics:
    """What BM25 asks of all pieces of all items, however they are dealt into slabs."""

    pieces: int
    mean: float
    terms: np.ndarray  # sorted word hashes
    df: np.ndarray

    @staticmethod
    def of(items: Iterator[Item]) -> ItemStatistics:
        n, words, terms, df, held = 0, 0, np.zeros(0, np.uint64), np.zeros(0, np.int64), []

        def folded() -> tuple[np.ndarray, np.ndarray]:
            every, at = np.unique(np.concatenate([terms, *held]), return_inverse=True)
            return every, np.bincount(at, weights=np.concatenate([df, np.ones(len(at) - len(df))]), minlength=len(every)).astype(np.int64)

        for item in items:
            for piece in item.pieces():
                n, words = n + 1, words + len(piece)
                held.append(np.unique(piece))
            if len(held) >= 4 * SLAB_ITEMS:
                (terms, df), held = folded(), []
        if held:
            terms, df = folded()
        return ItemStatistics(n, words / max(n, 1), terms, df)

    def idf(self, terms: np.ndarray) -> np.ndarray:
        df = self.df[np.searchsorted(self.terms, terms)]
        return np.log1p((self.pieces - df + 0.5) / (df + 0.5))


@dataclass(frozen=True)
class ItemIndex:
    """Postings of one slab of item pieces.  Impacts are BM25 weights, by the
    statistics of all items, divided by the piece's own score, so a passage that
    holds the whole piece scores 1."""

    items: np.ndarray  # item number of each piece
    item_ids: list
    parts: list  # (question, answer) of each item, as word hashes
    terms: np.ndarray  # sorted word hashes
    block_max: np.ndarray  # terms + 1 x blocks: the largest impact in a block (last row: unknown words)
    post_at: np.ndarray  # CSR of postings by term, in piece order
    post_piece: np.ndarray
    post_impact: np.ndarray

    @staticmethod
    def build(items: list[Item], statistics: ItemStatistics) -> ItemIndex:
        pieces, owner = [], []
        for k, item in enumerate(items):
            for piece in item.pieces():
                pieces.append(piece)
                owner.append(k)
        terms = np.unique(np.concatenate(pieces)) if pieces else np.zeros(0, np.uint64)
        n = len(pieces)
        t, d, w = [], [], []
        for j, piece in enumerate(pieces):
            own, tf = np.unique(np.searchsorted(terms, piece), return_counts=True)
            t.append(own)
            d.append(np.full(len(own), j))
            w.append(tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(piece) / statistics.mean)))
        t, d, w = (np.concatenate(x) if x else np.zeros(0) for x in (t, d, w))
        t, d = t.astype(np.int64), d.astype(np.int64)
        if n:
            w = w * statistics.idf(terms)[t]
            w = w / np.bincount(d, weights=w, minlength=n)[d]
        order = np.lexsort((d, t))
        t, d, w = t[order], d[order], w[order]
        blocks = max(1, -(-n // BLOCK_ITEMS))
        block_max = np.zeros((len(terms) + 1, blocks), np.float32)
        np.maximum.at(block_max, (t, d // BLOCK_ITEMS), w.astype(np.float32))
        post_at = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=len(terms)))])
        return ItemIndex(np.array(owner, np.int64), [i.id for i in items], [(i.question, i.answer) for i in items], terms, block_max, post_at, d, w)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.items, self.terms, self.block_max, self.post_at, self.post_piece, self.post_impact)) + sum(q.nbytes + a.nbytes for q, a in self.parts)

    def term_numbers(self, words: np.ndarray) -> np.ndarray:
        if len(self.terms) == 0:
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return np.where(self.terms[at] == words, at, len(self.terms))

    def search(self, words: np.ndarray, doc: np.ndarray, min_score: float) -> list[tuple[int, int, float, int, int]]:
        """(doc, item, score, from, to) of every passage and piece whose score
        reaches min_score.  Passages are two neighbouring segments of SEGMENT
        words of a document, so any SEGMENT words lie whole in one of them."""
        if len(words) == 0 or len(self.terms) == 0:
            return []
        term = self.term_numbers(words)
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        within = np.arange(len(words)) - np.repeat(first, np.diff(np.append(first, len(words))))
        begins = np.flatnonzero(within % SEGMENT == 0)
        # A segment's bound for each block of items: block maxima of its distinct terms.
        segment = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(words))))
        pair = np.unique(segment[term < len(self.terms)] * np.int64(len(self.terms) + 1) + term[term < len(self.terms)])
        owner, known = pair // (len(self.terms) + 1), pair % (len(self.terms) + 1)
        bound = np.zeros((len(begins) + 1, self.block_max.shape[1]), np.float32)
        if len(pair):
            at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            for lo in range(0, len(at), 4096):
                hi = min(lo + 4096, len(at))
                end = at[hi] if hi < len(at) else len(pair)
                bound[owner[at[lo:hi]]] = np.add.reduceat(self.block_max[known[at[lo] : end]], at[lo:hi] - at[lo], axis=0)
        follows = np.zeros(len(begins), bool)
        follows[:-1] = doc[begins[1:]] == doc[begins[:-1]]
        starts_doc = within[begins] == 0
        both = bound[:-1] + np.where(follows[:, None], bound[1:], 0)
        use = follows | starts_doc  # a document's last segment is part of the passage before
        found = []
        ends = np.append(begins[1:], len(words))
        for s in np.flatnonzero(use & (both.max(axis=1) >= min_score - 1e-4)):
            to = ends[s + 1] if follows[s] else ends[s]
            terms = np.unique(term[begins[s] : to])
            terms = terms[terms < len(self.terms)]
            # The bound again, now over the passage's distinct terms.
            live = self.block_max[terms].sum(axis=0) >= min_score - 1e-4
            if live.any():
                found += [(int(doc[begins[s]]), int(self.items[piece]), score, int(begins[s]), int(to)) for piece, score in self._wand(terms, live, min_score)]
        return found

    def _wand(self, terms: np.ndarray, live: np.ndarray, min_score: float) -> list[tuple[int, float]]:
        """(piece, score) of the pieces that reach min_score, by block-max WAND
        over the postings of the blocks that are still live.

        Cursors stand in piece order.  The pivot is the first one at which the
        terms' largest impacts add up to min_score; no piece before it can reach
        that.  If the pivot's block can't either, all cursors up to it jump to
        the block's end; if the first cursor stands at the pivot, the piece is
        scored in full; else the cursors before the pivot move up to it."""
        cursors = []
        for t in terms.tolist():
            own = slice(self.post_at[t], self.post_at[t + 1])
            keep = live[self.post_piece[own] // BLOCK_ITEMS]
            if keep.any():
                impacts = self.post_impact[own][keep].tolist()
                cursors.append([self.post_piece[own][keep].tolist(), impacts, 0, max(impacts), t])
        least, out = min_score - 1e-4, []

        def move(upto: int, to: int) -> list:
            for c in cursors[:upto]:
                while c[2] < len(c[0]) and c[0][c[2]] < to:
                    c[2] += 1
            return [c for c in cursors if c[2] < len(c[0])]

        while cursors:
            cursors.sort(key=lambda c: c[0][c[2]])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[3]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            piece = cursors[pivot][0][cursors[pivot][2]]
            upto = pivot + 1
            while upto < len(cursors) and cursors[upto][0][cursors[upto][2]] == piece:
                upto += 1
            block = piece // BLOCK_ITEMS
            if sum(float(self.block_max[c[4], block]) for c in cursors[:upto]) < least:
                beyond = cursors[upto][0][cursors[upto][2]] if upto < len(cursors) else len(self.items)
                cursors = move(upto, max(piece + 1, min((block + 1) * BLOCK_ITEMS, beyond)))
            elif cursors[0][0][cursors[0][2]] == piece:
                score = sum(c[1][c[2]] for c in cursors[:upto])
                if score >= min_score:
                    out.append((piece, score))
                cursors = move(upto, piece + 1)
            else:
                cursors = move(pivot, piece)
        return out

    def leaks(self, words: np.ndarray, doc: np.ndarray, min_score: float, min_overlap: float) -> list[tuple[int, int, float, float, float]]:
        """(doc, item, score, question overlap, answer overlap) of verified items,
        the best passage of each.  For an item of several pieces the text between
        its first and last passage is compared as a whole."""
        spans: dict[tuple[int, int], list] = {}
        for d, item, score, lo, to in self.search(words, doc, min_score):
            spans.setdefault((d, item), []).append((lo, to, score))
        out = []
        for (d, item), hits in sorted(spans.items()):
            question, answer = self.parts[item]
            whole = len(question) + len(answer)
            best = None
            for lo, to, score in hits:
                if whole > SEGMENT:  # pieces lie in several passages: widen to the item's length on both sides
                    a, b = np.searchsorted(doc, [d, d + 1])
                    lo, to = max(a, lo - whole), min(b, to + whole)
                found = verified(question, answer, words[lo:to], min_overlap)
                if found and (best is None or (score, *found) > best):
                    best = (score, *found)
            if best:
                out.append((d, item, *best))
        return out


def _items(rows: DataFrame) -> Iterator[Item]:
    for r in rows.toLocalIterator():
        if r.a is None:
            words = _hash_text(r.q)
            parts = question_and_answer(words) if len(words) else (words, words)
        else:
            parts = _hash_text(r.q), _hash_text(r.a)
        if len(parts[0]) + len(parts[1]):
            yield Item(r.i, *parts)


def item_passes(rows: DataFrame) -> Iterator[list[ItemIndex]]:
    """Indexes over all items of (i, q, a), in any order, in lists that one pass over
    the documents takes (scores don't depend on how items fall into them).  The test set comes to the driver part by part, twice:
    once for its statistics (a count per distinct word), once for the slabs."""
    statistics = ItemStatistics.of(_items(rows))
    held, words, slabs, size = [], 0, [], 0

    def closed():
        nonlocal held, words, slabs, size
        out, slab = None, ItemIndex.build(held, statistics)
        if slabs and size + slab.nbytes > PASS_BYTES:
            out, slabs, size = slabs, [], 0
        slabs.append(slab)
        size += slab.nbytes
        held, words = [], 0
        return out

    for item in _items(rows):
        held.append(item)
        words += len(item.question) + len(item.answer)
        if (len(held) >= SLAB_ITEMS or words >= SLAB_WORDS) and (full := closed()):
            yield full
    if held and (full := closed()):
        yield full
    if slabs:
        yield slabs


def find_leaks(
    docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE, min_overlap: float = MIN_OVERLAP,
    id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    question_col: str | None = None, answer_col: str | None = None,
) -> DataFrame:
    """``id, item_id, score, question_overlap, answer_overlap``: a row for each
    document and test item that it holds.

    Every passage of every whole text is a BM25 query against an inverted index
    of the items (a passage's words count once, as in plain BM25 without a
    query-frequency factor; document frequencies and the mean length are those
    of all items).  Scores are shares of the item's own score.  Blocks of items
    whose summed block maxima stay below ``min_score`` are passed over, for a
    passage's two segments first and for its distinct terms then; block-max WAND
    finds all items at ``min_score`` or above among the rest.  An item counts as
    leaked if the passage has at least ``min_overlap`` of the words of its
    question and of its answer in order, and a run of five of its words
    unchanged; an item of two to four words must stand there unchanged as a
    whole, one of a single word must be the whole passage.

    Items have their parts in ``question_col`` and ``answer_col``; without these,
    the first three quarters of ``item_text_col`` are held to be the question.
    Items longer than 64 words are indexed in pieces.  Null texts and items
    without words match nothing; repeated rows are judged one by one; empty
    tables give an empty result.  Indexes of at most 64 MB together are
    broadcast for one pass over the documents; a larger test set takes more
    passes.
    """
    spark = docs.sparkSession
    kinds = docs.schema[id_col].dataType.simpleString(), items.schema[item_id_col].dataType.simpleString()
    schema = f"id {kinds[0]}, item_id {kinds[1]}, score double, question_overlap double, answer_overlap double"
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if question_col:
        texts = items.select(F.col(item_id_col).alias("i"), F.coalesce(question_col, F.lit("")).alias("q"), F.coalesce(F.col(answer_col) if answer_col else F.lit(""), F.lit("")).alias("a"))
    else:
        texts = items.filter(F.col(item_text_col).isNotNull()).select(F.col(item_id_col).alias("i"), F.col(item_text_col).alias("q"), F.lit(None).cast("string").alias("a"))

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, texts in chunks(batch.columns, 1, CHUNK_BYTES):
                    words, doc = words_of(*text_buffers(pc.utf8_lower(texts)))
                    rows = [(d, index.item_ids[i], s, q, a) for index in shared.value for d, i, s, q, a in index.leaks(words, doc, min_score, min_overlap)]
                    if rows:
                        at, item, *scores = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(item), *(pa.array(s, pa.float64()) for s in scores)], names=["id", "item_id", "score", "question_overlap", "answer_overlap"])

        return source.mapInArrow(run, schema)

    found = [search(spark.sparkContext.broadcast(slabs)) for slabs in item_passes(texts)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)
