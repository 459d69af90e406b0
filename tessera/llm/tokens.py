"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# The pre-token pattern of the byte-level pre-tokenizer.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
CACHE_ENTRIES = 400_000
BATCH_SYMBOLS = 1 << 18
_NONE = np.int64(1) << 40


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary: bytes that
    print stand for themselves, the rest take code points from 256 up, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _refuse_other_settings(spec: dict, path: str) -> None:
    """Raises where a file asks for steps that aren't taken here."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    wrong = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    wrong += [k for k in ("normalizer", "truncation", "padding") if spec.get(k)]
    if model.get("type", "BPE") != "BPE":
        wrong.append("model")
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        wrong.append("pre_tokenizer")
    if any(t.get(k) for t in spec.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip")):
        wrong.append("added_tokens")
    if wrong:
        raise ValueError(f"{path}: settings that token counts don't follow: {', '.join(wrong)}")


class RankMerger:
    """Counts tokens of pre-tokens.  Symbols of many pre-tokens lie in one flat
    array with their pre-token's number; in every step each pre-token applies
    the merge of its lowest-ranked pair at all its places at once."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        _refuse_other_settings(spec, path)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        key = left << 32 | right
        self.key, self.made = key, made
        self._build_slots()
        self.byte_id = np.array([vocab[c] for _, c in sorted(byte_letters().items())], np.int64)
        self.pattern = regex.compile(PRE_TOKEN)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known: dict[str, int] = {}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _build_slots(self) -> None:
        """A hash table with linear probing from pair to rank, at most 1/16 full."""
        self.bits = max(10, int(len(self.key) * 16).bit_length())
        self.slots = np.full((1 << self.bits) + len(self.key), -1, np.int32)
        left, at = np.arange(len(self.key)), self._slot(self.key)
        while len(left):
            free = self.slots[at] == -1
            self.slots[at[free]] = left[free]
            held = self.slots[at] == left
            left, at = left[~held], at[~held] + 1

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        slot = self._slot(key)
        rank = self.slots[slot].astype(np.int64)
        open_ = np.flatnonzero((rank >= 0) & (self.key[rank] != key))
        while len(open_):
            slot[open_] += 1
            rank[open_] = got = self.slots[slot[open_]]
            open_ = open_[(got >= 0) & (self.key[got] != key[open_])]
        return np.where(rank >= 0, rank, _NONE)

    def merge(self, words: list[bytes]) -> np.ndarray:
        """The number of symbols that each word ends with."""
        out = np.array([len(w) for w in words], np.int64)
        symbols = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), out)
        while len(symbols) > 1:
            rank = np.full(len(symbols), _NONE)
            rank[:-1] = np.where(word[1:] == word[:-1], self._ranks(symbols[:-1], symbols[1:]), _NONE)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(symbols)))
            live = np.repeat(least < _NONE, size)  # words without a pair to merge are done
            hit = live & (rank == np.repeat(least, size))
            # A pair of two equal symbols can overlap itself: of each run of hits, every second counts.
            at = np.flatnonzero(hit)
            begins = np.concatenate([[True], np.diff(at) != 1]) if len(at) else np.zeros(0, bool)
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
            same = symbols[at] == symbols[np.minimum(at + 1, len(symbols) - 1)]
            at = at[(nth % 2 == 0) | ~same]
            symbols[at] = self.made[rank[at]]
            out -= np.bincount(word[at], minlength=len(out))
            live[at + 1] = False
            symbols, word = symbols[live], word[live]
        return out

    def _learn(self, fresh: list[str]) -> None:
        batch, size = [], 0
        for i, piece in enumerate(fresh):
            batch.append((piece, piece.encode("utf-8", "surrogatepass")))
            size += len(batch[-1][1])
            if size >= BATCH_SYMBOLS or i == len(fresh) - 1:
                self.known.update(zip([p for p, _ in batch], self.merge([b for _, b in batch]).tolist(), strict=True))
                batch, size = [], 0

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text, as the library gives them without added tokens;
        special strings inside a text count as one token each."""
        found, extra = [], []
        for text in texts:
            specials = 0
            if self.special is not None and (marks := list(self.special.finditer(text))):
                specials, at, pieces = len(marks), 0, []
                for m in marks:
                    pieces += self.pattern.findall(text[at : m.start()])
                    at = m.end()
                pieces += self.pattern.findall(text[at:])
            else:
                pieces = self.pattern.findall(text)
            found.append(pieces)
            extra.append(specials)
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        self._learn(list({p for pieces in found for p in pieces if p not in self.known}))
        known = self.known
        return [sum(map(known.__getitem__, pieces)) + more for pieces, more in zip(found, extra, strict=True)]


@lru_cache(maxsize=2)
def _merger(path: str) -> RankMerger:
    return RankMerger(path)


def token_counts(text: Column, vocabulary: str) -> Column:
    """The number of tokens (long) of each text under the byte-level BPE
    vocabulary file ``vocabulary``, whose path every executor can open.

    Null and empty texts have 0.  Whole texts are read in groups of about 1 MB;
    distinct pre-tokens are merged once per worker while a bounded cache holds
    them.  A pre-token of any length is merged as a whole.
    """

    @F.arrow_udf("long")
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        merger = _merger(vocabulary)
        for batch in batches:
            out, texts, size = [], [], 0
            for value in batch:
                texts.append(value.as_py() or "")
                size += len(texts[-1])
                if size >= 1 << 19:
                    out += merger.count(texts)
                    texts, size = [], 0
            yield pa.array(out + merger.count(texts), pa.int64())

    return counts(text)
