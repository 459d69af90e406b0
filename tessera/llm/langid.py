"""Language identification by nearest centroid over TF-IDF character n-grams."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mix64

UNDETERMINED = "und"
DIMENSIONS = 4096
ORDERS = (1, 2, 3)
CHUNK_CHARS = 1 << 18
SLICE = 1 << 20
TRAIN_PER_LANGUAGE = 600
CENTROIDS = 4
_SPACE = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters or marks that go with letters."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


@lru_cache(maxsize=1)
def _has_letter() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-gram counts, rows x DIMENSIONS; number of letters per row).

    Texts are lower-cased; everything but letters becomes one space between
    words, and n-grams of 1 to 3 characters include those spaces.  Texts are
    handled in groups of about CHUNK_CHARS characters, each text in one piece."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    letters = np.zeros(len(texts), np.int64)
    group, size = [], 0
    for i, text in enumerate(texts):
        group.append((i, text))
        size += len(text)
        if size >= CHUNK_CHARS:
            _add(group, out, letters)
            group, size = [], 0
    if group:
        _add(group, out, letters)
    return out, letters


def _add(group: list[tuple[int, str]], out: np.ndarray, letters: np.ndarray) -> None:
    codes = [np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32) for _, text in group]
    row = np.repeat(np.array([i for i, _ in group], np.int32), [len(c) for c in codes])
    code = np.concatenate(codes) if len(codes) > 1 else codes[0]
    np.add.at(letters, [i for i, _ in group], np.add.reduceat(_has_letter()[code].astype(np.int64), np.concatenate([[0], np.cumsum([len(c) for c in codes])[:-1]])))
    code = np.where(_letters()[code], code, np.uint32(_SPACE))
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != _SPACE) | (code[:-1] != _SPACE) | (row[1:] != row[:-1])
    code, row = code[keep], row[keep]
    first, last = int(row[0]), int(row[-1])
    flat = np.zeros((last - first + 1) * DIMENSIONS, np.int64)
    # Slices share their last characters with the next one, so that memory is bounded and no n-gram is lost.
    for lo in range(0, len(code), SLICE):
        for n in ORDERS:
            part, rows = code[lo : lo + SLICE + n - 1].astype(np.uint64), row[lo : lo + SLICE + n - 1]
            m = len(part) - n + 1
            if m <= 0:
                continue
            key = np.full(m, n, np.uint64)
            for k in range(n):
                key = key * np.uint64(0x1000193) + part[k : k + m]
            within = rows[:m] == rows[n - 1 :]
            if n == 1:
                within &= part != _SPACE
            slot = (mix64(key) & np.uint64(DIMENSIONS - 1)).astype(np.int64) + (rows[:m].astype(np.int64) - first) * DIMENSIONS
            flat += np.bincount(slot[within], minlength=len(flat))
    out[first : last + 1] += flat.reshape(-1, DIMENSIONS)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def clustered(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means with fixed starts: the first row, then each time the row
    farthest from all centroids so far."""
    centroids = vectors[:1]
    while len(centroids) < min(k, len(vectors)):
        centroids = np.vstack([centroids, vectors[np.argmin((vectors @ centroids.T).max(axis=1))]])
    for _ in range(rounds):
        nearest = (vectors @ centroids.T).argmax(axis=1)
        centroids = _unit(np.vstack([vectors[nearest == j].mean(axis=0) if (nearest == j).any() else centroids[j] for j in range(len(centroids))])).astype(np.float32)
    return centroids


@dataclass(frozen=True)
class LanguageModel:
    idf: np.ndarray
    centroids: np.ndarray
    labels: tuple[str, ...]  # of each centroid
    least: np.ndarray  # the least cosine by language and log2 of the number of letters
    languages: tuple[str, ...]

    def vectors(self, tf: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(tf) * self.idf).astype(np.float32)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(nearest language or ``und`` without letters, cosine, rejected)."""
        tf, letters = counts(texts)
        if not self.labels:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosine = self.vectors(tf) @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(texts)), best].astype(float), 0.0, 1.0)
        where = np.array([self.languages.index(x) for x in self.labels])[best]
        rejected = score < self.least[where, length_bin(letters)]
        none = letters == 0
        score[none] = 0.0
        return [UNDETERMINED if n else self.labels[b] for n, b in zip(none, best, strict=True)], score, rejected | none


LENGTH_BINS = 16


def length_bin(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(int), LENGTH_BINS - 1)


def _rejection(score: np.ndarray, bins: np.ndarray, quantile: float, slack: float) -> np.ndarray:
    """By length: ``slack`` times the quantile of the cosines of training texts
    that are no longer; rising with length, 0 below the shortest seen."""
    out = np.zeros(LENGTH_BINS)
    for b in range(LENGTH_BINS):
        seen = score[bins == b]
        if len(seen) >= 5:
            out[b] = slack * np.quantile(seen, quantile)
        elif b:
            out[b] = out[b - 1]
    return np.minimum.accumulate(out[::-1])[::-1]


def fit(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = TRAIN_PER_LANGUAGE, centroids: int = CENTROIDS, quantile: float = 0.0, slack: float = 0.5,
) -> LanguageModel:
    """Fits on at most ``per_language`` rows of each language: those with the
    smallest hashed ids, whole texts.  n-grams are counted on the executors;
    the driver gets the sample's count vectors: at most 24 KB a row, so 600 rows
    are at most 15 MB a language, whatever the size of the corpus.

    The sample gives document frequencies, ``centroids`` spherical k-means
    centroids per language, and for each language and length the cosine below
    which a text is rejected (``slack`` times the ``quantile`` of the sample's).
    Rows without language or text are left out; with no row left the model
    predicts ``und`` for all.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"), F.col(text_col).alias("text"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel(np.zeros(DIMENSIONS), np.zeros((0, DIMENSIONS), np.float32), (), np.zeros((1, LENGTH_BINS)), ())
    # The hash is even over its range: this share of it holds about per_language rows; the rest is trimmed.
    limit = F.lit(None).cast("long")
    for lang, n in sizes.items():
        limit = F.when(F.col("lang") == lang, F.lit(int(-(2**63) + min(2**64 - 1, int(2**64 * min(1.0, 1.1 * per_language / n)))))).otherwise(limit)
    sample = rows.filter(F.col("h") <= limit).mapInArrow(_vectors, "lang string, h long, letters long, slots binary, tf binary").collect()
    taken: dict[str, list] = {}
    for r in sorted(sample, key=lambda r: (r.lang, r.h, bytes(r.slots))):
        if r.letters and len(taken.setdefault(r.lang, [])) < per_language:
            taken[r.lang].append(r)
    languages = tuple(sorted(x for x in taken if taken[x]))
    tf = {}
    for lang in languages:
        tf[lang] = np.zeros((len(taken[lang]), DIMENSIONS), np.float32)
        for i, r in enumerate(taken[lang]):
            tf[lang][i, np.frombuffer(r.slots, np.uint16)] = np.frombuffer(r.tf, np.float32)
    total = sum(map(len, tf.values()))
    present = sum((x > 0).sum(axis=0) for x in tf.values()) if tf else np.zeros(DIMENSIONS)
    idf = np.log((1 + total) / (1 + present)) + 1
    model = LanguageModel(idf.astype(np.float32), np.zeros((0, DIMENSIONS), np.float32), (), np.zeros((1, LENGTH_BINS)), languages)
    parts, labels, least = [], [], []
    for lang in languages:
        vectors = model.vectors(tf[lang])
        own = clustered(vectors, centroids)
        parts.append(own)
        labels += [lang] * len(own)
        bins = length_bin(np.array([r.letters for r in taken[lang]]))
        least.append(_rejection((vectors @ own.T).max(axis=1), bins, quantile, slack))
    if not parts:
        return model
    return LanguageModel(model.idf, np.vstack(parts).astype(np.float32), tuple(labels), np.vstack(least), languages)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, hashes = batch.column(0), batch.column(1)
        for at in range(0, batch.num_rows, 64):
            texts = batch.column(2).slice(at, 64).to_pylist()
            tf, letters = counts([t or "" for t in texts])
            slots = [np.flatnonzero(row).astype(np.uint16) for row in tf]
            yield pa.RecordBatch.from_arrays(
                [langs.slice(at, 64), hashes.slice(at, 64), pa.array(letters, pa.int64()), pa.array([s.tobytes() for s in slots], pa.binary()), pa.array([tf[i, s].tobytes() for i, s in enumerate(slots)], pa.binary())],
                names=["lang", "h", "letters", "slots", "tf"],
            )


def predict(text: Column, model: LanguageModel, spark) -> Column:
    """struct<lang, score, rejected> of each whole text.

    lang is the label of the centroid nearest by cosine, ``und`` if the text is
    null or has no letter; score is that cosine (0 to 1, 0 for ``und``).
    rejected is true where the cosine is below what the model asks of texts of
    that language and length, and for ``und``.
    """
    shared = spark.sparkContext.broadcast(model)  # bounded: languages x centroids x DIMENSIONS numbers
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    @F.arrow_udf("lang string, score double, rejected boolean")
    def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for batch in batches:
            langs, scores, rejected = [], [], []
            for at in range(0, len(batch), 256):
                lang, score, out = own.predict([t or "" for t in batch.slice(at, 256).to_pylist()])
                langs += lang
                scores.append(score)
                rejected.append(out)
            scores, rejected = (np.concatenate(x) if x else np.zeros(0) for x in (scores, rejected))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected.astype(bool), pa.bool_())], fields=list(kind))

    return nearest(text)


def is_held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 3, is 1 (a null id is not held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> Column:
    return predict(F.col(text_col), model, docs.sparkSession)
