"""MinHash near-deduplication with dart signatures."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import CHUNK_BYTES, chunks, discard, hash_table, hash_words, mix64, rolling, settled, text_buffers, text_key, with_text_key, word_spans
from tessera.llm.graph import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4
FIRST_STRIP = 2.0**-12
_U = np.uint64


def shingle_hashes(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, count) of the distinct runs of n words of each text, sorted by
    row then hash.  A text of 1 to n-1 words has one shingle, all its words; a text
    without words has none."""
    raw, off = text_buffers(texts)
    starts, ends, row = word_spans(raw, off)
    words = hash_words(raw, starts, ends)
    out, at = [], []
    h = rolling(words, n)
    same = row[: len(h)] == row[n - 1 :] if len(h) else np.zeros(0, bool)
    out.append(h[same])
    at.append(row[: len(h)][same])
    size = np.bincount(row, minlength=len(texts))
    first = np.cumsum(size) - size
    for r in np.flatnonzero((size > 0) & (size < n)):
        out.append(rolling(words[first[r] : first[r] + size[r]], int(size[r]), seed=50 + int(size[r])))
        at.append(np.array([r]))
    hashes, rows = np.concatenate(out), np.concatenate(at).astype(np.int64)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    first_of = np.flatnonzero(new)
    return hashes[new], rows[new], np.diff(np.append(first_of, len(hashes)))


def dart_signatures(elements: np.ndarray, rows: np.ndarray, n_rows: int, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """n_rows x k signatures of weighted sets: equal coordinates have about the
    probability of the sets' weighted Jaccard similarity.

    The plane of an element has its weight on one side and the rank of darts on
    the other.  Hashes of (element, whole unit of weight, strip of rank) say how
    many darts fall there (Poisson of the area) and, for each, its exact place
    and its coordinate.  A dart counts if it lies under the element's weight;
    per coordinate the dart of least rank is kept.  Strips double in height, so
    a set of total weight W is read up to rank about (ln k + 2) k / W and throws
    about k (ln k + 2) darts, however many elements it has.  Where a coordinate
    stays empty, the next strip is read.  Rows without elements get zeros.
    """
    weights = np.ones(len(elements)) if weights is None else np.asarray(weights, float)
    # A cell is one whole unit of an element's weight; the last may be filled in part.
    units = np.ceil(weights).astype(np.int64)
    cell = np.repeat(np.arange(len(elements)), units)
    layer = np.arange(len(cell)) - np.repeat(np.cumsum(units) - units, units)
    base, row = mix64(elements[cell] + mix64(layer.astype(np.uint64) * _U(0x9E3779B97F4A7C15))), rows[cell]
    fill = np.minimum(weights[cell] - layer, 1.0)
    rank_of = np.full(n_rows * k, np.inf)
    name_of = np.zeros(n_rows * k, np.uint64)
    total = np.bincount(rows, weights=weights, minlength=n_rows)
    wanted = k * (np.log(k) + 2) / np.maximum(total, 1e-300)
    lo, height, strip = 0.0, FIRST_STRIP, 0
    live = total > 0
    while live.any():
        use = live[row]
        own, own_row, own_fill = base[use], row[use], fill[use]
        seed = mix64(own ^ hash_table(strip + 1, 21)[strip])
        # Poisson(height) by inversion; heights above 1 are thrown as several strips of at most 1.
        parts = max(1, int(np.ceil(height)))
        mean = height / parts
        for part in range(parts):
            s = mix64(seed + _U(part))
            u = (s >> _U(11)).astype(float) / float(1 << 53)
            count, p, cdf = np.zeros(len(s), np.int64), np.exp(-mean), np.exp(-mean)
            for j in range(1, 24):
                above = u >= cdf
                if not above.any():
                    break
                count += above
                p *= mean / j
                cdf += p
            hit = np.flatnonzero(count)
            which = np.repeat(hit, count[hit])
            nth = np.arange(len(which)) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit])
            dart = mix64(s[which] ^ mix64(nth.astype(np.uint64) + _U(77)))
            across = (mix64(dart + _U(1)) >> _U(11)).astype(float) / float(1 << 53)
            ok = across < own_fill[which]
            which, dart = which[ok], dart[ok]
            up = (mix64(dart + _U(2)) >> _U(11)).astype(float) / float(1 << 53)
            rank = lo + (part + up) * mean
            slot = own_row[which] * k + (mix64(dart + _U(3)) % _U(k)).astype(np.int64)
            order = np.argsort(rank, kind="stable")[::-1]
            slot, rank, dart = slot[order], rank[order], dart[order]
            better = rank < rank_of[slot]
            # Written from the highest rank down, so the lowest of a coordinate is what stays.
            rank_of[slot[better]] = rank[better]
            name_of[slot[better]] = dart[better]
        lo += height
        height, strip = lo, strip + 1  # the next strip doubles what has been read
        full = ~np.isinf(rank_of.reshape(n_rows, k)).any(axis=1)
        live &= ~((lo >= wanted) & full) & ~(full & (rank_of.reshape(n_rows, k).max(axis=1) <= lo))
    return name_of.reshape(n_rows, k)


def _band_keys(bands: int, rows: int, weighting: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts, keys_of_texts in chunks(batch.columns, 1, CHUNK_BYTES):
                hashes, at, times = shingle_hashes(texts)
                n = len(texts)
                filled = np.bincount(at, minlength=n) > 0
                if weighting == "set":
                    times = np.ones(len(times))
                signature = dart_signatures(hashes, at, n, bands * rows, times)
                code = hash_table(rows, 31)
                keys = np.zeros((n, bands), np.uint64)
                for r in range(rows):
                    keys += signature[:, r::rows][:, :bands] * code[r]
                keys = mix64(keys + np.arange(bands, dtype=np.uint64)[None, :] * _U(0x9E3779B97F4A7C15))
                # The whole set of shingles as one name: texts of equal sets are one member.
                same = np.zeros(n, np.uint64)
                np.add.at(same, at, mix64(hashes ^ _U(0x5DEECE66D)) * times.astype(np.uint64))
                same = mix64(same + np.bincount(at, minlength=n).astype(np.uint64))
                flat = keys.view(np.int64).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(flat))
                yield pa.RecordBatch.from_arrays([ids, keys_of_texts, pa.array(filled), pa.array(same.view(np.int64)), lists], names=["id", "h", "filled", "same", "keys"])

    return run


def _shingle_lists(weighting: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in chunks(batch.columns, 1, CHUNK_BYTES):
                hashes, at, times = shingle_hashes(texts)
                if weighting == "count":  # the nth occurrence is an element of its own
                    nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                    hashes, at = mix64(np.repeat(hashes, times) + nth.astype(np.uint64)), np.repeat(at, times)
                off = np.searchsorted(at, np.arange(len(texts) + 1))
                raw = [hashes[off[i] : off[i + 1]].tobytes() for i in range(len(texts))]
                yield pa.RecordBatch.from_arrays([ids, pa.array(raw, pa.binary())], names=["id", "shingles"])

    return run


def _similarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / max(len(x) + len(y) - both, 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "similarity"])


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", weighting: str = "set") -> DataFrame:
    """``id, class_id, n_links, kept``: a row per input row.

    Documents whose sets of five-word shingles have a Jaccard similarity of at
    least ``threshold`` are linked; classes are the connected components, named
    by their smallest id, which is also the one that stays.  n_links is the
    number of verified links of the document's shingle set.

    1. Each text gets a dart signature of bands x rows coordinates, in one pass
       without a shuffle.  Texts with equal shingle sets become one member.
    2. Members that share a band's key meet.  For every shared key the member
       least by the band's hash order and the one greatest by it are candidates
       for all others: two links per row at most, found with partial
       aggregates, so no group is gathered or paired with itself whatever its
       size.  16 bands give each member up to 32 partners of different kinds.
    3. Candidates are verified by the exact similarity of their shingle sets.
    4. In buckets whose members are then still in several classes leaders are
       drawn anew and compared with the members of other classes, for as long as
       at least one in ten candidates of a round is a link.
    5. Whatever buckets are then still open is compared as a whole: all pairs of
       their members in different classes are candidates, but those that
       cannot reach the threshold by their prefixes (see ``_unmet``).  So the
       number of rounds affects the work, never the classes.

    At similarity 0.8 a pair shares one of 16 bands of 4 with probability
    1-(1-0.8**4)**16 = 0.9998.  Texts without words (null, empty) belong to no
    class but their own; a text under five words is one shingle.  Repeated rows
    share a decision; rows that repeat an id with another text are told apart.  A null id
    stands alone.  An empty table gives an empty result.
    """
    return _decided(docs, threshold, bands, rows, id_col, text_col, weighting).drop("h")


def _decided(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", weighting: str = "set") -> DataFrame:
    """The rows of ``near_duplicates`` with ``h``, the key of the row's text."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_key(text_col).alias("h"))
    signed = settled(source.mapInArrow(_band_keys(bands, rows, weighting), f"id {kind}, h long, filled boolean, same long, keys array<long>"), "near-signatures")
    solid = signed.filter("filled AND id IS NOT NULL")
    members = settled(solid.groupBy(F.col("same").alias("member")).agg(F.min(F.struct("id", "h")).alias("row"), F.count("*").alias("copies"), F.first("keys").alias("keys")), "near-members")
    placed = members.select("member", F.posexplode("keys").alias("band", "key")).select("member", F.xxhash64("band", "key").alias("bucket"))
    # Aggregates are written before they meet their rows again: a join whose two sides are
    # dealt out anew is one whose large buckets Spark can split.
    shared = settled(placed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"), "near-shared")
    placed = settled(placed.join(shared, "bucket"), "near-buckets")
    discard(shared)
    sets = settled(_sets(source, members.join(placed.select("member").distinct(), "member", "left_semi").select("member", "row"), weighting), "near-shingles")

    links, classes, tried = None, None, None
    for nth in itertools.count():  # a round that goes on has merged classes, so it ends
        order = F.xxhash64(F.lit(nth), "bucket", "member")
        field = placed.withColumn("root", F.col("member")) if classes is None else settled(_open(placed, classes), f"near-open-{nth}")
        who = F.struct("member", "root")
        leaders = settled(field.groupBy("bucket").agg(F.min_by(who, order).alias("low"), F.max_by(who, order).alias("high")), f"near-leaders-{nth}")
        # Both leaders of a bucket in one row each; members of a leader's own class need no more links to it.
        met = field.join(leaders, "bucket").select("member", "root", F.explode(F.array("low", "high")).alias("y")).filter("root <> y.root")
        found = met.select(F.least("member", "y.member").alias("a"), F.greatest("member", "y.member").alias("b")).distinct()
        if tried is not None:
            found = found.join(tried, ["a", "b"], "left_anti")
        found = settled(found, f"near-candidates-{nth}")
        discard(leaders)
        if nth:
            discard(field)
        n_found = found.count()
        if not n_found:
            break
        verified = settled(_verified(sets, found, threshold), f"near-links-{nth}")
        tried = found if tried is None else tried.unionByName(found)
        n_links = verified.count()
        if not n_links:
            break
        links = verified if links is None else links.unionByName(verified)
        discard(classes)
        classes = settled(components(links), f"near-classes-{nth}")
        if n_links * LINK_SHARE < n_found:
            break
    # Leaders only shrink the work: what they left open is compared without exception.
    field = placed.withColumn("root", F.col("member")) if classes is None else _open(placed, classes)
    rest = _unmet(sets, settled(field.select("member", "root").distinct(), "near-unmet"), threshold)
    if rest is not None:
        if tried is not None:
            rest = rest.join(tried, ["a", "b"], "left_anti")
        verified = settled(_verified(sets, settled(rest, "near-candidates-rest"), threshold), "near-links-rest")
        if not verified.isEmpty():
            links = verified if links is None else links.unionByName(verified)
            classes = components(links)
    if links is None:
        named = members.select("member", "row", F.col("member").alias("root"), F.lit(0).cast("long").alias("n_links"))
    else:
        degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
        named = members.join(classes, members["member"] == classes["node"], "left").drop("node").join(degree, members["member"] == degree["node"], "left")
        named = named.select("member", "row", F.coalesce("root", "member").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    # Members are named by their sets, so a class takes its name from its least row.
    first = named.groupBy("root").agg(F.min("row").alias("stays"))
    named = named.join(first, "root").select("member", "stays", "n_links")
    inside = F.col("filled") & F.col("id").isNotNull()
    alone = F.concat(F.lit("row "), F.col("id").cast("string"))
    rows_ = signed.select("id", "h", F.when(inside, F.col("same").cast("string")).otherwise(F.coalesce(alone, F.lit("row"))).alias("key"))
    out = rows_.join(named.withColumn("key", F.col("member").cast("string")), "key", "left")
    return out.select("id", "h", F.coalesce("stays.id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("stays").isNull() | ((F.col("stays.id") == F.col("id")) & (F.col("stays.h") == F.col("h")))).alias("kept"))


# Leaders are drawn anew while one in so many candidates is a link; below that, comparing the rest by prefixes is less work.
LINK_SHARE = 10


def _open(placed: DataFrame, classes: DataFrame) -> DataFrame:
    """``bucket, member, root`` of the buckets that hold members of several classes."""
    named = placed.join(classes, placed["member"] == classes["node"], "left").select("bucket", "member", F.coalesce("root", "member").alias("root"))
    several = named.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("bucket")
    return named.join(several, "bucket").select("bucket", "member", "root")


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for member, root, raw in zip(*batch.columns, strict=True):
            shingles = np.frombuffer(raw.as_buffer(), np.int64)
            n = len(shingles)
            for at in range(0, n, CHUNK_BYTES // 8):
                part = shingles[at : at + CHUNK_BYTES // 8]
                same = [pa.array(np.full(len(part), v, np.int64)) for v in (member.as_py(), root.as_py(), n)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(part)], names=["member", "root", "size", "shingle"])


def _unmet(sets: DataFrame, field: DataFrame, threshold: float) -> DataFrame | None:
    """``a, b``: a superset of the pairs of ``field`` (``member, root``) in different
    classes whose similarity reaches the threshold; None if field is empty.

    Prefix filter: in any order of all shingles, two such sets share one among
    each one's first size - ceil(threshold * size) + 1.  First come shingles
    that occur in one class only and so make no pair, then rare ones; what a
    template puts into every text comes last.  From the first shared shingle on
    both sets must still have enough left, and sizes must be alike.  Of a
    shingle's holders those in its most frequent class are not paired with
    each other, so a large class costs no more than its members.
    """
    if field.isEmpty():
        return None
    texts = sets.join(field, sets["id"] == field["member"]).select("member", "root", "shingles")
    cells = texts.mapInArrow(_elements, "member long, root long, size long, shingle long")
    across = settled(cells.groupBy("shingle").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("shingle", "n"), "near-across")
    common = cells.join(across, "shingle")
    one = Window.partitionBy("member")
    ranked = common.select("member", "root", "size", "shingle", (F.col("size") - F.count("*").over(one) + F.row_number().over(one.orderBy("n", "shingle")) - 1).alias("at"))
    least = F.ceil(F.col("size") * threshold - 1e-9)
    heads = settled(ranked.filter(F.col("at") <= F.col("size") - least), "near-prefixes")
    discard(across)
    top = heads.groupBy("shingle", "root").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("roots")).filter("roots > 1")
    top = settled(top.select("shingle", F.col("top.root").alias("top")), "near-tops")
    y = heads.join(top, "shingle")
    x = y.filter("root <> top").select("shingle", *(F.col(c).alias(f"x_{c}") for c in ("member", "root", "size", "at")))
    enough = F.least(F.col("size") - F.col("at"), F.col("x_size") - F.col("x_at")) >= (F.col("size") + F.col("x_size")) * (threshold / (1 + threshold)) - 1e-6
    alike = F.least("size", "x_size") >= F.greatest("size", "x_size") * threshold - 1e-6
    once = (F.col("root") == F.col("top")) | (F.col("x_member") < F.col("member"))
    pairs = x.join(y, "shingle").filter((F.col("root") != F.col("x_root")) & once & alike & enough)
    return pairs.select(F.least("member", "x_member").alias("a"), F.greatest("member", "x_member").alias("b")).distinct()


def _sets(source: DataFrame, members: DataFrame, weighting: str) -> DataFrame:
    """``id, shingles`` of the members that share a bucket with another, each by
    the text of its own row.  Texts are dealt once, by a shuffle at every size: a broadcast of
    the members would only do for few."""
    wanted = members.select(F.col("row.id").alias("w"), F.col("row.h").alias("w_h"), "member").hint("shuffle_hash")
    texts = source.join(wanted, (source["id"] == wanted["w"]) & (source["h"] == wanted["w_h"])).select("member", "text")
    return texts.mapInArrow(_shingle_lists(weighting), "id long, shingles binary").dropDuplicates(["id"])


def _verified(sets: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the threshold."""
    x, y = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    joined = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    scored = joined.mapInArrow(_similarity, "a long, b long, similarity double")
    return scored.filter(F.col("similarity") >= threshold)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents with one of each class of near copies, all columns kept."""
    stays = _decided(docs, id_col=id_col, text_col=text_col, **how).filter("kept").select(F.col("id").alias("_stays"), F.col("h").alias("_stays_h")).distinct()
    keyed, h = with_text_key(docs, text_col)
    return keyed.join(stays, keyed[id_col].eqNullSafe(stays["_stays"]) & (keyed[h] == stays["_stays_h"]), "left_semi").drop(h)
